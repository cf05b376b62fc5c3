import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import SF, same
from tokenizers import Tokenizer

import corpus_pipeline
from tidelake.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, q.queries()[name], q.oracle_sql()[name])


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(q.tokenizer())
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_every_query_has_sql_or_a_test_here():
    assert set(q.queries()) - set(q.oracle_sql()) == {"op4_subword_quality", "op6_packing", "op9_separator_scan"}


def test_scores_are_of_held_out_labels_and_do_not_see_them(spark, texts, tmp_path):
    rows = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    scores = {}
    for name, flip in (("as they are", lambda i: False), ("held out", held), ("others", lambda i: not held(i))):
        d = tmp_path / name.replace(" ", "-")
        spark.createDataFrame([(r.doc_id, 1 - r.quality if flip(r.doc_id) else r.quality, r.toxic) for r in rows], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
        (d / "documents.parquet").symlink_to(f"{SF}/documents.parquet")
        scores[name] = {r.doc_id: (r.held_out, r.score, r.predicted) for r in q.op4_subword_quality(spark, str(d)).collect()}
    assert scores["as they are"] == scores["held out"] != scores["others"]
    assert set(scores["as they are"]) == set(texts)
    for i, (held_out, score, predicted) in scores["as they are"].items():
        assert (held_out, predicted) == (held(i), int(score >= 0.7)) and 0 <= score <= 1


def test_quality_of_held_out_documents_is_told(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    found = [(r.predicted, truth[r.doc_id]) for r in q.op4_subword_quality(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert len(found) > 50 and sum(a == b for a, b in found) >= 0.93 * len(found)


def test_pieces_are_all_ids_in_sequences_with_little_padding(spark, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in q.op6_packing(spark, SF).collect():
        whole = [*ids[r.doc_id], 1]
        part = np.array(whole[r.start : r.start + r.length], "<u4")
        assert (r.length, r.doc_tokens, r.ids_crc32) == (len(part), len(whole), zlib.crc32(part.tobytes())) and r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    total = {i: len(x) + 1 for i, x in ids.items()}
    assert set(pieces) == set(total)
    filled = 0
    for i, held in [*pieces.items(), *((None, x) for x in sequences.values())]:
        at = 0
        for start, length in sorted(held):
            assert start == at
            at += length
        assert at <= 2048 if i is None else at == total[i]
    filled = sum(total.values())
    padded = sum(2048 if (n := sum(x for _, x in held)) & (n - 1) else n for held in sequences.values())
    assert padded - filled <= 0.02 * filled


def test_token_counts_are_those_of_the_library(spark, ids):
    assert {r.doc_id: r.n_tokens for r in q.op9_separator_scan(spark, SF).collect()} == {i: len(x) for i, x in ids.items()}


def test_line_frequency_rejects_depleted_documents(spark):
    out = q.op2_line_frequency(spark, "/root/testdata/sf0.1")
    assert out.where("not base_failed and not kept").count() >= 5
    assert out.where("kept").count() >= 0.99 * out.where("not base_failed").count()


def test_pipeline_stages_keep_columns_and_hand_on_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= last
            last = docs.count()
    assert docs.select("doc_id").distinct().count() == last


def test_pipeline_takes_awkward_tables(spark, docs, nothing):
    for table in (docs, nothing):
        out = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == table.columns
        assert out.count() <= table.count()
