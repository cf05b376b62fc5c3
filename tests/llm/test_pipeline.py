"""Stages of the pipeline against what they are to leave."""

import random

import corpus_pipeline
from tidelake.llm import minhash

SENTENCE = "Please read the terms of this service before you go on."
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _line(rng, n=12):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_line_dedup_takes_lines_that_stand_in_other_documents_and_spares_near_copies(spark):
    rng = random.Random(4)
    own = {i: [_line(rng) for _ in range(6)] for i in range(30)}
    texts = {i: [*x[:3], SENTENCE if i % 2 else SENTENCE.replace("terms", "term"), *x[3:]] for i, x in own.items()}
    # near copies of 5, one of them before its time with a line that 20 has too; their original stays the first
    for i in (40, 41, 42):
        texts[i] = [*texts[5][:6], f"{texts[5][6]} {_line(rng, 1)}"]
    texts[41].append(own[20][0])
    texts[50] = [*own[50 - 44], _line(rng), _line(rng), _line(rng), _line(rng)]
    docs = spark.createDataFrame([(i, "\n".join(x), "en", "s", 0) for i, x in texts.items()], COLUMNS)
    left = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert all(n == len(t) for t, n in left.values())
    left = {i: t.split("\n") for i, (t, _) in left.items()}
    assert left[0] == texts[0] and all(left[i] == own[i] for i in range(1, 30))
    assert left[50] == texts[50][6:]
    assert left[40] == [x for x in texts[40] if x != SENTENCE] and left[41] == [x for x in texts[41] if x not in (SENTENCE, own[20][0])]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, "\n".join(x), "en", "s", 0) for i, x in left.items()], COLUMNS), "")
    assert {r.doc_id for r in kept.collect()} == {*range(30), 50}
    assert {r.doc_id for r in minhash.deduplicate(docs, **corpus_pipeline.NEAR).collect()} == {*range(30), 50}


def test_no_line_goes_for_standing_in_a_document_that_near_dedup_drops(spark):
    rng = random.Random(5)
    base, shared = [_line(rng) for _ in range(12)], _line(rng)
    texts = {1: base, 2: [*base, shared], 3: [*[_line(rng) for _ in range(5)], shared]}
    docs = spark.createDataFrame([(i, "\n".join(x), "en", "s", 0) for i, x in texts.items()], COLUMNS)
    left = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert left[1] == base and left[2] == base and left[3] == texts[3]


def test_the_same_frequent_line_goes_from_small_and_large_sources(spark):
    words = "concat_ws(' ', transform(sequence(1, 60), k -> concat('w', translate(cast(id * 100 + k as string), '0123456789', 'abcdefghij'))))"
    line = f"'{SENTENCE}'"
    text = f"if(id < 60 or id >= 50000, concat({line}, '\\n', {words}), {words})"
    docs = spark.range(50050).selectExpr("id as doc_id", f"{text} as text", "'en' as lang", "if(id < 50000, 'large', 'small') as source", "0L as n_chars")
    out = corpus_pipeline.quality_rules(spark, docs, "").where(f"startswith(text, {line})")
    assert out.isEmpty()
    assert corpus_pipeline.quality_rules(spark, docs, "").count() == 50050
