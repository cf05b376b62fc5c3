"""Each operator against a plain version on a small table of awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelake.llm import bpe, bytescan, editlines, linefreq, minhash, packing, sharding, subword, suffixdedup, tokenscan, urlfilter, urltable, winnow
from tidelake.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 1


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_are_the_components_of_exact_links(docs, rows, words):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(minhash.shingle_set(t, words))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    out = minhash.near_duplicates(docs, words=words).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert sorted(r.n_shingles for r in out) == sorted(len(minhash.shingle_set(t, words)) for _, t in rows)


def test_signatures_estimate_similarity_with_less_spread_than_chance():
    rng = np.random.default_rng(0)
    found = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 150).astype(np.uint64)
        a, b = pool[:120], pool[30:]  # 90 of 150 in common
        sig = minhash.superminhash(np.concatenate((a, b)), np.array([0, 120, 240]), 128)
        found.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(found) - 0.6) < 0.02 and np.std(found) < (0.6 * 0.4 / 128) ** 0.5


def test_components_by_rounds_and_at_once(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    get = lambda n: {r.node: r.component for r in components(df, n).collect()}
    assert get(0) == get(10**6) and get(0)[130] == 100


def test_deduplicate_keeps_one_of_a_group_and_all_columns(docs, rows):
    out = minhash.deduplicate(docs, words=5)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert kept.count(0) == 1 and 6 not in kept and {1, 2, 3, 32} <= set(kept)


# 2


def plain_stats(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_base_statistics(docs, rows):
    out = linefreq.judge(docs).collect()
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == sorted(plain_stats(t) for _, t in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    own = lambda i: " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))
    menu = "Home | Products | Contact 2024 " + " ".join("menu" + chr(97 + j % 26) + chr(97 + j // 26) for j in range(90))
    rows = [(i, f"{menu}\n{own(i)}", "s") for i in range(20)] + [(50, menu + "\nand a few words more", "s")] + [(60 + i, own(60 + i), "s") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdicts = {r.doc_id: r for r in linefreq.judge(df).collect()}
    assert verdicts[0].n_removed_words > 90 and verdicts[5].n_removed_words > 90 and verdicts[5].kept
    assert not verdicts[50].kept and not verdicts[50].base_failed
    left = {r.doc_id: r.text for r in linefreq.clean(df).collect()}
    assert left[5] == own(5) and left[0] == own(0) and 50 not in left and left[65] == own(65)


def test_verdicts_are_those_of_a_plain_count(spark, rows):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [" ".join(word() for _ in range(rng.randrange(3, 12))) for _ in range(6)]
    more = [(100 + i, "\n".join([" ".join(word() for _ in range(rng.randrange(30, 70))), *rng.sample(shared, rng.randrange(5))]).replace(" ", rng.choice([" ", "  ", "\t"])), f"h{i % 2}") for i in range(60)]
    more += [(200, more[3][1], "h1"), (201, more[3][1], "h1"), (None, more[4][1], "h0"), (300, None, None), (301, "", "h0")]
    norm = lambda x: re.sub(" +", " ", re.sub(r"[\t\x0b\x0c\r]", " ", re.sub("[1-9]", "0", lower(x)))).strip(" ")
    texts, holders = defaultdict(set), defaultdict(set)
    for _, t, host in more:
        texts[host or ""].add(t)
        for x in (t or "").split("\n"):
            holders[host or "", norm(x)].add(t)
    hot = {k for k, v in holders.items() if len(v) > 5 and (10 * len(v) > len(texts[k[0]]) or len(v) > 50)}
    want = []
    for i, t, host in more:
        n, _, _, _, repeats = plain_stats(t)
        lost = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if (host or "", norm(x)) in hot)
        failed = n < 50 or 100 * repeats > 50 * n
        want.append((str(i), n, lost, failed, not failed and n - lost >= 50 and 100 * (n - lost) >= 30 * n))
    df = spark.createDataFrame(more, "doc_id long, text string, source string")
    got = [(str(r.doc_id), r.n_words, r.n_removed_words, r.base_failed, r.kept) for r in linefreq.judge(df).collect()]
    assert sorted(got) == sorted(want)
    assert sum(not failed and not kept for *_, failed, kept in got) >= 5


# 3


def plain_windows(words, span=10):
    n = min(span, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@pytest.mark.parametrize("block_bytes", [32 << 20, 600, 100])
def test_contamination(spark, docs, rows, block_bytes):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = dict((i, t) for i, t in rows if t)
    items = [(1, " ".join(texts[20].split()[30:55])), (2, " ".join(texts[20].split()[30:55])), (3, " ".join(texts[32].split()[100:104])), (4, None), (5, "--"), (6, "one two"), (70, texts[36]), (8, texts[33])]
    items += [(100 + i, " ".join(f"unseen{i}n{j}" for j in range(20))) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = winnow.digest(winnow.contamination(docs, bench, block_bytes=block_bytes)).collect()
    expected = []
    for i, t in rows:
        words, hit, which = token.findall(lower(t)), set(), set()
        for item, text in items:
            for w in plain_windows(token.findall(lower(text))):
                for p in range(len(words) - len(w) + 1):
                    if tuple(words[p : p + len(w)]) == w:
                        hit |= set(range(p, p + len(w)))
                        which.add(str(item))
        expected.append((str(i), len(words), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit)))
    got = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out]
    assert sorted(got) == sorted(expected)
    left = winnow.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, *_, bad in [(x, e[-1]) for (x, _), e in zip(rows, expected, strict=True)] if not bad}


def test_contamination_gives_every_row_back_whatever_the_blocks(spark, docs):
    bench = spark.createDataFrame([(i, " ".join(f"unseen{i}n{j}" for j in range(20))) for i in range(20)] + [(30, "one two")], "item_id long, text string")
    one, many = ([str(r) for r in winnow.digest(winnow.contamination(docs, bench, block_bytes=n)).collect()] for n in (1 << 20, 600))
    assert sorted(one) == sorted(many)


# 4


def test_classifier_tells_held_out_documents_apart(spark):
    random.seed(2)
    make = lambda bad: " ".join(random.choice(["lorem", "ipsum", "dolor", "amet", "elit"]) + ("$$$" if bad else "") for _ in range(random.randrange(20, 60)))
    data = [(i, make(i % 3 == 0), int(i % 3 != 0)) for i in range(240)] + [(500, None, None), (501, "", 1), (None, "lorem", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    model = subword.fit(df.select("doc_id", "text"), df.where("doc_id < 120 or doc_id > 400").select("doc_id", "quality"))
    scored = {r.doc_id: r.score for r in subword.score(df.select("doc_id", "text", F.lit(0).alias("score")), model).collect()}
    assert len(scored) == len(data) and all(0 <= s <= 1 for s in scored.values())
    assert sum((scored[i] >= 0.7) == bool(q) for i, _, q in data[120:240]) >= 118
    assert scored[500] == scored[501]


LOW = 2**64 - 1


def plain_mix(x):
    x = (x + 0x9E3779B97F4A7C15) & LOW
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & LOW
    x = (x ^ x >> 27) * 0x94D049BB133111EB & LOW
    return x ^ x >> 31


def plain_features(text, bits):
    """Buckets of the words, and of all 3-grams and 4-grams of characters."""
    found = Counter()
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        total = sum((plain_mix(b) | 1) * pow(0x2545F4914F6CDD1D, k, 2**64) for k, b in enumerate(word)) & LOW
        found[plain_mix((total + len(word)) & LOW) >> 64 - bits] += 1
    for n, factor in ((3, 2654435761), (4, 2246822519)):
        for i in range(len(text) - n + 1):
            value = 0
            for c in text[i : i + n]:
                value = (value * 0x9E3779B1 + ord(c)) % 2**32
            found[(value * factor % 2**32) >> 32 - bits] += 1
    return found


def plain_training(examples, labels, bits, dim, epochs, rate, seed=7):
    """One document at a time, in plain numbers."""
    order = np.random.default_rng(seed)
    vectors = [[float(x) for x in row] for row in order.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)]
    output, share, step = [[0.0, 0.0] for _ in range(dim)], min(max(sum(labels) / len(labels), 0.01), 0.99), 0
    bias = [math.log(1 - share), math.log(share)]
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            now = rate * (1 - step / (epochs * len(examples)))
            step += 1
            total = sum(examples[i].values())
            if not total:
                continue
            weight = {b: n / total for b, n in examples[i].items()}
            mean = [sum(w * vectors[b][k] for b, w in weight.items()) for k in range(dim)]
            logits = [sum(m * o[c] for m, o in zip(mean, output, strict=True)) + bias[c] for c in (0, 1)]
            error = [math.exp(x - max(logits)) for x in logits]
            error = [x / sum(error) for x in error]
            error[labels[i]] -= 1
            back = [sum(o[c] * error[c] for c in (0, 1)) for o in output]
            scale = max(1e-3, sum(m * m for m in mean))
            for k in range(dim):
                for c in (0, 1):
                    output[k][c] -= now * mean[k] * error[c] / scale
            bias = [x - 0.1 * now * e for x, e in zip(bias, error, strict=True)]
            square = sum(w * w for w in weight.values())
            for b, w in weight.items():
                for k in range(dim):
                    vectors[b][k] -= now / square * w * back[k]
    return vectors, output, bias


def test_classifier_is_that_of_a_plain_version(spark, rows):
    bits, dim, epochs, rate = 9, 4, 3, 0.05
    data = [(i, t, n % 2) for n, (i, t) in enumerate(rows) if i is not None and t and len(t) < 3000 and i != 6] + [(900, "日本語のテキスト ß\n", 1), (901, "", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, quality long")
    model = subword.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"), bits=bits, dim=dim, epochs=epochs, rate=rate)
    packed = lambda f: (np.array(sorted(f), "<u4").tobytes(), np.array([f[b] for b in sorted(f)], "<u4").tobytes())
    examples = sorted(((y, *packed(f), f) for _, t, y in data for f in [plain_features(t, bits)]), key=lambda x: x[:3])
    vectors, output, bias = plain_training([x[3] for x in examples], [x[0] for x in examples], bits, dim, epochs, rate)
    for r in subword.score(df, model).collect():
        text = next(t for i, t, _ in data if i == r.doc_id)
        features = plain_features(text, bits)
        total = sum(features.values())
        margin = sum(n / total * sum(v * (o[1] - o[0]) for v, o in zip(vectors[b], output, strict=True)) for b, n in features.items()) + bias[1] - bias[0]
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-3


def test_very_long_texts_are_read_in_stretches_and_whole(spark, monkeypatch):
    words = [f"wörd{i % 97}x{i % 13}" for i in range(4000)]
    text = " ".join(words)
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short one")], "doc_id long, text string")
    model = subword.train([(np.arange(64, dtype=np.int32), np.ones(64, np.float32)), (np.arange(32, 128, dtype=np.int32), np.ones(96, np.float32))], np.array([0, 1]), 10)

    def found():
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text, text + " end", "short one"]), pa.array([5, 6, 7])], ["a", "b", "c"])
        signed = [r for b in minhash._signer(5, 8, 2)([batch]) for r in b.to_pylist()]

        class Table:
            value = model.margin_table()

        class Items:
            value = winnow.Index([("i", " ".join(words[1500:1520]))], 10, 5)

        scored = [r["score"] for b in subword._scorer(Table, 0.1, 10)([batch.select([0, 1])]) for r in b.to_pylist()]
        hits = [r for b in winnow._matcher(Items)([batch]) for r in b.to_pylist()]
        return signed, scored, hits

    whole = found()
    for module in (bytescan, subword):
        monkeypatch.setattr(module, "SLICE_BYTES", 1000)
    monkeypatch.setattr(bytescan.stretches, "__defaults__", (1000,))
    monkeypatch.setattr(bytescan.slices, "__defaults__", (1000,))
    parts = found()
    assert whole[0] == parts[0] and whole[2] == parts[2] and np.allclose(whole[1], parts[1], atol=1e-9)
    assert whole[2][0]["lo"] and df.count() == 3


# 5


def test_urls(spark):
    rules = [urlfilter.Rule.parse(x) for x in ("block com/en/", "allow example.com/en/7", "allow net/de/")]
    urls = ["https://A.Example.COM/en/71?x", "http://example.com/en/8", "http://notexample.com/en/7", "http://x.net/de/", "http://net/de/1#y", "http://www.cheap-pills.example.org/fr/1", "http://museum.example.org/fr/1", None, "no scheme", "http://", "a://b://c/d", "http://日本.example.org/ü/1"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: r for r in urlfilter.judge(df, rules).collect()}
    assert (out[0].host, out[0].path, out[0].rule, out[0].verdict) == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert [out[i].rule for i in (1, 2, 3, 4)] == ["com/en/", "com/en/", "net/de/", "net/de/"]
    assert [out[i].verdict for i in (1, 5, 6, 7, 8, 9)] == ["block", "block", "allow", "allow", "allow", "allow"]
    assert (out[10].host, out[10].path) == ("b:", "//c/d")
    for r in out.values():
        assert r.score == urlfilter.score_of(r.host, r.path)


def test_unseen_hosts_are_told_apart(spark):
    held = [x for x in urltable.labelled_urls() if x[3]]
    learned = {x[0] for x in urltable.labelled_urls() if not x[3]}
    assert len(held) > 1500 and not learned & {x[0] for x in held}
    df = spark.createDataFrame([(i, f"https://{host}{path}?q") for i, (host, path, *_) in enumerate(held)], "page_id long, url string")
    blocked = {r.page_id for r in urlfilter.judge(df, []).where("verdict = 'block'").collect()}
    hits = sum(held[i][2] for i in blocked)
    assert hits >= 0.95 * sum(x[2] for x in held) and hits >= 0.98 * len(blocked)


def test_urls_of_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string, score long, _host string, rule int")
    assert urlfilter.judge(none, []).collect() == []


# 6, 9


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_fast_ids_are_those_of_the_library(rows):
    random.seed(3)
    texts = [t for _, t in rows] + ["it's I'll 's 're''s  don't \n\n x", "<|endoftext|> a", "\n 'd 12'34 'm5", "a" * 1000]
    texts += ["".join(random.choice("ab 's'tr ev\n\té12日!.l") for _ in range(random.randrange(40))) for _ in range(500)]
    got = []
    for lo, hi, ids, at in bpe.load(PATH).encode_column(pa.array(texts)):
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    assert got == [ids_of(t) for t in texts]


def test_long_texts_have_the_same_ids_in_stretches(rows):
    text = next(t for i, t in rows if i == 32) + " it's we'll  a1 b2 é ñ  x\n" * 50 + "y" * 300 + " end of it"
    for limit in (64, 500):
        ((_, _, ids, at),) = bpe.load(PATH).encode_column(pa.array([text]), limit)
        assert ids.tolist() == ids_of(text) and at.tolist() == [0, len(ids)]


def test_packing_is_an_exact_round_trip(docs, rows, nothing):
    size = 256
    out = packing.pack(docs, PATH, size=size, keep_ids=True).collect()
    want = Counter((i, *ids_of(t), 1) for i, t in rows)
    parts = defaultdict(list)
    for r in out:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        parts[r.doc_id, r.start].append(r)
    assert Counter(x for r in out for x in [r.doc_id] for _ in r.ids) == Counter(i for i, t in rows for _ in range(len(ids_of(t)) + 1))
    for i, *ids in want:
        for start in range(0, len(ids), size):
            assert any(list(r.ids) == ids[start : start + size] and r.doc_tokens == len(ids) for r in parts[i, start])
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack(nothing, PATH).count() == 0


def test_patterns_hold_every_piece():
    random.seed(1)
    for _ in range(50):
        histogram = dict(Counter(random.randrange(1, 65) for _ in range(random.randrange(300))))
        patterns = packing.shortest_pack_first(histogram, 64)
        held = Counter()
        for n, lengths in patterns:
            assert sum(lengths) <= 64
            held.update({k: v * n for k, v in Counter(lengths).items()})
        assert held == histogram and len(patterns) <= 3 * 64


def test_patterns_are_those_of_packs_filled_one_by_one():
    """Longest pieces first, each into the shortest pack that there is, or a new one where it doesn't fit."""
    rng = random.Random(6)
    for _ in range(40):
        lengths = sorted((rng.randrange(1, 33) for _ in range(rng.randrange(1, 200))), reverse=True)
        packs = []
        for n in lengths:
            pack = min(packs, key=sum, default=None)
            if pack is None or sum(pack) + n > 32:
                packs.append(pack := [])
            pack.append(n)
        got = [list(lengths) for count, lengths in packing.shortest_pack_first(dict(Counter(lengths)), 32) for _ in range(count)]
        assert sorted(map(sum, got)) == sorted(map(sum, packs))  # packs of one length are alike


@pytest.mark.parametrize(("separator", "dtype"), [(70_000, "<u2"), (300, "<u2"), (50256, "<i2")])
def test_separators_that_text_may_have_are_refused(docs, separator, dtype):
    with pytest.raises(ValueError, match="id "):
        tokenscan.write_tokens(docs, PATH, separator=separator, dtype=dtype)


def test_token_counts_over_any_blocks(spark, docs, rows, nothing):
    index = tokenscan.write_tokens(docs, PATH)
    files = index.groupBy("file").agg(F.sum("n_bytes").alias("n_bytes"))
    want = sorted((str(i), len(ids_of(t))) for i, t in rows)
    for block in (7, 1000, 1 << 20):
        counted = index.join(tokenscan.token_counts(files, block_tokens=block), ["file", "ordinal"])
        assert sorted((str(r.doc_id), r.n_tokens) for r in counted.collect()) == want
    assert tokenscan.token_counts(tokenscan.write_tokens(nothing, PATH).groupBy("file").agg(F.sum("n_bytes").alias("n_bytes"))).count() == 0


def test_token_files_without_a_last_separator(spark, tmp_path):
    for name, ids in (("a", [5, 9, 9, 9, 5, 5]), ("b", [9]), ("c", []), ("d", [1, 2, 3])):
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}", (tmp_path / n).stat().st_size) for n in "abcd"], "file string, n_bytes long")
    for block in (1, 2, 50):
        got = sorted((r.file[-1], r.ordinal, r.start, r.n_tokens, r.terminated) for r in tokenscan.token_counts(files, separator=9, block_tokens=block).collect())
        assert got == [("a", 0, 0, 1, True), ("a", 1, 2, 0, True), ("a", 2, 3, 0, True), ("a", 3, 4, 2, False), ("b", 0, 0, 0, True), ("d", 0, 0, 3, False)]


# 7


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeated_bytes(docs, rows, nothing, crowd):
    best = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - 49):
                best[b[p : p + 50]] = min(best.get(b[p : p + 50], i), i)
    want = []
    for i, b in raw:
        mask = bytearray(len(b))
        for p in range(len(b) - 49) if i is not None else ():
            if best[b[p : p + 50]] < i:
                mask[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        want.append((str(i), len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(docs, crowd=crowd).collect()]
    assert sorted(got) == sorted(want)
    assert suffixdedup.remove_repeats(nothing).count() == 0


def test_two_texts_under_one_id(spark):
    a, b = "".join(map(chr, range(65, 120))) * 3, "".join(map(chr, range(60, 126))) * 2
    df = spark.createDataFrame([(1, a), (2, a + b), (2, b), (3, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixdedup.remove_repeats(df).collect())
    overlap = [p for p in range(len(b) - 49) if b[p : p + 50] in a]
    assert got[0] == (1, len(a), 0) and got[-1] == (3, len(b), len(b)) and got[2][2] >= len(a) - 1
    assert (got[1][2] > 0) == bool(overlap)


# 8


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def edited(rng, alphabet, n):
    a = "".join(rng.choice(alphabet) for _ in range(n))
    b = list(a)
    for _ in range(rng.randrange(5)):
        k, i = rng.randrange(3), rng.randrange(len(b) + 1)
        if k == 0:
            b.insert(i, rng.choice(alphabet))
        elif b:
            b[min(i, len(b) - 1) : min(i, len(b) - 1) + 1] = [] if k == 1 else [rng.choice(alphabet)]
    return a, "".join(b)


@pytest.mark.parametrize("tau", [1, 2])
def test_banded_distance_and_segments(spark, tau):
    rng = random.Random(tau)
    pairs = [edited(rng, "abé", rng.randrange(4, 24)) for _ in range(400)]
    df = spark.createDataFrame([(a, b, distance(a, b) <= tau) for a, b in pairs], "a string, b string, near boolean").cache()
    wrong = df.where(editlines.within_distance(editlines.characters(F.col("a")), editlines.characters(F.col("b")), tau) != F.col("near"))
    assert wrong.count() == 0
    own, probes = {}, {}
    for c in "ab":
        probes[c] = editlines.segment_keys(F.col(c), F.lit(0), tau)
        own[c] = F.array(*[F.get(probes[c], F.lit(k)) for k in editlines.own_places(tau)])
    df = df.where(f"near and length(a) > {tau} and length(b) > {tau}").select("a", "b", *[x.alias(f"{k}{c}") for k, s in (("o", own), ("p", probes)) for c, x in s.items()])
    assert df.where(~F.arrays_overlap("oa", "pb") & ~F.arrays_overlap("ob", "pa")).count() == 0


@pytest.mark.parametrize("within", [False, True])
def test_line_dedup(spark, within):
    rng = random.Random(9)
    lines = [x for _ in range(12) for x in edited(rng, "abcde ", 30)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(5))) for i in range(12)] + [(20, None), (21, ""), (22, "short\nshort"), (23, lines[0].upper() + "\n" + lines[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    norm = lambda x: re.sub(" +", " ", lower(x)).strip(" ")
    first = {}
    places = [(i, k, norm(x), (i, norm(x)) if within else norm(x)) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if len(norm(x)) >= 16]
    for i, k, x, key in places:
        first.setdefault(key, (i, k))
    want = set()
    for i, k, x, key in places:
        near = any(distance(x, y[1] if within else y) <= 2 and f < first[key] for y, f in first.items() if y != key and (not within or y[0] == i))
        if near or (i, k) != first[key]:
            want.add((i, k, near))
    got = {(r.doc_id, r.pos, r.near) for r in editlines.removals(df, within_document=within).collect()}
    assert got == want and len(want) >= 5
    left = {r.doc_id: r.text for r in editlines.dedup_lines(df, within_document=within).collect()}
    gone = {(i, k) for i, k, _ in want}
    for i, t in rows:
        assert left[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone))


@pytest.mark.parametrize("within", [False, True])
def test_lines_of_the_same_words_are_told_apart(spark, within):
    orders = [" ".join(x) for x in itertools.permutations("ab bc cd de ef fg gh hi ij".split())]
    df = spark.createDataFrame([(i, "\n".join(orders[i::100])) for i in range(100)], "doc_id long, text string")
    lines = editlines._lines(df, "doc_id", "text", 16, within)
    assert lines.select("h").distinct().count() == lines.select("g").distinct().count() == len(orders) == lines.count()


def test_lines_of_equal_first_hash_are_told_apart_by_the_second(spark, monkeypatch):
    lines = editlines._lines
    monkeypatch.setattr(editlines, "_lines", lambda *a: lines(*a).withColumn("h", F.lit(7).cast("long")))
    rows = [(i, f"{x * 9} of line\nshared by all of them") for i, x in enumerate(["ab", "cd", "ef", "ab", "日本"])]
    got = sorted((r.doc_id, r.pos, r.near) for r in editlines.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, False), (2, 1, False), (3, 0, False), (3, 1, False), (4, 1, False)]


def test_an_equal_line_in_very_many_documents_is_no_repeat_within_them(spark):
    df = spark.range(300_000).selectExpr("id as doc_id", "'the same line of words in every document' as text")
    assert editlines.removals(df, within_document=True).isEmpty()
    assert editlines.removals(df).count() == 299_999


# 10


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_and_slots(docs, rows, nothing):
    keys = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    out = sharding.shard(docs, payload=("text",)).collect()
    assert len(out) == len(rows)
    slots, where = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        where[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(w) == 1 for w in where.values())
    for key, ((shard, grown),) in where.items():
        assert (shard, grown) == tuple(plain_jump(plain_mix((key or 0) % 2**64), n) for n in (8, 9))
    for shard in slots:
        keys = [r.doc_id for r in sorted(out, key=lambda r: r.slot) if r.shard == shard and r.doc_id is not None]
        assert keys == sorted(keys)
    assert sharding.shard(nothing).count() == 0


# tables without rows, and clashing columns


def test_empty_tables_give_no_rows(spark, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert minhash.near_duplicates(nothing).count() == 0
    assert linefreq.judge(nothing).count() == 0 and linefreq.clean(nothing).columns == nothing.columns
    assert winnow.contamination(nothing, bench).count() == 0
    assert subword.score(nothing, subword.fit(nothing, labels)).count() == 0
    assert editlines.line_report(nothing).count() == 0 and editlines.dedup_lines(nothing).count() == 0


def test_awkward_rows_pass_line_operators(docs, rows):
    assert editlines.line_report(docs).count() == len(rows)
    assert editlines.dedup_lines(docs).columns == docs.columns and editlines.dedup_lines(docs).count() == len(rows)
    kept = linefreq.clean(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 20, 32}
