"""The whole pipeline against a plain version of its five stages on a small corpus."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_operators import WORD, distance, lower, plain_stats, plain_windows
from tokenizers import Tokenizer

import corpus_pipeline
from tidelake.llm.minhash import shingle_set

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(line):
    return re.sub(" +", " ", re.sub(r"[\t\x0b\x0c\r]", " ", re.sub("[1-9]", "0", lower(line)))).strip(" ")


def make(seed=11):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    line = lambda n=12: " ".join(word() for _ in range(n))
    boiler, shared = "Please Accept all Cookies of this site 2024", [line() for _ in range(4)]
    exam = [line(14), line(30), "short one here"]
    docs = []
    for i in range(40):
        lines = [line(rng.randrange(8, 20)) for _ in range(rng.randrange(6, 9))]
        if i % 4 == 0:
            lines.insert(1, boiler)
        if i % 3 == 0:
            other = shared[i // 3 % 4]
            lines.append(other if i % 2 else other.replace(other[5], "z", 1))
        if i % 13 == 0:
            lines.append(f"see {exam[i % 3]} again")
        docs.append([i, "\n".join(lines), f"s{i % 2}"])
    for i in range(40, 52):  # near copies of one document, exact ones of another
        text = docs[3][1].split(" ") if i < 47 else docs[5][1].split(" ")
        if i < 47:
            text[rng.randrange(len(text))] = word()
        docs.append([i, " ".join(text) + ("\n" + docs[8][1].split("\n")[0] if i == 45 else ""), f"s{i % 2}"])
    docs += [[60, None, "s0"], [61, "", None], [62, "too short", "s1"], [63, "again and again " * 40, "s1"], [64, boiler + "\n" + line(44), "s0"]]
    rng.shuffle(docs)
    return docs, list(zip(["q1", "q2", "q3"], exam, strict=True))


def quality(docs):
    texts, holders = defaultdict(set), defaultdict(set)
    for _, t, host in docs:
        texts[host or ""].add(t)
        for x in (t or "").split("\n"):
            if WORD.search(x):
                holders[host or "", norm(x)].add(t)
    hot = {k for k, v in holders.items() if len(v) > 5 and (10 * len(v) > len(texts[k[0]]) or len(v) > 50)}
    out = []
    for i, t, host in docs:
        n, _, _, _, repeats = plain_stats(t)
        left = [x for x in (t or "").split("\n") if (host or "", norm(x)) not in hot]
        words = sum(len(WORD.findall(x)) for x in left)
        if n >= 50 and 2 * repeats <= n and words >= 50 and 100 * words >= 30 * n:
            out.append([i, "\n".join(left), host])
    return out


def groups(docs):
    sets, parent = {i: shingle_set(t, 5) for i, t, _ in docs}, {i: i for i, *_ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def dedup_lines(docs):
    group = groups(docs)
    places = [(i, k, norm(x)) for i, t, _ in docs for k, x in enumerate(t.split("\n")) if len(norm(x)) >= 16]
    first, inside = {}, {}
    for i, k, x in sorted(places):
        if group[i] == i:
            first.setdefault(x, (i, k))
        inside.setdefault((i, x), k)
    links = defaultdict(set)
    every = sorted({x for *_, x in places})
    for a in every:
        for b in every:
            if a < b and abs(len(a) - len(b)) <= 2 and sum((Counter(a) - Counter(b)).values()) <= 2 and distance(a, b) <= 2:
                links[a].add(b)
                links[b].add(a)
    gone = set()
    for i, k, x in places:
        own, other = first.get(x), min((first[y] for y in links[x] if y in first), default=None)
        near = own is not None and other is not None and other < own
        if group[i] == i:
            go = near or (i, k) != own
        else:
            elsewhere = own or other
            go = near or k > inside[i, x] or elsewhere is not None and elsewhere[0] != group[i]
        if go:
            gone.add((i, k))
    return [[i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), host] for i, t, host in docs], gone


def near_dedup(docs):
    group = groups(docs)
    return [d for d in docs if group[d[0]] == d[0]]


def clean_of(docs, exam):
    windows = [w for _, t in exam for w in plain_windows(TOKEN.findall(lower(t)))]
    out = []
    for d in docs:
        words = TOKEN.findall(lower(d[1]))
        if not any(tuple(words[p : p + len(w)]) == w for w in windows for p in range(len(words) - len(w) + 1)):
            out.append(d)
    return out


def test_run_gives_what_a_plain_version_gives(spark, tmp_path):
    docs, exam = make()
    rows = [(i, t, "en", host, None if t is None else len(t), "more") for i, t, host in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(exam, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = quality(docs)
    lined, gone = dedup_lines(kept)
    single = near_dedup(lined)
    left = clean_of(single, exam)
    assert len(docs) > len(kept) > len(single) > len(left) > 20 and len(gone) > 5

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_name, stage), want in zip(corpus_pipeline.STAGES, (kept, lined, single, left), strict=False):
        table = stage(spark, table, str(tmp_path))
        got = sorted((r.doc_id, r.text, r.source, r.n_chars, r.id) for r in table.collect())
        assert got == sorted((i, t, host, len(t), "more") for i, t, host in want)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in left}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for held, total in [(pieces[i], len(ids[i])) for i in ids] + [(x, None) for x in sequences.values()]:
        at = 0
        for start, length in sorted(held):
            assert start == at and length > 0
            at += length
        assert at == total if total else at <= 2048
