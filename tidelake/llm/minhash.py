"""Near-duplicate detection: SuperMinHash signatures, banding, exact verification, union-find groups."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import LOWER, WHITESPACE, gram_hash, mix, slices, word_hashes
from .components import components
from .scratch import discard, materialize, passing, small

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_LOW32 = _U(0xFFFFFFFF)
#: Elements whose permutations are held at once (one byte per element and position).
_HELD = 1 << 16


def superminhash(elements: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m) of sets of hashed elements; documents without elements keep the maximum.

    An element walks down its own random permutation of the positions; at step j it offers j plus
    a fraction in [0, 1) to the j-th position of that permutation. Offers of step j+1 exceed all of
    step j, so a document is finished as soon as each of its positions has an offer.
    """
    n_docs = len(offsets) - 1
    sig = np.full(n_docs * m, _EMPTY, _U)
    counts = np.diff(offsets)
    base = np.repeat(np.arange(n_docs) * m, counts)
    draw = mix(elements)
    first = ((draw & _LOW32) * _U(m) >> _U(32)).astype(np.int64)
    np.minimum.at(sig, base + first, draw >> _U(32))
    open_docs = np.flatnonzero((counts > 0) & (sig.reshape(n_docs, m) == _EMPTY).any(1))
    lo = 0
    while lo < len(open_docs):
        held = np.cumsum(counts[open_docs[lo:]])
        hi = lo + max(1, int(np.searchsorted(held, _HELD, "right")))
        docs = open_docs[lo:hi]
        idx = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in docs])
        lo = hi
        key, at = elements[idx], base[idx]
        order = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(idx), 1))
        rows = np.arange(len(idx))
        order[rows, first[idx]] = 0
        for j in range(1, m):
            draw = mix(key + _U(j * 0xD1342543DE82EF95 % (1 << 64)))
            k = j + ((draw & _LOW32) * _U(m - j) >> _U(32)).astype(np.int64)
            position = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            np.minimum.at(sig, at + position, (_U(j) << _U(32)) | (draw >> _U(32)))
            still = (sig.reshape(n_docs, m)[docs] == _EMPTY).any(1)
            if not still.any():
                break
            if still.mean() < 0.7:
                keep = np.repeat(still, counts[docs])
                docs, key, at, order = docs[still], key[keep], at[keep], order[keep]
                rows = np.arange(len(key))
    return sig.reshape(n_docs, m)


def _shingle_sets(hashed: np.ndarray, by_doc: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each document, sorted, and their offsets."""
    grams = gram_hash(hashed, words)
    sets = []
    for a, b in zip(by_doc[:-1], by_doc[1:], strict=True):
        if b - a >= words:
            s = np.sort(grams[a : b - words + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            sets.append(gram_hash(hashed[a:b], b - a) if b > a else hashed[:0])
    return np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def _word_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, by_doc: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A digest of each document's words, one space between them."""
    keep = ~WHITESPACE[data]
    between = np.ones(len(end), bool)
    between[by_doc[1:][by_doc[1:] > by_doc[:-1]] - 1] = False
    keep[end[between]] = True
    plain = data.copy()
    plain[end[between]] = 0x20
    plain = plain[keep]
    at = np.concatenate(([0], np.cumsum(keep)))[offsets]
    return [hashlib.blake2b(plain[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]


def _signer(words: int, bands: int, rows: int):
    def sign(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                data = LOWER[data]
                hashed, start, end, word_at = word_hashes(data, offsets, WHITESPACE)
                elements, by_doc = _shingle_sets(hashed, word_at, words)
                sig = superminhash(elements, by_doc, bands * rows).reshape(hi - lo, bands, rows)
                keys = np.repeat(mix(np.arange(bands, dtype=_U))[None, :], hi - lo, 0)
                for r in range(rows):
                    keys = mix(keys ^ sig[:, :, r])
                n = np.diff(by_doc)
                marks = [hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).digest() for a, b in zip(by_doc[:-1], by_doc[1:], strict=True)]
                keyed = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                texts = _word_digests(data, start, end, word_at, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n.astype(np.int64)), pa.array(marks, pa.binary()), pa.array(texts, pa.binary()), keyed], ["id", "n_shingles", "mark", "words", "keys"])

    return sign


def shingle_set(text: str | None, words: int) -> set:
    """The exact set that signatures stand for."""
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(found) < words:
        return {tuple(found)} if found else set()
    return set(zip(*(found[i:] for i in range(words)), strict=False))


def _verifier(words: int, percent: int):
    def verify(batches):
        last, held = None, set()
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last != (a, ta):
                    last, held = (a, ta), shingle_set(ta, words)
                other = shingle_set(tb, words)
                common = len(held & other)
                union = len(held) + len(other) - common
                keep.append(bool(union) and 100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return verify


def _linked(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose whole sets are similar enough."""
    pairs = materialize(pairs.distinct(), "pairs")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    texts = docs.join(small(ids), "id", "left_semi").dropDuplicates()
    texts = materialize(texts, "pair-texts")
    side = lambda name: texts.select(F.col("id").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(_verifier(words, percent), "a long, b long"), "links")


def _shingler(words: int):
    def shingle(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                hashed, _, _, word_at = word_hashes(LOWER[data], offsets, WHITESPACE)
                elements, by_doc = _shingle_sets(hashed, word_at, words)
                ids = np.repeat(batch.column(0)[lo:hi].to_numpy(), np.diff(by_doc))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(elements.view(np.int64))], ["id", "shingle"])

    return shingle


def _across(docs: DataFrame, shared: DataFrame, groups: DataFrame, words: int, percent: int, rare: int) -> DataFrame | None:
    """Pairs (a, b) of different components among which are all links that banding can find.

    Only documents in buckets with several components take part; those connected by such buckets are
    a crowd. Within a crowd a shingle is rare if at most ``rare`` percent of the documents (or 4)
    have it. The overlap of two documents is at most that of their frequent parts plus the number k
    of rare shingles they share. Frequent parts overlap by at most the smaller, and at most by half
    of what their sizes exceed the bits in which their parities in 128 classes differ, as each
    differing bit takes a shingle that only one of them has. Pairs with k > 0 come from a join on rare shingles, which
    gives few pairs for each; pairs with k = 0 come from a join within buckets. Both keep
    only pairs whose bound reaches the threshold, so a text that differs from a group of copies by
    more than allowed is not compared with all of the group.
    """
    labels = groups.withColumnRenamed("node", "id")
    member = shared.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = member.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("id").alias("first")).where("low < high").select("key", "first")
    member = materialize(member.join(mixed, "key"), "mixed-buckets")
    crowd = components(member.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()).select(F.col("node").alias("id"), F.col("component").alias("g"))
    ids = materialize(member.select("id", "c").distinct().join(crowd, "id"), "mixed-ids")
    if ids.isEmpty():
        return None
    texts = docs.join(small(ids), "id").select("id", "text")
    held = texts.mapInArrow(_shingler(words), "id long, shingle long").distinct().join(ids.select("id", "g"), "id")
    held = materialize(held, "mixed-shingles")
    docs_of = ids.groupBy("g").agg(F.count("*").alias("docs"))
    seldom = held.groupBy("g", "shingle").agg(F.count("*").alias("df")).join(docs_of, "g").where(f"df <= greatest(4, {rare} * docs / 100)").select("g", "shingle", "df")
    seldom = materialize(held.join(seldom, ["g", "shingle"]), "rare-shingles")
    one_bit = "shiftleft(1L, cast(shingle & 63 as int))"
    sums = [F.count("*").alias("n"), *[F.expr(f"bit_xor(if((shingle & 64) = {half}, {one_bit}, 0L))").alias(p) for p, half in (("p", 0), ("q", 64))]]
    weak = seldom.groupBy("id").agg(*sums).select("id", *[F.col(x).alias("r" + x) for x in "npq"])
    size = ids.drop("g").join(held.groupBy("id").agg(*sums), "id").join(weak, "id", "left")
    size = size.selectExpr("id", "c", "n", "n - coalesce(rn, 0) as f", "p ^ coalesce(rp, 0) as p", "q ^ coalesce(rq, 0) as q")
    size = materialize(size, "mixed-sizes")
    most = "least(least(fa, fb, (fa + fb - bit_count(pa ^ pb) - bit_count(qa ^ qb)) div 2) + {k}, na, nb)"
    enough = f"100 * {most} >= {percent} * (na + nb - {most})"
    side = lambda df, x, more: df.select(*more, F.col("id").alias(x), *[F.col(c).alias(c + x) for c in df.columns if c not in (*more, "id")])
    common = seldom.where("df > 1").join(size, "id").select("g", "shingle", "id", "c", "n", "f", "p", "q")
    met = side(common, "a", ["g", "shingle"]).join(side(common, "b", ["g", "shingle"]), ["g", "shingle"]).where("a < b and ca <> cb and least(na, nb) * 100 >= greatest(na, nb) * " + str(percent))
    met = met.groupBy("a", "b", "na", "nb", "fa", "fb", "pa", "pb", "qa", "qb").agg(F.count("*").alias("k"))
    one = met.where(enough.format(k="k")).select("a", "b")
    sized = member.select("key", "id").join(size.where(f"100 * f >= {percent} * n"), "id")
    two = side(sized, "a", ["key"]).join(side(sized, "b", ["key"]), "key").where("a < b and ca <> cb and " + enough.format(k=0)).select("a", "b")
    return materialize(one, "pairs-rare").union(materialize(two.distinct(), "pairs-frequent"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, rare: int = 2) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept.

    Documents are linked when their sets of ``words``-word shingles (A-Z lowered, split at ASCII
    white space) have a Jaccard similarity of ``percent`` or more. A pair of similarity s shares a
    band with probability 1 - (1 - s^rows)^bands: all but 5 in 10^8 at s = 0.8 with 32 bands of 4.

    Equal sets are collapsed before banding: documents with the digest of one set are linked with the
    first of them, after a comparison of the whole sets where their words differ. Each band bucket then
    links its members with its smallest member only, so a bucket of n copies costs n pairs. Then
    ``_across`` looks at those buckets that still hold several components, and gives every pair that
    could join two of them.

    Defined cases: a null or wordless text has an empty set and links with nothing; fewer than
    ``words`` words make one shingle. A null id gets a null component and is kept. Rows repeated
    under one id are all returned and share a component. Columns other than the two named are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with passing() as made:
        signed = materialize(docs.mapInArrow(_signer(words, bands, rows), "id long, n_shingles long, mark binary, words binary, keys array<long>"), "signatures")
        full = signed.where("n_shingles > 0 and id is not null")
        first = full.groupBy("mark").agg(F.min(F.struct("id", "words")).alias("first"), F.count("*").alias("n"))
        first = materialize(first.where("n > 1").selectExpr("mark", "first.id as a", "first.words as as_a"), "equal-sets")
        known = full.join(small(first), "mark", "left")
        same = known.where("id <> a")
        links = materialize(same.where("words = as_a").select("a", F.col("id").alias("b")), "equal-words")
        links = links.union(_linked(docs, same.where("words <> as_a").select("a", F.col("id").alias("b")), words, percent))
        alone = known.where("a is null or id = a")
        buckets = materialize(alone.select("id", F.explode("keys").alias("key")).distinct(), "buckets")
        centre = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
        shared = materialize(buckets.join(centre, "key"), "shared-buckets")
        discard(buckets)
        links = links.union(_linked(docs, shared.where("id <> a").select("a", F.col("id").alias("b")), words, percent))
        groups = components(links)
        pairs = _across(docs, shared, groups, words, percent, rare)
        if pairs is not None:
            links = links.union(_linked(docs, pairs, words, percent))
            groups = components(links)
        out = signed.select("id", "n_shingles").join(groups.withColumnRenamed("node", "id"), "id", "left")
        component = F.coalesce("component", "id")
        out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))
        out = materialize(out, "near-duplicates")
        made.remove(out)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all their columns, of which ``near_duplicates`` keeps one for each group.

    Rows equal in id and text leave one row; rows of different text under one kept id all stay, as
    do rows without an id.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    dropped = small(materialize(found.where("not kept").select(F.col(id_col).alias("_id")).distinct(), "dropped"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0).cast("long")).alias("_text"))
    again = packed.groupBy("_doc", "_text").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_doc").alias("_d"), F.col("_text").alias("_t"))
    again = materialize(again, "repeated-rows")
    left = packed.join(dropped, F.col("_doc") == F.col("_id"), "left_anti")
    if again.isEmpty():
        return left.select("_row.*")
    # only rows that are repeated are brought together
    repeated = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))
    once = left.join(small(again), repeated, "left_semi").dropDuplicates(["_doc", "_text"])
    return left.join(small(again), repeated, "left_anti").union(once).select("_row.*")
