"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import LOWER, NON_ALNUM, gram_hash, gram_owner, slices, word_hashes
from .scratch import materialize, small

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Benchmark text that one index may hold; larger benchmarks are searched for in several blocks.
BLOCK_BYTES = 32 << 20
_HIT = "doc_id long, row_mark long, n_words long, lo array<long>, hi array<long>, items array<string>"


def winnow(grams: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Mask of the entries that are the minimum of some run of ``window`` entries of their document.

    Equal minima are all kept, so two texts that share such a run keep the same entries of it.
    """
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(len(grams), bool)
    low = grams[:n].copy()
    for i in range(1, window):
        np.minimum(low, grams[i : i + n], out=low)
    runs = np.maximum(np.diff(offsets) - window + 1, 0)
    whole = np.zeros(n + 1, np.int32)  # runs that cross a border between documents select nothing
    np.add.at(whole, offsets[:-1][runs > 0], 1)
    np.add.at(whole, (offsets[:-1] + runs)[runs > 0], -1)
    low[np.cumsum(whole[:n]) == 0] = _MAX
    picked = np.zeros(len(grams), bool)
    for i in range(window):
        picked[i : i + n] |= grams[i : i + n] == low
    return picked & (grams != _MAX)


def item_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER.tobytes()))


def _found(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Index:
    """Fingerprints of a block of benchmark items, and where each of their windows stands.

    Takes about 16 bytes a window besides the items' words.
    """

    def __init__(self, items: list[tuple[str, str | None]], span: int, k: int) -> None:
        self.span, self.k = span, k
        lines = [(item, b" ".join(words)) for item, text in items if (words := item_words(text))]
        self.items = [item for item, _ in lines]
        self.line = b"\n".join(line for _, line in lines)
        data = np.frombuffer(self.line, np.uint8)
        offsets = np.cumsum([0, *(len(line) + 1 for _, line in lines)])
        offsets[-1] = len(data)
        hashed, self.start, self.end, by_item = word_hashes(data, offsets, NON_ALNUM)
        sizes = np.diff(by_item)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in {span, *sizes[sizes < span].tolist()}:
            owner, per_item = gram_owner(by_item, n)
            which = np.repeat(np.arange(len(sizes)), np.diff(per_item))
            keep = sizes[which] >= span if n == span else sizes[which] == n
            owner, which = owner[keep], which[keep]
            hashes = gram_hash(hashed, n)[owner] if len(owner) else np.zeros(0, np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.windows[n] = hashes[order], owner[order].astype(np.int32), which[order].astype(np.int32)
        owner, offsets = gram_owner(by_item, k)
        grams = gram_hash(hashed, k)[owner] if len(owner) else np.zeros(0, np.uint64)
        self.prints = np.unique(grams[winnow(grams, offsets, span - k + 1)])

    def candidates(self, hashed: np.ndarray, by_doc: np.ndarray) -> dict[int, np.ndarray]:
        """By window size, indices of first words at which a window's hash stands within a document."""
        at = {}
        owner, offsets = gram_owner(by_doc, self.k)
        if len(owner):
            grams = gram_hash(hashed, self.k)[owner]
            picked = np.flatnonzero(winnow(grams, offsets, self.span - self.k + 1))
            hits = owner[picked[_found(grams[picked], self.prints)]]
            # extend each hit over all windows around it
            at[self.span] = np.unique((hits[:, None] - np.arange(self.span - self.k + 1)).ravel())
        for n in self.windows:
            if n < self.span:
                at[n], _ = gram_owner(by_doc, n)
        for n, i in at.items():
            i = i[(i >= 0) & (i + n <= len(hashed))]
            doc = np.searchsorted(by_doc, i, "right") - 1
            i = i[i + n <= by_doc[doc + 1]]
            at[n] = i[_found(gram_hash(hashed, n)[i], self.windows[n][0])] if len(i) else i
        return at

    def items_at(self, n: int, window_hash: np.uint64, text: bytes) -> set[str]:
        """Items in which this window occurs, word by word."""
        hashes, owner, which = self.windows[n]
        lo, hi = np.searchsorted(hashes, window_hash), np.searchsorted(hashes, window_hash, "right")
        return {self.items[w] for i, w in zip(owner[lo:hi].tolist(), which[lo:hi].tolist(), strict=True) if self.line[self.start[i] : self.end[i + n - 1]] == text}


def _matcher(index):
    def match(batches):
        block = index.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                data = LOWER[data]
                hashed, start, end, by_doc = word_hashes(data, offsets, NON_ALNUM)
                spans, items = defaultdict(list), defaultdict(set)
                for size, at in block.candidates(hashed, by_doc).items():
                    if not len(at):
                        continue
                    keys = gram_hash(hashed, size)[at]
                    doc = np.searchsorted(by_doc, at, "right") - 1
                    for d, i, key in zip(doc.tolist(), at.tolist(), keys, strict=True):
                        text = b" ".join([data[start[j] : end[j]].tobytes() for j in range(i, i + size)])
                        if seen := block.items_at(size, key, text):
                            first = i - int(by_doc[d])
                            items[d] |= seen
                            spans[d].append((first, first + size))
                n = hi - lo
                rows = [_union(spans[d]) if d in spans else ([], []) for d in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        batch.column(2)[lo:hi],
                        pa.array(np.diff(by_doc).astype(np.int64)),
                        pa.array([x for x, _ in rows], pa.list_(pa.int64())),
                        pa.array([x for _, x in rows], pa.list_(pa.int64())),
                        pa.array([sorted(items[d]) if d in items else [] for d in range(n)], pa.list_(pa.string())),
                    ],
                    ["doc_id", "row_mark", "n_words", "lo", "hi", "items"],
                )

    return match


def _union(runs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    lo: list[int] = []
    hi: list[int] = []
    for a, b in sorted(runs):
        if hi and a <= hi[-1]:
            hi[-1] = max(hi[-1], b)
        else:
            lo.append(a)
            hi.append(b)
    return lo, hi


def _joiner(batches):
    """Unites what several blocks have found in a document."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            lo, hi = _union([(a, b) for part in row.pop("parts") for a, b in zip(part["lo"], part["hi"], strict=True)])
            row["lo"], row["hi"] = lo, hi
        yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("doc_id", "row_mark", "n_words", "lo", "hi", "items")} for row in rows], schema=_ARROW)


_ARROW = pa.schema([("doc_id", pa.int64()), ("row_mark", pa.int64()), ("n_words", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, row_mark, n_words, lo, hi (maximal hit runs of words), items.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered. A window is
    ``span`` consecutive words of a benchmark item; an item with fewer is one window. Both sides keep
    the smallest ``k``-gram hash of each run of ``span - k + 1`` k-grams, so every shared window
    shares a fingerprint; each matching fingerprint is extended over the windows around it, which
    are compared word by word. Items shorter than a window have no such run and are looked up whole
    at every position.

    The fingerprint join probes the index of the benchmark on each executor; documents are not
    shuffled. The index's size is checked: a benchmark beyond ``block_bytes`` is dealt into blocks
    by item, each probed in a pass of its own, and passes are united by document.

    Defined cases: null or wordless texts have no words and no hits; items without words have no
    windows; items of equal text are all reported; a null item id is ignored. ``row_mark`` tells
    rows of one doc_id apart (a hash of the text). Clashing columns of either table are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_mark"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    blocks = int(total // block_bytes) + 1
    passes = []
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        index = spark.sparkContext.broadcast(Index([tuple(x) for x in part.collect()], span, k))
        passes.append(docs.mapInArrow(_matcher(index), _HIT))
    if blocks == 1:
        return passes[0]
    every = passes[0]
    for one in passes[1:]:
        every = every.union(one)
    found = every.groupBy("doc_id", "row_mark", "n_words").agg(F.collect_set(F.struct("lo", "hi")).alias("parts"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.count("*").alias("n"))
    # each pass gives every row once, so equal rows come back as often as they are in the table
    found = found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n") / blocks)))).drop("n", "_row")
    return found.mapInArrow(_joiner, _HIT)


def digest(hits: DataFrame) -> DataFrame:
    """Counts and checksum of ``contamination`` rows."""
    covered = F.aggregate(F.zip_with("lo", "hi", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return hits.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("lo") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all their columns, in which ``contamination`` finds no window."""
    hit = contamination(docs, benchmark, id_col, text_col, **options).where(F.size("lo") > 0).select(F.col("doc_id").alias("_id"), F.col("row_mark").alias("_mark")).distinct()
    hit = small(materialize(hit, "contaminated"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_doc"), F.xxhash64(F.col(text_col).cast("string")).alias("_text"))
    return packed.join(hit, F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_mark")), "left_anti").select("_row.*")
