"""Packing tokenised documents into sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load
from .scratch import materialize

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (how many packs, lengths in one) that hold every piece of ``histogram``.

    Lengths are placed longest first, always into the packs that are shortest so far; all packs of
    a pattern are handled at once, so the work depends on the number of lengths, not of pieces. A
    step splits at most one pattern, so there are at most two patterns more for each length.
    """
    by_space: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    widest = 0
    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        left = histogram[length]
        while left:
            while widest and not by_space.get(widest):
                widest -= 1
            if widest >= length:
                count, lengths = by_space[widest].pop()
                used = min(count, left)
                if count > used:
                    by_space[widest].append((count - used, lengths))
                by_space.setdefault(widest - length, []).append((used, (*lengths, length)))
                left -= used
            else:
                each = size // length
                packs, over = divmod(left, each)
                for count, n in ((packs, each), (1, over)):
                    if count and n:
                        by_space.setdefault(size - n * length, []).append((count, (length,) * n))
                        widest = max(widest, size - n * length)
                left = 0
    return [x for space in sorted(by_space) for x in by_space[space]]


def placements(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, pieces per sequence, offset) in order of rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for length, n in sorted(Counter(lengths).items(), reverse=True):
            rows.setdefault(length, []).append((taken[length], sequence, n, offset))
            taken[length] += count * n
            offset += length * n
        sequence += count
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def _cutter(path: str, size: int, end_id: int, keep_ids: bool):
    def cut(batches):
        bpe = load(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for lo, hi, ids, offsets in bpe.encode_column(batch.column(1)):
                out: list[list] = [[] for _ in range(7)]
                payload = []
                names = batch.column(0)[lo:hi].to_pylist()
                ids = ids.astype("<u4")
                for i, name in enumerate(names):
                    whole = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id))
                    for start in range(0, len(whole), size):
                        piece = whole[start : start + size]
                        for column, x in zip(out, (name, start, len(piece), zlib.crc32(piece), len(whole), part, seen[len(piece)]), strict=True):
                            column.append(x)
                        seen[len(piece)] += 1
                        if keep_ids:
                            payload.append(piece)
                columns = [pa.array(x, pa.int32() if i == 5 else pa.int64()) for i, x in enumerate(out)]
                fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
                if keep_ids:
                    flat = np.concatenate(payload).astype(np.int32) if payload else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, payload)]), pa.int32()), pa.array(flat)))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, fields)

    return cut


def _placer(tables: dict[int, np.ndarray], keep_ids: bool):
    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                table = tables[n]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                step, slot = np.divmod(rank[at] - row[:, 0], row[:, 2])
                sequence[at], offset[at] = row[:, 1] + step, row[:, 3] + slot * n
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            columns, names = [*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                columns, names = [*columns, batch.column(batch.schema.get_field_index("ids"))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return place


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's ids, with ``end_id`` appended, are cut at every ``size``; what is left over is one
    piece. Pieces are packed whole by ``shortest_pack_first``, which sees only the histogram of at
    most ``size`` lengths. Pieces are matched with patterns by their rank among those of their
    length: the rank within a written partition plus the counts of the partitions before it, so no
    length, however common, is brought together in a task.

    Defined cases: a null or empty text is the end id alone; rows repeated under one id are packed
    each; null ids stay null; an empty table gives no sequences. Other columns are ignored.
    """
    extra = ", ids array<int>" if keep_ids else ""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(docs.mapInArrow(_cutter(tokenizer, size, end_id, keep_ids), _PIECE + extra), "pieces")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    tables = placements(shortest_pack_first(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    return ranked.mapInArrow(_placer(tables, keep_ids), _PACKED + extra)
