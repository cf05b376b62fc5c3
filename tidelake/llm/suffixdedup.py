"""Removal of repeated byte strings: a Burrows-Wheeler index of what documents may have in common."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import BYTE_CODE, GRAM_BASE, mix, slices
from .scratch import materialize, passing, small

_U = np.uint64
_SEP = 0
#: Bytes indexed at once, and pieces that one anchor may bring to one index.
_INDEX_BYTES, _CROWD = 1 << 19, 20_000
#: Text whose pieces are compared with each other before they are sent on.
_UNIT_BYTES = 1 << 23
#: Bytes hashed at once, and cut from a longer text; places within them take _PIECE_BITS.
_SLICE, _CHUNK = 1 << 17, 1 << 20
_PIECE_BITS, _SIZE_BITS = 24, 16
_ROWS = 1 << 17


def _expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + size, size)


def _gram_hashes(data: np.ndarray, gram: int) -> tuple[np.ndarray, int, np.ndarray]:
    """(hash of every ``gram``-byte string, a power of two up to ``gram``, hash of every string of that length)."""
    power = lambda n: _U(pow(GRAM_BASE, n, 1 << 64))
    size, own = 1, BYTE_CODE[data]
    whole, held = (own, 1) if gram & 1 else (None, 0)
    while 2 * size <= gram:
        own = own[:-size] * power(size) + own[size:]
        size *= 2
        if gram & size:
            if whole is None:
                whole, held = own, size
            else:
                whole = own[: len(data) - held - size + 1] * power(held) + whole[size:]
                held += size
    out = whole ^ (whole >> _U(32))
    out *= _U(0xD6E8FEB86659FD93)
    return out, size, own


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content, first byte, bytes) of pieces that together hold every ``length``-byte string of a slice.

    A string's anchor is the smallest hash among its ``gram``-byte substrings, so equal strings have
    equal anchors. A piece is a run of strings with one anchor at one place; content is a hash of
    its bytes.
    """
    window, m = length - gram + 1, len(data) - length + 1
    if m < 1:
        none = np.zeros(0, np.int64)
        return none.view(_U), none.view(_U), none, none
    hashed, size, blocks = _gram_hashes(data, gram)
    low = hashed >> _U(_PIECE_BITS) << _U(_PIECE_BITS)
    low |= np.arange(len(low), dtype=_U)
    span = 1
    while 2 * span <= window:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if window > span:
        low = np.minimum(low[: len(low) - (window - span)], low[window - span :])
    place = low & _U((1 << _PIECE_BITS) - 1)
    edge = np.empty(m, bool)
    edge[0] = True
    np.not_equal(place[1:], place[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < m]] = True
    begin = np.flatnonzero(edge)
    stop = offsets[np.searchsorted(offsets, begin, "right")] - length + 1
    stop = np.minimum(stop, np.append(begin[1:], m))
    keep = begin < stop
    begin, n = begin[keep], (stop - begin)[keep] + length - 1
    content = mix(n.astype(_U))
    last, at = begin + n - size, begin.copy()
    while True:
        content = mix(content * _U(GRAM_BASE) + blocks[at])
        left = at < last
        if not left.any():
            break
        at = np.minimum(at + size, last)
    return hashed[place[begin].astype(np.int64)], content, begin, n


def _pieces(texts: pa.Array, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor, content, start << 16 | bytes) of the pieces of a slice of texts; a long text gives several."""
    for lo, hi, data, offsets in slices(texts, _SLICE):
        step = _CHUNK if len(data) > _CHUNK else len(data) or 1
        for cut in range(0, len(data), step):  # chunks share length - 1 bytes
            part = data[cut : cut + step + length - 1] if step < len(data) else data
            anchor, content, begin, size = anchors(part, offsets if step == len(data) else np.array([0, len(part)]), length, gram)
            row = np.searchsorted(offsets, begin, "right") - 1 if step == len(data) else np.zeros(len(begin), np.int64)
            yield lo + row, anchor, content, (begin + cut - offsets[row]) << _SIZE_BITS | size


def _unit(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Pieces of one unit; one that equals a piece of a smaller document here is settled, and marked by a negative place."""
    anchor, content, doc, mark, at = (np.concatenate([p[i] for p in parts]) for i in range(5))
    order = np.argsort(content)
    same = (content[order[1:]] == content[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
    if same.any():
        begin = np.flatnonzero(np.concatenate(([True], ~same)))
        low = np.repeat(np.minimum.reduceat(doc[order], begin), np.diff(np.append(begin, len(order))))
        gone = order[doc[order] > low]
        at[gone] = ~at[gone]
        # away from the anchor, so that no task gets all copies of a piece
        anchor[gone] = content[gone] = mix(doc[gone].astype(_U) * _U(GRAM_BASE) ^ at[gone].astype(_U))
    columns = [anchor.view(np.int64), content.view(np.int64), doc, mark, at]
    for i in range(0, len(at), _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + _ROWS]) for c in columns], ["anchor", "content", "doc_id", "mark", "at"])


def _lister(length: int, gram: int):
    def enlist(batches):
        held, size = [], 0
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for row, anchor, content, at in _pieces(batch.column(1), length, gram):
                held.append((anchor, content, ids[row], marks[row], at))
                size += len(at) * (length - gram) // 2
                if size > _UNIT_BYTES:
                    yield from _unit(held)
                    held, size = [], 0
        if held:
            yield from _unit(held)

    return enlist


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _extract(batches):
    """The bytes of the wanted pieces of each text."""
    for batch in batches:
        ids, marks, wanted = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
        data, offsets = _values(batch.column(1))
        bounds = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        flat = wanted.flatten()
        anchor, content, at = (flat.field(i).to_numpy() for i in range(3))
        row = np.repeat(np.arange(len(ids)), np.diff(bounds))
        size = at & ((1 << _SIZE_BITS) - 1)
        start = offsets[row] + (at >> _SIZE_BITS)
        for i in range(0, len(at), _ROWS):
            part = slice(i, i + _ROWS)
            body = _binary(data[_expand(start[part], size[part])], size[part])
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (anchor, content, ids[row], marks[row], at)] + [body], ["anchor", "content", "owner", "mark", "at", "piece"])


#: Symbols packed into one number, and the string length from which intervals are extended.
_PACKED, _SEED = 7, 28


def repeat_groups(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, mask of those that begin a group) where a group shares its first ``length`` symbols.

    Suffixes are ordered by slightly more than ``length`` symbols, by doubling. Over the
    Burrows-Wheeler transform of that order, intervals of strings are extended to the left by one
    symbol at a time, all intervals of one string length together; they start from all intervals of
    the last length up to ``_SEED`` that doubling passed. The right end of an extended interval is a
    border between suffixes whose common prefix has the current length; a border is set once, so
    common prefixes are found by increasing value. An interval that sets none is dropped, and the
    search stops at ``length``: borders not set by then have a longer common prefix.
    """
    n = len(symbols)
    rank = symbols.astype(np.int64)
    padded = np.concatenate((rank, np.zeros(_PACKED - 1, np.int64)))
    for i in range(1, _PACKED):
        rank = rank * 257 + padded[i : i + n]
    known, seed, seed_rank = _PACKED, 0, None
    while True:
        order = np.argsort(rank)
        ordered = rank[order]
        first = np.empty(n, bool)
        first[:1] = True
        np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(first)
        if known <= min(_SEED, length):
            seed, seed_rank = known, rank
        if known > length:
            break
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - known)] = rank[known:]
        rank = rank * (n + 1) + ahead
        known *= 2
    suffixes = order
    left = symbols[suffixes - 1].astype(np.int16)
    left[suffixes == 0] = _SEP
    order = np.argsort(left, kind="stable")
    step = np.empty(n, np.int64)
    step[order] = np.arange(n)
    following, preceding = np.full(n, n), np.full(n, -1)
    alike = left[order[1:]] == left[order[:-1]]
    following[order[:-1][alike]] = order[1:][alike]
    preceding[order[1:][alike]] = order[:-1][alike]
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    if seed_rank is not None:
        seeds = seed_rank[suffixes]
        np.not_equal(seeds[1:], seeds[:-1], out=border[1:n])
    lo = np.flatnonzero(border[:n])
    hi = np.append(lo[1:], n)
    for _ in range(seed, length):
        at = _expand(lo, hi - lo)
        size = hi - lo
        last = np.sort(step[at[following[at] >= np.repeat(hi, size)]]) + 1
        first = np.sort(step[at[preceding[at] < np.repeat(lo, size)]])
        new = ~border[last]
        border[last[new]] = True
        # the interval of the last symbol's strings ends at a border from the start, but leads on to new ones
        keep = new | (last == n) & (first > 0)
        lo, hi = first[keep], last[keep]
        if not len(lo):
            break
    return suffixes, border[:n]


def earliest_owner(data: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each ``length``-byte string in the pieces: (piece, place in it, smallest owner of an equal string)."""
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    symbols = np.full(int((sizes + 1).sum()), _SEP, np.int64)
    symbols[_expand(starts, sizes)] = data.astype(np.int64) + 1
    suffixes, border = repeat_groups(symbols, length)
    piece_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    begin = np.flatnonzero(border)
    low = np.minimum.reduceat(owners[piece_of[suffixes]], begin)
    smallest = np.empty(len(symbols), owners.dtype)
    smallest[suffixes] = np.repeat(low, np.diff(np.append(begin, len(symbols))))
    count = np.maximum(sizes - length + 1, 0)
    at = _expand(starts, count)
    piece = piece_of[at]
    return piece, at - starts[piece], smallest[at]


def _covered(piece: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes (piece, first, end) that strings at these places cover; places ascend within a piece."""
    if not len(piece):
        return piece, place, place
    begin = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (place[1:] > place[:-1] + length))))
    end = np.append(begin[1:], len(piece)) - 1
    return piece[begin], place[begin], place[end] + length


def _indexer(length: int):
    """Pieces, those of an anchor together, to (doc_id, mark, lo, hi) of bytes that an earlier document has too."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        anchor, content, owner, mark, at = (rows.column(i).to_numpy() for i in range(5))
        data, offsets = _values(rows.column(5).combine_chunks())
        # a piece that stands several times in its document is indexed once
        order = np.lexsort((content, anchor))
        new = np.concatenate(([True], (anchor[order[1:]] != anchor[order[:-1]]) | (content[order[1:]] != content[order[:-1]])))
        one = order[new]
        sizes = offsets[one + 1] - offsets[one]
        piece, place, low = earliest_owner(data[_expand(offsets[one], sizes)], sizes, owner[one], length)
        hit = low < owner[one[piece]]
        piece, lo, hi = _covered(piece[hit], place[hit], length)
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(order)))[piece]
        row = order[_expand(first[piece], times)]
        start = at[row] >> _SIZE_BITS
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (owner[row], mark[row], start + np.repeat(lo, times), start + np.repeat(hi, times))], ["doc_id", "mark", "lo", "hi"])

    def index(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch) * 2 * length
            if size <= _INDEX_BYTES:
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column(0).to_numpy()
            cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1  # where an index may end
            bound = np.cumsum(_values(table.column(5).combine_chunks())[1][1:] - _values(table.column(5).combine_chunks())[1][:-1])
            at = 0
            while len(cuts) and cuts[-1] > at:
                done = bound[at - 1] if at else 0
                k = np.searchsorted(bound[cuts - 1], done + _INDEX_BYTES, "right") - 1
                stop = int(cuts[max(k, 0)])
                if stop <= at:
                    stop = int(cuts[np.searchsorted(cuts, at, "right")])
                yield flush(table.slice(at, stop - at))
                at = stop
            rest = table.slice(at)
            held, size = rest.to_batches(), len(rest) * 2 * length
        if held:
            yield flush(pa.Table.from_batches(held))

    return index


def _windower(length: int):
    def windows(batches):
        for batch in batches:
            for anchor, owner, mark, at, piece in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                n, start = len(piece) - length + 1, at >> _SIZE_BITS
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n), pa.array([owner] * n), pa.array([mark] * n), pa.array(range(start, start + n), pa.int64()), pa.array([piece[i : i + length] for i in range(n)])], ["anchor", "owner", "mark", "lo", "bytes"])

    return windows


def _remover(keep_text: bool):
    def remove(batches):
        for batch in batches:
            data, offsets = _values(batch.column(1).fill_null(b""))
            spans = batch.column(2)
            flat, counts = spans.flatten(), np.diff(spans.offsets.to_numpy())
            counts = np.where(spans.is_null().to_numpy(False), 0, counts)
            row = np.repeat(np.arange(len(batch)), counts)
            lo, hi = flat.field(0).to_numpy() + offsets[row], flat.field(1).to_numpy() + offsets[row]
            # runs of a document end within it, so that the ends of all runs ascend when sorted by start
            order = np.lexsort((hi, lo, row))
            row, lo, hi = row[order], lo[order], hi[order]
            reach = np.maximum.accumulate(hi) if len(hi) else hi
            begin = np.flatnonzero(np.concatenate(([True], (lo[1:] > reach[:-1]) | (row[1:] != row[:-1]))))[: len(lo)]
            lo, hi, row = lo[begin], reach[np.append(begin[1:], len(reach)) - 1] if len(begin) else hi, row[begin]
            n_spans = np.bincount(row, minlength=len(batch))
            removed = np.bincount(row, hi - lo, len(batch)).astype(np.int64)
            cut = np.searchsorted(row, np.arange(len(batch) + 1))
            left = []
            for i in range(len(batch)):
                a, b = int(offsets[i]), int(offsets[i + 1])
                ends = [a, *hi[cut[i] : cut[i + 1]].tolist()]
                left.append(b"".join([data[x:y].tobytes() for x, y in zip(ends, [*lo[cut[i] : cut[i + 1]].tolist(), b], strict=True)]))
            digests = pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed), pa.array(n_spans.astype(np.int64)), digests, pa.array(left, pa.binary())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(columns[: 5 + keep_text], names[: 5 + keep_text])

    return remove


_PIECE = "anchor long, content long, owner long, mark long, at long, piece binary"
_SPAN = "doc_id long, mark long, lo long, hi long"


def _spans(lean: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """(doc_id, mark, lo, hi) of bytes that smaller documents have too; spans overlap."""
    every = lean.mapInArrow(_lister(length, gram), "anchor long, content long, doc_id long, mark long, at long")
    same = Window.partitionBy("anchor")
    ends = {"low": F.min("doc_id"), "high": F.max("doc_id"), "c0": F.min("content"), "c1": F.max("content")}
    shared = every.withColumns({k: v.over(same) for k, v in ends.items()}).where("low < high or at < 0")
    shared = shared.withColumn("owner", F.min("doc_id").over(Window.partitionBy("anchor", "content")))
    shared = materialize(shared.selectExpr("anchor", "content", "doc_id", "mark", "at", "owner", "c0 < c1 as several"), "pieces")
    place = "if(at < 0, ~at, at)"
    whole = shared.where("at < 0 or doc_id > owner").selectExpr("doc_id", "mark", f"shiftright({place}, {_SIZE_BITS}) as lo", f"shiftright({place}, {_SIZE_BITS}) + ({place} & {(1 << _SIZE_BITS) - 1}) as hi")
    own = shared.where("at >= 0 and doc_id = owner and several")
    wanted = own.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "content", "at")).alias("wanted"))
    bodies = materialize(lean.join(wanted, ["doc_id", "mark"]).select("doc_id", "text", "mark", "wanted").mapInArrow(_extract, _PIECE), "piece-bodies")
    crowds = materialize(bodies.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor"), "crowds")
    tasks = int(bodies.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0] // (1 << 23)) + 1
    index = bodies.join(F.broadcast(crowds), "anchor", "left_anti").repartition(tasks, "anchor").sortWithinPartitions("anchor")
    cuts = index.mapInArrow(_indexer(length), _SPAN)
    strings = bodies.join(F.broadcast(crowds), "anchor").select(*bodies.columns).mapInArrow(_windower(length), "anchor long, owner long, mark long, lo long, bytes binary")
    low = strings.groupBy("bytes").agg(F.min("owner").alias("low"))
    crowded = strings.join(low, "bytes").where("low < owner").select(F.col("owner").alias("doc_id"), "mark", "lo", (F.col("lo") + length).alias("hi"))
    return whole.union(materialize(cuts.union(crowded), "piece-cuts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 20, crowd: int = _CROWD, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the bytes kept).

    Every byte goes that lies in a ``length``-byte string which also starts in a document of smaller
    id; strings are judged on the input.

    Documents equal to one of smaller id go as a whole first. The others' texts are cut into
    overlapping pieces by content (``anchors``), so equal strings lie in pieces of equal anchor. Of
    pieces only hashes and places are brought together, after equal ones within some megabytes of text
    have been settled, so that a passage which a third of all documents hold sends one row for each
    such unit. A piece that equals one of a smaller document goes whole. Where an anchor has different
    pieces, the bytes of each one's smallest document are fetched and indexed together, many anchors
    in one index (``repeat_groups``), each string going to its smallest owner. An anchor with more than
    ``crowd`` different pieces is not indexed in one task: its strings are grouped by a
    distributed aggregation instead; there are few such anchors, as each takes ``crowd`` pieces.

    Defined cases: null and short texts lose nothing; rows repeated under one id don't match each
    other; rows with a null id neither lose bytes nor take any.
    """
    if not 0 < gram <= length or 2 * length - gram >= 1 << _SIZE_BITS:
        raise ValueError(f"no pieces of {length} bytes with anchors of {gram}")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    source = source.withColumn("mark", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")))
    eligible = f"doc_id is not null and octet_length(text) >= {length}"
    with passing() as made:
        heads = materialize(source.where(eligible).select("doc_id", "mark", F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("size")), "heads")
        if heads.groupBy("doc_id").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a < b").isEmpty():
            source, heads = (df.withColumn("mark", F.lit(0).cast("long")) for df in (source, heads))  # ids tell texts apart
        first = heads.groupBy("md5").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        copies = materialize(heads.join(small(materialize(first, "repeated-texts")), "md5").where("doc_id > first").select("doc_id", "mark", "size").distinct(), "copies")
        lean = source.where(eligible).join(small(copies), ["doc_id", "mark"], "left_anti").select("doc_id", "text", "mark")
        spans = _spans(lean, length, gram, crowd).union(copies.select("doc_id", "mark", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi")))
        spans = materialize(spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
        made.remove(spans)
    out = source.join(spans.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    return out.select("doc_id", "text", "spans").mapInArrow(_remover(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
