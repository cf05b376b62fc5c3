"""Byte-level BPE over whole columns of text.

Gives the ids that the ``tokenizers`` library gives for the same file, several times faster: each
distinct pre-token of a slice is merged once, and all of them step through their merges together as
arrays. Whatever the fast path doesn't cover goes to the library itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .bytescan import prefix_hash, range_hash, slices

_NONE = np.int32(0x7FFFFFFF)
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_PLAIN = np.zeros(256, bool)
_PLAIN[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
#: Pre-tokens beyond this many bytes would take as many rounds; their documents go to the library.
_LONG = 200
#: Pre-tokens that a worker remembers (24 bytes each), and their ids (4 bytes each).
_SLOTS, _REMEMBERED_IDS = 1 << 20, 1 << 23


def _byte_letters() -> list[str]:
    """The printable letters that stand for bytes in vocabulary files of this kind."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class _PairTable:
    """Merge ranks of pairs of ids: a few hash tables, each for what collided in the one before."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        self.levels = []
        bits = 19
        while len(keys):
            factor = np.uint32(2654435761 + 2 * len(self.levels))
            slot = (keys * factor) >> np.uint32(32 - bits)
            _, first = np.unique(slot, return_index=True)
            held, value = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.full(1 << bits, _NONE, np.int32)
            held[slot[first]], value[slot[first]] = keys[first], ranks[first]
            self.levels.append((factor, np.uint32(32 - bits), held, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
            bits = max(10, bits - 3)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        out = np.full(len(keys), _NONE, np.int32)
        for factor, shift, held, value in self.levels:
            slot = (keys * factor) >> shift
            hit = held[slot] == keys
            out[hit] = value[slot[hit]]
        return out


class Bpe:
    def __init__(self, path: str, specials_are_text: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = specials_are_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        plain = plain and model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        vocab = model["vocab"]
        letters = _byte_letters()
        self.fast = bool(plain and max(vocab.values()) < 0xFFFF and all(x in vocab for x in letters))
        self.specials = [] if specials_are_text else [x["content"].encode() for x in spec.get("added_tokens", [])]
        if self.fast:
            merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
            self.byte_id = np.array([vocab[x] for x in letters], np.int32)
            keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32)
            self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
            self.pairs = _PairTable(keys, np.arange(len(merges), dtype=np.int32))
            self.kinds = np.full(0x110000, 255, np.uint8)
            # merged pre-tokens by hash, a later one overwriting what shares its slot
            self.known = np.zeros(_SLOTS, np.uint64)
            self.start, self.count = np.zeros(_SLOTS, np.int64), np.zeros(_SLOTS, np.int64)
            self.pool, self.filled = np.zeros(1 << 20, np.int32), 0

    def _kind(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points, asked of the library's own splitter on first sight."""
        kind = self.kinds[points]
        if (kind == 255).any():
            split = self.library.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[kind == 255]).tolist():
                alike = [len(split(x + chr(p))) == 1 for x in "a1!"]
                self.kinds[p] = {0: _LETTER, 1: _NUMBER, 2: _OTHER}[alike.index(True)] if any(alike) else _SPACE
            kind = self.kinds[points]
        return kind

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mask of the code points that begin a pre-token; ``first`` marks those that begin a document."""
        kind = self._kind(points)
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        last_space = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:])
        start[last_space] = True
        start[last_space[points[last_space] == 0x20] + 1] = False
        quote = np.flatnonzero((points == 0x27) & start)
        if len(quote):
            ahead = np.concatenate((np.where(first, 0, points), [0, 0, 0]))  # nothing is read beyond a document
            one, two = ahead[quote + 1], ahead[quote + 2]
            single = np.isin(one, [ord(x) for x in "stmd"])
            double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for mask, n in ((single, 2), (double, 3)):
                at = quote[mask]
                start[at + 1] = False
                after = at + n
                start[after[after < len(start)]] = True
        return start

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as byte ids one after another; (ids, ids by word)."""
        n_words = len(sizes)
        word = np.repeat(np.arange(n_words), sizes)
        done_ids, done_words = [], []
        rank = np.full(len(symbols), _NONE, np.int32)
        if len(symbols) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.pairs.ranks(symbols[:-1], symbols[1:]), _NONE)
        while len(symbols):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(symbols)))
            best = np.repeat(low, length)
            if (ended := best == _NONE).any():
                done_ids.append(symbols[ended])
                done_words.append(word[ended])
                live = ~ended
                symbols, word, rank, best = symbols[live], word[live], rank[live], best[live]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == best)
            if len(at) > 1 and (np.diff(at) == 1).any():  # of overlapping pairs in a run, every second one
                run = np.concatenate(([True], np.diff(at) != 1))
                at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            new = moved[at]
            stale = np.concatenate((new, new[new > 0] - 1))
            stale.sort()
            rank[stale] = _NONE
            stale = stale[stale + 1 < len(symbols)]
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale] = self.pairs.ranks(symbols[stale], symbols[stale + 1])
        ids, words = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_ids, done_words))
        order = np.argsort(words, kind="stable")
        return ids[order], np.bincount(words, minlength=n_words)

    def _words(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens and their number by pre-token; only those not remembered are merged."""
        key = range_hash(prefix_hash(data), begin, begin + size)
        if self.filled > _REMEMBERED_IDS:
            self.known[:], self.filled = 0, 0
        slot = (key & np.uint64(_SLOTS - 1)).astype(np.int64)
        known = self.known[slot] == key
        start, count = self.start[slot], self.count[slot]
        if not known.all():
            new = np.flatnonzero(~known)
            fresh, one, which = np.unique(key[new], return_index=True, return_inverse=True)
            one = new[one]
            ids, n = self._merge(self.byte_id[data[_ranges(begin[one], size[one])]], size[one])
            at = self.filled + np.cumsum(n) - n
            if self.filled + len(ids) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * (self.filled + len(ids)))
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.filled += len(ids)
            self.known[slot[one]], self.start[slot[one]], self.count[slot[one]] = fresh, at, n
            start[new], count[new] = at[which], n[which]
        return self.pool[_ranges(start, count)], count

    def _slow(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's documents one after another, and offsets by document."""
        raw = data.tobytes()
        try:
            points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
            fast = self.fast
        except UnicodeDecodeError:
            fast = False
        n = len(offsets) - 1
        if not fast:
            parts = self._slow([raw[offsets[i] : offsets[i + 1]] for i in range(n)])
            return np.concatenate([np.zeros(0, np.int32), *parts]), np.cumsum([0, *map(len, parts)])
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        byte_at = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.zeros(len(points) + 1, bool)
        first[np.searchsorted(byte_at, offsets)] = True
        begin = byte_at[self._starts(points, first[:-1])]
        end = np.append(begin[1:], len(data))
        size = end - begin
        owner = np.searchsorted(offsets, begin, "right") - 1
        odd = set(owner[size > _LONG].tolist())
        for special in self.specials:
            at = raw.find(special)
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(special, at + 1)
        if odd:
            take = ~np.isin(owner, list(odd))
            begin, end, size, owner = begin[take], end[take], size[take], owner[take]
        ids, tokens = self._words(data, begin, size)
        per_doc = np.bincount(owner, tokens, minlength=n).astype(np.int64)
        if odd:
            parts = np.split(ids, np.cumsum(per_doc)[:-1])
            docs = sorted(odd)
            for i, x in zip(docs, self._slow([raw[offsets[i] : offsets[i + 1]] for i in docs]), strict=True):
                parts[i], per_doc[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, np.concatenate(([0], np.cumsum(per_doc)))

    def _parts(self, data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
        """Stretches of about ``limit`` bytes, cut only before a space between ASCII letters or digits, where a pre-token begins."""
        lo = 0
        while lo < len(data):
            hi = lo + limit
            while hi < len(data):
                near = data[hi - 1 : hi + 4097]
                found = np.flatnonzero((near[1:-1] == 0x20) & _PLAIN[near[:-2]] & _PLAIN[near[2:]]) if len(near) > 2 else []
                if len(found):
                    hi += int(found[0])
                    break
                hi += 4096
            yield data[lo:hi]
            lo = hi

    def encode_column(self, texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, offsets) of consecutive slices of a text column; long texts go in stretches."""
        for lo, hi, data, offsets in slices(texts, limit):
            if self.fast and hi - lo == 1 and len(data) > 4 * limit and not any(x in data.tobytes() for x in self.specials):
                ids = np.concatenate([self.encode_slice(part, np.array([0, len(part)]))[0] for part in self._parts(data, limit)])
                yield lo, hi, ids, np.array([0, len(ids)])
            else:
                yield lo, hi, *self.encode_slice(data, offsets)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of ``size[0]`` entries, then the same of the next."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + size, size)


@lru_cache(2)
def load(path: str, specials_are_text: bool = False) -> Bpe:
    return Bpe(path, specials_are_text)
