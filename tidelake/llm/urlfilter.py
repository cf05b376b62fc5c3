"""URL filters: allow and block rules, and logistic regression on hashed character n-grams.

The filter is made of DataFrame functions only; the model is trained on the driver from the small
labelled table of ``urltable``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urltable import labelled_urls

BUCKETS = 8192
#: Weights are whole numbers of this fraction, so that sums don't depend on their order.
UNIT = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, text: str) -> Rule:
        """From ``block host/path`` or ``allow host/path``."""
        verdict, where = text.split(" ", 1)
        host, _, path = where.partition("/")
        return cls(verdict, host, "/" + path)

    @property
    def name(self) -> str:
        return self.host + self.path


#: Gram sizes, and what tells their buckets apart.
_SALTS = ((3, 11), (4, 5003))


def _grams(text: str, seed: int) -> list[int]:
    """Buckets of the 3- and 4-grams of ``text``."""
    codes = [ord(c) for c in text]
    found = []
    for n, salt in _SALTS:
        for i in range(len(codes) - n + 1):
            value = 0
            for c in codes[i : i + n]:
                value = value * 31 + c
            found.append((value * 7919 + salt + seed) % BUCKETS)
    return found


_PARTS = (("host", "^", "$", 0), ("path", "", "", 1777))


def _shape(host: str, path: str) -> list[int]:
    zeros = path.translate(str.maketrans("123456789", "0" * 9))
    return [b for text, (_, left, right, seed) in zip((host, zeros), _PARTS, strict=True) for b in _grams(left + text + right, seed)]


@lru_cache(1)
def train(epochs: int = 300, rate: float = 4.0, decay: float = 1e-4, unwanted: float = 0.35) -> tuple[tuple[int, ...], int]:
    """(weights in units, bias in units) by gradient descent over the labelled table without its held-out hosts.

    All unwanted URLs together weigh ``unwanted``, all others the rest: an ordinary URL that is blocked
    is the dearer mistake.
    """
    rows = [r for r in labelled_urls() if not r[3]]
    y = np.array([r[2] for r in rows], float)
    shapes = [_shape(h, p) for h, p, _, _ in rows]
    size = np.array([len(x) for x in shapes])
    example, bucket = np.repeat(np.arange(len(rows)), size), np.concatenate(shapes).astype(np.int64)
    share = np.where(y == 1, unwanted / y.sum(), (1 - unwanted) / (1 - y).sum())
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        z = np.bincount(example, weights[bucket], len(rows)) + bias
        error = (1 / (1 + np.exp(-z)) - y) * share
        weights -= rate * (np.bincount(bucket, error[example], BUCKETS) + decay * weights)
        bias -= rate * error.sum()
    return tuple(np.round(weights * UNIT).astype(int).tolist()), round(bias * UNIT)


def score_of(host: str, path: str) -> int:
    """The model's log-odds in units, as ``judge`` computes them."""
    weights, bias = train()
    return bias + sum(weights[b] for b in _shape(host, path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered, and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def _weight(codes: Column, weights: Column, n: int, salt: int) -> Column:
    """Sum of the weights of all n-grams."""

    def weigh(c: Column, i: Column) -> Column:
        value = c
        for k in range(1, n):
            value = value * 31 + F.get(codes, i + k)
        return F.get(weights, F.pmod(value * 7919 + salt, F.lit(BUCKETS)).cast("int"))

    heads = F.slice(codes, F.lit(1), F.greatest(F.size(codes) - (n - 1), F.lit(0)))
    return F.aggregate(F.transform(heads, weigh), F.lit(0).cast("long"), lambda s, x: s + x)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, score, verdict) of every url.

    A rule fits its host and all subdomains where the path starts with the rule's; of several, the
    longest decides. ``rules`` is a short list that becomes part of the expression. Urls that no rule
    fits are blocked where the model's ``score``, its log-odds in units, is above 0.

    Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and gets
    the model's verdict on empty text; repeated rows are judged each. Other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    out = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    trained, bias = train()
    weights = F.split(F.lit(",".join(map(str, trained))), ",").cast("array<bigint>")  # folds to one literal
    out = out.withColumn("_host", _codes(F.concat(F.lit("^"), "host", F.lit("$")))).withColumn("_path", _codes(F.translate("path", "123456789", "0" * 9)))
    score = F.lit(bias).cast("long")
    for name, _, _, seed in _PARTS:
        for n, salt in _SALTS:
            score = score + _weight(F.col("_" + name), weights, n, salt + seed)
    out = out.select("*", rule.alias("rule"), verdict.alias("_verdict"), score.alias("score"))
    model = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(id_col, "host", "path", "rule", "score", F.coalesce("_verdict", model).alias("verdict"))
