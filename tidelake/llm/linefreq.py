"""Quality rules: text statistics, and how many documents of a host share each line.

Only DataFrame functions: everything runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, passing, small
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    inner = F.btrim(text, F.lit(_SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def plain_line(line: Column) -> Column:
    """A-Z lowered, digits as 0, white space as spaces."""
    return F.translate(line, _UPPER + "123456789" + _SPACES, _LOWER + "0" * 9 + " " * 6)


def squeezed(line: Column) -> Column:
    """Runs of spaces as one, none at the ends."""
    return F.btrim(F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " {2,}", " ")).otherwise(line))


def normal_line(line: Column) -> Column:
    """The form in which lines are compared: A-Z lowered, digits as 0, white space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(plain_line(line), " {2,}", " "))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _shift(value: Column, bits: Column, left: bool) -> Column:
    return F.call_function("shiftleft" if left else "shiftrightunsigned", value, bits)


def base_stats(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to rows with a ``text``.

    Repeated words are those inside 3-word windows that occur twice or more. Only texts in which two
    windows have one 64-bit hash are looked at further: there each window becomes one long, hash bits
    above and position below, so that sorting plain longs brings equal windows together; neighbours
    are then compared word by word. (Two repeated windows whose cut hashes are equal could lie
    interleaved and be missed; a text of a million words leaves 44 bits of hash.) A repeated window
    adds no more words than its distance to the next one, so overlaps count once.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), _has_word)
    out = docs.select("*", words(text).alias("_w"), lines.alias("_lines"))
    windows = F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0)))
    out = out.withColumn("_h", F.transform(windows, lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))))
    out = out.withColumn("_bits", F.length(F.bin(F.size("_w").cast("long"))).cast("int"))
    bits = F.col("_bits")
    alone = F.size(F.array_distinct("_h")) == F.size("_h")
    coded = F.sort_array(F.transform("_h", lambda x, i: _shift(x, bits, True).bitwiseOR(i.cast("long"))))
    out = out.withColumn("_coded", F.when(alone, F.array().cast("array<bigint>")).otherwise(coded))
    at = lambda c: c.bitwiseAND(_shift(F.lit(1).cast("long"), bits, True) - 1).cast("int")

    def same(a: Column, b: Column) -> Column:
        equal = _shift(a, bits, False) == _shift(b, bits, False)
        for k in range(3):
            equal = equal & (F.get("_w", at(a) + k) == F.get("_w", at(b) + k))
        return F.coalesce(equal, F.lit(False))

    repeated = F.filter("_coded", lambda c, i: same(c, F.get("_coded", i - 1)) | same(c, F.get("_coded", i + 1)))
    out = out.withColumn("_at", F.sort_array(F.transform(repeated, at)))
    step = lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3)))
    covered = F.aggregate(F.transform("_at", step), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{_SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, mark, host, text): what the rules read, under names of their own."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("mark"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"))


def removed_lines(docs: DataFrame, min_docs: int = 5, percent: int = 10, enough: int = 50) -> DataFrame:
    """(doc_id, mark, line_hash, n words) of the lines that ``keyed`` documents lose.

    A line counts once for each distinct text of its host, so exact copies are one document. It is
    above the limits where more than ``min_docs`` of the host's distinct texts have it and these are
    more than ``percent`` percent of them, or more than ``enough``, so that a large host is not held
    to less than a small one. Counts are combined before each shuffle, and the joined side has one
    row for each frequent line, however many documents hold it.
    """
    normal = F.transform(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), plain_line), squeezed)
    every = F.posexplode_outer(F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("hash"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("n")))).alias("pos", "line")
    line = docs.select("doc_id", "mark", "host", every).where("line.n > 0").select("doc_id", "mark", "host", F.col("line.hash").alias("line_hash"), F.col("line.n").cast("long").alias("n"))
    with passing() as made:
        line = materialize(line.groupBy("host", "line_hash", "mark", "doc_id").agg(F.sum("n").alias("n")), "host-lines")
        texts = docs.select("host", "mark").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
        count = line.select("host", "line_hash", "mark").distinct().groupBy("host", "line_hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
        hot = count.join(texts, "host").where((100 * F.col("n_docs") > percent * F.col("host_docs")) | (F.col("n_docs") > enough)).select("host", "line_hash")
        out = materialize(line.join(small(materialize(hot, "hot-lines")), ["host", "line_hash"], "left_semi").select("doc_id", "mark", "line_hash", "n"), "removed-lines")
        made.remove(out)
    return out


def _join_marked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Left join on (doc_id, mark), in which null ids are equal."""
    right = found.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").drop("_id", "_mark")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_left: int = 30, min_words: int = 50, max_repeat: int = 50, lost: DataFrame | None = None, **limits: int) -> DataFrame:
    """One row per document: id, base statistics, n_removed_words, base_failed and kept.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` percent of them
    repeated. A document that passes is rejected as depleted when, without the lines that
    ``removed_lines`` takes from it, fewer than ``min_words`` words or less than ``min_left`` percent
    of its words are left.

    Defined cases: a null text has no words (and fails); a null host is the host ""; rows repeated
    under one id are judged each; rows with a null id are told apart by their text. Only the three
    named columns are read. ``lost`` is what ``removed_lines`` gives, where that is known already;
    ``limits`` are its limits.
    """
    docs = keyed(docs, id_col, text_col, host_col)
    lost = removed_lines(docs, **limits) if lost is None else lost
    lost = small(materialize(lost.groupBy("doc_id", "mark").agg(F.sum("n").alias("n_removed_words")), "lost-words"))
    out = _join_marked(base_stats(docs).drop("text", "host"), lost)
    n, removed = F.col("n_words"), F.coalesce("n_removed_words", F.lit(0))
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat * n)
    depleted = (n - removed < min_words) | (100 * (n - removed) < min_left * n)
    out = out.select(
        F.col("doc_id").alias(id_col), "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", removed.cast("long").alias("n_removed_words"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )
    # a table, as a filter on the verdicts would be pushed below the statistics and repeat their expressions
    return materialize(out, "verdicts")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", judging: dict[str, int] | None = None, **limits: int) -> DataFrame:
    """The documents that ``judge`` keeps, all their columns, without the lines above the limits."""
    read = keyed(docs, id_col, text_col, host_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0).cast("long")).alias("mark"))
    gone = removed_lines(read, **limits)
    verdicts = judge(docs, id_col, text_col, host_col, lost=gone, **(judging or {})).where("not kept").select(F.col(id_col).alias("_id"), F.col("mark").alias("_mark")).distinct()
    rejected = small(materialize(verdicts, "rejected"))
    packed = packed.join(rejected, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_anti")
    lost = gone.groupBy("doc_id", "mark").agg(F.collect_set("line_hash").alias("_lost"))
    out = _join_marked(packed, small(materialize(lost, "lost-lines")))
    text = F.col(f"_row.`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_lost", F.xxhash64(normal_line(x)))), "\n")
    new = F.when(F.col("_lost").isNull(), text).otherwise(left)
    return out.select(*[(new if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
