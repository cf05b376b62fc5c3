"""Line dedup: segment-partition edit join with banded bit-parallel verification.

Only DataFrame functions: everything runs inside the JVM.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .linefreq import plain_line, squeezed
from .linefreq import words as text_words
from .scratch import materialize, passing, small

#: Parts of the keys that are brought together one after the other.
PASSES = 2
#: Letters whose numbers bound edits, 16 in a long.
LETTERS = ("etaonihsrdlucmgb", "fpwyvkjxqz .,éüñ")


def within_distance(a: Column, b: Column, tau: int) -> Column:
    """Whether two arrays of characters differ by at most ``tau`` insertions, deletions and substitutions.

    What both have in common at either end is cut off first. Of the rest, only the band of 2 tau + 1
    diagonals is followed, as one bit vector for each column: vertical steps up and down of the cells
    in the band, with carries of an addition running along matches. The distance is summed along the
    diagonal on which the last cell lies.
    """
    width, mask = 2 * tau + 1, (1 << (2 * tau + 1)) - 1
    start = ((1 << (tau + 1)) - 1) << tau
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)

    def step(p: Column, s: Column, c: Column) -> Column:
        match = F.lit(0)
        for i in range(width):
            match = match + F.when(F.get(p, s["j"] + (i - tau)) == c, F.lit(1 << i)).otherwise(F.lit(0))
        vp, vn = s["vp"], s["vn"]

        def column(pm: Column) -> Column:
            return _with(((((pm.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn)).bitwiseAND(F.lit(mask)), advance)

        def advance(d0: Column) -> Column:
            up = vn.bitwiseOR(F.lit(mask).bitwiseXOR(d0.bitwiseOR(vp)))
            down = d0.bitwiseAND(vp)
            half = F.call_function("shiftright", d0, F.lit(1))
            return F.struct(
                (s["j"] + 1).alias("j"),
                down.bitwiseOR(F.lit(mask).bitwiseXOR(half.bitwiseOR(up))).bitwiseAND(F.lit(mask)).alias("vp"),
                half.bitwiseAND(up).alias("vn"),
                (s["d"] + F.lit(1) - F.call_function("shiftright", d0, s["at"]).bitwiseAND(F.lit(1))).alias("d"),
                s["at"].alias("at"),
            )

        return _with(match, column)

    def run(p: Column, t: Column) -> Column:
        gap = F.size(p) - F.size(t)
        first = F.struct(F.lit(0).alias("j"), F.lit(start).alias("vp"), F.lit(0).alias("vn"), gap.alias("d"), (gap + tau).alias("at"))
        return F.aggregate(t, first, lambda s, c: step(p, s, c), lambda s: s["d"] <= tau)

    def unlike(pair: Column) -> Column:
        """The pair from its first different character on, reversed; twice, this leaves what both ends don't share."""
        p, t = pair["p"], pair["t"]
        rest = lambda x, i: F.reverse(F.slice(x, i, F.greatest(F.size(x) - i + 1, F.lit(0))))
        return _with(F.greatest(_first_difference(p, t), F.lit(1)), lambda i: F.struct(rest(p, i).alias("p"), rest(t, i).alias("t")))

    pair = F.struct(longer.alias("p"), shorter.alias("t"))
    near = _with(_with(pair, unlike), lambda pair: _with(unlike(pair), lambda x: run(x["p"], x["t"])))
    return F.when(F.abs(F.size(a) - F.size(b)) > tau, F.lit(False)).when(a == b, F.lit(True)).otherwise(near)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_difference(a: Column, b: Column) -> Column:
    """Place (from 1) of the first different entry of two arrays; 0 where they are equal."""
    return F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _places(tau: int) -> list[tuple[int, int, int]]:
    """(gap, segment, shift) of the substrings that a line looks up: lengths differ by gap, places by shift.

    With tau edits at least one of tau + 1 segments of the shorter line stands unchanged in the
    longer one, and the edits left and right of it bound where.
    """
    return [(gap, i, shift) for gap in range(tau + 1) for i in range(tau + 1) for shift in range(max(-i, gap - (tau - i)), min(i, gap + (tau - i)) + 1)]


def own_places(tau: int) -> list[int]:
    """Where a line's own segments stand among the substrings it looks up: those of its own length, not shifted."""
    return [k for k, (gap, _, shift) in enumerate(_places(tau)) if gap == shift == 0]


def segment_keys(line: Column, scope: Column, tau: int) -> Column:
    """Keys of the substrings that a line looks up, its own segments among them.

    Segments are even, the last ones longer by one. A key holds scope, indexed length, number of the
    segment and its characters. One small expression goes over all places, as written out it would be
    more code than the JVM compiles; it cuts the line as four bytes a character, in which places need
    no scan.
    """
    parts = tau + 1
    table = F.array(*[F.struct(F.lit(gap).alias("gap"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for gap, i, shift in _places(tau)])

    def key(wide: Column, x: Column) -> Column:
        indexed, i = F.call_function("div", F.octet_length(wide), F.lit(4)).cast("int") - x["gap"], x["i"]
        base = F.call_function("div", indexed, F.lit(parts)).cast("int")
        short = parts - indexed % parts  # segments from this one on are longer by one
        start = base * i + F.greatest(i - short, F.lit(0)) + x["shift"]
        return F.xxhash64(scope, indexed, i, F.substring(wide, 4 * start + 1, 4 * (base + F.when(i >= short, 1).otherwise(0))))

    return _with(F.encode(line, "UTF-32"), lambda wide: F.transform(table, lambda x: key(wide, x)))


def _word_parities(line: Column) -> Column:
    """Parities of the numbers of words in 64 classes.

    An edit changes at most three words (two become one, or one two), so lines within tau edits
    differ in at most 3 tau of these bits.
    """
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(F.split(line, " "), F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(bit(w)))


def _letter_codes(line: Column, letters: str) -> Column:
    """How often each of 16 letters occurs, modulo 8, as four bits of a long.

    The four bits fill up from the right and empty again, so that counts one apart differ in one bit.
    An edit changes the counts of at most two letters by one, so lines within tau edits differ in at
    most 2 tau bits.
    """
    codes = F.array(*[F.lit((1 << m) - 1 if m < 5 else 15 << (m - 4) & 15).cast("long") for m in range(8)])
    code = F.lit(0).cast("long")
    for i, x in enumerate(letters):
        count = F.length(line) - F.length(F.replace(line, F.lit(x), F.lit("")))
        code = code.bitwiseOR(F.call_function("shiftleft", F.get(codes, F.pmod(count, F.lit(8)).cast("int")), F.lit(4 * i)))
    return code


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, within_document: bool, copies: DataFrame | None = None) -> DataFrame:
    """(doc_id, mark, pos, copy_of, scope, line, h, g) of the lines that are long enough to compare.

    h and g are hashes of scope and line with seeds of their own, 128 bits that are a line's identity.
    """
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("copy_of", F.lit(None).cast("long")) if copies is None else docs.join(small(copies).select("doc_id", "copy_of"), "doc_id", "left")
    # normalised inside the array, as the filters on length and on empty arrays would else repeat the expression
    every = F.posexplode_outer(F.transform(F.transform(F.split("text", "\n"), plain_line), squeezed)).alias("pos", "line")
    line = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("mark"), "copy_of", every).where(F.length("line") >= min_chars)
    scope = F.xxhash64("doc_id", "mark") if within_document else F.lit(0).cast("long")
    return line.withColumn("scope", scope).withColumns({"h": F.xxhash64("scope", "line"), "g": F.xxhash64(F.lit("g"), "line", "scope")})


def _members(distinct: DataFrame, tau: int) -> DataFrame:
    """(key, id, own) of all lines at keys that one line has as its own and another looks up.

    A key's rows are sorted once; a line's number and whether the key is its own go as one long.
    """
    rows = distinct.select("id", F.posexplode("probes").alias("at", "key"))
    rows = rows.select("key", (2 * F.col("id") + F.when(F.col("at").isin(own_places(tau)), 1).otherwise(0)).alias("who"))
    found = []
    for i in range(PASSES):
        here = Window.partitionBy("key")
        part = rows.where(F.pmod("key", F.lit(PASSES)) == i).withColumns({"low": F.min(F.expr("who div 2")).over(here), "high": F.max(F.expr("who div 2")).over(here), "own": F.max(F.expr("who & 1L")).over(here)})
        found.append(materialize(part.where("low < high and own = 1").selectExpr("key", "who div 2 as id", "who & 1L = 1 as own"), "line-members"))
    return functools.reduce(DataFrame.union, found)


def _links(line: DataFrame, distinct: DataFrame, tau: int) -> DataFrame:
    """(a, b): numbers of different lines within ``tau`` edits, each pair once."""
    members = _members(distinct, tau)
    ids = materialize(members.select("id").distinct(), "line-ids")
    named = distinct.select("id", "h", "g").join(small(ids), "id", "left_semi")
    texts = materialize(line.select("h", "g", "line").join(small(materialize(named, "line-names")), ["h", "g"]).groupBy("id").agg(F.any_value("line").alias("line")), "line-texts")
    traits = materialize(texts.select("id", _word_parities(F.col("line")).alias("w"), *[_letter_codes(F.col("line"), x).alias(n) for n, x in zip("xy", LETTERS, strict=True)]), "line-traits")
    side = lambda x, rows: rows.join(traits, "id").select("key", F.col("id").alias(x), *[F.col(c).alias(c + x) for c in "wxy"])
    alike = f"a <> b and bit_count(wa ^ wb) <= {3 * tau} and bit_count(xa ^ xb) + bit_count(ya ^ yb) <= {2 * tau}"
    pairs = side("a", members.where("own")).join(side("b", members), "key").where(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "line-pairs")
    text = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"))
    both = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", characters(F.col("line_a")).alias("ca"), characters(F.col("line_b")).alias("cb"))
    return materialize(both.where(within_distance(F.col("ca"), F.col("cb"), tau)).select("a", "b"), "line-links")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, min_chars: int = 16, within_document: bool = False, copies: DataFrame | None = None) -> DataFrame:
    """(doc_id, mark, pos, near) of every line that repeats an earlier one.

    Lines are compared in the form of ``normal_line`` (A-Z lowered, digits as 0, white space
    collapsed), from ``min_chars`` characters on; order is (doc_id, line number). A line is removed
    if an equal line stands earlier, or (``near``) a different line within ``tau`` edits first stood
    earlier than the line itself did. Lines are judged on the input, not on what is left.
    ``within_document`` compares only lines of one document.

    ``copies`` (a table of doc_id, copy_of; one row for each id) names documents that a later step drops as
    near copies of document ``copy_of``. Lines are then judged on the other documents alone. A copy
    loses the lines that another group's document keeps or its original loses, and its own repeats,
    but no line for standing in its original: it stays a copy that the later step recognises, and no
    line goes for standing in a document that will be dropped.

    Equal lines are collapsed before the join, with their first place only, so a line that is in a
    third of all documents is one row there. Lines are told apart by 128 bits of hash. Keys are first
    reduced to those that two different lines share, in ``PASSES`` parts; only there are lines paired,
    under bounds on edits that counts of words and letters give. Many lines made from one template
    share keys and are compared by these counts, but only those within the bounds become rows.
    """
    with passing() as made:
        line = materialize(_lines(docs, id_col, text_col, min_chars, within_document, copies), "lines")
        probes = segment_keys(F.col("line"), F.col("scope"), tau)
        place = F.when(F.col("copy_of").isNull(), F.struct("doc_id", "mark", "pos"))
        read = line.select("h", "g", place.alias("first"), probes.alias("probes"))
        distinct = read.groupBy("h", "g").agg(F.min("first").alias("first"), F.any_value("probes").alias("probes"), F.count("*").alias("n"))
        distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "line-keys")
        links = _links(line, distinct, tau)
        each = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = distinct.select("id", "h", "g", "n", "first")
        seen = each.join(first.select(F.col("id").alias("b"), F.col("first").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        later = first.join(seen.withColumnRenamed("a", "id"), "id", "left").where("n > 1 or other is not null")
        later = materialize(later.select("h", "g", "first", "other", F.coalesce(F.col("other") < F.col("first"), F.lit(False)).alias("near")), "line-verdicts")
        at = line.select("h", "g", "doc_id", "mark", "pos", "copy_of").join(small(later, 200_000), ["h", "g"])
        gone = "copy_of is null and (near or not (struct(doc_id, mark, pos) <=> first))"
        if copies is not None:
            own = at.where("copy_of is not null").withColumn("own", F.min("pos").over(Window.partitionBy("doc_id", "mark", "h", "g")))
            at = at.where("copy_of is null").withColumn("own", F.col("pos")).union(own).withColumn("elsewhere", F.coalesce("first", "other"))
            gone = f"{gone} or copy_of is not null and (near or pos > own or elsewhere is not null and not (elsewhere.doc_id <=> copy_of))"
        out = materialize(at.where(gone).select("doc_id", "mark", "pos", "near"), "removed-lines")
        made.remove(out)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, held: int = 12) -> DataFrame:
    """(doc_id, copy_of) of documents that a later near-dedup step will find to be copies of ``copy_of``.

    By DataFrame functions only, as the rest of this module. A document's keys are the ``held``
    smallest hashes of its ``words``-word shingles: two documents of similarity s share none with
    probability (1 - s)^held, 4e-9 at 0.8. A key's documents are compared with the smallest of them
    only, shingle by shingle, so a group of n copies makes n pairs for a key; links are followed to the smallest
    document reached. What this misses is a link that runs through no such first document.
    """
    text = F.col(text_col).cast("string")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null and text is not null")
    read = read.select("doc_id", F.xxhash64("text").alias("m"), F.xxhash64(F.lit("g"), "text").alias("g"), text_words(F.lower("text")).alias("w"))
    gram = lambda w, x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, words)])
    every = lambda w: F.when(F.size(w) < words, F.filter(F.array(F.xxhash64(F.array_join(w, " "))), lambda _: F.size(w) > 0)).otherwise(F.transform(F.slice(w, 1, F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda x, i: gram(w, x, i)))
    shingled = read.select("doc_id", "m", "g", _with(F.col("w"), every).alias("s"))
    with passing() as made:
        keyed = materialize(shingled.select("doc_id", "m", "g", F.slice(F.sort_array(F.array_distinct("s")), 1, held).alias("keys")), "sketches")
        same = keyed.groupBy("m", "g").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("m", "g", "a")
        known = keyed.join(small(materialize(same, "equal-texts")), ["m", "g"], "left")
        links = materialize(known.where("doc_id <> a").select("a", F.col("doc_id").alias("b")), "copy-links")
        key = known.where("a is null or doc_id = a").select("doc_id", F.explode("keys").alias("key"))
        first = key.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key", "a")
        pairs = materialize(key.join(first, "key").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "copy-pairs")
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "copy-ids")
        sets = materialize(shingled.join(small(ids), "doc_id", "left_semi").select("doc_id", F.array_distinct("s").alias("s")), "copy-sets")
        side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("s").alias(f"s{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        common, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
        links = links.union(materialize(both.where(100 * common >= percent * (total - common)).select("a", "b"), "near-links"))
        out = materialize(components(links, plain=True).where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("copy_of")).distinct(), "copies")
        made.remove(out)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all their columns, without the lines that ``removals`` names.

    Defined cases: null and empty texts are unchanged; a document all of whose lines go keeps an
    empty text; rows with equal id and text lose the same lines; null ids come first in the order;
    shorter lines always stay.
    """
    gone = removals(docs, id_col, text_col, **options).groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("_gone"))
    gone = small(materialize(gone.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), "lines-to-go"))
    text = F.col(text_col).cast("string")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("_text"))
    out = packed.join(gone, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_mark")), "left")
    text = F.col(f"_row.`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    new = F.when(F.col("_gone").isNull(), text).otherwise(left)
    return out.select(*[(new if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_lines, n_removed and n_near_removed of ``removals``."""
    gone = removals(docs, id_col, text_col, **options).groupBy("doc_id", "mark").agg(F.count("*").alias("n_removed"), F.count_if("near").alias("n_near_removed"))
    gone = small(materialize(gone.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), "line-counts"))
    text = F.col(text_col).cast("string")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("mark"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = read.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("doc_id").alias(id_col), "n_lines", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_near_removed", zero).alias("n_near_removed"))
