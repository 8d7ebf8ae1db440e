"""Line deduplication over a whole corpus by a deletion-neighbourhood join.

A line is its sequence of tokens: what stands between single spaces.  Of equal lines the
earliest stays; a line of at least ``near_tokens`` tokens also goes if an earlier line of at
least as many is within one token of it (one token put in, left out or replaced).  Shorter
lines are compared for equality only: one token in few is no near copy.  Earlier means:
smaller document id (nulls last), then smaller hash of the text, then smaller line number.
Lines of white space alone always stay.

The neighbourhood: two lines within one token have a common variant after deleting one
token of each (or of the longer).  Variants are emitted as hashed keys, equal keys meet,
and the edit distance is then verified on the tokens themselves.  Only lines that share
half of their tokens with another line can be within one token of one: one half of the two
is untouched by the edit.  So the variants are emitted for lines with a shared half only,
and only for deletions in the other half; nothing is lost by that.  A key's group is never
listed in pairs and never brought together: lines that share a variant with the same place
deleted are all within one token of each other, and a line equal to a variant is within one
token of all its owners, so a key's earliest line is enough.  It is found by partial minima
and joined back.

Rows are sifted before they move by a bit filter of fixed size (``_WORDS`` longs, broadcast):
it lets through every row that an exact join behind it wants, and few others; when it is
full it only sifts less.

Everything here is DataFrame code: built-in functions only.

Defined results: a null text stays null; an empty text stays empty; a document may end up
with an empty text; of fully repeated rows one keeps its lines.  Rows with one id, or none,
are told apart by 128 bits of their text's hash.  Any extra columns are passed through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.util import cut

_BLANK = " \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1
#: A position: document, two hashes of its text, line.
_AT = ("d", "a", "b", "line")
_WORDS = 1 << 16
#: Lines of more tokens take their variants from running sums, which stay linear.
_SHORT = 1000


def _document(key: str, text: str) -> list[Column]:
    """What tells a row from others, in the order of documents."""
    t = F.col(f"`{text}`")
    doc = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST))
    return [doc.alias("d"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit(5), t).alias("b")]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(d, a, b, line, l) of every line that is not blank."""
    rows = docs.select(*_document(key, text), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("line", "l"))
    return rows.where(F.btrim("l", F.lit(_BLANK)) != "")


def _sifted(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """``rows`` whose ``columns`` may be among ``wanted``: all that are, and few others."""

    def place() -> tuple[Column, Column]:
        h = F.xxhash64(F.lit(11), *columns)
        return F.pmod(h, F.lit(_WORDS)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")

    word, bit = place()
    bits = wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_one"))
    bits = bits.groupBy("_word").agg(F.bit_or("_one").alias("_bits"))  # ``_WORDS`` rows at most
    met = rows.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return met.where(F.call_function("getbit", F.col("_bits"), bit) == 1).select(*rows.columns)


def _half(side: int, size: Column) -> Column:
    """The key of the first (0) or last (1) ``size`` tokens of column ``l``."""
    part = F.call_function("substring_index", F.col("l"), F.lit(" "), size if side == 0 else -size)
    return F.xxhash64(F.lit(side), size, part)


def _running(values: Column) -> Column:
    """Prefix sums, from 0 on: one more than there are values; worked out in chunks, so that long lines stay linear."""
    size = 256

    def short(own: Column) -> Column:
        start = F.array(F.lit(0).cast("long"))
        return F.aggregate(own, start, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    count = F.ceil(F.size(values) / size).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda c: short(F.slice(values, c * size + 1, size)))
    before = F.slice(short(F.transform(chunks, lambda r: F.element_at(r, -1))), 1, count)
    moved = F.zip_with(chunks, before, lambda r, o: F.transform(F.slice(r, 2, size), lambda x: x + o))
    return F.concat(F.array(F.lit(0).cast("long")), F.flatten(moved))


def _within_one(x: Column, y: Column) -> Column:
    """True where two token sequences are within one token."""

    def common(a: Column, b: Column) -> Column:
        first = F.array_position(F.zip_with(a, b, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(first == 0, F.size(a).cast("long")).otherwise(first - 1)

    longest = F.greatest(F.size(x), F.size(y))
    near = F.abs(F.size(x) - F.size(y)) <= 1
    return near & (common(x, y) + common(F.reverse(x), F.reverse(y)) >= longest - 1)


def _deleted(n: Column) -> Column:
    """The places to delete: a shared first half (side 0) leaves those behind it, a shared second half those before."""
    middle = F.shiftright(n - 1, 1)
    first = F.when(F.col("high") == 1, F.lit(1)).otherwise(middle + 1)
    last = F.when(F.col("low") == 0, n).otherwise(n - middle)
    return F.sequence(first, last)


def _short_variants(lines: DataFrame) -> DataFrame:
    """(r, i, v1, v2): the whole line (i = 0) and the line without its ``i``-th token, hashed.

    Each token stands as eight bytes of its hash, so leaving one out is a copy of bytes.
    """
    hashes = F.transform("w", lambda w: F.lpad(F.hex(F.xxhash64(w)), 16, "0"))
    coded = lines.select("r", "low", "high", F.size("w").alias("n"), F.unhex(F.array_join(hashes, "")).alias("x"))
    places = F.concat(F.array(F.lit(0)), _deleted(F.col("n")))
    each = coded.select("r", "n", "x", F.explode(places).alias("i"))
    part = lambda start, size: F.call_function("substring", F.col("x"), start, size)
    rest = F.concat(part(F.lit(1), (F.col("i") - 1) * 8), part(F.col("i") * 8 + 1, (F.col("n") - F.col("i")) * 8))
    each = each.select("r", "i", F.when(F.col("i") == 0, F.col("x")).otherwise(rest).alias("x"))
    return each.select("r", "i", F.xxhash64("x").alias("v1"), F.xxhash64(F.lit(1), "x").alias("v2"))


def _long_variants(lines: DataFrame) -> DataFrame:
    """The same from sums over tokens and their places, in linear time."""

    def sums(seed: int, shift: int) -> Column:
        return _running(F.transform("w", lambda w, i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), w, i - shift), 22)))

    summed = lines.select(
        "r", "low", "high", F.size("w").alias("n"),
        sums(1, 0).alias("a1"), sums(1, 1).alias("b1"), sums(2, 0).alias("a2"), sums(2, 1).alias("b2"),
    )

    def variant(a: str, b: str, i: Column) -> Column:
        return F.element_at(a, i) + F.element_at(b, -1) - F.element_at(b, i + 1)

    whole = F.struct(F.lit(0).alias("i"), F.element_at("a1", -1).alias("v1"), F.element_at("a2", -1).alias("v2"))
    without = F.transform(
        _deleted(F.col("n")),
        lambda i: F.struct(i.alias("i"), variant("a1", "b1", i).alias("v1"), variant("a2", "b2", i).alias("v2")),
    )
    return summed.select("r", F.explode(F.concat(F.array(whole), without)).alias("e")).select("r", "e.*")


def near_lines(first: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Positions (d, a, b, line) of lines that an earlier line is within one token of.

    ``first``: positions and the half keys p1, p2, s1, s2 of distinct lines that are long enough.
    """
    sides = [F.struct(F.lit(i // 2).alias("side"), F.col(c).alias("key")) for i, c in enumerate(("p1", "p2", "s1", "s2"))]
    halves = first.select(*_AT, F.explode(F.array(*sides)).alias("h")).select(*_AT, "h.side", "h.key").where("key is not null")
    shared = cut(halves.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    met = _sifted(halves, shared, "key").join(shared, "key", "left_semi")
    open_ = cut(met.groupBy(*_AT).agg(F.min("side").alias("low"), F.max("side").alias("high")))
    lines = (
        _sifted(_lines(docs, key, text), open_.select(*_AT), *_AT)
        .join(open_, list(_AT))
        # Fully repeated rows have their lines at the same positions.
        .groupBy(*_AT, "low", "high")
        .agg(F.min("l").alias("l"))
    )
    # Ranges in the order of positions: from here on a line is one number that grows with its position.
    lines = lines.orderBy(*_AT).select(F.monotonically_increasing_id().alias("r"), *_AT, "low", "high", F.split("l", " ").alias("w"))
    lines = cut(lines)
    short, long_ = lines.where(F.size("w") <= _SHORT + 1), lines.where(F.size("w") > _SHORT)
    entries = _short_variants(short).unionByName(_long_variants(long_))
    deleted, whole = entries.where("i > 0"), entries.where("i = 0").drop("i")

    at = ("v1", "v2", "i")
    earliest = deleted.groupBy(*at).agg(F.min("r").alias("witness"), F.max("r").alias("last"))
    earliest = cut(earliest.where("witness < last").drop("last"))
    same = _sifted(deleted, earliest, *at).join(earliest, list(at)).where("witness < r").select("r", "witness")

    value = ("v1", "v2")
    cuts = _sifted(deleted, whole, *value).select(F.col("r").alias("owner"), *value)
    apart = cuts.join(whole, list(value)).select(F.greatest("r", "owner").alias("r"), F.least("r", "owner").alias("witness"))

    pairs = same.unionByName(apart).groupBy("r").agg(F.min("witness").alias("witness"))
    own = lines.select("r", *_AT, "w")
    return (
        pairs.join(own, "r")
        .join(lines.select(F.col("r").alias("witness"), F.col("w").alias("v")), "witness")
        .where(_within_one(F.col("w"), F.col("v")))
        .select(*_AT)
    )


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", near_tokens: int = 8, counts_as: str | None = None
) -> DataFrame:
    """The documents with repeated lines left out: all columns of ``docs`` with the text changed.

    ``counts_as`` names a further struct column with n_lines and n_dropped, if it is wanted.
    """
    lines = _lines(docs, key, text)
    n = (F.octet_length("l") - F.octet_length(F.replace("l", F.lit(" "), F.lit(""))) + 1).cast("int")
    long_ = F.col("n") >= near_tokens
    more = F.shiftright(F.col("n"), 1)
    less = F.shiftright(F.col("n") - 1, 1)
    even = long_ & (more != less)
    halves = ("p1", "p2", "s1", "s2")
    distinct = cut(
        lines.withColumn("n", n)
        .select(
            F.struct(*_AT).alias("pos"), F.xxhash64("l").alias("h1"), F.xxhash64(F.lit(7), "l").alias("h2"),
            F.when(long_, _half(0, less)).alias("p1"), F.when(even, _half(0, more)).alias("p2"),
            F.when(long_, _half(1, less)).alias("s1"), F.when(even, _half(1, more)).alias("s2"),
        )
        .groupBy("h1", "h2")
        .agg(F.min("pos").alias("pos"), *[F.first(c).alias(c) for c in halves])
        .select("pos.*", *halves)
    )
    near = near_lines(distinct.where("p1 is not null"), docs, key, text)
    kept = distinct.select(*_AT).join(near, list(_AT), "left_anti")
    kept = kept.groupBy("d", "a", "b").agg(F.collect_list("line").alias("kept"))
    others = [c for c in docs.columns if c != text]
    whole = docs.select(
        *_document(key, text), F.col(f"`{text}`").alias("t"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)],
    )
    # Of fully repeated rows the first has the lines.
    copy = F.row_number().over(Window.partitionBy("d", "a", "b").orderBy("a"))
    whole = whole.withColumn("copy", copy).join(kept, ["d", "a", "b"], "left")
    none = F.array().cast("array<int>")
    keeps = F.when(F.col("copy") == 1, F.coalesce("kept", none)).otherwise(none)
    # A line's number is enough to find it again, so a document takes the time of a sort of its lines.
    blanks = F.filter(F.transform("all", lambda l, i: F.when(F.btrim(l, F.lit(_BLANK)) == "", i)), lambda i: i.isNotNull())
    made = whole.withColumn("all", F.split("t", "\n")).withColumn("stay", F.concat(blanks, keeps))
    left = F.array_join(F.transform(F.sort_array("stay"), lambda i: F.get("all", i)), "\n")
    left = F.when(F.size("stay") == F.size("all"), F.col("t")).otherwise(left)
    zero = F.lit(0).cast("long")
    counts = F.struct(
        F.coalesce(F.size("all").cast("long"), zero).alias("n_lines"),
        F.when(F.col("t").isNull(), zero).otherwise((F.size("all") - F.size("stay")).cast("long")).alias("n_dropped"),
    )
    named = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text: left}
    return made.select(*[named[c].alias(c) for c in docs.columns], *([counts.alias(counts_as)] if counts_as else []))
