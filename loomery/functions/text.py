"""Text functions: sentences, tokens, keys and cleaning, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and lists whose results must equal the source system's.
SENTENCE_ENDS = "。！？!?；;\n"
NOISE = r"^[\d\t|、，,。/\\ \-\+%=]+$"
LEADER = (
    r"^\s*(?:[①-⑳\d一二三四五六七八九十百千]+[\.、．:：\)）]|\(\d+\)|\[\d+\]|[-\*•·>►▶]|[a-zA-Z]\d{0,2}\)|"
    r"(?:Case|步骤|Step|Note|注意|说明|场景|方案)[一二三四五六七八九十\d]*[\.、:：])\s*"
)
SPACES = " \t\n\r\x0b\x0c"
CJK = r"[\x{4e00}-\x{9fff}]"

STEM_SUFFIXES = (
    ("ing", 3), ("tion", 4), ("sion", 4), ("ment", 4), ("ness", 4), ("ence", 4), ("ance", 4), ("able", 4),
    ("ible", 4), ("ful", 3), ("less", 4), ("ous", 3), ("ive", 3), ("al", 2), ("ed", 2), ("es", 2), ("er", 2),
    ("s", 1), ("y", 1),
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def once(rows: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``rows`` with costly columns that filters and expressions behind may use without working them out again.

    The optimizer copies a projected expression into a filter on it; it does not do so across a generator.
    """
    one = F.array(F.struct(*[c.alias(name) for name, c in made.items()]))
    return rows.select(*keep, F.explode_outer(one).alias("_made")).select(*keep, *[f"_made.{name}" for name in made])


def split_class(text: Column, characters: str) -> Column:
    """Split at any of some characters."""
    escaped = "".join("\\" + c if c in "\\]^-[" else c for c in characters)
    return F.split(text, f"[{escaped}]")


def words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def mixed_tokens(text: Column) -> Column:
    """The set of ``[a-z0-9_]{2,}`` tokens and of the two-character pieces of CJK runs (a run of one is whole)."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"({CJK}+)"), 1)
    last = lambda r: F.greatest(F.lit(1), F.length(r) - 1)
    pieces = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), last(r)), lambda i: F.substring(r, i, 2))))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"([a-z0-9_]{2,})"), 1), pieces))


def keywords(name: Column, stop: tuple[str, ...] = ()) -> Column:
    """Parts of a name split at ``_``, ``-`` or spaces, of 3 characters or more, and the first 3 CJK runs of 2 to 4."""
    parts = F.filter(F.split(F.lower(name), r"[_\-\s]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*stop) if stop else F.length(w) >= 3)
    runs = F.slice(F.regexp_extract_all(name, F.lit(f"({CJK}{{2,4}})"), 1), 1, 3)
    return F.array_distinct(F.concat(parts, runs))


def rich_text(name: Column, description: Column, parameters: Column) -> Column:
    """A tool in one sentence or two for an embedding: readable name, the first 300 characters of its purpose, and parameters if it has any."""
    readable = F.translate(name, "_-", "  ")
    purpose = strip(F.left(F.coalesce(description, F.lit("")), F.lit(300)))
    listed = F.array_join(parameters, ", ")
    # The words between.
    whole = F.concat(F.lit("Tool: "), readable, F.lit(". Purpose: "), purpose, F.lit("."))
    return F.when(F.coalesce(listed, F.lit("")) == "", whole).otherwise(F.concat(whole, F.lit(" Parameters: "), listed, F.lit(".")))


def stem_variants(word: Column) -> Column:
    """A word, its form without the first suffix that fits, and that stem with every suffix; sorted, over 2 long."""
    w = F.lower(word)
    none = F.array().cast("array<string>")

    def with_suffix(suffix: str) -> Column:
        base = F.left(w, F.length(w) - len(suffix))
        grown = [F.concat(base, F.lit(s)) for s, _ in STEM_SUFFIXES]
        return F.concat(F.array(base), F.filter(F.array(*grown), lambda v: F.length(v) > 3), F.array(w))

    chosen = reduce(
        lambda rest, item: F.when(
            F.endswith(w, F.lit(item[0])) & (F.length(w) - len(item[0]) >= item[1]), with_suffix(item[0])
        ).otherwise(rest),
        reversed(STEM_SUFFIXES),
        none,
    )
    base = F.left(w, F.length(w) - 3)
    ies = F.when(F.endswith(w, F.lit("ies")), F.array(F.concat(base, F.lit("y")), base)).otherwise(none)
    ied = F.when(F.endswith(w, F.lit("ied")), F.array(F.concat(base, F.lit("y")))).otherwise(none)
    every = F.array_distinct(F.concat(F.array(w), chosen, ies, ied))
    return F.array_sort(F.filter(every, lambda v: F.length(v) > 2))


def strip_letters(word: Column, letters: str) -> Column:
    """Remove trailing characters of a set (not a suffix)."""
    return F.regexp_replace(word, f"[{letters}]+$", "")


def short_id(prefix: str, text: Column, size: int = 12) -> Column:
    """A deterministic id: prefix and the first digits of the text's SHA-256, trimmed and lower-cased."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, size))


def fingerprint(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def truncated(text: Column, size: int = 60) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def without_suffix_note(text: Column) -> Column:
    """A name without a trailing ``[...]`` or ``(...)``."""
    return F.trim(F.regexp_replace(text, r"\s*[\[\(][^\[\]\(\)]*[\]\)]\s*$", ""))


def without_thinking(text: Column) -> Column:
    """A model's answer without ``<think>`` parts and code fences."""
    plain = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(plain, r"(?m)^```[a-zA-Z]*\s*$", ""))


def line_range(anchor: Column) -> Column:
    """(first, last) of ``L42-L68`` or ``L42``; nulls where there is none."""
    first = F.nullif(F.regexp_extract(anchor, r"L(\d+)", 1), F.lit("")).cast("int")
    last = F.nullif(F.regexp_extract(anchor, r"L\d+-L?(\d+)", 1), F.lit("")).cast("int")
    return F.struct(first.alias("first"), F.coalesce(last, first).alias("last"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(50), F.floor(F.length(text) / 3).cast("int"))


def canonical_uri(scheme: Column, location: Column, revision: Column, subpath: Column, anchor: Column) -> Column:
    """``repo:location#revision:subpath#anchor``, ``file:`` for relative paths, else ``scheme://location#anchor``.

    Only a repository has a revision and a subpath; elsewhere they are an error.
    """
    some = lambda mark, part: F.when(F.coalesce(part, F.lit("")) != "", F.concat(F.lit(mark), part)).otherwise("")
    repo = F.concat(F.lit("repo:"), location, some("#", revision), some(":", subpath))
    plain = F.when((scheme == "file") & F.startswith(location, F.lit(".")), F.concat(F.lit("file:"), location))
    plain = plain.otherwise(F.concat(scheme, F.lit("://"), location))
    bad = (scheme != "repo") & (revision.isNotNull() | subpath.isNotNull())
    base = F.when(scheme == "repo", repo).when(bad, F.raise_error(F.lit("only a repository has a revision and a subpath"))).otherwise(plain)
    return F.concat(base, some("#", anchor))


def filled(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` replaced by columns (null: nothing); one name after the other, as given."""
    out = F.lit(template)
    for name, part in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(part.cast("string"), F.lit("")))
    return out


def _hyphened(digits: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digits, at, size) for at, size in cuts])


def _with_variant(digit: Column) -> Column:
    """A hexadecimal digit whose two high bits are 10."""
    return F.lower(F.hex(F.conv(digit, 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))


def name_id(namespace: str, name: Column) -> Column:
    """A version 5 UUID of a name in a namespace (itself a UUID)."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digits = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    part = lambda at, size: F.substring(digits, at, size)
    return _hyphened(F.concat(part(1, 12), F.lit("5"), part(14, 3), _with_variant(part(17, 1)), part(18, 15)))


def time_id(micros: Column, sequence: Column, node: Column) -> Column:
    """A version 6 UUID: ids sort by their time (microseconds of the Unix epoch), then by a sequence number of 14 bits.

    ``node`` fills the last 48 bits.
    """
    return tick_id(micros.cast("long") * 10, sequence, node)


def tick_id(tenths: Column, sequence: Column, node: Column) -> Column:
    """:func:`time_id` of a time in tenths of microseconds, so that equal times can be told apart by it."""
    # Fixed value: tenths of microseconds from the calendar's reform to the Unix epoch.
    ticks = F.lpad(F.lower(F.hex(tenths.cast("long") + F.lit(0x01B21DD213814000))), 15, "0")
    marked = sequence.cast("long").bitwiseAND(F.lit(0x3FFF)).bitwiseOR(F.lit(0x8000))
    last = F.lpad(F.lower(F.hex(node.cast("long").bitwiseAND(F.lit(0xFFFFFFFFFFFF)))), 12, "0")
    return _hyphened(F.concat(F.substring(ticks, 1, 12), F.lit("6"), F.substring(ticks, 13, 3), F.lower(F.hex(marked)), last))
