"""Column expressions shared by the jobs. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from specmill import refdata as R

# what counts as blank around a value (ASCII and the common Unicode blanks)
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """Null-safe trim of every kind of blank."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))


def strip_id(c: Column) -> Column:
    """``strip`` for identifiers. It names its argument once: Spark puts the expression of a derived column in the place of every
    mention when it pushes a filter down, and texts made of many cases then outgrow the 64 KB of a compiled method."""
    return strip(c)


def strip_kept(c: Column) -> Column:
    """``strip_id`` for columns of written tables. A value between two visible ASCII characters is left as it is at a sixth of the
    cost; but the argument is named several times, so it must not stand for a long derivation."""
    plain = F.ascii(c).between(33, 126) & F.ascii(F.substr(c, F.lit(-1))).between(33, 126)
    return F.when(plain, c).otherwise(strip(c))


def key_kept(c: Column) -> Column:
    """``key`` for columns of written tables."""
    return F.upper(strip_kept(c))


def key(c: Column) -> Column:
    """Comparison form of an identifier: trimmed and upper-cased."""
    return F.upper(strip_id(c))


def is_empty_marker(c: Column) -> Column:
    return key(c).isin(R.EMPTY_MARKERS)


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


# three punctuation-free forms; the character classes differ on purpose
def plain_grounding(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[\s\-._/]+", "")


def plain_batch(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[\s\-.,/_]", "")


def plain_text(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[\s\-.,/]", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=.)\.[^.]*$", "")


def contains_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def first_hit(c: Column, table: list[tuple[str, list[str]]]) -> Column:
    """Label of the first entry (in table order) one of whose words occurs in ``c``; null if none does."""
    out = None
    for label, words in table:
        cond = contains_any(c, [w.upper() for w in words])
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def first_of(arr: Column) -> Column:
    """First element or null."""
    return F.try_element_at(arr, F.lit(1))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where it appears in conditions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def join_key(c: Column, row: str = "record_id") -> Column:
    """``c`` as a key of a left join: rows without a value are spread over keys that match nothing, not dealt to one task."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.concat(F.lit("\n"), F.pmod(F.xxhash64(row), F.lit(4096)).cast("string"))).otherwise(c)


def nullif_blank(c: Column) -> Column:
    return F.when(c != "", c)


def joined_sorted(arr: Column, sep: str = "|") -> Column:
    return F.concat_ws(sep, F.sort_array(arr))


def chars(c: Column) -> Column:
    """Array of the characters of ``c`` (empty for an empty string)."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def four_grams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n >= 4, F.transform(F.sequence(F.lit(1), n - 3), lambda i: F.substr(c, i, F.lit(4)))).otherwise(
        F.array().cast("array<string>")
    )


def share_sequence(a: Column, b: Column) -> Column:
    """Do both identifiers, without punctuation, share a run of four characters?"""
    norm = lambda c: F.regexp_replace(F.upper(c), r"[\s\-\./_,]", "")
    return F.arrays_overlap(four_grams(norm(a)), four_grams(norm(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays seen as sets; 0 if either is empty."""
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0),
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)),
    ).otherwise(F.lit(0.0))


def digit_jaccard(a: Column, b: Column) -> Column:
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)
    return jaccard(runs(a), runs(b))


def char_jaccard(a: Column, b: Column) -> Column:
    letters = lambda c: F.array_distinct(chars(F.regexp_replace(F.upper(c), r"[\s\-\./_,]", "")))
    return jaccard(letters(a), letters(b))


def finding(type_: str, severity: Column | str, source: Column | str, value: Column, message: Column | str) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        F.lit(type_).alias("type"),
        lit(severity).alias("severity"),
        lit(source).alias("source"),
        value.alias("value"),
        lit(message).alias("message"),
    )


FINDING_TYPE = "struct<type:string,severity:string,source:string,value:string,message:string>"
NO_FINDINGS = "array<" + FINDING_TYPE + ">"


def no_findings() -> Column:
    return F.array().cast(NO_FINDINGS)


def findings_if(cond: Column, item: Column) -> Column:
    """One-element findings array where ``cond`` holds, else an empty one."""
    return F.when(cond, F.array(item).cast(NO_FINDINGS)).otherwise(no_findings())


def round_half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)
