"""Pieces of checking SQL, written for DuckDB and independent of the Spark expressions."""

from __future__ import annotations

import re

from specmill import refdata as R
from specmill.sources import adapter

_TABLES = adapter.checking_sql()
_NAMES = list(_TABLES)


def _needs(sql: str) -> set[str]:
    found = {n for n in _NAMES if re.search(rf"\b{n}\b", sql)}
    for n in list(found):
        found |= _needs(_TABLES[n]) - found if _TABLES[n] != sql else set()
    return found


def check(sql: str) -> str:
    """Prefix the statement with the derived tables it mentions."""
    need = _needs(sql)
    ctes = [f"{n} AS ({_TABLES[n]})" for n in _NAMES if n in need]
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def inn(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), E' \\t\\n\\r')"


def key(x: str) -> str:
    return f"upper({strip(x)})"


def stem(x: str) -> str:
    return f"regexp_replace({x}, '^(.+)\\.[^.]*$', '\\1')"


def rx(x: str, p: str) -> str:
    return f"regexp_matches({x}, {lit(p)})"


def cap(x: str, p: str, g: int = 1) -> str:
    return f"regexp_extract({x}, {lit(p)}, {g})"


def sub(x: str, p: str, r: str) -> str:
    return f"regexp_replace({x}, {lit(p)}, {lit(r)}, 'g')"


def groups(replacement: str) -> str:
    """Group references of a replacement text in this engine's spelling (one digit each)."""
    return re.sub(r"\$(\d)", r"\\\1", replacement)


def anyof(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def first_label(x: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {anyof(x, [w.upper() for w in ws])} THEN {lit(k)}" for k, ws in table) + " END"


def lookalike(a: str, b: str) -> str:
    per = (
        f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = substr({b}, i, 1) THEN 0 "
        f"WHEN contains({lit(R.lookalike_string())}, '|' || substr({a}, i, 1) || substr({b}, i, 1) || '|') THEN 1 ELSE 99 END))"
    )
    return f"(CASE WHEN length({a}) <> length({b}) THEN 99 ELSE least(99, {per}) END)"


def distance(a: str, b: str) -> str:
    """Brute-force identifier distance of two upper-cased SQL expressions (plain column names only)."""
    swap = (
        f"(CASE WHEN length({a}) = length({b}) AND len(list_filter(range(1, length({a})), lambda i: "
        f"substr({a}, 1, i - 1) || substr({a}, i + 1, 1) || substr({a}, i, 1) || substr({a}, i + 2) = {b})) > 0 THEN 1 ELSE 99 END)"
    )

    def drop(lo: str, sh: str) -> str:
        return (
            f"(CASE WHEN length({lo}) = length({sh}) + 1 AND len(list_filter(range(1, length({lo}) + 1), lambda i: "
            f"substr({lo}, 1, i - 1) || substr({lo}, i + 1) = {sh})) > 0 THEN 1 ELSE 99 END)"
        )

    def letter(lo: str, sh: str) -> str:
        cut = f"substr({lo}, 1, length({lo}) - 1)"
        return (
            f"(CASE WHEN length({lo}) = length({sh}) + 1 AND regexp_matches({lo}, '\\p{{L}}$') THEN {lookalike(cut, sh)} ELSE 99 END)"
        )

    return (
        f"(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 99 WHEN {a} = {b} THEN 0 ELSE "
        f"least({lookalike(a, b)}, {swap}, {drop(a, b)}, {drop(b, a)}, {letter(a, b)}, {letter(b, a)}) END)"
    )


def bare(x: str) -> str:
    return f"regexp_replace(upper({x}), '[\\s\\-\\./_,]', '', 'g')"


def shares4(a: str, b: str) -> str:
    return (
        f"(length({a}) >= 4 AND len(list_filter(range(1, length({a}) - 2), lambda i: contains({b}, substr({a}, i, 4)))) > 0)"
    )


def jaccard(a: str, b: str) -> str:
    return (
        f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_distinct(list_intersect({a}, {b})))::DOUBLE / "
        f"len(list_distinct(list_concat({a}, {b}))) END)"
    )
