"""Standardisation jobs: records in, corrected records out. ``corrections`` lists what changed."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill import refdata as R
from specmill.functions import distance as D
from specmill.functions import exprs as E


def corrections(before: DataFrame, after: DataFrame, fields: list[str], rule: str, key: str = "record_id") -> DataFrame:
    """(record_id, field, rule, old, new) for every field value a job changed."""
    cols = [F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").alias("old"), F.col(f"a.{f}").alias("new")) for f in fields]
    joined = before.select(key, *fields).alias("b").join(after.select(key, *fields).alias("a"), key)
    return (
        joined.select(key, F.explode(F.array(*cols)).alias("c"))
        .where(~F.col("c.old").eqNullSafe(F.col("c.new")))
        .select(key, F.col("c.field"), F.lit(rule).alias("rule"), F.col("c.old"), F.col("c.new"))
    )


def job_corrections(job: Callable[[DataFrame], DataFrame], records: DataFrame, fields: list[str], rule: str) -> DataFrame:
    """The same for a job that keeps its input columns: old values travel in the row, so nothing is joined."""
    after = job(records.withColumns({f"_old_{f}": F.col(f) for f in fields}))
    cols = [F.struct(F.lit(f).alias("field"), F.col(f"_old_{f}").alias("old"), F.col(f).alias("new")) for f in fields]
    return (
        after.select("record_id", F.explode(F.filter(F.array(*cols), lambda c: ~c["old"].eqNullSafe(c["new"]))).alias("c"))
        .select("record_id", "c.field", F.lit(rule).alias("rule"), "c.old", "c.new")
    )


# ------------------------------------------------------------------ N1
def narrow_candidate(name: Column) -> Column:
    """Conservative part number in a file name: white-listed prefix first, else the longest of six or more."""
    s = F.upper(E.stem(E.file_name(name)))
    for prefix in R.NARROW_DECORATIONS:
        s = F.when(s.startswith(prefix), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)
    found = F.flatten(F.transform(F.split(s, r"[-_()\s]+"), lambda seg: F.regexp_extract_all(seg, F.lit(R.PN_NARROW), 1)))
    banned = "|".join(R.PN_BLACKLIST)
    found = F.filter(found, lambda c: F.length(c).between(5, 15) & ~c.rlike(banned))

    def choose(all_: Column) -> Column:
        listed = E.first_of(F.filter(all_, lambda c: c.rlike("^(" + "|".join(R.PN_PREFIXES) + ")")))
        longest = F.aggregate(all_, F.lit(""), lambda best, c: F.when(F.length(c) > F.length(best), c).otherwise(best))
        return F.coalesce(listed, E.let(longest, lambda x: F.when(F.length(x) >= 6, x)), F.lit(""))

    return E.let(found, choose)


def file_stem_without_decorations(name: Column) -> Column:
    s = F.upper(E.stem(E.file_name(name)))
    cut = F.when(F.lit(False), s)
    for prefix in R.GENERIC_DECORATIONS:
        cut = cut.when(s.startswith(prefix), F.substr(s, F.lit(len(prefix) + 1)))
    s = cut.otherwise(s)
    s = F.regexp_replace(s, r"-?\(\d{4,}\)$", "")
    s = F.regexp_replace(s, r"_(DRILL|PART|SHEET|PAS|\d{2})$", "")
    s = F.regexp_replace(s, r"#[^#]+#[^#]+#[^#]+_?\d*$", "")
    return F.btrim(s, F.lit("-_ ."))


def _generic_match(s: Column) -> Column:
    hits = []
    for p in R.PN_GENERIC:
        hits.append(E.let(F.regexp_extract(s, p, 1), lambda c: F.when(F.length(c).between(5, 30), c)))
    return F.coalesce(*hits)


def identifier_candidates(manifest: DataFrame, name: str = "source_filename") -> DataFrame:
    """Adds ``narrow`` and ``generic`` part-number candidates taken from the file name."""
    core = F.btrim(F.regexp_extract("_stem", R.PN_CORE, 1), F.lit("-_ ."))
    return (
        manifest.withColumn("_stem", file_stem_without_decorations(F.col(name)))
        .withColumn("_cut", F.btrim(F.regexp_replace("_stem", R.PN_TAIL, ""), F.lit("-_ .")))
        .withColumn("narrow", narrow_candidate(F.col(name)))
        .withColumn(
            "generic",
            F.coalesce(
                F.btrim(_generic_match(F.col("_stem")), F.lit("-_ .")),
                F.when(F.length(core).between(5, 30), core),
                F.when((F.col("_cut") != "") & (F.col("_cut") != F.col("_stem")), _generic_match(F.col("_cut"))),
                F.lit(""),
            ),
        )
        .drop("_stem", "_cut")
    )


# ------------------------------------------------------------------ N2
def suspicious_identifier(c: Column) -> Column:
    """Identifier that is really a list cell, a header, a description or a fragment."""
    p = E.key(c)
    bare = F.regexp_replace(p, "[ -]", "")
    return (p != "") & (
        p.rlike(R.PN_ITEM_CELL) | p.isin(R.PN_HEADER_WORDS) | p.contains(" ") | (F.length(bare) < 5)
        | (bare.rlike(r"^\d+$") & (F.length(bare) < 7))
    )


def _body_digits(c: Column) -> Column:
    return F.length(F.regexp_extract(c, r"^\p{L}{2}(\d*)", 1))


def reconcile_identifiers(records: DataFrame) -> DataFrame:
    """Repair ``part_number`` / ``drawing_number`` from each other and from the file-name candidates.

    Expects the ``narrow`` and ``generic`` columns of ``identifier_candidates``;
    adds ``pn_rule``, the last rule that changed the part number.
    """
    up = F.upper
    pn, dn, nar, gen = (F.col(x) for x in ("_pn", "_dn", "narrow", "generic"))
    df = records.withColumns({"_pn": E.strip_id(F.col("part_number")), "_dn": E.strip_id(F.col("drawing_number"))})
    df = df.withColumn("_pn0", pn).withColumn("_dn0", dn).withColumn("pn_rule", F.lit(""))

    # 1 distance to the file-name candidates; an exact candidate ends the search
    df = df.withColumn("_d1", F.when((pn != "") & (nar != ""), D.identifier_distance(up(pn), up(nar))))
    df = df.withColumn(
        "_d2",
        F.when((pn != "") & (gen != "") & (gen != nar) & ~F.coalesce(F.col("_d1") <= 2, F.lit(False)),
               D.identifier_distance(up(pn), up(gen))),
    )
    df = df.withColumn("_fix", F.when(F.col("_d1").between(1, 2), nar).when(F.col("_d2").between(1, 2), gen))
    fixed = F.col("_fix").isNotNull()
    df = df.withColumns({
        "_dn": F.when(fixed & (dn == pn), F.col("_fix")).otherwise(dn),
        "_pn": F.coalesce("_fix", "_pn"),
        "pn_rule": F.when(fixed, "distance").otherwise(F.col("pn_rule")),
    })

    # 2 one is the other plus a last letter
    both = (F.col("_pn0") != "") & (dn != "") & (pn != dn)
    dn_longer = both & up(dn).rlike(r"\p{L}$") & (F.substr(up(dn), F.lit(1), F.length(dn) - 1) == up(pn))
    pn_longer = both & up(pn).rlike(r"\p{L}$") & (F.substr(up(pn), F.lit(1), F.length(pn) - 1) == up(dn))
    df = df.withColumns({
        "_pn": F.when(dn_longer, dn).otherwise(pn),
        "_dn": F.when(~dn_longer & pn_longer, pn).otherwise(dn),
        "pn_rule": F.when(dn_longer, "trailing_letter").otherwise(F.col("pn_rule")),
    })

    # 3 a single misreading between the two: keep the form with more digits after two letters
    df = df.withColumn("_one", F.when(both, D.identifier_distance(up(pn), up(dn)) == 1).otherwise(F.lit(False)))
    take_dn = F.col("_one") & (_body_digits(dn) > _body_digits(pn))
    df = df.withColumn("_take_dn", take_dn).withColumns({
        "_pn": F.when(F.col("_take_dn"), dn).otherwise(pn),
        "_dn": F.when(F.col("_one") & ~F.col("_take_dn"), pn).otherwise(dn),
        "pn_rule": F.when(F.col("_take_dn"), "unify").otherwise(F.col("pn_rule")),
    })

    # 4 the file name holds a longer form of the same number
    differs = (F.col("_pn0") != "") & (pn != "") & (gen != "") & (up(gen) != up(pn))
    compact = lambda c: F.regexp_replace(up(c), r"[\-\s\.]", "")
    shorter = F.regexp_replace(up(pn), r"[-\s]?[A-Z0-9]$", "")
    complete = (
        differs & ~((compact(pn) != "") & compact(gen).contains(compact(pn)))
        & (F.length(shorter) >= 6) & up(gen).contains(shorter) & (F.length(gen) >= F.length(pn) + 2)
    )
    df = _follow(df.withColumn("_hit", complete), gen, "substring")

    # 5 the number is suspicious or unrelated to the file name
    df = df.withColumn("_sus", differs & suspicious_identifier(pn))
    dn_sus = suspicious_identifier(dn)
    one_digit = (
        (nar != "") & (up(nar) != up(pn)) & (F.length(nar) == F.length(pn))
        & F.coalesce(_single_digit_change(up(pn), up(nar)), F.lit(False))
    )
    df = df.withColumn("_digit", differs & ~F.col("_sus") & one_digit)
    rest = differs & ~F.col("_sus") & ~F.col("_digit")
    df = df.withColumn("_rest", rest)
    df = df.withColumn("_far", F.when(F.col("_rest"), D.identifier_distance(up(pn), up(gen))))
    df = df.withColumn("_shared", F.when(F.col("_rest"), E.share_sequence(pn, gen)))
    unrelated = (
        (F.length(gen) >= 5) & (E.digit_jaccard(pn, gen) < 0.15) & (E.char_jaccard(pn, gen) < 0.4)
        & ~F.col("_shared") & (F.col("_far") > 3)
    )
    structure = (
        (F.length(gen) >= 6) & (F.length(pn) >= 5) & F.ltrim(pn, F.lit("-_ ")).rlike(r"^\p{L}")
        & F.ltrim(gen, F.lit("-_ ")).rlike(r"^\d") & ~F.col("_shared")
    )
    bare = lambda c: F.regexp_replace(up(c), r"[\s\-\./_,]", "")
    present = F.size(F.filter(E.chars(bare(pn)), lambda c: bare(gen).contains(c)))
    truncated = (
        (F.length(pn) <= 8) & (F.length(gen) >= F.length(pn) + 2)
        & (present / F.greatest(F.length(bare(pn)), F.lit(1)) >= 0.75) & (F.col("_far") > 2) & ~F.col("_shared")
    )
    df = df.withColumn("_other", F.col("_rest") & (unrelated | structure | truncated))
    hit = F.coalesce(F.col("_sus") | F.col("_digit") | F.col("_other"), F.lit(False))
    new = F.when(F.col("_digit"), nar).otherwise(gen)
    df = _follow(df.withColumn("_hit", hit), new, "override", F.col("_sus") & dn_sus)

    # empty part number: drawing number, else the narrow candidate
    empty = F.col("_pn0") == ""
    df = df.withColumns({
        "_pn": F.when(empty, F.when(F.col("_dn0") != "", F.col("_dn0")).otherwise(nar)).otherwise(pn),
        "pn_rule": F.when(empty & ((F.col("_dn0") != "") | (nar != "")), "filled").otherwise(F.col("pn_rule")),
    })
    return df.withColumns({
        "part_number": F.when(pn == F.col("_pn0"), F.col("part_number")).otherwise(pn),
        "drawing_number": F.when(dn == F.col("_dn0"), F.col("drawing_number")).otherwise(dn),
    }).select(*records.columns, "pn_rule")


def _follow(df: DataFrame, new: Column, rule: str, also: Column | None = None) -> DataFrame:
    """Where ``_hit``: set the part number, and the drawing number if it equalled the old one."""
    same = F.upper(F.col("_dn")) == F.upper(F.col("_pn"))
    move = same if also is None else (same | also)
    return df.withColumn("_move", F.col("_hit") & move).withColumns({
        "_dn": F.when(F.col("_move"), new).otherwise(F.col("_dn")),
        "_pn": F.when(F.col("_hit"), new).otherwise(F.col("_pn")),
        "pn_rule": F.when(F.col("_hit"), rule).otherwise(F.col("pn_rule")),
    })


def _single_digit_change(a: Column, b: Column) -> Column:
    diffs = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    at = E.first_of(diffs)
    return (
        (F.size(diffs) == 1) & F.substr(a, at, F.lit(1)).rlike(r"^\d$") & F.substr(b, at, F.lit(1)).rlike(r"^\d$")
    )


# ------------------------------------------------------------------ N3, N4
def fill_drawing_number(records: DataFrame) -> DataFrame:
    """An empty drawing number takes the part number."""
    pn = E.strip(F.col("part_number"))
    return records.withColumn(
        "drawing_number",
        F.when((pn != "") & E.is_empty_marker(F.col("drawing_number")), pn).otherwise(F.col("drawing_number")),
    )


def reconcile_revisions(records: DataFrame) -> DataFrame:
    """Unmangle the revision, then fill it from the revision table, then from the file name."""
    rev = E.key(F.col("revision"))
    out = (
        F.when((rev == "") | (F.length(rev) > 6), F.col("revision"))
        .when(rev.rlike(r"^R[A-Z]$"), F.substr(rev, F.lit(2)))
        .when(rev.rlike(r"^REV\s+[A-Z0-9]+$"), F.regexp_extract(rev, r"^REV\s+([A-Z0-9]+)$", 1))
        .when(rev.rlike(r"^REV[\.\-_]\s*[A-Z0-9]+$"), F.regexp_extract(rev, r"^REV[\.\-_]\s*([A-Z0-9]+)$", 1))
        .otherwise(F.col("revision"))
    )
    last = E.strip(F.try_element_at(F.col("revisions_history"), F.lit(-1))["rev"])
    from_name = F.upper(F.regexp_extract(E.stem(E.file_name(F.col("source_filename"))), R.REV_IN_FILENAME, 1))
    return records.withColumn("revision", out).withColumn(
        "revision",
        F.when(~E.is_empty_marker(F.col("revision")), F.col("revision"))
        .when(~E.is_empty_marker(last), last)
        .when(from_name != "", from_name)
        .otherwise(F.col("revision")),
    )


# ------------------------------------------------------------------ N5
def clean_cage(c: Column) -> Column:
    k = E.key(c)
    return F.when(k.rlike("^[A-Z0-9]{3,6}$"), k).otherwise(F.lit(""))


def party_key(c: Column) -> Column:
    return E.squeeze(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[\.,_/\-]+", " "))


def canonical_names(names: DataFrame, alias: DataFrame) -> DataFrame:
    """(name, canonical) for distinct raw names: exact alias, else first alias of six or more starting the name.

    The prefix search is an equi-join: a name offers each of its word prefixes
    as a key, so the number of keys is the number of its words.
    """
    k = names.select("name", party_key(F.col("name")).alias("k"))
    exact = k.join(alias.select(F.col("alias").alias("k"), F.col("customer").alias("exact")), "k", "left")
    words = F.split("k", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.slice(words, F.lit(1), i)))
    by_prefix = (
        exact.where("exact IS NULL AND k LIKE '% %'")
        .select("name", F.explode(prefixes).alias("alias"))
        .where(F.length("alias") >= 6)
        .join(alias, "alias")
        .groupBy("name")
        .agg(F.min_by("customer", "ordinal").alias("by_prefix"))
    )
    return exact.join(by_prefix, "name", "left").select(
        "name", F.coalesce("exact", "by_prefix", E.strip(F.col("name"))).alias("canonical")
    )


def normalise_parties(records: DataFrame, cage: DataFrame, default_cage: DataFrame, alias: DataFrame) -> DataFrame:
    """CAGE cleaned, customer from CAGE, canonical customer name, CAGE from customer.

    The mapping is made per distinct (customer, CAGE), so blank and popular values meet the dimensions once each;
    records take their result in a single join, whose hot keys AQE splits.
    """
    pairs = records.select(F.col("customer").alias("_customer"), F.col("cage_code").alias("_cage")).distinct()
    df = pairs.withColumns({"customer": F.col("_customer"), "cage_code": clean_cage(F.col("_cage"))}).join(
        cage.select(F.col("cage").alias("cage_code"), F.col("customer").alias("_by_cage")), "cage_code", "left"
    )
    df = df.withColumn(
        "customer", F.when(E.strip(F.col("customer")) == "", F.coalesce("_by_cage", "customer")).otherwise(F.col("customer"))
    ).drop("_by_cage")
    names = canonical_names(df.select(F.col("customer").alias("name")).where("name <> ''").distinct(), alias)
    df = df.join(names.withColumnRenamed("name", "customer"), "customer", "left").withColumn(
        "customer", F.coalesce("canonical", "customer")
    ).drop("canonical")
    df = df.join(
        default_cage.select(F.col("customer"), F.col("cage").alias("_default")), "customer", "left"
    ).withColumn("cage_code", F.when(F.col("cage_code") == "", F.coalesce("_default", "cage_code")).otherwise(F.col("cage_code")))
    mapped = df.select("_customer", "_cage", F.col("customer").alias("_to_customer"), F.col("cage_code").alias("_to_cage"))
    same = records["customer"].eqNullSafe(mapped["_customer"]) & records["cage_code"].eqNullSafe(mapped["_cage"])
    done = {"customer": F.col("_to_customer").alias("customer"), "cage_code": F.col("_to_cage").alias("cage_code")}
    return records.join(mapped, same, "left").select(*[done.get(c, records[c]) for c in records.columns])


# ------------------------------------------------------------------ N6
# ship this module's functions with the task: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def collapse_repeats(text: str, min_repeat: int = 3) -> str:
    """Collapse a word sequence that occurs ``min_repeat`` or more times in a row, longest first, until stable."""
    if not text:
        return text or ""
    changed_once = False
    words = text.split()
    while True:
        codes = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.array([], dtype=int)
        n, changed = len(words), False
        for size in range(max(1, n // min_repeat), 0, -1):
            if n < size * min_repeat:
                continue
            same = codes[:-size] == codes[size:]
            # length of the run of equal pairs starting at each place
            breaks = np.flatnonzero(np.append(~same, True))
            runs = breaks[np.searchsorted(breaks, np.arange(len(same)))] - np.arange(len(same))
            starts = np.flatnonzero(runs >= size * (min_repeat - 1))
            if not len(starts):
                continue
            keep, at = np.ones(n, dtype=bool), 0
            for s in starts:
                if s < at:
                    continue
                end = s + (runs[s] // size + 1) * size
                keep[s + size:end] = False
                at = end
            words, changed = [w for w, k in zip(words, keep) if k], True
            break
        if not changed:
            return " ".join(words) if changed_once else text
        changed_once = True


@F.pandas_udf(T.ArrayType(T.StringType()))
def _collapse_all(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in parts:
        # descriptions recur: each text of a batch is collapsed once
        done = {t: collapse_repeats(t) for t in {t for a in batch if a is not None for t in a}}
        yield batch.map(lambda a: None if a is None else [done[t] for t in a])


def clean_bom_text(records: DataFrame) -> DataFrame:
    """Collapse repeated phrases in BOM descriptions; adds ``bom_fixed``, the number of items changed.

    Only arrays with a word occurring three times reach Python, everything else
    passes as null. Items keep their place, so no shuffle is needed.
    """
    raw = F.transform("bom_items", lambda b: F.coalesce(b["description"], F.lit("")))
    repeated = lambda t: (
        F.size(F.array_distinct(F.split(E.squeeze(t), " "))) <= F.size(F.split(E.squeeze(t), " ")) - 2
    )
    df = records.withColumn("_raw", raw)
    df = df.withColumn("_todo", F.when(F.exists("_raw", repeated), F.col("_raw")))
    df = df.withColumn("_done", _collapse_all(F.col("_todo")))
    df = df.withColumn("_clean", F.transform(F.coalesce("_done", "_raw"), E.squeeze))
    df = df.withColumn(
        "bom_fixed", F.size(F.filter(F.arrays_zip("_raw", "_clean"), lambda z: z["_raw"] != z["_clean"])).cast("bigint")
    )
    df = df.withColumn(
        "bom_items",
        F.transform(
            "bom_items",
            lambda b, i: b.withField(
                "description",
                F.when(F.get("_raw", i) != F.get("_clean", i), F.get("_clean", i)).otherwise(b["description"]),
            ),
        ),
    )
    return df.drop("_raw", "_todo", "_done", "_clean")


# ------------------------------------------------------------------ N7
# every pattern of PHRASE_FIXES needs one of these in the (upper-cased) text
_PHRASE_HINT = "SQ|SU|NQE|26074|PS|SM|RAFDOCS"


def may_need_phrase_fix(c: Column) -> Column:
    return F.coalesce(F.upper(c).rlike(_PHRASE_HINT), F.lit(False))


def fix_phrases(c: Column) -> Column:
    out = c
    for pattern, repl, _ in R.PHRASE_FIXES:
        out = F.regexp_replace(out, pattern, repl)
    return F.when(may_need_phrase_fix(c), out).otherwise(c)


def _fix_and_label(pattern: str, repl: str, label: str):
    """One step of the fold over (text, labels): the text is rewritten, and labelled if the pattern was found."""
    def step(s: Column) -> Column:
        n = F.regexp_count(s["text"], F.lit(pattern))
        found = F.concat(s["labels"], F.array(F.concat(F.lit(label + " ×"), n.cast("string"))))
        return F.struct(F.regexp_replace(s["text"], pattern, repl).alias("text"), F.when(n > 0, found).otherwise(s["labels"]).alias("labels"))
    return step


def phrase_labels(c: Column) -> Column:
    """``label ×n`` for every fix that applied to the string, in order; each fix is applied once. None for null."""
    state = F.struct(c.alias("text"), F.array().cast("array<string>").alias("labels"))
    for fix in R.PHRASE_FIXES:
        state = E.let(state, _fix_and_label(*fix))
    return state["labels"]


def _string_leaves(field: T.StructField) -> Column | None:
    """All strings of a column as one array."""
    c, t = F.col(f"`{field.name}`"), field.dataType
    if isinstance(t, T.StringType):
        return F.array(c)
    if isinstance(t, T.StructType):
        return F.array(*[c[f.name] for f in t if isinstance(f.dataType, T.StringType)])
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        return c
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        names = [f.name for f in t.elementType if isinstance(f.dataType, T.StringType)]
        return F.flatten(F.transform(c, lambda x: F.array(*[x[n] for n in names])))
    return None


def _rewrite(field: T.StructField) -> Column:
    c, t = F.col(f"`{field.name}`"), field.dataType
    as_struct = lambda x, st: F.struct(*[
        (fix_phrases(x[f.name]) if isinstance(f.dataType, T.StringType) else x[f.name]).alias(f.name) for f in st
    ])
    if isinstance(t, T.StringType):
        return fix_phrases(c)
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), as_struct(c, t))
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        return F.transform(c, fix_phrases)
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        return F.transform(c, lambda x: as_struct(x, t.elementType))
    return c


def normalise_phrases(records: DataFrame, skip: tuple[str, ...] = ("record_id", "batch_id", "fingerprint")) -> DataFrame:
    """Ordered phrase fixes on every string of the record (``_`` columns excepted); adds ``phrase_fixes``.

    A cheap test on every string decides which records are rewritten at all.
    """
    fields = [f for f in records.schema if not f.name.startswith("_") and f.name not in skip]
    leaves = [x for x in (_string_leaves(f) for f in fields) if x is not None]
    df = records.withColumn("_hits", F.filter(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in leaves]),
                                              may_need_phrase_fix))
    df = df.withColumn("phrase_fixes", F.array_distinct(F.flatten(F.transform("_hits", phrase_labels))))
    touched = F.size("_hits") > 0
    return df.withColumns({
        f.name: F.when(touched, _rewrite(f)).otherwise(F.col(f"`{f.name}`")) for f in fields
    }).drop("_hits")


# ------------------------------------------------------------------ N8, N9
def looks_like_material(c: Column) -> Column:
    return E.contains_any(F.upper(c), R.MATERIAL_WORDS)


def material_instruction_only(c: Column) -> Column:
    t = F.upper(E.strip(c))
    starts = F.lit(False)
    for p in R.MATERIAL_INSTRUCTIONS:
        starts = starts | t.startswith(p)
    return (t != "") & starts & ~looks_like_material(E.strip(c))


def labelled_material(text: Column) -> Column:
    """First material after a MATERIAL label: on the same line or on one of the next three non-empty lines."""
    lines = F.filter(F.transform(F.split(text, E.LINE_BREAK), E.strip), lambda x: x != "")
    noise = lambda u: E.contains_any(u, R.MATERIAL_NOISE)

    def candidate(c: Column) -> Column:
        u = F.upper(c)
        return (
            ~noise(u) & ~u.isin(R.MATERIAL_SKIP_LABELS) & (F.length(c) >= 4) & c.rlike(r"\p{L}") & looks_like_material(c)
        )

    def search(all_: Column) -> Column:
        def at_line(c: Column, i: Column) -> Column:
            u = F.upper(c)
            following = E.first_of(F.filter(F.slice(all_, i + 2, F.lit(3)), candidate))
            inline = E.let(
                E.strip(F.regexp_extract(c, R.MATERIAL_LINE, 1)),
                lambda x: F.when((x != "") & ~noise(F.upper(x)) & looks_like_material(x), x),
            )
            return (
                F.when(~u.rlike("MATERIAL|MATL|MAT'L"), None).when(noise(u), None)
                .when(u.isin(R.MATERIAL_LABELS), following).otherwise(inline)
            )

        return E.first_of(F.filter(F.transform(all_, at_line), lambda x: x.isNotNull()))

    return F.when(text.rlike(r"(?i)MATERIAL|MATL|MAT'L"), E.let(lines, search))


def direct_material(text: Column) -> Column:
    """First material phrase anywhere in the text, patterns tried in order."""
    hits = []
    for p in R.MATERIAL_DIRECT:
        hits.append(E.let(
            F.regexp_replace(E.strip(F.regexp_extract(text, p, 0)), r"\s+", " "),
            lambda c: F.when((F.length(c) > 6) & looks_like_material(c), c),
        ))
    return F.coalesce(*hits)


def material_from_text(texts: DataFrame) -> DataFrame:
    """(record_id, text_material): one pass over each whole text."""
    return texts.select("record_id", F.coalesce(labelled_material(F.col("text")), direct_material(F.col("text"))).alias("text_material"))


def resolve_material(records: DataFrame, texts: DataFrame) -> DataFrame:
    """Blank out instruction-only materials, then fill empty ones from the source text.

    The text is reduced to its material before the join, so texts are not shuffled.
    """
    df = records.withColumn(
        "material", F.when(material_instruction_only(F.col("material")), F.lit("")).otherwise(F.col("material"))
    )
    df = df.join(material_from_text(texts), "record_id", "left")
    return df.withColumn(
        "material", F.when(E.strip(F.col("material")) == "", F.coalesce("text_material", "material")).otherwise(F.col("material"))
    ).select(*records.columns)


def split_formerly(records: DataFrame) -> DataFrame:
    """Move ``(FORMERLY x)`` out of the material unless ``material_formerly`` is already filled."""
    mat = E.strip(F.col("material"))
    hit = (E.strip(F.col("material_formerly")) == "") & mat.rlike(R.FORMERLY)
    former = F.rtrim(E.strip(F.regexp_extract(mat, R.FORMERLY, 1)), F.lit(".,; "))
    main = F.rtrim(E.strip(F.regexp_replace(E.strip(F.regexp_replace(mat, R.FORMERLY, "")), r"\s{2,}", " ")), F.lit(".,;"))
    return records.withColumn("_m", F.when(hit, main).otherwise(F.col("material"))).withColumn(
        "material_formerly", F.when(hit, former).otherwise(F.col("material_formerly"))
    ).withColumn("material", F.col("_m")).drop("_m")


# ------------------------------------------------------------------ N10, N11, N12, N13
def infer_roles(records: DataFrame) -> DataFrame:
    """A BOM that lists only the record itself is emptied (role PART); empty roles follow from the BOM.

    Adds ``role_rule``: SELF_REF_BOM, ROLE_AUTODETECTED or empty.
    """
    pn = E.key(F.col("part_number"))
    items = F.filter(F.transform("bom_items", lambda b: E.key(b["part_number"])), lambda p: p != "")
    df = records.withColumn("_pn", pn).withColumn("_items", items)
    self_only = (F.col("_pn") != "") & (F.size("_items") > 0) & ~F.exists("_items", lambda p: p != F.col("_pn"))
    df = df.withColumn("_self", F.coalesce(self_only, F.lit(False)))
    no_role = E.strip(F.col("assembly_role")) == ""
    others = F.coalesce(F.exists("_items", lambda p: p != F.col("_pn")), F.lit(False))
    return df.withColumns({
        "role_rule": F.when(F.col("_self"), "SELF_REF_BOM").when(no_role, "ROLE_AUTODETECTED").otherwise(""),
        "bom_items": F.when(F.col("_self"), F.slice("bom_items", 1, 0)).otherwise(F.col("bom_items")),
        "assembly_role": F.when(F.col("_self"), "PART")
        .when(no_role, F.when(others, "ASSEMBLY").otherwise("PART"))
        .otherwise(F.col("assembly_role")),
    }).drop("_pn", "_items", "_self")


def conform_drawing_prefix(records: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The drawing number must start with a prefix of the customer.

    ``prefixes`` is (customer, ordinal, prefix). A customer without prefixes
    takes those of the customer whose prefix starts the part number, in
    dimension order. Records without customer or part number match no row by it
    and are spread. Adds ``prefix_finding`` and ``prefix_used``.
    """
    by_customer = prefixes.groupBy(F.upper("customer").alias("_cust")).agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "prefix"))).alias("_own"), F.min("ordinal").alias("_first")
    )
    df = records.withColumn("_cust", E.join_key(F.upper(E.strip(F.col("customer")))))
    df = df.join(by_customer.select("_cust", "_own"), "_cust", "left")
    # prefixes implied by the part number: every leading substring is an equi-join key
    pn = E.key(F.col("part_number"))
    implied = (
        df.where("_own IS NULL").select(pn.alias("_pn")).where("_pn <> ''").distinct()
        .select("_pn", F.explode(F.transform(F.sequence(F.lit(1), F.length("_pn")), lambda n: F.substr("_pn", F.lit(1), n))).alias("prefix"))
        .join(prefixes, "prefix")
        .select("_pn", F.upper("customer").alias("_cust"))
        .join(by_customer, "_cust")
        .groupBy("_pn").agg(F.min_by("_own", "_first").alias("_implied"))
    )
    df = df.withColumn("_pn", E.join_key(pn)).join(implied, "_pn", "left")
    dwg = E.strip(F.col("drawing_number"))
    up = F.upper(dwg)
    df = df.withColumn("_list", F.transform(F.coalesce("_own", "_implied"), lambda p: F.upper(p["prefix"])))
    df = df.withColumn(
        "_applies",
        (dwg != "") & F.col("_list").isNotNull() & ~F.coalesce(F.exists("_list", lambda p: up.startswith(p)), F.lit(False)),
    )
    hit = E.first_of(F.filter("_list", lambda p: up.endswith(p) | up.contains(p)))
    df = df.withColumn("prefix_used", F.when(F.col("_applies"), F.coalesce(hit, F.lit(""))).otherwise(""))
    moved = F.col("_applies") & (F.col("prefix_used") != "") & up.endswith(F.col("prefix_used"))
    df = df.withColumn("_moved", moved).withColumn(
        "prefix_finding",
        F.when(~F.col("_applies") | F.col("_applies").isNull(), "")
        .when(F.col("_moved"), "DWG_PREFIX_REORDERED")
        .when(F.col("prefix_used") != "", "DWG_PREFIX_MISMATCH")
        .otherwise("DWG_PREFIX_MISSING"),
    )
    return df.withColumn(
        "drawing_number",
        F.when(F.col("_moved"), F.concat(F.col("prefix_used"), F.substr(dwg, F.lit(1), F.length(dwg) - F.length("prefix_used"))))
        .otherwise(F.col("drawing_number")),
    ).select(*records.columns, "prefix_finding", "prefix_used")


_EMPTY_STRINGS = ["part_number", "drawing_number", "revision", "customer", "material", "quantity", "catalog_number",
                  "alternative_material", "os_level", "cage_code", "material_formerly", "title", "notes"]


def complete_overview_records(images: DataFrame) -> DataFrame:
    """Default the missing fields of overview-image records; the part number falls back to the file stem."""
    out = {c: F.coalesce(c, F.lit("")) for c in _EMPTY_STRINGS if c in images.columns}
    for f in images.schema:
        if isinstance(f.dataType, T.ArrayType) and not f.name.startswith("_"):
            out[f.name] = F.coalesce(f.name, F.array().cast(f.dataType))
    df = images.withColumns(out)
    return df.withColumns({
        "part_number": F.when(E.strip(F.col("part_number")) == "", E.stem(E.file_name(F.col("source_filename")))).otherwise(F.col("part_number")),
        "source_filename": E.file_name(F.col("source_filename")),
        "assembly_role": F.lit(R.OVERVIEW_ROLE),
        "_ocr_used": F.lit(False),
        "_is_overview_image": F.lit(True),
    })


def fix_relationship_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ordered identifier fixes on the given columns of the relationship table."""
    def fix(c: Column) -> Column:
        for pattern, repl in R.RELATION_FIXES:
            c = F.regexp_replace(c, pattern, repl)
        return c
    return df.withColumns({c: fix(F.col(c)) for c in columns})


# ------------------------------------------------------------------ N14
EDITABLE = ["part_number", "drawing_number", "revision", "customer", "material", "quantity"]


def apply_review_edits(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply human edits and approvals.

    ``edits`` is (record_id, ts, field, value): the last value of a field wins;
    ``field = '_approve'`` is an approval. Editable are the scalar fields,
    ``standards`` (comma separated) and ``packaging_notes.en`` / ``.he``. An
    edit that changes nothing is ignored; the first original value is kept; an
    edit later than the last approval makes the status ``edited`` again.
    """
    last = edits.groupBy("record_id", "field").agg(
        F.max_by("value", "ts").alias("value"), F.max("ts").alias("last_ts")
    )
    fields = [*EDITABLE, "standards", "packaging_notes.en", "packaging_notes.he"]
    wide = last.groupBy("record_id").agg(
        *[F.max(F.when(F.col("field") == f, E.strip(F.col("value")))).alias(f"_e_{f.replace('.', '_')}") for f in fields],
        F.max(F.when(F.col("field") == "_approve", F.col("last_ts"))).alias("_approved"),
        F.max(F.when(F.col("field") != "_approve", F.col("last_ts"))).alias("_edited"),
    )
    df = records.join(wide, "record_id", "left")
    old = {f: E.strip(F.col(f)) for f in EDITABLE}
    old["standards"] = F.concat_ws(", ", F.transform("standards", E.strip))
    old["packaging_notes.en"] = E.strip(F.col("packaging_notes.en"))
    old["packaging_notes.he"] = E.strip(F.col("packaging_notes.he"))
    std_new = F.filter(F.transform(F.split("_e_standards", ","), E.strip), lambda s: s != "")
    new = {f: F.col(f"_e_{f.replace('.', '_')}") for f in fields}
    new["standards"] = F.concat_ws(", ", std_new)
    changed = {f: F.col(f"_e_{f.replace('.', '_')}").isNotNull() & (new[f] != old[f]) for f in fields}
    df = df.withColumn("_chg", F.struct(*[changed[f].alias(f.replace(".", "_")) for f in fields]))
    df = df.withColumn(
        "_user_edits",
        F.map_from_entries(F.filter(F.array(*[
            F.when(F.col("_chg")[f.replace(".", "_")], F.struct(F.lit(f), old[f])) for f in fields
        ]), lambda x: x.isNotNull())),
    )
    any_edit = F.size("_user_edits") > 0
    df = df.withColumn("_any", any_edit)
    df = df.withColumns({
        **{f: F.when(F.col("_chg")[f], new[f]).otherwise(F.col(f)) for f in EDITABLE},
        "standards": F.when(F.col("_chg.standards"), std_new).otherwise(F.col("standards")),
        "packaging_notes": F.col("packaging_notes")
        .withField("en", F.when(F.col("_chg.packaging_notes_en"), new["packaging_notes.en"]).otherwise(F.col("packaging_notes.en")))
        .withField("he", F.when(F.col("_chg.packaging_notes_he"), new["packaging_notes.he"]).otherwise(F.col("packaging_notes.he"))),
        "_review_status": F.when(F.col("_approved").isNotNull() & (~F.col("_any") | (F.col("_approved") >= F.col("_edited"))), "reviewed")
        .when(F.col("_any"), "edited").otherwise(F.coalesce("_review_status", F.lit("pending"))),
    })
    df = df.withColumn("_review_timestamp", F.when((F.col("_review_status") == "reviewed"), F.col("_approved").cast("string")))
    return df.select(*[c for c in records.columns if c not in ("_user_edits", "_review_timestamp")], "_user_edits", "_review_timestamp")
