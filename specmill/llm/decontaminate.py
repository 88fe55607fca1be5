"""Benchmark decontamination by winnowing.

Every span of 13 words has 6 hashes of 8-word grams; winnowing keeps the smallest of each 6 in a row, so a span that a
document and an item share leaves the same fingerprint, at the same place in it, on both sides. Fingerprints meet by
equi-join; each hit is extended by up to 5 words to either side and counts if the common run has 13 words. Items of fewer
words are one window: their grams are as long as they are, and every place of the document counts.

Only DataFrame functions. Defined results: null and empty texts have no words, are never contaminated and hit nothing;
items without words are no windows; repeated rows get equal results; items of equal id count once; an empty item table
leaves every document clean; further columns are carried along, one that is named like the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specmill.llm import shared

#: Words of a window, of a gram, and hashes a fingerprint is chosen from: GRAM + CHOICE - 1 == WINDOW.
WINDOW, GRAM = 13, 8
CHOICE = WINDOW - GRAM + 1


def _hashes(words: Column, gram: int) -> Column:
    """A hash per gram: words are hashed once, and runs of 1, 2, 4 and 8 words are joined by doubling."""
    n = F.size(words)

    def joined(x: Column, y: Column, by: int) -> Column:
        return F.zip_with(x, F.slice(y, by + 1, F.greatest(F.size(y) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def runs(x: Column, length: int, left: int, made: int, out: Column | None) -> Column:
        """``x``: hashes of runs of ``length`` words; ``left``: words still to come; ``out``: hashes of the first ``made`` words."""
        if left & length:
            out, made, left = (x if out is None else joined(out, x, made)), made + length, left - length
        if not left:
            return out
        return shared.let(joined(x, x, length), lambda y: runs(y, length * 2, left, made, out))

    some = shared.let(F.transform(words, lambda w: F.xxhash64(F.lit(gram), w)), lambda x: runs(x, 1, gram, 0, None))
    return F.when(n >= gram, F.slice(some, F.lit(1), n - gram + 1)).otherwise(shared.empty_array("bigint"))


def _shifted_least(h: Column, by: int) -> Column:
    return F.zip_with(h, F.slice(h, by + 1, F.greatest(F.size(h) - by, F.lit(0))), lambda x, y: F.least(x, y))


def _chosen(h: Column, choice: int) -> Column:
    """Structs (fp, pos): of each ``choice`` hashes in a row the smallest, the first of equal ones; each place once."""
    if choice == 1:
        return F.transform(h, lambda x, i: F.struct(x.alias("fp"), i.alias("pos")))

    def low(h: Column) -> Column:
        span, m = 1, h
        while span * 2 <= choice:
            m, span = _shifted_least(m, span), span * 2
        return _shifted_least(m, choice - span) if span < choice else m

    def pick(m: Column) -> Column:
        windows = F.size(h) - choice
        new = lambda j: (j == 0) | (m[j] != m[j - 1]) | (h[j - 1] == m[j])  # noqa: E731  another value, or the old place has gone
        place = lambda j: (j + F.array_position(F.slice(h, j + 1, choice), m[j]) - 1).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), windows), new), lambda j: F.struct(m[j].alias("fp"), place(j).alias("pos")))

    some = shared.let(low(h), pick)
    return F.when(F.size(h) >= choice, some).otherwise(F.array().cast("array<struct<fp:bigint,pos:int>>"))


def fingerprints(words: Column, gram: int, choice: int) -> Column:
    """Array of structs (fp, pos, gram) of a word array."""
    picked = shared.let(_hashes(words, gram), lambda h: _chosen(h, choice))
    return F.transform(picked, lambda p: F.struct(p["fp"].alias("fp"), p["pos"].alias("pos"), F.lit(gram).alias("gram")))


def _around(words: Column, pos: Column, gram: Column, reach: int) -> tuple[Column, Column, Column]:
    """Up to ``reach`` words before a gram (nearest first), the gram, up to ``reach`` words after it."""
    first = F.greatest(pos - reach, F.lit(0))
    return F.reverse(F.slice(words, first + 1, pos - first)), F.slice(words, pos + 1, gram), F.slice(words, pos + gram + 1, reach)


def _common(x: Column, y: Column) -> Column:
    """How many leading words two arrays share."""
    same = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return shared.let(F.array_position(same, False), lambda p: F.when(p == 0, F.size(x)).otherwise((p - 1).cast("int")))


def _passages(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, list[int]]:
    """One row per fingerprint and surrounding passage of the items, with the ids of all items that have it; lengths of short items."""
    own = items.select(F.col(item_id).alias("item"), shared.words(F.col(text)).alias("w")).where("size(w) > 0").dropDuplicates()
    shorts = [r[0] for r in own.where(F.size("w") < WINDOW).select(F.size("w").alias("n")).distinct().collect()]  # 12 rows at most
    fps = F.when(F.size("w") >= WINDOW, fingerprints(F.col("w"), GRAM, CHOICE))
    for n in sorted(shorts):
        fps = fps.when(F.size("w") == n, fingerprints(F.col("w"), n, 1))
    rows = own.select("item", "w", F.explode(fps).alias("f")).select("item", "w", "f.*")
    left, mid, right = _around(F.col("w"), F.col("pos"), F.col("gram"), WINDOW - GRAM)
    full = F.col("gram") == GRAM if GRAM not in shorts else (F.col("gram") == GRAM) & (F.size("w") >= WINDOW)
    none = shared.empty_array("string")
    rows = rows.select("item", "fp", "gram", F.when(full, left).otherwise(none).alias("left"), mid.alias("mid"),
                       F.when(full, right).otherwise(none).alias("right"), F.least(F.size("w"), F.lit(WINDOW)).alias("need"))
    out = rows.groupBy("fp", "gram", "left", "mid", "right", "need").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return out, sorted(shorts)


@shared.apart("doc_id", "text")
def annotate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "decon") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, items (ids as sorted strings), runs (start, end of common runs, by words).

    The items' fingerprints are few against the documents'; whether their side is broadcast is left to Spark's size check.
    Documents shuffle once, as text; the hits of one document meet in its row, bounded by its own length.
    """
    docs = docs.drop(out)
    passages, shorts = _passages(items, item_id, item_text)
    w = shared.words(F.col(text))
    keyed = docs.select(shared.row_key(doc_id, text).alias("_k"), w.alias("w"))
    sets = [fingerprints(F.col("w"), GRAM, CHOICE), *[fingerprints(F.col("w"), n, 1) for n in shorts]]
    # a plain explode makes Spark infer a filter on the array's size, which computes all fingerprints twice
    found = keyed.select("_k", F.explode_outer(F.concat(*sets) if shorts else sets[0]).alias("f")).where("f.fp is not null").select("_k", "f.*")
    hits = found.join(passages, ["fp", "gram"]).select("_k", F.struct("pos", "gram", "left", "mid", "right", "need", "items").alias("h"))
    hits = hits.groupBy("_k").agg(F.collect_set("h").alias("_hits"))

    def extended(w: Column):
        def one(h: Column) -> Column:
            left, mid, right = _around(w, h["pos"], h["gram"], WINDOW - GRAM)
            before, after = _common(left, h["left"]), _common(right, h["right"])
            start, end = h["pos"] - before, h["pos"] + h["gram"] + after
            good = (mid == h["mid"]) & (end - start >= h["need"])
            return F.struct(start.alias("start"), end.alias("end"), good.alias("good"), h["items"].alias("items"))
        return F.struct(F.size(w).alias("n"), F.filter(F.transform(F.col("_hits"), one), lambda x: x["good"]).alias("found"))

    joined = docs.withColumn("_k", shared.row_key(doc_id, text)).join(hits, "_k", "left")
    joined = joined.withColumn("_x", shared.let(w, extended))
    runs = F.array_distinct(F.transform(F.col("_x.found"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    joined = joined.withColumn("_runs", F.coalesce(F.array_sort(runs), F.array().cast("array<struct<start:int,end:int>>")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(r["end"] - F.greatest(r["start"], a["reach"]), F.lit(0))).alias("n"), F.greatest(a["reach"], r["end"]).alias("reach"))
    hit = F.aggregate("_runs", start, step, lambda a: a["n"])
    ids = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(F.col("_x.found"), lambda x: x["items"])))), shared.empty_array("string"))
    return joined.select(*docs.columns, F.struct(F.col("_x.n").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), ids.alias("items"), F.col("_runs").alias("runs")).alias(out))


def contaminated(decon: str = "decon") -> Column:
    """At least a twentieth of the words are hit."""
    return (F.col(f"{decon}.n_hit") > 0) & (20 * F.col(f"{decon}.n_hit") >= F.col(f"{decon}.n_words"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    d = annotate(docs.select("doc_id", "text"), items)
    return d.select("doc_id", "decon.n_words", "decon.n_hit", F.size("decon.items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "decon.items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS MATERIALIZED (
  SELECT item_id, w, least(len(w), 13) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM b, unnest(range(1, len(w) - k + 2)) AS t(i)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
hit AS MATERIALIZED (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n_hit AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hit, unnest(range(0, k)) AS t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(its.l, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
