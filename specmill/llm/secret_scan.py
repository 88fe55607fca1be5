"""Secret scans with multipart credential linking.

Parts of a credential are matched per kind: base secrets (assign, hex), access identifiers (access), and weak candidates
(ident: names of users and accounts; weak: long mixed tokens; endpoint: addresses). Matches become intervals of code points,
and an interval join links the parts within a scope: for every part the nearest end before and the nearest start after it
are found for each complementary kind in one ordered pass per row (a sweep, linear in the parts; no pairs are formed).
Base matches are always reported; weak candidates only with their complement in scope: ident with a secret, weak with an
identifier or endpoint, endpoint with both.

Only DataFrame functions. Positions come from ``split`` and ``regexp_extract_all`` with one pattern: the pieces between
the matches and the matches give all lengths. Defined results: null and empty texts have no spans; repeated rows get equal
results; an empty table gives an empty result; further columns are carried along, one named like the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from specmill.llm import shared

#: kind, pattern, group whose length counts, least length. The order decides among equal starts.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # shorter runs fail as a whole, so the bound may stand in the pattern
]
WEAK = [
    ("ident", r"""(?i:(login|username|user_?id|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 4),
    ("weak", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
    ("endpoint", r"https?://[A-Za-z0-9.:-]+", 0, 11),
]
#: Code points between the parts of one credential.
SCOPE = 300
SECRETS, NAMES = ("assign", "hex", "weak"), ("access", "ident")


def _pieces(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of structs (kind, i, gap, length, good): what stands before each match, and the match."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    mixed = lambda m: (F.lit(True) if kind != "weak" else m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"))
    one = lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["gap"].alias("gap"), F.char_length(z["m"]).alias("length"),
                                ((F.char_length(z["c"]) >= least) & mixed(z["m"])).alias("good"))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("m"), counted.alias("c"))
    return F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), one)


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate of every row: _k, kind, order, start, end (code points, end exclusive)."""
    kinds = [*BASE, *WEAK]
    t = F.coalesce(F.col(text), F.lit(""))
    strong = "|".join(f"(?:{p})" for _, p, _, _ in [*BASE, WEAK[0], WEAK[2]])
    rows = docs.select(shared.row_key(doc_id, text).alias("_k"), t.alias("_t")).where(F.col("_t").rlike(strong))  # weak tokens alone link to nothing
    every = F.concat(*[_pieces(F.col("_t"), *k) for k in kinds])
    rows = rows.select("_k", F.explode(every).alias("p")).select("_k", "p.*").distinct()
    before = W.partitionBy("_k", "kind").orderBy("i")
    start = F.sum("gap").over(before) + F.sum("length").over(before) - F.col("length")
    order = F.array_position(F.array(*[F.lit(k) for k, *_ in kinds]), F.col("kind"))
    rows = rows.withColumn("start", start).where("good")
    return rows.select("_k", "kind", order.alias("order"), "start", (F.col("start") + F.col("length")).alias("end"))


def _weak_outside(found: DataFrame) -> DataFrame:
    """Weak tokens that overlap a match of another kind are the same thing seen twice and go."""
    base = F.col("kind") != "weak"
    back = W.partitionBy("_k").orderBy("start", "order").rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy("_k").orderBy("start", "order").rowsBetween(W.currentRow, W.unboundedFollowing)
    end, start = F.max(F.when(base, F.col("end"))).over(back), F.min(F.when(base, F.col("start"))).over(ahead)
    free = F.coalesce(end <= F.col("start"), F.lit(True)) & F.coalesce(start >= F.col("end"), F.lit(True))
    return found.withColumn("_free", base | free).where("_free").drop("_free")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The interval join: base matches, and weak candidates whose complement lies within ``scope``."""
    found = _weak_outside(found)
    back = W.partitionBy("_k").orderBy("start", "order", "end").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("_k").orderBy("start", "order", "end").rowsBetween(1, W.unboundedFollowing)

    def near(kinds) -> Column:
        own = F.col("kind").isin(*kinds)
        gap_back = F.col("start") - F.max(F.when(own, F.col("end"))).over(back)
        gap_ahead = F.min(F.when(own, F.col("start"))).over(ahead) - F.col("end")
        return F.coalesce(gap_back <= scope, F.lit(False)) | F.coalesce(gap_ahead <= scope, F.lit(False))

    secret, name, place = near(SECRETS), near(NAMES), near(("endpoint",))
    keep = (F.when(F.col("kind") == "ident", secret).when(F.col("kind") == "weak", name | place)
            .when(F.col("kind") == "endpoint", secret & name).otherwise(F.lit(True)))
    return found.withColumn("_keep", keep).where("_keep").drop("_keep")


@shared.apart("doc_id", "text")
def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE, out: str = "secrets") -> DataFrame:
    """``docs`` with an array ``out`` of structs (start, order, kind, end), sorted; the spans of one row meet in that row."""
    docs = docs.drop(out)
    spans = linked(parts(docs, doc_id, text), scope)
    spans = spans.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("start", "order", "kind", "end"))).alias(out))
    joined = docs.withColumn("_k", shared.row_key(doc_id, text)).join(spans, "_k", "left")
    none = F.array().cast("array<struct<start:bigint,order:bigint,kind:string,end:bigint>>")
    return joined.select(*docs.columns, F.coalesce(F.col(out), none).alias(out))


def redacted(text: Column, spans: Column, kinds=("assign", "access", "hex", "weak")) -> Column:
    """The text with every span of these kinds replaced by its kind in brackets; overlapping spans become one."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    first = F.struct(F.array().cast("array<struct<a:bigint,n:bigint,k:string>>").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(a, s):
        from_ = F.greatest(a["at"], s["start"])
        piece = F.struct(a["at"].alias("a"), (from_ - a["at"]).alias("n"), s["kind"].alias("k"))
        return F.struct(F.when(s["end"] > a["at"], F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    put = lambda p: F.concat(F.substring(text, (p["a"] + 1).cast("int"), p["n"].cast("int")), F.lit("["), p["k"], F.lit("]"))
    body = lambda a: F.concat(F.concat_ws("", F.transform(a["out"], put)), F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(wanted) == 0, text).otherwise(F.aggregate(wanted, first, step, body))


def query(spark, sf_dir: str) -> DataFrame:
    d = annotate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["order"] <= len(BASE))
    return d.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
                    F.array_join(F.transform("secrets", told), ",").alias("spans"))


def _sql() -> str:
    def one(i, kind, pattern, group, least):
        p = pattern.replace("'", "''")
        mixed = " AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')" if kind == "weak" else ""
        return f"""SELECT doc_id, '{kind}' AS kind, {i} AS ord, st AS "start", st + length(m) AS "end" FROM (
          SELECT doc_id, m, c, (sum(length(g)) OVER w + sum(length(m)) OVER w - length(m))::BIGINT AS st FROM (
            SELECT doc_id, i, g[i] AS g, m[i] AS m, c[i] AS c FROM (
              SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS c FROM d WHERE regexp_matches(t, '{p}')),
              unnest(range(1, len(m) + 1)) AS u(i)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(c) >= {least}{mixed}"""
    kinds = "\nUNION ALL\n".join(one(i, *k) for i, k in enumerate([*BASE, *WEAK], 1))
    near = lambda ks: f"""(coalesce("start" - max("end") FILTER (kind IN {ks}) OVER b <= {SCOPE}, false) OR coalesce(min("start") FILTER (kind IN {ks}) OVER a - "end" <= {SCOPE}, false))"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS MATERIALIZED ({kinds}),
free AS (SELECT * FROM (SELECT *, kind <> 'weak' OR (
    coalesce(max("end") FILTER (kind <> 'weak') OVER (PARTITION BY doc_id ORDER BY "start", ord ROWS UNBOUNDED PRECEDING) <= "start", true)
    AND coalesce(min("start") FILTER (kind <> 'weak') OVER (PARTITION BY doc_id ORDER BY "start", ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= "end", true)) AS free
  FROM parts) WHERE free),
near AS (SELECT *, {near(SECRETS)} AS secret, {near(NAMES)} AS name, {near("('endpoint')")} AS place FROM free
  WINDOW b AS (PARTITION BY doc_id ORDER BY "start", ord, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY doc_id ORDER BY "start", ord, "end" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
kept AS (SELECT *, kind || ':' || "start" || ':' || "end" AS told FROM near
  WHERE CASE kind WHEN 'ident' THEN secret WHEN 'weak' THEN name OR place WHEN 'endpoint' THEN secret AND name ELSE true END),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(told, ',' ORDER BY "start", ord) FILTER (ord <= {len(BASE)}) AS base, string_agg(told, ',' ORDER BY "start", ord) AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
