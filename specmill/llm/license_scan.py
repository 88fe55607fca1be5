"""License scans by a positional index of rare words.

Templates (licence phrases with the places of their mandatory key words) give postings word -> (template, place). The
highest-IDF key words of each template, by document frequency over the whole corpus, are its anchors. A text that holds the
key holds all its words, so these are also the rarest of that template's key words in the file: no label hangs on words
outside the key. Their occurrences in a document are looked up, turned into starts by their places, and a start on which
all anchors agree is a candidate. The key words of a candidate are then verified, one equi-join on (row, place, word); the
share of IDF mass found, over all words of the template, is its score.

Only DataFrame functions. Defined results: null and empty texts have no words, no labels and score 0; repeated rows get
equal results; an empty table gives an empty result; further columns are carried along, one named like the result is
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from specmill.llm import shared

#: label, phrase, how many of its first words are the mandatory key; base phrases are mandatory as a whole.
BASE = [("cc-by", "cc by", 2), ("gpl", "general public license", 3), ("reserved", "all rights reserved", 3)]
MORE = [
    ("agpl", "affero general public license", 4),
    ("lgpl", "lesser general public license", 4),
    ("gnu-gpl-3", "gnu general public license version 3", 4),
    ("apache-2.0", "apache license version 2 0", 2),
    ("mit", "mit license", 2),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", 4),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    ("mpl", "mozilla public license", 3),
    ("cc-by-nc", "cc by nc", 3),
    ("cc-by-sa", "cc by sa", 3),
    ("cc0", "cc0 1 0 universal", 1),
    ("copyright", "copyright notice", 2),
]
#: Anchors of a template, chosen among its key words.
ANCHORS = 2


def templates(spark: SparkSession, base=BASE, more=MORE) -> DataFrame:
    """One row per word of a template: template, label, base, rel, word, key, n_words. Its size is that of the parameters."""
    rows = []
    for i, (label, phrase, key) in enumerate([*base, *more]):
        ws = phrase.split()
        rows += [(i, label, i < len(base), rel, w, rel < key, len(ws)) for rel, w in enumerate(ws)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, rel int, word string, key boolean, n_words int")


@shared.apart("doc_id", "text")
def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base=BASE, more=MORE, out: str = "licences") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Texts are never shuffled with the words: only words of the templates leave a row, keyed by the row; their counts are
    aggregated before they shuffle. What is broadcast (postings, weights) has the size of the template list.
    """
    spark = docs.sparkSession
    docs = docs.drop(out)
    folder = shared.shared_folder(spark)
    post = templates(spark, base, more)
    listed = sorted({w for _, p, _ in [*base, *more] for w in p.split()})
    w = shared.words(F.col(text))
    places = docs.select(shared.row_key(doc_id, text).alias("_k"), F.posexplode(w).alias("pos", "word")).where(F.col("word").isin(listed))
    seen = shared.written(places, folder, "places").distinct()
    df = seen.select("_k", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(docs.count() + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + F.lit(1e-6)
    weights = post.join(df, "word", "left").withColumn("idf", idf).drop("df")
    weights = shared.written(weights.coalesce(1), folder, "weights")
    rank = W.partitionBy("template").orderBy(F.desc("idf"), "rel")
    anchors = weights.where("key").withColumn("r", F.row_number().over(rank)).withColumn("wanted", F.count("*").over(W.partitionBy("template")))
    anchors = anchors.where(F.col("r") <= ANCHORS).select("template", "rel", "word", F.least(F.col("wanted"), F.lit(ANCHORS)).alias("wanted"))
    starts = seen.join(F.broadcast(anchors), "word").select("_k", "template", (F.col("pos") - F.col("rel")).alias("start"), "rel", "wanted")
    starts = starts.groupBy("_k", "template", "start", "wanted").agg(F.count("*").alias("votes")).where("votes = wanted and start >= 0").drop("votes", "wanted")
    full = starts.join(F.broadcast(weights), "template").withColumn("pos", F.col("start") + F.col("rel"))
    full = full.join(seen.withColumn("there", F.lit(True)), ["_k", "pos", "word"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    found = full.groupBy("_k", "template", "label", "base", "start").agg(
        F.min(F.col("there") | ~F.col("key")).alias("good"), (F.sum(F.when(F.col("there"), F.col("idf")).otherwise(0.0)) / F.sum("idf")).alias("share"))
    found = found.where("good").groupBy("_k").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"), F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"), F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "label"))).alias("places"))
    keyed = docs.withColumn("_k", shared.row_key(doc_id, text)).withColumn("_n", F.size(w).cast("long"))
    joined = keyed.join(found, "_k", "left")
    return joined.select(*docs.columns, F.struct(
        F.col("_n").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", shared.empty_array("string")).alias("base_labels"), F.coalesce("labels", shared.empty_array("string")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.col("places")).alias(out))


def query(spark, sf_dir: str) -> DataFrame:
    d = annotate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    listed = lambda c: F.concat_ws(",", f"licences.{c}").alias(c)
    return d.select("doc_id", "licences.n_words", "licences.n_base", "licences.first_word", "licences.last_word", listed("base_labels"), listed("labels"),
                    F.round("licences.score", 9).alias("score"))


def _sql() -> str:
    more = ", ".join(f"({i}, '{label}', false, {key}, string_split('{p}', ' '))" for i, (label, p, key) in enumerate(MORE, 3))
    return rf"""
WITH t(template, label, base, key, p) AS (VALUES (0, 'cc-by', true, 2, ['cc', 'by']), (1, 'gpl', true, 3, ['general', 'public', 'license']),
  (2, 'reserved', true, 3, ['all', 'rights', 'reserved']), {more}),
d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
tw AS (SELECT template, label, base, key, len(p) AS n, rel - 1 AS rel, p[rel] AS word FROM t, unnest(range(1, len(p) + 1)) AS u(rel)),
occ AS MATERIALIZED (SELECT doc_id, w[i] AS word, i - 1 AS pos FROM d, unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i] IN (SELECT word FROM tw)),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM occ GROUP BY word),
idf AS MATERIALIZED (SELECT tw.*, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1)) + 1e-6 AS idf FROM tw LEFT JOIN df USING (word)),
anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY idf DESC, rel) AS r FROM idf WHERE rel < key) WHERE r <= {ANCHORS}),
cand AS (SELECT doc_id, template, st FROM (
    SELECT doc_id, template, pos - a.rel AS st, count(*) AS votes, min(a.key) AS n FROM occ JOIN anchor a ON occ.word = a.word GROUP BY doc_id, template, pos - a.rel)
  WHERE votes = least({ANCHORS}, n) AND st >= 0),
seen AS (SELECT c.doc_id, c.template, i.label, i.base, c.st AS start, bool_and(o.pos IS NOT NULL OR i.rel >= i.key) AS good,
    sum(CASE WHEN o.pos IS NULL THEN 0 ELSE i.idf END) / sum(i.idf) AS share
  FROM cand c JOIN idf i ON c.template = i.template LEFT JOIN occ o ON o.doc_id = c.doc_id AND o.pos = c.st + i.rel AND o.word = i.word
  GROUP BY c.doc_id, c.template, i.label, i.base, c.st),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, max(share) AS score
  FROM seen WHERE good GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, string_agg(label, ',' ORDER BY label) FILTER (base) AS base_labels
  FROM (SELECT DISTINCT doc_id, label, base FROM seen WHERE good) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 9) AS score
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)
"""


SQL = _sql()
