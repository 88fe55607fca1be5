"""Spelling variant grouping by PartEnum signatures.

Words are counted over whole texts. A word's letter multiset is a binary vector over (letter, how often so far). One replaced
code point changes at most two of its dimensions (and no length), one inserted or deleted code point changes one. The dimensions are
cut into four parts by letter, balanced by the letters' counts; of words of one length at least two parts stay equal, so every choice of two parts is a signature
(6); of lengths that differ by one, one of two pairs of parts stays equal (2). A single edit also leaves the first or the last half of the
shorter word as it is: each signature is made once with either half, which splits the crowds of words with the same letters
and loses nothing. Signatures meet by equi-join, and every pair that meets is verified by its edit distance.

Only DataFrame functions. Each word's form has at least twice its count, so chains of forms end after log2(largest count)
steps; roots go down from the ends, a level at a time, and no key has more rows than a word has near words.

Defined results: null and empty texts have no words; a null doc_id counts as empty in the hash; repeated rows count as often as
they occur; an empty table gives an empty result; only ``doc_id`` and ``text`` are read, other columns do not matter. Texts are
never cut, and no count or group is capped.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from specmill.llm import shared

#: Words have so many code points and occurrences at least; one of ``EVERY`` runs loses a code point.
LEAST_LENGTH, LEAST_COUNT, EVERY = 5, 3, 97
#: Maximal runs of letters that are long enough: a shorter run has no match inside.
RUN = r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH
PARTS = 4


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of all texts with their counts."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("r"))
    low = runs.select("d", shared.ascii_lower(F.col("r")).alias("r"))
    hashed = low.select("r", F.crc32(F.concat("d", F.lit(":"), "r").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("r")).cast("int")
    less = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.char_length("r")))
    word = F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("r")).alias("word")
    return hashed.select(word).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def parts_of_letters(vocabulary: DataFrame) -> list[str]:
    """The letters that occur, dealt to ``PARTS`` parts of about equal weight. At most 90 letters exist, so they are collected."""
    counts = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    parts, weights = [""] * PARTS, [0] * PARTS
    for c, n in sorted(counts, key=lambda r: (-r[1], r[0])):
        k = weights.index(min(weights))
        parts[k], weights[k] = parts[k] + c, weights[k] + n
    return parts


def signatures(vocabulary: DataFrame) -> DataFrame:
    """sig, side, word, n. Side 0 meets its like (equal lengths), side 1 meets side 2 (one code point more)."""
    letters = parts_of_letters(vocabulary)
    ordered = F.array_join(F.sort_array(F.split("word", "")), "")
    length = F.char_length("word")
    rows = vocabulary.select("word", "n", ordered.alias("ordered"), length.alias("length"), F.expr("char_length(word) div 2").alias("half"), F.expr("(char_length(word) - 1) div 2").alias("less"))
    # the part of a letter multiset: its sorted letters without those of the other parts
    rows = rows.select("*", *[F.translate("ordered", "".join(x for j, x in enumerate(letters) if j != k), "").alias(f"part{k}") for k in range(PARTS)])
    first = {name: F.substring("word", F.lit(1), F.col(name)) for name in ("half", "less")}

    def last(shorter: Column, half: str) -> Column:
        return F.substring("word", F.col("length") - shorter + F.col(half) + 1, F.col("length"))

    def made(side: int, kept: tuple[int, ...], shorter: Column, half: str) -> list[Column]:
        name = (1 if side else 0) * 100 + kept[0] * 10 + kept[1]
        return [F.struct(F.xxhash64(F.lit(2 * name + k), shorter, h, *[F.col(f"part{p}") for p in kept]).alias("sig"), F.lit(side).alias("side")) for k, h in enumerate((first[half], last(shorter, half)))]

    one, two = F.col("length"), F.col("length") - 1
    sigs = [s for kept in combinations(range(PARTS), 2) for s in made(0, kept, one, "half")]
    sigs += [s for kept in ((0, 1), (2, 3)) for side, shorter, half in ((1, one, "half"), (2, two, "less")) for s in made(side, kept, shorter, half)]
    return rows.select("word", "n", F.explode(F.array(*sigs)).alias("s")).select("s.sig", "s.side", "word", "n")


def near(vocabulary: DataFrame) -> DataFrame:
    """a, an, b, bn: each pair of words at edit distance one, once."""
    rows = signatures(vocabulary)
    x, y = rows.alias("x"), rows.alias("y").hint("merge")  # Spark's estimate does not count the signatures of a word
    sides = F.col("x.side") * 3 + F.col("y.side")  # of both rows at once, so that both sides of the join are one exchange
    alike, longer = (sides == 0) & (F.col("x.word") < F.col("y.word")), sides == 5
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (alike | longer) & (F.levenshtein("x.word", "y.word", 1) == 1))
    return met.select(F.col("x.word").alias("a"), F.col("x.n").alias("an"), F.col("y.word").alias("b"), F.col("y.n").alias("bn")).distinct()


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``."""
    folder = shared.shared_folder(docs.sparkSession)
    vocabulary = shared.written(words(docs, doc_id, text), folder, "words")
    pairs = shared.written(near(vocabulary), folder, "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("m")).union(pairs.select("b", "a", "an"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("other"))).alias("best"))
    formed = vocabulary.join(best, "word", "left")
    much = -F.col("best.less") >= 2 * F.col("n")
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best.other")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"))
    formed = shared.written(formed, folder, "forms")
    open_ = formed.where("form is not null").select("word", "form")
    level = formed.where("form is null").select("word", F.col("word").alias("root"))
    found, step = level, 0
    while True:
        ends = level.withColumnRenamed("word", "form")
        level = shared.written(open_.join(ends, "form").select("word", "root"), folder, f"roots{step}")
        if level.isEmpty():
            break
        found, step = found.union(level), step + 1
    return formed.join(found, "word").select("word", "form", "root", "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The hash is built from its polynomial; near words share a place and what is left without it, or one is the other less one.
SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(range(8)::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) ORDER BY i) AS t
  FROM range(256) AS r(i)),
runs AS MATERIALIZED (
  SELECT d, r, count(*) AS k FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS d,
      unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r
    FROM documents) WHERE length(r) >= 5 GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT r, k, xor(list_reduce(flatten(list_transform(string_split(d || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
roots AS (SELECT word, word AS root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM forms f JOIN roots r ON f.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
