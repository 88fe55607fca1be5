"""URL filters: fixed rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table, a parameter of a few dozen rows (``LABELLED``), so its cost does not
depend on the input; every URL is scored with it in the JVM. Rules win over the model; of the rules that fit, the longest.

Only DataFrame functions and Spark's own learner. Defined results: a null URL or one without ``://`` has empty host and
path, fits no rule and is allowed; repeated rows get equal results; an empty table gives an empty result; further columns are
carried along, columns named like the results are replaced. Very long URLs are used whole.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from specmill.llm import shared

#: verdict, host, path: of the rules that fit, the longest decides.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
GRAMS, BUCKETS = (3, 4), 1 << 14

_BAD = ["casino-win", "spam-farm", "free-casino", "poker-bonus", "cheap-pills", "pharma-deals", "xxx-video", "adult-cams", "bet-odds", "slots-jackpot",
        "torrent-crack", "warez-keygen", "loan-payday", "seo-links", "click-bait", "win-prize", "replica-watch", "spam-links", "free-spins", "sure-bets", "casino-slots", "link-farm"]
_GOOD = ["news-daily", "docs-python", "city-library", "open-data", "museum-art", "garden-blog", "school-physics", "weather-map", "recipes-home", "travel-notes",
         "health-clinic", "history-archive", "science-journal", "music-review", "linux-kernel", "book-club", "sports-local", "math-forum", "bird-watch", "parks-guide"]
_PLAIN = ("another thunder nation station interest there within thousand border reading edition heather thistle hero author theatre mother together "
          "leather northern enter action reason sheet anthem oxford entire blend stand weather either rather bother breath earth ethos method other "
          "island editor letter orient throne shore inner outer tender render sender winter summer autumn garden ocean forest meadow stone timber "
          "harbour letters notebook kitchen pottery violin teacher student council village railway museum").split()
_PATHS = ["/", "/en/1024", "/fr/77.html", "/de/311/", "/es/9.html", "/en/4410?page=2"]


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled URL table: url, label (1: block)."""
    tops = ["example.com", "example.org", "example.net"]
    rows = [(f"https://{('www', 'blog', 'm')[(i + j) % 3]}.{name}.{tops[(i + j) % 3]}{_PATHS[(i + 2 * j) % len(_PATHS)]}", float(bad))
            for bad, names in ((1, _BAD), (0, _GOOD + _PLAIN)) for i, name in enumerate(names) for j in range(2)]
    return spark.createDataFrame(rows, "url string, label double")


def host_of(url: Column) -> Column:
    return F.coalesce(shared.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams, told apart by where they stand; both ends are marked."""
    def of(tag: str, n: int, text: Column) -> Column:
        cut = lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) - n + 1), lambda i: F.concat(F.lit(tag), F.substring(t, i, F.lit(n))))
        return shared.let(F.concat(F.lit("^"), text, F.lit("$")), lambda t: F.when(F.char_length(t) >= n, cut(t)).otherwise(shared.empty_array("string")))
    path = F.lower(F.regexp_replace(path, "[0-9]+", "0"))
    return F.concat(*[of(tag, n, t) for tag, t in (("h:", host), ("p:", path)) for n in GRAMS])


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def fit(table: DataFrame):
    """The learner's model from a labelled URL table; bounded by that table."""
    table = table.withColumn("_grams", grams(host_of(F.col("url")), path_of(F.col("url"))))
    hashed = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=BUCKETS, binary=True).transform(table.coalesce(1))
    return LogisticRegression(featuresCol="_tf", labelCol="label", regParam=0.01, maxIter=60, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_label").fit(hashed)


@shared.apart("url")
def annotate(pages: DataFrame, url: str = "url", rules=RULES, table: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict, score (probability of block by the model)."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    rows = pages.withColumn("_host", host_of(F.col(url))).withColumn("_path", path_of(F.col(url)))
    rows = rows.withColumn("_grams", grams(F.col("_host"), F.col("_path"))).withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    rows = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=BUCKETS, binary=True).transform(rows)
    model = fit(labelled(pages.sparkSession) if table is None else table)
    rows = model.transform(rows).withColumn("_score", F.when(F.col("_host") == "", 0.0).otherwise(vector_to_array("_p")[1]))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_score") >= 0.5, "block").otherwise("allow"))
    return rows.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("_score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return annotate(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
