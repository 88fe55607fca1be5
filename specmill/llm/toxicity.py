"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words counts common subsequences of four characters that span at most ``REACH`` of each, every one
weighted by ``DECAY`` per character spanned, so gapped insults and insults with inserted characters still match. A sentence
is its words (letters set apart by blanks are joined first) and scores as its worst word; a text as its worst sentence.
Labels are those of texts, so a positive text is represented by its witness, the word most tied to toxic texts; negatives
are words of clean texts, first frequent and random ones, then those that the machine gets most wrong.

With landmarks L the Nyström features of x are K(x, L) K(L, L)^(-1/2), and a linear machine on them is one weight per
subsequence: f(x) = sum over subsequences of decay * weight / norm. A word therefore costs a few table look-ups, whatever the
number of landmarks, and the table is of fixed size. The training sample is bounded: ``LABELLED`` texts, one of each family
of near copies, read whole; from them ``LANDMARKS``, ``NEGATIVES`` and ``WITNESSES`` words.

Defined results: null and empty texts score as clean; texts of any length are read whole; repeated rows score equally; with no
training labels of both kinds, or no word at all that is likelier in toxic texts, every text scores 0; an empty table gives an empty result; further columns are carried along,
one named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from specmill.llm import shared

DECAY, REACH, ORDER, SYMBOLS = 0.75, 6, 4, 40
LANDMARKS, NEGATIVES, WITNESSES, HARD_ROUNDS = 384, 6000, 4000, 3
#: Times that a witness word is likelier in a toxic text than in a clean one, at least.
LIKELIER = 20
#: Labelled texts that the machine learns from, at most; chosen by a hash of their id.
LABELLED = 24_000
#: Words a worker remembers at once; more only cost time.
REMEMBERED = 300_000
_OFFSETS = [(0, *c) for c in combinations(range(1, REACH), ORDER - 1)]
_CHUNK = re.compile(r'[^\s.,;:!?"()\[\]]+')
_SPACED = re.compile(r"(?:(?<=\s)|^)\w(?:[ ]\w){2,}(?=\s|$|[.,;:!?])")
_SCHEMA_WORDS = "word string"


def _alphabet() -> np.ndarray:
    """Symbol of each code point below 0x2000: letters, digits as one, accented letters by rest, everything else one."""
    table = np.full(0x2000, 39, np.int64)
    table[np.arange(97, 123)] = np.arange(26)
    table[np.arange(48, 58)] = 26
    accented = np.arange(0xC0, 0x2000)
    table[accented] = 29 + accented % 10
    return table


_SYMBOL = _alphabet()


def words_of(text: str) -> set[str]:
    """The distinct words of a text in lower case, with spaced-out letters also joined."""
    text = text.lower()
    out = set(_CHUNK.findall(text))
    for m in _SPACED.findall(text):
        out.add(m.replace(" ", ""))
    return out


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length of word: places of the words, codes of their subsequences (words x n), weights (n)."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        step = max(1, 400_000 // (n + 2))
        for s in range(0, len(at), step):
            part = at[s:s + step]
            points = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            body = _SYMBOL[np.minimum(points, 0x1FFF)]
            seq = np.concatenate([np.full((len(part), 1), 27), body, np.full((len(part), 1), 28)], axis=1)
            codes, weights = [], []
            for offset in _OFFSETS:
                m = n + 2 - offset[-1]
                if m > 0:
                    code = seq[:, :m]
                    for o in offset[1:]:
                        code = code * SYMBOLS + seq[:, o:o + m]
                    codes.append(code)
                    weights.append(np.full(m, DECAY ** (offset[-1] + 1)))
            if codes:
                yield np.array(part), np.concatenate(codes, axis=1), np.concatenate(weights)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of words against landmarks, through the landmarks' sparse subsequence table."""
    parts = [(at, c, w / np.sqrt((w * w).sum())) for at, c, w in subsequences(landmarks)]
    used = np.unique(np.concatenate([c.ravel() for _, c, _ in parts]))
    table = np.zeros((len(used) + 1, len(landmarks)))
    for at, c, w in parts:
        for j, i in enumerate(at):
            np.add.at(table[:, i], np.searchsorted(used, c[j]), w)
    out = np.zeros((len(words), len(landmarks)))
    for at, c, w in subsequences(words):
        row = np.searchsorted(used, c)
        row[(row == len(used)) | (used[np.minimum(row, len(used) - 1)] != c)] = len(used)
        norm = np.sqrt((w * w).sum())
        for s in range(0, len(at), 256):
            out[at[s:s + 256]] = np.einsum("ijk,j->ik", table[row[s:s + 256]], w) / norm
    return out


class Scorer:
    """One weight per subsequence, a bias, and the calibration of a text's score."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float = 4.0, shift: float = 0.0):
        self.weight, self.bias, self.slope, self.shift = weight, bias, slope, shift
        self.known: dict[str, float] = {}

    def words(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for at, c, w in subsequences(words):
            out[at] += (self.weight[c] @ w) / np.sqrt((w * w).sum())
        return out

    def texts(self, texts, at_once: int = 256) -> np.ndarray:
        """The worst word's value of each text; the bias alone for no words. Few texts' words are held at a time."""
        low, out, texts = min(self.bias, -1.0), [], list(texts)
        for i in range(0, len(texts), at_once):
            sets = [words_of(t) if t else set() for t in texts[i:i + at_once]]
            if len(self.known) > REMEMBERED:
                self.known = {}
            new = list({w for s in sets for w in s if w not in self.known})
            self.known.update(zip(new, self.words(new).tolist(), strict=True))
            out += [max(map(self.known.__getitem__, s), default=low) for s in sets]
        return np.array(out, float)

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (value - self.shift), -60, 60)))

    def __getstate__(self):
        return {**self.__dict__, "known": {}}


def machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray, c: float = 2e4, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps on the rows inside the margin; ``cost`` balances the classes."""
    x = np.hstack([z, np.ones((len(z), 1))])
    cost = cost / cost.sum() * c
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        xc = x[inside] * cost[inside, None]
        w = np.linalg.solve(ridge + xc.T @ x[inside], xc.T @ y[inside])
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def _fold(z_weights: np.ndarray, landmarks: list[str]) -> np.ndarray:
    out = np.zeros(SYMBOLS ** ORDER, np.float64)
    for at, c, w in subsequences(landmarks):
        for j, i in enumerate(at):
            np.add.at(out, c[j], w / np.sqrt((w * w).sum()) * z_weights[i])
    return out.astype(np.float32)


def _train(landmarks: list[str], positive: list[str], negative: list[str]) -> Scorer:
    gram = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-6 * values[-1]
    half = vectors[:, keep] / np.sqrt(values[keep])
    words = positive + negative
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    cost = np.where(y > 0, 0.5 / max(len(positive), 1), 0.5 / max(len(negative), 1))
    w, b = machine(kernel(words, landmarks) @ half, y, cost)
    return Scorer(_fold(half @ w, landmarks), b)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer | None:
    """Learns from ``LABELLED`` of the labelled rows. Word counts are aggregated on Spark; the driver sees bounded word lists only."""
    folder = shared.shared_folder(docs.sparkSession)
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(marks), "_id").select("_id", "_y", "_t")  # LABELLED rows at most
    rows = shared.written(rows, folder, "labelled")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for y in (0, 1):  # counts of a batch are summed before they leave the task
                count: dict[str, int] = {}
                for t in b.loc[b["_y"] == y, "_t"]:
                    for w in words_of(t) if t else ():
                        count[w] = count.get(w, 0) + 1
                yield pd.DataFrame({"word": list(count), "toxic": [v * y for v in count.values()], "clean": [v * (1 - y) for v in count.values()]})

    rows = shared.written(rows.join(_first_of_family(rows, folder), "_id", "left_semi").select("_y", "_t"), folder, "rows")
    totals = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    words = rows.mapInPandas(spread, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = shared.written(words, folder, "words")
    p, q = F.col("toxic") / totals[1], F.col("clean") / totals[0]
    tie = (p - q) / F.sqrt((F.col("toxic") + F.col("clean") + 1) / (totals[0] + totals[1])) * F.sqrt(F.col("toxic") + F.col("clean"))
    words = words.withColumn("tie", tie)
    # a witness word is likelier in toxic texts by rates, whatever the share of toxic texts, and by more than chance allows
    top = words.where("toxic >= 2").where(p >= LIKELIER * q).orderBy(F.desc("tie"), "word").limit(WITNESSES).collect()
    rate = totals[1] / (totals[0] + totals[1])
    allowed = np.log(words.count() + 1.0)
    positive = [r["word"] for r in top if _surprise(r["toxic"], r["clean"], rate) > allowed]
    if not positive:  # none is sure: the most tied ones, else nothing could be called toxic
        positive = [r["word"] for r in words.where(p > q).orderBy(F.desc("tie"), "word").limit(10).collect()]
    if not positive:
        return None
    clean = words.where("clean > 0 and toxic * 3 <= clean * 2")
    common = [r[0] for r in clean.orderBy(F.desc("clean"), "word").select("word").limit(NEGATIVES // 2).collect()]
    chance = [r[0] for r in clean.orderBy(F.xxhash64("word"), "word").select("word").limit(NEGATIVES // 2).collect()]
    negative = list(dict.fromkeys([w for w in common + chance if w]))
    scorer = None
    for _ in range(HARD_ROUNDS):
        marks_ = positive[:LANDMARKS // 2] + negative[-LANDMARKS // 4:] + negative[:LANDMARKS // 4]
        scorer = _train(list(dict.fromkeys(marks_)), positive, negative)
        wrong = clean.mapInPandas(_valued(scorer), "word string, value double").orderBy(F.desc("value"), "word").limit(NEGATIVES // 3).collect()
        known = set(negative)
        fresh = [r["word"] for r in wrong if r["value"] > -1 and r["word"] not in known]
        if not fresh:
            break
        negative += fresh
    values = rows.mapInPandas(_worst(scorer), "y int, value double")
    bins = values.groupBy("y", F.round(F.least(F.greatest("value", F.lit(-5.0)), F.lit(5.0)), 2).alias("v")).count().collect()  # 2 x 1001 rows at most
    scorer.slope, scorer.shift = _calibrated([(r["y"], r["v"], r["count"]) for r in bins])
    return scorer


def _surprise(toxic: int, clean: int, rate: float) -> float:
    """Minus the logarithm of (a bound of) the chance that so many of a word's texts are toxic at this rate."""
    n = toxic + clean
    return sum(x * np.log(x / n / r) for x, r in ((toxic, rate), (clean, 1 - rate)) if x)


def _first_of_family(rows: DataFrame, folder: str, hashes: int = 6, rounds: int = 2) -> DataFrame:
    """One id of each family of near copies, else a text copied a hundred times would lend its weight to all its words.

    Texts that share one of their smallest hashes of three words take over the smallest id among them, twice.
    """
    w = shared.words(F.col("_t"))
    grams = shared.let(w, lambda x: F.when(F.size(x) >= 3, F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.xxhash64(F.slice(x, i + 1, 3)))).otherwise(F.array(F.xxhash64(x))))
    least = shared.let(grams, lambda g: F.array(*[F.array_min(F.transform(g, lambda x: F.xxhash64(x, F.lit(j)))) for j in range(hashes)]))
    near = shared.written(rows.select("_id", F.explode(least).alias("h")), folder, "near")
    label = near.select("_id").distinct().withColumn("label", F.col("_id"))
    for _ in range(rounds):
        low = near.join(label, "_id").groupBy("h").agg(F.min("label").alias("label"))
        label = near.join(low, "h").groupBy("_id").agg(F.min("label").alias("label"))
    return label.where("_id = label").select("_id")


def _valued(scorer: Scorer):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "value": scorer.words(b["word"].tolist())})
    return run


def _worst(scorer: Scorer):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["_y"], "value": scorer.texts(b["_t"])})
    return run


def _calibrated(bins: list[tuple[int, float, int]]) -> tuple[float, float]:
    """The shift that makes fewest errors on the training texts (midway between equally good ones), slope by the spread."""
    bins = sorted(bins, key=lambda b: b[1])
    values = sorted({v for _, v, _ in bins})
    toxic, clean = dict.fromkeys(values, 0), dict.fromkeys(values, 0)
    for y, v, n in bins:
        (toxic if y else clean)[v] += n
    errors, best = sum(clean.values()), None
    for i, v in enumerate(values):  # cut just above values[i - 1]
        if best is None or errors < best[0]:
            best = (errors, i, i)
        elif errors == best[0]:
            best = (errors, best[1], i)
        errors += toxic[v] - clean[v]
    i = best[1]
    low, high = values[max(i - 1, 0)], values[min(i, len(values) - 1)]
    return 6.0, (low + high) / 2 if i else values[0] - 0.1


def score(docs: DataFrame, scorer: Scorer | None, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a double ``out`` from 0 to 1. The scorer is of fixed size (SYMBOLS ** ORDER weights)."""
    docs = docs.drop(out)
    if scorer is None:
        return docs.withColumn(out, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def worst(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = held.value
        for texts in batches:
            yield pd.Series(s.score(s.texts(texts)))
        s.known = {}  # a worker outlives its task

    return docs.withColumn(out, worst(F.col(text)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = fit(docs, labels.where(~held_out()))
    return score(docs, scorer).select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
