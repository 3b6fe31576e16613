"""Operator 10: toxicity from two class-conditional Kneser-Ney models.

Each class, toxic and ordinary, is a context that words follow; an expression counts by the distinct texts it occurs
in. As in Kneser-Ney smoothing, a discount is taken off each class's counts, and the mass taken off is given to a
backoff that smooths rare expressions by counts the classes share:

    P(w | class) = (n(w) - d(w)) / N + L * P(s | class) * P(w | s),    L = sum of all d(w) / N

s is the word's beginning of five letters, P(w | s) comes from the counts of both classes together, and P(s | class)
is made alike from continuation counts (the distinct words of the class that begin so), backing off to four letters
and these to the shared continuation counts. The discount is what the shared counts lead to expect of the class, and
`DEVIATIONS` standard deviations of it, or all of a smaller count: a constant for rare expressions, as the absolute
discount is, and more for frequent ones. The probabilities of each class sum to one. A text's expressions are its
distinct words. The difference of its log-likelihoods, per expression and per square root of their number, goes into a
logistic function fitted to labelled texts that the models have not seen.

Models and fit use labelled rows outside the held-out fold, at most `max_toxic` and `max_ordinary` of them,
chosen by a hash of the doc_id; whole texts are counted. One fold of these is the fit's. What is broadcast is
the models of this bounded sample. Every document's whole text is scored, on words alone.

Defined cases: a null or empty text has ratio zero; without labelled rows of both classes the score is the share
of toxic ones (a millionth at least); null labels or ids don't count, a doc_id with both labels is left out, repeated
rows are documents like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_fold, slices, texts

HELD_OUT_FOLD, FIT_FOLD = 0, 4
MAX_TOXIC, MAX_ORDINARY = 8_000, 16_000
#: Standard deviations of a count, besides its expectation, that are taken off before it speaks for its class.
DEVIATIONS = 3.0
#: Words in fewer of the sample's texts are left to their beginnings.
LEAST_TEXTS = 2
BEGINNINGS = (5, 4)
#: Words whose ratio a task remembers.
CACHE_WORDS = 150_000
TOKEN = re.compile(r"[^\W_]+")


def expressions(text: str) -> set[str]:
    return set(TOKEN.findall(text.lower()))


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) to partial counts of texts (word, n0, n1)."""
    for whole in batches:
        for batch in slices(whole, "text"):
            counts = Counter(), Counter()
            for text, toxic in zip(texts(batch, "text"), batch.column("toxic").to_pylist()):
                counts[toxic].update(expressions(text))
            words = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", "n0", "n1"])


def smoothed(counts: np.ndarray, total: np.ndarray, backoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many times likelier than by the shared counts each class makes expressions, and the mass of its backoff.

    counts [expression, class] may lack expressions that are discounted whole; total has the sums over all by class;
    backoff is relative to the shared counts as well."""
    total = np.maximum(total, 1)
    shared = counts.sum(axis=1, keepdims=True) / total.sum()
    expected = shared * total
    left = (counts - np.minimum(counts, expected + DEVIATIONS * np.sqrt(expected + 1))) / total
    mass = 1 - left.sum(axis=0)
    return left / shared + mass * backoff, mass


class Ratios:
    """log toxic minus log ordinary likelihood of expressions.

    A level is (expressions, counts [:, class], totals by class, pooled counts of the longer expressions that begin
    so); first words, whose last item is unused, then beginnings from long to short.
    """

    def __init__(self, levels: list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]):
        self.tables: list[dict[str, float]] = []
        #: By level, what an expression unknown there adds before its beginning is looked up.
        self.unknown: list[float] = []
        shorter: dict[str, list[float]] = {}
        for k in range(len(levels) - 1, -1, -1):
            names, counts, total, longer = levels[k]
            backoff = np.ones((len(names), 2))
            if k + 1 < len(levels) and names:
                n = BEGINNINGS[k]
                backoff = np.array([shorter[x[:n]] for x in names])
            found, mass = smoothed(counts.reshape(-1, 2), total, backoff)
            mass = np.maximum(mass, 1e-9)
            self.unknown.insert(0, float(np.log(mass[1]) - np.log(mass[0])))
            self.tables.insert(0, dict(zip(names, (np.log(found[:, 1]) - np.log(found[:, 0])).tolist())))
            # Relative to the pooled counts of the longer expressions, by which the next level shares out a beginning.
            weight = counts.sum(axis=1) / max(total.sum(), 1) / np.maximum(longer / max(longer.sum(), 1), 1e-300) if k else np.ones(len(names))
            shorter = dict(zip(names, (found * weight.reshape(-1, 1)).tolist()))
        self.cache: dict[str, float] = {}

    def one(self, word: str) -> float:
        out = 0.0
        for table, unknown, n in zip(self.tables, self.unknown, (None, *BEGINNINGS)):
            if (found := table.get(word[:n])) is not None:
                return out + found
            out += unknown
        return out

    def __call__(self, words: set[str]) -> float:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for w in words.difference(self.cache):
            self.cache[w] = self.one(w)
        return math.fsum(map(self.cache.__getitem__, words))


def features(ratios: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    n = np.maximum(lengths, 1)
    return np.stack([ratios / n, ratios / np.sqrt(n), np.ones(len(n))], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method, on scaled columns."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def ratio_batches(batches: Iterator[pa.RecordBatch], ratios: Ratios, extra: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns named, with each text's `__ratio` and number of `__expressions`."""
    for whole in batches:
        for batch in slices(whole, "text"):
            found = [expressions(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in extra), pa.array([ratios(x) for x in found], pa.float64()), pa.array([len(x) for x in found], pa.int64())], names=[*extra, "__ratio", "__expressions"]
            )
    ratios.cache.clear()  # other operators' tasks may run in this worker next


def sample(labels: DataFrame, max_toxic: int, max_ordinary: int) -> DataFrame:
    """doc_id and toxic of the labelled rows that are learnt from: at most so many of each class."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(id_fold(F.col("doc_id")) != HELD_OUT_FOLD)
    known = known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_ordinary))


def learn(counts: DataFrame) -> Ratios:
    """From partial counts (word, n0, n1) to the models, which the size of the sample bounds."""
    levels, kept = [], []
    own = counts.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.lit(0).cast("long").alias("longer"))
    for n, least in ((None, LEAST_TEXTS), *((n, 1) for n in BEGINNINGS)):
        if n:
            begun = [F.count_if(F.col(c) > 0).alias(c) for c in ("n0", "n1")]
            own = own.groupBy(F.substring("word", 1, n).alias("word")).agg(*begun, F.sum(F.col("n0") + F.col("n1")).alias("longer"))
        own = own.persist()
        kept.append(own)
        total = own.agg(F.sum("n0"), F.sum("n1")).first()
        table = own.where(F.col("n0") + F.col("n1") >= least).toArrow()
        columns = [table.column(c).to_numpy().astype(float) for c in ("n0", "n1", "longer")]
        levels.append((table.column("word").to_pylist(), np.stack(columns[:2], 1), np.array([x or 0 for x in total], float), columns[2]))
    for own in kept:
        own.unpersist()
    return Ratios(levels)


def _scored(docs: DataFrame, labels: DataFrame, train_docs: DataFrame, max_toxic: int, max_ordinary: int) -> DataFrame:
    """docs with the column `__score`; labelled texts come from train_docs."""
    spark: SparkSession = docs.sparkSession
    chosen = sample(labels, max_toxic, max_ordinary)
    rows = train_docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    to_fit = id_fold(F.col("doc_id")) == FIT_FOLD
    ratios = learn(rows.where(~to_fit).select("text", "toxic").mapInArrow(count_batches, "word string, n0 long, n1 long"))
    shared = spark.sparkContext.broadcast(ratios)
    fit = rows.where(to_fit).select("text", "toxic").mapInArrow(lambda it: ratio_batches(it, shared.value, ["toxic"]), "toxic int, __ratio double, __expressions long").toPandas()
    y = fit["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        weights = fit_logistic(features(fit["__ratio"].to_numpy(), fit["__expressions"].to_numpy()), y)
    else:
        share = min(max(chosen.agg(F.avg("toxic")).first()[0] or 0.0, 1e-6), 1 - 1e-6)
        weights = np.array([0.0, 0.0, np.log(share / (1 - share))])
    schema = T.StructType([*docs.schema.fields, T.StructField("__ratio", T.DoubleType()), T.StructField("__expressions", T.LongType())])
    columns = docs.columns
    found = docs.mapInArrow(lambda it: ratio_batches(it, shared.value, columns), schema)
    n = F.greatest(F.col("__expressions"), F.lit(1))
    a, b, c = (float(w) for w in weights)
    logit = F.lit(a) * F.col("__ratio") / n + F.lit(b) * F.col("__ratio") / F.sqrt(n) + F.lit(c)
    return found.withColumn("__score", 1 / (1 + F.exp(-logit))).drop("__ratio", "__expressions")


def score(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labelled texts come from train_docs, or docs."""
    found = _scored(docs.select("doc_id", "text"), labels, docs if train_docs is None else train_docs, max_toxic, max_ordinary)
    held_out = (id_fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out")
    return found.select("doc_id", held_out, F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> DataFrame:
    """docs' rows and columns without the documents predicted toxic."""
    found = _scored(docs, labels, docs if train_docs is None else train_docs, max_toxic, max_ordinary)
    return found.where("__score < 0.5").drop("__score")
