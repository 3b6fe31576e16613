import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cavern.llm import toxicity


def tables(spark, n=600):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice("abcdefgh") + r.choice("aeiou") + r.choice("lmnrst") + r.choice("aeiou") * (1 + i % 2) for _ in range(r.randint(5, 80))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["Nitwit,", "oaf", "rottenA", "rottenB", "rottenC"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1 - toxic, toxic))
    docs += [(None, "oaf oaf", None), (9000, None, None), (9001, "", None), (9002, "Nitwit oaf rottenZ rottenB", None), (9002, "Nitwit oaf rottenZ rottenB", None)]
    labels += [(3, 1, 0), (None, 1, 1), (7, 0, None), (8, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = tables(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count()
    for x in got:
        assert x.held_out == (zlib.crc32(("" if x.doc_id is None else str(x.doc_id)).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 600]
    assert sum(x.predicted == int(x.doc_id % 6 == 0) for x in held) > 0.95 * len(held)
    assert all(x.predicted == 1 for x in got if x.doc_id == 9002) and all(x.predicted == 0 for x in got if x.doc_id in (9000, 9001))


def test_few_or_no_labels(spark):
    docs, labels = tables(spark, 30)
    assert all(0 < x.score < 1e-5 for x in toxicity.score(docs, labels.limit(0)).collect())
    assert {x.predicted for x in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_probabilities_sum_to_one_and_back_off():
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(300)})
    counts = np.array([[r.randint(0, 60), r.randint(0, 9) * r.randint(0, 5)] for _ in words], float)
    words, counts = [w for w, c in zip(words, counts) if c.sum()], counts[counts.sum(axis=1) > 0]
    levels = [(words, counts, counts.sum(axis=0), np.zeros(len(words)))]
    for n in toxicity.BEGINNINGS:
        above, of, *_ = levels[-1]
        names = sorted({w[:n] for w in above})
        begun = np.array([[sum(c[k] > 0 for w, c in zip(above, of) if w[:n] == x) for k in (0, 1)] for x in names], float)
        levels.append((names, begun, begun.sum(axis=0), np.array([sum(c.sum() for w, c in zip(above, of) if w[:n] == x) for x in names])))
    # By the formula, word by word.
    shared = [dict(zip(names, c.sum(axis=1))) for names, c, _, _ in levels]
    total = [sum(x.values()) for x in shared]

    def parts(k, x, own):
        names, c, t, _ = levels[k]
        expected = t[own] * shared[k][x] / total[k]
        n = c[names.index(x), own]
        return n, min(n, expected + toxicity.DEVIATIONS * np.sqrt(expected + 1))

    mass = [[sum(parts(k, x, own)[1] for x in levels[k][0]) / levels[k][2][own] for own in (0, 1)] for k in range(3)]

    def probability(k, x, own):
        n, d = parts(k, x, own)
        if k == 2:
            back = shared[2][x] / total[2]
        else:
            start = x[: toxicity.BEGINNINGS[k]]
            back = probability(k + 1, start, own) * shared[k][x] / sum(shared[k][y] for y in shared[k] if y[: toxicity.BEGINNINGS[k]] == start)
        return (n - d) / levels[k][2][own] + mass[k][own] * back

    ratios = toxicity.Ratios(levels)
    for own in (0, 1):
        assert abs(sum(probability(0, w, own) for w in words) - 1) < 1e-9
    for w in words:
        assert abs(ratios.one(w) - np.log(probability(0, w, 1) / probability(0, w, 0))) < 1e-9
    assert abs(ratios.one("zzzzzz") - sum(np.log(m[1] / m[0]) for m in mass)) < 1e-9


@pytest.mark.parametrize("sf,accuracy,recall", [("sf0.01", 0.95, 0.8), ("sf0.1", 0.985, 0.917)])
def test_held_out_rows_of_the_tables(spark, sf, accuracy, recall):
    """Every document of the whole table once, and the held-out labels against the prediction."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert sorted(x.doc_id for x in rows) == sorted(x.doc_id for x in docs.select("doc_id").collect())
    held = [x for x in rows if x.held_out and x.toxic is not None]
    assert sum(x.predicted == x.toxic for x in held) >= accuracy * len(held)
    assert sum(x.predicted for x in held if x.toxic) >= recall * sum(x.toxic for x in held)


def test_long_texts_and_clashing_columns(spark):
    docs, labels = tables(spark)
    long = docs.limit(1).selectExpr("9100L as doc_id", "repeat('word other ', 500000) || ' Nitwit oaf' as text", "'x' as score")
    rows = docs.unionByName(long).withColumns({"toxic": F.lit(1), "predicted": F.lit("p"), "held_out": F.lit(0)})
    got = {x.doc_id: x for x in toxicity.score(rows, labels).collect()}
    assert got[9100].predicted == 1
    kept = toxicity.drop_toxic(rows, labels)
    assert kept.columns == rows.columns and {x.score for x in kept.select("score").collect()} == {"x", None}
