"""Operator 1, quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each text, standardised, go through cosines of random projections, which approximate a
Gaussian kernel. Each partition of the training rows sums its normal equations; the driver adds the
partitions' sums and solves them. Held-back training rows calibrate the scores, by pooling adjacent
violators, into estimates of the probability of label 1.

Training uses at most SAMPLE labelled rows, those with the least hash of doc_id; everything else covers
all rows. Labels are the only thing read besides the text.

Defined results: a null or empty text has the statistics of no words and is scored like any other. A
document with several labels has their mean; null labels are none. Without any usable label every score
is 0.5. Rows that repeat a doc_id are scored each by its own text; a null doc_id is never held out and
never learned from. Extra columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, rules

SAMPLE, FIT_PARTITIONS, FEATURES, RIDGE, WIDTH = 20_000, 8, 256, 1.0, 4.0
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
_TAIL = re.compile(rb"[^\w\x80-\xff.,;:?)\"'-]$")

NAMES = (
    "log_chars log_words word_length upper digit space punctuation symbol distinct distinct_per_root top_share "
    "adjacent_repeats repeated_windows odd_ends upper_words marks_only line_length same_lines common_words sentences"
).split()


def statistics(text: str | None) -> list[float]:
    """The numbers that a text is judged by, named in NAMES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    classes = np.bincount(rules._CLASS, by_byte, minlength=6)[:5]
    chars = max(1.0, classes.sum())
    digits = by_byte[48:58].sum()
    counts = Counter(words)
    seen = dict(zip(counts, range(len(counts)), strict=True))
    ids = np.fromiter(map(seen.__getitem__, words), np.int64, n)
    lines = data.split(b"\n")
    most = max(1, n)
    return [
        np.log1p(chars),
        np.log1p(n),
        (chars - classes[2]) / most,
        classes[1] / chars,
        digits / chars,
        classes[2] / chars,
        classes[3] / chars,
        classes[4] / chars,
        len(counts) / most,
        len(counts) / np.sqrt(most),
        max(counts.values(), default=0) / most,
        float((ids[1:] == ids[:-1]).sum()) / most,
        rules.repeated_words(ids, len(seen)) / most,
        sum(c for w, c in counts.items() if _TAIL.search(w)) / most,
        sum(c for w, c in counts.items() if w.isupper()) / most,
        sum(c for w, c in counts.items() if not w.isalnum() and len(w) == 1) / most,
        np.log1p(chars / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(counts[w] for w in rules._FORMS.keys() & counts.keys()) / most,
        sum(c for w, c in counts.items() if w.endswith(b".")) / most,
    ]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for each row of docs."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([np.array(statistics(t), np.float32) for t in part], dtype=object)

    return docs.select(docs["doc_id"], F.pandas_udf(run, "array<float>")(docs["text"]).alias("stats"))


class Model:
    """Standardising, projection, weights and calibration; small whatever the data's size."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES) -> None:
        random = np.random.default_rng(7)
        self.mean, self.scale = mean, scale
        self.turn = random.normal(size=(len(mean), features)) / WIDTH
        self.shift = random.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots, self.levels = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(x @ self.turn + self.shift) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        # a small share of the raw score orders what the calibration's steps tie
        return 0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * np.clip(raw, 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and rising levels fitted to y over x by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    # a pool's level is drawn toward one half by half a row of each label
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])


def _matrix(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["stats"].to_numpy()).astype(float) if len(part) else np.zeros((0, len(NAMES)))


def _summed(rows: DataFrame, parts_of) -> np.ndarray | None:
    """The sum over FIT_PARTITIONS partitions of parts_of(batch), flattened."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            if len(part):
                one = parts_of(part)
                total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    found = rows.mapInPandas(run, "sums binary").collect()
    return sum(np.frombuffer(r["sums"]) for r in found) if found else None


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """A model of stats (doc_id, stats) and labels (doc_id, quality), from at most SAMPLE rows."""
    usable = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("quality").alias("quality"))
    usable = usable.where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(FOLDS)) != HELD_OUT)
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = stats.join(chosen, stats["doc_id"] == chosen["id"]).select("id", "stats", "quality").dropDuplicates(["id"]).repartition(FIT_PARTITIONS, "id")
    sample = common.table(sample, "sample")
    held = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5)) == 0
    d = len(NAMES)

    def moments(part: pd.DataFrame) -> np.ndarray:
        x = _matrix(part)
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    total = _summed(sample, moments)
    if total is None:
        return Model(np.zeros(d), np.ones(d))
    mean = total[1 : d + 1] / total[0]
    model = Model(mean, np.sqrt(np.maximum(total[d + 1 :] / total[0] - mean**2, 0)) + 1e-3)

    def equations(part: pd.DataFrame) -> np.ndarray:
        f, y = model.features(_matrix(part)), part["quality"].to_numpy(float)
        return np.hstack([f.T @ f, (f.T @ y)[:, None]]).ravel()

    sums = _summed(sample.where(~held), equations)
    n = FEATURES + 1
    if sums is not None:
        sums = sums.reshape(n, n + 1)
        model.weights = np.linalg.solve(sums[:, :n] + RIDGE * 1e-2 * np.eye(n), sums[:, n])
        rest = sample.where(held).select("stats", "quality").toPandas()
        if len(rest):
            model.knots, model.levels = isotonic(model.raw(_matrix(rest)), rest["quality"].to_numpy(float))
    common.drop(sample)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    stats = common.table(described(docs), "stats")
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.value.scores(_matrix(pd.DataFrame({"stats": part}))))

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT
    out = stats.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.pandas_udf(run, "double")("stats").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
