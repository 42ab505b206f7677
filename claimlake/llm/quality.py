"""Quality classifier on random Fourier features.

Statistics of a whole text are standardised and mapped to random Fourier features, which approximate a
Gaussian kernel. Every partition sums its share of the normal equations; their sum gives ridge scores, and
isotonic regression over binned scores turns these into probabilities. The bins hold scores out of fold: each row is
scored by a ridge that was fitted without its fold. Labels, language, source and id are
never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Number of Fourier features, kernel width in standard deviations, ridge penalty, seed, score bins.
FOURIER, WIDTH, PENALTY, SEED, BINS = 192, 4.0, 1.0, 7, 1024
#: Folds of the calibration; rows with equal statistics share one.
FOLDS = 4
NAMES = ["log_chars", "log_words", "word_length", "distinct_words", "log_lines", "line_words", "distinct_lines", "upper", "digits", "symbols", "stops", "marks", "beyond_ascii", "pipes", "symbol_words", "longest_word", "distinct_pairs"]

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in b"#$%&*+/<=>@[\\]^_`{}~":
    _CLASS[_c] = 3
for _c in b".,;:":
    _CLASS[_c] = 4
for _c in b"!?\"'()-":
    _CLASS[_c] = 5
_CLASS[128:] = 6
_CLASS[ord("|")] = 7


def statistics(text: str | None) -> list[float]:
    """One number for each of NAMES; an empty or null text has zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, lines = len(words), [x for x in raw.split(b"\n") if x.strip()]
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    solid = max(sum(map(len, words)), 1)
    lower = [w.lower() for w in words]
    share = counts / solid
    return [
        np.log1p(len(raw)), np.log1p(n), solid / n, len(set(lower)) / n, np.log1p(len(lines)), np.log1p(n / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1),
        share[1], share[2], share[3], counts[4] / n, counts[5] / n, share[6], counts[7] / n, min(counts[3] / n, 4.0), np.log1p(max(map(len, words))), len(set(zip(lower, lower[1:], strict=False))) / max(n - 1, 1),
    ]


@dataclass
class Model:
    """Everything that a score needs: bounded by FOURIER and BINS, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(SEED)
        w = draw.standard_normal((x.shape[1], FOURIER)) / WIDTH
        phase = draw.uniform(0, 2 * np.pi, FOURIER)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FOURIER) * np.cos(z @ w + phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins in ascending order: the increasing rates nearest to hits / counts."""
    blocks: list[list[float]] = []
    for h, c in zip(hits, counts, strict=True):
        blocks.append([h, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), h / c) for h, c, k in blocks]) if blocks else np.zeros(0)


def with_statistics(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """The kept columns (none of them named x or _text) and ``x``, the statistics of the whole text."""
    kept = docs.select(*[common.col(c) for c in keep], common.col(text).cast("string").alias("_text"))
    schema = kept.drop("_text").schema.add("x", T.ArrayType(T.DoubleType()))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            x = pa.array([statistics(t) for t in batch.column("_text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), x], [*keep, "x"])

    return kept.mapInArrow(common.tidy(compute), schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(NAMES))


def solve(system: np.ndarray) -> np.ndarray:
    """Ridge weights of the normal equations, right side last; the constant is not penalised."""
    penalty = PENALTY * np.eye(FOURIER + 1)
    penalty[-1, -1] = 1e-6
    return np.linalg.solve(system[:, :-1] + penalty, system[:, -1])


def fit(rows: DataFrame) -> Model:
    """Fit on rows (x, y) with y from 0 to 1. Without rows every score is 1/2; with one label only, that label."""
    fold = F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = common.materialize(rows.select("x", F.col("y").cast("double").alias("y"), fold).where(F.col("y").isNotNull()), "quality-train")
    each = [f(F.col("x")[i]) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]
    first = rows.agg(F.count("*"), F.avg("y"), *each).first()
    if not first[0] or first[1] in (0.0, 1.0):
        value = 0.5 if not first[0] else first[1]
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(FOURIER + 1), np.array([0.0]), np.array([value]))
    model = Model(np.array(first[2::2]), np.maximum(np.array(first[3::2]), 1e-6), np.zeros(FOURIER + 1), np.zeros(1), np.zeros(1))
    size = FOURIER + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            z, y, at = model.fourier(_matrix(batch)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f in np.unique(at):
                own = at == f
                total[f, :, :-1] += z[own].T @ z[own]
                total[f, :, -1] += z[own].T @ y[own]
        yield from _rows(dict(enumerate(total.reshape(FOLDS * size, size + 1))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, values in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.array(values)
        yield from _rows(total)

    parts = rows.mapInArrow(common.tidy(sums), "i int, v array<double>").repartition(8, "i").mapInArrow(common.tidy(add), "i int, v array<double>")
    systems = np.zeros((FOLDS * size, size + 1))
    for row in parts.collect():  # FOLDS * (FOURIER + 1) rows
        systems[row["i"]] = row["v"]
    systems = systems.reshape(FOLDS, size, size + 1)
    whole = systems.sum(axis=0)
    model.weights = solve(whole)
    without = np.array([solve(whole - systems[f]) for f in range(FOLDS)])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, counts = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            raw = (model.fourier(_matrix(batch)) * without[batch.column("fold").to_numpy()]).sum(axis=1)
            at = bin_of(raw)
            counts += np.bincount(at, minlength=BINS)
            hits += np.bincount(at, weights=batch.column("y").to_numpy(), minlength=BINS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(hits[used]), pa.array(counts[used])], ["bin", "hits", "n"])

    found = sorted(rows.mapInArrow(common.tidy(bins), "bin long, hits double, n double").groupBy("bin").agg(F.sum("hits"), F.sum("n")).collect())  # at most BINS rows
    at, hits, counts = (np.array(x, dtype=float) for x in zip(*found, strict=True))
    model.knots, model.values = (at + 0.5) / BINS * 2 - 0.5, isotonic(hits, counts)
    return model


def bin_of(raw: np.ndarray) -> np.ndarray:
    """Bins of ridge scores, which lie about 0 and 1."""
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)


def _rows(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["i", "v"])


def score_column(model: Model, text: str = "text") -> Column:
    """Score of a text column as a vectorised function."""

    def score(texts: pa.Array) -> pa.Array:
        x = [statistics(t) for at in range(0, len(texts), 512) for t in texts.slice(at, 512).to_pylist()]
        return pa.array(model.scores(np.array(x).reshape(len(x), len(NAMES))))

    return F.arrow_udf(score, "double")(common.col(text).cast("string"))


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, mod 3, is 1. A null id never teaches either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def usable_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(_of, y): the labels 0 and 1 of ids that are not held out, once each; of an id with several, their mean."""
    usable = labels.where(common.col(label).isin(0, 1) & ~held_out(common.col(doc_id)))
    return usable.groupBy(common.col(doc_id).alias("_of")).agg(F.avg(common.col(label)).alias("y"))


def train(docs_x: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on rows (doc_id, x) that have a label and are not held out."""
    return fit(docs_x.join(usable_labels(labels, doc_id, label), common.col(doc_id) == F.col("_of")).select("x", "y"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """Statistics of the rows that may have a usable label: a bit filter of the labels' ids spares the others the work."""
    ids = common.materialize(usable_labels(labels, doc_id, label).select(F.xxhash64("_of").alias("_h")), "quality-ids")
    bits = common.filter_bits(ids.count())
    words = common.materialize(common.filter_words(ids, "_h", bits), "quality-filter")
    rows = docs.where(~held_out(common.col(doc_id))).select(common.col(doc_id), common.col(text).cast("string").alias("_words"), F.xxhash64(common.col(doc_id).cast(labels.schema[doc_id].dataType)).alias("_h"))
    return with_statistics(common.might_hold(rows, words, "_h", bits, "_hit").where("_hit"), "_words", doc_id)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows whose score is at least ``least``, with the columns of the input.

    Null and empty texts are scored like any other, repeated rows alike (each teaches, if its id is labelled); an id
    labelled several times teaches the mean of its labels; an empty table stays empty; without usable labels every score
    is 1/2, so that nothing is rejected.
    """
    model = train(common.materialize(labelled_statistics(docs, labels, text, doc_id, label), "quality-stats"), labels, doc_id, label)
    return docs.where(score_column(model, text) >= least)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = common.materialize(with_statistics(docs, "text", "doc_id"), "quality-stats")
    model = train(stats, common.table(spark, sf_dir, "labels"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = stats.mapInArrow(common.tidy(score), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
