"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracklake.llm.common import in_batches, materialize, table


@dataclass
class Model:
    """weights[f] is a feature's weight times its log-count ratio; a score is sigmoid(bias + sum over a text's distinct features)."""

    sizes: tuple[int, ...]
    bits: int
    weights: np.ndarray
    bias: float


class Features:
    """Distinct hashed character n-grams of texts."""

    def __init__(self, sizes: tuple[int, ...], bits: int):
        self.sizes, self.bits = sizes, bits
        self.place = np.zeros(1 << bits, np.int32)

    def of(self, text: str | None) -> np.ndarray:
        """Feature numbers of a text, each once. White space of any length counts as one space, case doesn't count."""
        t = f" {' '.join((text or '').lower().split())} "
        x = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
        found = []
        for n in self.sizes:
            if len(x) < n:
                continue
            h = np.full(len(x) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ x[i : i + len(h)]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            found.append(h >> np.uint32(32 - self.bits))
        if not found:
            return np.empty(0, np.uint32)
        h = np.concatenate(found)
        order = np.arange(len(h), dtype=np.int32)
        self.place[h] = order  # the last place of each feature stays
        return h[self.place[h] == order]


def _counter(sizes: tuple[int, ...], bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(sizes, bits), np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label, features.of(text)] += 1
        some = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(some), 65536):
            f = some[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(counts[0, f]), pa.array(counts[1, f])], names=["f", "n0", "n1"])

    return count


def _vectors(sizes: tuple[int, ...], bits: int, number: np.ndarray):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(sizes, bits)
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                x = number[features.of(text)]
                found.append(x[x >= 0].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["label", "x", "id"])

    return vectors


def fit_logistic(x: list[np.ndarray], y: np.ndarray, weight: np.ndarray, scale: np.ndarray, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features times `scale`, by Nesterov's accelerated gradient with restarts."""
    rows, cols = np.repeat(np.arange(len(x), dtype=np.int32), [len(v) for v in x]), np.concatenate(x)
    n, w, bias = weight.sum(), np.zeros(len(scale)), float(np.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5)))
    values = scale[cols]
    # a bound of the curvature: the largest squared norm of a row
    step = 1.0 / (0.25 * max(1.0, float(np.bincount(rows, values**2, minlength=len(x)).max(initial=0)) + 1.0) + l2)
    step *= 20.0  # rows are far from parallel; a restart halves it when the loss rises
    v, vb, t, last = w.copy(), bias, 1.0, np.inf
    for _ in range(rounds):
        z = np.bincount(rows, values * v[cols], minlength=len(x)) + vb
        loss = weight @ (np.logaddexp(0, z) - y * z) / n + 0.5 * l2 * v @ v
        if loss > last + 1e-12:
            step, t, v, vb, last = step / 2, 1.0, w.copy(), bias, np.inf
            continue
        last = loss
        e = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        w2, b2 = v - step * (np.bincount(cols, e[rows] * values, minlength=len(scale)) + l2 * v), vb - step * e.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - bias)
        w, bias, t = w2, b2, t2
    return w * scale, bias


def fit_line(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of label 1 over a score, by Newton's method with a slight pull to (1, 0)."""
    x, p = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (weight * (q - y)) + (p - [1.0, 0.0])
        p = p - np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.eye(2), g)
    return (float(p[0]), float(p[1])) if np.isfinite(p).all() and p[0] > 0 else (1.0, 0.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000, sizes: tuple[int, ...] = (3, 4, 5, 6), bits: int = 20, kept: int = 16_384, least: int = 3, smoothing: float = 1.0, l2: float = 1e-3, rounds: int = 200) -> Model:
    """Fits on at most `per_class` labelled documents of each label, those whose ids have the least hashes.

    Each n-gram's scale is its naive Bayes log-count ratio ln((n1 + a) / (N1 + 2a)) - ln((n0 + a) / (N0 + 2a)), n its documents of a
    label and N all of these. The `kept` n-grams whose ratio is largest against its own standard error, of those in at
    least `least` documents, enter the regression; the rest weigh nothing. Documents are weighted so that the labels have
    their shares of all labelled rows. Scores that each half of the sample gets from the other set slope and bias.

    Null labels, labels but 0 and 1, and labels whose document is missing teach nothing; a document that is labelled twice counts with its highest label, and of repeated rows of a labelled
    id one teaches, that whose text has the least hash. Null texts are empty ones. Without a label of either kind the score is the share of label 1 (one half if there are none).
    To the driver come the n-gram counts (at most 2 ** bits rows) and the sample's vectors, both bounded.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    counts = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return Model(sizes, bits, np.zeros(1 << bits, np.float32), float(np.log((n1 + 1e-9) / (n0 + 1e-9))))
    order = F.xxhash64("id", F.lit("fit"))
    sample = marked.where("label = 0").orderBy(order, "id").limit(per_class).union(marked.where("label = 1").orderBy(order, "id").limit(per_class))
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    # one text an id, so that what reaches the driver is bounded by the ids, however often an id is repeated
    known = known.groupBy("label", "id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("label", "text", "id")
    known = materialize(known, "toxicity-known")  # documents are read once for the fit
    there = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    in0, in1 = there.get(0, 0), there.get(1, 0)
    if not in0 or not in1:
        return Model(sizes, bits, np.zeros(1 << bits, np.float32), float(np.log((in1 + 1e-9) / (in0 + 1e-9))))
    seen = known.transform(in_batches, _counter(sizes, bits), "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= least)
    f, c0, c1 = (seen.toArrow().sort_by("f")[c].to_numpy().astype(np.float64) for c in ("f", "n0", "n1"))
    ratio = np.log((c1 + smoothing) / (in1 + 2 * smoothing)) - np.log((c0 + smoothing) / (in0 + 2 * smoothing))
    sure = np.abs(ratio) / np.sqrt(1 / (c1 + smoothing) + 1 / (c0 + smoothing))
    best = np.sort(np.argsort(-sure, kind="stable")[:kept])
    number = np.full(1 << bits, -1, np.int32)
    number[f[best].astype(np.int64)] = np.arange(len(best), dtype=np.int32)
    shared = spark.sparkContext.broadcast(number)
    rows = known.transform(in_batches, _vectors_of(sizes, bits, shared), "label int, x binary, id long").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    x, y = [np.frombuffer(r["x"], "<i4") for r in rows], np.array([r["label"] for r in rows], np.float64)
    weight = np.where(y == 1, n1 / in1, n0 / in0)
    w, bias = fit_logistic(x, y, weight, ratio[best], l2, rounds)
    # scores of documents that a half of the sample hasn't seen tell where label 1 becomes likelier
    z, half = np.zeros(len(x)), np.arange(len(x)) % 2 == 0
    for own in (half, ~half):
        if 0 < y[own].sum() < own.sum():
            w_, b_ = fit_logistic([v for v, o in zip(x, own, strict=True) if o], y[own], weight[own], ratio[best], l2, rounds)
            z[~own] = [w_[v].sum() + b_ for v, o in zip(x, own, strict=True) if not o]
    slope, shift = fit_line(z, y, weight)
    w, bias = slope * w, slope * bias + shift
    weights = np.zeros(1 << bits, np.float32)
    weights[f[best].astype(np.int64)] = w
    return Model(sizes, bits, weights, float(bias))


def _vectors_of(sizes: tuple[int, ...], bits: int, shared):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _vectors(sizes, bits, shared.value)(batches)

    return vectors


def _scorer(sizes: tuple[int, ...], bits: int, bias: float, shared, text_col: str, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Features(sizes, bits), shared.value
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            z = np.array([bias + float(weights[features.of(texts[i].as_py())].sum(dtype=np.float64)) for i in range(len(texts))], np.float64)
            kept = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*names, "score"])

    return score


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows of docs with score (0 to 1) and predicted (1 if score >= 0.5), from the whole text alone; without the text, if that isn't to be kept.

    Null and empty texts have the score of no features. Other columns of docs named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    rows = docs.drop(*({"score", "predicted"} - {text_col}))
    out = rows.drop("score", "predicted") if keep_text else rows.drop("score", "predicted", text_col)
    schema = StructType([*out.schema.fields, StructField("score", DoubleType())])
    scored = rows.transform(in_batches, _scorer(model.sizes, model.bits, model.bias, shared, text_col, out.columns), schema)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out()))
    return score_toxicity(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", held_out().alias("held_out"), "score", "predicted")
