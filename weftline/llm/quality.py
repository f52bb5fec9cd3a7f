"""Quality classifier: naive Bayes support vectors.

Indicators of hashed character n-grams are scaled by the log-ratio of their class counts, and a linear hinge-loss model
is fitted on them by dual coordinate descent. Class counts come from all training rows; the fit itself takes a bounded
sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import smallest, written

DIM_BITS = 16
DIM = 1 << DIM_BITS
SLICE = 1 << 18
_RAW, _SHAPED = (1, 2, 3), (2, 3, 4, 6)
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = 128


def features(text: str | None) -> np.ndarray:
    """Sorted indices of the n-grams that the whole text has: of its bytes, and of their classes (letters, digits)."""
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "replace") + b" ", np.uint8)
    seen = np.zeros(DIM, bool)
    for at in range(0, len(raw), SLICE):
        part = raw[max(0, at - 5) : at + SLICE]
        for kind, (data, lengths) in enumerate(((part, _RAW), (_SHAPE[part], _SHAPED))):
            wide = data.astype(np.uint64)
            for n in lengths:
                if len(wide) < n:
                    continue
                code = np.full(len(wide) - n + 1, n + 16 * kind, np.uint64)
                for i in range(n):
                    code = code * np.uint64(257) + wide[i : len(wide) - n + 1 + i]
                seen[(code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIM_BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros((2, DIM), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):  # a text at a time
            counts[label, features(text.as_py())] += 1
            rows[label] += 1
    used = np.flatnonzero(counts.any(axis=0))
    columns = [np.append(used, -1), np.append(counts[0, used], rows[0]), np.append(counts[1, used], rows[1])]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["feature", "n0", "n1"])


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()).astype(np.uint16).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["f", "label"])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, *, cost: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model over unit rows scale[idx] / norm; y is -1 or 1."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norms = [1 / max(np.sqrt((scale[i] ** 2).sum()), 1e-12) for i in rows]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = scale[rows[i]] * norms[i]
            step = alpha[i] - (y[i] * (w[rows[i]] @ x + bias) - 1) / 2  # x has norm 1, the bias another
            step = min(max(step, 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * x
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return w, bias


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's a, b with smoothed targets: P(y=1) = 1 / (1 + exp(-(a m + b)))."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target, x, theta = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (target - p))
        theta += np.clip(step, -5, 5)
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(training: DataFrame, *, sample_rows: int = 6000, cost: float = 1.0, epochs: int = 12) -> dict:
    """A model from (row_key, text, label 0 or 1). Counts cover all rows; the hinge fit takes the sample_rows rows whose
    hash of row_key is smallest. Without rows of both labels the score is the share of label 1 (0.5 without rows)."""
    counted = training.select("text", "label").mapInArrow(_class_counts, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0"), F.sum("n1")).toArrow()
    index, n0, n1 = (counted.column(i).to_numpy() for i in range(3))
    total0, total1 = int(n0[index == -1].sum()), int(n1[index == -1].sum())
    if not total0 or not total1:
        return {"w": np.zeros(DIM), "scale": np.zeros(DIM), "bias": 0.0, "a": 1.0, "b": 0.0, "constant": 0.5 if not total0 + total1 else float(total1 > 0)}
    p = np.ones((2, DIM))
    p[0, index[index >= 0]] += n0[index >= 0]
    p[1, index[index >= 0]] += n1[index >= 0]
    scale = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    near = smallest(training, F.xxhash64("row_key"), sample_rows)
    drawn = near.orderBy(F.xxhash64("row_key"), "row_key", "label", F.xxhash64("text")).limit(sample_rows).select("text", "label").mapInArrow(_sampled_features, "f binary, label int").toArrow()
    rows = [np.frombuffer(b, np.uint16).astype(np.int32) for b in drawn["f"].to_pylist()]
    y = np.where(drawn["label"].to_numpy() == 1, 1.0, -1.0)
    w, bias = dual_coordinate_descent(rows, y, scale, cost=cost, epochs=epochs)
    model = {"w": w, "scale": scale, "bias": bias, "a": 1.0, "b": 0.0, "constant": None}
    margin = np.array([_margin(model, r) for r in rows])
    model["a"], model["b"] = _sigmoid_fit(margin, y)
    return model


def _margin(model: dict, found: np.ndarray) -> float:
    x = model["scale"][found]
    return float(model["w"][found] @ x / max(np.sqrt((x**2).sum()), 1e-12) + model["bias"])


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score (double, 0 to 1); a column named score is replaced."""
    held = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float64) if isinstance(v, np.ndarray) else v for k, v in model.items()})

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = held.value
        if m["constant"] is not None:
            return pa.array(np.full(len(texts), m["constant"]))
        z = np.fromiter((_margin(m, features(t.as_py())) for t in texts), np.float64, len(texts))  # a text at a time
        return pa.array(1 / (1 + np.exp(-np.clip(m["a"] * z + m["b"], -500, 500))))

    return docs.withColumn("score", score(F.coalesce("text", F.lit(""))))


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """All columns of docs with held_out, score and predicted beside them.

    Labels of held-out documents, null labels and labels other than 0 and 1 are never read for fitting; a document
    labelled twice counts once, with its lower label. Rows that repeat a doc_id are training rows each. Null text is
    empty text; rows without doc_id are scored and never trained on. Columns of those three names are replaced. Labels
    are joined by a sort and merge at every size, since their table grows with the documents.
    """
    docs = docs.drop("held_out", "score", "predicted")
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    own = docs.where(~held_out("doc_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    training = written(own.join(marked.hint("merge"), "doc_id").select(F.col("doc_id").alias("row_key"), "text", "label"), "quality-training")
    scored = score_texts(docs, fit(training, **options))
    return scored.select(*docs.columns, held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(docs.select("doc_id", "text"), labels.select("doc_id", "quality")).select("doc_id", "held_out", "score", "predicted")
