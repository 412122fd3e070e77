"""Quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

A bounded sample of labelled texts is turned into sets of hashed n-grams. Each n-gram's indicator is scaled by the ratio of the classes'
smoothed counts; a linear hinge-loss model is fitted by dual coordinate descent, its margins are mapped to a probability by a
logistic curve fitted on margins of texts that the model in question has not seen. Scoring reads every text once and shuffles nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.textvec import combine, distinct, mix, slices, utf8, word_hashes, word_spans

BITS = 18
#: Most labelled texts that the model is fitted on.
SAMPLE = 8000
SMOOTH = 1.0
COST = 0.1
EPOCHS = 12
THRESHOLD = 0.3
#: n-grams of one and two words, and of the shapes of words (letters by case, digits, marks) up to three.
_SHAPE = np.zeros(256, np.uint8)
_SHAPE[65:91] = 1
_SHAPE[97:123] = 2
_SHAPE[128:] = 2
_SHAPE[48:58] = 3
_SHAPE[[33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 58, 59, 60, 61, 62, 63, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 4


def indicators(raw: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of each row, as (row, feature) in order: one and two words, one and three word shapes."""
    words, first = word_hashes(raw, at)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(first))
    keys = [(rows, words)]
    inside = rows[1:] == rows[:-1] if len(rows) else np.zeros(0, bool)
    if len(words) > 1:
        pairs = combine(words, 2)
        keys.append((rows[1:][inside], pairs[inside]))
    # Word shapes: the first and the last byte's kind and whether all bytes are of one kind, alone and in threes.
    starts, ends, _ = word_spans(raw, at)
    if len(starts):
        kind = _SHAPE[raw].astype(np.int64)
        upper = np.concatenate([[0], np.cumsum(kind == 1)])
        marks = np.concatenate([[0], np.cumsum(kind == 4)])
        digits = np.concatenate([[0], np.cumsum(kind == 3)])
        size = ends - starts
        ups = upper[ends] - upper[starts]
        shape = np.minimum(size, 15) * 64 + (ups == size) * 32 + (ups > 0) * 16 + np.minimum(marks[ends] - marks[starts], 3) * 4 + np.minimum(digits[ends] - digits[starts], 3)
        shape = mix(shape.astype(np.uint64) + np.uint64(1 << 20))
        keys.append((rows, shape))
        if len(shape) > 2:
            three = combine(shape, 3)
            whole = rows[2:] == rows[:-2]
            keys.append((rows[2:][whole], three[whole]))
    row = np.concatenate([k[0] for k in keys]).astype(np.uint64)
    feature = np.concatenate([k[1] for k in keys]) >> np.uint64(64 - bits)
    both = distinct((row << np.uint64(bits)) | feature)
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 5) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss model by dual coordinate descent over indicators scaled by ``ratio``.

    Each text's vector has length one, so that long texts do not outweigh short ones.
    """
    w = np.zeros(len(ratio) + 1)
    alpha = np.zeros(len(rows))
    sizes = [max(np.sqrt((ratio[f] ** 2).sum()), 1e-9) for f in rows]
    order, draw = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        draw.shuffle(order)
        moved = 0.0
        for i in order:
            f, sign = rows[i], y[i]
            v = ratio[f] / sizes[i]
            gradient = sign * (w[f] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), cost)
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[f] += step * sign * v
                w[-1] += step * sign
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float) -> np.ndarray:
    p, q = np.full(size, smooth), np.full(size, smooth)
    for f, sign in zip(rows, y, strict=True):
        (p if sign > 0 else q)[f] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) fitted by Newton steps to smoothed targets."""
    good = (y > 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


class QualityModel:
    """Weights by feature, the bias, and the logistic curve's two numbers."""

    def __init__(self, weights: np.ndarray, ratio: np.ndarray, bias: float, curve: tuple[float, float], bits: int):
        self.weights, self.ratio, self.bias, self.curve, self.bits = weights.astype(np.float32), ratio.astype(np.float32), bias, curve, bits

    def margins(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, feature = indicators(raw, at, self.bits)
        n = len(at) - 1
        r = self.ratio[feature]
        dot = np.bincount(row, weights=self.weights[feature] * r, minlength=n)
        size = np.sqrt(np.bincount(row, weights=r * r, minlength=n))
        return dot / np.maximum(size, 1e-9) + self.bias

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.margins(raw, at) + b, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS, cost: float = COST, epochs: int = EPOCHS) -> QualityModel:
    """Fit the model on at most ``sample`` labelled texts, those of the lowest hash of the id; rows without a label are left out.

    Of repeated labels of an id the greatest holds. With labels of one class or none every text scores that class's share (or 0.5).
    """
    wanted = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("__lid")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("__label"))
    wanted = wanted.orderBy(F.xxhash64("__lid"), "__lid").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # At most ``sample`` ids: a bounded side.
    chosen = texts.join(F.broadcast(wanted), F.col("__id") == F.col("__lid")).select("__id", "__label", "text")

    def features(batches):
        for batch in slices(batches, "text"):
            raw, at = utf8(batch.column("text"))
            row, feature = indicators(raw, at, bits)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            blobs = [feature[first[k] : first[k + 1]].astype(np.int32).tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["id", "label", "features"])

    size = 1 << bits

    def fit(got: pa.Table) -> pa.Table:
        order = np.argsort(got.column("id").to_numpy(), kind="stable")
        blobs = got.column("features").combine_chunks()
        rows = [np.frombuffer(blobs[int(k)].as_buffer(), np.int32) for k in order]  # views: the sample is held once
        y = np.where(got.column("label").to_numpy()[order] > 0, 1.0, -1.0)
        weights, ratio, bias, curve = _fit_rows(rows, y, size, cost, epochs)
        return pa.table({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), "ratio": pa.array([ratio.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([bias]), "a": pa.array([curve[0]]), "b": pa.array([curve[1]])})

    # The sample's n-grams meet in one task, which is bounded by ``sample``; the driver gets the fitted weights alone.
    fitted = chosen.mapInArrow(features, "id long, label int, features binary").withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "weights binary, ratio binary, bias double, a double, b double").first()
    if fitted is None:
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, (1.0, 0.0), bits)
    return QualityModel(np.frombuffer(fitted.weights, np.float32), np.frombuffer(fitted.ratio, np.float32), fitted.bias, (fitted.a, fitted.b), bits)


def _fit_rows(rows: list[np.ndarray], y: np.ndarray, size: int, cost: float, epochs: int) -> tuple[np.ndarray, np.ndarray, float, tuple[float, float]]:
    """(weights, ratio, bias, curve) of texts given as their features, in an order that does not depend on partitions."""
    if len(set(y)) < 2:
        share = float(np.clip((y > 0).mean(), 0.01, 0.99))
        return np.zeros(size), np.zeros(size), 0.0, (1.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(y))
    folds = np.arange(len(y)) % 3
    for k in range(3):  # margins of texts that the fold's model has not seen, for the curve
        seen = np.flatnonzero(folds != k)
        if len(set(y[seen])) < 2:
            continue
        ratio = log_count_ratio([rows[i] for i in seen], y[seen], size, SMOOTH)
        w = fit_hinge([rows[i] for i in seen], y[seen], ratio, cost, epochs)
        for i in np.flatnonzero(folds == k):
            v = ratio[rows[i]]
            margins[i] = w[rows[i]] @ v / max(np.sqrt((v * v).sum()), 1e-9) + w[-1]
    curve = logistic_curve(margins, y)
    ratio = log_count_ratio(rows, y, size, SMOOTH)
    w = fit_hinge(rows, y, ratio, cost, epochs)
    return w[:-1], ratio, float(w[-1]), curve


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each row; null and empty texts score what the bias alone gives. Repeated rows give equal rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(*utf8(batch.column("text"))))], schema=schema)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    kind = docs.schema

    def keep(batches):
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(model.scores(*utf8(batch.column(text_col))) >= threshold))

    return docs.mapInArrow(keep, kind)
