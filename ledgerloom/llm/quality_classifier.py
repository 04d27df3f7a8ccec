"""A quality classifier that compresses: text is good if a dictionary of good text shortens it more.

Two zstandard dictionaries are trained on bounded samples of pieces of good and bad
labelled text. A document is compressed whole, in pieces, with either: the difference of
the sizes over their sum, a figure free of length, goes through a logistic curve fitted on
further labelled documents, weighted as the labels are spread, so scores are
probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, save, scratch

#: Documents of each label that dictionaries are trained on, and that the curve is fitted on, at most.
SAMPLE, CALIBRATION = 1000, 1000
#: Bytes of a dictionary, and of the pieces that texts are compressed in.
DICTIONARY, PIECE = 112 << 10, 512
#: Pieces of each label that reach the driver to train on, at most (4 MB).
PIECES = 8192


@dataclass
class Model:
    good: bytes
    bad: bytes
    #: Of the difference, and a constant.
    curve: tuple[float, float] = (0.0, 0.0)


class Sizes:
    def __init__(self, good: bytes, bad: bytes) -> None:
        self.pair = []
        for data in (good, bad):
            own = zstandard.ZstdCompressionDict(data)
            own.precompute_compress(level=3)
            self.pair.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False, write_checksum=False))

    def difference(self, text: str | None) -> float:
        """(bad - good) / (bad + good) of the compressed sizes; 0 for no text."""
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0
        good, bad = (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for c in self.pair)
        return (bad - good) / (bad + good)


def held_out(doc_id: str = "doc_id"):
    """The rows that fitting never sees: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:] or b" "


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and constant of the weighted logistic regression of y (0 or 1) on x, by Newton's method; the ridge is on x over its mean size."""
    weight = weight * len(y) / weight.sum()
    scale = max(float(np.abs(x).mean()), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        g = z.T @ (weight * (y - p)) - ridge * beta
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model:
    """A model from bounded samples, by a hash of doc_id, of the labelled rows that aren't held out.

    The driver gets PIECES pieces of each label and two numbers a calibration document.
    With only one label, or none, every document scores that label's share, or a half.
    """
    with scratch(docs.sparkSession):
        return _fit(docs, labels, sample, calibration)


def _fit(docs: DataFrame, labels: DataFrame, sample: int, calibration: int) -> Model:
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", "quality").distinct()
    by_hash = lambda v: known.where(F.col("quality") == v).orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(sample + calibration)
    picked = save(by_hash(0).union(by_hash(1)), "quality_sample")
    # 2 * (sample + calibration) ids at most
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").where("text is not null")
    texts = save(texts.select("doc_id", "quality", "text", (F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(sample + calibration)) < sample).alias("trains")), "quality_texts")
    n = {(r["quality"], r["trains"]): r["count"] for r in texts.groupBy("quality", "trains").count().collect()}
    of = {v: n.get((v, True), 0) + n.get((v, False), 0) for v in (0, 1)}
    if not (of[0] and of[1]):
        return Model(b" ", b" ", (0.0, 0.0 if not (of[0] or of[1]) else 4.0 if of[1] else -4.0))
    # a label with one half only is trained and calibrated on all it has
    trains = lambda v: F.lit(True) if not (n.get((v, True)) and n.get((v, False))) else F.col("trains")
    tests = lambda v: F.lit(True) if not (n.get((v, True)) and n.get((v, False))) else ~F.col("trains")
    data = F.col("text").cast("binary")
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / PIECE).cast("int")), lambda i: F.struct(i.alias("i"), F.substring(data, i * PIECE + 1, F.lit(PIECE)).alias("piece"))))
    pieces = lambda v: [bytes(r[0]) for r in texts.where((F.col("quality") == v) & trains(v)).select("doc_id", cut.alias("c")).orderBy(F.xxhash64("doc_id", "c.i"), "doc_id", "c.i", "c.piece").limit(PIECES).select("c.piece").collect()]
    good, bad = _dictionary(pieces(1)), _dictionary(pieces(0))

    def make():
        sizes = Sizes(good, bad)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([sizes.difference(t) for t in batch.column(1).to_pylist()], pa.float64())], ["quality", "x"])

        return step

    rows = map_rows(texts.where(F.when(F.col("quality") == 1, tests(1)).otherwise(tests(0))).select(F.col("quality").cast("int"), "text"), make, "quality int, x double").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["quality"]) for r in rows])
    spread = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    order = np.lexsort((x, y))  # sums don't depend on the order of rows
    weight = np.array([spread[int(v)] / (y == v).sum() for v in y[order]])
    return Model(good, bad, fit_curve(x[order], y[order], weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, over its whole text.

    Null and empty texts score what the curve gives without evidence; repeated rows get
    equal results; other columns are ignored; an empty table gives no rows.
    """

    def make():
        sizes = Sizes(model.good, model.bad)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([sizes.difference(t) for t in batch.column(2).to_pylist()], np.float64)
            p = 1 / (1 + np.exp(-np.clip(x * model.curve[0] + model.curve[1], -40, 40)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array(p >= 0.5).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")
