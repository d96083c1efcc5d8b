"""Quality classifier by compression.

Two zstandard dictionaries are trained, from texts labelled good and from texts
labelled bad.  A text is compressed whole with either; the difference of the
two sizes, normalised by the text's, is calibrated to the probability of the
label 1 by logistic regression on labelled texts that the dictionaries have not
seen.  The regression also gets the text's length and its plain compressed
share, without which the difference of a short or a highly repetitive text
can't be read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the training sample: labelled texts of each class (the larger class may have more for calibration), and the bytes of one.
SAMPLE_BAD, SAMPLE_GOOD, SAMPLE_TEXT_BYTES = 2_500, 5_000, 1 << 16
#: Bytes of the sample's texts together.
SAMPLE_BYTES = 96 << 20
#: Texts of each class for its dictionary, at most, and as a share of the class where it is small.
DICT_TEXTS, DICT_SHARE = 1_500, 0.6
DICT_BYTES, LEVEL = 112 << 10, 6


def _dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts, level=LEVEL)
    except zstandard.ZstdError:  # too few texts to train from: their own bytes are the dictionary
        return zstandard.ZstdCompressionDict((b"\n".join(texts) or b"\n" * 8)[-DICT_BYTES:].rjust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@dataclass
class QualityModel:
    """Dictionaries and weights; small enough to go with each task."""

    bad: bytes
    good: bytes
    raw: tuple[bool, bool]
    mean: list[float]
    scale: list[float]
    weights: list[float]

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if "_made" not in self.__dict__:
            made = []
            for data, raw in zip((self.bad, self.good), self.raw, strict=True):
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
            self.__dict__["_made"] = made
        return self.__dict__["_made"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def features(self, text: str) -> list[float]:
        data = text.encode("utf-8", "surrogatepass")
        by_bad, by_good = (len(c.compress(data)) for c in self._compressors())
        n = len(data)
        gap = (by_bad - by_good) / max(n, 1)
        return [gap, (by_bad - by_good) / (n + 40), float(np.log1p(n)), gap * float(np.log1p(n)), min(by_bad, by_good) / max(n, 1)]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = (np.array([self.features(t) for t in texts]) - self.mean) / self.scale
        z = np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_quality(bad: list[str], good: list[str], prior_good: float) -> QualityModel:
    """Fit on distinct texts; ``prior_good`` is the share of good ones among all labelled rows."""
    bad, good = list(dict.fromkeys(bad)), list(dict.fromkeys(good))
    parts, rest = [], []
    for texts in (bad, good):
        k = min(DICT_TEXTS, int(len(texts) * DICT_SHARE))
        parts.append([t.encode("utf-8", "surrogatepass") for t in texts[:k] if t])
        rest.append(texts[k:])
    dicts = [_dictionary(p) for p in parts]
    raw = tuple(d.as_bytes()[:4] != b"\x37\xa4\x30\xec" for d in dicts)
    model = QualityModel(dicts[0].as_bytes(), dicts[1].as_bytes(), raw, [0.0] * 5, [1.0] * 5, [0.0] * 6)
    prior_good = min(max(prior_good, 1e-3), 1 - 1e-3)
    model.weights[0] = float(np.log(prior_good / (1 - prior_good)))
    if not rest[0] or not rest[1]:  # one class is missing: nothing can be told, the prior stands
        return model
    x = np.array([model.features(t) for t in rest[0] + rest[1]])
    y = np.array([0.0] * len(rest[0]) + [1.0] * len(rest[1]))
    weight = np.where(y == 1, prior_good / len(rest[1]), (1 - prior_good) / len(rest[0])) * len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [0.3] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(model.bad, model.good, raw, mean.tolist(), scale.tolist(), w.tolist())


def in_held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from the rows of ``labels`` that aren't held out, on a bounded sample.

    The sample is drawn from the labels alone (a hash of the id orders them), so
    at most SAMPLE_BAD + SAMPLE_GOOD ids are sent to the executors and as many
    texts, each of SAMPLE_TEXT_BYTES and all of SAMPLE_BYTES at most, to the
    driver.  Of rows that share an id one is taken, the least text.  Null
    labels, labels other than 0 and 1 and labels without a document are left
    out; without any label every score is 0.5.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(~in_held_out("id"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    texts: dict[int, list[str]] = {0: [], 1: []}
    if counts:
        order = F.xxhash64(F.col("id"), F.lit("sample"))
        ids = None
        for label, most in ((0, SAMPLE_BAD), (1, SAMPLE_GOOD)):
            part = known.filter(F.col("label") == label).orderBy(order, "id").limit(most)
            ids = part if ids is None else ids.unionByName(part)
        rows = (
            docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .filter(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
            .join(F.broadcast(ids), "id")
            .groupBy("id", "label")
            .agg(F.min("text").alias("text"))
        )
        # rows for SAMPLE_BAD + SAMPLE_GOOD ids at most
        upto = F.sum(F.octet_length("text")).over(Window.orderBy(order, "id", "label").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("upto", upto).filter(F.col("upto") <= SAMPLE_BYTES).select("id", "label", "text")
        for _, label, text in sorted(map(tuple, rows.collect())):
            texts[label].append(text)
        shuffle = np.random.default_rng(7)
        texts = {k: [v[i] for i in shuffle.permutation(len(v))] for k, v in texts.items()}
    total = sum(counts.values())
    return fit_quality(texts[0], texts[1], counts.get(1, 0) / total if total else 0.5)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score (double, 0 to 1) for every row; null text counts as empty, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


def filter_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``threshold``."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([t.as_py() or "" for t in batch.column(at)])
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, schema)
