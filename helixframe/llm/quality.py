"""Quality of texts by compression: zstandard dictionaries of good and of bad labelled text, and how much smaller each makes a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held
from .langid import held_out

#: Texts are compressed block by block, so that a long text's own repeats don't replace the dictionary.
BLOCK_BYTES, LEVEL = 1024, 3
DICTIONARY_BYTES = 32768
#: Bounds of what is learned from: documents of a class for its dictionary, blocks of each, documents of a class for calibration.
DICTIONARY_DOCS, BLOCKS_PER_DOC, CALIBRATION_DOCS = 1500, 4, 2000
#: A text of so many bytes tells half as much as a very long one.
HALF_BYTES = 32.0
#: Strength of the pull of the calibration's weights to zero, in rows.
RIDGE = 1e-2
_MANY = 1_000_003


def _parameters() -> zstandard.ZstdCompressionParameters:
    """Frames without header fields: what is left is what the text takes."""
    return zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples' most useful parts; of too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Compressors:
    """Sizes of a text after each of two dictionaries (bad, good)."""

    def __init__(self, bad: bytes, good: bytes):
        self.own = []
        for raw in (bad, good):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(compression_params=_parameters())
            self.own.append(zstandard.ZstdCompressor(compression_params=_parameters(), dict_data=d))

    def difference(self, text: bytes) -> float:
        """By how much the good dictionary makes the whole text smaller than the bad one does, as a share of the text."""
        if not text:
            return 0.0
        bad, good = (sum(len(c.compress(b)) for b in blocks(text)) for c in self.own)
        return (bad - good) / len(text)


def _features(difference: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the calibration weighs: one, how much the text can tell, and that times the difference."""
    tells = size / (size + HALF_BYTES)
    return np.stack((np.ones(len(size)), tells, tells * difference), axis=1)


@dataclass
class QualityModel:
    """Two dictionaries and the weights of the calibration. Without both classes ``dictionaries`` is None and the first weight tells alone."""

    dictionaries: tuple[bytes, bytes] | None
    weights: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        size, x = np.array([len(t) for t in texts], float), np.zeros(len(texts))
        if self.dictionaries:
            compressors = held("quality", self.dictionaries, lambda: Compressors(*self.dictionaries))
            x = np.array([compressors.difference(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(_features(x, size) @ self.weights, -40, 40)))


def calibrated(difference: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps. Documents count by ``weight``, so that drawn classes have the shares of all labelled ones."""
    f = _features(difference, size)
    scale = np.maximum(np.sqrt((f * f * weight[:, None]).sum(axis=0) / weight.sum()), 1e-9)
    f, w = f / scale, np.zeros(f.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -40, 40)))
        slope = f.T @ (weight * (label - p)) - RIDGE * w
        step = np.linalg.solve((f * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ f + RIDGE * np.eye(len(w)), slope)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some blocks of each text, evenly from all of it."""
    for b in batches:
        out = []
        for q, rank, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            own = blocks(t.as_py())
            out += [(q, rank, own[i]) for i in np.unique(np.linspace(0, len(own) - 1, BLOCKS_PER_DOC).round().astype(int)).tolist()] if own else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["quality", "rank", "block"])


def _measured(batches: Iterator[pa.RecordBatch], dictionaries: tuple[bytes, bytes]) -> Iterator[pa.RecordBatch]:
    compressors = held("quality", dictionaries, lambda: Compressors(*dictionaries))
    for b in batches:
        texts = [t.as_py() for t in b.column(2)]
        told = [pa.array([compressors.difference(t) for t in texts], pa.float64()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *told], names=["quality", "rank", "difference", "size"])


def _drawn(labels: DataFrame, part: int, most: int, n: dict) -> Column:
    """The labels of one part whose ids hash lowest: ``most`` of each class, and a few more for the draw's chance."""
    taken = F.lit(False)
    for quality in (0, 1):
        share = min(1.0, (most + 4 * most**0.5 + 10) / max(1, n.get((quality, part), 0)))
        taken = taken | ((F.col("quality") == quality) & (F.pmod("rank", F.lit(_MANY)) < int(share * _MANY) + 1))
    return taken & (F.col("part") == part)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A model of the labels 0 and 1 in ``label_col``; other labels, null ids and ids with both labels teach nothing.

    Half of the labelled documents, by a hash of the id, are for the dictionaries, the others for the calibration; of each at
    most DICTIONARY_DOCS and CALIBRATION_DOCS a class are drawn, those whose ids hash lowest. Only their ids are joined with
    the documents, so texts stay where they are read. Of documents that repeat an id the least text counts; null texts teach
    nothing. Dictionaries see BLOCKS_PER_DOC blocks from all over a text, the calibration whole texts. Without rows of both
    classes the score is their share of ones, without rows at all 0.5.
    """
    seen = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("quality")).filter(F.col("_id").isNotNull() & F.col("quality").isin(0, 1))
    rank = F.xxhash64("_id", F.lit("quality"))
    known = seen.groupBy("_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter(F.col("quality") == F.col("most")).select("_id", "quality", F.shiftright(rank, 8).alias("rank"), F.pmod(rank, F.lit(2)).cast("int").alias("part"))
    n = {(r["quality"], r["part"]): r["n"] for r in known.groupBy("quality", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = [sum(n.get((q, part), 0) for part in (0, 1)) for q in (0, 1)]
    prior = QualityModel(None, np.array([np.log((total[1] + 0.5) / (total[0] + 0.5)) if sum(total) else 0.0, 0.0, 0.0]))
    if not all(total):
        return prior

    def drawn(part: int, most: int) -> DataFrame:
        ids = F.broadcast(known.filter(_drawn(known, part, most, n)).select("_id", "quality", "rank"))
        texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(ids, "_id")
        return texts.groupBy("_id", "quality", "rank").agg(F.min("text").alias("text")).select("quality", "rank", F.encode("text", "UTF-8").alias("text"))

    samples: dict[int, dict] = {0: {}, 1: {}}
    for r in drawn(0, DICTIONARY_DOCS).mapInArrow(_sampled, "quality int, rank long, block binary").collect():
        samples[r["quality"]].setdefault(r["rank"], []).append(bytes(r["block"]))
    lowest = lambda own, most: sorted(own, key=lambda k: (k % _MANY, k))[:most]
    if not all(samples.values()):
        return prior
    both = tuple(dictionary([b for k in lowest(samples[q], DICTIONARY_DOCS) for b in sorted(samples[q][k])]) for q in (0, 1))
    rows: dict[int, dict] = {0: {}, 1: {}}
    for r in drawn(1, CALIBRATION_DOCS).mapInArrow(partial(_measured, dictionaries=both), "quality int, rank long, difference double, size long").collect():
        rows[r["quality"]][r["rank"]] = (r["difference"], r["size"])
    taken = [[rows[q][k] for k in lowest(rows[q], CALIBRATION_DOCS)] for q in (0, 1)]
    if not all(taken):
        return prior
    x, size = np.array(taken[0] + taken[1], float).T
    label = np.repeat([0.0, 1.0], [len(t) for t in taken])
    weight = np.repeat([total[q] / len(taken[q]) for q in (0, 1)], [len(t) for t in taken])
    return QualityModel(both, calibrated(x, size, label, weight * len(label) / weight.sum()))


def quality_of(text: Column, model: QualityModel) -> Column:
    """The score (0 to 1) of each whole text, however long; null texts count as empty ones."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score([t.as_py() for t in texts]), pa.float64())

    return score(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` with ``quality_score``, ``quality_predicted`` (1 from ``threshold`` on) and ``in_held_out``; held-out ids teach nothing.

    Rows stay as they are and in number, but columns of these three names are replaced; repeated rows are scored each, null
    ids are not held out, an empty table gives no rows.
    """
    model = fit(docs, labels.filter(~held_out(F.col(id_col), folds, fold)), id_col, text_col, label_col)
    scored = docs.withColumns({"quality_score": quality_of(F.col(text_col), model), "in_held_out": held_out(F.col(id_col), folds, fold)})
    return scored.withColumn("quality_predicted", (F.col("quality_score") >= threshold).cast("int"))
