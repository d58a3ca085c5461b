"""Language identification by the nearest of several TF-IDF n-gram centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, release

DIMENSIONS = 4096
#: Bounds of the sample that the centroids are fitted on: documents a language, and in all.
SAMPLE_PER_LANGUAGE, SAMPLE_IN_ALL = 600, 6000
CLUSTERS, ROUNDS = 4, 12
#: A document is rejected below this share of the cosine that all but this part of the fitted documents reach.
MARGIN, ODD = 0.5, 0.02
#: Texts of fewer n-grams are measured by a cosine that shrinks with the root of their number, as short texts' cosines do.
FULL_NGRAMS = 400
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are no letters count as blanks.
_BLANKS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of a lower-cased text's byte bigrams and trigrams."""
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split()) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    return np.bincount(two >> shift, minlength=DIMENSIONS) + np.bincount(three >> shift, minlength=DIMENSIONS)


def expected(counts: np.ndarray) -> np.ndarray:
    """The share of a long text's cosine that texts with these counts come to."""
    return np.minimum(1.0, np.sqrt(counts.sum(axis=1, dtype=float) / FULL_NGRAMS))


@dataclass
class LanguageModel:
    """languages: one name a centroid; centroids: unit rows; reject: a centroid's least cosine for long texts."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    reject: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and self.languages and _LETTER.search(t)]
        for at in range(0, len(known), 256):
            part = known[at : at + 256]
            counts = np.stack([ngram_counts(texts[i]) for i in part])
            cosines = self.vectors(counts) @ self.centroids.T
            for i, k, row, share in zip(part, cosines.argmax(axis=1).tolist(), cosines, expected(counts), strict=True):
                names[i], scores[i], rejected[i] = self.languages[k], float(min(1.0, max(0.0, row[k]))), bool(row[k] < self.reject[k] * share)
        return names, scores, rejected


def spherical_means(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means by cosine, started from the vectors farthest from those chosen before."""
    chosen = [int((vectors @ vectors.sum(axis=0)).argmax())]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(axis=1).argmin()))
    centroids = vectors[chosen].copy()
    for _ in range(rounds):
        near = (vectors @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (near == c).any():
                centroids[c] = vectors[near == c].sum(axis=0)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
    return centroids


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [ngram_counts(x.as_py()).astype("<u4").tobytes() for x in b.column(2)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(counts, pa.binary())], names=["lang", "rank", "counts"])


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, in_all: int = SAMPLE_IN_ALL, clusters: int = CLUSTERS) -> LanguageModel:
    """A model of the languages named in ``docs``; rows with a null or letterless text, or a null language, teach nothing.

    Texts are whole; at most ``per_language`` documents a language and ``in_all`` in all, those whose keys and texts hash
    lowest, are vectorised on the executors and clustered here; rows that repeat key and text are one of them. Ties and
    their order don't matter. Without usable rows the model knows no language.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(key_col), F.col(text_col)).alias("rank"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(1, min(per_language, in_all // max(1, len(sizes))))
    if not sizes:
        return LanguageModel([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros(0))
    drawn = F.lit(False)
    for lang, n in sizes.items():
        share = min(1.0, (most + 4 * most**0.5 + 10) / n)
        drawn = drawn | ((F.col("lang") == F.lit(lang)) & (F.pmod("rank", F.lit(1_000_003)) < int(share * 1_000_003) + 1))
    taken: dict[str, list] = {}
    for r in rows.filter(drawn).dropDuplicates(["lang", "rank"]).mapInArrow(_counted, "lang string, rank long, counts binary").collect():
        taken.setdefault(r["lang"], []).append((r["rank"] % 1_000_003, bytes(r["counts"])))
    counts = {lang: np.stack([np.frombuffer(c, "<u4") for _, c in sorted(own)[:most]]) for lang, own in sorted(taken.items())}
    n = sum(map(len, counts.values()))
    idf = (np.log((1 + n) / (1 + sum((c > 0).sum(axis=0) for c in counts.values()))) + 0.1).astype(np.float32)
    model = LanguageModel([], np.zeros((0, DIMENSIONS), np.float32), idf, np.zeros(0))
    names, centroids, reject = [], [], []
    for lang, c in counts.items():
        v = model.vectors(c)
        own = spherical_means(v, clusters)
        names += [lang] * len(own)
        centroids.append(own)
        reject += [MARGIN * float(np.quantile((v @ own.T).max(axis=1) / expected(c), ODD))] * len(own)
    return LanguageModel(names, np.concatenate(centroids), idf, np.array(reject))


def language_of(text: Column, model: LanguageModel) -> Column:
    """struct<lang, score, rejected> of each text, by the model's nearest centroid.

    Texts are read whole, however long; of centroids that tie the first, by language name, tells.
    ``lang`` is ``und`` where the text is null or has no letter, or nothing was learned. ``rejected`` marks those and texts
    farther from every centroid than fitted documents are.
    """

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        held("langid", None, dict)
        names, scores, rejected = [], [], []
        for at in range(0, len(texts), 256):
            for own, more in zip((names, scores, rejected), model.predict(texts.slice(at, 256).to_pylist()), strict=True):
                own += more
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"])

    return predict(text)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``lang_id`` (struct<lang, score, rejected>) and ``in_held_out``, learned from the rows not held out.

    Rows are kept as they are and in number, but columns of these two names are replaced; null ids are not held out. An
    empty table gives no rows.
    """
    model = fit(docs.filter(~held_out(F.col(id_col), folds)), lang_col, text_col, id_col)
    return docs.withColumns({"lang_id": language_of(F.col(text_col), model), "in_held_out": held_out(F.col(id_col), folds)})
