"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes counts of its byte n-grams (one to three bytes of letters, other ASCII bytes as one space, A-Z in
lower case) in hashed buckets; counts are damped, weighed by inverse document frequency and normalised. Each language
has a few centroids from spherical k-means, and a text takes the language of the centroid with the largest cosine. A
text farther from it than the centroid's own documents is rejected in `accepted`.

Document frequencies come from all training rows. The centroids come from a bounded sample: of each language about
SAMPLE_PER_LANGUAGE distinct texts by a hash of the text. Every language has centroids, of 64 KB in the broadcast model.

Defined results: a null text, or one without a letter, is `und` with score 0 and not accepted; so is everything if there
are no training rows; ties go to the first language in order; rows are judged one by one; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evertally.llm import words as w
from evertally.llm.tables import in_training_part, small_side, written

UNDETERMINED = "und"
BUCKETS = 4096
MAX_NGRAM = 3
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 400
#: A text is rejected if its distance to the centroid is above this many times that of the farthest training texts.
REJECT_FACTOR = 1.25
ROWS = 512

LETTERS = w.ASCII_LOWER.copy()
LETTERS[:0x80][~np.array([chr(b).isalpha() for b in range(0x80)])] = 0x20


def counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Bucket counts of consecutive rows, a dense block at a time."""
    for _, data, offsets in w.text_slices(texts):
        letters = LETTERS[data].astype(np.uint32)
        for first in range(0, len(offsets) - 1, ROWS):
            bounds = offsets[first : first + ROWS + 1]
            rows = len(bounds) - 1
            own = letters[bounds[0] : bounds[-1]]
            row = np.repeat(np.arange(rows), np.diff(bounds))
            total = np.zeros(rows * BUCKETS, dtype=np.int64)
            gram = np.zeros(len(own), dtype=np.uint32)
            for length in range(1, MAX_NGRAM + 1):
                n = len(own) - length + 1
                if n <= 0:
                    break
                gram = (gram[:n] << np.uint32(8)) | own[length - 1 :]
                bucket = ((gram + np.uint32(length * 0x51ED270B)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
                inside = row[:n] == row[length - 1 :]
                total += np.bincount((row[:n] * BUCKETS + bucket)[inside], minlength=rows * BUCKETS)
            yield total.reshape(rows, BUCKETS)


def vectors(block: np.ndarray, weights: np.ndarray) -> np.ndarray:
    found = np.log1p(block.astype(np.float32)) * weights
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): texts of the task that hold each bucket; bucket -1 counts all."""
    found, rows = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        for block in counts(batch.column("text")):
            found += (block > 0).sum(axis=0)
    buckets = np.append(np.arange(BUCKETS), -1)
    yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.append(found, rows))], names=["bucket", "n"])


def _vectors(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base = 0
        for block in counts(batch.column("text")):
            found = list(vectors(block, weights))
            rows = batch.column("lang").slice(base, len(found))
            yield pa.RecordBatch.from_arrays([rows, pa.array(found, type=pa.list_(pa.float32()))], names=["lang", "vector"])
            base += len(found)


def cluster(points: np.ndarray, count: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, largest distance of their points) by spherical k-means from spread-out starting points."""
    chosen = [int(np.argmax(points @ points.mean(axis=0)))]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(np.argmin((points @ points[chosen].T).max(axis=1))))
    centroids = points[chosen]
    for _ in range(rounds):
        nearest = np.argmax(points @ centroids.T, axis=1)
        sums = np.stack([points[nearest == c].sum(axis=0) for c in range(len(centroids))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids).astype(np.float32)
    cosines = points @ centroids.T
    nearest = np.argmax(cosines, axis=1)
    distance = 1 - cosines.max(axis=1)
    return centroids, np.array([distance[nearest == c].max(initial=0.0) for c in range(len(centroids))])


def _centroids(rows: pd.DataFrame) -> pd.DataFrame:
    points = np.stack(rows["vector"].to_list()).astype(np.float32)
    centroids, radius = cluster(points, CENTROIDS)
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": list(centroids), "radius": radius})


@dataclass
class LanguageModel:
    weights: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    radius: np.ndarray

    def predict(self, block: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, whether it is near enough) per row."""
        cosines = vectors(block, self.weights) @ self.centroids.T
        best = np.argmax(cosines, axis=1)
        cosine = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(np.float64)
        return [self.languages[i] for i in best], cosine, 1 - cosine <= REJECT_FACTOR * self.radius[best]


def learned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """A model from the training part; None without any training row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter("text is not null and lang is not null").filter(in_training_part()).select("text", "lang")
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    # copies of a text are drawn together, so shares are of distinct texts
    texts = F.approx_count_distinct(F.xxhash64("text")).alias("texts")
    sizes = written(rows.groupBy("lang").agg(texts), "languages")
    languages = sizes.count()
    if not languages:
        return None
    found = rows.select("text").mapInArrow(_frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = {r["bucket"]: r["n"] for r in found.collect()}  # BUCKETS + 1 rows
    total = frequency.pop(-1)
    weights = np.array([np.log((1 + total) / (1 + frequency.get(b, 0))) + 1 for b in range(BUCKETS)], dtype=np.float32)
    # distinct texts whose hash is below the language's share
    share = F.least(F.lit(1.0), SAMPLE_PER_LANGUAGE / F.col("texts"))
    draw = F.xxhash64("text").cast("double") / 2.0**64 + 0.5
    sample = rows.join(small_side(sizes, languages), "lang").filter(draw < share).select("lang", "text").distinct()
    sample = sample.mapInArrow(partial(_vectors, weights=weights), "lang string, vector array<float>")
    clusters = sample.groupBy("lang").applyInPandas(_centroids, "lang string, centroid array<float>, radius double")
    best = written(clusters, "centroids").orderBy("lang", "centroid").collect()  # CENTROIDS rows a language
    if (found := len({r["lang"] for r in best})) < languages:
        raise RuntimeError(f"{languages - found} of {languages} languages have no centroid")
    centroids = np.array([r["centroid"] for r in best], dtype=np.float32)
    return LanguageModel(weights, [r["lang"] for r in best], centroids, np.array([r["radius"] for r in best]))


def _predicted(model, keep: list[str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column("lettered").to_pylist()
            languages, scores, accepted = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=bool)
            base = 0
            for block in counts(batch.column("text")) if model.value else ():
                found, cosine, near = model.value.predict(block)
                for row in range(len(found)):
                    if lettered[base + row]:
                        languages[base + row], scores[base + row], accepted[base + row] = found[row], cosine[row], near[row]
                base += len(found)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(languages, type=pa.string()), pa.array(scores), pa.array(accepted)],
                names=[*keep, "lang_pred", "score", "accepted"],
            )

    return predict


def identified(docs: DataFrame, model: LanguageModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score (cosine), accepted (the nearest centroid is near enough)."""
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), lettered)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predicted(shipped, ["doc_id"]), T.StructType([rows.schema["doc_id"], *fields]))
