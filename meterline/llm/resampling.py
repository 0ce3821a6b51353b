"""Target-distribution importance resampling over hashed n-grams.

Every text is a bag of hashed runs of one and two words.  Bucket counts of the
source and of the target, arrays of ``buckets`` longs, give each bucket a gain
(the scaled log ratio of its smoothed shares); a document's weight is the mean
gain of its features, read from the array.  A Gumbel number from the document's
id is added to the weight, and the highest scores are drawn: a sample without
replacement in proportion to the ratio.  Ranks come from a distributed LSD radix
sort over (score descending, doc_id ascending).

Cases: null and empty texts have no features and weight 0; a null doc_id counts
as '' in the draw and comes after all others in ties; rows equal in score and id
keep the order of their row number, so repeated rows get different ranks; an
empty source or target leaves only the smoothing; texts of any length are read
whole; extra columns are not touched.  Counts are summed per task before the
shuffle; only the gains (``buckets`` numbers) and one row of bounds reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, documents, freeze
from .radix import radix_ranks


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    seed: int = 7
    least_words: int = 20
    #: Share of the documents long enough that is drawn, in percent.
    percent: int = 25


class _Crcs(dict):
    """(crc of a word, crc of the word and a space), kept while they are few; clearing it changes no result."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= 300_000:
            self.clear()
        value = crc32(word)
        pair = self[word] = (value, crc32(b" ", value))
        return pair


_CRCS = _Crcs()


def feature_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    """Buckets of all single words, then of all pairs; a pair's crc goes on from that of its first word and a space."""
    if not words:
        return np.zeros(0, np.int64)
    ones, fronts = zip(*map(_CRCS.__getitem__, words), strict=True)
    n = len(words)
    out = np.empty(2 * n - 1, np.int64)
    out[:n] = ones
    out[n:] = np.fromiter(map(crc32, words[1:], fronts), np.int64, n - 1)
    return out % buckets


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of all features of ``texts`` (text).  Each task sends one array of sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total += np.bincount(feature_buckets(alnum_words(text.as_py()), buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Gain of each bucket; the collected table has at most ``buckets`` rows."""
    both = bucket_counts(source, settings.buckets).withColumnRenamed("n", "s").join(
        bucket_counts(target, settings.buckets).withColumnRenamed("n", "t"), "bucket", "full"
    )
    counts = np.zeros((2, settings.buckets), np.int64)
    for row in both.collect():
        counts[:, row.bucket] = row.s or 0, row.t or 0
    (s_all, t_all), size = counts.sum(axis=1).tolist(), settings.buckets
    return np.array([
        math.floor(1000.0 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in counts.T.tolist()
    ], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, table: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of ``docs`` (row, doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 8 bytes a bucket
    schema = "row long, doc_id long, n_words long, n_features long, weight long, score long"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, batch.column("text"), strict=True):
                words = alnum_words(text.as_py())
                found = feature_buckets(words, settings.buckets)
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                out.append((len(words), len(found), weight, weight + gumbel(doc_id, settings.seed)))
            cells = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *[pa.array(cells[:, k]) for k in range(4)]],
                names=["row", "doc_id", "n_words", "n_features", "weight", "score"],
            )

    return docs.select("row", F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(score, schema)


def ranks(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, rank) of the rows that are drawn, from ``rows`` as ``scored`` gives them (frozen)."""
    long_enough = rows.where(F.col("n_words") >= settings.least_words)
    bounds = long_enough.agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("most"), F.min("score").alias("least"),
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    if not bounds.n:
        return rows.where("false").select("row", F.lit(None).cast("long").alias("rank"))
    first, last = (0, 0) if bounds.first is None else (bounds.first, bounds.last)
    # Ids count from the least one where the difference fits; else with the sign bit turned, as unsigned numbers.
    near = last - first < 1 << 62
    offset = F.col("doc_id") - F.lit(first) if near else F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))
    keyed = long_enough.select(
        "row", F.col("row").alias("position"), F.coalesce(offset, F.lit(0)).cast("long").alias("by_id"),
        F.col("doc_id").isNull().cast("long").alias("by_null"), (F.lit(bounds.most) - F.col("score")).alias("by_score"),
    )
    widths = [(last - first).bit_length() if near else 64, 1 if bounds.nulls else 0, (bounds.most - bounds.least).bit_length()]
    ranked = radix_ranks(keyed, ["by_id", "by_null", "by_score"], widths)
    drawn = settings.percent * bounds.n // 100
    return ranked.where(F.col("position") < drawn).select("row", (F.col("position") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (row, doc_id, text); rank is null if not drawn."""
    rows = freeze(scored(docs, gains(docs, target, settings), settings), "resampling-scores")
    return rows.join(ranks(rows, settings), "row", "left")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("row", F.monotonically_increasing_id())
    drawn = resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
