"""From raw documents to packed training sequences, in five stages.

Each stage takes the table that the one before it wrote and returns a DataFrame;
all but the last return the columns of documents.  Nulls, empty texts, repeated
rows, empty tables and extra columns are handled as the stages' operators state;
extra columns pass through to the last stage, which returns pieces.

What a stage froze is removed when the next one begins, as its rows have been
written by then: read a stage's result before calling another stage.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import decontam, packing, probminhash, quality, secrets
from meterline.functions.storage import delete, recorded
from meterline.llm.common import freeze, hide

#: Similarity of near duplicates and packing cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that stages before froze, per application.
_frozen: dict[str, list[str]] = {}


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        # A caller that hands on a result without writing it still needs what that was made of.
        inputs = docs.inputFiles() if _frozen.get(app) else []
        left = [p for p in _frozen.get(app, []) if any(f"{p}/" in name for name in inputs)]
        for path in set(_frozen.pop(app, [])) - set(left):
            delete(spark, path)
        with recorded() as paths:
            rows = function(spark, docs, sf_dir)
        _frozen[app] = [*left, *paths]
        return rows

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the limits of their language and source."""
    hidden, shown = hide(docs, ("doc_id", "text", "lang", "source"))
    measured = freeze(quality.with_measures(hidden), "quality-measured")
    return quality.judge(measured).where("kept").select(*shown)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the least doc_id, then the first row."""
    hidden, shown = hide(docs, ("doc_id", "text"))
    rows = freeze(hidden.withColumn("row", F.monotonically_increasing_id()), "near-texts")
    classes = freeze(probminhash.near_duplicates(rows.select("row", "text")), "near-classes")
    first = classes.join(rows.select("row", "doc_id"), "row").groupBy("class_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("first")
    )
    # A bit per row, so that the side that the texts meet is small enough to leave them where they are.
    word, bit = F.shiftright("row", 6).alias("_word"), F.expr("CAST(row & 63 AS INT)")
    kept = first.select(F.col("first.row").alias("row")).groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, CAST(row & 63 AS INT))")).alias("_bits"))
    marked = rows.select("*", word).join(freeze(kept, "near-kept"), "_word")
    return marked.where(F.getbit("_bits", bit) == 1).select(*shown)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; documents that consist of them mostly go as a whole."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, linked weak ones included, are replaced by a mark."""
    hidden, shown = hide(docs, ("doc_id", "text"))
    rows = freeze(hidden.withColumn("_row", F.monotonically_increasing_id()), "secret-texts")
    found = freeze(secrets.all_spans(rows.select("_row", "text"), "_row").where(F.size("spans") > 0).select("_row", "spans"), "secret-found")
    joined = rows.join(found, "_row", "left")
    fixed = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.redact("text", "spans"))
    return joined.withColumn("text", fixed).select(*shown)


@_stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids placed in sequences of at most 1024."""
    from public_tokenizers import path

    pieces = packing.with_sequence_ids(packing.pack(docs, path("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        with recorded() as written:
            docs = freeze(rows, "stage-" + name.replace(" ", "-"))
        for path in before:  # the table that this stage has read
            delete(spark, path)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
