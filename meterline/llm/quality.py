"""Quality rules with thresholds read from the data.

Each text gives whole-number features.  Per language and source a mergeable
histogram sketch counts them in buckets of bounded relative width (a value is
kept exactly below 64 and to five leading bits above), so partial sketches add
up in any order and give the same quantiles on every run.  A group with too few
texts is judged by the merged sketch of its language, then by that of all texts.
Only texts that pass the base rule are sketched, since only they are judged.
A feature fails where it lies beyond the upper quartile by ``spread`` times the
distance of the quartiles, beyond twice the median, and beyond what ``oddities``
single symbols, repeated lines or repeated windows make in a text of the group's
median length, whichever is furthest.  The last keeps a group whose texts mostly
have none from losing those that have a few; it too comes from the group's
sketch, so no limit is a fixed number.

Nulls: a null text has no words and fails the base rule.  Null languages and
sources form groups of their own.  Repeated rows are judged one by one, ties
with a limit are kept.  Very long texts are measured whole, one at a time in a
batch.  Empty tables give no rows.  Extra columns pass through; one named like a
result is replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, freeze, hash_words, shingle_hashes

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features that are judged, each in whole thousandths (repeated lines in ten-thousandths).
RATES = ["symbol_rate", "dup_rate", "repeat_rate", "length_rate"]
RESULTS = [*BASE, "base_failed", "kept"]
_SPACE = [chr(c) for c in (0x20, 9, 10, 11, 12, 13)]


@dataclass(frozen=True)
class Rules:
    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    #: Texts that a (language, source) sketch needs before it is used.
    least_texts: int = 50
    #: Distances of the quartiles above the upper quartile that are still kept.
    spread: int = 6
    #: Single oddities that a text of the group's median length may have.
    oddities: int = 12


def measure(text: str | None, window: int = 8) -> tuple[int, int, int, int, int]:
    """The base counts of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    symbols = sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeats = 0
    if len(words) > window:
        runs = shingle_hashes(hash_words(words), window)
        ordered = np.sort(runs)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(runs, twice))
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            repeats = int((np.cumsum(edge) > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def with_measures(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the base counts; texts are measured whole, batch by batch."""
    docs = docs.drop(*RESULTS, *RATES)
    window = rules.window

    @F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in BASE]))
    def counts(text):
        import pandas as pd

        return pd.DataFrame([measure(x if isinstance(x, str) else None, window) for x in text], columns=BASE)

    return docs.withColumn("_m", counts("text")).select(*docs.columns, *[F.col(f"_m.{c}").alias(c) for c in BASE])


def _rate(part: str, whole: str):
    return F.expr(f"CASE WHEN {whole} > 0 THEN {part} * 1000 DIV {whole} ELSE 0 END")


def _with_rates(measured: DataFrame, rules: Rules) -> DataFrame:
    return measured.select(
        "*",
        _rate("n_symbols", "n_words").alias("symbol_rate"),
        _rate("n_dup_lines * 10", "n_words").alias("dup_rate"),
        _rate("n_repeat_words", "n_words").alias("repeat_rate"),
        _rate("word_chars", "n_words").alias("length_rate"),
        F.expr(f"n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words").alias("base_failed"),
    )


def sketch(rated: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n): counts that merge by addition.

    Features are numbered as in ``RATES``; the number of words follows them.
    """
    long = rated.filter("NOT base_failed").select(
        "lang", "source", F.explode(F.expr("array(" + ", ".join(f"named_struct('f', {i}, 'v', {c})" for i, c in enumerate([*RATES, "n_words"])) + ")")).alias("x")
    ).select("lang", "source", F.col("x.f").alias("feature"), F.expr(
        "CASE WHEN x.v < 64 THEN x.v ELSE shiftleft(shiftright(x.v, length(bin(x.v)) - 6), length(bin(x.v)) - 6) END"
    ).alias("bucket"))
    return long.groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))


def _quartiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Lower, middle and upper quartile and size of each sketch in ``merged``."""
    by = [*keys, "feature"]
    cells = merged.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    listed = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"), F.sum("n").alias("total"))

    def at(quarter: int):
        return f"""aggregate(cells, named_struct('seen', 0L, 'value', CAST(NULL AS BIGINT)),
            (a, c) -> named_struct('seen', a.seen + c.n, 'value',
                IF(a.value IS NULL AND (a.seen + c.n) * 4 >= total * {quarter}, c.bucket, a.value)), a -> a.value)"""

    return listed.selectExpr(*by, "total", *[f"{at(q)} AS q{q}" for q in (1, 2, 3)])


def thresholds(cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The limit of every feature for each (lang, source) with a text that passes the base rule.

    The number of buckets in a sketch is bounded (under 600 for any 64-bit value
    at this width), so each list above is bounded too.
    """
    fine, mid, coarse = (_quartiles(cells, k) for k in (["lang", "source"], ["lang"], []))
    keys = ["total", "q1", "q2", "q3"]
    mid = mid.select(F.col("lang").alias("lang_m"), F.col("feature").alias("feature_m"), F.struct(*keys).alias("m"))
    coarse = coarse.select(F.col("feature").alias("feature_c"), F.struct(*keys).alias("c"))
    joined = (
        fine.select("lang", "source", "feature", F.struct(*keys).alias("f"))
        .join(mid, F.col("lang").eqNullSafe(F.col("lang_m")) & (F.col("feature") == F.col("feature_m")))
        .join(coarse, F.col("feature") == F.col("feature_c"))
        .withColumn("use", F.when(F.col("f.total") >= rules.least_texts, F.col("f"))
                    .when(F.col("m.total") >= rules.least_texts, F.col("m")).otherwise(F.col("c")))
    )
    sizes = joined.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("feature") == i, F.col("use"))).alias(f"u{i}") for i in range(len(RATES) + 1)]
    )
    usual = f"u{len(RATES)}.q2"
    # What one symbol, repeated line or repeated window adds to its feature, times the words of the text.
    units = (1000, 10_000, 1000 * rules.window, 0)
    return sizes.select("lang", "source", *[
        F.expr(f"greatest(u{i}.q3 + {rules.spread} * (u{i}.q3 - u{i}.q1), 2 * u{i}.q2, {rules.oddities * unit}L DIV greatest({usual}, 1))")
        .alias(f"most_{c}")
        for i, (c, unit) in enumerate(zip(RATES, units))
    ])


def judge(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``measured`` with rates, limits, ``base_failed`` and ``kept``.

    Pass a frozen table: it is read for the sketches and again for the verdict.
    The table of limits is frozen too, so that its true size decides whether the
    join broadcasts it.
    """
    rated = _with_rates(measured, rules)
    limits = freeze(thresholds(sketch(rated), rules), "quality-limits").select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"most_{c}" for c in RATES]
    )
    beyond = " OR ".join(f"{c} > most_{c}" for c in RATES)
    return rated.join(
        limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    ).drop("_lang", "_source").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.expr(beyond), F.lit(False)))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    measured = freeze(with_measures(docs).drop("text"), "quality-measures")
    return judge(measured).select("doc_id", *RESULTS)
