"""Paired comparison of agent runs with and without the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _list(*fields: tuple[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


_S, _D = T.StringType(), T.DoubleType()
RUNS = T.StructType(
    [
        *(T.StructField(n, _S) for n in ("id", "question_id", "question", "mode", "started_at", "completed_at")),
        T.StructField("tool_calls", _list(("name", _S), ("output_chars", _D))),
        T.StructField("direct_file_reads", _list(("path", _S), ("chars", _D))),
        T.StructField("text_searches", _list(("query", _S), ("result_count", _D))),
        T.StructField("graph_calls", _list(("tool", _S), ("query", _S), ("result_count", _D), ("chars", _D))),
        T.StructField("final_citations", _list(("path", _S), ("line", T.IntegerType()), ("correct", _S))),
        T.StructField("raw_file_fallback", T.BooleanType()),
        *(T.StructField(n, _D) for n in ("token_estimate", "character_budget", "latency_ms")),
        T.StructField("notes", T.ArrayType(_S)),
    ]
)
METRICS = ("tool_calls", "tool_output_chars", "file_reads", "file_chars", "text_searches", "graph_calls", "graph_chars", "citations", "correct_citations", "known_citations", "citation_rate", "fallback", "token_estimate", "character_budget", "latency_ms")
RATES = ("citation_rate",)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).json(path, multiLine=True)


def invalid_runs(runs: DataFrame) -> DataFrame:
    """id, problem of records that lack a field or hold a value out of range."""
    bad = [
        (F.coalesce(F.trim("id"), F.lit("")) == "", "id is missing"),
        (F.coalesce(F.trim("question_id"), F.lit("")) == "", "question_id is missing"),
        (F.coalesce(F.trim("question"), F.lit("")) == "", "question is missing"),
        (~F.coalesce(F.col("mode"), F.lit("")).isin("with", "without"), "mode must be with or without"),
        *((F.col(n) < 0, f"{n} is negative") for n in ("token_estimate", "character_budget", "latency_ms")),
    ]
    return runs.select("id", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(text)) for test, text in bad)))).alias("problem"))


def _total(items: str, field: str) -> Column:
    return F.aggregate(F.transform(F.filter(items, lambda x: x[field].isNotNull()), lambda x: x[field]), F.lit(0.0), lambda a, x: a + x)


def run_metrics(runs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row per run with METRICS. expected: question_id, paths of questions whose sources are known.

    A citation is correct by the expected paths where they are known, else by its own flag;
    flags that say neither are left out of the rate, which is null if none is known.
    """
    rows = runs.join(expected.select("question_id", F.col("paths").alias("expected_paths")), "question_id", "left") if expected is not None else runs.withColumn("expected_paths", F.lit(None).cast("array<string>"))
    lists = ("tool_calls", "direct_file_reads", "text_searches", "graph_calls", "final_citations")
    for name in lists:
        rows = rows.withColumn(name, F.coalesce(name, F.expr("array()").cast(runs.schema[name].dataType)))
    by_path = F.col("expected_paths").isNotNull()
    right = F.when(by_path, F.size(F.filter("final_citations", lambda c: F.array_contains("expected_paths", c["path"])))).otherwise(F.size(F.filter("final_citations", lambda c: c["correct"] == "true")))
    known = F.when(by_path, F.size("final_citations")).otherwise(F.size(F.filter("final_citations", lambda c: F.coalesce(c["correct"], F.lit("unknown")).isin("true", "false"))))
    out = rows.select(
        "id",
        "question_id",
        F.trim("question").alias("question"),
        "mode",
        F.size("tool_calls").cast("double").alias("tool_calls"),
        _total("tool_calls", "output_chars").alias("tool_output_chars"),
        F.size("direct_file_reads").cast("double").alias("file_reads"),
        _total("direct_file_reads", "chars").alias("file_chars"),
        F.size("text_searches").cast("double").alias("text_searches"),
        F.size("graph_calls").cast("double").alias("graph_calls"),
        _total("graph_calls", "chars").alias("graph_chars"),
        F.size("final_citations").cast("double").alias("citations"),
        right.cast("double").alias("correct_citations"),
        known.cast("double").alias("known_citations"),
        F.coalesce(F.col("raw_file_fallback"), F.lit(False)).cast("int").cast("double").alias("fallback"),
        "token_estimate",
        "character_budget",
        "latency_ms",
    )
    return out.withColumn("citation_rate", F.when(F.col("known_citations") > 0, F.round(F.col("correct_citations") / F.col("known_citations"), 4)))


def pair_runs(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deltas (with less without) of complete pairs, and question_id, reason of the others.

    A pair needs exactly one run of each mode and one question text.
    """
    one = [F.max(F.when(F.col("mode") == mode, F.struct(*METRICS))).alias(mode) for mode in ("with", "without")]
    sizes = [F.count(F.when(F.col("mode") == mode, 1)).alias(f"n_{mode}") for mode in ("with", "without")]
    grouped = metrics.groupBy("question_id").agg(*one, *sizes, F.count_distinct("question").alias("texts"), F.min("question").alias("question"))
    reason = (
        F.when(F.col("n_with") == 0, "missing run with the graph")
        .when(F.col("n_without") == 0, "missing run without the graph")
        .when((F.col("n_with") > 1) | (F.col("n_without") > 1), "more than one run of a mode")
        .when(F.col("texts") > 1, "question texts differ")
    )
    judged = grouped.withColumn("reason", reason)
    deltas = judged.where("reason is null").select("question_id", "question", *((F.col(f"with.{m}") - F.col(f"without.{m}")).alias(m) for m in METRICS))
    return deltas, judged.where("reason is not null").select("question_id", "reason")


def aggregate_deltas(deltas: DataFrame) -> DataFrame:
    """One row: sums of deltas and means of rates; null where no pair has a value."""
    return deltas.agg(F.count("*").alias("pairs"), *((F.avg(m) if m in RATES else F.sum(m)).alias(m) for m in METRICS))
