"""Hashed text vectors and brute-force similarity, all in Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fnv1a, fnv1a_of, query_tokens, query_tokens_of, token_counts, utf16_length


def _token_weight(token: Column) -> Column:
    sign = F.when(fnv1a(F.concat(F.lit("sign:"), token)) % 2 == 0, 1.0).otherwise(-1.0)
    return sign * (1 + F.ln(utf16_length(token)))


def embed(content: Column, dimensions: int) -> Column:
    """Feature-hashed vector of a text: unit length, six decimals, all zero without tokens."""
    parts = F.transform(query_tokens(content), lambda t: F.struct((fnv1a(t) % dimensions).cast("int").alias("i"), _token_weight(t).alias("w")))
    merged = F.aggregate(
        parts,
        F.array_repeat(F.lit(0.0), dimensions),
        lambda acc, p: F.transform(acc, lambda x, k: F.when(k == p["i"], x + p["w"]).otherwise(x)),
    )
    norm = F.sqrt(F.aggregate(merged, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.when(norm == 0, merged).otherwise(F.transform(merged, lambda x: F.round(x / norm, 6)))
    return unit.cast("array<float>")


def _coordinates(rows: DataFrame, id_col: str, text_col: str, dimensions: int) -> DataFrame:
    tokens = token_counts(rows.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", "__text")
    spread = tokens.select("__id", (fnv1a(F.col("token")) % dimensions).cast("int").alias("__at"), (F.col("n") * _token_weight(F.col("token"))).alias("__w"))
    return spread.groupBy("__id", "__at").agg(F.sum("__w").alias("__w"))


def embed_tokens(rows: DataFrame, id_col: str, text_col: str, dimensions: int) -> DataFrame:
    """id, at, weight: the non-zero coordinates of embed() before scaling, as rows."""
    return _coordinates(rows, id_col, text_col, dimensions).select(F.col("__id").alias(id_col), F.col("__at").alias("at"), F.col("__w").alias("weight"))


def embed_rows(rows: DataFrame, id_col: str, text_col: str, dimensions: int) -> DataFrame:
    """id, vector: embed() of every row, summed by coordinate so that a long text doesn't cost its length times the dimensions."""
    gathered = _coordinates(rows, id_col, text_col, dimensions).groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("__at", "__w"))).alias("__m"), F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__norm"))
    joined = rows.select(F.col(id_col).alias("__id")).distinct().join(gathered, "__id", "left")
    unit = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.round(F.try_element_at("__m", i) / F.nullif("__norm", F.lit(0.0)), 6), F.lit(0.0)))
    return joined.select(F.col("__id").alias(id_col), unit.cast("array<float>").alias("vector"))


def embed_text(text: str, dimensions: int) -> list[float]:
    """embed() of one string on the driver."""
    vector = [0.0] * dimensions
    for token in query_tokens_of(text):
        sign = 1 if fnv1a_of(f"sign:{token}") % 2 == 0 else -1
        vector[fnv1a_of(token) % dimensions] += sign * (1 + math.log(len(token.encode("utf-16-le")) // 2))
    norm = math.sqrt(sum(x * x for x in vector))
    return [round(x / norm, 6) for x in vector] if norm else vector


def dot(vector: Column, query: list[float]) -> Column:
    """Dot product over the shorter length; stored components are rounded to six decimals on reading."""
    other = F.array(*(F.lit(float(x)) for x in query))
    n = F.least(F.size(vector), F.lit(len(query)))
    pairs = F.zip_with(F.slice(vector, 1, n), F.slice(other, 1, n), lambda a, b: F.round(a.cast("double"), 6) * b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def similar_vectors(vectors: DataFrame, query: list[float], limit: int, provider: str | None = None, model: str | None = None, id_col: str = "chunk_id", vector_col: str = "vector") -> DataFrame:
    """id, similarity of the `limit` most similar vectors with a positive product; ties by id."""
    rows = vectors
    if provider is not None:
        rows = rows.where((F.col("provider") == provider) & (F.col("model") == model))
    return rows.select(id_col, dot(F.col(vector_col), query).alias("similarity")).where("similarity > 0").orderBy(F.col("similarity").desc(), id_col).limit(limit)


def vector_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("provider", "model", "dimensions").agg(F.count("*").alias("n"))
