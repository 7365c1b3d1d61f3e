"""References to documents and sections as equi-joins on normalised aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_path, slugify, trimmed


def strip_extension(value: Column) -> Column:
    return F.regexp_replace(value, r"(?i)\.mdx?\z", "")


def normalize_reference(value: Column) -> Column:
    return F.lower(strip_extension(F.regexp_replace(trimmed(normalize_path(value)), r"^\./", "")))


def collapse(path: Column) -> Column:
    """A posix path without `.` and with `..` resolved as far as there is something to leave."""
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1))
        up = (part == "..") & F.coalesce(last != "..", F.lit(False))
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.concat_ws("/", F.aggregate(F.split(path, "/"), empty, step))


def is_relative(value: Column) -> Column:
    return value.rlike(r"^\.?\.?/") | value.rlike(r"(?i)\.mdx?(?:#|\z)")


def document_aliases(documents: DataFrame) -> DataFrame:
    """alias, document_id of every alias that only one document claims.

    documents: id, path, title, front_id.
    """
    bare = strip_extension(F.col("path"))
    names = F.array("path", bare, F.element_at(F.split(bare, "/"), -1), "front_id", "title")
    aliases = F.array_distinct(F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), normalize_reference))
    claimed = documents.select(F.col("id").alias("document_id"), F.explode(aliases).alias("alias"))
    return claimed.groupBy("alias").agg(F.min("document_id").alias("document_id"), F.max("document_id").alias("other")).where("document_id = other").drop("other")


def ambiguous_aliases(documents: DataFrame) -> DataFrame:
    """alias, claimants of every alias that more than one document claims."""
    bare = strip_extension(F.col("path"))
    names = F.array("path", bare, F.element_at(F.split(bare, "/"), -1), "front_id", "title")
    aliases = F.array_distinct(F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), normalize_reference))
    claimed = documents.select(F.col("id").alias("document_id"), F.explode(aliases).alias("alias"))
    return claimed.groupBy("alias").agg(F.count_distinct("document_id").alias("claimants")).where("claimants > 1")


def section_anchors(sections: DataFrame) -> DataFrame:
    """document_id, slug, section_id: a section's own anchor first, else the first heading of that slug.

    sections: id, document_id, anchor, heading, ord.
    """
    own = sections.select("document_id", F.col("anchor").alias("slug"), F.lit(0).alias("rule"), (-F.col("ord")).alias("at"), "id")
    by_heading = sections.select("document_id", slugify(F.col("heading")).alias("slug"), F.lit(1).alias("rule"), F.col("ord").alias("at"), "id")
    return own.unionByName(by_heading).groupBy("document_id", "slug").agg(F.min_by("id", F.struct("rule", "at")).alias("section_id"))


def resolve(references: DataFrame, aliases: DataFrame, anchors: DataFrame) -> DataFrame:
    """references with target_document and node_id (a section or document id, null if unresolved).

    references: from_id, from_path, reference, anchor (null: taken from the reference after #).
    An empty reference with an anchor means the document itself. Both lookups are equi-joins;
    Spark broadcasts the alias table where its size allows.
    """
    hash_at = F.instr("reference", "#")
    cut = F.col("anchor").isNull() & (hash_at > 0)
    spot = F.when(cut, F.expr("substring(reference, instr(reference, '#') + 1)")).otherwise(F.col("anchor"))
    rows = references.withColumn("__spot", F.when(spot != "", spot)).withColumn("__ref", normalize_path(F.when(cut, F.expr("substring(reference, 1, instr(reference, '#') - 1)")).otherwise(F.col("reference"))))
    plain = normalize_reference(F.col("__ref"))
    folder = F.when(F.instr("from_path", "/") > 0, F.regexp_replace("from_path", r"/[^/]*\z", "")).otherwise(F.lit("."))
    joined = normalize_reference(collapse(F.concat_ws("/", folder, F.col("__ref"))))
    rows = rows.withColumn("__alias", F.when((plain != "") & is_relative(F.col("__ref")), joined).otherwise(plain)).withColumn("__bare", strip_extension(F.col("__alias")))
    one = aliases.select(F.col("alias").alias("__alias"), F.col("document_id").alias("__one"))
    two = aliases.select(F.col("alias").alias("__bare"), F.col("document_id").alias("__two"))
    rows = rows.join(one, "__alias", "left").join(two, "__bare", "left")
    itself = (F.col("__alias") == "") & F.col("__spot").isNotNull()
    rows = rows.withColumn("target_document", F.when(F.col("__alias") != "", F.coalesce("__one", "__two")).when(itself, F.col("from_id"))).withColumn("__slug", slugify(F.col("__spot")))
    spots = anchors.select(F.col("document_id").alias("__doc"), F.col("slug").alias("__at"), F.col("section_id").alias("__section"))
    rows = rows.join(spots, (F.col("target_document") == F.col("__doc")) & (F.col("__slug") == F.col("__at")), "left")
    node = F.when(F.col("__spot").isNull(), F.col("target_document")).otherwise(F.col("__section"))
    return rows.withColumn("node_id", node).drop(*(c for c in rows.columns if c.startswith("__")))


def is_external(url: Column) -> Column:
    return url.rlike(r"(?i)^(?:https?:|mailto:)")


def url_reference(url: Column) -> tuple[Column, Column]:
    """Reference and anchor (empty if there is none) of a Markdown URL."""
    parts = F.split(url, "#")
    return parts[0], F.coalesce(F.get(parts, 1), F.lit(""))
