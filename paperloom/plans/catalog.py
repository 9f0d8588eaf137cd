"""The queries of the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.engine import table
from paperloom.operators import shredding
from paperloom.plans import readers, reference, stores
from paperloom.plans.registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES", "readers", "reference", "stores"]


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return shredding.node_parents(table(spark, d, "raw_results").select("raw_id", "payload"))


@query()
def p1_elements(spark: SparkSession, d: str) -> DataFrame:
    """The element table of shared inlining with its foreign keys."""
    flat = shredding.flatten(table(spark, d, "raw_results").select("raw_id", "payload"), "raw_id", "payload", keep=("element",))
    return shredding.wide(flat, "raw_id", "element")


@query()
def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    flat = shredding.flatten(table(spark, d, "raw_results").select("raw_id", "payload"), "raw_id", "payload", keep=("cell",))
    return shredding.wide(flat, "raw_id", "cell")


@query()
def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of tables, those without cells too, which cells refer to."""
    flat = shredding.flatten(table(spark, d, "raw_results").select("raw_id", "payload"), "raw_id", "payload", keep=("row",))
    return shredding.wide(flat, "raw_id", "row")


@query()
def p1_others(spark: SparkSession, d: str) -> DataFrame:
    """Attributes that the declared graph doesn't know."""
    return shredding.other_keys(table(spark, d, "raw_results").select("raw_id", "payload"), "raw_id", "payload")


@query()
def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """The schema graph of the payloads as they are."""
    return shredding.profile(table(spark, d, "raw_results"), "payload")


@query("""select raw_id, 1 as root_ord, exporter as key from raw_results where false""")
def p1_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Rows of any table whose parent is in none; whole links give no row."""
    flat = shredding.flatten(table(spark, d, "raw_results").select("raw_id", "payload").distinct(), "raw_id", "payload", attrs=False)
    parents = flat.select("raw_id", "root_ord", F.col("table").alias("parent_table"), F.col("key").alias("parent_key"))
    return flat.where("parent_table <> ''").join(parents, ["raw_id", "root_ord", "parent_table", "parent_key"], "left_anti").select("raw_id", "root_ord", "key")


@query()
def p1_results(spark: SparkSession, d: str) -> DataFrame:
    flat = shredding.flatten(table(spark, d, "raw_results").select("raw_id", "payload"), "raw_id", "payload", keep=("result",))
    return shredding.wide(flat, "raw_id", "result")
