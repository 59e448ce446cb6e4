"""From raw documents to packed training sequences: each stage works on what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import exact_dedup, jaccard_join, packing, quality_rules, secret_scan
from panelwright.llm.queries import TOKENIZER, table
from panelwright.llm.store import Workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(ws: Workspace, docs: DataFrame) -> DataFrame:
    """``docs`` written with a number for each row: ids may be NULL or repeat, so decisions go by row."""
    return ws.table(docs.withColumn("_row", F.monotonically_increasing_id()))


def _without(numbered: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose number isn't in ``gone``, without the numbers."""
    return numbered.join(gone.select("_row"), "_row", "left_anti").drop("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or the likelihood ratio go."""
    ws = Workspace(spark, "quality-stage")
    numbered = _numbered(ws, docs)
    judged = quality_rules.judge(numbered, table(spark, sf_dir, "labels"), row_col="_row")
    return _without(numbered, ws.table(judged.where(~F.col("kept")).select("_row")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts, the row with the largest id stays, the last of these; one without an id if none has one."""
    numbered = _numbered(Workspace(spark, "exact-stage"), docs)
    groups = exact_dedup.exact_groups(numbered.select(F.struct("doc_id", "_row").alias("place"), "text"), id_col="place")
    return _without(numbered, groups.where(~F.col("kept")).select("place._row"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts, the row with the smallest id stays, the first of these; one without an id if none has one."""
    ws = Workspace(spark, "near-stage")
    numbered = _numbered(ws, docs)
    linked = jaccard_join.linked_components(numbered.select("_row", "text"), id_col="_row").select("_row", "component_id")
    rows = ws.table(numbered.select("_row", "doc_id").join(linked, "_row"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    groups = rows.groupBy("component_id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size"))
    groups = ws.table(groups.where("size > 1").select("component_id", F.col("first._row").alias("first")))
    return _without(numbered, rows.join(groups, "component_id").where("_row <> first"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are replaced by a mark, and ``n_chars`` follows; copied examples stay as they are."""
    clean = secret_scan.redact_live(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left and their places in sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

# The last stage tokenizes, which SQL can't express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next one reads it."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
