"""Idempotent loads: archives of text rows, and series documents.

The control table is an append-only event log; the newest event of a version is its
state. A version is logged as in progress before its rows are written and as
complete (or rejected) after, so a load that died is picked up by the next. A member
that can't be read stays in progress with the reason, and keeps no other from being loaded.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import ingest
from panelwright.session import cut_lineage, delete_path, shared_dir
from panelwright.sources import archives, documents, text
from panelwright.sources.events import EventLog

CONTROL_SCHEMA = "archive string, member string, version_ts string, crc32 string, source_object string, status string, reason string, load_id string"
CONTROL_COLUMNS = ["archive", "member", "version_ts", "crc32", "source_object", "status"]


def control_log(spark: SparkSession, path: str) -> EventLog:
    return EventLog(spark, path, CONTROL_SCHEMA, ["archive", "source_object"])


def log_control(log: EventLog, rows: DataFrame, status: str | None = None, load_id: str | None = None) -> None:
    """Append states to the control log."""
    log.append((rows if status is None else rows.withColumn("status", F.lit(status))).withColumn("load_id", F.lit(load_id)))


def read_control(log: EventLog, bronze: str) -> DataFrame:
    """B8. State per version; rebuilt from the stored rows when the log is lost."""
    if log.exists():
        return log.state()
    if text.table_exists(log.spark, bronze):
        return ingest.rebuild_control(text.read_table(log.spark, bronze)).withColumn("reason", F.lit(None).cast("string"))
    return log.state()


def load_archives(
    spark: SparkSession,
    folder: str,
    bronze: str,
    control_path: str,
    required: Sequence[str],
    system: str,
    load_id: str,
    at: str,
) -> DataFrame:
    """A1–A7, B1–B8. Load every member version that is not handled yet; returns the changes with their new states.

    Unchanged archives cost a look at their index. Rows and faults of the changed members come out of
    one pass and are written with their tags; the rows of members without a fault are then appended without any shuffle. Only
    versions that an earlier load left in progress are compared with what is stored of them.
    """
    log = control_log(spark, control_path)
    members = cut_lineage(archives.archive_index(archives.list_archives(spark, folder)))  # one row per member
    control = read_control(log, bronze)
    known_crc = cut_lineage(ingest.fill_missing_crc(control.filter("crc32 IS NULL"), members).filter("crc32 IS NOT NULL"))
    if not known_crc.isEmpty():
        log_control(log, known_crc, load_id=load_id)
    changed = cut_lineage(archives.file_contract(archives.probe_members(ingest.changed_members(members, control)), required))
    lacking = F.when(F.size("missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("missing", ", ")))
    changed = changed.withColumn("reason", F.coalesce("error", lacking))
    status = F.when(F.col("contract").isin("rejected", "bad_archive"), F.lit(ingest.REJECTED)).otherwise(F.lit(ingest.IN_PROGRESS))
    changed = changed.withColumn("status", status)
    if changed.isEmpty():
        return changed
    log_control(log, changed, load_id=load_id)
    accepted = changed.filter("contract = 'accepted'")
    if accepted.isEmpty():
        return changed

    columns = archives.header_columns(accepted)
    staging = f"{shared_dir(spark)}/staging/{uuid.uuid4().hex}"
    tagged = archives.tagged_rows(accepted, columns, carried=["source_object"])
    tagged.write.parquet(staging)  # as the rows come; folders by tag would have each task sort its members
    staged = spark.read.schema(tagged.schema).parquet(staging)
    faults = cut_lineage(staged.filter(F.col("tag") == archives.ERROR).select("source_object", F.col("reason").alias("fault")))
    clean = accepted.join(faults, "source_object", "left_anti")

    def rows_of(chosen: DataFrame) -> DataFrame:
        rows = staged.filter(F.col("tag") == archives.ROW).join(chosen.select("source_object"), "source_object", "left_semi")
        named = rows.select(*columns, F.col("source_object").alias("_source_object"))
        return named.withColumn("_record_hash", ingest.record_hash(columns, own_fields=True))

    resumed = clean.filter("resumes")
    if resumed.isEmpty() or not text.table_exists(spark, bronze):
        new = rows_of(clean)
    else:
        versions = resumed.select(F.col("source_object").alias("_source_object"))
        stored = text.read_table(spark, bronze).join(versions, "_source_object", "left_semi")
        for missing in set(columns) - set(stored.columns):
            stored = stored.withColumn(missing, F.lit(None).cast("string"))
        kept = [*columns, "_source_object", "_record_hash"]
        new = rows_of(clean.filter("NOT resumes")).unionByName(ingest.missing_rows(rows_of(resumed), stored, kept))
    if not clean.isEmpty():
        text.append_by_date(
            ingest.with_metadata(new, system, F.col("_source_object"), load_id, "incremental", at), bronze
        )
    done = F.when(F.col("contract") != "accepted", F.col("status")).when(F.col("fault").isNull(), F.lit(ingest.COMPLETE)).otherwise(F.col("status"))
    outcome = changed.join(faults, "source_object", "left").withColumn("status", done).withColumn("reason", F.coalesce("reason", "fault")).drop("fault")
    log_control(log, outcome.filter("contract = 'accepted'"), load_id=load_id)
    outcome = cut_lineage(outcome)
    delete_path(spark, staging)
    return outcome


def load_series(
    spark: SparkSession, document: str, bronze: str, date: str, source_object: str, system: str, load_id: str, at: str
) -> None:
    """A5, B1–B2, B9–B11. Append the document's rows from the high-water mark on that are not stored yet."""
    rows = documents.read_documents(spark, document).withColumn("_source_object", F.lit(source_object))
    columns = [c for c in rows.columns if c != "_source_object"]
    hashed = rows.withColumn("_record_hash", ingest.record_hash(columns))
    kept = [*columns, "_source_object", "_record_hash"]
    if text.table_exists(spark, bronze):
        stored = text.read_table(spark, bronze).filter(F.col("_source_object") == source_object)
    else:
        stored = spark.createDataFrame([], hashed.schema)
    fresh = ingest.incremental_rows(hashed, stored.select(*kept), kept, date)
    # The mark and the difference are fixed before the table they read grows.
    fresh = cut_lineage(fresh)
    loaded = ingest.with_metadata(fresh.drop("_ingestion_mode"), system, source_object, load_id, "", at)
    modes = fresh.select("_ingestion_mode").first()
    if modes is not None:
        text.append_by_date(loaded.withColumn("_ingestion_mode", F.lit(modes["_ingestion_mode"])), bronze)
