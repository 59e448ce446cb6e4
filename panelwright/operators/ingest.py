"""B1–B11. Versioned, incremental and idempotent loading of text rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.parsing import day_key
from panelwright.operators.ordered import bag_difference

IN_PROGRESS, COMPLETE, REJECTED = "in_progress", "complete", "rejected"
TECHNICAL = [
    "_ingestion_timestamp",
    "_ingestion_date",
    "_source_system",
    "_source_object",
    "_load_id",
    "_ingestion_mode",
]


def with_metadata(
    df: DataFrame, system: str, source_object: Column | str, load_id: str, mode: str, at: str
) -> DataFrame:
    """B1. Six technical columns; ``at`` is the instant of the run."""
    instant = F.lit(at).cast("timestamp")
    source = F.lit(source_object) if isinstance(source_object, str) else source_object
    return df.withColumns(
        {
            "_source_object": source,
            "_source_system": F.lit(system),
            "_load_id": F.lit(load_id),
            "_ingestion_mode": F.lit(mode),
            "_ingestion_timestamp": instant,
            "_ingestion_date": F.to_date(instant),
        }
    )


def record_hash(columns: Sequence[str], source_object: str = "_source_object", own_fields: bool = False) -> Column:
    """B2. SHA-256 of the fields in name order and the source object, all in codegen.

    With ``own_fields``, fields that are NULL don't count: rows of files with different headers, read over
    the columns of all of them, keep the hash they have over their own header.
    """
    options = {"ignoreNullFields": str(own_fields).lower()}
    fields = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), options)
    return F.sha2(F.concat(fields, F.col(source_object)), 256)


def version_id(archive: Column, member: Column, version_ts: Column) -> Column:
    """B3. ``archive!/member@time``: members of equal name in two archives are two files."""
    return F.concat(archive, F.lit("!/"), member, F.lit("@"), version_ts)


def changed_members(members: DataFrame, control: DataFrame) -> DataFrame:
    """B3–B4. Members whose version is not handled yet, with their version id.

    ``members``: archive, member, version_ts, crc32 (from the archive index).
    ``control``: archive, member, version_ts, crc32, source_object, status; one row per version, so an archive that
    goes back to an earlier version has nothing new. A CRC that changed under the same timestamp gets its own
    id. A control row rebuilt from stored rows has no CRC and matches on the timestamp alone.
    """
    keys = ["archive", "member", "version_ts"]
    states = F.struct(F.col("crc32").alias("crc"), F.col("source_object").alias("id"), "status")
    known = control.groupBy(*keys).agg(F.collect_list(states).alias("_known"))  # as many as the CRCs seen at one time

    def any_known(test) -> Column:
        return F.coalesce(F.exists("_known", test), F.lit(False))

    def same(k: Column) -> Column:
        return k["crc"].isNull() | (k["crc"] == F.col("crc32"))

    plain = version_id(F.col("archive"), F.col("member"), F.col("version_ts"))
    earlier = F.get(F.filter("_known", same), F.lit(0))["id"]
    other = any_known(lambda k: k["crc"] != F.col("crc32"))
    source_object = F.coalesce(earlier, F.when(other, F.concat(plain, F.lit("#crc"), F.col("crc32"))), plain)
    return (
        members.join(known, keys, "left")
        .filter(~any_known(lambda k: k["status"].isin(COMPLETE, REJECTED) & same(k)))
        .withColumn("source_object", source_object)
        .withColumn("resumes", any_known(lambda k: (k["status"] == IN_PROGRESS) & (k["id"] == F.col("source_object"))))
        .drop("_known")
    )


def archive_actions(listing: DataFrame, control: DataFrame) -> DataFrame:
    """B5. What to do with each archive: reuse, reuse unverified, or fetch.

    ``listing``: archive, published_tag, has_local. ``control``: archive, tag.
    """
    action = (
        F.when(~F.col("has_local"), F.lit("fetch"))
        .when(F.col("published_tag").isNull(), F.lit("unverified"))
        .when(F.col("published_tag") == F.col("tag"), F.lit("reuse"))
        .otherwise(F.lit("fetch"))
    )
    return listing.join(control, "archive", "left").select("archive", action.alias("action"))


def control_state(control: DataFrame, changes: DataFrame, status: str) -> DataFrame:
    """B6. Control table with the versions in ``changes`` moved to ``status``; other rows stay.

    Written before the rows with ``in_progress`` and after them with
    ``complete`` or ``rejected``.
    """
    columns = ["archive", "member", "version_ts", "crc32", "source_object", "status"]
    moved = changes.withColumn("status", F.lit(status)).select(*columns)
    return control.join(moved, ["archive", "source_object"], "left_anti").select(*columns).unionByName(moved)


def fill_missing_crc(control: DataFrame, members: DataFrame) -> DataFrame:
    """B4. A rebuilt control row takes the CRC the first time its version is seen again."""
    keys = ["archive", "member", "version_ts"]
    seen = members.select(*keys, F.col("crc32").alias("_crc"))
    return control.join(seen, keys, "left").withColumn("crc32", F.coalesce("crc32", "_crc")).drop("_crc")


def missing_rows(new: DataFrame, stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B7. Rows of an interrupted version still to be written.

    Identical rows inside one file are legitimate: they are counted, so a
    resumed load ends with as many copies as a clean one.
    """
    return bag_difference(new, stored, columns)


def rebuild_control(bronze: DataFrame, source_object: str = "_source_object") -> DataFrame:
    """B8. Control table from stored rows: every version that is stored, CRC unknown."""
    whole = F.col("source_object")
    at = F.length(whole) - F.length(F.substring_index(whole, "@", -1))
    file, version = F.substring(whole, F.lit(1), at - 1), F.substring(whole, at + 1, F.length(whole))
    cut = F.instr(file, "!/")
    return bronze.select(F.col(source_object).alias("source_object")).distinct().select(
        F.substring(file, F.lit(1), F.greatest(cut - 1, F.lit(0))).alias("archive"),
        F.when(cut > 0, F.substring(file, cut + 2, F.length(file))).otherwise(file).alias("member"),
        F.split_part(version, F.lit("#"), F.lit(1)).alias("version_ts"),
        F.lit(None).cast("string").alias("crc32"),
        "source_object",
        F.lit(COMPLETE).alias("status"),
    )


def watermark(bronze: DataFrame, date: str) -> DataFrame:
    """B10–B11. Greatest non-empty day stored, NULL before the first load."""
    day = day_key(F.col(date))
    return bronze.agg(F.max(F.when(day != "", day)).alias("watermark"))


def incremental_rows(document: DataFrame, bronze: DataFrame, columns: Sequence[str], date: str) -> DataFrame:
    """B9. Rows at or after the mark that are not stored yet, copies counted.

    Only stored rows at or after the mark can match, so both sides are cut by
    the same filter before the difference. Rows without a date load only when
    there is no mark, as text comparison leaves them out. The mark is one
    scalar: no driver round trip, and the whole load is one plan.
    """
    mark = watermark(bronze, date).scalar()

    def after_mark(df: DataFrame) -> DataFrame:
        kept = df.withColumn("_mark", mark)
        return kept.filter(F.col("_mark").isNull() | (day_key(F.col(date)) >= F.col("_mark"))).drop("_mark")

    missing = bag_difference(after_mark(document), after_mark(bronze), columns)
    return missing.withColumn(
        "_ingestion_mode", F.when(mark.isNull(), F.lit("full")).otherwise(F.lit("incremental"))
    )
