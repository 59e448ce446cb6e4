"""J1–J3. Publish a set of tables as one unit, and read the published set back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.session import create_file, delete_path, folder_names

POINTER = "_publications"


def column_type(dtype: T.DataType) -> str:
    """J2. Target column type of a Spark type."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double precision"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return "jsonb"
    return "text"


def table_types(df: DataFrame) -> dict[str, str]:
    return {f.name: column_type(f.dataType) for f in df.schema.fields}


def clean_missing(df: DataFrame) -> DataFrame:
    """J1. NaN leaves as NULL."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in doubles}) if doubles else df


class PublicationRefused(Exception):
    """J1. The load id has been published before, or another publication came first."""


def _manifests(spark: SparkSession, root: str) -> list[int]:
    names = folder_names(spark, f"{root}/{POINTER}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _manifest_path(root: str, number: int) -> str:
    return f"{root}/{POINTER}/{number:012d}.json"


def publish(
    tables: dict[str, DataFrame | None], root: str | None, load_id: str, published_at: str, required: tuple[str, ...] = ()
) -> bool:
    """J1, J3. Write every table as a new version, then make one manifest that names them all.

    Readers follow the newest manifest, so they see either the old set or the new one, and a version is never
    written twice. A manifest has the number after the newest one at the start and is created only if no
    other has taken it: a publication that fails half-way, comes second, or repeats a load id leaves the
    published set as it was. Returns False when there is no target or a table is missing.
    """
    names = list(required) or list(tables)
    if not root or any(tables.get(n) is None for n in names):
        return False
    spark = next(iter(tables.values())).sparkSession
    before = max(_manifests(spark, root), default=0)
    if before and not publications(spark, root).filter(F.col("load_id") == load_id).isEmpty():
        raise PublicationRefused(f"{load_id} has been published")
    version = f"{load_id}-{uuid.uuid4().hex[:12]}"
    entries, rows = {}, {}
    for name, table in tables.items():
        counts = Observation(name)
        path = f"tables/{name}/{version}"
        clean_missing(table).observe(counts, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(f"{root}/{path}")
        entries[name], rows[name] = path, int(counts.get["rows"])
    manifest = {"load_id": load_id, "published_at": published_at, "rows": json.dumps(rows, sort_keys=True, separators=(",", ":")), "tables": entries}
    if not create_file(spark, _manifest_path(root, before + 1), json.dumps(manifest, sort_keys=True)):
        raise PublicationRefused(f"another publication came before {load_id}")
    return True


def publications(spark: SparkSession, root: str) -> DataFrame:
    """J1. The control table: one row per publication, in order of ``number``."""
    paths = [_manifest_path(root, n) for n in _manifests(spark, root)]
    schema = "load_id string, published_at timestamp, rows string, tables map<string, string>"
    number = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -1), ".", 1).cast("long")
    if not paths:
        return spark.createDataFrame([], f"{schema}, number long")
    return spark.read.schema(schema).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").json(paths).withColumn("number", number)


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table of the newest publication."""
    newest = publications(spark, root).orderBy(F.col("number").desc()).first()
    return spark.read.parquet(f"{root}/{newest['tables'][name]}")


def drop_unpublished(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete table versions that none of the newest ``keep`` publications names; returns their paths.

    Not while a publication is under way: its versions aren't named yet.
    """
    kept = publications(spark, root).orderBy(F.col("number").desc()).limit(keep).select(F.explode(F.map_values("tables")))
    named = {r[0] for r in kept.collect()}  # `keep` times the number of tables
    found = [f"tables/{t}/{v}" for t in folder_names(spark, f"{root}/tables") for v in folder_names(spark, f"{root}/tables/{t}")]
    gone = sorted(set(found) - named)
    for path in gone:
        delete_path(spark, f"{root}/{path}")
    return gone
