"""Panels, readings, text rows and scores derived from the driver's star schema.

Each function gives the DataFrame; ``STANDIN_SQL`` holds the same relation in
SQL for the oracle. All of them read their whole tables.
"""

from __future__ import annotations

import codecs
import datetime
import itertools
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.reference_data import ENTITY_CODES
from panelwright.operators.silver import build_panel
from panelwright.session import use_utc, ship_package
from panelwright.sources.archives import file_system

# Product names the part types stand for; the fourth is out of scope.
PRODUCT_NAMES = {
    "ECONOMY": "Financiamentos imobiliários",
    "LARGE": "Financiamentos rurais (ex-agroindustriais)",
    "MEDIUM": "Financiamentos",
    "PROMO": "Empréstimos",
    "SMALL": "Financiamentos à exportação",
    "STANDARD": "Financiamentos de infraestrutura e desenvolvimento",
}
PRODUCTS = sorted(PRODUCT_NAMES.values())
SERIES = "rate-series"
AS_OF = "2001-11-15"
RUN_AT = "2026-01-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def entity_code(nation_key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in ENTITY_CODES]), nation_key + 1)


def product_name(part_type: Column) -> Column:
    name = F.lit(None).cast("string")
    for key, value in PRODUCT_NAMES.items():
        name = F.when(part_type == key, F.lit(value)).otherwise(name)
    return name


def shipped_lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with entity and product; join strategy left to measured sizes."""
    line = table(spark, sf, "lineitem")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    return (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(part, line.l_partkey == part.p_partkey)
        .select(
            F.to_date("l_shipdate").alias("day"),
            entity_code(F.col("s_nationkey")).alias("entity"),
            product_name(F.col("p_type")).alias("product"),
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_linenumber",
            "l_returnflag",
            "l_linestatus",
        )
    )


def _aggregate(lines: DataFrame, keys: list[str]) -> DataFrame:
    quantity = F.when(F.col("l_discount") == 0, F.lit(-1)).otherwise(F.col("l_quantity").cast("bigint"))
    return build_panel(lines, keys, F.col("day"), quantity, F.col("l_extendedprice").cast("decimal(18,2)"))


def panel_a(spark: SparkSession, sf: str) -> DataFrame:
    """Month × entity × product."""
    return _aggregate(shipped_lines(spark, sf), ["entity", "product"])


def panel_c(spark: SparkSession, sf: str) -> DataFrame:
    """Month × entity × return flag."""
    lines = shipped_lines(spark, sf).withColumn("product", F.col("l_returnflag"))
    return _aggregate(lines, ["entity", "product"])


def panel_e(spark: SparkSession, sf: str) -> DataFrame:
    """Month × entity."""
    lines = shipped_lines(spark, sf).withColumn("product", F.lit("all"))
    return _aggregate(lines, ["entity", "product"])


def panel_b(spark: SparkSession, sf: str) -> DataFrame:
    """Month × customer nation × market segment, with gaps."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.to_date("o_orderdate").alias("day"),
        entity_code(F.col("c_nationkey")).alias("entity"),
        F.col("c_mktsegment").alias("product"),
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "P", F.lit(-1)).otherwise(F.lit(1)).alias("quantity"),
    )
    return build_panel(
        joined, ["entity", "product"], F.col("day"), F.col("quantity"), F.col("o_totalprice").cast("decimal(18,2)")
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Daily readings as text: several per day, tied instants, missing values, another series."""
    orders = table(spark, sf, "orders")
    amount = F.round(F.col("o_totalprice") / 10000, 2)
    text = F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit(None).cast("string")).otherwise(
        amount.cast("decimal(18,2)").cast("string")
    )
    return orders.select(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00-03:00")).alias("date_text"),
        text.alias("value_text"),
        F.timestamp_seconds(F.lit(1_000_000_000) + F.floor(F.col("o_orderkey") / 100)).alias("_ingestion_timestamp"),
        F.when(F.col("o_orderstatus") == "P", F.lit("other-series")).otherwise(F.lit(SERIES)).alias("_source_object"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("full")).otherwise(F.lit("incremental")).alias("_ingestion_mode"),
    )


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Text rows with every kind of defect, in two versions per yearly file."""
    lines = shipped_lines(spark, sf)
    price = F.translate(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), ".", ",")
    value = (
        F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), F.lit("abc"))
        .when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "A"), F.concat(F.lit("-"), price))
        .when((F.col("l_linenumber") == 7) & (F.col("l_quantity") == 30), F.lit("1e30"))
        .otherwise(price)
    )
    quantity = (
        F.when(F.col("l_discount") == 0, F.lit("-1"))
        .when(F.col("l_quantity") == 50, F.lit("-5"))
        .when(F.col("l_quantity") == 49, F.lit("10.0"))
        .when((F.col("l_quantity") == 48) & (F.col("l_linenumber") == 7), F.lit("1" + "0" * 24))
        .otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    )
    date = (
        F.when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "R"), F.lit("2024-13-01"))
        .when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "A"), F.lit("2030-01-31"))
        .when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "N"), F.date_format("day", "yyyy-MM"))
        .otherwise(F.date_format("day", "yyyy-MM-dd"))
    )
    version = F.when(F.col("l_linestatus") == "O", F.lit("2026-02-11T08:15:30")).otherwise(F.lit("2026-08-04T21:05:10"))
    return lines.select(
        date.alias("date_text"),
        F.when(F.col("l_tax") == 0.08, F.lit("XX")).otherwise(F.col("entity")).alias("entity"),
        "product",
        quantity.alias("quantity_text"),
        value.alias("value_text"),
        F.concat(F.lit("lines_"), F.year("day"), F.lit(".csv@"), version).alias("_source_object"),
    )


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows as stored text rows: one member per type and day, version from the day's last event."""
    events = table(spark, sf, "events")
    return events.select(
        F.col("event_type").alias("archive"),
        F.concat(F.col("event_type"), F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit(".csv")).alias("member"),
        F.concat(
            F.col("event_type"), F.lit(".csv@"), F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00")
        ).alias("_source_object"),
        F.col("user_id").cast("string").alias("user"),
        F.floor(F.col("value") / 10).cast("string").alias("level"),
        F.hour("ts").alias("hour"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("instant"),
        "event_id",
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows: quality as label, length as score and weight, source as period, language as group."""
    labels, documents = table(spark, sf, "labels"), table(spark, sf, "documents")
    return labels.join(documents, "doc_id").select(
        F.col("quality").alias("gains"),
        F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)).alias("score"),
        (-F.col("toxic") - F.col("n_chars") / F.lit(100000.0)).alias("simple_score"),
        F.col("n_chars").cast("double").alias("weight"),
        F.col("source").alias("origin"),
        F.col("lang").alias("entity"),
        F.col("doc_id").alias("product"),
    )


def _write_archive(out, frames: Iterator[pd.DataFrame]) -> None:
    """Members one after the other, each a stream of pieces; the frames come sorted by ``_source_object``."""
    pieces = (piece for frame in frames for piece in frame.groupby("_source_object", sort=False))
    with zipfile.ZipFile(out, "w") as archive:
        for name, parts in itertools.groupby(pieces, key=lambda piece: piece[0]):
            member, version = name.split("@")
            when = datetime.datetime.fromisoformat(version).timetuple()[:6]
            info = zipfile.ZipInfo(f"{version[:10]}_{member}", when)
            info.compress_type = zipfile.ZIP_DEFLATED
            with archive.open(info, "w", force_zip64=True) as target:
                target.write(codecs.BOM_UTF8)
                for i, (_, part) in enumerate(parts):
                    target.write(part.drop(columns="_source_object").to_csv(sep=";", index=False, header=i == 0).encode())


def _write_document(out, frames: Iterator[pd.DataFrame]) -> None:
    """One list of all records, written frame by frame."""
    out.write(b'{"value": [')
    for i, frame in enumerate(frames):
        records = frame.astype(object).where(frame.notna(), None).to_dict("records")
        out.write((", " * (i > 0) + json.dumps(records)[1:-1]).encode())
    out.write(b"]}")


def write_files(rows: DataFrame, folder: str, kind: str) -> None:
    """Write the rows as the external files the loaders read: one file per Spark partition.

    ``zip``: an archive with one delimited member per ``_source_object``, of the same name in every archive; a row
    without one is of no member. ``json``: a document with a ``value`` list. File names follow the partition
    number, so a retried task overwrites its own file. A partition may be of any size: Spark sorts it by member, on disk
    where it must, and a task holds one batch of it.
    """
    ship_package(rows.sparkSession)

    def write(batches):
        number = TaskContext.get().partitionId()
        frames = (b.to_pandas() for b in batches if b.num_rows)
        first = next(frames, None)
        if first is not None:
            filesystem, inner = file_system(folder)
            filesystem.create_dir(inner, recursive=True)
            with filesystem.open_output_stream(f"{inner}/part-{number:05d}.{kind}") as out:
                (_write_document if kind == "json" else _write_archive)(out, itertools.chain([first], frames))
        yield pa.RecordBatch.from_pydict({"n": pa.array([int(first is not None)], pa.int64())})

    ordered = rows if kind == "json" else rows.sortWithinPartitions("_source_object")
    ordered.mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()


def _sql_case(column: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {arms} END"


_CODES = "[" + ", ".join(f"'{c}'" for c in ENTITY_CODES) + "]"


def _panel_sql(product: str, source: str = "shipped_lines") -> str:
    return f"""
        SELECT CAST(date_trunc('month', day) AS DATE) AS month, entity, {product} AS product,
               CAST(sum(CASE WHEN l_discount = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS BIGINT) AS qty_disclosed,
               count(*) FILTER (WHERE l_discount = 0) AS masked_rows,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
        FROM {source} GROUP BY ALL"""


STANDIN_SQL = {
    "shipped_lines": f"""
        SELECT CAST(l_shipdate AS DATE) AS day, {_CODES}[s_nationkey + 1] AS entity,
               {_sql_case('p_type', PRODUCT_NAMES)} AS product,
               l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "panel_a": _panel_sql("product"),
    "panel_c": _panel_sql("l_returnflag"),
    "panel_e": _panel_sql("'all'"),
    "panel_b": f"""
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {_CODES}[c_nationkey + 1] AS entity,
               c_mktsegment AS product,
               CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END) AS BIGINT) AS qty_disclosed,
               count(*) FILTER (WHERE o_orderstatus = 'P') AS masked_rows,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "readings": f"""
        SELECT strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00-03:00' AS date_text,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL
                    ELSE printf('%.2f', round(o_totalprice / 10000, 2)) END AS value_text,
               1000000000 + CAST(floor(o_orderkey / 100) AS BIGINT) AS read_at,
               CASE WHEN o_orderstatus = 'P' THEN 'other-series' ELSE '{SERIES}' END AS _source_object,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'full' ELSE 'incremental' END AS _ingestion_mode
        FROM orders""",
    "dirty": """
        SELECT CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN '2024-13-01'
                    WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN '2030-01-31'
                    WHEN l_linenumber = 6 AND l_returnflag = 'N' THEN strftime(day, '%Y-%m')
                    ELSE strftime(day, '%Y-%m-%d') END AS date_text,
               CASE WHEN l_tax = 0.08 THEN 'XX' ELSE entity END AS entity, product,
               CASE WHEN l_discount = 0 THEN '-1' WHEN l_quantity = 50 THEN '-5' WHEN l_quantity = 49 THEN '10.0'
                    WHEN l_quantity = 48 AND l_linenumber = 7 THEN '1' || repeat('0', 24)
                    ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity_text,
               CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'abc'
                    WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN '-' || price
                    WHEN l_linenumber = 7 AND l_quantity = 30 THEN '1e30' ELSE price END AS value_text,
               'lines_' || CAST(year(day) AS VARCHAR) || '.csv@' ||
               CASE WHEN l_linestatus = 'O' THEN '2026-02-11T08:15:30' ELSE '2026-08-04T21:05:10' END AS _source_object
        FROM (SELECT *, replace(printf('%.2f', l_extendedprice), '.', ',') AS price FROM shipped_lines)""",
    "versions": """
        SELECT event_type AS archive, event_type || '_' || strftime(ts, '%Y%m%d') || '.csv' AS member,
               event_type || '.csv@' || strftime(ts, '%Y-%m-%d') || 'T00:00:00' AS _source_object,
               CAST(user_id AS VARCHAR) AS user, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS level,
               CAST(hour(ts) AS INTEGER) AS hour, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS instant, event_id
        FROM events""",
    "scores": """
        SELECT quality AS gains, least(1.0, CAST(n_chars AS DOUBLE) / 5000.0) AS score,
               -toxic - CAST(n_chars AS DOUBLE) / 100000.0 AS simple_score,
               CAST(n_chars AS DOUBLE) AS weight, source AS origin, lang AS entity, labels.doc_id AS product
        FROM labels JOIN documents ON labels.doc_id = documents.doc_id""",
}
STANDIN_NEEDS = {
    "panel_a": ["shipped_lines"],
    "panel_c": ["shipped_lines"],
    "panel_e": ["shipped_lines"],
    "dirty": ["shipped_lines"],
}
