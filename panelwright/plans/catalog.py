"""Every registered query, next to its SQL check.

A query takes (spark, sf_dir) and returns a DataFrame over whole tables. The
SQL is absent where the result is not expressible in SQL (training, scoring).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions import labels as lb
from panelwright.functions.money import exact_total, to_money
from panelwright.functions.parsing import to_day, to_number
from panelwright.functions.reference_data import ENTITY_CODES, GENERAL_LABEL, PRODUCT_PREFIX
from panelwright.operators import (
    audit,
    calendar,
    decide,
    evaluate,
    features,
    ingest,
    model,
    panel,
    publish,
    quality,
    reporting,
    serve,
    silver,
    stats,
)
from panelwright.plans import loading
from panelwright.plans import oracle as o
from panelwright.plans import pipeline as p
from panelwright.plans import run
from panelwright.plans import standins as st
from panelwright.session import cut_lineage, fingerprint, shared_dir
from panelwright.sources import archives, documents, text
from panelwright.sources.events import fold_events
from panelwright.streaming import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, needs: Sequence[str] = (), sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = o.with_relations(list(needs), sql)
        return fn

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def small(flag: Column) -> Column:
    return flag.cast("int")


# ---- B. versioned loading ---------------------------------------------------

VERSION_FIELDS = ["user", "level"]


def _members(spark: SparkSession, sf: str, until_hour: int) -> DataFrame:
    """Members as an archive index would list them once the day reached ``until_hour``.

    Errors and purchases keep one timestamp all day, so only their CRC moves.
    """
    rows = st.versions(spark, sf).filter(F.col("hour") < until_hour)
    fixed = F.col("archive").isin("error", "purchase")
    return rows.groupBy("archive", "member").agg(
        F.when(fixed, F.concat(F.substring(F.max("instant"), 1, 10), F.lit("T00:00:00")))
        .otherwise(F.max("instant"))
        .alias("version_ts"),
        F.lower(F.lpad(F.hex(F.sum("event_id")), 8, "0")).alias("crc32"),
    )


def _control(spark: SparkSession, sf: str) -> DataFrame:
    """Control table of a load that ran at 22 h; some rows rebuilt, rejected or interrupted."""
    status = (
        F.when(F.col("archive") == "error", F.lit(ingest.REJECTED))
        .when(F.col("archive") == "view", F.lit(ingest.IN_PROGRESS))
        .otherwise(F.lit(ingest.COMPLETE))
    )
    crc = F.when(F.col("archive") == "click", F.lit(None).cast("string")).otherwise(F.col("crc32"))
    return _members(spark, sf, 22).select(
        "archive",
        "member",
        "version_ts",
        crc.alias("crc32"),
        ingest.version_id(F.col("archive"), F.col("member"), F.col("version_ts")).alias("source_object"),
        status.alias("status"),
    )


def _members_sql(until: int) -> str:
    return f"""SELECT archive, member,
               CASE WHEN archive IN ('error', 'purchase') THEN substr(max(instant), 1, 10) || 'T00:00:00' ELSE max(instant) END AS version_ts,
               lower(lpad(to_hex(CAST(sum(event_id) AS BIGINT)), 8, '0')) AS crc32
        FROM versions WHERE hour < {until} GROUP BY archive, member"""


o.relation("members", ["versions"], _members_sql(24))
o.relation("members_before", ["versions"], _members_sql(22))
o.relation(
    "control",
    ["members_before"],
    """SELECT archive, member, version_ts, CASE WHEN archive = 'click' THEN NULL ELSE crc32 END AS crc32,
              archive || '!/' || member || '@' || version_ts AS source_object,
              CASE archive WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'in_progress' ELSE 'complete' END AS status
       FROM members_before""",
)
o.relation(
    "changed",
    ["members", "control"],
    """SELECT m.archive, m.member, m.version_ts, m.crc32,
              CASE WHEN c.version_ts = m.version_ts AND c.crc32 IS NOT NULL AND c.crc32 <> m.crc32
                   THEN m.archive || '!/' || m.member || '@' || m.version_ts || '#crc' || m.crc32
                   ELSE m.archive || '!/' || m.member || '@' || m.version_ts END AS source_object,
              c.status, c.source_object AS old_object
       FROM members m LEFT JOIN control c ON m.archive = c.archive AND m.member = c.member AND m.version_ts = c.version_ts
       WHERE NOT coalesce(c.status IN ('complete', 'rejected') AND c.version_ts = m.version_ts
                          AND (c.crc32 IS NULL OR c.crc32 = m.crc32), false)""",
)


@query(
    "record_hash",
    ["versions"],
    """SELECT archive, count(*) AS rows, count(DISTINCT (_source_object, user, level)) AS hashes
       FROM versions GROUP BY archive""",
)
def record_hash(spark, sf):
    rows = ingest.with_metadata(
        st.versions(spark, sf), "events", F.col("_source_object"), p.LOAD_ID, "full", st.RUN_AT
    ).withColumn("_record_hash", ingest.record_hash(VERSION_FIELDS))
    merged = rows.groupBy("archive", "_record_hash").agg(F.count("*").alias("n"))
    return merged.groupBy("archive").agg(F.sum("n").alias("rows"), F.count("*").alias("hashes"))


@query(
    "version_changeset",
    ["changed"],
    """SELECT archive, member, version_ts, crc32, source_object,
              CAST(coalesce(status = 'in_progress' AND old_object = source_object, false) AS INTEGER) AS resumes FROM changed""",
)
def version_changeset(spark, sf):
    changed = ingest.changed_members(_members(spark, sf, 24), _control(spark, sf))
    return changed.select(
        "archive", "member", "version_ts", "crc32", "source_object", small(F.col("resumes")).alias("resumes")
    )


@query(
    "archive_actions",
    ["versions"],
    """SELECT l.archive, CASE WHEN NOT has_local THEN 'fetch' WHEN published_tag IS NULL THEN 'unverified'
                            WHEN published_tag = tag THEN 'reuse' ELSE 'fetch' END AS action
       FROM (SELECT archive, archive <> 'purchase' AS has_local,
                    CASE WHEN archive = 'view' THEN NULL ELSE max(substr(instant, 1, 10)) END AS published_tag
             FROM versions GROUP BY archive) l
       LEFT JOIN (SELECT archive, CASE WHEN archive = 'error' THEN min(substr(instant, 1, 10)) ELSE max(substr(instant, 1, 10)) END AS tag
                  FROM versions GROUP BY archive) c ON l.archive = c.archive""",
)
def archive_actions(spark, sf):
    rows, day = st.versions(spark, sf), F.substring("instant", 1, 10)
    listing = rows.groupBy("archive").agg(
        F.when(F.col("archive") == "view", F.lit(None)).otherwise(F.max(day)).alias("published_tag"),
        (F.col("archive") != "purchase").alias("has_local"),
    )
    control = rows.groupBy("archive").agg(
        F.when(F.col("archive") == "error", F.min(day)).otherwise(F.max(day)).alias("tag")
    )
    return ingest.archive_actions(listing, control)


@query(
    "control_transition",
    ["control", "changed"],
    """SELECT archive, member, version_ts, crc32, source_object, status FROM control
       WHERE source_object NOT IN (SELECT source_object FROM changed)
       UNION ALL SELECT archive, member, version_ts, crc32, source_object, 'complete' FROM changed""",
)
def control_transition(spark, sf):
    control = _control(spark, sf)
    changed = ingest.changed_members(_members(spark, sf, 24), control)
    started = ingest.control_state(control, changed, ingest.IN_PROGRESS)
    return ingest.control_state(started, changed, ingest.COMPLETE)


@query(
    "control_crc_fill",
    ["control", "members"],
    """SELECT c.archive, c.member, c.version_ts,
              coalesce(c.crc32, CASE WHEN m.version_ts = c.version_ts THEN m.crc32 END) AS crc32, c.source_object, c.status
       FROM control c LEFT JOIN members m ON c.archive = m.archive AND c.member = m.member""",
)
def control_crc_fill(spark, sf):
    return ingest.fill_missing_crc(_control(spark, sf), _members(spark, sf, 24)).select(
        "archive", "member", "version_ts", "crc32", "source_object", "status"
    )


@query(
    "resume_missing",
    ["versions"],
    """SELECT _source_object, user, level FROM versions
       EXCEPT ALL SELECT _source_object, user, level FROM versions WHERE hour < 12""",
)
def resume_missing(spark, sf):
    rows = st.versions(spark, sf)
    fields = ["_source_object", *VERSION_FIELDS]
    return ingest.missing_rows(rows, rows.filter("hour < 12"), fields)


@query(
    "control_rebuild",
    ["versions"],
    """SELECT archive, split_part(_source_object, '@', 1) AS member, split_part(_source_object, '@', 2) AS version_ts,
              CAST(NULL AS VARCHAR) AS crc32, archive || '!/' || _source_object AS source_object, 'complete' AS status
       FROM versions GROUP BY ALL""",
)
def control_rebuild(spark, sf):
    stored = st.versions(spark, sf).select(F.concat("archive", F.lit("!/"), "_source_object").alias("_source_object"))
    return ingest.rebuild_control(stored)


@query(
    "control_fold",
    ["versions"],
    """SELECT archive, member, _source_object AS source_object, count(*) AS events, max(event_id) AS seq,
              arg_max(level, event_id) AS status FROM versions GROUP BY ALL""",
)
def control_fold(spark, sf):
    """B6: the newest event of each version, however long its history."""
    logged = st.versions(spark, sf).select(
        "archive", "member", F.col("_source_object").alias("source_object"), F.col("level").alias("status"), F.col("event_id").alias("seq")
    )
    keys = ["archive", "member", "source_object"]
    return fold_events(logged, keys).join(logged.groupBy(*keys).agg(F.count("*").alias("events")), keys)


_DOC = ["date_text", "value_text", "_source_object"]


@query(
    "watermark_load",
    ["readings"],
    """SELECT date_text, value_text, _source_object, 'incremental' AS _ingestion_mode FROM (
           SELECT date_text, value_text, _source_object FROM readings
           WHERE substr(date_text, 1, 10) >= (SELECT max(substr(date_text, 1, 10)) FROM readings WHERE date_text < '2000-01-15' AND _ingestion_mode = 'full')
           EXCEPT ALL
           SELECT date_text, value_text, _source_object FROM readings WHERE date_text < '2000-01-15' AND _ingestion_mode = 'full')""",
)
def watermark_load(spark, sf):
    document = st.readings(spark, sf)
    stored = document.filter((F.col("date_text") < "2000-01-15") & (F.col("_ingestion_mode") == "full"))
    return ingest.incremental_rows(document.select(*_DOC), stored.select(*_DOC), _DOC, "date_text")


@query(
    "watermark",
    ["readings"],
    "SELECT max(substr(date_text, 1, 10)) AS watermark FROM readings",
)
def watermark(spark, sf):
    return ingest.watermark(st.readings(spark, sf), "date_text")


@query(
    "bronze_audit",
    ["versions"],
    """, d AS (SELECT _source_object, user, level, count(*) AS n FROM versions GROUP BY ALL),
            v AS (SELECT _source_object, split_part(_source_object, '@', 1) AS member, CAST(sum(n) AS BIGINT) AS rows,
                         CAST(sum(n - 1) AS BIGINT) AS duplicates, max(substr(split_part(_source_object, '@', 2), 1, 4)) AS year
                  FROM d GROUP BY ALL)
       SELECT 'rows' AS section, _source_object AS item, rows AS n FROM v
       UNION ALL SELECT 'duplicates', _source_object, duplicates FROM v
       UNION ALL SELECT 'year', year, CAST(sum(rows) AS BIGINT) FROM v GROUP BY year
       UNION ALL SELECT 'several_versions', member, count(*) FROM v GROUP BY member HAVING count(*) > 1""",
)
def bronze_audit(spark, sf):
    year = F.substring(F.split_part(F.col("_source_object"), F.lit("@"), F.lit(2)), 1, 4)
    return audit.bronze_audit(st.versions(spark, sf), VERSION_FIELDS, year)


@query(
    "series_audit",
    ["readings"],
    """, r AS (SELECT *, substr(date_text, 1, 10) AS day FROM readings),
         d AS (SELECT day, count(*) AS n FROM r GROUP BY day)
       SELECT 'span' AS section, min(day) || '/' || max(day) AS item, CAST(sum(n) AS BIGINT) AS n FROM d
       UNION ALL SELECT 'mode', _ingestion_mode, count(*) FROM r GROUP BY _ingestion_mode
       UNION ALL SELECT 'repeated_day', day, n FROM d WHERE n > 1
       UNION ALL SELECT 'duplicates', 'all', CAST(sum(n - 1) AS BIGINT)
                 FROM (SELECT count(*) AS n FROM r GROUP BY date_text, value_text, _source_object)""",
)
def series_audit(spark, sf):
    return audit.series_audit(st.readings(spark, sf), _DOC, "date_text")


@query(
    "source_profile",
    ["dirty"],
    """SELECT _source_object, count(*) AS rows, CAST(5 AS INTEGER) AS columns, CAST(4 AS INTEGER) AS required_present,
              min(date_text) AS first_period, max(date_text) AS last_period FROM dirty GROUP BY _source_object""",
)
def source_profile(spark, sf):
    required = ["date_text", "entity", "quantity_text", "value_text", "absent_column"]
    return audit.source_profile(p.bronze(spark, sf), required, "date_text")


@query(
    "source_exploration",
    ["dirty"],
    f"""SELECT 'file' AS section, _source_object AS item, count(*) AS n FROM dirty GROUP BY _source_object
       UNION ALL SELECT CASE WHEN starts_with(product, '{PRODUCT_PREFIX}') THEN 'product_in_scope' ELSE 'product_out_of_scope' END,
                        product, count(*) FROM dirty GROUP BY product
       UNION ALL SELECT 'negative_quantity', quantity_text, count(*) FROM dirty
                 WHERE TRY_CAST(quantity_text AS DOUBLE) < 0 GROUP BY quantity_text""",
)
def source_exploration(spark, sf):
    return audit.exploration(p.bronze(spark, sf), "product", "quantity_text", "value_text", PRODUCT_PREFIX)


@query(
    "value_by_product",
    ["dirty_checked"],
    """SELECT product, CAST(sum(TRY_CAST(v AS DECIMAL(20,2))) AS DOUBLE) AS value FROM dirty_checked
       WHERE entity = 'AC' AND starts_with(date_text, '1998-06') GROUP BY product""",
)
def value_by_product(spark, sf):
    return audit.value_by_product(
        p.bronze(spark, sf), "entity", "product", "date_text", "value_text", "AC", "1998-06"
    )


def _fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "text_roundtrip",
    ["dirty"],
    """SELECT _source_object, entity, product, count(*) AS rows,
              count(DISTINCT date_text) AS dates, count(DISTINCT value_text) AS amounts
       FROM dirty GROUP BY _source_object, entity, product""",
)
def text_roundtrip(spark, sf):
    """A2, A6–A8: write as delimited text, scan it back as text, store it by date, read the table."""
    root = _fresh_folder(spark, "text")
    rows = p.bronze(spark, sf)
    rows.write.option("sep", ";").option("header", True).csv(f"{root}/raw")
    schema = ", ".join(f"`{c}` string" for c in rows.columns)
    scanned = text.read_delimited(spark, f"{root}/raw", schema=schema)
    loaded = ingest.with_metadata(scanned, "panel-source", F.col("_source_object"), p.LOAD_ID, "full", st.RUN_AT)
    text.append_by_date(loaded, f"{root}/_bronze")
    stored = text.read_table(spark, f"{root}/_bronze")
    return stored.groupBy("_source_object", "entity", "product").agg(
        F.count("*").alias("rows"),
        F.countDistinct("date_text").alias("dates"),
        F.countDistinct("value_text").alias("amounts"),
    )


@query(
    "archive_scan",
    ["dirty"],
    """SELECT substr(split_part(_source_object, '@', 2), 1, 10) || '_' || split_part(_source_object, '@', 1) AS member,
              split_part(_source_object, '@', 2) AS version_ts, entity, product, count(*) AS rows,
              CAST(sum(length(value_text)) AS BIGINT) AS characters, max(date_text) AS last_date
       FROM dirty GROUP BY ALL""",
)
def archive_scan(spark, sf):
    """A1, A3, A4: archives of the text rows, listed, checked and read member by member."""
    folder = _fresh_folder(spark, "archives")
    rows = p.bronze(spark, sf)
    st.write_files(rows, folder, "zip")
    required = ["date_text", "entity", "product", "quantity_text", "value_text"]
    members = archives.archive_members(archives.list_archives(spark, folder))
    accepted = archives.file_contract(members, required).filter("contract = 'accepted'")
    return archives.member_rows(accepted, required).groupBy("member", "version_ts", "entity", "product").agg(
        F.count("*").alias("rows"),
        F.sum(F.length("value_text")).alias("characters"),
        F.max("date_text").alias("last_date"),
    )


@query(
    "archive_load",
    ["dirty"],
    """SELECT substr(split_part(_source_object, '@', 2), 1, 10) || '_' || split_part(_source_object, '@', 1) || '@' ||
              split_part(_source_object, '@', 2) AS _source_object, entity, product, count(*) AS rows, 'incremental' AS mode
       FROM dirty GROUP BY ALL""",
)
def archive_load(spark, sf):
    """B1–B8: archives loaded twice into one table; the second load finds nothing new.

    Every archive holds a member of each file under the same name.
    """
    folder = _fresh_folder(spark, "load")
    st.write_files(p.bronze(spark, sf), f"{folder}/in", "zip")
    required = ["date_text", "entity", "product", "quantity_text", "value_text"]
    for load_id in ("load-1", "load-2"):
        loading.load_archives(spark, f"{folder}/in", f"{folder}/_bronze", f"{folder}/_control", required, "panel-source", load_id, st.RUN_AT)
    stored = text.read_table(spark, f"{folder}/_bronze")
    name = F.regexp_replace("_source_object", r"^.*!/", "")
    return stored.groupBy(name.alias("_source_object"), "entity", "product", F.col("_ingestion_mode").alias("mode")).agg(
        F.count("*").alias("rows")
    )


@query(
    "document_scan",
    ["readings"],
    """SELECT date_text, count(*) AS rows, count(value_text) AS present,
              CAST(sum(CAST(value_text AS DECIMAL(18,2))) AS DOUBLE) AS total FROM readings GROUP BY date_text""",
)
def document_scan(spark, sf):
    """A5: JSON documents of the readings, scanned back as text; a JSON null stays NULL."""
    folder = _fresh_folder(spark, "documents")
    st.write_files(st.readings(spark, sf).select("date_text", "value_text", "_source_object"), folder, "json")
    return documents.read_documents(spark, folder).groupBy("date_text").agg(
        F.count("*").alias("rows"),
        F.count("value_text").alias("present"),
        F.sum(F.col("value_text").cast("decimal(18,2)")).cast("double").alias("total"),
    )


@query(
    "stream_load",
    ["readings"],
    """SELECT date_text, coalesce(value_text, '') AS value_text, count(*) AS rows, '2026-01-01' AS loaded_on
       FROM readings GROUP BY ALL""",
)
def stream_load(spark, sf):
    """B6, B9 as a stream, drained twice: the second pass and a lost checkpoint add nothing."""
    root = _fresh_folder(spark, "stream")
    rows = st.readings(spark, sf).select("date_text", "value_text")
    rows.write.option("sep", ";").option("header", True).csv(f"{root}/in")
    for checkpoint in ("first", "first", "lost"):
        stream = load.stream_delimited(spark, f"{root}/in", "date_text string, value_text string")
        load.load_stream(
            stream, rows.columns, f"{root}/out", f"{root}/{checkpoint}", "series-source", p.LOAD_ID, st.RUN_AT
        ).awaitTermination()
    return text.read_table(spark, f"{root}/out").groupBy("date_text", "value_text").agg(
        F.count("*").alias("rows"), F.min("_ingestion_date").cast("string").alias("loaded_on")
    )


# ---- C. validation ----------------------------------------------------------


@query(
    "check_masks",
    ["dirty_checked"],
    f"""SELECT CAST(bad_entity AS INTEGER) AS outside_domain, CAST(d IS NULL AS INTEGER) AS bad_date,
              CAST(v IS NULL AS INTEGER) AS bad_value, CAST(bad_int AS INTEGER) AS bad_quantity,
              CAST(coalesce(d > DATE '{st.AS_OF}', false) AS INTEGER) AS in_future,
              CAST(coalesce(v < 0, false) AS INTEGER) AS negative_value,
              CAST(coalesce(q < 0 AND q <> -1, false) AS INTEGER) AS negative_quantity,
              CAST(coalesce(d NOT BETWEEN DATE '{p.SCOPE_START}' AND DATE '{st.AS_OF}', true) AS INTEGER) AS outside_interval,
              count(*) AS rows, CAST(sum(TRY_CAST(v AS DECIMAL(20,2))) AS DOUBLE) AS value, min(d) AS first_day
       FROM dirty_checked GROUP BY ALL""",
)
def check_masks(spark, sf):
    day = to_day(F.col("date_text"))
    value, quantity = to_number(F.col("value_text"), ","), to_number(F.col("quantity_text"))
    masks = {
        "outside_domain": quality.outside_domain(F.col("entity"), ENTITY_CODES),
        "bad_date": quality.bad_type(F.col("date_text"), "date"),
        "bad_value": quality.bad_type(F.col("value_text"), "float", ","),
        "bad_quantity": quality.bad_type(F.col("quantity_text"), "int"),
        "in_future": quality.in_future(day, st.AS_OF),
        "negative_value": quality.negative(value),
        "negative_quantity": quality.negative(quantity, -1),
        "outside_interval": quality.outside_interval(day, p.SCOPE_START, st.AS_OF),
    }
    return (
        p.bronze(spark, sf)
        .groupBy(*[small(m).alias(n) for n, m in masks.items()])
        .agg(
            F.count("*").alias("rows"),
            exact_total(to_money(F.col("value_text"), ",")).alias("value"),
            F.min(day).alias("first_day"),
        )
    )


def _classified(spark, sf) -> DataFrame:
    c, rows = p.CONTRACT, p.bronze(spark, sf)
    typed = rows.withColumns(quality.typed_columns(c.date, c.quantity, c.value, c.decimal))
    rules = quality.panel_rules(c.entity, c.domain, c.as_of, c.sentinel)
    return quality.classify(typed, rules).select(*rows.columns, "reason")


@query(
    "classify_rows",
    ["dirty_classified"],
    "SELECT coalesce(reason, 'valid') AS reason, entity, product, count(*) AS rows FROM dirty_classified GROUP BY ALL",
)
def classify_rows(spark, sf):
    rows = _classified(spark, sf).withColumn("reason", F.coalesce("reason", F.lit("valid")))
    return rows.groupBy("reason", "entity", "product").agg(F.count("*").alias("rows"))


@query(
    "quarantine_by_reason",
    ["dirty_classified"],
    "SELECT reason, count(*) AS rows FROM dirty_classified WHERE reason IS NOT NULL GROUP BY reason",
)
def quarantine_by_reason(spark, sf):
    return quality.reason_counts(_classified(spark, sf))


@query(
    "quarantine_table",
    ["dirty_classified"],
    f"""SELECT '{p.LOAD_ID}' AS _load_id, 'panel-source' AS _source_system, _source_object, reason,
              '{{"date_text":"' || date_text || '","entity":"' || entity || '","product":"' || product ||
              '","quantity_text":"' || quantity_text || '","value_text":"' || value_text ||
              '","_source_object":"' || _source_object || '"}}' AS payload
       FROM dirty_classified WHERE reason IS NOT NULL""",
)
def quarantine_table(spark, sf):
    rejected = quality.split_valid(_classified(spark, sf))[1]
    table = quality.quarantine_table(rejected, p.LOAD_ID, "panel-source", "_source_object", st.RUN_AT)
    return table.drop("quarantined_at")


@query(
    "quarantine_append",
    ["dirty_classified"],
    """SELECT reason, 2 * count(*) AS rows, CAST(sum(length(value_text)) AS BIGINT) AS characters
       FROM dirty_classified WHERE reason IS NOT NULL GROUP BY reason""",
)
def quarantine_append(spark, sf):
    """C10: a quarantine that is replaced, then appended to, read back."""
    folder = _fresh_folder(spark, "quarantine")
    rejected = quality.split_valid(_classified(spark, sf))[1]
    table = quality.quarantine_table(rejected, p.LOAD_ID, "panel-source", "_source_object", st.RUN_AT)
    stored = [quality.store_quarantine(table, f"{folder}/q"), quality.store_quarantine(table, f"{folder}/q"), quality.store_quarantine(table, f"{folder}/q", append=True)]
    if not all(stored):
        raise RuntimeError("quarantine not written")
    value = F.length(F.get_json_object("payload", "$.value_text"))
    return spark.read.parquet(f"{folder}/q").groupBy("reason").agg(F.count("*").alias("rows"), F.floor(F.sum(value) / 2).alias("characters"))


# ---- D. silver --------------------------------------------------------------


@query(
    "current_versions",
    ["versions"],
    """SELECT split_part(_source_object, '@', 1) AS file, max(_source_object) AS _source_object
       FROM versions GROUP BY 1""",
)
def current_versions(spark, sf):
    return silver.current_versions(st.versions(spark, sf))


@query(
    "keep_current",
    ["versions"],
    """SELECT _source_object, user, level, event_id FROM versions WHERE _source_object IN (
           SELECT max(_source_object) FROM versions GROUP BY split_part(_source_object, '@', 1))""",
)
def keep_current(spark, sf):
    return silver.keep_current(st.versions(spark, sf)).select("_source_object", "user", "level", "event_id")


_STAGE_COUNTS = ", ".join(f"count(*) FILTER (WHERE stage = '{s}') AS {s}" for s in silver.STAGES)


@query("scope_funnel", ["dirty_staged"], f"SELECT count(*) AS read, {_STAGE_COUNTS} FROM dirty_staged")
def scope_funnel(spark, sf):
    return p.silver_panel(spark, sf).report


@query("silver_panel", ["panel_a"], "SELECT * FROM panel_a")
def silver_panel(spark, sf):
    return st.panel_a(spark, sf)


@query(
    "incomplete_keys",
    ["panel_b"],
    "SELECT entity, product, count(*) AS months_present FROM panel_b GROUP BY ALL HAVING count(*) < 80",
)
def incomplete_keys(spark, sf):
    return silver.incomplete_keys(st.panel_b(spark, sf), ["entity", "product"], 80)


@query(
    "panel_facts",
    ["panel_b"],
    """SELECT count(*) AS rows, count(DISTINCT month) AS months,
              string_agg(DISTINCT product, '|' ORDER BY product) AS products FROM panel_b""",
)
def panel_facts(spark, sf):
    return silver.panel_facts(st.panel_b(spark, sf))


@query(
    "silver_build",
    ["dirty_staged"],
    f"""SELECT CAST(date_trunc('month', d) AS DATE) AS month, entity, product,
              CAST(sum(CASE WHEN q >= 0 THEN TRY_CAST(q AS BIGINT) ELSE 0 END) AS BIGINT) AS qty_disclosed,
              count(*) FILTER (WHERE q = -1) AS masked_rows,
              CAST(sum(TRY_CAST(v AS DECIMAL(20,2))) AS DOUBLE) AS value, '{p.LOAD_ID}' AS _load_id
       FROM dirty_staged WHERE stage = 'aggregated' GROUP BY ALL""",
)
def silver_build(spark, sf):
    return p.silver_panel(spark, sf).table


@query(
    "silver_quarantine",
    ["dirty_staged"],
    "SELECT _source_object, reason, count(*) AS rows FROM dirty_staged WHERE stage = 'quarantined' GROUP BY ALL",
)
def silver_quarantine(spark, sf):
    return p.silver_panel(spark, sf).quarantine.groupBy("_source_object", "reason").agg(F.count("*").alias("rows"))


def _days(spark, sf) -> DataFrame:
    mine = st.readings(spark, sf).filter(F.col("_source_object") == st.SERIES)
    return silver.classify_days(silver.current_readings(mine, "date_text", "value_text", "_ingestion_timestamp"))


@query(
    "day_readings",
    ["day_classified"],
    """SELECT day, value_text, CAST(ambiguous AS INTEGER) AS ambiguous, tied_readings, older_readings, date, number, reason
       FROM day_classified""",
)
def day_readings(spark, sf):
    days = _days(spark, sf)
    return days.select(
        "day",
        "value_text",
        small(F.col("ambiguous")).alias("ambiguous"),
        "tied_readings",
        "older_readings",
        "date",
        "number",
        "reason",
    )


@query(
    "ambiguous_days",
    ["day_classified"],
    "SELECT day, tied_readings FROM day_classified WHERE reason = 'duplicate_key'",
)
def ambiguous_days(spark, sf):
    return _days(spark, sf).filter(F.col("reason") == quality.DUPLICATE_KEY).select("day", "tied_readings")


@query(
    "series_quarantine",
    ["day_classified", "readings"],
    f"""SELECT r.date_text, r.value_text, c.reason, count(*) AS rows FROM readings r
       JOIN day_classified c ON substr(r.date_text, 1, 10) = c.day AND r.read_at = c.read_at
       WHERE c.reason = 'duplicate_key' AND r._source_object = '{st.SERIES}' GROUP BY ALL
       UNION ALL SELECT day || 'T00:00:00-03:00', value_text, reason, 1 FROM day_classified
                 WHERE reason IS NOT NULL AND reason <> 'duplicate_key'""",
)
def series_quarantine(spark, sf):
    table = p.silver_series(spark, sf).quarantine
    fields = F.from_json("payload", "date_text string, value_text string")
    return (
        table.select(fields.alias("f"), "reason")
        .groupBy("f.date_text", "f.value_text", "reason")
        .agg(F.count("*").alias("rows"))
    )


@query("month_end_series", ["series"], "SELECT month, rate FROM series")
def month_end_series(spark, sf):
    return p.silver_series(spark, sf).table.drop("_load_id")


@query(
    "series_report",
    ["readings", "day_classified", "month_ends", "series"],
    f"""SELECT 'read' AS metric, count(*) AS n FROM readings
       UNION ALL SELECT 'other_series', count(*) FROM readings WHERE _source_object <> '{st.SERIES}'
       UNION ALL SELECT 'older_readings', CAST(sum(older_readings) AS BIGINT) FROM day_classified
       UNION ALL SELECT 'valid_days', count(*) FROM day_classified WHERE reason IS NULL
       UNION ALL SELECT 'month_out_of_scope', count(*) FROM month_ends WHERE month NOT BETWEEN DATE '{p.SCOPE_START}' AND DATE '{p.SCOPE_END}'
       UNION ALL SELECT 'month_not_closed', count(*) FROM month_ends WHERE month BETWEEN DATE '{p.SCOPE_START}' AND DATE '{p.SCOPE_END}'
                 AND month >= date_trunc('month', DATE '{st.AS_OF}')
       UNION ALL SELECT 'kept', count(*) FROM series""",
)
def series_report(spark, sf):
    return p.silver_series(spark, sf).report


@query(
    "run_report",
    ["dirty_staged"],
    """SELECT 'counters' AS section, count(DISTINCT stage) + 1 AS items FROM dirty_staged
       UNION ALL SELECT 'quarantine_by_reason', count(DISTINCT reason) FROM dirty_staged WHERE stage = 'quarantined'""",
)
def run_report(spark, sf):
    built = p.silver_panel(spark, sf)
    counters = built.report.unpivot([], built.report.columns, "metric", "n").filter("n > 0")
    reasons = built.quarantine.groupBy("reason").agg(F.count("*").alias("rows"))
    report = reporting.run_report(p.LOAD_ID, st.RUN_AT, counters, {"quarantine_by_reason": reasons})
    return report.groupBy("section").agg(F.count("item").alias("items"))


# ---- E. gold ----------------------------------------------------------------

_LAG_COLUMNS = [f"rate_lag_{k}" for k in range(1, 7)]
_LAG_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _LAG_COLUMNS)


@query(
    "dense_series",
    ["panel_b"],
    """SELECT k.entity, k.product, CAST(k.m AS DATE) AS month, b.value FROM (
           SELECT entity, product, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS m
           FROM panel_b GROUP BY entity, product) k
       LEFT JOIN panel_b b ON b.entity = k.entity AND b.product = k.product AND b.month = CAST(k.m AS DATE)""",
)
def dense_series(spark, sf):
    narrow = st.panel_b(spark, sf).select("entity", "product", "month", "value")
    return calendar.densify(narrow, by=["entity", "product"])


@query(
    "series_lags",
    ["series_lagged"],
    f"SELECT month, rate, round(rate_change, 6) AS rate_change, {_LAG_SQL} FROM series_lagged",
)
def series_lags(spark, sf):
    return rounded(calendar.series_lags(p.series(spark, sf)), "rate_change", *_LAG_COLUMNS)


@query(
    "calendar_lags",
    ["panel_b"],
    f"""SELECT month, entity, product, value, {o.lagged('value', 1)} AS lag_1, {o.lagged('value', 3)} AS lag_3,
              {o.lagged('value', -2)} AS lead_2 FROM panel_b""",
)
def calendar_lags(spark, sf):
    by = ["entity", "product"]
    return st.panel_b(spark, sf).select(
        "month",
        *by,
        "value",
        calendar.calendar_lag(F.col("value"), 1, by).alias("lag_1"),
        calendar.calendar_lag(F.col("value"), 3, by).alias("lag_3"),
        calendar.calendar_lag(F.col("value"), -2, by).alias("lead_2"),
    )


_CHANGE_SQL = """month, entity, product, qty_disclosed, masked_rows, value, CAST(has_prev AS INTEGER) AS has_prev,
              round(qty_change_pct, 6) AS qty_change_pct, round(value_change_pct, 6) AS value_change_pct"""


@query("consecutive_change", ["panel_b"], f"SELECT {_CHANGE_SQL} FROM ({o.changes('panel_b')})")
def consecutive_change(spark, sf):
    changed = panel.consecutive_changes(st.panel_b(spark, sf), ["entity", "product"])
    return rounded(changed.withColumn("has_prev", small(F.col("has_prev"))), "qty_change_pct", "value_change_pct")


@query(
    "orphan_months",
    ["panel_a", "series"],
    """SELECT month, 'panel_only' AS side FROM (SELECT DISTINCT month FROM panel_a) WHERE month NOT IN (SELECT month FROM series)
       UNION ALL SELECT month, 'series_only' FROM series WHERE month NOT IN (SELECT month FROM panel_a)""",
)
def orphan_months(spark, sf):
    return panel.orphan_months(p.panel_table(spark, sf), p.series(spark, sf))


@query(
    "gold_panel",
    ["gold"],
    f"SELECT {_CHANGE_SQL}, rate, round(rate_change, 6) AS rate_change, {_LAG_SQL} FROM gold",
)
def gold_panel(spark, sf):
    gold = p.build_gold(spark, sf).withColumn("has_prev", small(F.col("has_prev")))
    return rounded(gold, "qty_change_pct", "value_change_pct", "rate_change", *_LAG_COLUMNS)


@query(
    "gold_report",
    ["gold", "panel_a", "series"],
    """SELECT 'gold_rows' AS metric, count(*) AS n FROM gold
       UNION ALL SELECT 'gold_months', count(DISTINCT month) FROM gold
       UNION ALL SELECT 'rows_without_prev', count(*) FROM gold WHERE NOT has_prev
       UNION ALL SELECT 'rows_without_qty_change', count(*) FROM gold WHERE qty_change_pct IS NULL
       UNION ALL SELECT 'panel_rows', count(*) FROM panel_a
       UNION ALL SELECT 'panel_only_months', count(DISTINCT month) FROM panel_a WHERE month NOT IN (SELECT month FROM series)
       UNION ALL SELECT 'series_only_months', count(*) FROM series WHERE month NOT IN (SELECT month FROM panel_a)""",
)
def gold_report(spark, sf):
    return panel.gold_report(p.gold(spark, sf), p.panel_table(spark, sf), p.series(spark, sf))


@query(
    "key_check",
    ["gold", "dirty"],
    """SELECT 'gold' AS "table", count(*) AS duplicate_keys FROM (SELECT 1 FROM gold GROUP BY month, entity, product HAVING count(*) > 1)
       UNION ALL SELECT 'text rows', count(*) FROM (SELECT 1 FROM dirty GROUP BY _source_object, date_text, entity, product HAVING count(*) > 1)""",
)
def key_check(spark, sf):
    def counted(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        return panel.duplicate_keys(df, keys).agg(F.count("*").alias("duplicate_keys")).select(
            F.lit(name).alias("table"), "duplicate_keys"
        )

    return counted("gold", p.gold(spark, sf), ["month", "entity", "product"]).unionByName(
        counted("text rows", p.bronze(spark, sf), ["_source_object", "date_text", "entity", "product"])
    )


# ---- F. statistics ----------------------------------------------------------


@query(
    "national_change",
    ["national"],
    """SELECT product, month, value, CAST(has_prev AS INTEGER) AS has_prev, round(value_change_pct, 6) AS value_change_pct
       FROM national""",
)
def national_change(spark, sf):
    changed = stats.national_change(p.gold(spark, sf)).withColumn("has_prev", small(F.col("has_prev")))
    return rounded(changed, "value_change_pct")


@query(
    "lag_pairs",
    ["pairs"],
    "SELECT product, month, CAST(lag AS INTEGER) AS lag, round(y, 6) AS y, round(x, 6) AS x FROM pairs",
)
def lag_pairs(spark, sf):
    gold = p.gold(spark, sf)
    pairs = stats.lag_pairs(stats.national_change(gold), stats.series_change(gold))
    return rounded(pairs.select("product", "month", "lag", "y", "x"), "y", "x")


@query(
    "lag_correlation",
    ["corr"],
    """SELECT product, CAST(lag AS INTEGER) AS lag, n_months, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson
       FROM corr""",
)
def lag_correlation(spark, sf):
    gold = p.gold(spark, sf)
    pairs = stats.lag_pairs(stats.national_change(gold), stats.series_change(gold))
    return rounded(stats.correlations(pairs, ["product", "lag"]), "spearman", "pearson")


@query(
    "spearman_pvalue",
    ["corr_p"],
    "SELECT product, CAST(lag AS INTEGER) AS lag, n_months, round(p_value, 8) AS p_value FROM corr_p",
)
def spearman_pvalue(spark, sf):
    gold = p.gold(spark, sf)
    pairs = stats.lag_pairs(stats.national_change(gold), stats.series_change(gold))
    table = stats.with_p_values(stats.correlations(pairs, ["product", "lag"]))
    return rounded(table.select("product", "lag", "n_months", "p_value"), "p_value", places=8)


def _table_sql(keys: str, extra: str = "") -> str:
    return f"""SELECT {keys}, CAST(lag AS INTEGER) AS lag, n_months, {extra}round(spearman, 6) AS spearman,
              round(pearson, 6) AS pearson, round(p_value, 8) AS p_value, round(p_adjusted, 8) AS p_adjusted,
              CAST(significant AS INTEGER) AS significant"""


def _statistics(table: DataFrame, keys: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    flags = [small(F.col(c)).alias(c) for c in (*extra, "significant")]
    chosen = table.select(*keys, "lag", "n_months", *flags, "spearman", "pearson", "p_value", "p_adjusted")
    return rounded(rounded(chosen, "spearman", "pearson"), "p_value", "p_adjusted", places=8)


@query("bh_adjust", ["level1"], _table_sql("product") + " FROM level1")
def bh_adjust(spark, sf):
    return _statistics(stats.level_one(p.gold(spark, sf)), ["product"])


@query("product_table", ["market_level1"], _table_sql("product") + " FROM market_level1")
def product_table(spark, sf):
    return _statistics(stats.level_one(p.market_gold(spark, sf)), ["product"])


@query("best_lag", ["best_lag"], "SELECT product, CAST(best_lag AS INTEGER) AS best_lag FROM best_lag")
def best_lag(spark, sf):
    return stats.best_lag(stats.level_one(p.gold(spark, sf)))


_KEY_SQL = _table_sql("entity, product", "CAST(insufficient AS INTEGER) AS insufficient, ")


@query("key_correlation", ["level2"], _KEY_SQL + " FROM level2")
def key_correlation(spark, sf):
    gold = p.gold(spark, sf)
    table = stats.level_two(gold, stats.best_lag(stats.level_one(gold)))
    return _statistics(table, ["entity", "product"], ("insufficient",))


@query("key_table", ["market_level2"], _KEY_SQL + " FROM market_level2")
def key_table(spark, sf):
    return _statistics(p.build_level_two(spark, sf), ["entity", "product"], ("insufficient",))


@query(
    "product_label",
    ["panel_a"],
    f"""SELECT product, CASE WHEN trim(product) = '{PRODUCT_PREFIX}' THEN '{GENERAL_LABEL}'
              ELSE upper(substr(rest, 1, 1)) || substr(rest, 2) END AS label, rows
       FROM (SELECT product, trim(split_part(regexp_replace(product, '^{PRODUCT_PREFIX}\\s*', ''), '(', 1)) AS rest,
                    count(*) AS rows FROM panel_a GROUP BY product)""",
)
def product_label(spark, sf):
    counted = p.panel_table(spark, sf).groupBy("product").agg(F.count("*").alias("rows"))
    return counted.select(
        "product", lb.product_label(F.col("product"), PRODUCT_PREFIX, GENERAL_LABEL).alias("label"), "rows"
    )


@query(
    "rho_matrix",
    ["market_level2"],
    "SELECT entity, "
    + ", ".join(
        f"round(max(CASE WHEN product = '{name}' THEN spearman END), 6) AS rho_{i}, "
        f"max(CASE WHEN product = '{name}' THEN CAST(significant AS INTEGER) END) AS sig_{i}"
        for i, name in enumerate(st.PRODUCTS)
    )
    + " FROM market_level2 GROUP BY entity",
)
def rho_matrix(spark, sf):
    matrix = stats.rho_matrix(p.level_two(spark, sf), st.PRODUCTS)
    n = range(len(st.PRODUCTS))
    flags = {f"sig_{i}": small(F.col(f"sig_{i}")) for i in n}
    return rounded(matrix.withColumns(flags), *[f"rho_{i}" for i in n])


@query(
    "figure_bars",
    ["market_level1", "market_best_lag"],
    """SELECT l.product, CAST(l.lag AS INTEGER) AS lag, round(coalesce(spearman, 0), 6) AS height,
              CASE WHEN coalesce(spearman, 0) < 0 THEN 'negative' ELSE 'positive' END AS sign_class,
              CASE WHEN significant THEN 'solid' ELSE 'light' END AS strength_class,
              CAST(coalesce(l.lag = b.best_lag, false) AS INTEGER) AS is_peak
       FROM market_level1 l LEFT JOIN market_best_lag b ON l.product = b.product""",
)
def figure_bars(spark, sf):
    bars = stats.figure_bars(p.level_one(spark, sf))
    return rounded(bars.withColumn("is_peak", small(F.col("is_peak"))), "height")


@query(
    "heat_cells",
    ["market_level2"],
    """SELECT entity, product, round(spearman, 6) AS spearman,
              CASE WHEN spearman IS NULL THEN 'hatched' WHEN significant THEN 'labelled' ELSE 'plain' END AS cell,
              CAST(coalesce(abs(spearman) > 0.5, false) AS INTEGER) AS light_text FROM market_level2""",
)
def heat_cells(spark, sf):
    cells = stats.heat_cells(p.level_two(spark, sf))
    return rounded(cells.withColumn("light_text", small(F.col("light_text"))), "spearman")


@query(
    "series_summary",
    ["series_lagged"],
    """SELECT count(*) FILTER (WHERE rate_change <> 0) AS months_with_change, min(rate) AS min_value,
              max(rate) AS max_value, count(*) AS months FROM series_lagged""",
)
def series_summary(spark, sf):
    return stats.series_summary(calendar.series_lags(p.series(spark, sf)))


@query(
    "last_months",
    ["series_lagged"],
    "SELECT month, rate, round(rate_change, 6) AS rate_change FROM series_lagged ORDER BY month DESC LIMIT 6",
)
def last_months(spark, sf):
    lags = calendar.series_lags(p.series(spark, sf)).select("month", "rate", "rate_change")
    return rounded(stats.last_rows(lags, 6), "rate_change")


@query(
    "significant_summary",
    ["market_level2"],
    """SELECT product, count(*) AS pairs, count(*) FILTER (WHERE spearman > 0) AS positive,
              count(*) FILTER (WHERE spearman < 0) AS negative, round(quantile_cont(spearman, 0.5), 6) AS median_rho,
              CAST(min(lag) AS INTEGER) AS lag FROM market_level2 WHERE significant GROUP BY product""",
)
def significant_summary(spark, sf):
    return rounded(stats.significant_summary(p.level_two(spark, sf)), "median_rho")


@query(
    "strongest_association",
    ["market_level1"],
    """SELECT product, CAST(lag AS INTEGER) AS lag, round(spearman, 6) AS spearman FROM market_level1
       WHERE spearman IS NOT NULL ORDER BY round(abs(spearman), 12) DESC, product, lag LIMIT 3""",
)
def strongest_association(spark, sf):
    top = stats.strongest(p.level_one(spark, sf), 3, ["product", "lag"])
    return rounded(top.select("product", "lag", "spearman"), "spearman")


# ---- G. panel for training --------------------------------------------------


@query(
    "cohort",
    ["panel_c"],
    "SELECT entity, product, count(*) AS months_present FROM panel_c GROUP BY ALL HAVING count(*) = 83",
)
def cohort(spark, sf):
    return features.cohort(st.panel_c(spark, sf), ["entity", "product"], 83)


@query(
    "excluded_keys",
    ["panel_c"],
    "SELECT entity, product, count(*) AS months_present FROM panel_c GROUP BY ALL HAVING count(*) < 83",
)
def excluded_keys(spark, sf):
    return features.excluded_keys(st.panel_c(spark, sf), ["entity", "product"], 83)


_FEATURE_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in features.NUMERIC_FEATURES)


@query(
    "ml_features",
    ["feature_rows"],
    f"SELECT entity, product, origin, {_FEATURE_SQL}, value_origin FROM feature_rows",
)
def ml_features(spark, sf):
    rows = features.features(p.gold(spark, sf), p.SPLIT).drop("gains")
    return rounded(rows, *features.NUMERIC_FEATURES)


_LEAK_CUT = "1999-06-01"
_LEAK_NAMES = ", ".join(f"'{n}'" for n in [*features.NUMERIC_FEATURES, "value_origin"])


@query(
    "leakage",
    ["feature_rows"],
    f"""SELECT feature, CAST(n AS BIGINT) AS compared, CAST(0 AS BIGINT) AS differing
       FROM (SELECT count(*) AS n FROM feature_rows WHERE origin <= DATE '{_LEAK_CUT}'), unnest([{_LEAK_NAMES}]) AS t(feature)""",
)
def leakage(spark, sf):
    """G12: what comes after a month changes no feature up to it."""
    return features.leakage(p.gold(spark, sf), p.SPLIT, _LEAK_CUT)


@query("ml_label", ["feature_rows"], "SELECT entity, product, origin, gains FROM feature_rows")
def ml_label(spark, sf):
    return features.features(p.gold(spark, sf), p.SPLIT).select("entity", "product", "origin", "gains")


@query(
    "ml_dataset",
    ["dataset"],
    f"SELECT entity, product, origin, {_FEATURE_SQL}, value_origin, gains, split FROM dataset",
)
def ml_dataset(spark, sf):
    return rounded(p.build_dataset(spark, sf), *features.NUMERIC_FEATURES)


@query(
    "split_rows",
    ["dataset"],
    """SELECT split, count(*) AS rows, count(gains) AS labelled, CAST(sum(gains) AS BIGINT) AS positives,
              min(origin) AS first_origin, max(origin) AS last_origin FROM dataset GROUP BY split""",
)
def split_rows(spark, sf):
    return p.dataset(spark, sf).groupBy("split").agg(
        F.count("*").alias("rows"),
        F.count("gains").alias("labelled"),
        F.sum("gains").alias("positives"),
        F.min("origin").alias("first_origin"),
        F.max("origin").alias("last_origin"),
    )


@query(
    "pivot_unpivot",
    ["panel_e"],
    "SELECT month, entity, value FROM panel_e",
)
def pivot_unpivot(spark, sf):
    wide = features.to_wide(st.panel_e(spark, sf), "month", "entity", ENTITY_CODES, "value")
    return features.to_long(wide, "month", "entity", "value")


@query(
    "pivot_wide",
    ["panel_e"],
    "SELECT month, "
    + ", ".join(f"max(CASE WHEN entity = '{c}' THEN value END) AS {c}" for c in ENTITY_CODES)
    + " FROM panel_e GROUP BY month",
)
def pivot_wide(spark, sf):
    return features.to_wide(st.panel_e(spark, sf), "month", "entity", ENTITY_CODES, "value")


# ---- H. training and evaluation --------------------------------------------

FOLDS = model.yearly_folds(p.FOLD_YEARS)
_RUNS: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf: str, what: str, build: Callable[[], object]) -> object:
    """Training results shared by the queries of one application."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _RUNS:
        _RUNS[key] = build()
    return _RUNS[key]


def fold_aucs(spark: SparkSession, sf: str) -> DataFrame:
    return _once(
        spark, sf, "aucs", lambda: cut_lineage(model.rolling_evaluation(p.dataset(spark, sf), FOLDS))
    )


def chosen_model(spark: SparkSession, sf: str) -> str:
    return _once(spark, sf, "chosen", lambda: model.chosen_name(model.model_choice(fold_aucs(spark, sf))))


def final_run(spark: SparkSession, sf: str, kind: str | None = None) -> model.FinalTest:
    kind = kind or chosen_model(spark, sf)
    return _once(spark, sf, f"final-{kind}", lambda: model.final_test(p.dataset(spark, sf), kind))


@query("rolling_eval")
def rolling_eval(spark, sf):
    return fold_aucs(spark, sf)


@query(
    "fold_sizes",
    ["dataset"],
    " UNION ALL ".join(
        f"SELECT '{f.name}_train' AS metric, count(*) AS n FROM dataset WHERE split = 'development' AND origin <= DATE '{f.train_end}' "
        f"UNION ALL SELECT '{f.name}_evaluation', count(*) FROM dataset WHERE split = 'development' "
        f"AND origin BETWEEN DATE '{f.first}' AND DATE '{f.last}'"
        for f in FOLDS
    ),
)
def fold_sizes(spark, sf):
    return model.fold_sizes(p.dataset(spark, sf), FOLDS)


@query("model_choice")
def model_choice(spark, sf):
    return model.model_choice(fold_aucs(spark, sf))


@query("rate_effect")
def rate_effect(spark, sf):
    return model.rate_effect(fold_aucs(spark, sf), chosen_model(spark, sf))


@query("final_test")
def final_test(spark, sf):
    return final_run(spark, sf).metrics


@query("test_predictions")
def test_predictions(spark, sf):
    return final_run(spark, sf).predictions


@query("auc_by_product")
def auc_by_product(spark, sf):
    return model.auc_by_product(final_run(spark, sf).scored)


@query("result_summary")
def result_summary(spark, sf):
    return model.result_summary(p.dataset(spark, sf), final_run(spark, sf).metrics)


@query("production_scores")
def production_scores(spark, sf):
    return model.production_scores(p.dataset(spark, sf), chosen_model(spark, sf))


@query("permutation_importance")
def permutation_importance(spark, sf):
    run = final_run(spark, sf, model.LOGISTIC)
    return model.permutation_importance(run.model, p.dataset(spark, sf).filter("split = 'test'"))


@query(
    "permutation_donors",
    ["dataset"],
    """SELECT CAST(r AS INTEGER) AS repeat, n AS rows, n AS donors, CAST(n * (n - 1) / 2 AS BIGINT) AS total, 1 AS mixed
       FROM (SELECT count(*) AS n FROM dataset WHERE split = 'test'), unnest(range(1, 4)) AS t(r)""",
)
def permutation_donors(spark, sf):
    """H15: in each repeat every test row lends its values once, and few to themselves."""
    lent = model.donors(p.dataset(spark, sf).filter("split = 'test'"), ["entity", "product", "origin"], repeats=3)
    return lent.groupBy("repeat").agg(
        F.count("*").alias("rows"),
        F.countDistinct("_donor").alias("donors"),
        F.sum("_donor").alias("total"),
        small(F.count_if(F.col("_row") == F.col("_donor")) < 10 + F.count("*") / 20).alias("mixed"),
    )


@query("coefficients")
def coefficients(spark, sf):
    return model.coefficients(final_run(spark, sf, model.LOGISTIC).model)


o.relation(
    "baseline_rows",
    ["dataset"],
    """SELECT 'majority_class' AS candidate, entity, product, origin, value_origin, gains, 0.5 AS score,
              CAST((SELECT avg(gains) FROM dataset WHERE split = 'development') >= 0.5 AS INTEGER) AS predicted
       FROM dataset WHERE split = 'test'
       UNION ALL SELECT 'mean_reversion', entity, product, origin, value_origin, gains, -acceleration_3m,
                        CAST(acceleration_3m < 0 AS INTEGER) FROM dataset WHERE split = 'test'""",
)


@query(
    "baseline_metrics",
    ["baseline_rows"],
    f"""SELECT candidate, 'auc' AS metric, round(auc, 6) AS value FROM ({o.auc_sql('baseline_rows', 'candidate')})
       UNION ALL SELECT candidate, 'auc_weighted', round(auc, 6) FROM ({o.auc_sql('baseline_rows', 'candidate', 'value_origin')})
       UNION ALL SELECT candidate, 'precision_at_n', round(avg(hit), 6) FROM (
           SELECT candidate, origin, avg(CAST(gains AS DOUBLE)) AS hit FROM (
               SELECT *, row_number() OVER (PARTITION BY candidate, origin ORDER BY score DESC, entity, product) AS pos
               FROM baseline_rows) WHERE pos <= 20 GROUP BY ALL) GROUP BY candidate
       UNION ALL SELECT candidate, metric, round(value, 6) FROM (
           UNPIVOT (
               SELECT candidate, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
                      coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
                      coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1,
                      (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy, CAST(tp + fp + fn + tn AS DOUBLE) AS rows
               FROM (SELECT candidate, count(*) FILTER (WHERE gains = 1 AND predicted = 1) AS tp,
                            count(*) FILTER (WHERE gains = 0 AND predicted = 1) AS fp,
                            count(*) FILTER (WHERE gains = 1 AND predicted = 0) AS fn,
                            count(*) FILTER (WHERE gains = 0 AND predicted = 0) AS tn FROM baseline_rows GROUP BY candidate)
           ) ON precision, recall, f1, accuracy, rows INTO NAME metric VALUE value)""",
)
def baseline_metrics(spark, sf):
    data = p.dataset(spark, sf)
    rows = evaluate.baseline_scores(data.filter("split = 'development'"), data.filter("split = 'test'"))
    return rounded(evaluate.metrics_table(rows.withColumn("score", F.col("score").cast("double"))), "value")


@query("auc_by_group", ["scores"], f"SELECT entity, round(auc, 6) AS auc FROM ({o.auc_sql('scores', 'entity')})")
def auc_by_group(spark, sf):
    return rounded(evaluate.auc(st.scores(spark, sf), "gains", "score", ["entity"]), "auc")


@query(
    "auc_weighted",
    ["scores"],
    f"""SELECT 'plain' AS kind, round(auc, 6) AS auc FROM ({o.auc_sql('scores', '')})
       UNION ALL SELECT 'weighted', round(auc, 6) FROM ({o.auc_sql('scores', '', 'weight')})""",
)
def auc_weighted(spark, sf):
    rows = st.scores(spark, sf)
    plain = evaluate.auc(rows, "gains", "score").select(F.lit("plain").alias("kind"), "auc")
    heavy = evaluate.auc(rows, "gains", "score", weight="weight").select(F.lit("weighted").alias("kind"), "auc")
    return rounded(plain.unionByName(heavy), "auc")


@query(
    "precision_at_n",
    ["scores"],
    f"SELECT list_size, round(precision, 6) AS precision FROM ({o.precision_sql('scores', 'score', (5, 10, 20))})",
)
def precision_at_n(spark, sf):
    rows = evaluate.precision_at_n(
        st.scores(spark, sf), "gains", "score", (5, 10, 20), "origin", ("entity", "product")
    )
    return rounded(rows, "precision")


o.relation(
    "score_cells",
    ["scores"],
    """SELECT entity, count(*) FILTER (WHERE gains = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE gains = 0 AND score >= 0.5) AS fp,
              count(*) FILTER (WHERE gains = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE gains = 0 AND score < 0.5) AS tn
       FROM scores GROUP BY entity""",
)
o.relation(
    "score_metrics",
    ["score_cells"],
    """SELECT entity, tp, fp, fn, tn, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
              coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
              coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1,
              (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy, tp + fp + fn + tn AS rows FROM score_cells""",
)


def _score_metrics(spark, sf) -> DataFrame:
    rows = st.scores(spark, sf).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return evaluate.confusion(rows, "gains", "predicted", ["entity"])


@query(
    "confusion_metrics",
    ["score_metrics"],
    """SELECT entity, tp, fp, fn, tn, rows, round(precision, 6) AS precision, round(recall, 6) AS recall,
              round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM score_metrics""",
)
def confusion_metrics(spark, sf):
    return rounded(_score_metrics(spark, sf), "precision", "recall", "f1", "accuracy")


@query(
    "metric_alerts",
    ["score_metrics"],
    """SELECT entity, metric, round(value, 6) AS value FROM (
           UNPIVOT (SELECT entity, precision, recall, f1, accuracy FROM score_metrics)
           ON precision, recall, f1, accuracy INTO NAME metric VALUE value) WHERE value > 0.6""",
)
def metric_alerts(spark, sf):
    names = ["precision", "recall", "f1", "accuracy"]
    long = _score_metrics(spark, sf).select("entity", *names).unpivot(["entity"], names, "metric", "value")
    return rounded(evaluate.alerts(long, limit=0.6), "value")


# ---- I. decision ------------------------------------------------------------


def _score_panel(spark, sf) -> DataFrame:
    return st.scores(spark, sf).select("entity", "product", F.col("origin").alias("month"), F.col("weight").alias("value"))


def _recommended(spark, sf) -> DataFrame:
    return decide.recommendation(st.scores(spark, sf), _score_panel(spark, sf))


@query(
    "recommendation",
    ["recommended"],
    'SELECT "group", position, entity, product, round(score, 6) AS score, value FROM recommended',
)
def recommendation(spark, sf):
    return rounded(_recommended(spark, sf), "score")


_RULES = """SELECT rule, parameter, round(per_month, 6) AS per_month, round(precision_model, 6) AS precision_model,
              round(recall_model, 6) AS recall_model, round(precision_simple, 6) AS precision_simple"""


def _sensitivity(spark, sf) -> DataFrame:
    return decide.sensitivity(st.scores(spark, sf))


@query("threshold_sensitivity", ["sensitivity"], f"{_RULES} FROM sensitivity WHERE rule = 'minimum score'")
def threshold_sensitivity(spark, sf):
    table = decide.threshold_sensitivity(st.scores(spark, sf))
    return rounded(table, "per_month", "precision_model", "recall_model", "precision_simple")


@query("list_sensitivity", ["sensitivity"], f"{_RULES} FROM sensitivity WHERE rule = 'top of the month'")
def list_sensitivity(spark, sf):
    table = decide.list_sensitivity(st.scores(spark, sf))
    return rounded(table, "per_month", "precision_model", "recall_model", "precision_simple")


o.relation(
    "strongest_significant",
    ["market_level1"],
    """SELECT product, lag, spearman, p_adjusted, significant FROM market_level1 WHERE spearman IS NOT NULL
       ORDER BY significant DESC, round(abs(spearman), 12) DESC, product, lag LIMIT 1""",
)
o.relation(
    "closing",
    ["recommended", "sensitivity", "scores", "strongest_significant"],
    """SELECT CAST(20 AS INTEGER) AS list_size,
              (SELECT CAST(sum(CAST(value AS DECIMAL(30,2))) AS DOUBLE) FROM recommended WHERE "group" = 'expand') AS list_value,
              s.precision_model, s.precision_simple, c.chance AS precision_chance,
              s.precision_model * 20 AS expected_hits, (1 - s.precision_model) * 20 AS expected_misses,
              s.precision_simple * 20 AS expected_hits_simple, c.chance * 20 AS expected_hits_chance,
              t.product AS strongest_product, CAST(t.lag AS INTEGER) AS strongest_lag, t.spearman AS strongest_rho,
              t.p_adjusted AS strongest_p_adjusted,
              (SELECT string_agg(entity || '|' || CAST(product AS VARCHAR), ';' ORDER BY position) FROM recommended
               WHERE "group" = 'expand' AND position <= 3) AS top3
       FROM sensitivity s, (SELECT avg(CAST(gains AS DOUBLE)) AS chance FROM scores) c, strongest_significant t
       WHERE s.rule = 'top of the month' AND s.parameter = 20""",
)
_CLOSING_DOUBLES = [
    "precision_model",
    "precision_simple",
    "precision_chance",
    "expected_hits",
    "expected_misses",
    "expected_hits_simple",
    "expected_hits_chance",
    "strongest_rho",
    "strongest_p_adjusted",
]
_CLOSING_SQL = (
    "SELECT list_size, list_value, strongest_product, strongest_lag, top3, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _CLOSING_DOUBLES)
    + " FROM closing"
)


def _closing(spark, sf) -> DataFrame:
    return decide.closing_numbers(
        _recommended(spark, sf), _sensitivity(spark, sf), st.scores(spark, sf), p.level_one(spark, sf)
    )


@query("closing_numbers", ["closing"], _CLOSING_SQL)
def closing_numbers(spark, sf):
    return rounded(_closing(spark, sf), *_CLOSING_DOUBLES)


@query(
    "strongest_significant",
    ["strongest_significant"],
    "SELECT product, CAST(lag AS INTEGER) AS lag, round(spearman, 6) AS spearman, CAST(significant AS INTEGER) AS significant FROM strongest_significant",
)
def strongest_significant(spark, sf):
    top = decide.strongest_significant(p.level_one(spark, sf))
    return rounded(
        top.select("product", "lag", "spearman", small(F.col("significant")).alias("significant")), "spearman"
    )


@query(
    "quarter_label",
    ["dataset"],
    f"""SELECT origin, {o._MONTHS}[month(origin + INTERVAL 3 MONTH)] || '–' || {o.month_label_sql('(origin + INTERVAL 5 MONTH)')} AS quarter
       FROM (SELECT max(origin) AS origin FROM dataset WHERE split = 'production')""",
)
def quarter_label(spark, sf):
    return decide.quarter(p.dataset(spark, sf).filter("split = 'production'"))


# ---- J. serving -------------------------------------------------------------


@query(
    "serve_last_publication",
    [],
    "SELECT strftime(max(ts) - INTERVAL 3 HOUR, '%d/%m/%Y %H:%M') AS published FROM events",
)
def serve_last_publication(spark, sf):
    control = st.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("published_at"))
    return serve.last_publication(control)


@query(
    "serve_recommendation",
    ["recommended"],
    'SELECT "group", position, entity, product, round(score, 6) AS score, value FROM recommended',
)
def serve_recommendation(spark, sf):
    return rounded(serve.recommendations(_recommended(spark, sf)), "score")


@query(
    "serve_rate",
    ["gold"],
    """SELECT strftime(month, '%Y-%m') AS month, max(rate) AS rate, round(max(rate_change), 6) AS rate_change
       FROM gold GROUP BY gold.month""",
)
def serve_rate(spark, sf):
    return rounded(serve.rate_by_month(p.gold(spark, sf)), "rate_change")


@query(
    "serve_national_value",
    ["gold"],
    """SELECT strftime(month, '%Y-%m') AS month, product, CAST(sum(CAST(value AS DECIMAL(30,2))) AS DOUBLE) AS value
       FROM gold GROUP BY gold.month, product""",
)
def serve_national_value(spark, sf):
    return serve.national_value(p.gold(spark, sf))


@query(
    "serve_product_correlations",
    ["market_level1"],
    """SELECT product, CAST(lag AS INTEGER) AS lag, CAST(n_months AS INTEGER) AS n_months, round(spearman, 6) AS spearman,
              round(p_adjusted, 6) AS p_adjusted, CAST(significant AS INTEGER) AS significant FROM market_level1""",
)
def serve_product_correlations(spark, sf):
    rows = serve.product_correlations(p.level_one(spark, sf)).withColumn("significant", small(F.col("significant")))
    return rounded(rows, "spearman", "p_adjusted")


@query(
    "serve_key_correlations",
    ["market_level2"],
    """SELECT entity, product, CAST(lag AS INTEGER) AS lag, CAST(n_months AS INTEGER) AS n_months,
              CAST(insufficient AS INTEGER) AS insufficient, round(spearman, 6) AS spearman, round(p_adjusted, 6) AS p_adjusted,
              CAST(significant AS INTEGER) AS significant FROM market_level2""",
)
def serve_key_correlations(spark, sf):
    rows = serve.key_correlations(p.level_two(spark, sf))
    flags = {c: small(F.col(c)) for c in ("insufficient", "significant")}
    return rounded(rows.withColumns(flags), "spearman", "p_adjusted")


o.relation(
    "reversion_scores",
    ["dataset"],
    """SELECT entity, product, origin, 1 / (1 + exp(acceleration_3m / 100)) AS score FROM dataset
       WHERE split = 'production'""",
)


def _reversion_scores(spark, sf) -> DataFrame:
    """Production scores of the mean-reversion rule: comparable in SQL, unlike a trained model's."""
    rows = p.dataset(spark, sf).filter("split = 'production'")
    return rows.select(
        "entity", "product", "origin", (F.lit(1) / (1 + F.exp(F.col("acceleration_3m") / 100))).alias("score")
    )


@query(
    "serve_predictions",
    ["reversion_scores"],
    "SELECT entity, product, strftime(origin, '%Y-%m') AS origin, round(score, 6) AS score FROM reversion_scores",
)
def serve_predictions(spark, sf):
    return rounded(serve.predictions(_reversion_scores(spark, sf)), "score")


@query(
    "publish_set",
    ["gold", "market_level1", "market_level2", "recommended", "sensitivity", "closing", "reversion_scores"],
    """SELECT 'gold' AS "table", count(*) AS rows, count(value_change_pct) AS measured FROM gold
       UNION ALL SELECT 'product_correlations', count(*), count(spearman) FROM market_level1
       UNION ALL SELECT 'key_correlations', count(*), count(spearman) FROM market_level2
       UNION ALL SELECT 'recommendation', count(*), count(value) FROM recommended
       UNION ALL SELECT 'predictions', count(*), count(score) FROM reversion_scores
       UNION ALL SELECT 'sensitivity', count(*), count(precision_model) FROM sensitivity
       UNION ALL SELECT 'closing', count(*), count(list_value) FROM closing
       UNION ALL SELECT 'publications', 2, 7""",
)
def publish_set(spark, sf):
    """J1: the seven published tables, read back through the newest manifest; the last row counts publications and tables."""
    root = _fresh_folder(spark, "published")
    closing = _closing(spark, sf)
    tables = {
        "gold": p.gold(spark, sf),
        "product_correlations": p.level_one(spark, sf),
        "key_correlations": p.level_two(spark, sf),
        "recommendation": _recommended(spark, sf),
        "predictions": _reversion_scores(spark, sf),
        "sensitivity": _sensitivity(spark, sf),
        "closing": closing.select(F.to_json(F.struct("*")).alias("document")),
    }
    listed = F.get_json_object("document", "$.list_value")
    measures = {"gold": "value_change_pct", "recommendation": "value", "predictions": "score", "sensitivity": "precision_model", "closing": listed}
    publish.publish({n: t.limit(0) for n, t in tables.items()}, root, "load-0", st.RUN_AT)
    publish.publish(tables, root, p.LOAD_ID, st.RUN_AT)
    control = publish.publications(spark, root)
    out = control.select(F.lit("publications").alias("table"), F.count("*").over(Window.partitionBy()).alias("rows"), F.size("tables").cast("long").alias("measured"))
    out = out.limit(1)
    for name in tables:
        measured = F.count(measures.get(name, "spearman")).alias("measured")
        out = out.unionByName(publish.read_published(spark, root, name).agg(F.lit(name).alias("table"), F.count("*").alias("rows"), measured))
    return out


def run_stages_of(spark, sf) -> list[run.Stage]:
    """Gold, statistics, dataset, decision and closing figures as stages of one run on the stand-in inputs."""
    return [
        run.Stage("gold", lambda: p.build_gold(spark, sf)),
        run.Stage("market_gold", lambda: panel.build_gold(p.panel_table(spark, sf), p.market_series(spark, sf))),
        run.Stage("level_one", stats.level_one, ["market_gold"]),
        run.Stage("level_two", lambda gold, one: stats.level_two(gold, stats.best_lag(one)), ["market_gold", "level_one"]),
        run.Stage("dataset", lambda gold: features.build_dataset(gold, p.SPLIT), ["gold"], settings={"split": repr(p.SPLIT)}),
        run.Stage("model_inputs", lambda rows: rows.filter("split IN ('development', 'test')"), ["dataset"], run.enough_rows),
        run.Stage("scores", lambda: st.scores(spark, sf)),
        run.Stage("recommendation", lambda _, scored: decide.recommendation(scored, _score_panel(spark, sf)), ["model_inputs", "scores"], run.all_there(["model_inputs", "scores"])),
        run.Stage("sensitivity", decide.sensitivity, ["scores"], run.all_there(["scores"])),
        run.Stage(
            "closing", decide.closing_numbers, ["recommendation", "sensitivity", "scores", "level_one"],
            run.all_there(["recommendation", "sensitivity", "scores", "level_one"]),
        ),
    ]


@query(
    "run_all",
    ["gold", "market_gold", "market_level1", "market_level2", "dataset", "scores", "recommended", "sensitivity", "closing"],
    """, counted AS (
           SELECT 'gold' AS stage, count(*) AS rows FROM gold UNION ALL SELECT 'market_gold', count(*) FROM market_gold
           UNION ALL SELECT 'level_one', count(*) FROM market_level1 UNION ALL SELECT 'level_two', count(*) FROM market_level2
           UNION ALL SELECT 'dataset', count(*) FROM dataset
           UNION ALL SELECT 'model_inputs', count(*) FROM dataset WHERE split IN ('development', 'test')
           UNION ALL SELECT 'scores', count(*) FROM scores UNION ALL SELECT 'recommendation', count(*) FROM recommended
           UNION ALL SELECT 'sensitivity', count(*) FROM sensitivity UNION ALL SELECT 'closing', count(*) FROM closing)
       SELECT 1 AS run, stage, 'built' AS state, rows FROM counted UNION ALL SELECT 2, stage, 'reused', rows FROM counted""",
)
def run_all(spark, sf):
    """A8, A9, H19, I8: the run from gold to the closing figures, twice; the second finds every stage."""
    root = _fresh_folder(spark, "run")
    parts = []
    for number in (1, 2):
        outcomes = run.run_stages(spark, run_stages_of(spark, sf), f"{root}/stages", fingerprint(spark, sf))
        told = run.report(spark, outcomes)
        if not run.write_report(told, f"{root}/reports", f"run-{number}", st.RUN_AT):
            raise RuntimeError("report not written")
        read = spark.read.json(f"{root}/reports/run-{number}.json").filter("section = 'stages'")
        items = read.select(F.from_json("item", "stage string, state string, rows long").alias("i"))
        parts.append(items.select(F.lit(number).alias("run"), "i.stage", "i.state", "i.rows"))
    return parts[0].unionByName(parts[1])


@query(
    "serve_sensitivity",
    ["sensitivity"],
    _RULES
    + """, CAST(rule = 'top of the month' AND parameter = 20 AS INTEGER) AS adopted,
              CAST(row_number() OVER (ORDER BY rule = 'top of the month', parameter) AS INTEGER) AS "order" FROM sensitivity""",
)
def serve_sensitivity(spark, sf):
    rows = serve.rule_order(_sensitivity(spark, sf)).withColumn("adopted", small(F.col("adopted")))
    return rounded(rows, "per_month", "precision_model", "recall_model", "precision_simple")


@query("serve_closing", ["closing"], _CLOSING_SQL)
def serve_closing(spark, sf):
    closing = _closing(spark, sf)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in closing.schema.fields)
    stored = closing.select(F.to_json(F.struct("*")).alias("document"))
    return rounded(serve.closing_document(stored, schema), *_CLOSING_DOUBLES)


@query(
    "serve_key_series",
    ["gold"],
    """SELECT strftime(month, '%Y-%m') AS month, value, round(value_change_pct, 6) AS value_change_pct,
              CAST(qty_disclosed AS DOUBLE) AS qty_disclosed, rate
       FROM gold WHERE entity = 'BA' AND product = 'Financiamentos imobiliários'""",
)
def serve_key_series(spark, sf):
    rows = serve.key_series(spark, p.gold(spark, sf), "BA", "Financiamentos imobiliários")
    return rounded(rows, "value_change_pct")


@query(
    "align_axis",
    ["panel_b", "series"],
    """SELECT s.month, b.value, round(b.value_change_pct, 6) AS value_change_pct FROM series s
       LEFT JOIN (SELECT * FROM ("""
    + o.changes("panel_b")
    + ") WHERE entity = 'BA' AND product = 'BUILDING') b ON s.month = b.month",
)
def align_axis(spark, sf):
    changed = panel.consecutive_changes(st.panel_b(spark, sf), ["entity", "product"])
    one = changed.filter("entity = 'BA' AND product = 'BUILDING'").select("month", "value", "value_change_pct")
    return rounded(serve.align(one, p.series(spark, sf)), "value_change_pct")


@query(
    "list_drilldown",
    ["recommended"],
    """SELECT position, entity, product, value, round(coalesce(value, 0) / greatest(1, max(value) OVER ()), 6) AS bar,
              count(*) OVER (PARTITION BY entity) AS entity_rows FROM recommended WHERE "group" = 'expand'""",
)
def list_drilldown(spark, sf):
    return rounded(serve.drilldown(_recommended(spark, sf)), "bar")


def _key_lists(spark, sf) -> DataFrame:
    return decide.recommendation(_reversion_scores(spark, sf), p.gold(spark, sf))


o.relation(
    "key_lists",
    ["reversion_scores", "gold"],
    " UNION ALL ".join(
        f"""SELECT '{group}' AS "group", CAST(pos AS INTEGER) AS position, r.entity, r.product, r.score, g.value FROM (
            SELECT *, row_number() OVER (ORDER BY score {order}, entity, product) AS pos FROM reversion_scores) r
            LEFT JOIN gold g ON g.entity = r.entity AND g.product = r.product AND g.month = r.origin WHERE pos <= 20"""
        for group, order in (("expand", "DESC"), ("alert", "ASC"))
    ),
)
o.relation("list_names", ["product_dim", "panel_a"], o.product_names_sql("panel_a"))


@query(
    "key_recommendation",
    ["key_lists"],
    'SELECT "group", position, entity, product, round(score, 6) AS score, value FROM key_lists',
)
def key_recommendation(spark, sf):
    return rounded(_key_lists(spark, sf), "score")


@query(
    "list_by_product",
    ["key_lists", "list_names"],
    """SELECT n.name, count(*) AS rows FROM key_lists l JOIN list_names n ON l.product = n.product
       WHERE l."group" = 'expand' GROUP BY n.name""",
)
def list_by_product(spark, sf):
    return serve.list_by_product(_key_lists(spark, sf))


@query(
    "heatmap_counters",
    ["market_level2"],
    """SELECT count(spearman) AS computed, count(*) FILTER (WHERE significant) AS significant,
              count(*) FILTER (WHERE significant AND spearman > 0) AS positive,
              count(*) FILTER (WHERE significant AND spearman < 0) AS negative,
              count(*) FILTER (WHERE insufficient) AS insufficient FROM market_level2""",
)
def heatmap_counters(spark, sf):
    return serve.heatmap_counters(p.level_two(spark, sf))


@query(
    "change_points",
    ["series_lagged"],
    """SELECT count(*) FILTER (WHERE rate_change <> 0) AS months_with_change,
              (SELECT month FROM series_lagged ORDER BY rate DESC, month LIMIT 1) AS month_of_max,
              (SELECT month FROM series_lagged ORDER BY rate, month LIMIT 1) AS month_of_min FROM series_lagged""",
)
def change_points(spark, sf):
    return serve.change_points(calendar.series_lags(p.series(spark, sf)))


o.relation(
    "axis_limits",
    ["gold"],
    """SELECT entity, product, greatest(1.0, coalesce(a[CAST(floor(len(a) * 0.98) AS BIGINT) + 1], 1.0)) AS "limit" FROM (
           SELECT entity, product, coalesce(list_sort(list(abs(value_change_pct)) FILTER (WHERE value_change_pct IS NOT NULL)), []) AS a
           FROM gold GROUP BY ALL)""",
)


@query("axis_limit", ["axis_limits"], 'SELECT entity, product, round("limit", 6) AS "limit" FROM axis_limits')
def axis_limit(spark, sf):
    return rounded(serve.axis_limit(p.gold(spark, sf), ["entity", "product"]), "limit")


@query(
    "clipped_changes",
    ["gold", "axis_limits"],
    """SELECT g.month, g.entity, g.product, round(greatest(-"limit", least("limit", value_change_pct)), 6) AS clipped
       FROM gold g JOIN axis_limits a ON g.entity = a.entity AND g.product = a.product WHERE value_change_pct IS NOT NULL""",
)
def clipped_changes(spark, sf):
    by = ["entity", "product"]
    gold = p.gold(spark, sf).select("month", *by, "value_change_pct").filter("value_change_pct IS NOT NULL")
    limits = serve.axis_limit(gold, by)
    clipped = serve.clip(F.col("value_change_pct"), F.col("limit"))
    return rounded(gold.join(limits, by).select("month", *by, clipped.alias("clipped")), "clipped")


@query(
    "key_status",
    ["market_level2", "reversion_scores", "key_lists"],
    """SELECT c.entity, c.product, round(s.score, 6) AS score,
              CASE WHEN l.position IS NULL THEN 'outside the lists'
                   ELSE 'list ' || l."group" || ' #' || CAST(l.position AS VARCHAR) END AS status,
              CAST(c.insufficient OR c.spearman IS NULL AS INTEGER) AS without_correlation
       FROM market_level2 c LEFT JOIN reversion_scores s ON c.entity = s.entity AND c.product = s.product
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY entity, product ORDER BY "group" <> 'expand') AS rn FROM key_lists) l
         ON c.entity = l.entity AND c.product = l.product AND l.rn = 1""",
)
def key_status(spark, sf):
    rows = serve.key_status(_reversion_scores(spark, sf), p.level_two(spark, sf), _key_lists(spark, sf))
    return rounded(rows.withColumn("without_correlation", small(F.col("without_correlation"))), "score")


@query("product_dim", ["list_names"], "SELECT * FROM list_names")
def product_dim(spark, sf):
    return serve.ordered_products(p.panel_table(spark, sf))


@query(
    "entity_dim",
    ["panel_a", "entity_dim"],
    """SELECT p.entity, entity_name, grid_column, grid_row, rows FROM (
           SELECT entity, count(*) AS rows FROM panel_a GROUP BY entity) p JOIN entity_dim d ON p.entity = d.code""",
)
def entity_dim(spark, sf):
    counted = p.panel_table(spark, sf).groupBy("entity").agg(F.count("*").alias("rows"))
    return serve.with_entity_names(counted)


_SIGNED = "CASE WHEN v > 0 THEN '+' WHEN v < 0 THEN '−' ELSE '' END || " + o.number_text_sql("abs(v)", 2)


@query(
    "format_labels",
    ["gold"],
    f"""SELECT month, entity, product, {o.month_label_sql('month')} AS month_label, {o.number_text_sql('rate', 2)} AS rate_text,
              CASE WHEN value_change_pct IS NULL THEN '—' ELSE {_SIGNED} END AS change_text,
              CASE WHEN value_change_pct IS NULL THEN '—' ELSE {o.number_text_sql('value_change_pct / 100 * 100', 2)} || '%' END AS percent_text,
              CASE WHEN value IS NULL THEN '—' WHEN value = 0 THEN 'R$ 0'
                   WHEN value >= 1e12 THEN 'R$ ' || {o.number_text_sql('value / 1e12', 2)} || ' tri'
                   WHEN value >= 1e9 THEN 'R$ ' || {o.number_text_sql('value / 1e9', 1)} || ' bi'
                   WHEN value >= 1e6 THEN 'R$ ' || {o.number_text_sql('value / 1e6', 1)} || ' mi'
                   ELSE 'R$ ' || {o.number_text_sql('value / 1e3', 0)} || ' mil' END AS value_text
       FROM (SELECT *, round(value_change_pct, 2) AS v FROM gold)""",
)
def format_labels(spark, sf):
    gold = p.gold(spark, sf)
    return gold.select(
        "month",
        "entity",
        "product",
        lb.month_label(F.col("month")).alias("month_label"),
        lb.number_text(F.col("rate"), 2).alias("rate_text"),
        lb.signed_text(F.col("value_change_pct"), 2).alias("change_text"),
        lb.percent_text(F.col("value_change_pct") / 100, 2).alias("percent_text"),
        lb.currency_text(F.col("value")).alias("value_text"),
    )
