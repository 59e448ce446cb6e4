"""Exact duplicates by deterministic naming of fixed-size blocks.

A text is cut into blocks of ``block_bytes`` bytes of its UTF-8 form. All blocks of the corpus are sorted,
and each distinct block that occurs twice or more gets an integer name in that order. Then adjacent names
are paired, distinct pairs are sorted and named, and so on, until each text that can still have an equal
has one name. Two texts have the same number of blocks and the same name exactly when they are identical:
names stand for contents compared in full, so there are no collisions.

A block or pair that occurs once in the corpus proves that its text has no equal; such texts leave at
once and only their own row comes back at the end. Each round therefore handles fewer and shorter rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.store import Workspace

BLOCK_BYTES = 4096


def _named(ws: Workspace, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted integer names of the values of ``keys`` that occur twice or more.

    The order is by hash, then by value: even ranges, and a short key for the samples that set them. Names
    are written before they are used, so a task that runs again reads them and can't name anew.
    """
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    repeated = repeated.withColumn("place", F.xxhash64(*keys))
    ordered = repeated.repartitionByRange(parts, "place").sortWithinPartitions("place", *keys).drop("place")
    return ws.table(ordered.withColumn("name", F.monotonically_increasing_id()))


def _blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    raw = F.col("text").cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int")
    return texts.select(
        "row_id",
        "text_sha256",
        count.alias("n_blocks"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)),
            )
        ).alias("idx", "block"),
    )


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per input row: id, ``keep_id`` (largest id of the identical texts), ``group_size``, ``kept``, ``text_sha256``.

    NULL text counts as the empty text, so all NULL and empty texts form one group. Rows that repeat an id
    with the same text count in ``group_size``; those with the largest id are all marked ``kept``, since
    nothing tells them apart. A NULL id never outranks another id. Other columns are neither read nor
    returned, whatever their names. An empty table gives an empty result.
    """
    ws = Workspace(df.sparkSession, "exact-dedup")
    clean = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(F.col(id_col).alias("row_id"), clean.alias("text")).withColumn(
        "text_sha256", F.sha2(F.col("text").cast("binary"), 256)
    )
    blocks = _blocks(texts, block_bytes)
    names = _named(ws, blocks, ["block"])
    key = ["row_id", "text_sha256", "n_blocks"]
    level = ws.table(blocks.join(names, "block").select(*key, "idx", "name"))
    ws.drop(names)
    width = F.col("n_blocks")
    done = level.where("n_blocks = 1")
    finished = [done.select("row_id", "text_sha256", "n_blocks", "name")]
    longest = level.agg(F.max("n_blocks")).first()[0] or 0
    spans = 1
    while spans < longest:
        # Repeated rows of one id and text carry the same names, so max() picks "the" name of either half.
        span = spans
        open_rows = level.where(width > span)
        pairs = open_rows.groupBy(*key, (F.col("idx").bitwiseAND(~1)).alias("at")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("left_name"),
            F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("right_name"),
            F.count(F.when(F.col("idx") % 2 == 0, 1)).alias("copies"),
        )
        last = F.ceil(width / span).cast("int") - 1
        pairs = pairs.where("left_name is not null").where(
            F.col("right_name").isNotNull() | (F.col("at") == last)
        )
        pairs = pairs.withColumn("right_name", F.coalesce("right_name", F.lit(-1)))
        names = _named(
            ws,
            pairs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(2))))),
            ["left_name", "right_name"],
        )
        joined = pairs.join(names, ["left_name", "right_name"])
        following = ws.table(
            joined.select(
                *key,
                F.shiftright("at", 1).cast("int").alias("idx"),
                "name",
                F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
            ).drop("copy")
        )
        ws.drop(names)
        spans *= 2
        level = following
        finished.append(level.where((width > span) & (width <= spans)).select(*key, "name"))
    whole = finished[0]
    for part in finished[1:]:
        whole = whole.unionByName(part)
    groups = whole.groupBy("n_blocks", "name").agg(
        F.max("row_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = ws.table(groups.where("group_size > 1"))  # written, so a hot group's join can be split
    members = ws.table(
        whole.join(groups, ["n_blocks", "name"])
        .select("row_id", "text_sha256", "keep_id", "group_size")
        .distinct()
    )
    left = texts.select("row_id", "text_sha256").alias("t")
    match = F.col("t.row_id").eqNullSafe(F.col("m.row_id")) & (F.col("t.text_sha256") == F.col("m.text_sha256"))
    found = left.join(members.alias("m"), match, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("t.row_id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("t.row_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("t.row_id").eqNullSafe(keep).alias("kept"),
        F.col("t.text_sha256").alias("text_sha256"),
    )
