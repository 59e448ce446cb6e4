"""Credentials in texts, told from copied examples by how many owners hold the same value.

Every text is scanned once. The values found are reduced to hashes, and the hashes are counted over the
whole corpus: in how many repositories (here: rows) and with how many distinct owners each occurs. A value
that many owners hold is a copied example; one that few owners hold and that looks random is taken for a
live credential of theirs. Counting goes by (hash, owner) first, so a value that fills a third of the
corpus reaches the second step as one row per owner.

Offsets come from the lengths of the pieces between the matches and of the matches themselves, summed in
a window over the (few) matches of one text and kind. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.store import Workspace

KINDS = ("assign", "access", "hex", "generic")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Of the two kinds below, shorter runs never become matches; for `assign` a short match still uses up its text.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
GENERIC = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+"
ASSIGN_LEAST = 6
# An owner count from which a value is a copied example, and what a live-looking value has at least.
SHARED_OWNERS = 5
LIVE_CHARS, LIVE_DISTINCT = 16, 8


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """Every match of one kind, in order, with the length of the text between it and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("match")))
    rows = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), x["match"].alias("match")))
    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,match:string>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def _live_looking(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LIVE_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= LIVE_DISTINCT)


def _generic_shape(value: Column) -> Column:
    """A generic token needs all three classes of characters; words, paths and rules of dashes lack one."""
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def scan(
    ws: Workspace, df: DataFrame, id_col: str, text_col: str, owner_col: str, row_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows (row, id, owner), and spans (row, kind, start, end, n_repos, n_owners, shared, live) of candidates.

    ``row`` numbers the input's rows, so rows that repeat an id stay apart; it is ``row_col`` if the input has
    been written with such numbers. ``end`` is exclusive; both offsets count code points. Generic tokens come
    back only when they are live.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*(_matches(text, k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, GENERIC))))
    rows = ws.table(
        df.select(
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
            F.col(id_col).alias("id"),
            F.col(owner_col).cast("string").alias("owner"),
            found.alias("found"),
        )
    )
    in_text = Window.partitionBy("row", "kind").orderBy("nth")
    size = F.length("match")
    spans = (
        rows.select("row", "owner", F.inline("found"))
        .withColumn("end", F.sum(F.col("gap") + size).over(in_text))
        .withColumn("start", F.col("end") - size)
        .withColumn("value", F.when(F.col("kind") == 0, F.regexp_extract("match", f"^{ASSIGN}$", 2)).otherwise(F.col("match")))
        .where((F.col("kind") != 0) | (F.length("value") >= ASSIGN_LEAST))
        .where((F.col("kind") != 3) | _generic_shape(F.col("value")))
        .select("row", "owner", "kind", "start", "end", _live_looking(F.col("value")).alias("live_looking"), F.sha2("value", 256).alias("hash"))
    )
    spans = ws.table(spans)
    held = (
        spans.groupBy("hash", "owner", "row").agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    )
    shared = F.col("n_owners") >= SHARED_OWNERS
    judged = spans.join(held, "hash").select(
        "row", "kind", "start", "end", "n_repos", "n_owners",
        shared.alias("shared"), (F.col("live_looking") & ~shared).alias("live"),
    )
    return rows.select("row", "id", "owner"), judged.where((F.col("kind") != 3) | F.col("live"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per input row: its candidates counted by kind, their spans, and the verdict of ownership.

    Columns: the id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` (digest of the spans of these
    three), ``spans`` (those and the live generic tokens, as kind:start:end), ``n_live`` and ``n_shared``
    (distinct spans judged so). NULL or empty text has no spans. NULL owners count as one owner. Rows that repeat
    an id, or whole rows, are scanned and returned each; columns of other names are ignored.
    """
    ws = Workspace(df.sparkSession, "secrets")
    rows, judged = scan(ws, df, id_col, text_col, owner_col)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    label = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    by_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", label.alias("label")))).alias("list"),
        F.count_if(F.col("live")).alias("n_live"),
        F.count_if(F.col("shared")).alias("n_shared"),
    )
    every = F.coalesce("list", F.array().cast("array<struct<start:bigint,kind:int,label:string>>"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: s["label"]), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long")

    return rows.join(by_row, "row", "left").select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter(every, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
    )


def redact_live(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[secret]"
) -> DataFrame:
    """``df`` with each live credential's span in ``text_col`` replaced by ``mark``; copied examples stay.

    Overlapping spans become one. Rows are numbered and written with their texts, and cut by that number, so
    ids may be NULL or repeat.
    """
    ws = Workspace(df.sparkSession, "redact")
    numbered = ws.table(df.withColumn("_cut_row", F.monotonically_increasing_id()))
    _, judged = scan(ws, numbered, id_col, text_col, owner_col, "_cut_row")
    order = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    merged = (
        judged.where("live").select("row", "start", "end").distinct()
        .withColumn("fresh", F.when(F.col("start") <= F.max("end").over(order), 0).otherwise(1))
        .withColumn("block", F.sum("fresh").over(Window.partitionBy("row").orderBy("start", "end")))
        .groupBy("row", "block").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    )
    cuts = ws.table(merged.select(F.col("row").alias("_cut_row"), F.col("cuts").alias("_cuts")))
    text = F.col(text_col)

    def before(cut: Column, i: Column) -> Column:
        left = F.when(i > 0, F.get(F.col("_cuts"), i - 1)["end"]).otherwise(0)
        return F.substring(text, (left + 1).cast("int"), (cut["start"] - left).cast("int"))

    tail = F.substring(text, (F.element_at("_cuts", -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.concat(F.array_join(F.transform("_cuts", lambda c, i: F.concat(before(c, i), F.lit(mark))), ""), tail)
    joined = numbered.join(cuts, "_cut_row", "left")
    return joined.withColumn(text_col, F.when(F.col("_cuts").isNull(), text).otherwise(clean)).select(df.columns)
