"""J4–J20. Reads behind the published page, as DataFrames over the published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.labels import plain_lower
from panelwright.functions.reference_data import (
    ENTITIES,
    PRODUCT_PREFIX,
    PRODUCTS,
    entity_dimension,
)
from panelwright.operators.decide import EXPAND, RULE_LIST, RULE_THRESHOLD

LOCAL_ZONE = "America/Sao_Paulo"


def month_text(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def last_publication(control: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """J4. Newest publication instant in local time."""
    local = F.from_utc_timestamp("published_at", zone)
    return control.orderBy(F.col("published_at").desc()).limit(1).select(
        F.date_format(local, "dd/MM/yyyy HH:mm").alias("published")
    )


def recommendations(table: DataFrame) -> DataFrame:
    """J5."""
    return table.select(
        "group", F.col("position").cast("int").alias("position"), "entity", "product", "score", "value"
    ).orderBy(F.col("group").desc(), "position")


def rate_by_month(gold: DataFrame) -> DataFrame:
    """J6. One row per month; all rows of a month carry the same rate."""
    return (
        gold.groupBy("month")
        .agg(F.max("rate").alias("rate"), F.max("rate_change").alias("rate_change"))
        .orderBy("month")
        .select(month_text(F.col("month")).alias("month"), "rate", "rate_change")
    )


def national_value(gold: DataFrame) -> DataFrame:
    """J7."""
    return (
        gold.groupBy("month", "product")
        .agg(F.sum(F.col("value").cast("decimal(30,2)")).cast("double").alias("value"))
        .orderBy("product", "month")
        .select(month_text(F.col("month")).alias("month"), "product", "value")
    )


def product_correlations(level1: DataFrame) -> DataFrame:
    """J8."""
    return level1.select(
        "product",
        F.col("lag").cast("int").alias("lag"),
        F.col("n_months").cast("int").alias("n_months"),
        "spearman",
        "p_adjusted",
        "significant",
    ).orderBy("product", "lag")


def key_correlations(level2: DataFrame) -> DataFrame:
    """J8."""
    return level2.select(
        "entity",
        "product",
        F.col("lag").cast("int").alias("lag"),
        F.col("n_months").cast("int").alias("n_months"),
        "insufficient",
        "spearman",
        "p_adjusted",
        F.coalesce("significant", F.lit(False)).alias("significant"),
    ).orderBy("entity", "product")


def predictions(scores: DataFrame) -> DataFrame:
    """J9."""
    return scores.select(
        "entity", "product", month_text(F.col("origin")).alias("origin"), "score"
    ).orderBy(F.col("score").desc(), "entity", "product")


def closing_document(published: DataFrame, schema: str) -> DataFrame:
    """J9. Closing figures stored as one JSON text, read back as columns."""
    return published.select(F.from_json("document", schema).alias("d")).select("d.*")


SERIES_QUERY = """
    SELECT date_format(month, 'yyyy-MM') AS month, value, value_change_pct,
           CAST(qty_disclosed AS DOUBLE) AS qty_disclosed, rate
    FROM {gold}
    WHERE entity = :entity AND product = :product
    ORDER BY month
"""


def key_series(spark: SparkSession, gold: DataFrame, entity: str, product: str) -> DataFrame:
    """J10. One series by key, through parameter markers; arguments are checked first.

    On a table written sorted by key the two equality filters prune files.
    """
    if entity not in {code for code, *_ in ENTITIES} or not product.startswith(PRODUCT_PREFIX):
        raise ValueError(f"unknown key: {entity}, {product}")
    return spark.sql(SERIES_QUERY, args={"entity": entity, "product": product}, gold=gold)


def align(series: DataFrame, months: DataFrame, month: str = "month") -> DataFrame:
    """J11. Series on the scope axis; a month without a row stays NULL."""
    return months.select(month).distinct().join(series, month, "left")


def listed_products(dim_rows: DataFrame, product: str = "product") -> DataFrame:
    """J18. Display names of product names that occur in a table.

    A bare prefix is the general product; otherwise the first known fragment
    in display order wins; an unknown product shows its own name. The fixed
    dimension becomes one conditional expression, so there is no join.
    """
    text = plain_lower(F.col(product))
    rest = F.trim(
        F.split_part(F.regexp_replace(F.col(product), f"(?i)^{PRODUCT_PREFIX}\\s*", ""), F.lit("("), F.lit(1))
    )
    rest = F.when(rest == "", F.col(product)).otherwise(rest)

    def entry(position: Column, key: Column, name: Column, short: Column) -> Column:
        return F.struct(
            key.alias("product_key"), name.alias("name"), short.alias("short_name"), position.alias("position")
        )

    for position, key, fragment, name, short in sorted(PRODUCTS, key=lambda p: p[2] != ""):
        test = text.contains(fragment) if fragment else F.trim(text) == PRODUCT_PREFIX.lower()
        known = entry(F.lit(position), F.lit(key), F.lit(name), F.lit(short))
        found = F.when(test, known) if not fragment else found.when(test, known)
    shown = found.otherwise(entry(F.lit(len(PRODUCTS) + 1), text, rest, F.substring(rest, 1, 8)))
    return dim_rows.select(product).distinct().select(product, shown.alias("_d")).select(product, "_d.*")


def ordered_products(table: DataFrame, product: str = "product") -> DataFrame:
    """J18. Display order: known products by position, the others by name."""
    return listed_products(table, product).orderBy("position", product)


def drilldown(recommended: DataFrame, group: str = EXPAND) -> DataFrame:
    """J12. One list by value, with its largest value and the number of rows of its entity."""
    listed = recommended.filter(F.col("group") == group)
    top = F.greatest(F.lit(1.0), F.coalesce(listed.agg(F.max("value")).scalar(), F.lit(0.0)))
    same_entity = Window.partitionBy("entity")  # a list has at most 2 × top rows
    return listed.select(
        "position",
        "entity",
        "product",
        "value",
        (F.coalesce("value", F.lit(0.0)) / top).alias("bar"),
        F.count(F.lit(1)).over(same_entity).alias("entity_rows"),
    ).orderBy(F.coalesce("value", F.lit(0.0)).desc(), "position")


def list_by_product(recommended: DataFrame, group: str = EXPAND) -> DataFrame:
    """J12. Rows of one list per display product."""
    listed = recommended.filter(F.col("group") == group)
    names = listed_products(listed).select("product", "name")
    return listed.join(names, "product").groupBy("name").agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "name")


def heatmap_counters(level2: DataFrame) -> DataFrame:
    """J13."""
    significant = F.col("significant")
    return level2.agg(
        F.count_if(F.col("spearman").isNotNull()).alias("computed"),
        F.count_if(significant).alias("significant"),
        F.count_if(significant & (F.col("spearman") > 0)).alias("positive"),
        F.count_if(significant & (F.col("spearman") < 0)).alias("negative"),
        F.count_if(F.col("insufficient")).alias("insufficient"),
    )


def change_points(series: DataFrame, month: str = "month", rate: str = "rate", change: str = "rate_change") -> DataFrame:
    """J14. Months with a change; first month of the maximum and of the minimum."""
    first = -F.unix_date(F.col(month))
    last = F.unix_date(F.col(month))
    return series.agg(
        F.count_if(F.coalesce(F.col(change) != 0, F.lit(False))).alias("months_with_change"),
        F.max_by(month, F.struct(rate, first)).alias("month_of_max"),
        F.min_by(month, F.struct(rate, last)).alias("month_of_min"),
    )


def axis_limit(changes: DataFrame, by: Sequence[str], change: str = "value_change_pct", quantile: float = 0.98) -> DataFrame:
    """J15. Value at index floor(q·n) of the sorted absolute changes, at least 1.

    A key has at most one change per calendar month, so its array is bounded.
    """
    sizes = F.sort_array(F.collect_list(F.abs(change)))
    listed = changes.groupBy(*by).agg(sizes.alias("_a"))
    at = F.floor(F.size("_a") * F.lit(quantile)).cast("int")
    return listed.select(
        *by, F.greatest(F.lit(1.0), F.coalesce(F.get("_a", at), F.lit(1.0))).alias("limit")
    )


def clip(value: Column, limit: Column) -> Column:
    """J15."""
    return F.greatest(-limit, F.least(limit, value))


def key_status(scores: DataFrame, level2: DataFrame, recommended: DataFrame, keys: Sequence[str] = ("entity", "product")) -> DataFrame:
    """J16. Score, correlation and list position of every key, with its status label."""
    lists = recommended.groupBy(*keys).agg(F.min(F.struct(F.col("group") != EXPAND, "group", "position")).alias("_l"))
    correlation = level2.select(*keys, "insufficient", "spearman")
    joined = correlation.join(scores.select(*keys, "score"), list(keys), "left").join(lists, list(keys), "left")
    label = F.when(F.col("_l").isNull(), F.lit("outside the lists")).otherwise(
        F.concat(F.lit("list "), F.col("_l.group"), F.lit(" #"), F.col("_l.position").cast("string"))
    )
    return joined.select(
        *keys,
        "score",
        label.alias("status"),
        (F.col("insufficient") | F.col("spearman").isNull()).alias("without_correlation"),
    )


def rule_order(sensitivities: DataFrame, adopted_size: int = 20) -> DataFrame:
    """J17. Score rules first, then list rules, each ascending; the adopted rule is marked."""
    rank = F.when(F.col("rule") == RULE_THRESHOLD, 0).otherwise(1)
    adopted = (F.col("rule") == RULE_LIST) & (F.col("parameter") == float(adopted_size))
    position = Window.orderBy(rank, "parameter")  # one row per rule
    return sensitivities.select("*", adopted.alias("adopted"), F.row_number().over(position).alias("order")).orderBy("order")


def with_entity_names(df: DataFrame, entity: str = "entity") -> DataFrame:
    """J20. Name and grid place of an entity code; an unknown code shows itself."""
    dim = F.broadcast(entity_dimension(df.sparkSession).withColumnRenamed("entity", "_code"))  # 27 rows
    return (
        df.join(dim, F.col(entity) == F.col("_code"), "left")
        .drop("_code")
        .withColumn("entity_name", F.coalesce("entity_name", F.col(entity)))
    )
