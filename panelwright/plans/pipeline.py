"""The whole run on the stand-in inputs: series, gold, statistics, dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.reference_data import ENTITY_CODES, PRODUCT_PREFIX
from panelwright.operators import features, panel, silver, stats
from panelwright.plans import standins as st
from panelwright.session import fingerprint, stage_path, stage_table

SCOPE_START, SCOPE_END = "1995-01-01", "2001-07-01"
N_MONTHS = silver.months_in_scope(SCOPE_START, SCOPE_END)
SPLIT = features.SplitRules(train_end="1999-09-01", test_start="2000-03-01", n_months=N_MONTHS)
FOLD_YEARS = (1997, 1998, 1999)
LOAD_ID = "load-1"

CONTRACT = silver.PanelContract(
    entity="entity",
    product="product",
    date="date_text",
    quantity="quantity_text",
    value="value_text",
    domain=ENTITY_CODES,
    product_prefix=PRODUCT_PREFIX,
    start=SCOPE_START,
    end=SCOPE_END,
    as_of=st.AS_OF,
)


def _stage_name(spark: SparkSession, sf: str, name: str) -> str:
    """Stages are kept by what they were made from: other files, or files that have changed, get other stages."""
    return f"{fingerprint(spark, sf)}/{name}"


def _stage(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    return stage_table(spark, _stage_name(spark, sf, name), build)


def bronze(spark: SparkSession, sf: str) -> DataFrame:
    """Text rows, as landed for the later stages."""
    return _stage(spark, sf, "bronze", lambda: st.dirty(spark, sf))


def silver_series(spark: SparkSession, sf: str) -> silver.SilverTables:
    return silver.build_silver_series(
        st.readings(spark, sf), st.SERIES, SCOPE_START, SCOPE_END, st.AS_OF, LOAD_ID, "series-source", st.RUN_AT
    )


def silver_panel(spark: SparkSession, sf: str) -> silver.SilverTables:
    folder = stage_path(spark, _stage_name(spark, sf, "silver_panel"))
    return silver.build_silver_panel(bronze(spark, sf), CONTRACT, LOAD_ID, "panel-source", st.RUN_AT, folder)


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Silver series, as stored for the later stages."""
    return _stage(spark, sf, "series", lambda: silver_series(spark, sf).table.drop("_load_id"))


def panel_table(spark: SparkSession, sf: str) -> DataFrame:
    """Silver panel, as stored for the later stages."""
    return _stage(spark, sf, "panel", lambda: st.panel_a(spark, sf))


def market_series(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly total of the panel in millions: a series the keys really move with."""
    return panel_table(spark, sf).groupBy("month").agg(
        (F.sum(F.col("value").cast("decimal(30,2)")).cast("double") / 1_000_000).alias("rate")
    )


def build_gold(spark: SparkSession, sf: str) -> DataFrame:
    return panel.build_gold(panel_table(spark, sf), series(spark, sf))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return _stage(spark, sf, "gold", lambda: build_gold(spark, sf))


def market_gold(spark: SparkSession, sf: str) -> DataFrame:
    return _stage(
        spark, sf, "market_gold", lambda: panel.build_gold(panel_table(spark, sf), market_series(spark, sf))
    )


def level_one(spark: SparkSession, sf: str) -> DataFrame:
    return _stage(spark, sf, "level_one", lambda: stats.level_one(market_gold(spark, sf)))


def build_level_two(spark: SparkSession, sf: str) -> DataFrame:
    return stats.level_two(market_gold(spark, sf), stats.best_lag(level_one(spark, sf)))


def level_two(spark: SparkSession, sf: str) -> DataFrame:
    return _stage(spark, sf, "level_two", lambda: build_level_two(spark, sf))


def build_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return features.build_dataset(gold(spark, sf), SPLIT)


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    return _stage(spark, sf, "dataset", lambda: build_dataset(spark, sf))
