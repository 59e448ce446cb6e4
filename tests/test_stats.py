"""F. Correlation, p-values, multiple tests; the distributed running sums under skew."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright.functions.student_t import two_sided_p
from panelwright.operators import stats
from panelwright.operators.ordered import bag_difference, replicate, running_sums


def test_p_values_against_known_numbers():
    import numpy as np

    cases = [(0.5, 10, 0.1411), (0.3, 30, 0.1072), (-0.9, 12, 6.6e-5), (0.0, 20, 1.0), (1.0, 5, 0.0)]
    got = two_sided_p(np.array([c[0] for c in cases]), np.array([c[1] for c in cases]))
    for value, (_, _, want) in zip(got, cases):
        assert value == pytest.approx(want, rel=2e-2, abs=1e-12)
    # df = 1 and df = 2 have closed forms
    assert two_sided_p(np.array([0.5]), np.array([3]))[0] == pytest.approx(1 - 2 / math.pi * math.asin(0.5), rel=1e-12)
    assert two_sided_p(np.array([0.5]), np.array([4]))[0] == pytest.approx(0.5, rel=1e-12)
    assert two_sided_p(np.array([0.999999]), np.array([100]))[0] < 1e-200


def brute_rank(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def brute_pearson(x, y):
    n, mx, my = len(x), sum(x) / len(x), sum(y) / len(y)
    cov = sum((a - mx) * (b - my) for a, b in zip(x, y))
    return cov / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def test_correlations_with_ties_constants_and_gaps(spark):
    rng = random.Random(3)
    x = [float(rng.randint(0, 5)) for _ in range(40)]
    y = [float(rng.randint(0, 5)) for _ in range(40)]
    rows = [("a", i, j) for i, j in zip(x, y)] + [("a", None, 1.0), ("a", 1.0, None)]
    rows += [("constant", 1.1, float(i)) for i in range(5)] + [("short", 1.0, 2.0), ("short", 2.0, 1.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = {r["g"]: r for r in stats.correlations(df, ["g"]).collect()}
    assert out["a"]["n_months"] == 40
    assert out["a"]["pearson"] == pytest.approx(brute_pearson(x, y))
    assert out["a"]["spearman"] == pytest.approx(brute_pearson(brute_rank(x), brute_rank(y)))
    for g, n in (("constant", 5), ("short", 2), ("none", 0)):
        assert (out[g]["n_months"], out[g]["spearman"], out[g]["pearson"]) == (n, None, None)


def brute_bh(ps):
    known = sorted(p for p in ps if p is not None)
    m = len(known)
    return [None if p is None else min(1.0, min(q * m / (i + 1) for i, q in enumerate(known) if q >= p)) for p in ps]


def test_benjamini_hochberg_with_hot_ties(spark):
    rng = random.Random(5)
    ps = [rng.random() ** 3 for _ in range(400)] + [1.0] * 250 + [0.01] * 100 + [None] * 50
    df = spark.createDataFrame(list(enumerate(ps)), "k int, p_value double")
    out = {r["k"]: r for r in stats.adjust_p_values(df, ["k"]).collect()}
    assert len(out) == len(ps)
    for k, want in enumerate(brute_bh(ps)):
        assert out[k]["p_adjusted"] == (None if want is None else pytest.approx(want, rel=1e-12))
        assert out[k]["significant"] == (want is not None and want < 0.05)


def test_running_sums_against_brute_force(spark):
    rng = random.Random(7)
    rows = [("hot", rng.choice([0.5, 0.5, rng.random()]), rng.randint(0, 3)) for _ in range(3000)]
    rows += [("cold", rng.random(), 1) for _ in range(20)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    out = running_sums(df, ["g"], "v", {"s": F.col("w")}, parts=16).collect()
    for r in out:
        assert r["s_below"] == sum(w for g, v, w in rows if g == r["g"] and v < r["v"])
        assert r["s_total"] == sum(w for g, _, w in rows if g == r["g"])
    assert len(out) == len({(g, v) for g, v, _ in rows})


def test_bag_difference_counts_copies(spark):
    new = spark.createDataFrame([("a", 1)] * 25 + [("b", None)] * 3 + [("c", 2)], "k string, v int")
    stored = spark.createDataFrame([("a", 1)] * 4 + [("b", None)] * 3 + [("z", 9)], "k string, v int")
    out = [tuple(r) for r in bag_difference(new, stored, ["k", "v"], chunk=4).collect()]
    assert sorted(out) == [("a", 1)] * 21 + [("c", 2)]
    assert replicate(spark.createDataFrame([("x", 10)], "k string, n bigint"), "n", chunk=3).count() == 10


def planted_gold(spark):
    """60 months, two products; growth follows minus the rate change two months before; one short key."""
    rng = random.Random(11)
    months = [dt.date(2018 + i // 12, i % 12 + 1, 1) for i in range(60)]
    change = [rng.uniform(-1, 1) for _ in months]
    rows = []
    for product, noise in (("A", 0.0), ("B", 0.01)):
        value = 1000.0
        for i, m in enumerate(months):
            pct = None
            if i >= 1:
                pct = (-5 * change[i - 2] if i >= 2 else 0.1) + noise * rng.uniform(-1, 1)
                value *= 1 + pct / 100
            rows.append((m, "SP", product, value, i >= 1, pct, change[i]))
    for i in range(6):
        rows.append((months[i], "RJ", "A", 1e-6, i >= 1, 1.0 + i if i else None, change[i]))
    return spark.createDataFrame(
        rows,
        "month date, entity string, product string, value double, has_prev boolean, value_change_pct double, rate_change double",
    )


def test_planted_lag_is_found(spark):
    gold = planted_gold(spark)
    level1 = stats.level_one(gold)
    assert level1.count() == 14
    best = {r["product"]: r["best_lag"] for r in stats.best_lag(level1).collect()}
    assert best == {"A": 2, "B": 2}
    peak = level1.filter("product = 'A' AND lag = 2").first()
    assert peak["spearman"] < -0.95 and peak["significant"]
    level2 = {(r["entity"], r["product"]): r for r in stats.level_two(gold, stats.best_lag(level1)).collect()}
    assert level2["SP", "A"]["spearman"] < -0.95
    short = level2["RJ", "A"]
    assert short["insufficient"] and short["spearman"] is None and short["n_months"] == 4 and not short["significant"]
    assert stats.strongest(level1, 1, ["product", "lag"]).first()["lag"] == 2


def test_tied_strength_takes_the_smallest_lag(spark):
    df = spark.createDataFrame([("A", 3, -0.5), ("A", 1, 0.5), ("A", 2, None)], "product string, lag int, spearman double")
    assert stats.best_lag(df).first()["best_lag"] == 1


def test_declaring_starts_no_job(spark):
    from panelwright.operators import evaluate

    context = spark.sparkContext
    rows = spark.createDataFrame([(f"g{i % 2}", i % 3 % 2, i / 40, 1.0) for i in range(40)], "g string, label int, score double, w double")
    tests = rows.select("g", (F.col("score") / 10).alias("p_value"))
    context.setJobGroup("declared", "nothing should run")
    try:
        plans = [stats.adjust_p_values(tests, ["g"]), evaluate.auc_both(rows, "label", "score", "w", ["g"])]
        assert list(context.statusTracker().getJobIdsForGroup("declared")) == []
        assert [p.count() for p in plans] == [40, 2]
        assert list(context.statusTracker().getJobIdsForGroup("declared"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
