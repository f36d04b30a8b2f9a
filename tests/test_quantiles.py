"""Exact quantiles by selection against sorted values."""

import random

import numpy as np
import pytest

from temblor.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.5, 0.9, 0.975, 1.0]


def want(values):
    return np.quantile(np.array(values, dtype=float), PROBS).tolist() if values else None


@pytest.mark.parametrize("most", [65_536, 50, 1])
def test_all_values_different(spark, most):
    random.seed(21)
    wide = [random.choice([-1, 1]) * 10 ** random.uniform(-300, 300) for _ in range(1500)]
    near = [1e6 + k * 1e-6 for k in random.sample(range(1500), 1500)]
    rows = [(a, b, None if k % 3 else float(k)) for k, (a, b) in enumerate(zip(wide, near))]
    df = spark.createDataFrame(rows, "wide double, near double, `some.gaps` double")
    got = exact_quantiles(df.withColumnRenamed("some.gaps", "gaps"), ["wide", "near", "gaps"], PROBS, most=most).first()
    assert got["wide"] == pytest.approx(want(wide))
    assert got["near"] == pytest.approx(want(near), rel=1e-15)
    assert got["gaps"] == pytest.approx(want([r[2] for r in rows if r[2] is not None]))


@pytest.mark.parametrize("most", [65_536, 3])
def test_groups_with_a_hot_and_a_nameless_one(spark, most):
    random.seed(22)
    rows = [(None if k % 5 == 0 else "hot" if k % 2 else f"g{k % 7}", random.choice([random.random(), -0.0, 0.0, -2.5]))
            for k in range(900)]
    rows += [("empty", None)]
    found = exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["x"], PROBS, ["g"], most=most).collect()
    assert {r["g"] for r in found} == {g for g, _ in rows} - {"empty"}
    for r in found:
        assert r["x"] == pytest.approx(want([x for g, x in rows if g == r["g"] and x is not None]))


def test_no_values(spark):
    empty = spark.createDataFrame([], "x double, y bigint")
    assert [tuple(r) for r in exact_quantiles(empty, ["x", "y"], [0.5]).collect()] == [(None, None)]
    one = spark.createDataFrame([(None, 7)], "x double, y bigint")
    assert [tuple(r) for r in exact_quantiles(one, ["x", "y"], [0.5]).collect()] == [(None, [7.0])]


def test_values_meet_in_bins_only(spark):
    df = spark.range(5000).selectExpr("sqrt(id) as x")
    got = exact_quantiles(df, ["x"], [0.25, 0.75], most=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    single = [line for line in plan.split("\n") if "SinglePartition" in line]
    assert len(single) == 1  # the one row of the answer
    assert got.first()["x"] == pytest.approx(np.quantile(np.sqrt(np.arange(5000)), [0.25, 0.75]).tolist())
