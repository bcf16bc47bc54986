"""Quantiles, global ranks and top rows per group against simple computations."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nightledger.operators import quantiles, ranking

FEW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


@FEW
@given(
    st.lists(
        st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 2)), min_size=1, max_size=60
    )
)
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.9}
    row = quantiles.exact_quantiles(df, "v", probs).first()
    for name, p in probs.items():
        assert row[name] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


def test_quantiles_by_group_with_a_hot_value(spark):
    rnd = random.Random(7)
    rows = [("hot", 10.0)] * 3000 + [("hot", round(rnd.uniform(1, 500), 2)) for _ in range(2000)]
    rows += [(f"g{i % 40}", round(rnd.uniform(-5, 5), 3)) for i in range(400)]
    rows += [(None, 1.0), ("empty", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    got = {
        r.g: (r.a, r.b)
        for r in quantiles.exact_quantiles(df, "v", {"a": 0.25, "b": 0.5}, by=["g"]).collect()
    }
    groups = {}
    for g, v in rows:
        if g is not None and v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx((np.quantile(vs, 0.25), np.quantile(vs, 0.5)))


def test_fill_examples(spark):
    def median(values):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        return quantiles.column_quantiles(df, {"m": ("v", 0.5)}).collect()

    assert median([1.0, None, 2.0, 4.0])[0].m == 2.0
    assert median([1.0, 2.0, 3.0, 4.0, None])[0].m == 2.5
    assert [r.m for r in median([None, None])] == [None]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("partitions", [1, 7])
def test_global_positions(spark, descending, partitions):
    rnd = random.Random(3)
    values = [0.0] * 500 + [float(rnd.randint(1, 60)) for _ in range(700)] + [None] * 80
    rnd.shuffle(values)
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        placed = ranking.global_positions(df, "v", "id", descending).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(
        enumerate(values),
        key=lambda r: (
            (r[1] is None, -(r[1] or 0), r[0])
            if descending
            else (r[1] is not None, r[1] or 0, r[0])
        ),
    )
    distinct = list(dict.fromkeys(v for _, v in order))
    expected = {i: (n + 1, distinct.index(v) + 1) for n, (i, v) in enumerate(order)}
    assert {r.id: (r.row_number, r.dense_rank) for r in placed} == expected
    assert {r.row_total for r in placed} == {len(values)}
    numbered = ranking.global_row_numbers(df, "v", "id", descending).collect()
    assert {r.id: r.row_number for r in numbered} == {i: n for i, (n, _) in expected.items()}


def test_many_partitions_keep_ranks(spark):
    """More range partitions than distinct values: a run of equal values crosses borders."""
    values = [5.0] * 300 + [1.0] * 3
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed = ranking.global_positions(df, "v", "id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.v, r.dense_rank) for r in placed} == {(1.0, 1), (5.0, 2)}
    assert sorted(r.row_number for r in placed) == list(range(1, 304))


@pytest.mark.parametrize("n, sizes", [(10, [3, 3, 2, 2]), (3, [1, 1, 1]), (8, [2, 2, 2, 2])])
def test_ntile_sizes(spark, n, sizes):
    df = spark.range(n).select((F.col("id") * 1.0).alias("v"), "id")
    placed = ranking.global_row_numbers(df, "v", "id")
    tile = ranking.ntile_of(F.col("row_number"), F.col("row_total"), 4)
    counts = placed.groupBy(tile.alias("t")).count().orderBy("t").collect()
    assert [r["count"] for r in counts] == sizes


def test_percent_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 9.0)], "k string, v double")
    got = {r.k: r.p for r in ranking.percent_rank_of(df, "v", "k", "p").collect()}
    assert got == pytest.approx({"a": 0.0, "b": 1 / 3, "c": 1 / 3, "d": 1.0})


def test_rank_keeps_ties(spark):
    df = spark.createDataFrame([(1, 50), (2, 50), (3, 40), (4, 10)], "id int, gap int")
    order = [F.col("gap").desc()]
    top = ranking.top_per_group(df.withColumn("g", F.lit(1)), ["g"], order, 3, "rank", "r")
    assert sorted((r.id, r.r) for r in top.collect()) == [(1, 1), (2, 1), (3, 3)]


def test_hot_group_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    top = ranking.top_per_group(df, ["g"], [F.desc("id")], 3, "row_number", "r")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "g string, v double, id int")
    assert quantiles.exact_quantiles(empty, "v", {"m": 0.5}).collect() == []
    assert quantiles.exact_quantiles(empty, "v", {"m": 0.5}, by=["g"]).collect() == []
    assert ranking.global_positions(empty, "v", "id").collect() == []


def test_dense_rank_by_values(spark):
    """Equal values in many partitions, NULLs, and both directions."""
    import random

    from nightledger.operators.ranking import global_dense_rank

    rnd = random.Random(3)
    values = [rnd.choice([0.0, 0.0, 0.0, None, float(rnd.randrange(40)), -2.5]) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double").repartition(16)
    for descending in (False, True):
        known = sorted({v for v in values if v is not None}, reverse=descending)
        order = [*known, None] if descending else [None, *known]
        want = {k: order.index(v) + 1 for k, v in enumerate(values)}
        for threshold in ("-1", "10485760"):  # by shuffle, and by broadcast
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = global_dense_rank(df, "v", "place", descending).collect()
            assert {r.k: r.place for r in got} == want and len(got) == len(values)
