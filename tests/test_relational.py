import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import aggregates as A
from millrace.operators import relational as R


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bag(df):
    return Counter(map(tuple, df.collect()))


values = st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=8)


@given(values, values)
@settings(max_examples=12, deadline=None)
def test_set_algebra(spark, a, b):
    x, y = frame(spark, [(v,) for v in a], "v int"), frame(spark, [(v,) for v in b], "v int")
    ca, cb = Counter((v,) for v in a), Counter((v,) for v in b)
    assert bag(R.union(x, y, all=True)) == ca + cb and set(bag(R.union(x, y))) == set(ca) | set(cb)
    assert bag(R.intersect(x, y, all=True)) == ca & cb and set(bag(R.intersect(x, y))) == set(ca) & set(cb)
    assert bag(R.except_(x, y, all=True)) == ca - cb and set(bag(R.except_(x, y))) == set(ca) - set(cb)


def test_joins_against_nested_loops(spark):
    rng = random.Random(2)
    a = [(i, rng.choice([None, 1, 2, 3])) for i in range(20)]
    b = [(rng.choice([None, 2, 3, 4]), i) for i in range(15)]
    x, y = frame(spark, a, "i int, k int"), frame(spark, b, "k2 int, j int")
    on = F.col("k") == F.col("k2")
    both = Counter((*r, *s) for r in a for s in b if r[1] is not None and r[1] == s[0])
    assert bag(R.join(x, y, on)) == both
    left = Counter((*r, None, None) for r in a if not any(r[1] is not None and r[1] == s[0] for s in b))
    right = Counter((None, None, *s) for s in b if not any(s[0] is not None and r[1] == s[0] for r in a))
    assert bag(R.join(x, y, on, "left")) == both + left and bag(R.join(x, y, on, "full")) == both + left + right
    assert bag(R.anti(x, y, on)) == Counter(r[:2] for r in left.elements())
    assert R.join(x, y, None, "cross").count() == 300
    salted = R.salted_join(x, y.withColumnRenamed("k2", "k"), ["k"], 3, "left")
    assert Counter((r.i, r.k, r.j) for r in salted.collect()) == Counter((r[0], r[1], r[3]) for r in (both + left).elements())


def test_asof_and_range_against_brute_force(spark):
    rng = random.Random(3)
    a = [(i, rng.choice("xyz"), rng.choice([None, *range(50)])) for i in range(60)]
    b = sorted({(k, t): (k, t, i) for i, (k, t) in enumerate((rng.choice("xy"), rng.randrange(50)) for _ in range(25))}.values())
    out = R.asof_join(frame(spark, a, "i int, k string, t int"), frame(spark, b, "k string, u int, v int"), ["k"], "t", "u", ["v"])
    for r in out.collect():
        prior = [(u, v) for k, u, v in b if r.t is not None and k == r.k and u <= r.t]
        assert r.v == (max(prior)[1] if prior else None)
    assert out.count() == 60
    spans = [(lo, lo + rng.randrange(0, 12), j) for j, lo in enumerate(rng.choices(range(50), k=20))]
    got = R.range_join(frame(spark, a, "i int, k string, t int"), frame(spark, spans, "lo int, hi int, j int"), "t", "lo", "hi", 5.0)
    assert Counter((r.i, r.j) for r in got.collect()) == Counter((i, j) for i, _, t in a for lo, hi, j in spans if t is not None and lo <= t < hi)


def test_pivot_and_unpivot(spark):
    rows = [("n", "jan", 10), ("n", "feb", 20), ("s", "jan", 5), ("n", "jan", 1), ("e", "mar", 7), (None, "jan", 2)]
    df = frame(spark, rows, "region string, month string, revenue int")
    out = {r.region: r for r in R.pivot(df, ["region"], "month", ["jan", "feb"], {"sum": F.sum("revenue"), "n": F.count(F.lit(1))}).collect()}
    assert (out["n"].jan_sum, out["n"].feb_sum, out["n"].jan_n) == (11, 20, 2) and out["s"].feb_sum is None
    assert out["e"].jan_sum is None and out[None].jan_sum == 2 and len(out) == 4
    wide = R.pivot(df, ["region"], ["region", "month"], {"a": ("n", "jan")}, {"sum": F.sum("revenue")})
    assert {r.region: r.a_sum for r in wide.collect()}["n"] == 11
    long = frame(spark, [(1, 4, None), (2, None, 6)], "id int, a int, b int")
    assert bag(R.unpivot(long, ["id"], ["a", "b"], "q", "v")) == Counter([(1, "a", 4), (2, "b", 6)])
    assert R.unpivot(long, ["id"], ["a", "b"], "q", "v", include_nulls=True, cast="string").count() == 4


def test_recursion(spark):
    edges = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4)], "a int, b int")
    step = lambda f: f.join(edges, f.n == edges.a).select("b")
    start = frame(spark, [(1,)], "n int")
    assert sorted(r.n for r in R.recursive(start, step).collect()) == [1, 2, 3, 4]
    with pytest.raises(RecursionError):
        R.recursive(start, step, all=True, bound=4)


def test_top_k_and_grouping_sets(spark):
    df = frame(spark, [(i % 3, None if i == 4 else i) for i in range(9)], "g int, v int")
    assert [r.v for r in R.top_k(df, [("v", False), "g"], 2).collect()] == [None, 8]
    assert sorted((r.g, r.v) for r in R.top_k_per(df, ["g"], ["v"], 1).collect()) == [(0, 0), (1, 1), (2, 2)]
    sets = R.grouping_sets(df, [["g"], []], [F.count(F.lit(1)).alias("n")])
    assert bag(sets) == Counter([(0, 3), (1, 3), (2, 3), (None, 9)])


def test_ordered_aggregates(spark):
    df = frame(spark, [(1, None), (2, "b"), (3, "a"), (4, None)], "k int, v string")
    r = df.agg(A.first("v", "k").alias("f"), A.last("v", "k").alias("l"), A.string_agg("v", "k", "+").alias("s"), A.count("v").alias("n"), A.filtered(F.count, "v", F.col("k") > 2).alias("c")).first()
    assert tuple(r) == ("b", "a", "b+a", 2, 1)
    assert df.filter("k > 9").agg(A.string_agg("v", "k").alias("s")).first().s is None


def test_plans_are_the_ones_meant(spark, sf):
    from millrace.plans.catalogue import QUERIES

    def plan(name):
        df = QUERIES[name](spark, sf)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    q6 = plan("q6_revenue")
    assert "PushedFilters: [" in q6 and "GreaterThanOrEqual(l_discount" in q6 and "l_partkey" not in q6
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in q6
    assert "TakeOrderedAndProject" in plan("topk") and "WindowGroupLimit" in plan("topk_per_group")
    assert "CartesianProduct" not in plan("join_range") and "BroadcastNestedLoopJoin" not in plan("join_range")


def test_pairs_within_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, *range(30)])) for _ in range(120)]
    expected = Counter((v, w) for a, b, v in rows for c, d, w in rows if a is not None and (a, b) == (c, d) and None not in (v, w) and v < w)
    df = frame(spark, rows, "a string, b int, v int")
    for block in (7, 1000):
        out = R.pairs_within(df, ["a", "b"], "v", "x", "y", block)
        assert bag(out) == expected and out.columns == ["x", "y"]
    # One group's pairs are the work of many tasks.
    spread = R.pairs_within(spark.range(1000).selectExpr("id DIV 1000 AS k", "id"), ["k"], "id", "x", "y", 100)
    tasks = spread.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in tasks) == 499_500 and len(tasks) > 4
