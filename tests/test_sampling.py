import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowatlas.functions.draws import uniform
from flowatlas.functions.prefix import running_sums
from flowatlas.operators import sampling


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_running_sums_are_exact_for_any_ranges(spark, ranges):
    r = random.Random(int(ranges))
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), k, r.choice([0.1, 0.1, r.random() * 1e6, 1e-12])) for k in range(700)] + [("one", 0, 0.3)]
    table = spark.createDataFrame(rows, "g string, k long, w double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        found = running_sums(table, ["g"], ["w", "k"], "w").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    exact = lambda w: Decimal(repr(w)).quantize(Decimal("1e-12"))
    wanted = {}
    for g in {x[0] for x in rows}:
        at, last = Decimal(0), None
        mine = sorted((x[2], x[1]) for x in rows if x[0] == g)
        total = sum(exact(w) for w, _ in mine)
        for w, k in mine:
            wanted[g, k] = (at, total, last)
            at, last = at + exact(w), exact(w)
    assert {(x["g"], x["k"]): (x["_before"], x["_total"], x["_previous"]) for x in found} == wanted


def test_no_task_sees_a_whole_group(spark):
    table = spark.range(500).select(F.lit("a").alias("g"), F.col("id").alias("k"), (F.col("id") % 9 + 1.0).alias("w"))
    for group in ([], ["g"]):
        plan = running_sums(table, group, ["w", "k"], "w")._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "NestedLoop" not in plan
        assert "hashpartitioning(g#" not in plan


def test_intervals_of_ties_nulls_and_tiny_weights(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("d", 0.0), ("e", -3.0), ("f", 1e-15)], "event string, w double")
    cdf = sampling.weights_cdf(rows, [], "event", "w").orderBy("cum_lo").collect()
    assert [tuple(r) for r in cdf] == [("a", 0.0, 0.5), ("b", 0.5, 1.0)]
    assert sampling.weights_cdf(rows.where("false"), [], "event", "w").collect() == []


def test_many_events_meet_few_candidates(spark):
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("event"), (F.col("id") % 97 + 0.25).alias("w"))
    cdf = sampling.weights_cdf(rows, [], "event", "w")
    drawn = sampling.weighted_choice(spark.range(5000), cdf, [], uniform(F.col("id"), 1))
    assert drawn.select("id").distinct().count() == drawn.count() == 5000
    slots = 2 ** int(np.ceil(np.log2(n)))
    pairs = cdf.selectExpr(f"sum(floor(cum_hi * {slots}) - floor(cum_lo * {slots}) + 1) / {slots} p").first()["p"]
    assert pairs < 2.1


def test_choice_by_group_keeps_rows_without_events(spark):
    events = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "z", 2.0)], "g string, event string, w double")
    rows = spark.range(2000).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("g"))
    cdf = sampling.weights_cdf(events, ["g"], "event", "w")
    kept = sampling.weighted_choice(rows, cdf, ["g"], uniform(F.col("id"), 1), keep=True)
    counts = {(r["g"], r["event"]): r["count"] for r in kept.groupBy("g", "event").count().collect()}
    assert counts["b", "z"] == 500 and counts["c", None] == 500 and counts[None, None] == 500
    assert counts["a", "x"] + counts["a", "y"] == 500 and 90 < counts["a", "x"] < 160
    assert sampling.weighted_choice(rows, cdf, ["g"], uniform(F.col("id"), 1)).count() == 1000


def test_draws_over_all_64_bits(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 6_800_000_000, 2**32, 2**32 + 1, 2**31, -(2**31)]
    found = spark.createDataFrame([(k,) for k in keys], "k long").select("k", uniform(F.col("k"), 5).alias("u"), uniform(F.col("k"), 24, 2**40).alias("v")).collect()
    assert all(0 <= r["u"] < 1 and 0 <= r["v"] < 1 for r in found)
    assert len({r["u"] for r in found}) == len(keys)


@pytest.mark.parametrize("step", [16, 2**40 + 7])
def test_draws_are_even_and_independent(spark, step):
    n = 40_000
    rows = np.array(spark.range(n).select(uniform(F.col("id") * step, 1).alias("u"), uniform(F.col("id") * step, 2).alias("v"), uniform(F.col("id") * step + step, 1).alias("w")).toPandas())
    for c in range(3):
        counts = np.histogram(rows[:, c], 50, (0, 1))[0]
        assert ((counts - n / 50) ** 2 / (n / 50)).sum() < 110  # chi square of 49 degrees: far beyond 99.9 %
    assert abs(np.corrcoef(rows.T) - np.eye(3)).max() < 0.03


def test_weights_of_one_share_are_ordered_by_event(spark):
    """Weights that differ by less than their shares can tell are in order of event, as in the SQL's ORDER BY p, event."""
    total = 441616942.3
    steps = [1.9 + k * 2.0**-52 for k in range(0, 64)]
    light, heavy = next((a, b) for a, b in zip(steps, steps[1:]) if a < b and a / total == b / total)
    rest = total - light - heavy
    rows = spark.createDataFrame([(9, light), (3, heavy), (5, rest)], "event long, w double")
    exact = sum(Decimal(repr(w)).quantize(Decimal("1e-12")) for w in (light, heavy, rest))
    assert light / float(exact) == heavy / float(exact)
    cdf = sampling.weights_cdf(rows, [], "event", "w").orderBy("cum_lo").collect()
    assert [r.event for r in cdf] == [3, 9, 5]
