import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sulatan.operators import ordered as O
from sulatan.operators import ranking
from sulatan.operators.ranking import spaced_top_k
from sulatan.session import co_partitioned


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    # one key holds far more than a third of the rows
    data = [(1 if rng.random() < .7 else rng.randint(2, 6), float(rng.randint(0, 300)), i, rng.randint(0, 9)) for i in range(900)]
    return spark.createDataFrame(data, "k int, x double, id int, v int")


ORDER = ["x", "id"]


def same(a, b, cols):
    key = lambda df: sorted(tuple(r) for r in df.select("id", *cols).collect())
    assert key(a) == key(b)


@pytest.mark.parametrize("width", [1, 7, 50, 1000])
def test_against_plain_windows(rows, width):
    w = W.partitionBy("k").orderBy(*ORDER)
    df = O.chunked(rows, "x", width)
    same(O.previous_row(df, ["k"], ORDER, ["v"]).withColumn("p", F.col("prev.v")), rows.withColumn("p", F.lag("v").over(w)), ["p"])
    got = O.running(df, ["k"], ORDER, sums={"s": "v"}, peaks={"m": "v"}, peaks_before={"b": "v"}, index="i")
    want = rows.withColumns({"s": F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)), "m": F.max("v").over(w.rowsBetween(W.unboundedPreceding, 0)),
                             "b": F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)), "i": (F.row_number().over(w) - 1).cast("long")})
    same(got, want, ["s", "m", "b", "i"])
    seg = O.segments(df, ["k"], ORDER, ["v"], lambda p, c: c.getField("v") > p.getField("v"), "g")
    flag = F.when(F.col("v") > F.lag("v").over(w), 1).otherwise(0)
    same(seg, rows.withColumn("f", flag).withColumn("g", F.sum("f").over(w.rowsBetween(W.unboundedPreceding, 0))), ["g"])
    halo = O.with_halo(df, ["k"], ORDER, ["v"], 4).withColumn("r", F.sum("v").over(W.partitionBy("k", O.CHUNK).orderBy(*ORDER).rowsBetween(-4, 0)))
    same(halo.filter("not _halo"), rows.withColumn("r", F.sum("v").over(w.rowsBetween(-4, 0))), ["r"])


@pytest.mark.parametrize("width", [7, 1000])
def test_dealt_rows_are_made_and_sorted_once(spark, rows, width):
    own = co_partitioned(spark)
    data = [tuple(r) for r in rows.collect()] + [(None, 3.0, 900, 1), (2, None, 901, 1)]
    there, here = (O.chunked(s.createDataFrame(data, rows.schema), "x", width) for s in (own, spark))

    def flag(p, c):
        return c.getField("v") > p.getField("v")

    for step in (lambda df: O.previous_row(df, ["k"], ORDER, ["v"]).withColumn("p", F.col("prev.v")).drop("prev"),
                 lambda df: O.running(df, ["k"], ORDER, sums={"s": "v"}, peaks={"m": "v"}, peaks_before={"b": "v"}, index="i"),
                 lambda df: O.segments(df, ["k"], ORDER, ["v"], flag, "g")):
        got, want = step(there), step(here)
        assert sorted(got.dtypes) == sorted(want.dtypes)
        same(got, want, [c for c in got.columns if c != "id"])
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join(spark, rows, how):
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "z")], "k int, n string")
    same(O.skew_join(rows, right, ["k"], ["id"], how), rows.join(right, "k", how), ["n"])
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    same(O.skew_join(rows, right, ["k"], ["id"], how, counts=counts), rows.join(right, "k", how), ["n"])


@pytest.mark.parametrize("k,gap,whole", [(5, 20, True), (1, 20, True), (40, 3, True), (40, 2.5, False)])
def test_spaced_top_k(spark, k, gap, whole):
    rng = random.Random(2)
    place = (lambda: rng.randint(-50, 200)) if whole else (lambda: round(rng.uniform(-50, 200), 1))
    data = [(key, float(place()), rng.randint(0, 5)) for key in range(3) for _ in range(250)] + [(7, float(x), x) for x in range(90)]
    want = set()
    for key in {r[0] for r in data}:
        best = {}
        for kk, x, s in data:
            if kk == key:
                best[x] = min(s, best.get(x, 99))
        kept = []
        for s, x in sorted((s, x) for x, s in best.items()):
            if len(kept) < k and all(abs(x - c) >= gap for c in kept):
                kept.append(x)
        want |= {(key, x) for x in kept}
    df = spark.createDataFrame(data + [(9, None, 1), (9, 4.0, None)], "k int, x double, s int").repartition(6)
    assert {tuple(r) for r in spaced_top_k(df, ["k"], "x", "s", gap, k).collect()} == want
    with pytest.raises(ValueError):
        spaced_top_k(df, ["k"], "x", "s", 0, k)


def test_spaced_top_k_in_place(spark, monkeypatch):
    def never(df, name):
        raise AssertionError(f"{name} stored")

    rng = random.Random(5)
    data = [(key, float(rng.randint(0, 300)), rng.randint(0, 6)) for key in range(4) for _ in range(200)] + [(9, None, 1), (9, 4.0, None)]
    want = sorted(tuple(r) for r in spaced_top_k(spark.createDataFrame(data, "k int, x double, s int"), ["k"], "x", "s", 11, 14).collect())
    monkeypatch.setattr(ranking, "stored", never)
    own = co_partitioned(spark).createDataFrame(data, "k int, x double, s int").repartition(3, "k")
    out = spaced_top_k(own, ["k"], "x", "s", 11, 14)
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) > 40
