import datetime as dt
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from sulatan.operators import kernel as K
from sulatan.operators import motion as M
from sulatan.plans import registry
from sulatan.streaming import motion as SM
from sulatan.streaming import session_log as SL

SCHEMA = "device_id long, ts timestamp, event_id long, x double, y double, z double"
START = dt.datetime(2024, 1, 1, 12)


def readings():
    rng = random.Random(1)
    rows, event = [], 0
    for device in (1, 2):
        for i in range(160):
            shaky = (i // 40) % 2
            rows.append((device, START + dt.timedelta(milliseconds=50 * i), event, rng.uniform(0, 2.0 if shaky else .02), 0.0, 0.0))
            event += 1
    return rows


def by_hand(rows):
    percents, fired = {}, set()
    for device in (1, 2):
        mine = [r for r in rows if r[0] == device]
        since, done = None, False
        for i in range(19, len(mine)):
            p = min(100.0, max(0.0, 100 * (1 - np.std([r[3] for r in mine[i - 19:i + 1]]) / 1.2)))
            percents[mine[i][2]] = p
            if p >= 95:
                since = since or mine[i][1]
                if not done and (mine[i][1] - since).total_seconds() >= .7:
                    done = True
                    fired.add(mine[i][2])
            else:
                since, done = None, False
    return percents, fired


def test_batch(spark):
    rows = readings()
    want, fired = by_hand(rows)
    steady = M.steadiness(spark.createDataFrame(rows, SCHEMA), slice_seconds=0.3)
    got = {r["event_id"]: r["percent"] for r in steady.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    assert len(fired) >= 4
    assert {r["event_id"] for r in M.held_steady(steady, slice_seconds=0.3).collect()} == fired


def test_stream_over_several_batches(spark, tmp_path):
    rows = readings()
    rows_by_time = sorted(rows, key=lambda r: r[1])
    for i in range(0, len(rows_by_time), 64):
        spark.createDataFrame(rows_by_time[i:i + 64], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i:04d}"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = (SM.steadiness_stream(src).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    want, fired = by_hand(rows)
    got = spark.read.schema(SM.OUTPUT).parquet(out).collect()
    assert {r["event_id"] for r in got} == set(want)
    assert np.allclose([r["percent"] for r in got], [want[r["event_id"]] for r in got])
    assert {r["event_id"] for r in got if r["fired"]} == fired


@pytest.mark.parametrize("backwards", [False, True])
def test_logged_stream_in_any_order(spark, tmp_path, backwards):
    rows = sorted(readings(), key=lambda r: r[1], reverse=backwards)
    for i in range(0, len(rows), 64):
        spark.createDataFrame(rows[i:i + 64], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i:04d}"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    SM.start_motion_log(src, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    want, fired = by_hand(rows := sorted(rows, key=lambda r: r[1]))
    got = SM.current_steadiness(spark, str(tmp_path / "out")).collect()
    assert {r["event_id"] for r in got} == set(want) and len(got) == len(want)
    assert np.allclose([r["percent"] for r in got], [want[r["event_id"]] for r in got])
    assert {r["event_id"] for r in got if r["fired"]} == fired


@pytest.mark.parametrize("layout", ["file", "folder"])
def test_stream_queries_read_files_and_folders(spark, tmp_path, layout):
    """Newest events first, one file or many: no event is missing."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy(F.desc("ts"))
    parts = tmp_path / "parts"
    (events.coalesce(1) if layout == "file" else events.repartitionByRange(7, F.desc("ts"))).write.parquet(str(parts))
    if layout == "file":
        shutil.copy(next(parts.glob("part-*.parquet")), tmp_path / "events.parquet")
    else:
        shutil.copytree(parts, tmp_path / "events.parquet")
    queries = registry.queries()
    assert queries["session_log_stream"](spark, str(tmp_path)).agg(F.sum("n_events")).first()[0] == events.count()
    whole = queries["steadiness"](spark, str(tmp_path)).count()
    assert queries["steadiness_stream"](spark, str(tmp_path)).count() == whole > 0


def test_session_log(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    for i, (s, t, status) in enumerate([(1, 0, "Processing"), (2, 1, "Processing"), (1, 2, "Success"), (2, 30, "Error")]):
        spark.createDataFrame([(s, base + dt.timedelta(hours=t), i, status)], "session_id long, ts timestamp, event_id long, status string") \
            .coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    src = spark.readStream.schema("session_id long, ts timestamp, event_id long, status string").option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    SL.start_session_log(src, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["session_id"]: (r["status"], r["n_events"]) for r in SL.current_sessions(spark, str(tmp_path / "out")).collect()}
    assert got == {1: ("Success", 2), 2: ("Error", 2)}


def test_parts_stay_few():
    for fanin in (2, 3, 8):
        for n in range(300):
            parts = SL._live(n, fanin)
            assert [at for at, _ in parts] == [sum(s for _, s in parts[:i]) for i in range(len(parts))] and sum(s for _, s in parts) == n
            assert max([0, *(sum(s == size for _, s in parts) for _, size in parts)]) < fanin


def test_session_log_is_merged(spark, tmp_path):
    """Many batches, some written twice as after a lost driver: few folders, nothing lost or counted twice."""
    path, base, rng = str(tmp_path / "log"), dt.datetime(2024, 1, 1), np.random.default_rng(1)
    assert SL.current_sessions(spark, path).collect() == []
    rows = []
    for b in range(31):
        own = [(int(rng.integers(5)), base + dt.timedelta(minutes=int(rng.integers(10_000))), b * 10 + i, ["Processing", "Success", "Error"][int(rng.integers(3))]) for i in range(4)]
        rows += own
        batch = spark.createDataFrame(own, "session_id long, ts timestamp, event_id long, status string").coalesce(1)
        for _ in range(2 if b in (0, 2, 8, 9, 26, 30) else 1):
            SL.write_batch(batch, b, path, fanin=3)
        folders = len(list((tmp_path / "log").glob("size=*/first=*")))
        assert folders <= len(SL._live(b + 1, 3)) + len(SL._live(b, 3)) + len(SL._sizes(b + 1, 3))
    got = {r["session_id"]: (r["status"], r["n_events"], r["start_time"], r["end_time"]) for r in SL.current_sessions(spark, path, fanin=3).collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == k)
        assert got[k] == (mine[-1][2], len(mine), mine[0][0], max([t for t, _, s in mine if s != "Processing"], default=None))


def test_large_models_score_like_small_ones(spark):
    rng = np.random.default_rng(0)
    sv = spark.createDataFrame([(i, i % 3, rng.normal(size=4).tolist()) for i in range(30)], "sv_id long, class int, vec array<double>")
    vecs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "vec_id long, vec array<double>")
    pair = spark.createDataFrame([(0, 0, 1, .1, -1., 0.), (1, 0, 2, 0., -1., 0.), (2, 1, 2, -.1, -1., 0.)],
                                 "pair_id int, i int, j int, intercept double, prob_a double, prob_b double")
    coef = sv.join(pair, (F.col("class") == F.col("i")) | (F.col("class") == F.col("j"))).select(
        "sv_id", "pair_id", F.when(F.col("class") == F.col("i"), .5).otherwise(-.7).alias("coef"))
    near = [{(r["vec_id"], r["rank"]): (r["sv_id"], round(r["k"], 9)) for r in K.nearest_vectors(vecs, sv, .3, max_bytes=b, block=4).collect()} for b in (10**6, 0)]
    assert near[0] == near[1] and len(near[0]) == 200
    dec = [{(r["vec_id"], r["pair_id"]): round(r["decision"], 9) for r in K.pair_decisions(vecs, sv, coef, pair, .3, max_bytes=b, block=4).collect()} for b in (10**6, 0)]
    assert dec[0] == dec[1] and len(dec[0]) == 120
