"""Hand-computed fixtures: one series of six points, seconds as unit."""

import datetime as dt
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidelake.functions import filters, hashes
from tidelake.functions.clock import parse_time
from tidelake.operators import detect, forecast, series, windows
from tidelake.plans.catalog import Catalog
from tidelake.plans.pipeline import Find, aggregate
from tidelake.sources import store
from tidelake.spec import SeriesSpec, duration

SPEC = SeriesSpec("t", (), ("v",), ("id",))
BASE = [(0, 10), (30, 12), (60, 11), (90, 50), (150, 12), (200, 13)]
ZERO = dt.datetime(1970, 1, 1)


def frame(spark, points, shift=0):
    return spark.createDataFrame([(ZERO + dt.timedelta(seconds=t + shift), float(v), i) for i, (t, v) in enumerate(points)], "t timestamp_ntz, v double, id long")


def pairs(df, value):
    return sorted((int((r.t - ZERO).total_seconds()), None if r[value] is None else round(r[value], 4)) for r in df.collect())


def test_tumbling_windows_in_both_alignments(spark):
    df = frame(spark, BASE, 40)
    assert pairs(windows.tumbling_epoch(df, SPEC, "60s", {"v": "avg"}), "v_avg") == [(0, 10), (60, 11.5), (120, 50), (180, 12), (240, 13)]
    assert pairs(windows.tumbling_first(df, SPEC, "60s", {"v": "avg"}), "v_avg") == [(40, 11), (100, 30.5), (160, 12), (220, 13)]


def test_moving_windows(spark):
    out = windows.moving(frame(spark, BASE), SPEC, "v", "60s", "30s")
    assert pairs(out, "v_avg") == [(30, 11), (60, 11.5), (90, 30.5), (120, 50), (150, 12), (180, 12.5), (210, 13)]
    same_step = windows.moving(frame(spark, BASE), SPEC, "v", "60s")
    assert [v for _, v in pairs(same_step, "v_avg")] == [v for _, v in pairs(windows.tumbling_first(frame(spark, BASE), SPEC, "60s", {"v": "avg"}), "v_avg")]


@pytest.mark.parametrize(("method", "gap", "expected"), [("linear", 0, [(110, 37.3333), (130, 24.6667), (170, 12.5)]), ("linear", "50s", [(170, 12.5)]), ("previous", "50s", [(170, 12)]), ("next", "50s", [(170, 13)]), ("zero", "50s", [(170, 0)])])
def test_interpolation(spark, method, gap, expected):
    out = series.interpolate(frame(spark, BASE), SPEC, "v", "20s", gap, method)
    assert pairs(out.where("inserted"), "v") == expected
    assert out.where("not inserted").count() == 6


@pytest.mark.parametrize("alpha", [0.2, 0.0, 2.0])
@pytest.mark.parametrize("ranges", [1, 3, None])
def test_ema_is_the_same_in_any_ranges(spark, alpha, ranges):
    out = series.ema(frame(spark, BASE), SPEC, "v", alpha, ranges=ranges)
    assert [v for _, v in pairs(out, "v_ema")] == [10, 10.4, 10.52, 18.416, 17.1328, 16.3062]


def test_ema_of_one_is_identity(spark):
    assert [v for _, v in pairs(series.ema(frame(spark, BASE), SPEC, "v", 1.0), "v_ema")] == [10, 12, 11, 50, 12, 13]


@pytest.mark.parametrize(("p", "value"), [(0, 10), (50, 12), (90, 50), (95, 50), (100, 50)])
def test_nearest_rank(spark, p, value):
    assert series.percentile_windows(frame(spark, BASE), SPEC, "v", p).first()[0] == value


@pytest.mark.parametrize(("method", "threshold", "values", "flagged"), [("zscore", 3, [10, 12, 11, 13, 12, 40, 11], [40]), ("iqr", 1.5, [10, 12, 11, 13, 12, 40, 11], [40]), ("mad", 3, [10, 12, 11, 13, 12, 40, 11], [40]), ("zscore", 3, [5, 5, 5, 5, 5, 6], []), ("mad", 3, [5, 5, 5, 5, 5, 6], []), ("iqr", 1.5, [5, 5, 5, 5, 5, 6], [6])])
def test_anomalies(spark, method, threshold, values, flagged):
    out = detect.anomalies(frame(spark, list(enumerate(values))), SPEC, "v", method, 5, threshold)
    assert [r.v for r in out.collect()] == flagged


def test_forecasts(spark):
    df = frame(spark, [(0, 1), (60, 3), (120, 2), (180, 4)])
    assert pairs(forecast.forecast(df, SPEC, "v", "linear", 3), "v") == [(240, 4.5), (300, 5.3), (360, 6.1)]
    assert {v for _, v in pairs(forecast.forecast(df, SPEC, "v", "average", 3), "v")} == {2.5}
    assert {v for _, v in pairs(forecast.forecast(df, SPEC, "v", "ses", 3), "v")} == {2.016}
    one = frame(spark, [(0, 7)])
    for method in ("linear", "average", "ses"):
        assert pairs(forecast.forecast(one, SPEC, "v", method), "v") == [(3600 * i, 7) for i in range(1, 11)]


def test_empty_and_non_numeric_aggregates(spark):
    body = {"_id": None, "a": {"$avg": "$v"}, "s": {"$sum": "$v"}, "n": {"$count": "$v"}, "m": {"$min": "$v"}}
    assert tuple(aggregate(frame(spark, []), SPEC, [{"$group": body}]).first()) == (0.0, 0.0, 0, None)
    text = spark.createDataFrame([("a",), ("b",)], "v string")
    assert tuple(aggregate(text, SPEC, [{"$group": body}]).first()) == (0.0, 0.0, 2, None)


def test_missing_tag_is_a_group_of_its_own(spark):
    df = spark.createDataFrame([("1",), (None,), ("",)], "a string")
    assert aggregate(df, SPEC, [{"$group": {"_id": {"a": "$tags.a"}, "n": {"$count": {}}}}]).count() == 3


def test_find_sorts_and_cuts(spark):
    out = Find(where={"v": {"$gte": 11}}, sort={"v": -1}, skip=1, limit=2).on(frame(spark, BASE), SPEC)
    assert [r.v for r in out.collect()] == [13, 12]
    assert Find(skip=100).on(frame(spark, BASE), SPEC).count() == 0


def test_a_cursor_gives_batches(spark):
    df = frame(spark, [(i, i) for i in range(25)])
    got = list(Find(where={"v": {"$gte": 3}}, sort={"v": 1}).batches(df, SPEC, 10))
    assert [len(x) for x in got] == [10, 10, 2] and [r.v for x in got for r in x] == list(range(3, 25))
    assert list(Find(where={"v": {"$gt": 99}}).batches(df, SPEC)) == []


def test_ordered_scans_and_merged_runs_come_in_order(spark):
    df = frame(spark, [(i * 37 % 101 // 3, i) for i in range(100)]).repartition(5)
    assert [(r.t, r.id) for r in store.ordered(df, SPEC).collect()] == sorted((r.t, r.id) for r in df.collect())
    runs = [df.where("id % 2 = 0"), df.where("id % 2 = 1")]
    assert [(r.t, r.id) for r in series.merge_runs(runs, SPEC).collect()] == sorted((r.t, r.id) for r in df.collect())


def test_dedup_keeps_the_first_by_order(spark):
    out = series.dedup_by_time(frame(spark, [(0, 1), (0, 2), (5, 3)]), SPEC)
    assert pairs(out, "v") == [(0, 1), (5, 3)]


def test_durations():
    assert [duration(x) for x in ("1s", "5m", "2h", "1d", "1w", "1h30m", "500ms")] == [1_000_000, 300_000_000, 7_200_000_000, 86_400_000_000, 604_800_000_000, 5_400_000_000, 500_000]
    for wrong in ("10", "x", ""):
        with pytest.raises(ValueError, match="duration"):
            duration(wrong)


def test_timestamps_in_text(spark):
    second = dt.datetime(2024, 1, 2, 3, 4, 5)
    part = second + dt.timedelta(microseconds=120_000)
    texts = {
        "1700000000000000000": dt.datetime(2023, 11, 14, 22, 13, 20),
        "1700000000123456789": dt.datetime(2023, 11, 14, 22, 13, 20, 123456),
        "-1": ZERO - dt.timedelta(microseconds=1),
        "2024-01-02T03:04:05Z": second,
        "2024-01-02T05:04:05.12+02:00": part,
        "2024-01-02T03:04:05.123456789Z": second + dt.timedelta(microseconds=123456),
        "2024-01-02 03:04:05": second,
        "2024-01-02T03:04:05": second,
        "2024-01-02T03:04:05.12": part,
        "2024/01/02 03:04:05": second,
        "01/02/2024 03:04:05": second,
        "13/02/2024 03:04:05.12": dt.datetime(2024, 2, 13, 3, 4, 5, 120_000),
        "2024-01-02": None,
        "no time": None,
        "": None,
    }
    df = spark.createDataFrame([(x,) for x in texts], "s string").select(parse_time(F.col("s")).alias("t"))
    assert [r.t for r in df.collect()] == list(texts.values())
    micros = spark.range(0, 200_000).selectExpr("1700000000000000 + id * 1237 as m")
    assert micros.where(F.unix_micros(parse_time(F.concat(F.col("m").cast("string"), F.lit("000"))).cast("timestamp")) != F.col("m")).isEmpty()


def test_rare_times_are_read_as_the_layouts_read_them(spark):
    day = lambda *at: dt.datetime(*at)
    texts = {
        "2024-01-02t03:04:05": day(2024, 1, 2, 3, 4, 5),
        "2024/01/02 03:04:05.1234567890123456789012345": day(2024, 1, 2, 3, 4, 5, 123456),
        "12/13/2024 03:04:05": day(2024, 12, 13, 3, 4, 5),
        "13/12/2024 03:04:05": day(2024, 12, 13, 3, 4, 5),
        "29/02/2023 03:04:05": None,
        "00/12/2024 03:04:05": None,
        "13/13/2024 03:04:05": None,
        "2024-02-30 03:04:05": None,
        "2024-01-02 24:00:00": None,
        "2024-01-02 03:04:05Z": None,
        "2024-01-02T03:04:05Z\n": day(2024, 1, 2, 3, 4, 5),
        "2024-01-02 03:04:05\n": None,
        "+2024-01-02 03:04:05": None,
        " 2024-01-02 03:04:05": None,
        "12024-01-02 03:04:05": None,
        "03:04:05": None,
        "\t-1001 ": dt.datetime(1969, 12, 31, 23, 59, 59, 999998),
        "1.5": None,
        "99999999999999999999": None,
    }
    df = spark.createDataFrame([(x,) for x in [*texts, None]], "s string").select(parse_time(F.col("s")).alias("t"))
    assert [r.t for r in df.collect()] == [*texts.values(), None]
    rare = spark.createDataFrame([("+12024-01-02 03:04:05.5",), ("01/02/+12024 03:04:05.5",)], "s string").select(parse_time(F.col("s")).cast("string").alias("t"))
    assert [r.t for r in rare.collect()] == ["+12024-01-02 03:04:05.5"] * 2


def test_parsed_text_is_made_once_a_row_and_failing_casts_are_not_tried(spark):
    df = spark.range(1).select(F.timestamp_micros("id").alias("ts"))
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    plan = df.select(parse_time(text).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format(") == 1
    before = [plan.split(x)[0] for x in (" as bigint)", "gettimestamp(", "try_cast(")]
    assert all(x != plan and "RLIKE(" in x for x in before)


def test_store_round_trip_and_clear(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.insert(frame(spark, BASE), path, SPEC)
    assert pairs(store.scan(store.read(spark, path), SPEC, "1970-01-01 00:00:30", "1970-01-01 00:01:30"), "v") == [(30, 12), (60, 11), (90, 50)]
    assert store.retained(store.read(spark, path), SPEC, "60s").count() == 2
    assert store.purge(spark, path, "19700102") == ["19700101"]


def test_catalog(spark):
    c = Catalog(spark)
    c.use("tide_test")
    c.create("m", "t timestamp_ntz, v double, id long", SPEC)
    assert c.describe("m").time == "t"
    c.insert("m", frame(spark, BASE))
    assert c.stats("m")["objects"] == 6
    assert c.list_collections("m").count() == 1
    assert c.clear("m")["cleared"] and spark.table("m").count() == 0
    c.drop("m")
    spark.sql("USE default")
    c.drop_database("tide_test")
    assert c.ping() == {"ok": 1} and c.hello()["ismaster"]


def test_count_of_a_field_skips_rows_without_it(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "v double")
    out = aggregate(df, SPEC, [{"$group": {"_id": None, "has": {"$count": "$v"}, "all": {"$count": {}}}}])
    assert tuple(out.first()) == (2, 3)


@pytest.mark.parametrize("ranges", [2, 5, 40])
def test_ranges_change_no_result(spark, ranges):
    rng = random.Random(3)
    at, points = 0, []
    for _ in range(200):
        at += rng.choice([0, 1, 1, 2, 30, 500])
        points.append((at, rng.choice([1, 2, 3, 60])))
    rng.shuffle(points)
    df = frame(spark, points).withColumn("k", F.col("id") % 3)
    spec = SeriesSpec("t", ("k",), ("v",), ("id",))
    rows = lambda x: sorted(map(str, x.collect()))
    for keys in ((), ("k",)):
        for method in ("zscore", "iqr", "mad"):
            one, many = (rows(detect.anomalies(df, spec, "v", method, 12, 1.5, keys, n)) for n in (1, ranges))
            assert one == many and one
        assert rows(series.interpolate(df, spec, "v", "10s", 0, "linear", keys, 1)) == rows(series.interpolate(df, spec, "v", "10s", 0, "linear", keys, ranges))
        assert rows(windows.downsample(df, spec, "v", "10s", "avg", "linear", keys, 1)) == rows(windows.downsample(df, spec, "v", "10s", "avg", "linear", keys, ranges))
        one, many = ({r.id: round(r.v_ema, 9) for r in series.ema(df, spec, "v", 0.3, keys, n).collect()} for n in (1, ranges))
        assert one == many and len(one) == 200


def test_a_gap_of_many_points_is_filled_in_blocks(spark):
    out = series.interpolate(frame(spark, [(0, 0), (100_000, 100_000)]), SPEC, "v", "1s").where("inserted")
    assert out.count() == 99_999 and out.where("abs(v - unix_seconds(cast(t as timestamp))) > 1e-6").isEmpty()


@pytest.mark.parametrize("name", ["avg", "sum", "min", "max", "count", "first", "last"])
@pytest.mark.parametrize("step", ["30s", "25s"])
def test_moving_windows_of_every_accumulator(spark, name, step):
    got = pairs(windows.moving(frame(spark, BASE), SPEC, "v", "60s", step, name), f"v_{name}")
    apply = {"avg": lambda x: sum(x) / len(x), "sum": sum, "min": min, "max": max, "count": len, "first": lambda x: x[0], "last": lambda x: x[-1]}[name]
    s = int(step[:-1])
    held = {k: [v for t, v in BASE if k * s <= t < k * s + 60] for k in range(200 // s + 1)}
    assert got == [(k * s + 30, round(apply(v), 4)) for k, v in held.items() if v]


def test_hashes_of_bytes(spark):
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "hello, world", "é" * 9, "x" * 100, None]

    def murmur(data, h=0):
        turn = lambda x, n: (x << n | x >> 32 - n) & 0xFFFFFFFF
        word = lambda b: turn(int.from_bytes(b, "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        whole = len(data) // 4 * 4
        for i in range(0, whole, 4):
            h = (turn(h ^ word(data[i : i + 4]), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= word(data[whole:]) ^ len(data)
        for n, c in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> n) * c & 0xFFFFFFFF
        return h ^ h >> 16

    def fnv(data):
        h = 2166136261
        for b in data:
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    assert murmur(b"hello, world") == 345750399 and fnv(b"a") == 0xE40C292C
    df = spark.createDataFrame([(x,) for x in texts], "s string").repartition(2)
    for r in df.select("s", hashes.fnv1a(F.col("s")).alias("f"), hashes.murmur3(F.col("s")).alias("m"), hashes.crc32(F.col("s")).alias("c")).collect():
        raw = None if r.s is None else r.s.encode()
        assert (r.f, r.m, r.c) == ((None,) * 3 if raw is None else (fnv(raw), murmur(raw), zlib.crc32(raw)))


def days_frame(spark, n=6):
    return spark.createDataFrame([(ZERO + dt.timedelta(hours=5 * i), float(i), i) for i in range(24 * n // 5)], "t timestamp_ntz, v double, id long")


@pytest.mark.parametrize("stop", [None, "rename", "delete"])
def test_an_interrupted_migration_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, stop):
    hot, cold, df = f"file://{tmp_path}/hot", f"file://{tmp_path}/cold", days_frame(spark)
    store.insert(df, hot, SPEC)
    if stop:
        with monkeypatch.context() as m:
            m.setattr(store, "_finish", lambda *a: None)
            store.migrate(spark, hot, cold, "19700104")
        if stop == "delete":  # one day's files were put into place, its folder in the hot tier still waits to be dropped
            day = "dt=19700101"
            (tmp_path / "cold" / day).mkdir()
            for f in (tmp_path / "cold" / "_staged" / day).iterdir():
                f.rename(tmp_path / "cold" / day / f.name)
            (tmp_path / "cold" / "_staged" / day).rmdir()
    assert store.migrate(spark, hot, cold, "19700104") == ([] if stop else ["19700101", "19700102", "19700103"])
    assert sorted(r.id for r in store.read_tiers(spark, hot, cold).collect()) == list(range(df.count()))
    assert store.days(spark, cold) == ["19700101", "19700102", "19700103"]


def test_updates_and_deletes_rewrite_only_their_days(spark, tmp_path):
    path, df = f"file://{tmp_path}/s", days_frame(spark)
    store.insert(df, path, SPEC)
    before = {p.name for p in tmp_path.glob("s/dt=19700105/*.parquet")}
    assert store.rewrite(spark, path, SPEC, F.col("id").isin(0, 1, 6), {"v": F.lit(-1.0)}) == ["19700101", "19700102"]
    assert store.rewrite(spark, path, SPEC, F.col("t") < "1970-01-02") == ["19700101"]
    assert {r.id: r.v for r in store.read(spark, path).collect()} == {i: -1.0 if i == 6 else float(i) for i in range(5, df.count())}
    assert {p.name for p in tmp_path.glob("s/dt=19700105/*.parquet")} == before and store.days(spark, path)[0] == "19700102"
    with pytest.raises(ValueError, match="time"):
        store.rewrite(spark, path, SPEC, F.col("id") == 7, {"t": F.lit(None)})


def test_an_interrupted_rewrite_is_ended(spark, tmp_path):
    path, df = f"file://{tmp_path}/s", days_frame(spark, 2)
    store.insert(df, path, SPEC)
    (tmp_path / "s" / "_leaving").mkdir()
    (tmp_path / "s" / "dt=19700101").rename(tmp_path / "s" / "_leaving" / "dt=19700101")
    store.rewrite(spark, path, SPEC, F.col("id") == 9, {"v": F.lit(0.5)})
    assert sorted(r.id for r in store.read(spark, path).collect()) == list(range(df.count()))


def test_documents_are_parsed_flattened_and_appended(spark, tmp_path):
    path, spec = f"file://{tmp_path}/d", SeriesSpec("t", ("a", "b"), ("v",))
    docs = spark.createDataFrame([("2024-01-02T03:04:05Z", {"a": "x"}, 1.0), ("never", {"b": "y"}, 2.0), ("1704164645000000000", None, 3.0)], "timestamp string, tags map<string,string>, v double")
    assert store.insert_documents(docs, path, spec) == 1
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert sorted((r.v, r.t, r.a, r.b) for r in store.read(spark, path).collect()) == [(1.0, at, "x", None), (3.0, at, None, None)]


def test_clear_keeps_the_schema(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    days_frame(spark).write.parquet(path)
    store.clear(spark, path)
    left = spark.read.parquet(path)
    assert left.columns == ["t", "v", "id"] and left.count() == 0


def test_expiry_granularity_and_database_statistics(spark):
    c = Catalog(spark)
    c.use("tide_more")
    c.create("m", "t timestamp_ntz, v double, id long", SeriesSpec("t", (), ("v",), ("id",)), expire="1d", granularity="12h")
    c.insert("m", days_frame(spark))
    assert c.downsample("m").count() == 12
    assert c.expire_rows("m", "1970-01-05 00:00:00")["removed"] == 15
    found = c.database_stats("tide_more")
    assert (found["collections"], found["objects"]) == (1, days_frame(spark).count() - 15) and found["dataSize"] > 0
    spark.sql("USE default")
    c.drop_database("tide_more")


def test_period_ranges_take_whole_periods(spark):
    df = days_frame(spark)
    level = lambda a, b, **k: df.where(filters.period_range(SPEC, a, b, **k)).count()
    assert level("1970-01-02 10:00:00", "1970-01-04 09:00:00") == df.where("t >= '1970-01-02' and t < '1970-01-05'").count()
    assert level("1970-01-02 10:00:00", "1970-01-04 09:00:00", include_start=False, include_end=False) == df.where("t >= '1970-01-03' and t < '1970-01-04'").count()
    assert level("1969-12-31 10:00:00", "1970-03-04 09:00:00", include_start=False) == df.count()
