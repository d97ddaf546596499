"""Documented examples, file skipping, streaming sources, and a sample of the registered queries."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideframe import TRS, multi_time_series, time_series
from tideframe.sources import skipping
from tideframe.streaming import add_sink, polling_source, run, stream_series, writer_source


def test_reference_times(spark):
    day = TRS(timedelta(days=1), datetime(1990, 1, 1, tzinfo=timezone.utc))
    minute = TRS(timedelta(minutes=1))
    df = spark.createDataFrame([(1546300800000,)], "ms long")
    nine = 1546300800000 + 9 * 3_600_000
    got = df.select(
        TRS().to_index(F.col("ms")), day.to_long_lower(F.lit(2)), day.to_long_upper(F.lit(2)),
        minute.to_long_lower(minute.to_index(F.lit(nine + 1000))), minute.to_long_lower(minute.to_index(F.lit(nine + 2000))),
        minute.to_index(F.lit(-1)),
    ).first()
    start = 631152000000
    assert list(got) == [1546300800000, start + 2 * 86_400_000, start + 3 * 86_400_000 - 1, nine, nine, -1]


def test_keyed_table(spark):
    df = spark.createDataFrame([("a", 1, 27.0), ("b", 3, 4.0), ("a", 5, 17.0), ("a", 3, 7.0), ("b", 2, 45.0)], "letters string, timestamp long, numbers double")
    ts = multi_time_series(df, "timestamp", "letters", "numbers")
    got = {r.letters: [o.tick for o in r.observations] for r in ts.collect().collect()}
    assert got == {"a": [1, 3, 5], "b": [2, 3]}


def test_segments_of_the_documents(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 8)], "t long, v double")
    ts = time_series(df, "t", "v")
    odd_even = {r.seg_id: r.n for r in ts.segment_by("value % 2 = 0").bounds().collect()}
    assert odd_even == {True: 3, False: 4}
    assert sorted((r.seg_start, r.seg_end) for r in ts.segment(3, 2).bounds().collect()) == [(1, 3), (3, 5), (5, 7)]
    assert sorted((r.seg_start, r.n) for r in ts.segment_by_time(3, 3).bounds().collect()) == [(1, 3), (4, 3), (7, 1)]
    around = ts.segment_by_anchor("value % 2 = 0", 1, 1).bounds().collect()
    assert sorted((r.seg_id, r.seg_start, r.seg_end, r.n) for r in around) == [(2, 1, 3, 3), (4, 3, 5, 3), (6, 5, 7, 3)]


@pytest.fixture()
def stored(spark, tmp_path):
    data, index = str(tmp_path / "data"), str(tmp_path / "index")
    rows = [(i, float(i), ["x", "y", "z"][i // 100], None if i % 7 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, temp double, city string, maybe long")
    df.repartitionByRange(6, "id").write.parquet(data)
    return skipping.FileIndex(spark, data, index).minmax("temp", "maybe").value_list("city").bloom("id"), df


def test_skipping(spark, stored):
    index, df = stored
    assert not index.is_indexed()
    assert {(r.kind, r.column, r.files) for r in index.build().collect()} == {("minmax", "temp", 6), ("minmax", "maybe", 6), ("values", "city", 6), ("bloom", "id", 6)}
    c = skipping.col
    asked = {
        "range": (c("temp") > 260.0, "temp > 260"),
        "list": (c("city") == "y", "city = 'y'"),
        "bloom": (c("id") == 17, "id = 17"),
        "in": (c("id").isin(1, 299, 1000), "id in (1, 299, 1000)"),
        "or": ((c("temp") < 5.0) | (c("city") == "z"), "temp < 5 or city = 'z'"),
        "nulls": (c("maybe") >= 290, "maybe >= 290"),
        "none": (c("city") == "w", "city = 'w'"),
        "opaque": (skipping.opaque(F.col("temp") % 50 == 0), "temp % 50 = 0"),
    }
    for p, sql in asked.values():
        assert sorted(index.skip_read(p).collect()) == sorted(df.where(sql).collect())
    total = index.skip_stats().first()
    assert 0 < total.files_skipped < total.files_total
    index.clear_stats()
    index.skip_read(asked["none"][0])
    assert index.skip_stats().first().files_skipped == 6
    # New files are read without an index, and enter it by a refresh.
    spark.createDataFrame([(1000, 1.0, "w", 1)], df.schema).coalesce(1).write.mode("append").parquet(index.data)
    assert [r.id for r in index.skip_read(asked["none"][0]).collect()] == [1000]
    assert tuple(index.refresh().first()) == (1, 6, 0)
    index.clear_stats()
    assert index.skip_read(c("temp") > 299.5).count() == 0
    assert index.skip_stats().first().files_skipped == 7
    index.remove()
    assert not index.is_indexed()


def test_skipping_is_the_filtered_scan(spark, tmp_path):
    """Whatever the types of column and literal, the index loses no row and invents none."""
    rows = [(i, str(i % 12), float(i) if i % 11 else None, f"2024-01-{i % 28 + 1:02d} 00:00:00", "one" if i < 50 else "two") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a string, f double, t string, g string").withColumn("t", F.col("t").cast("timestamp"))
    df.repartitionByRange(5, "id").write.parquet(str(tmp_path / "d"))
    index = skipping.FileIndex(spark, str(tmp_path / "d"), str(tmp_path / "ix"), value_limit=20, bloom_values=100)
    index.minmax("id", "a", "f", "t", "g").value_list("a", "id", "g", "t").bloom("a", "id", "f").build()
    c, day = skipping.col, datetime(2024, 1, 9)
    asked = [
        c("a") == 10, c("a") == "10", c("a") == 5.0, c("a") > 9, c("a") > "9", c("a").isin("1", "77"), c("a").isin(3, 4), c("a") != "3", c("a") != 3,
        c("id") == 7, c("id") == 7.0, c("id") == 7.5, c("id") == 2**40, c("id") == "7", c("id") != 7, c("id") < 12.5, c("f") == 30, c("f") == 30.0,
        c("f") != 30.0, c("f").isNull(), c("f").isNotNull(), c("t") == day, c("t") >= day, c("t") < day, c("g") != "one", ~(c("g") == "two"),
        ~(c("id") < 150), ~(c("id").isin(1, 2, 3)), ~((c("id") > 20) & (c("a") == "4")), ~((c("id") > 20) | c("f").isNull()), ~skipping.opaque("id % 2 = 0"),
        (c("id") > 190) | (c("f") == float("nan")), F.col("id") * 2 > 390, "id % 50 = 3 and g = 'two'", ~c("f").isNull(),
    ]
    for i, p in enumerate(asked):
        condition = p.data if isinstance(p, skipping.Predicate) else F.expr(p) if isinstance(p, str) else p
        assert sorted(map(str, index.skip_read(p).collect())) == sorted(map(str, df.where(condition).collect())), i
    index.clear_stats()
    index.skip_read(c("g") != "one")
    index.skip_read(~(c("id") < 150))
    index.skip_read(c("a") == "77")
    assert index.skip_stats().first().files_skipped >= 1 + 3 + 5


def test_index_is_built_again_after_a_refresh(spark, stored):
    index, df = stored
    index.build()
    spark.createDataFrame([(1000, 1.0, "w", 1)], df.schema).coalesce(1).write.mode("append").parquet(index.data)
    index.refresh()
    again = skipping.FileIndex(spark, index.data, index.index).minmax("id")
    again.build()
    assert again.table().count() == 7 and "min_id" in again.table().columns
    assert [r.id for r in again.skip_read(skipping.col("id") == 1000).collect()] == [1000]
    assert again.skip_stats().first().files_skipped == 6
    again.remove()
    assert not again.is_indexed()


def test_metadata_location(spark, tmp_path):
    assert skipping.metadata_location(spark, path="/a/b", base="/ix") == "/ix/a_b"
    spark.sql(f"CREATE TABLE metered (id BIGINT) USING parquet LOCATION '{tmp_path}/metered' TBLPROPERTIES ('skipping.location' = '/here')")
    assert skipping.metadata_location(spark, table="metered") == "/here"
    spark.sql("DROP TABLE metered")


def test_polling_stream(spark):
    def poll(start, end):
        return [f"{i},{i * 2}" if i % 5 else "bad" for i in range(start, end)]

    def parse(line):
        parts = line.split(",")
        return (int(parts[0]), float(parts[1])) if len(parts) == 2 else None

    out = run(polling_source(spark, "numbers_poll", "tick long, value double", lambda: 20, poll, parse))
    assert sorted(r.tick for r in out.collect()) == [i for i in range(20) if i % 5]


def test_custom_writer(spark, tmp_path):
    place = str(tmp_path)

    def write_rows(rows, options):
        import uuid

        with open(f"{options['folder']}/{uuid.uuid4().hex}.txt", "w") as f:
            f.writelines(f"{r.tick}={r.value}\n" for r in rows)

    writer_source(spark, "lines_out", write_rows)
    ts = time_series(spark.createDataFrame([(1, 2.0), (2, 3.0)], "t long, v double"), "t", "v")
    ts.write.option("folder", place).save("lines_out")
    lines = sorted(line for p in tmp_path.glob("*.txt") for line in p.read_text().split())
    assert lines == ["1=2.0", "2=3.0"]


def test_late_rows_are_dropped(spark, tmp_path):
    src = tmp_path / "in"
    schema = "k long, ts timestamp, v double"

    def add(*minutes):
        rows = [(1, datetime(2024, 1, 1, 0, 0) + timedelta(minutes=m), 1.0) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))

    got = []

    def dump(batch, _id):
        got.extend((r.seg_start, r.n) for r in batch.collect())

    def once():
        stream = stream_series(spark.readStream.schema(schema).parquet(str(src)), "ts", "k", "v", "10 minutes")
        add_sink(stream.segment_by_time("5 minutes").transform(n="count(*)"), dump, str(tmp_path / "cp")).awaitTermination()

    add(0, 1, 6, 30)
    once()
    add(2, 60)  # minute 2 is late by now
    once()
    start = 1704067200000
    assert sorted(got) == [(start, 2), (start + 300_000, 1), (start + 1_800_000, 1)]


SAMPLE = ["resample_weekly_mean", "as_of_join", "segment_by_marker", "describe", "distance_correlation", "matcher_subseq", "frequent_sub_sequences", "skip_read_minmax", "stream_resample"]


@pytest.mark.parametrize("name", SAMPLE)
def test_registered_query(spark, sf, name):
    import duckdb

    from tests.check import TABLES, rows
    from tideframe.catalog import ORACLES, QUERIES

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    rel = db.execute(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in rel.description], rel.fetchall())


def test_feature_ranges(spark):
    from tideframe import TS
    from tideframe.operators import features

    rows = [(1, t, float(t)) for t in range(20)]
    data = TS(spark.createDataFrame(rows, "k long, tick long, value double"), ("k",))
    marks = spark.createDataFrame([(1, 5, 1.0), (1, 6, 0.0), (1, 14, 1.0)], "k long, tick long, value double")
    out = features.prepare(data, TS(marks, ("k",)), "value = 1", 2, 3, 1.0, 1.0, feature_range=(0, 1), label_range=(2, 3)).orderBy("tick").collect()
    # The window of tick 6 overlaps that of tick 5; the label series has one more mark within its range.
    assert [(r.tick, r.label, r.feature) for r in out] == [(5, [1.0, 0.0], [3.0, 4.0]), (14, [1.0], [12.0, 13.0])]
    none = features.prepare(data, TS(marks, ("k",)), "value = 1", 2, 3, 1.0, 0.0, with_replacement=True)
    assert sorted(r.tick for r in none.collect()) == [5, 14]
    pairs = data.map("array(value, -value)")
    flat = features.prepare_predictions(pairs, 1, 0, label=TS(marks, ("k",)), anchor="value = 0", flatten_vector=True).first()
    assert flat.feature == [5.0, -5.0, 6.0, -6.0]


def test_models_are_tables(spark, tmp_path):
    from tideframe.operators import cluster, mining

    df = spark.createDataFrame([(i, [float((j * (1 + i % 3)) % 7) for j in range(16)]) for i in range(12)], "id long, values array<double>")
    models = cluster.explore(df, 1, 3, keys=["id"], max_iterations=3)
    assert [len(m.centroids) for m in models] == [2, 3]
    assert models[1].inter_cluster_distances.shape == (3, 3)
    models[0].save(spark, str(tmp_path / "shapes"))
    again = cluster.load_model(spark, str(tmp_path / "shapes"), ["id"])
    assert again.score(df).orderBy("id").collect() == models[0].score(df).orderBy("id").collect()
    rows = [(k, t, v) for k, s in {1: "abc", 2: "acb", 3: "bc"}.items() for t, v in enumerate(s)]
    ts = multi_time_series(spark.createDataFrame(rows, "k long, t long, v string"), "t", "k", "v")
    model = mining.frequent_sub_sequences(ts, 0.6)
    assert {"".join(r.sequence): r.coverage for r in model.collect()} == {"a": 2, "b": 3, "c": 3, "ab": 2, "ac": 2, "bc": 2}
    mining.save_model(model, str(tmp_path / "patterns"), 0.6)
    assert spark.read.parquet(str(tmp_path / "patterns")).where("min_support = 0.6").count() == 6


def test_fold_counts_zero_once(spark):
    from tideframe.operators import cross

    df = spark.range(100).selectExpr("id AS tick", "cast(id AS double) AS value", "id % 3 AS k").repartition(7)
    ts = multi_time_series(df, "tick", "k", "value")
    total = lambda acc, v: acc + float(v.sum())
    assert cross.aggregate_fold(ts, 10.0, total, lambda a, b: a + b).first().value == 4960
    top = cross.aggregate_fold(ts, -5.0, lambda acc, v: max(acc, float(-v.min())), max, neutral=float("-inf"))
    assert top.first().value == 0
    assert cross.aggregate_fold(ts.with_df(ts.df.where("false")), 10.0, total, lambda a, b: a + b).first().value == 10


def test_upsert_keeps_one_row_per_key(spark):
    from tideframe.sources import sinks

    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (None, 1, "c")], "k int, v int, w string")
    new = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (1, 7, "z"), (3, 1, "n"), (None, 2, "m")], "k int, v int, w string")
    got = sorted(map(tuple, sinks.merge_latest(old, new, ["k"], ["v"]).collect()), key=str)
    assert got == sorted([(1, 7, "z"), (2, 1, "b"), (3, 1, "n"), (None, 2, "m")], key=str)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "bigint"])
def test_tick_range_reaches_the_scan(spark, tmp_path, kind):
    rows = spark.range(-200, 2000).selectExpr("id % 3 AS k", f"{'id' if kind == 'bigint' else f'cast(timestamp_millis(id * 40000000 + 7) AS {kind})'} AS at", "cast(id AS double) AS value")
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    whole = multi_time_series(df, "at", "k", "value", granularity=None if kind == "bigint" else timedelta(days=1), start_time=None if kind == "bigint" else datetime(1969, 12, 1, tzinfo=timezone.utc))
    for a, b in ((5, 40), (-30, 31), (0, 0), (10**7, 10**8)):
        some = whole.get_values(a, b)
        assert sorted(some.df.collect()) == sorted(whole.df.where(f"tick BETWEEN {a} AND {b}").collect())
        around = whole.map("value * 2").filter("value <> 8").get_values(a, b, inclusive=True)
        ticks = [r.tick for r in whole.df.where("value <> 4").select("tick").collect()]
        for k in range(3):
            own = sorted(r.tick for r in whole.df.where(f"k = {k} AND value <> 4").collect())
            lo, hi = max([t for t in own if t <= a], default=a), min([t for t in own if t >= b], default=b)
            assert sorted(r.tick for r in around.df.where(f"k = {k}").collect()) == [t for t in own if lo <= t <= hi] and ticks

    def pushed(ts):
        plan = ts.df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return [line for line in plan.splitlines() if "PushedFilters" in line]

    for ts in (whole, whole.map("value + 1").filter("value > 0")):
        (one,) = pushed(ts.get_values(5, 40))
        assert "GreaterThanOrEqual(at" in one and "LessThanOrEqual(at" in one
        assert all("OrEqual(at" in line for line in pushed(ts.get_values(5, 40, inclusive=True)))


def test_models_without_enough_rows_keep_their_keys(spark):
    from tideframe.operators import forecast

    df = spark.createDataFrame([(1, i, float(i % 5)) for i in range(30)] + [(2, 0, 1.0)], "k int, tick long, value double")
    ts = multi_time_series(df, "tick", "k", "value")
    out = forecast.forecast(ts, 3, "exponential").collect()
    assert sorted((r.k, r.step, r.value is None) for r in out) == [(k, s, k == 2) for k in (1, 2) for s in (1, 2, 3)]
    grown = forecast.update_model(forecast.exponential(ts), multi_time_series(spark.createDataFrame([(2, 5, 3.0), (2, 9, 3.0), (3, 1, 1.0)], df.schema), "tick", "k", "value"), forecast.exponential)
    got = {r.k: (r.state[0], r.error_history_length, r.last_time) for r in grown.collect()}
    assert got[2] == (pytest.approx(1.0 * 0.49 + 3.0 * 0.51), 2, 9) and got[1][2] == 29 and got[3][1] == 0
