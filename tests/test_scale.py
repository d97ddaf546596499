import itertools
import tracemalloc
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.catalog import base, streams
from tideframe.functions import udf
from tideframe.handle import Segments, TS
from tideframe.llm import lm
from tideframe.operators import mining
from tideframe.plans import durable


def _spread(spark, seen, rows=100_000, n=3_000, **more):
    """Range of each of many series by partials; ``seen`` counts the calls of user functions."""
    df = spark.range(0, rows, 1, 4).selectExpr(f"if(id % {n} = 7, NULL, id % {n} + (1L << 60)) AS k", "id AS tick", "cast(id % 977 AS double) AS value")
    ts = TS(df, ("k",), **more)

    def count(out):
        seen.add(1)
        return out

    return ts, udf.fold_values(
        ts, lambda v: count([v.min(), v.max()]), lambda p: count([p["lo"].min(), p["hi"].max()]), lambda x: count(x[1] - x[0]), ["lo", "hi"]
    )


@pytest.mark.parametrize("chunk_rows", [1_000_000, 9])
def test_folds_call_the_functions_in_step_with_the_series(spark, chunk_rows):
    seen = spark.sparkContext.accumulator(0)
    ts, out = _spread(spark, seen, chunk_rows=chunk_rows)
    want = ts.df.groupBy("k").agg((F.max("value") - F.min("value")).alias("value"))
    got = out.collect()
    calls = seen.value
    assert sorted(map(str, got)) == sorted(map(str, want.collect()))
    per_series = 3 if chunk_rows > 9 else 2 * 4 + 2  # four slices of a hot series, and their meeting
    assert calls <= 1.1 * per_series * 3_000  # as often as a table has batches, before


def test_segments_reach_the_function_in_one_stream(spark):
    df = spark.range(0, 20_000, 1, 3).selectExpr(
        "if(id % 50 = 7, NULL, id % 50 + (1L << 60)) AS k", "id AS tick", "if(id % 11 = 0, NULL, id + (1L << 60)) AS e", "if(id % 3 = 0, NULL, cast(id AS double)) AS value"
    )
    segs = Segments(df.withColumn("seg_id", F.floor(F.col("tick") / 7_000)), ("k",), ("e",))

    def facts(pdf):
        whole = pdf["e"].dtype == np.int64
        assert list(pdf.index) == list(range(len(pdf))) and pdf["tick"].is_monotonic_increasing and pdf["tick"].dtype == np.int64
        return f"{pdf['value'].median()}/{pdf['value'].count()}/{pdf['e'].count()}/{int(pdf['e'].iat[0]) if whole else None}"

    out = udf.map_segments(segs, facts, "string")
    plan = out._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan  # one call of Spark's per segment, before
    text = F.concat_ws("/", F.median("value").cast("string"), F.count("value").cast("string"), F.count("e").cast("string"), F.when(F.count("e") == F.count("*"), F.min("e").cast("string")).otherwise(F.lit("None")))
    want = segs.df.groupBy("k", "seg_id").agg(text.alias("value"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        udf.map_segments(Segments(segs.df, ("k",), ("e",), chunk_rows=100), facts, "string")


@pytest.mark.parametrize("kind", ["string", "double"])
def test_item_sets_from_blocks_of_bits(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    value = (lambda i: "abcdefg"[i]) if kind == "string" else (lambda i: float("nan") if i == 6 else float(i))
    rows = [(k or None, t, value(int(min(6, rng.geometric(0.35) - 1))) if t % 9 else None) for k in range(60) for t in range(int(rng.integers(1, 12)))]
    ts = TS(spark.createDataFrame(rows, f"k long, tick long, value {kind}"), ("k",))
    monkeypatch.setattr(mining, "BLOCK_ROWS", 7)
    monkeypatch.setattr(mining, "TILE", 2)
    held = {}
    for k, _, v in rows:
        held.setdefault(k, set()).update([] if v is None else [str(v)])
    names = sorted(set().union(*held.values()))
    for support, size in ((0.1, None), (0.25, 2)):
        want = {}
        for length in range(1, (size or len(names)) + 1):
            for c in itertools.combinations(names, length):
                n = sum(set(c) <= s for s in held.values())
                if n >= support * len(held):
                    want[c] = n
        got = {tuple(sorted(map(str, r.item_set))): r.coverage for r in mining.frequent_item_sets(ts, support, size).collect()}
        assert {c: n for c, n in got.items() if "nan" not in c} == {c: n for c, n in want.items() if "nan" not in c}
        assert kind == "double" or len(want) > 20 or size
    baskets = spark.createDataFrame([([1, 2],), ([2],), ([],)] * 10, "items array<long>")
    blocks = mining._blocks(baskets.coalesce(1)).collect()
    assert len(blocks) == 5 and all(len(b) == 1 for r in blocks for b in r.bits)
    assert sum(bin(b[0]).count("1") for r in blocks for i, b in zip(r["items"], r.bits) if i == 2) == 20


def test_only_matches_of_frequent_patterns_are_written(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k or None, t, None if t == 3 else "ab"[t] if t < 2 else f"i{rng.integers(12)}") for k in range(40) for t in range(9)]
    ts = TS(spark.createDataFrame(rows, "k long, tick long, value string"), ("k",))
    written = []

    def saved(df):
        df = durable.saved(df)
        if "sequence" in df.columns and "ticks" in df.columns:
            written.append(df.count())
        return df

    monkeypatch.setattr(mining, "saved", saved)
    series = {}
    for k, t, v in rows:
        series.setdefault(k, []).extend([] if v is None else [v])
    items = sorted({v for s in series.values() for v in s})
    inside = lambda p, s: all(v in rest for rest in [iter(s)] for v in p)
    held, level = {}, [()]
    while level:
        level = [p + (v,) for p in level for v in items]
        level = [p for p in level if sum(inside(p, s) for s in series.values()) >= 0.35 * len(series)]
        held |= {p: sum(inside(p, s) for s in series.values()) for p in level}
    for cut in (ts, replace(ts, chunk_rows=4)):
        written.clear()
        model = mining.frequent_sub_sequences(cut, 0.35).select("sequence", "coverage")
        assert {tuple(r.sequence): r.coverage for r in model.collect()} == held and max(map(len, held)) > 2
        assert sum(written[1:]) == sum(n for p, n in held.items() if len(p) > 1)  # all that occur anywhere, before
        written.clear()
        score = mining.sub_sequence_matches(cut, model.where("size(sequence) = 2")).collect()
        assert len(score) == sum(written[1:]) == sum(n for p, n in held.items() if len(p) == 2)


def test_polling_holds_a_batch_at_a_time(spark, tmp_path, monkeypatch):
    spark.range(0, 200_000, 1, 1).selectExpr("if(id = 5, NULL, id) AS event_id", "if(id % 4 = 0, 'error', 'view') AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    polls = []
    source = streams.polling_source
    monkeypatch.setattr(streams, "polling_source", lambda *args: polls.append(args[4]) or source(*args))
    out = base.QUERIES["stream_source"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in out] == [("view", 149_999, 1, 199_999)]
    (poll,) = polls
    assert sum(1 for _ in poll(10, 60)) == 50
    tracemalloc.start()
    assert sum(1 for _ in poll(0, 200_000)) == 199_999
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000  # the whole slice as a list, before


def test_joined_halves_have_tasks_by_rows(spark, tmp_path, monkeypatch):
    spark.range(0, 3_000, 1, 2).selectExpr(
        "if(id % 50 = 0, NULL, id % 40) AS l_suppkey", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, id % 30) AS l_shipdate", "cast(id AS double) AS l_extendedprice",
        "if(id % 2 = 0, 'R', 'A') AS l_returnflag",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(base, "TASK_ROWS", 100, raising=False)
    few = base.QUERIES["inner_align"](spark, str(tmp_path))
    assert few.rdd.getNumPartitions() in (30, 60)  # a hundred rows of the table to a task, whatever its size; a union may keep the parts
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, few.collect())) == sorted(db.execute(base.ORACLES["inner_align"]).fetchall())


def test_training_takes_every_counted_trigram():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 30, (900, 3)), axis=0)
    counts = rng.integers(1, 50, len(grams)).astype(float)
    table = lm.LogBilinear.train(grams, counts, steps=60).table()
    order = rng.permutation(len(grams))
    assert np.allclose(lm.LogBilinear.train(grams[order], counts[order], steps=60).table(), table)  # draws depended on the order
    halves = lm.LogBilinear.train(np.r_[grams, grams], np.r_[counts / 2, counts / 2], steps=60).table()
    assert np.allclose(halves, table, atol=1e-6)
    more = counts.copy()
    more[17] += 20  # any one count tells
    a, b, c = grams[17]
    assert lm.LogBilinear.train(grams, more, steps=60).table()[a, b, c] > table[a, b, c]
