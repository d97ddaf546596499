"""Sources, sinks, plain relational operators and file skipping."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..operators import create
from ..plans import saved, shared_folder
from ..sources import readers, sinks, skipping
from .base import E, events, query, r, table


def scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_parquet", "SELECT * FROM supplier")
def _(spark, sf):
    return readers.read_parquet(spark, f"{sf}/supplier.parquet")


@query("read_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "supplier").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE")


@query("read_csv_inferred", "SELECT c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    df = readers.read_csv(spark, path)
    return df.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("c_acctbal"), 2).alias("balance"))


@query("read_hive_table", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")
def _(spark, sf):
    path, name = scratch(spark, "hive"), f"orders_{uuid.uuid4().hex}"
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    df = readers.read_hive_table(spark, name, path, "o_orderkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING", "o_orderstatus")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@query("read_text_map", f"WITH {E} SELECT tick, value FROM e WHERE event_type <> 'error'")
def _(spark, sf):
    path = scratch(spark, "text")
    ev = events(spark, sf, F.struct("event_type", "value")).df
    ev.select(F.concat_ws(";", F.col("tick").cast("string"), "value.event_type", F.col("value.value").cast("string"))).write.text(path)
    parts = F.split("value", ";")
    parse = F.when(parts[1] != "error", F.struct(parts[0].cast("long").alias("tick"), parts[2].cast("double").alias("value")))
    return readers.read_text_map(spark.read.text(path), parse)


@query("read_generated", "SELECT count(*) AS n, sum(l_linenumber * 10) AS total FROM (SELECT range AS id FROM range((SELECT count(*) FROM orders))) r JOIN lineitem ON l_orderkey = r.id")
def _(spark, sf):
    n = table(spark, sf, "orders").count()
    ids = readers.read_generated(spark, 0, n)
    both = ids.join(table(spark, sf, "lineitem"), F.col("id") == F.col("l_orderkey"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_linenumber") * 10).alias("total"))


@query("json_project", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    df = table(spark, sf, "events")
    return df.select("event_id", F.from_json("props", "k BIGINT").alias("data")).select("event_id", "data.*")


@query("filter_not_null_eq", "SELECT * FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type = 'purchase'")
def _(spark, sf):
    return table(spark, sf, "events").where("value IS NOT NULL AND user_id IS NOT NULL AND event_type = 'purchase'")


@query("group_count_sorted", "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC")
def _(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").count().orderBy(F.desc("count"))


@query("group_sum_sorted", "SELECT l_returnflag, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1 ORDER BY 2 DESC")
def _(spark, sf):
    return spark.sql("SELECT l_returnflag, sum(l_quantity) AS quantity FROM {li} GROUP BY 1 ORDER BY 2 DESC", li=table(spark, sf, "lineitem"))


@query("ratio_projection", "SELECT p_partkey, p_retailprice / p_size AS price_per_size FROM part ORDER BY 2")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / F.col("p_size")).alias("price_per_size")).orderBy("price_per_size")


@query("ratio_rounded", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 10) AS unit FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 10).alias("unit"))


@query("count_where", "SELECT count(*) AS n FROM events WHERE value > 30")
def _(spark, sf):
    return table(spark, sf, "events").where("value > 30").agg(F.count(F.lit(1)).alias("n"))


@query("select_where", "SELECT * FROM events WHERE value > 30")
def _(spark, sf):
    return table(spark, sf, "events").where("value > 30")


@query("map_count", "SELECT count(v) AS n, round(sum(v), 4) AS total FROM (SELECT sqrt(o_totalprice) + ln(o_totalprice) + log10(o_totalprice) AS v FROM orders)")
def _(spark, sf):
    v = F.sqrt("o_totalprice") + F.ln("o_totalprice") + F.log10("o_totalprice")
    return table(spark, sf, "orders").select(v.alias("v")).agg(F.count("v").alias("n"), r(F.sum("v"), 4).alias("total"))


@query("temp_view_sql", "SELECT o_orderpriority, avg(o_totalprice) AS price FROM orders GROUP BY 1")
def _(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders_view")
    return spark.sql("SELECT o_orderpriority, avg(o_totalprice) AS price FROM orders_view GROUP BY 1")


# Sinks: written, read back.


@query("to_df", f"WITH {E} SELECT user_id, tick, value, epoch_ms(tick) AS timestamp FROM e")
def _(spark, sf):
    from ..trs import TRS

    ts = events(spark, sf)
    out = create.to_df(ts.with_df(ts.df, trs=TRS()))
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("write_csv", f"WITH {E} SELECT user_id, tick, value FROM e")
def _(spark, sf):
    path = scratch(spark, "series")
    events(spark, sf).write.option("delimiter", "|").csv(path)
    return spark.read.option("header", True).option("delimiter", "|").schema("user_id BIGINT, tick BIGINT, value DOUBLE").csv(path)


@query("write_object_file", f"WITH {E} SELECT user_id, tick, value FROM e")
def _(spark, sf):
    path = scratch(spark, "series")
    events(spark, sf).write.object_file(path)
    return sinks.read_object_file(spark, path, "user_id", "event_id").to_df_observations()


@query("write_encoded", f"WITH {E} SELECT 'user-' || user_id AS user_id, tick, CAST(round(value * 100) AS BIGINT) || 'c' AS value FROM e")
def _(spark, sf):
    path = scratch(spark, "series")
    cents = lambda c: F.concat(F.round(c * 100).cast("bigint").cast("string"), F.lit("c"))
    name = lambda c: F.concat(F.lit("user-"), c.cast("string"))
    events(spark, sf).write.encode_value(cents).encode_key(name).csv(path)
    return spark.read.option("header", True).schema("user_id STRING, tick BIGINT, value STRING").csv(path)


@query("write_save", f"WITH {E} SELECT user_id, count(*) AS n FROM e GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "series")
    events(spark, sf).write.save("json", path)
    return spark.read.schema("user_id BIGINT, tick BIGINT, value DOUBLE").json(path).groupBy("user_id").agg(F.count("value").alias("n"))


@query("table_write", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1 - s_suppkey, s_acctbal FROM supplier")
def _(spark, sf):
    name, place = f"accounts_{uuid.uuid4().hex}", scratch(spark, "accounts")
    sinks.create_table(spark, name, "c_custkey BIGINT, c_acctbal DOUBLE", location=place)
    cust = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    sinks.insert(cust, name)
    fresh = cust.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.lit(0.0))
    added = table(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    sinks.upsert(spark, name, fresh.unionByName(added), ["c_custkey"])
    out = spark.read.parquet(place)
    sinks.drop_table(spark, name)
    return out


# File skipping over lineitem, stored by month and spread over several files per month.
MONTH = "strftime(l_shipdate, '%Y-%m') AS month"


def stored(spark, sf, where="true"):
    path = scratch(spark, "lineitem")
    add_files(spark, sf, path, where)
    index = skipping.FileIndex(spark, path, path + "-index")
    return index.minmax("l_extendedprice", "l_shipdate").value_list("l_returnflag", "l_quantity").bloom("l_partkey")


def add_files(spark, sf, path, where):
    li = table(spark, sf, "lineitem").where(where).withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    li.repartition("month", F.col("l_orderkey") % 2).write.mode("append").partitionBy("month").parquet(path)


@query(
    "index_build",
    f"SELECT {MONTH}, count(*) AS rows, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_shipdate) AS day, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    index = stored(spark, sf)
    index.build()
    t = index.table().withColumn("month", F.regexp_extract("path", "month=([0-9-]+)", 1))
    return t.groupBy("month").agg(
        F.sum("rows").alias("rows"), F.min("min_l_extendedprice").alias("lo"), F.max("max_l_extendedprice").alias("hi"),
        F.min("min_l_shipdate").alias("day"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values_l_returnflag")))), ",").alias("flags"),
    )


@query(
    "index_stats",
    "SELECT kind, \"column\", count(l_orderkey) > 0 AS complete FROM lineitem, (VALUES ('minmax', 'l_extendedprice'), ('minmax', 'l_shipdate'), ('values', 'l_returnflag'), ('values', 'l_quantity'), ('bloom', 'l_partkey')) t(kind, \"column\") GROUP BY 1, 2",
)
def _(spark, sf):
    index = stored(spark, sf)
    status = index.build()
    return status.select("kind", "column", (F.col("files") == index.files().count()).alias("complete"))


@query(
    "index_refresh",
    f"SELECT {MONTH}, count(*) AS rows, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    index = stored(spark, sf, "l_returnflag <> 'R'")
    index.build()
    add_files(spark, sf, index.data, "l_returnflag = 'R'")
    index.refresh()
    t = index.table().withColumn("month", F.regexp_extract("path", "month=([0-9-]+)", 1))
    return t.groupBy("month").agg(F.sum("rows").alias("rows"), F.max("max_l_extendedprice").alias("hi"))


LI = "l_orderkey, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag"
FROM, TO = "1997-03-10", "1997-05-05"


@query("skip_read_minmax", f"SELECT {LI} FROM lineitem WHERE l_shipdate >= TIMESTAMP '{FROM}' AND l_shipdate < TIMESTAMP '{TO}' AND l_extendedprice > 30000")
def skip_read_minmax(spark, sf):
    index = stored(spark, sf)
    index.build()
    c = skipping.col
    p = (c("l_shipdate") >= datetime(1997, 3, 10)) & (c("l_shipdate") < datetime(1997, 5, 5)) & (c("l_extendedprice") > 30000.0)
    return index.skip_read(p).select(*LI.split(", "))


@query("skip_read_value_list", f"SELECT {LI} FROM lineitem WHERE l_returnflag IN ('R', 'X') AND l_quantity = 13 OR l_shipdate < TIMESTAMP '1995-02-01'")
def _(spark, sf):
    index = stored(spark, sf)
    index.build()
    c = skipping.col
    p = (c("l_returnflag").isin("R", "X") & (c("l_quantity") == 13.0)) | (c("l_shipdate") < datetime(1995, 2, 1))
    return index.skip_read(p).select(*LI.split(", "))


@query("skip_read_bloom", f"SELECT {LI} FROM lineitem WHERE l_partkey = 77 AND l_extendedprice * l_discount > 10")
def _(spark, sf):
    index = stored(spark, sf)
    index.build()
    p = (skipping.col("l_partkey") == 77) & skipping.opaque(F.col("l_extendedprice") * F.col("l_discount") > 10)
    return index.skip_read(p).select(*LI.split(", "))


@query("skip_read_opposite", f"SELECT {LI} FROM lineitem WHERE l_returnflag <> 'R' AND NOT (l_quantity >= 10 OR l_shipdate < TIMESTAMP '1996-01-01') AND l_partkey IS NOT NULL")
def _(spark, sf):
    index = stored(spark, sf)
    index.build()
    c = skipping.col
    p = (c("l_returnflag") != "R") & ~((c("l_quantity") >= 10.0) | (c("l_shipdate") < datetime(1996, 1, 1))) & c("l_partkey").isNotNull()
    return index.skip_read(p).select(*LI.split(", "))


@query("skip_read_mixed_types", f"SELECT {LI} FROM lineitem WHERE l_returnflag = 'A' AND (l_quantity = 7 OR l_partkey = 12.0 OR l_partkey < 3.5)")
def _(spark, sf):
    index = stored(spark, sf)
    index.minmax("l_partkey").build()
    c = skipping.col
    p = (c("l_returnflag") == "A") & ((c("l_quantity") == 7) | (c("l_partkey") == 12.0) | (c("l_partkey") < 3.5))
    return index.skip_read(p).select(*LI.split(", "))


@query("skip_read_sql", f"SELECT {LI} FROM lineitem WHERE l_orderkey % 100 = 7")
def _(spark, sf):
    index = stored(spark, sf)
    index.build()
    return index.skip_read("l_orderkey % 100 = 7").select(*LI.split(", "))


@query("index_rebuild", f"SELECT {MONTH}, count(*) AS rows, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem GROUP BY 1")
def _(spark, sf):
    index = stored(spark, sf, "l_returnflag <> 'R'")
    index.build()
    add_files(spark, sf, index.data, "l_returnflag = 'R'")
    index.refresh()
    again = skipping.FileIndex(spark, index.data, index.index).minmax("l_orderkey")
    again.build()
    t = again.table().withColumn("month", F.regexp_extract("path", "month=([0-9-]+)", 1))
    return t.groupBy("month").agg(F.sum("rows").alias("rows"), F.min("min_l_orderkey").alias("lo"), F.max("max_l_orderkey").alias("hi"))


@query("skip_stats", "SELECT true AS some_read, true AS some_skipped, count(DISTINCT strftime(l_shipdate, '%Y-%m')) > 3 AS many FROM lineitem")
def _(spark, sf):
    index = stored(spark, sf)
    index.build()
    index.skip_read(skipping.col("l_shipdate") < datetime(1995, 6, 1))
    s = index.skip_stats()
    return s.select((F.col("files_skipped") < F.col("files_total")).alias("some_read"), (F.col("bytes_skipped") > 0).alias("some_skipped"), (F.col("files_total") > 3).alias("many"))


@query("skip_is_indexed", f"SELECT {MONTH}, count(*) AS rows, false AS before, true AS built, false AS removed FROM lineitem GROUP BY 1")
def _(spark, sf):
    """An index that is built, read and taken away; months and rows come from the index itself."""
    index = stored(spark, sf)
    before = index.is_indexed()
    index.build()
    built = index.is_indexed()
    found = saved(index.table().groupBy(F.regexp_extract("path", "month=([0-9-]+)", 1).alias("month")).agg(F.sum("rows").alias("rows")))
    index.remove()
    return found.withColumns({"before": F.lit(before), "built": F.lit(built), "removed": F.lit(index.is_indexed())})


@query("metadata_location", "SELECT '/indexes/lines' AS location, count(*) AS rows FROM lineitem")
def _(spark, sf):
    """Where the index of a table lives, from the table's property."""
    name, path = f"lines_{uuid.uuid4().hex}", scratch(spark, "lines")
    table(spark, sf, "lineitem").write.parquet(path)
    spark.sql(f"CREATE TABLE {name} USING parquet OPTIONS (path '{path}') TBLPROPERTIES ('skipping.location' = '/indexes/lines')")
    place = skipping.metadata_location(spark, table=name)
    rows = saved(spark.table(name).agg(F.count("*").alias("rows")))
    spark.sql(f"DROP TABLE {name}")
    return rows.select(F.lit(place).alias("location"), "rows")
