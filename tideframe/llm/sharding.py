"""Sharding by a hierarchical weighted hash tree (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import col, query, saved, table, unused

#: Hexadecimal digits of the order hash that make up a slot bucket (16^3 buckets a shard).
BUCKET_DIGITS = 3


def fleet(shards: int, racks: int = 2, per_rack: int = 5, weight: float = 1.0) -> list[tuple]:
    """(region, rack, shard, weight) rows: shards in racks of ``per_rack``, racks in regions of ``racks``."""
    return [(f"r{s // (racks * per_rack)}", f"r{s // (racks * per_rack)}k{s // per_rack % racks}", s, weight) for s in range(shards)]


def _tree(topology: Iterable[tuple]) -> dict:
    out: dict = {}
    for region, rack, shard, weight in topology:
        if weight < 0:
            raise ValueError(f"negative weight of shard {shard}")
        if weight:
            out.setdefault(region, {}).setdefault(rack, {})[int(shard)] = out.get(region, {}).get(rack, {}).get(int(shard), 0.0) + float(weight)
    if not out:
        raise ValueError("the topology has no shard of positive weight")
    return out


def _draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw of rate ``weight`` that only the key and the node decide."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(node + "|"), key)), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(2**52)) / weight


def _winner(key: Column, nodes: dict[object, float], prefix: str) -> Column:
    """The node with the smallest draw; ties go to the first name."""
    if len(nodes) == 1:
        return F.lit(next(iter(nodes)))
    draws = [F.struct(_draw(key, f"{prefix}{n}", w).alias("d"), F.lit(n).alias("n")) for n, w in sorted(nodes.items())]
    return F.array_min(F.array(*draws))["n"]


def _choice(on: Column, options: dict, value) -> Column:
    """CASE over the nodes of one level."""
    out = None
    for name, below in sorted(options.items()):
        out = F.when(on == name, value(name, below)) if out is None else out.when(on == name, value(name, below))
    return out


def assign(df: DataFrame, key: str, topology: Iterable[tuple], out: str = "shard") -> DataFrame:
    """``df`` with the shard that its ``key`` descends to in the tree of ``topology``.

    ``topology``: (region, rack, shard, weight) rows; a node weighs what its shards weigh.
    On each level the key draws ``-ln(hash)/weight`` for every child of the node it has
    reached and goes to the smallest: children get keys in proportion to their weights, and
    when weights change, keys leave or enter only the subtrees whose weights change; the
    order of keys inside an untouched subtree stays. The work per row is the sum of the
    fan-outs on one path, with no shuffle.

    Null keys share one shard, as do rows with equal keys. Empty tables stay empty. A
    column named like ``out`` is replaced; all others stay as they are.
    """
    tree = _tree(topology)
    region, rack = unused(df, "_region", "_rack")
    k = F.coalesce(col(key).cast("string"), F.lit("null"))
    weight = {r: {q: sum(shards.values()) for q, shards in racks.items()} for r, racks in tree.items()}
    racks = {q: shards for inner in tree.values() for q, shards in inner.items()}
    if len(racks) != sum(len(inner) for inner in tree.values()):
        raise ValueError("a rack lies in one region")
    df = df.withColumn(region, _winner(k, {r: sum(w.values()) for r, w in weight.items()}, "region:"))
    df = df.withColumn(rack, _choice(col(region), weight, lambda _, w: _winner(k, w, "rack:")))
    df = df.withColumn(out, _choice(col(rack), racks, lambda _, w: _winner(k, w, "shard:")).cast("int"))
    return df.drop(region, rack)


def with_slots(df: DataFrame, shard: str, order: str, out: str = "slot") -> DataFrame:
    """``df`` with gapless positions from 0 inside every shard, in the order of ``order``.

    ``order``: a column of evenly spread lower-case hexadecimal text, such as an md5. Its
    first digits cut each shard into buckets that are ranked side by side; a bucket starts
    after the rows of those before it, which are counted per shard and bucket. No task ranks
    a shard. Equal order values are numbered in any order. ``df`` is read twice.
    """
    bucket, n, start = unused(df, "_bucket", "_n", "_start")
    cut = df.withColumn(bucket, F.substring(col(order), 1, BUCKET_DIGITS))
    sizes = cut.groupBy(col(shard), col(bucket)).agg(F.count("*").alias(n))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    ranked = cut.withColumn(out, F.row_number().over(Window.partitionBy(shard, bucket).orderBy(order)).cast("long") - 1)
    return ranked.join(starts, [shard, bucket]).withColumn(out, col(out) + col(start)).drop(bucket, start)


SHARDS = 40


def _sql_draws(prefix: str, nodes: str, weight: str, key: str = "k") -> str:
    return (
        f"arg_min(n, -ln((('0x' || substr(md5('{prefix}' || n || '|' || {key}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight}) "
        f"AS {nodes}"
    )


# The digest of the rows; crc32 bit by bit over the bytes, by its reversed polynomial.
_SQL = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(cast(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (
  SELECT rid, doc_id, k, length(h) // 2 AS len, CASE WHEN length(h) = 0 THEN 0 ELSE xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INTEGER, 2))::BIGINT)),
    lambda c, x: xor(c // 256, t[(xor(c, x) % 256 + 1)::INTEGER]))) END AS crc FROM d, crc_table),
fleet AS (
  SELECT s, 'r' || (s // 10) AS r, 'r' || (s // 10) || 'k' || (s // 5 % 2) AS q FROM (SELECT unnest(range({SHARDS + 1})) AS s)),
f AS (SELECT {SHARDS} AS total, * FROM fleet WHERE s < {SHARDS} UNION ALL SELECT {SHARDS + 1}, * FROM fleet),
regions AS (SELECT total, r AS n, count(*)::DOUBLE AS w FROM f GROUP BY ALL),
racks AS (SELECT total, r, q AS n, count(*)::DOUBLE AS w FROM f GROUP BY ALL),
p1 AS (SELECT total, rid, k, {_sql_draws("region:", "r", "w")} FROM b, regions GROUP BY total, rid, k),
p2 AS (SELECT p1.total, rid, k, {_sql_draws("rack:", "q", "w")} FROM p1 JOIN racks ON racks.total = p1.total AND racks.r = p1.r GROUP BY p1.total, rid, k),
p3 AS (SELECT total, rid, {_sql_draws("shard:", "s", "1.0")} FROM (SELECT p2.total, rid, k, s AS n FROM p2 JOIN f ON f.total = p2.total AND f.q = p2.q) GROUP BY total, rid, k),
placed AS (
  SELECT b.*, a.s AS shard, g.s AS grown FROM b JOIN p3 a ON a.rid = b.rid AND a.total = {SHARDS} JOIN p3 g ON g.rid = b.rid AND g.total = {SHARDS + 1})
SELECT doc_id, (len + 16)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY md5(k || '|' || len || '|' || crc)) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM placed
"""


@query("op4_sharding", _SQL)
def op4_sharding(spark, sf):
    """All documents in 40 shards under the law ``key``, with slots and the shard after growth.

    The fleet has four regions of two racks of five shards. The added shard comes as a region
    of its own, so no existing subtree changes its weight and it takes rows only into itself.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    docs = assign(assign(docs, "doc_id", fleet(SHARDS)), "doc_id", fleet(SHARDS + 1), out="grown_shard")
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size") - 16, F.col("text_crc32")))
    placed = with_slots(saved(docs.withColumn("_order", order)), "shard", "_order")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
