"""File skipping over Parquet: an index table with one row per data file, asked before the scan.

``FileIndex(spark, data, index).minmax("temp").value_list("city").bloom("vid").build()`` reads the data
once; ``skip_read(col("temp") > 30)`` evaluates the predicate on the index, reads only the files that
may hold matches, and applies the predicate again. A file that is not in the index, or changed since,
is always read; null and NaN never cause a file to be skipped. An index is asked only where it compares
as the data does: with a literal of the column's own kind. Any other condition reads every file.
"""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Predicate:
    """A condition on the data together with what it implies for a file's index row.

    ``opposite`` builds what ``~`` gives; without it the negation may match any file.
    """

    def __init__(self, data: Column, may_match, opposite: Callable[[], Predicate] | None = None):
        self.data, self.may_match, self._opposite = data, may_match, opposite

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(self.data & other.data, lambda ix: self.may_match(ix) & other.may_match(ix), lambda: ~self | ~other)

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(self.data | other.data, lambda ix: self.may_match(ix) | other.may_match(ix), lambda: ~self & ~other)

    def __invert__(self) -> Predicate:
        return self._opposite() if self._opposite else opaque(~self.data)


def opaque(condition: Column | str) -> Predicate:
    """A condition the index knows nothing about: every file may match."""
    return Predicate(F.expr(condition) if isinstance(condition, str) else condition, lambda ix: F.lit(True))


def _ordered_alike(kind: T.DataType, v) -> bool:
    """Does the column compare with this literal as its least and greatest value do?"""
    if isinstance(kind, T.StringType):
        return isinstance(v, str)
    if isinstance(v, bool) or isinstance(kind, T.BooleanType):
        return isinstance(v, bool) and isinstance(kind, T.BooleanType)
    if isinstance(kind, T.NumericType):
        return isinstance(v, (int, float, decimal.Decimal)) and not (isinstance(v, float) and math.isnan(v))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return isinstance(v, datetime.datetime)
    if isinstance(kind, T.DateType):
        return isinstance(v, datetime.date) and not isinstance(v, datetime.datetime)
    return isinstance(kind, T.BinaryType) and isinstance(v, (bytes, bytearray))


def _same_kind(kind: T.DataType, v) -> bool:
    """May the literal be turned into the column's type to be looked up?"""
    if isinstance(kind, T.IntegralType):
        return isinstance(v, int) and not isinstance(v, bool)
    if isinstance(kind, T.DecimalType):
        return isinstance(v, (int, decimal.Decimal)) and not isinstance(v, bool)
    return _ordered_alike(kind, v)


def _plain(value: Column, kind: T.DataType) -> Column:
    """One text per value, whatever the session's time zone; both zeros are one."""
    if isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0).cast(kind)
    elif isinstance(kind, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


class col:
    """Column of a skipping predicate: ``col("a") > 3``, ``col("b").isin("x", "y")``, ``col("c").isNull()``."""

    def __init__(self, name: str):
        self.name = name

    def _compare(self, data: Column, v, test, opposite) -> Predicate:
        def may(ix):
            if f"min_{self.name}" not in ix or not _ordered_alike(ix[f"_type_{self.name}"], v):
                return F.lit(True)
            return F.coalesce(test(F.col(f"min_{self.name}"), F.col(f"max_{self.name}")), F.lit(True))

        return Predicate(data, may, opposite)

    def __lt__(self, v):
        return self._compare(F.col(self.name) < F.lit(v), v, lambda lo, hi: lo < F.lit(v), lambda: self >= v)

    def __le__(self, v):
        return self._compare(F.col(self.name) <= F.lit(v), v, lambda lo, hi: lo <= F.lit(v), lambda: self > v)

    def __gt__(self, v):
        return self._compare(F.col(self.name) > F.lit(v), v, lambda lo, hi: hi > F.lit(v), lambda: self <= v)

    def __ge__(self, v):
        return self._compare(F.col(self.name) >= F.lit(v), v, lambda lo, hi: hi >= F.lit(v), lambda: self < v)

    def __eq__(self, v):
        name = self.name

        def may(ix):
            parts, kind = [F.lit(True)], ix[f"_type_{name}"]
            if f"min_{name}" in ix and _ordered_alike(kind, v):
                parts.append((F.col(f"min_{name}") <= F.lit(v)) & (F.col(f"max_{name}") >= F.lit(v)))
            if _same_kind(kind, v):
                own = F.lit(v).try_cast(kind)
                if f"values_{name}" in ix:
                    parts.append(F.array_contains(F.col(f"values_{name}"), _plain(own, kind)))
                if f"bloom_{name}" in ix:
                    for p in _positions(own, F.element_at(f"bloom_{name}", -1), F.element_at(f"bloom_{name}", -2)):
                        word = F.coalesce(F.try_element_at(F.col(f"bloom_{name}"), F.floor(p / 64).cast("int")), F.lit(0).cast("long"))
                        parts.append(p.isNull() | (F.getbit(word, (p % 64).cast("int")) == 1))
            return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(True)) for p in parts])

        return Predicate(F.col(name) == F.lit(v), may, lambda: self != v)

    def __ne__(self, v):
        def may(ix):
            if f"min_{self.name}" not in ix or not _ordered_alike(ix[f"_type_{self.name}"], v):
                return F.lit(True)
            return F.coalesce((F.col(f"min_{self.name}") != F.lit(v)) | (F.col(f"max_{self.name}") != F.lit(v)), F.lit(True))

        return Predicate(F.col(self.name) != F.lit(v), may, lambda: self == v)

    __hash__ = None

    def isin(self, *values) -> Predicate:
        each = [self == v for v in values]
        none = lambda: reduce(lambda a, b: a & b, [self != v for v in values])
        return Predicate(F.col(self.name).isin(*values), lambda ix: reduce(lambda a, b: a | b, [e.may_match(ix) for e in each], F.lit(False)), none if values else None)

    def isNull(self) -> Predicate:
        may = lambda ix: F.coalesce(F.col(f"nulls_{self.name}") > 0, F.lit(True)) if f"nulls_{self.name}" in ix else F.lit(True)
        return Predicate(F.col(self.name).isNull(), may, self.isNotNull)

    def isNotNull(self) -> Predicate:
        may = lambda ix: F.coalesce(F.col(f"nulls_{self.name}") < F.col("rows"), F.lit(True)) if f"nulls_{self.name}" in ix else F.lit(True)
        return Predicate(F.col(self.name).isNotNull(), may, self.isNull)


#: Hash functions of a bloom filter at most.
MAX_HASHES = 16


def _positions(value: Column, bits: Column, hashes: Column | int) -> list[Column]:
    """Bit numbers of a value; null beyond the filter's number of hashes."""
    n = hashes if isinstance(hashes, int) else MAX_HASHES
    place = [F.pmod(F.xxhash64(value, F.lit(seed)), bits) for seed in range(n)]
    return place if isinstance(hashes, int) else [F.when(F.lit(i) < hashes, p) for i, p in enumerate(place)]


class FileIndex:
    """Index of the Parquet files under ``data``, kept as Parquet under ``index``."""

    def __init__(self, spark: SparkSession, data: str, index: str, value_limit: int = 1_000, bloom_values: int = 100_000, false_positives: float = 0.01):
        """``value_limit``: longest value list of a file. ``bloom_values``, ``false_positives``: how many distinct
        values of a file a bloom filter is made for, and the share of absent values that then pass it."""
        self.spark, self.data, self.index = spark, data, index.rstrip("/")
        self.value_limit = value_limit
        bits = -bloom_values * math.log(false_positives) / math.log(2) ** 2
        self.bits = max(64, 64 * math.ceil(bits / 64))
        self.hashes = min(MAX_HASHES, max(1, round(self.bits / bloom_values * math.log(2))))
        self._columns: dict[str, list[str]] = {"minmax": [], "values": [], "bloom": []}
        self._stats: list[tuple] = []

    # What to index

    def minmax(self, *columns: str) -> FileIndex:
        self._columns["minmax"] += columns
        return self

    def value_list(self, *columns: str) -> FileIndex:
        """Distinct values per file; a file with more than ``value_limit`` has no list and is never skipped by it."""
        self._columns["values"] += columns
        return self

    def bloom(self, *columns: str) -> FileIndex:
        self._columns["bloom"] += columns
        return self

    # Building

    def files(self) -> DataFrame:
        """Current data files: path, size, mtime. The file contents are not read."""
        listing = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
        return listing.load(self.data).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))

    def _summaries(self, paths: list[str] | None) -> DataFrame:
        """One row per file, from one scan: every row gives one entry for the ends and one per value and bloom bit."""
        data = self.spark.read.option("basePath", self.data).parquet(*(paths or [self.data]))
        kinds = {f.name: f.dataType for f in data.schema.fields}
        entry = lambda kind, name="", word=None, mask=None, value=None: F.struct(
            F.lit(kind).alias("_kind"), F.lit(name).alias("_of"), F.lit(word).cast("int").alias("_word") if word is None else word.alias("_word"),
            F.lit(mask).cast("long").alias("_mask") if mask is None else mask.alias("_mask"), F.lit(value).cast("string").alias("_value") if value is None else value.alias("_value"),
        )
        entries = [entry("ends")]
        for c in self._columns["values"]:
            entries.append(F.when(F.col(c).isNotNull(), entry("values", c, value=_plain(F.col(c), kinds[c]))))
        for c in self._columns["bloom"]:
            for p in _positions(F.col(c), F.lit(self.bits), self.hashes):
                mask = F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))
                entries.append(F.when(F.col(c).isNotNull(), entry("bloom", c, F.floor(p / 64).cast("int"), mask)))
        ends = list(dict.fromkeys(self._columns["minmax"]))
        rows = data.select(F.col("_metadata.file_path").alias("_path"), *ends, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("_e"))
        whole = [f(F.when(F.col("_e._kind") == "ends", F.col(c))).alias(f"{n}_{c}") for c in ends for n, f in (("min", F.min), ("max", F.max))]
        nulls = [F.count_if((F.col("_e._kind") == "ends") & F.col(c).isNull()).alias(f"nulls_{c}") for c in ends]
        key = [F.col(f"_e.{k}").alias(k) for k in ("_kind", "_of", "_word", "_value")]
        found = rows.groupBy("_path", *key).agg(F.count(F.lit(1)).alias("rows"), F.bit_or("_e._mask").alias("_mask"), *whole, *nulls)
        # Words and values of a file are gathered by column first; a list beyond the limit is not gathered at all.
        counted = found.withColumn("_n", F.count("_value").over(Window.partitionBy("_path", "_kind", "_of")))
        is_kind = lambda kind, c: (F.col("_kind") == kind) & (F.col("_of") == c)
        lists = [
            F.when(F.max(F.when(is_kind("values", c), F.col("_n"))).cast("long") > self.value_limit, F.lit(None))
            .otherwise(F.sort_array(F.collect_list(F.when(is_kind("values", c) & (F.col("_n") <= self.value_limit), F.col("_value")))))
            .alias(f"values_{c}")
            for c in self._columns["values"]
        ]
        blooms = [
            F.map_concat(
                F.map_from_entries(F.collect_list(F.when(is_kind("bloom", c), F.struct("_word", "_mask")))),
                F.create_map(F.lit(-1), F.lit(self.bits).cast("long"), F.lit(-2), F.lit(self.hashes).cast("long")),
            ).alias(f"bloom_{c}")
            for c in self._columns["bloom"]
        ]
        one = [F.max(F.when(F.col("_kind") == "ends", F.col(n))).alias(n) for n in ("rows", *(f"{p}_{c}" for c in ends for p in ("min", "max", "nulls")))]
        return counted.groupBy(F.col("_path").alias("path")).agg(*one, *lists, *blooms)

    def _versions(self) -> DataFrame:
        return self.spark.read.parquet(self.index)

    def _latest(self) -> int:
        return self._versions().agg(F.max("version")).first()[0]

    def table(self) -> DataFrame:
        """The index rows of the newest version."""
        return self.spark.read.option("basePath", self.index).parquet(f"{self.index}/version={self._latest()}").drop("version")

    def is_indexed(self) -> bool:
        from pyspark.errors import AnalysisException

        try:
            return not self._versions().limit(1).isEmpty()
        except AnalysisException:
            return False

    def build(self) -> DataFrame:
        """Index all files; returns one status row per kind and column."""
        rows = self.files().join(self._summaries(None), "path")
        self._write(rows, self._latest() + 1 if self.is_indexed() else 0)
        return self.index_stats()

    def _write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.index}/version={version}")

    def refresh(self) -> DataFrame:
        """Index new and changed files, forget removed ones; returns (``indexed``, ``kept``, ``dropped``) counts."""
        now, old, key = self.files(), self.table(), ["path", "size", "mtime"]
        kept = old.join(now, key, "left_semi")
        todo = now.join(old.select(*key), key, "left_anti")
        paths = [r[0] for r in todo.select("path").collect()]
        fresh = todo.join(self._summaries(paths), "path") if paths else None
        n_old, n_kept = old.count(), kept.count()
        self._write(kept if fresh is None else kept.unionByName(fresh), self._latest() + 1)
        return self.spark.createDataFrame([(len(paths), n_kept, n_old - n_kept)], "indexed long, kept long, dropped long")

    def index_stats(self) -> DataFrame:
        """One row per kind and column: how many files carry it."""
        table = self.table()
        names = [(k, c, f"{p}_{c}") for k, p in (("minmax", "min"), ("values", "values"), ("bloom", "bloom")) for c in self._columns[k]]
        counts = F.array(*[
            F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), F.count(n).alias("files")) for k, c, n in names
        ])
        return table.agg(counts.alias("s")).select(F.inline("s"))

    def remove(self) -> None:
        """Delete the index by overwriting its versions with nothing."""
        if self.is_indexed():
            self._versions().limit(0).write.mode("overwrite").partitionBy("version").parquet(self.index)

    # Reading

    def pruned(self, predicate: Predicate) -> DataFrame:
        """Every current file with ``read``: may it hold a match?"""
        table = self.table()
        known = {c: True for c in table.columns}
        schema = self.spark.read.parquet(self.data).schema
        known.update({f"_type_{f.name}": f.dataType for f in schema.fields})
        asked = table.select("path", "size", "mtime", predicate.may_match(known).alias("read"))
        out = self.files().join(asked, ["path", "size", "mtime"], "left")
        return out.withColumn("read", F.coalesce("read", F.lit(True)))

    def skip_read(self, predicate: Predicate | Column | str) -> DataFrame:
        """``read().where(predicate)`` that opens only the files the index cannot rule out.

        A plain Column or SQL condition is applied to all files.
        """
        if not isinstance(predicate, Predicate):
            predicate = opaque(predicate)
        files = self.pruned(predicate)
        skipped = lambda c: F.sum(F.when(~F.col("read"), c).otherwise(0))
        self._stats.append(tuple(v or 0 for v in files.agg(F.count(F.lit(1)), skipped(F.lit(1)), F.sum("size"), skipped(F.col("size"))).first()))
        reader = self.spark.read.option("basePath", self.data)
        if self._stats[-1][1] == 0:
            return reader.parquet(self.data).where(predicate.data)
        # The names that are left are what Spark's reader takes; the list is as long as its own listing.
        read = [f["path"] for f in files.where("read").select("path").collect()]
        if not read:
            return reader.parquet(self.data).where(F.lit(False))
        return reader.schema(self.spark.read.parquet(self.data).schema).parquet(*read).where(predicate.data)

    def skip_stats(self) -> DataFrame:
        """Files and bytes seen and skipped since the last ``clear_stats``."""
        schema = "files_total long, files_skipped long, bytes_total long, bytes_skipped long"
        total = [tuple(sum(s[i] for s in self._stats) for i in range(4))] if self._stats else [(0, 0, 0, 0)]
        return self.spark.createDataFrame(total, schema)

    def clear_stats(self) -> None:
        self._stats.clear()


def metadata_location(spark: SparkSession, path: str | None = None, table: str | None = None, base: str | None = None) -> str:
    """Where an index lives: the table's property, else its database's property, else a base folder.

    The properties are named ``skipping.location``.
    """
    if table is not None:
        row = spark.sql(f"SHOW TBLPROPERTIES {table} ('skipping.location')").first()
        if row is not None and "does not have property" not in row[-1]:
            return row[-1]
        db = table.split(".")[0] if "." in table else spark.catalog.currentDatabase()
        for r in spark.sql(f"DESCRIBE DATABASE EXTENDED {db}").collect():
            if r[0] == "Properties" and "skipping.location" in r[1]:
                return r[1].split("(skipping.location,")[1].split(")")[0] + "/" + table.split(".")[-1]
    if base is None:
        raise ValueError("no location: give base, or set skipping.location on the table or database")
    name = (table or path).rstrip("/").replace(":", "").replace("/", "_").strip("_")
    return f"{base.rstrip('/')}/{name}"
