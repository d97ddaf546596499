"""k-Shape clustering of equally long series.

Centroids (k arrays) are the only thing the driver holds. The series are read once and kept. Each round
every series goes to its closest centroid by shape-based distance and is shifted onto it; the leading
eigenvector of a cluster's product sums is the next centroid. Short series add their products up in one
pass; for long ones no product matrix is built, but the eigenvector is approached by passes that
multiply the aligned series with a few vectors (Lanczos).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..handle import TS
from ..plans import saved
from .reducers import _ddl

#: Length up to which a task sums the products of series as a matrix (at most 2 MiB a cluster).
DENSE_LENGTH = 512
#: Passes that approach an eigenvector of longer series.
LANCZOS_PASSES = 24
MAX_CENTROID_BYTES = 64 << 20


def packed(ts: TS) -> DataFrame:
    """(keys, values): one ordered array per series; every series must have the same length."""
    if not ts.bounded():
        raise ValueError("k-Shape needs series of at most chunk_rows values")
    obs = F.array_sort(F.collect_list(F.struct(*ts.by, *([] if "value" in ts.by else ["value"]))))
    out = ts.df.groupBy(*ts.keys).agg(obs.alias("o"))
    return out.select(*ts.keys, F.transform("o", lambda s: s["value"].cast("double")).alias("values"))


def _znorm(x: np.ndarray) -> np.ndarray:
    sd = x.std(axis=-1, keepdims=True)
    return (x - x.mean(axis=-1, keepdims=True)) / np.where(sd == 0, 1.0, sd)


def _distances(x: np.ndarray, centroids: np.ndarray):
    """Shape-based distances (n, k) and the best shift of each centroid onto each series."""
    m = x.shape[1]
    n_fft = 1 << (2 * m - 1).bit_length()
    fx = np.fft.rfft(x, n_fft)
    dist, shift = np.empty((len(x), len(centroids))), np.empty((len(x), len(centroids)), int)
    norm = np.linalg.norm(x, axis=1)
    for j, c in enumerate(centroids):
        cc = np.fft.irfft(fx * np.conj(np.fft.rfft(c, n_fft)), n_fft)
        cc = np.concatenate([cc[:, -(m - 1) :], cc[:, :m]], axis=1)  # shifts -(m-1) .. m-1
        best = cc.argmax(axis=1)
        size = norm * np.linalg.norm(c)
        top = np.take_along_axis(cc, best[:, None], 1)[:, 0]
        dist[:, j] = 1 - np.divide(top, size, out=np.zeros_like(top), where=size > 0)
        shift[:, j] = best - (m - 1)
    return dist, shift


def _aligned(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Each row moved by -shift, zeros filled in."""
    out = np.zeros_like(x)
    m = x.shape[1]
    for i, s in enumerate(shift):
        if s >= 0:
            out[i, : m - s] = x[i, s:]
        else:
            out[i, -s:] = x[i, : m + s]
    return out


@dataclass
class KShapeModel:
    """``centroids``: (k, m) array; the other facts are read from a pass over the training series."""

    keys: list[str]
    centroids: np.ndarray
    sum_squares: float = float("nan")
    intra_cluster_distances: dict = field(default_factory=dict)
    silhouette_coefficients: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)

    @property
    def inter_cluster_distances(self) -> np.ndarray:
        return _distances(self.centroids, self.centroids)[0]

    def score(self, series: DataFrame, with_silhouette: bool = False) -> DataFrame:
        """(keys, cluster, distance[, silhouette]); the silhouette compares the closest two centroids."""
        cents, keys = self.centroids, self.keys

        def work(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _znorm(np.array(pdf["values"].tolist(), float))
                d, _ = _distances(x, cents)
                out = pdf[keys].copy()
                out["cluster"], out["distance"] = d.argmin(axis=1).astype("int32"), d.min(axis=1)
                if with_silhouette:
                    two = np.sort(d, axis=1)[:, :2] if d.shape[1] > 1 else np.column_stack([d, d])
                    top = np.maximum(two[:, 1], 1e-300)
                    out["silhouette"] = (two[:, 1] - two[:, 0]) / top
                yield out

        extra = ", silhouette double" if with_silhouette else ""
        return series.mapInPandas(work, f"{_ddl(series, keys)}, cluster int, distance double{extra}")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, [float(v) for v in c], self.intra_cluster_distances.get(i), self.silhouette_coefficients.get(i), self.sizes.get(i, 0), self.sum_squares)
            for i, c in enumerate(self.centroids)
        ]
        return spark.createDataFrame(
            rows, "cluster int, centroid array<double>, intra_cluster_distance double, silhouette_coefficient double, size long, sum_squares double"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, keys) -> KShapeModel:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["cluster"])
    return KShapeModel(
        list(keys), np.array([r["centroid"] for r in rows]), rows[0]["sum_squares"],
        {r["cluster"]: r["intra_cluster_distance"] for r in rows}, {r["cluster"]: r["silhouette_coefficient"] for r in rows},
        {r["cluster"]: r["size"] for r in rows},
    )


def _update(series: DataFrame, keys, cents: np.ndarray, use_eigen: bool, first_seed: int | None) -> np.ndarray:
    """One round: assign, align, and extract the new centroids. ``first_seed``: assign by hash instead."""
    k, m = cents.shape
    if use_eigen and m > DENSE_LENGTH:
        return _update_long(series, keys, cents, first_seed)
    width = m * m if use_eigen else m

    def partial(batches):
        sums, counts = np.zeros((k, width)), np.zeros(k, int)
        lead = np.zeros((k, m))
        for pdf in batches:
            if not len(pdf):
                continue
            x = _znorm(np.array(pdf["values"].tolist(), float))
            if first_seed is None:
                d, shift = _distances(x, cents)
                own = d.argmin(axis=1)
                y = _aligned(x, shift[np.arange(len(x)), own])
            else:
                own, y = pdf["_own"].to_numpy(), x
            y = _znorm(y)
            for j in range(k):
                part = y[own == j]
                if len(part):
                    sums[j] += (part.T @ part).ravel() if use_eigen else part.sum(axis=0)
                    lead[j] += part.sum(axis=0)
                    counts[j] += len(part)
        for j in range(k):
            if counts[j]:
                yield pd.DataFrame({"cluster": [j], "s": [sums[j].tolist()], "lead": [lead[j].tolist()], "n": [int(counts[j])]})

    def total(batches):
        s, lead, n = np.zeros(width), np.zeros(m), 0
        cluster = None
        for pdf in batches:
            for c, a, b, k_ in zip(pdf["cluster"], pdf["s"], pdf["lead"], pdf["n"]):
                cluster, s, lead, n = c, s + np.asarray(a), lead + np.asarray(b), n + int(k_)
        return cluster, s, lead, n

    # Partials stream through these, so a merge holds one sum, however many partials there are.
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cluster, s, lead, n = total(batches)
        yield pd.DataFrame({"cluster": [cluster], "s": [s.tolist()], "lead": [lead.tolist()], "n": [n]})

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cluster, s, lead, n = total(batches)
        if use_eigen:
            q = np.eye(m) - 1.0 / m
            _, vectors = np.linalg.eigh(q @ s.reshape(m, m) @ q)
            c = vectors[:, -1]
            c = -c if c @ lead < 0 else c
        else:
            c = s / n
        yield pd.DataFrame({"cluster": [cluster], "s": [_znorm(c).tolist()], "lead": [[]], "n": [n]})

    if first_seed is not None:
        series = series.withColumn("_own", F.pmod(F.xxhash64(F.lit(first_seed), *keys), F.lit(k)).cast("int"))
    schema = "cluster int, s array<double>, lead array<double>, n long"
    parts = series.mapInPandas(partial, schema)
    # Partials of one cluster are merged in two steps, so no task adds up those of the whole cluster.
    some = parts.groupBy("cluster", F.pmod(F.xxhash64("n", F.col("lead")[0]), F.lit(16)).alias("_s")).applyInPandas(merge, schema)
    new = some.groupBy("cluster").applyInPandas(extract, schema).collect()
    out = cents.copy()
    for r in new:
        out[r["cluster"]] = r["s"]
    return out


def _merged(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (cluster, s) rows by cluster, in two steps, so no task adds up all partials of one."""
    schema = "cluster int, s array<double>"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, cluster = 0.0, None
        for pdf in batches:
            for c, s in zip(pdf["cluster"], pdf["s"]):
                cluster, total = c, total + np.asarray(s)
        yield pd.DataFrame({"cluster": [cluster], "s": [total.tolist()]})

    some = parts.groupBy("cluster", F.pmod(F.xxhash64(F.col("s")[0], F.col("s")[1]), F.lit(16)).alias("_s")).applyInPandas(add, schema)
    return {r["cluster"]: np.array(r["s"]) for r in some.groupBy("cluster").applyInPandas(add, schema).collect()}


def _update_long(series: DataFrame, keys, cents: np.ndarray, first_seed: int | None) -> np.ndarray:
    """``_update`` without product matrices: series are aligned once, then multiplied with a vector a pass."""
    k, m = cents.shape
    if first_seed is not None:
        series = series.withColumn("_own", F.pmod(F.xxhash64(F.lit(first_seed), *keys), F.lit(k)).cast("int"))

    def align(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _znorm(np.array(pdf["values"].tolist(), float))
            if first_seed is None:
                d, shift = _distances(x, cents)
                own = d.argmin(axis=1)
                x = _aligned(x, shift[np.arange(len(x)), own])
            else:
                own = pdf["_own"].to_numpy()
            yield pd.DataFrame({"cluster": own.astype("int32"), "y": _znorm(x).tolist()})

    aligned = saved(series.mapInPandas(align, "cluster int, y array<double>"))

    def times(vectors: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
        """Per cluster the sum of y (y . v); of y, where there is no v yet."""

        def partial(batches):
            sums: dict[int, np.ndarray] = {}
            for pdf in batches:
                y, own = np.array(pdf["y"].tolist(), float).reshape(len(pdf), m), pdf["cluster"].to_numpy()
                for c in np.unique(own).tolist():
                    part = y[own == c]
                    if vectors is None or c in vectors:
                        sums[c] = sums.get(c, 0.0) + (part.sum(axis=0) if vectors is None else part.T @ (part @ vectors[c]))
            if sums:
                yield pd.DataFrame({"cluster": np.array(list(sums), "int32"), "s": [s.tolist() for s in sums.values()]})

        return _merged(aligned.mapInPandas(partial, "cluster int, s array<double>"))

    lead = times(None)
    rng = np.random.default_rng(0)
    basis, alphas, betas, now = {}, {}, {}, {}
    for c, v in lead.items():
        v = v - v.mean()
        v = v if np.linalg.norm(v) > 1e-9 * m else rng.normal(size=m)
        basis[c], alphas[c], betas[c], now[c] = [v / np.linalg.norm(v)], [], [], True
    for _ in range(min(LANCZOS_PASSES, m)):
        asked = {c: basis[c][-1] for c in basis if now[c]}
        if not asked:
            break
        for c, w in times(asked).items():
            w = w - w.mean()
            alphas[c].append(float(w @ basis[c][-1]))
            for _ in range(2):  # against all vectors so far, as rounding spoils the short recurrence
                for b in basis[c]:
                    w = w - (w @ b) * b
            beta = float(np.linalg.norm(w))
            if beta < 1e-8 * max(1.0, abs(alphas[c][0])):
                now[c] = False
            else:
                betas[c].append(beta)
                basis[c].append(w / beta)
    out = cents.copy()
    for c, a in alphas.items():
        t = np.diag(a) + np.diag(betas[c][: len(a) - 1], 1) + np.diag(betas[c][: len(a) - 1], -1)
        top = np.linalg.eigh(t)[1][:, -1]
        v = np.array(basis[c][: len(a)]).T @ top
        out[c] = _znorm(-v if v @ lead[c] < 0 else v)
    return out


def _spread_start(series: DataFrame, keys, k: int, seed: int) -> np.ndarray:
    """Start centroids drawn one by one with probability proportional to the squared distance to those drawn."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    draw = lambda df, weight: df.select("values", (-F.ln(u) / weight).alias("_k")).agg(F.min_by("values", "_k")).first()[0]
    cents = [_znorm(np.array(draw(series, F.lit(1.0))))]
    while len(cents) < k:
        model = KShapeModel(list(keys), np.array(cents))
        scored = model.score(series.select(*keys, "values")).select(*keys, "distance")
        near = series.join(scored, list(keys)).where("distance > 1e-9")
        row = draw(near, F.col("distance") * F.col("distance"))
        if row is None:
            break
        cents.append(_znorm(np.array(row)))
    return np.array(cents)


def fit(ts, k_clusters, num_runs: int = 1, use_eigen: bool = True, init_strategy: str = "plusplus", max_iterations: int = 20, seed: int = 0, keys=None) -> KShapeModel:
    """Best of ``num_runs`` runs by the sum of squared distances; a pair [lo, hi] of k tries every k between.

    ``ts``: series of equal length, or a table (keys, values array) with ``keys`` named.
    """
    series = packed(ts) if isinstance(ts, TS) else ts
    keys = list(ts.keys if isinstance(ts, TS) else keys)
    series = saved(series.select(*keys, F.col("values").cast("array<double>").alias("values")))
    lengths = series.agg(F.min(F.size("values")), F.max(F.size("values"))).first()
    if lengths[0] != lengths[1]:
        raise ValueError("k-Shape needs series of one length")
    m = lengths[0]
    ks = [k_clusters] if isinstance(k_clusters, int) else range(k_clusters[0], k_clusters[1] + 1)
    if max(ks) * m * 8 > MAX_CENTROID_BYTES:
        raise ValueError("the centroids are too large to send to every task")
    best = None
    for k in ks:
        for run in range(num_runs):
            start = seed * 1_000 + run
            if init_strategy == "plusplus":
                cents, hashed = _spread_start(series, keys, k, start), None
            else:
                cents, hashed = np.zeros((k, m)), (start if init_strategy == "random" else 0)
            for _ in range(max_iterations):
                new = _update(series, keys, cents, use_eigen, hashed)
                hashed = None
                moved = np.abs(new - cents).max()
                cents = new
                if moved < 1e-6:
                    break
            model = _summarise(KShapeModel(keys, cents), series)
            if best is None or model.sum_squares < best.sum_squares:
                best = model
    return best


def _summarise(model: KShapeModel, series: DataFrame) -> KShapeModel:
    facts = model.score(series, True).groupBy("cluster").agg(
        F.sum(F.col("distance") ** 2).alias("ss"), F.avg("distance").alias("d"), F.avg("silhouette").alias("s"), F.count(F.lit(1)).alias("n")
    ).collect()
    model.sum_squares = float(sum(r["ss"] for r in facts))
    model.intra_cluster_distances = {r["cluster"]: r["d"] for r in facts}
    model.silhouette_coefficients = {r["cluster"]: r["s"] for r in facts}
    model.sizes = {r["cluster"]: r["n"] for r in facts}
    return model


def explore(ts, num_runs: int, max_k: int, min_k: int = 2, **arguments) -> list[KShapeModel]:
    """The best model of every k."""
    keys = list(ts.keys if isinstance(ts, TS) else arguments.pop("keys"))
    series = saved((packed(ts) if isinstance(ts, TS) else ts).select(*keys, "values"))
    return [fit(series, k, num_runs, keys=keys, **arguments) for k in range(min_k, max_k + 1)]
