"""Clusters of a vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcorpus.functions import lists as L
from voxcorpus.operators import vectors as V

SEEDS = 10
#: Vectors that are clustered on the driver (with 384 numbers each some 60 MB); more are clustered by the tasks.
SMALL = 20_000
#: Rounds of a run in the tasks, at most; before, it ends when no center moves farther than this.
ROUNDS, STILL = 20, 1e-4


def _centers(x: np.ndarray, k: int, seed: int, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Cost and centers of one run: spread first centers, then means until nothing moves."""
    rng = np.random.default_rng(seed)
    centers = x[[rng.integers(len(x))]]
    for _ in range(k - 1):
        far = np.clip(((x[:, None] - centers) ** 2).sum(2).min(1), 0, None)
        pick = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))
        centers = np.vstack([centers, x[pick]])
    mine, squares = None, (x**2).sum(1)[:, None]
    for _ in range(rounds):
        distance = squares - 2 * x @ centers.T + (centers**2).sum(1)
        new = distance.argmin(1)
        if mine is not None and (new == mine).all():
            break
        mine = new
        for c in range(k):
            if (mine == c).any():
                centers[c] = x[mine == c].mean(0)
    return float(distance[np.arange(len(x)), mine].sum()), centers


def _numbers(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a table."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _merged(rows: DataFrame, act: Callable[[np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``act`` of all vectors in one job: of each batch, merged within a task, then over the tasks."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows:
                got = act(_numbers(batch.column(0)))
                out = got if out is None else merge(out, got)
        if out is not None:
            yield pa.RecordBatch.from_pydict({"shape": [list(out.shape)], "x": [out.ravel()]}, pa.schema([("shape", pa.list_(pa.int64())), ("x", pa.list_(pa.float64()))]))

    out = None
    for r in rows.mapInArrow(one, "shape array<bigint>, x array<double>").collect():
        got = np.array(r["x"]).reshape(r["shape"])
        out = got if out is None else merge(out, got)
    return out


def _drawn(x: np.ndarray, seed: int) -> np.ndarray:
    """A waiting time for each vector, drawn by its own numbers, wherever it lies."""
    odd = np.arange(1, 2 * x.shape[1], 2, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    h = ((x + 0.0).view("uint64") * odd).sum(1, dtype="uint64") + np.uint64((seed + 1) * 0xD1B54A32D192ED03 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return -np.log(((h >> np.uint64(11)).astype("float64") + 0.5) / 2**53)


def _centers_in_tasks(rows: DataFrame, k: int, seed: int, seeds: int) -> np.ndarray:
    """Centers of the cheapest run; all runs take each pass over the vectors together. First centers are spread as in
    ``_centers``: the next one is the vector with the least waiting time over its squared distance."""
    centers = None  # run, center, number

    def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.clip((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0, None)

    for j in range(k):

        def draw(x: np.ndarray, j: int = j, centers: np.ndarray | None = centers) -> np.ndarray:
            out = []
            for i in range(seeds):
                far = np.ones(len(x)) if centers is None else squares(x, centers[i]).min(1)
                far = np.where(far > 1e-12, far, 1e-300)  # what lies on a center comes last
                wait = _drawn(x, (seed + i) * 1000 + j) / far
                first = wait.argmin()
                out.append([wait[first], *x[first]])
            return np.array(out)

        got = _merged(rows, draw, lambda a, b: np.where(a[:, :1] <= b[:, :1], a, b))[:, None, 1:]
        centers = got if centers is None else np.concatenate([centers, got], axis=1)

    def step(centers: np.ndarray) -> np.ndarray:
        """For each run and center the sum and number of its vectors, and what they cost."""

        runs, k, dim = centers.shape

        def act(x: np.ndarray) -> np.ndarray:
            out = []
            every = squares(x, centers.reshape(runs * k, dim)).reshape(len(x), runs, k)
            for i in range(runs):
                d = every[:, i]
                mine = d.argmin(1)
                whose = (mine[:, None] == np.arange(k)).astype("float64")
                out.append(np.column_stack([whose.T @ x, whose.sum(0), whose.T @ d[np.arange(len(x)), mine]]))
            return np.array(out)

        return _merged(rows, act, np.add)

    moving = np.arange(seeds)
    for _ in range(ROUNDS):
        got = step(centers[moving])
        new = np.where(got[:, :, -2:-1] > 0, got[:, :, :-2] / np.maximum(got[:, :, -2:-1], 1), centers[moving])
        far = np.sqrt(((new - centers[moving]) ** 2).sum(2)).max(1)
        centers[moving] = new
        moving = moving[far > STILL]
        if not len(moving):
            break
    return centers[step(centers)[:, :, -1].sum(1).argmin()]


def kmeans(vectors: DataFrame, k: int = L.CLUSTERS, seed: int = 42, seeds: int = SEEDS) -> DataFrame:
    """Adds ``cluster``: the nearest center of the cheapest of ``seeds`` runs; k is at most the number of rows and
    at least 1. Null vectors have a null cluster.

    Up to ``SMALL`` vectors, which is most vocabularies, the runs are made on the driver; beyond, all runs together
    are a few passes over the vectors in the tasks. Either way only the k centers are known in the end, and the
    rows get their cluster by them.
    """
    rows = V.with_unit(vectors.where(F.col("embedding").isNotNull()).select("embedding"), "embedding", "_v").select("_v")
    # read off the end, in an order of their own, so that the runs do not hang on that of the tasks
    rows = rows.select(vector_to_array("_v").alias("v"))
    some = rows.limit(SMALL + 1).toArrow()["v"].combine_chunks()
    if not len(some):
        return vectors.withColumn("cluster", F.lit(None).cast("int"))
    if len(some) <= SMALL:
        x = _numbers(some)
        x = x[np.lexsort(x.T[::-1])]
        k = max(1, min(k, len(x)))
        best = min((_centers(x, k, seed + i) for i in range(seeds)), key=lambda r: r[0])[1]
    else:
        rows = rows.persist()
        try:
            best = _centers_in_tasks(rows, k, seed, seeds)
        finally:
            rows.unpersist()
    # the nearest center of v is that of the largest v.c - |c|^2 / 2
    halves = (best**2).sum(1) / 2

    @F.pandas_udf("int")
    def nearest(given: pd.Series) -> pd.Series:
        there = given.notna().to_numpy()
        out = pd.Series([None] * len(given), dtype="Int32")
        if there.any():
            x = np.stack(given[there].to_numpy()).astype("float64")
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            out[there] = (x / np.where(norm == 0, 1.0, norm) @ best.T - halves).argmax(1)
        return out

    return vectors.withColumn("cluster", nearest(F.col("embedding").cast("array<double>")))


def ranked_members(members: DataFrame, by: list[str], top: int = L.CLUSTER_TOP) -> DataFrame:
    """The heaviest tokens of each cluster, ties by token."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("weight", 6)), "token")
    return members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def labels(members: DataFrame, by: list[str]) -> DataFrame:
    """``*by, label, top_tokens, size``: the three heaviest tokens name a cluster."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "token", "weight")))
    top = ranked_members(members, by).groupBy(*by).agg(ordered.alias("o"))
    size = members.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    return top.join(size, by).select(
        *by,
        F.array_join(F.transform(F.slice("o", 1, 3), lambda x: x["token"]), ", ").alias("label"),
        F.transform("o", lambda x: F.struct(x["token"].alias("token"), x["weight"].alias("weight"))).alias("top_tokens"),
        "size",
    )


def exemplars(members: DataFrame, by: list[str], name: str = "token") -> DataFrame:
    """``*by, centroid_token``: the member nearest to its cluster's centroid, ties by name."""
    middle = V.centroids(members, by)
    measured = V.distances(members, middle, by)
    near = V.extremes(measured, by, [name], k=1)
    return near.select(*by, F.col(name).alias("centroid_token"))


def stopword_share(members: DataFrame, by: list[str], stopwords: list[str] | None = None) -> DataFrame:
    """``*by, stop_share``: share of stopwords among the heaviest ``CLUSTER_STOP_TOP`` tokens."""
    stopwords = StopWordsRemover.loadDefaultStopWords("english") if stopwords is None else stopwords
    top = ranked_members(members, by, L.CLUSTER_STOP_TOP)
    return top.groupBy(*by).agg(F.avg(F.when(F.col("token").isin(*stopwords), 1.0).otherwise(0.0)).alias("stop_share"))


def surviving(members: DataFrame, by: list[str], stopwords: list[str] | None = None) -> DataFrame:
    """Labels of the clusters that are large enough and not mostly stopwords; they keep their numbers."""
    kept = labels(members, by).join(stopword_share(members, by, stopwords), by)
    return kept.where((F.col("size") >= L.CLUSTER_MIN_SIZE) & (F.col("stop_share") <= L.CLUSTER_STOP_SHARE))


def summary(members: DataFrame, stopwords: list[str] | None = None) -> tuple[list[dict], np.ndarray, int]:
    """What ``surviving``, ``exemplars`` and ``centroids`` say of the clusters of one corpus, as rows in order of
    their numbers; the centroids of these; and how many clusters there are. Three plain jobs over the members:
    their sums, the heaviest of each cluster, the nearest to each centroid."""
    stopwords = set(StopWordsRemover.loadDefaultStopWords("english") if stopwords is None else stopwords)
    unit = V.with_unit(members, "embedding", "_v").select("cluster", "token", "weight", vector_to_array("_v").alias("v"))
    sums = V.with_unit(members, "embedding", "_v").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), vector_to_array(Summarizer.mean(F.col("_v"))).alias("m")).collect()
    top = {}
    for r in ranked_members(members.select("cluster", "token", "weight"), ["cluster"]).orderBy("cluster", "rank").collect():
        top.setdefault(r["cluster"], []).append(r)
    rows, middles = [], []
    for r in sorted(sums, key=lambda r: r["cluster"]):
        heaviest = top[r["cluster"]]
        stops = [t["token"] in stopwords for t in heaviest[: L.CLUSTER_STOP_TOP]]
        if r["size"] >= L.CLUSTER_MIN_SIZE and sum(stops) / len(stops) <= L.CLUSTER_STOP_SHARE:
            middles.append(V.unit_mean([(1, r["m"])]))
            rows.append({"cluster": r["cluster"], "label": ", ".join(t["token"] for t in heaviest[:3]), "size": r["size"],
                         "top_tokens": [{"token": t["token"], "weight": t["weight"]} for t in heaviest]})
    if not rows:
        return [], np.zeros((0, 0)), len(sums)
    given = members.sparkSession.createDataFrame([(r["cluster"], m.tolist()) for r, m in zip(rows, middles)], "cluster int, m array<double>")
    measured = unit.join(F.broadcast(given), "cluster").select("cluster", "token", (1.0 - V.dot(F.col("v"), F.col("m"))).alias("distance"))
    near = {r["cluster"]: r["token"] for r in V.extremes(measured, ["cluster"], ["token"], k=1).collect()}
    return [r | {"centroid_token": near[r["cluster"]]} for r in rows], np.array(middles), len(sums)
