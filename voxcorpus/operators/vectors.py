"""Vectors: centroids, distances, extremes, and where embeddings come from."""

from __future__ import annotations

from collections.abc import Iterator
import re
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcorpus.functions import lists as L
from voxcorpus.functions import text as T
from voxcorpus.functions.rows import beside, join_on


class Embedder(Protocol):
    """Gives texts unit vectors, inside a task."""

    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedNgrams:
    """Signed counts of hashed character three- to five-grams. No semantics, but similar spellings are near
    and it needs no model; the default where no other embedder is given. Whole batches at once, as arrays."""

    name = "hashed-ngrams"
    #: Texts whose arrays are worked on together; of as many sentences they stay in the processor's cache.
    TOGETHER = 500

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        parts = [self._encode(texts[i : i + self.TOGETHER]) for i in range(0, len(texts), self.TOGETHER)]
        return np.concatenate(parts) if parts else np.zeros((0, self.dim))

    def _encode(self, texts: list[str]) -> np.ndarray:
        padded = [f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
        codes = np.frombuffer(b"".join(padded), "uint32").astype("uint64")
        owner = np.repeat(np.arange(len(texts)), [len(p) // 4 for p in padded])
        out = np.zeros(len(texts) * self.dim)
        begins = owner * self.dim
        for n in (3, 4, 5):
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, "uint64")
            for k in range(n):
                h ^= codes[k : len(codes) - n + 1 + k]
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = owner[: len(h)] == owner[n - 1 :]  # not over the border of two texts
            rest = h & np.uint64(self.dim - 1) if self.dim & (self.dim - 1) == 0 else h % np.uint64(self.dim)
            place = begins[: len(h)] + rest.view("int64")
            sign = ((h >> np.uint64(63)).view("int64") * 2.0 - 1.0) * inside
            out += np.bincount(place, sign, len(out))
        out = out.reshape(len(texts), self.dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1.0, norm)


class LearnedWords:
    """Vectors of words that occur in the same documents are near each other; a text is the mean of its words'.
    Made by ``learn_words``; words it does not know are left out, a text without any known word is spelled."""

    def __init__(self, words: dict[str, int], table: np.ndarray) -> None:
        self.name = f"learned-words-{len(words)}"
        self.words, self.table, self.dim = words, table, table.shape[1]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        find = re.compile(L.WORD).findall
        for i, t in enumerate(texts):
            known = [k for w in find((t or "").lower()) if (k := self.words.get(w)) is not None]
            if known:
                out[i] = self.table[known].sum(0)
        norm = np.linalg.norm(out, axis=1)
        if (norm == 0).any():
            none = np.nonzero(norm == 0)[0]
            out[none] = HashedNgrams(self.dim).encode([texts[i] for i in none])
            norm[none] = np.linalg.norm(out[none], axis=1)
        return out / np.where(norm == 0, 1.0, norm)[:, None]


def learn_words(docs: DataFrame, dim: int = 64, most: int = L.BASELINE_TOP) -> LearnedWords:
    """Random indexing over all documents: a document is a sparse random vector (by the hash of its text), a word
    the sum of the vectors of its documents, rarer documents' words less shared. The ``most`` commonest words
    are kept: ``most`` x ``dim`` numbers on the driver and in each task, whatever the corpus."""
    rows = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), F.array_distinct(T.words(F.col("text"))).alias("ws"))
    seen = rows.select("h", F.explode("ws").alias("token")).where(T.is_content(F.col("token")))
    # four places of a document's vector are one or minus one; sums are made in the tasks first
    draw = [F.xxhash64("h", F.lit(k)) for k in range(4)]
    places = F.explode(F.array(*[F.struct(F.pmod(x, F.lit(dim)).cast("int").alias("pos"), F.when(x > 0, 1).otherwise(-1).alias("v")) for x in draw]))
    cells = seen.select("token", places.alias("c")).groupBy("token", "c.pos").agg(F.sum("c.v").alias("v"), F.count(F.lit(1)).alias("n"))
    common = cells.groupBy("token").agg(F.collect_list(F.struct("pos", "v")).alias("cs"), F.sum("n").alias("n")).where(F.col("n") >= 8)
    top = common.orderBy(F.desc("n"), "token").limit(most).collect()
    table = np.zeros((len(top), dim))
    for i, r in enumerate(top):
        for c in r["cs"]:
            table[i, c["pos"]] = c["v"]
    table -= table.mean(0) if len(top) else 0  # what all words share says nothing
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return LearnedWords({r["token"]: i for i, r in enumerate(top)}, table / np.where(norm == 0, 1.0, norm))


class SentenceModel:
    """A sentence-transformers model, where that package and the model are installed on the workers."""

    def __init__(self, model: str = "all-MiniLM-L6-v2", dim: int = 384) -> None:
        self.name, self.dim, self._model = model, dim, None

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    def encode(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.name)
        return np.asarray(self._model.encode(texts, normalize_embeddings=True), "float64")


def embed(df: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """Adds ``embedding``: Arrow batches through the embedder."""

    @F.pandas_udf("array<double>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(embedder.encode(part.fillna("").tolist())))

    return df.withColumn("embedding", encode(F.col(text)))


def encoded(texts: pa.Array, embedder: Embedder) -> np.ndarray:
    """Vectors of length one, a row each (a zero vector stays); texts that come again are embedded once."""
    coded = pc.fill_null(texts, "").dictionary_encode()
    x = np.asarray(embedder.encode(coded.dictionary.to_pylist()), "float64").reshape(len(coded.dictionary), embedder.dim)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm == 0, 1.0, norm))[coded.indices.to_numpy()]


def unit_mean(sums: list[tuple[int, list[float]]]) -> np.ndarray | None:
    """Mean of vectors of which there are partial counts and sums, of length one; None without any vector."""
    n = sum(k for k, _ in sums)
    if not n:
        return None
    mean = np.sum([s for _, s in sums], axis=0) / n
    return mean / (np.linalg.norm(mean) + 1e-12)


def extreme_texts(df: DataFrame, text: str, embedder: Embedder, middle: np.ndarray, k: int = L.SAMPLE_SENTENCES) -> DataFrame:
    """``distance`` added, and of each Arrow batch only the rows that can be among the k nearest or farthest of all:
    those no farther than its kth nearest, no nearer than its kth farthest, and what rounding may make equal to
    these. Vectors are made anew from the texts, and none leaves its task."""
    schema = df.select("*", F.lit(0.0).alias("distance")).schema
    at, slack = df.columns.index(text), 2e-9

    def near_or_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = 1.0 - encoded(batch.column(at), embedder) @ middle
                ordered = np.sort(d)
                low, high = ordered[min(k, len(d)) - 1] + slack, ordered[-min(k, len(d))] - slack
                kept = pa.array(np.nonzero((d <= low) | (d >= high))[0])
                yield pa.RecordBatch.from_arrays([*batch.take(kept).columns, pa.array(d).take(kept)], names=schema.names)

    return df.mapInArrow(near_or_far, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_unit(vectors: DataFrame, vector: str, name: str) -> DataFrame:
    """Adds ``name``: the vector as an ML vector of length one; a zero vector stays. One pass over its numbers (an
    array expression would take the norm anew for each of them)."""
    rows = vectors.withColumn(f"_raw_{name}", array_to_vector(F.col(vector).cast("array<double>")))
    return Normalizer(p=2.0, inputCol=f"_raw_{name}", outputCol=name).transform(rows).drop(f"_raw_{name}")


def cosine(v: Column, unit_vector: Column) -> Column:
    """Cosine of any vector and one of length one; 0 for a zero vector."""
    d = v.cast("array<double>")
    norm = F.sqrt(dot(d, d))
    return F.when(norm > 0, dot(d, unit_vector) / norm).otherwise(0.0)


def centroids(vectors: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """``*by, centroid``: mean of the unit vectors, of length one. Null vectors are left out.

    Each task sums its own vectors as a whole before anything is shuffled: one row a group and task.
    """
    rows = with_unit(vectors.where(F.col(vector).isNotNull()).select(*by, vector), vector, "v")
    mean = F.col("m")
    out = rows.groupBy(*by).agg(Summarizer.mean(F.col("v")).alias("s")).where(F.col("s").isNotNull()).select(*by, vector_to_array("s").alias("m"))
    norm = F.sqrt(dot(mean, mean)) + 1e-12
    return out.select(*by, F.transform("m", lambda x: x / norm).alias("centroid"))


def distances(vectors: DataFrame, middle: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Adds ``distance``, 1 less the cosine to the group's centroid."""
    joined = join_on(vectors, middle, by) if by else beside(vectors, middle)
    return joined.withColumn("distance", 1.0 - cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def extremes(measured: DataFrame, by: list[str], order: list[str], k: int = L.SAMPLE_SENTENCES, nearest: bool = True) -> DataFrame:
    """The k nearest or farthest rows of each group, ties by ``order``; ``rank`` from 1."""
    rounded = F.round("distance", 9)
    w = Window.partitionBy(*by).orderBy(rounded.asc() if nearest else rounded.desc(), *order)
    return measured.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_centroid(vectors: DataFrame, middles: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``min_cluster_distance`` to the nearest of a few centroids (``CLUSTERS`` at most for each
    corpus); the centroids travel as one row."""
    packed = middles.agg(F.collect_list("centroid").alias("cs"))
    d = F.col(vector).cast("array<double>")
    norm = F.sqrt(dot(d, d))
    best = F.array_max(F.transform("cs", lambda c: dot(d, c)))
    nearest = F.when(norm > 0, best / norm).otherwise(0.0)
    return beside(vectors, packed).withColumn("min_cluster_distance", 1.0 - nearest).drop("cs")


def semantic_partition(candidates: DataFrame, middles: DataFrame, threshold: float = L.RELEVANCE) -> DataFrame:
    """Candidates with ``stylistic``: near enough to a cluster to be a matter of style, else of topic."""
    return nearest_centroid(candidates, middles).withColumn("stylistic", F.col("min_cluster_distance") <= threshold)
