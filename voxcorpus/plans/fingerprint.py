"""The whole measurement of corpora: cadence, vocabulary, clusters, tone, exemplars."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcorpus.functions import lists as L
from voxcorpus.functions import text as T
from voxcorpus.functions.rows import join_on
from voxcorpus.operators import cadence as C
from voxcorpus.operators import clusters as K
from voxcorpus.operators import tone as N
from voxcorpus.operators import vectors as V
from voxcorpus.operators import vocabulary as W

BY = ["corpus_id"]
#: Sentences whose lengths may come to the driver one by one.
MOST_LENGTHS = 1_000_000


def sketch(docs: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row for each corpus, all of it in one plan: cadence, tone, thin flag, signature and avoided
    words, most frequent words. For any number of corpora at once; clusters and exemplars, which
    need an embedder, are in ``fingerprint``. Documents without a corpus are a corpus of their own.

    The texts are read twice: for their tokens, whose counts are kept (small against the texts) and read by
    the three lists of words, and for their sentences. All else joins by corpus.
    """
    counts = W.token_counts(docs, BY).persist()
    rates = W.brand_rates(counts, BY)
    groups = docs.groupBy(*BY).agg(F.count(F.lit(1)).alias("doc_count"))
    signature = W.signature_words(rates, baseline, BY)
    avoided = W.forbidden_candidates(rates, baseline, groups, BY)

    def packed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("rank", *columns)))
        return df.groupBy(*BY).agg(F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))

    out = C.cadence(docs, BY, groups=groups)
    for part in (
        packed(signature, "signature_words", "token", "brand_rate", "baseline_rate", "ratio", "brand_count"),
        packed(avoided, "forbidden_words", "token", "brand_rate", "baseline_rate", "ratio", "brand_count"),
        packed(W.top_vocabulary(counts, BY), "top_vocab", "token", "brand_count"),
    ):
        out = join_on(out, part, BY, "left")
    out = out.withColumn("sig_tokens", F.transform("signature_words", lambda x: x["token"]))
    return N.classify(C.target_range(C.is_thin(out)))


@dataclass
class Timings:
    """Milliseconds of each stage."""

    taken: dict[str, float]

    def of(self, name: str, act):
        began = time.perf_counter()
        out = act()
        self.taken[name] = round((time.perf_counter() - began) * 1000, 1)
        return out


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def fingerprint(
    spark: SparkSession,
    docs: DataFrame,
    baseline: DataFrame,
    brand_name: str = "Unknown",
    source: str = "",
    embedder: V.Embedder | None = None,
    exact: bool = True,
    baseline_name: str = "baseline",
    lengths: bool = True,
) -> dict:
    """Everything about one corpus, as a dict for the sinks. What comes to the driver are aggregates and
    top lists of fixed length; documents, sentences and tokens stay in the cluster.

    exact: sentences may run on over documents, as if the corpus were one text.
    lengths: the lengths of all sentences in order, up to ``MOST_LENGTHS`` of them; of more the list is None
    (the histogram and ``C.sentence_lengths``, a table, hold them all).
    """
    embedder = embedder or V.HashedNgrams()
    stamp = datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    docs = docs.select(F.lit("c").alias("corpus_id"), "doc_seq", "text").persist()
    n = docs.count()
    head = {"brand_name": brand_name, "source": source, "generated_at": stamp, "doc_count": n}
    if not n:
        docs.unpersist()
        return head | {"empty": True}
    clock = Timings({})
    # cut anew for each reader, as kept sentences would be the texts once more; not where texts run into each other
    sentences = C.split_sentences(docs, BY, exact)
    sentences = sentences.persist() if exact else sentences
    usable = T.is_usable_sentence(F.col("sentence"))

    def measure_cadence() -> tuple[dict, np.ndarray | None]:
        by_length, middle = C.lengths_and_mean(sentences, usable, embedder)
        table = spark.createDataFrame(by_length, ", ".join(["n_words int", *(f"{c} bigint" for c in C.SUMS)]))
        out = _rows(C.cadence_of_lengths(table, []))[0] if by_length else {"sentence_count": 0, "word_count": 0} | {m: 0.0 for m in C.MEASURES}
        hist = _rows(C.histogram_of_lengths(table.select("n_words", "n"), []).orderBy("bin")) if by_length else []
        if lengths and out["sentence_count"] <= MOST_LENGTHS:
            in_order = C.sentence_lengths(C.measure_sentences(sentences)).orderBy("doc_seq", "sent_seq").select("n_words").collect()
            out["sentence_lengths"] = [r["n_words"] for r in in_order]
        else:
            out["sentence_lengths"] = None
        return out | {"histogram": [{k: h[k] for k in ("bin", "lo", "hi", "n", "bar")} for h in hist]}, middle

    cadence, middle = clock.of("cadence", measure_cadence)
    stats = W.token_spread(docs).persist()
    counts = stats.select(F.lit("c").alias("corpus_id"), "token", "brand_count")

    def measure_voice() -> dict:
        near, far, vocab = [], [], []
        if middle is not None:
            some = V.extreme_texts(sentences.where(usable).select("doc_seq", "sent_seq", "sentence"), "sentence", embedder, middle).persist()
            distance, order = F.round("distance", 9), ["doc_seq", "sent_seq"]
            near, far = (
                [{"text": r["sentence"], "distance": r["distance"]} for r in _rows(some.orderBy(x, *order).limit(L.SAMPLE_SENTENCES))]
                for x in (distance.asc(), distance.desc())
            )
            some.unpersist()
            vocab = [[r["token"], r["brand_count"]] for r in _rows(counts.orderBy(F.desc("brand_count"), "token").limit(L.TOP_VOCABULARY))]
        return {
            "top_vocab": vocab, "closest_to_centroid": near, "farthest_from_centroid": far,
            "embedding_dim": embedder.dim if near else 0, "embed_model": embedder.name,
        }

    voice = clock.of("voice", measure_voice)

    def measure_clusters() -> tuple[dict, DataFrame | None]:
        weights = W.tfidf_known(docs, stats, n, W.in_cluster_vocabulary())
        vectors = V.embed(weights, "token", embedder).persist()
        members = K.kmeans(vectors).persist()
        size = members.count()
        vectors.unpersist()
        if not size:
            return {"clusters": [], "n_clusters": 0, "n_dropped": 0, "vocab_size": 0, "clustered_tokens": 0}, None
        rows, middles, found = K.summary(members)
        members.unpersist()
        clusters = [
            {"id": r["cluster"], "label": r["label"], "size": r["size"], "centroid_token": r["centroid_token"],
             "top_tokens": [[t["token"], t["weight"]] for t in r["top_tokens"]]}
            for r in rows
        ]
        return {
            "clusters": clusters, "n_clusters": len(clusters), "n_dropped": found - len(clusters), "vocab_size": size,
            "clustered_tokens": sum(c["size"] for c in clusters),
        }, spark.createDataFrame([(m,) for m in middles.tolist()], "centroid array<double>") if clusters else None

    clusters, middles = clock.of("clusters", measure_clusters)

    def measure_words() -> dict:
        rates = W.brand_rates(counts, BY)
        fields = ["token", "brand_rate", "baseline_rate", "ratio", "brand_count"]
        signature = _rows(W.signature_words(rates, baseline, BY).orderBy("rank").select(*fields))
        unique, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("brand_count"), F.lit(0))).first()
        if not total:
            return {"signature_words": [], "forbidden_words": [], "forbidden_irrelevant": [], "brand_total_tokens": 0, "stats": {"note": "empty input"}}
        pool = W.forbidden_candidates(rates, baseline, docs, BY, top=L.SEMANTIC_POOL)
        if middles is None:
            stylistic, irrelevant = _rows(pool.where(F.col("rank") <= L.TOP_FORBIDDEN).orderBy("rank").select(*fields)), []
        else:
            parted = V.semantic_partition(V.embed(pool, "token", embedder), middles)
            rows = _rows(parted.orderBy("rank").select(*fields, "min_cluster_distance", "stylistic"))
            stylistic, irrelevant = [], []
            for r in rows:
                (stylistic if r.pop("stylistic") else irrelevant).append(r)
            stylistic = stylistic[: L.TOP_FORBIDDEN]
        base = baseline.agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("t")).first()
        return {
            "signature_words": signature, "forbidden_words": stylistic, "forbidden_irrelevant": irrelevant,
            "brand_total_tokens": total,
            "stats": {"brand_unique_tokens": unique, "baseline_unique_tokens": base["n"], "baseline_total_tokens": base["t"] or 0,
                      "min_brand_count": L.MIN_BRAND_COUNT, "semantic_filter_applied": middles is not None},
        }

    vocabulary = clock.of("forbidden", measure_words)

    def measure_tone() -> dict:
        row = {k: cadence[k] for k in ["sentence_count", "word_count", *C.MEASURES]}
        row["sig_tokens"] = [w["token"] for w in vocabulary["signature_words"]]
        schema = ", ".join(["sentence_count bigint", "word_count bigint", *(f"{m} double" for m in C.MEASURES), "sig_tokens array<string>"])
        r = N.classify(spark.createDataFrame([row], schema)).first().asDict()
        return {
            "primary_tone": r["primary_tone"], "secondary_tone": r["secondary_tone"], "confidence": r["confidence"],
            "uncertain": r["uncertain"], "rationale": r["rationale"], "tone_scores": {x: r[f"score_{x}"] for x in N.LABELS},
            "signals": {s: r[s] for s in N.SIGNALS} | {"has_contractions": bool(r["has_contractions"])},
        }

    tone = clock.of("tone", measure_tone)
    stats.unpersist()
    sentences.unpersist()
    docs.unpersist()
    return head | {
        "thin_corpus": cadence["word_count"] < L.THIN_WORDS, "cadence": cadence, "voice": voice, "clusters": clusters,
        **vocabulary, "relevance_threshold": L.RELEVANCE, "baseline": baseline_name, "tone": tone, "timings_ms": clock.taken,
    }

