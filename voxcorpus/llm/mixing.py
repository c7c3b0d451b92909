"""Mixing sources to target shares of tokens.

Method: soft-membership mixing. A document's membership in the target domains is a
probability vector: certain where its source is known, else the posterior of a naive
Bayes classifier that was fitted on labelled rows. Nonnegative document rates (expected
copies, at most the domain's ``max_repeats``) are fitted so that the expected token
totals of the domains meet ``target_share`` of the whole: least squares by projected
gradient, first over the labelled documents alone, then over all of them, so that
unlabelled ones fill only what labelled ones leave open.

Documents with equal memberships have equal rates. The labelled ones are thus one group a
source: one row with their tokens. The rate of an unlabelled document is the projection
``clip(-p . total, 0, p . caps)`` of one running sum of steps (one number a domain), so a
pass needs no earlier pass, moves one number a domain to the driver, and stores no rates.
A step divides a domain's residual by its tokens; in that scale the quadratic form has no
eigenvalue over 1, so that full steps converge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxcorpus.llm.common import join_on

#: Labelled rows the classifier is fitted on, in expectation at most; rows are taken by the hash of their id.
TRAIN_ROWS = 50_000
#: Hash buckets of the classifier's words, and numbers its model may have over all domains.
BUCKETS = 1 << 13
MODEL_NUMBERS = 1 << 23
#: The passes end when the totals move by no more than this part of all tokens; ``converged`` tells whether they did.
TOLERANCE = 1e-4
STEPS = 60
OTHER = "\x00other"


def clean_source(source: Column) -> Column:
    """Sources that differ only in letter case or blanks around them are one."""
    return F.lower(F.trim(F.regexp_replace(source, r"[\s ]+", " ")))


def read_targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """Targets on the driver, one row each of the table's sources; repeated sources add their shares."""
    rows = (
        targets.where(F.col("source").isNotNull())
        .groupBy(clean_source(F.col("source")).alias("s"))
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))), F.max(F.coalesce("max_repeats", F.lit(0))))
        .collect()
    )
    return sorted((r[0], float(r[1]), int(r[2])) for r in rows)


def _buckets(text: str | None, size: int) -> list[int]:
    return [zlib.crc32(w.encode()) % size for w in re.findall(r"\w+", (text or "").lower())]


def fit_classifier(documents: DataFrame, domains: list[str], train_rows: int = TRAIN_ROWS, n: int | None = None) -> np.ndarray:
    """Log weights (domains, buckets + 1), the last column being the log prior. n: rows, if known."""
    number = {s: i for i, s in enumerate(domains)}
    size = max(64, min(BUCKETS, MODEL_NUMBERS // max(1, len(domains))))
    n = documents.count() if n is None else n
    k = max(1, -(-n // train_rows))
    rows = documents.where(F.col("domain").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(k)) == 0))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for domain, text in zip(*(c.to_pylist() for c in batch.columns)):
                at = total.setdefault(number[domain], np.zeros(size + 1))
                at[:size] += np.bincount(_buckets(text, size), minlength=size)[:size] if text else 0
                at[size] += 1
        for d, row in total.items():
            b = np.nonzero(row)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(b), d, "int32")), pa.array(b.astype("int32")), pa.array(row[b])], names=["d", "b", "n"]
            )

    summed = (
        rows.select("domain", "text")
        .mapInArrow(counts, "d int, b int, n double")
        .groupBy("d", "b")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    total = np.zeros((len(domains), size + 1))
    total[summed["d"].to_numpy(), summed["b"].to_numpy()] = summed["n"].to_numpy()
    words, docs = total[:, :size], total[:, size]
    log = np.log(words + 0.1) - np.log(words.sum(1, keepdims=True) + 0.1 * size)
    prior = np.log(docs + 0.5) - np.log(docs.sum() + 0.5 * len(domains))
    return np.hstack([log, prior[:, None]]).astype("float32")


def posterior(model: np.ndarray, text: str | None) -> np.ndarray:
    """Probabilities of the domains; an empty or null text has the prior."""
    size = model.shape[1] - 1
    b = _buckets(text, size)
    score = model[:, size].astype("float64")
    if b:
        score = score + model[:, b].sum(1, dtype="float64")
    score = np.exp(score - score.max())
    return score / score.sum()


def labelled(documents: DataFrame, targets: list[tuple[str, float, int]]) -> DataFrame:
    """``doc_id, text, n, domain``: domain is the source where it has a target, OTHER where not, null
    where the source is null or empty. n: tokens, null as 0."""
    s = clean_source(F.col("source"))
    s = F.when(s == "", None).otherwise(s)
    if targets:
        want = documents.sparkSession.createDataFrame([(t, True) for t, _, _ in targets], "_s string, _known boolean")
        documents = documents.withColumn("_s", s).join(F.broadcast(want), "_s", "left")  # as many rows as targets
    else:
        documents = documents.withColumn("_s", s).withColumn("_known", F.lit(None).cast("boolean"))
    return documents.select(
        "doc_id",
        "text",
        F.coalesce(F.col("n_tokens"), F.lit(0)).cast("double").alias("n"),
        F.when(F.col("_s").isNull(), None).when(F.col("_known"), F.col("_s")).otherwise(OTHER).alias("domain"),
    )


def memberships(unlabelled: DataFrame, model: np.ndarray) -> DataFrame:
    """``doc_id, n, idx, p``: the domains' probabilities, those aside that vanish beside the largest (under
    half a unit of its last place)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, p = [], []
            for text in batch.column(2).to_pylist():
                q = posterior(model, text)
                at = np.nonzero(q > q.max() * 2.0**-53)[0]
                idx.append(at.astype("int32"))
                p.append(q[at] / q[at].sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(idx, pa.list_(pa.int32())), pa.array(p, pa.list_(pa.float64()))],
                names=["doc_id", "n", "idx", "p"],
            )

    return unlabelled.select("doc_id", "n", "text").mapInArrow(predict, "doc_id bigint, n double, idx array<int>, p array<double>")


def _projected(idx: pa.Array, p: pa.Array, caps: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rates of documents, and their memberships flat: (rate, row, domain, probability)."""
    sizes = np.diff(idx.offsets.to_numpy())
    flat, prob = idx.flatten().to_numpy(), p.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    dot = lambda v: np.bincount(row, prob * v[flat], len(sizes))
    return np.clip(-dot(total), 0.0, dot(caps)), row, flat, prob


@dataclass
class Fit:
    """What the projected gradient found: rates of the labelled groups after the first stage (``sure``) and
    in the end, the running sum of the steps, expected tokens by domain, and how it ended."""

    caps: np.ndarray
    want: np.ndarray
    own: np.ndarray
    sure: np.ndarray
    rate: np.ndarray
    total: np.ndarray
    mass: np.ndarray
    mixed: np.ndarray
    tokens: float
    steps: int
    converged: bool


def fit_rates(own: np.ndarray, tokens: float, members: DataFrame, targets: list[tuple[str, float, int]], steps: int = STEPS) -> Fit:
    """Fits the rates. own: tokens of the labelled group of each domain, OTHER last; tokens: of all rows."""
    caps = np.array([float(m) for _, _, m in targets] + [0.0])
    want = np.array([t for _, t, _ in targets] + [0.0]) * tokens
    size = len(caps)

    def expected(total: np.ndarray) -> np.ndarray:
        """Mixed tokens and tokens of the unlabelled documents by domain."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, size))
            for batch in batches:
                n = batch.column(0).to_numpy(zero_copy_only=False)
                rate, row, flat, prob = _projected(batch.column(1), batch.column(2), caps, total)
                out[0] += np.bincount(flat, prob * (n * rate)[row], size)
                out[1] += np.bincount(flat, prob * n[row], size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size, dtype="int32")), pa.array(out[0]), pa.array(out[1])], names=["d", "y", "n"]
            )

        got = (
            members.select("n", "idx", "p")
            .mapInArrow(run, "d int, y double, n double")
            .groupBy("d")
            .agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
            .toArrow()
        )
        y = np.zeros((2, size))
        y[:, got["d"].to_numpy()] = got["y"].to_numpy(), got["n"].to_numpy()
        return y

    # First stage: labelled groups have one domain each, so a full step is the solution.
    has = own > 0
    start = np.minimum(1.0, caps)
    sure = np.clip(start - np.where(has, (own * start - want) / np.where(has, own, 1.0), 0.0), 0.0, caps)
    total = np.zeros(size)
    y, n = expected(total)
    mass = own + n
    full = np.maximum(mass, 1e-9)
    rate, mixed = sure, own * sure + y
    taken, converged = 0, False
    for taken in range(1, steps + 1):
        total = total + np.where(mass > 0, (mixed - want) / full, 0.0)
        rate = np.clip(sure - total, 0.0, caps)
        y, _ = expected(total)
        before, mixed = mixed, own * rate + y
        if np.abs(mixed - before).sum() <= TOLERANCE * max(tokens, 1.0):
            converged = True
            break
    return Fit(caps, want, own, sure, rate, total, mass, mixed, tokens, taken, converged)


def mix(documents: DataFrame, targets: DataFrame, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """Rates of all documents, and the report by source.

    rates: ``doc_id, domain, n_tokens, rate``, each document once.
    report: ``source, target_share, max_repeats, tokens, expected_tokens, mixed_tokens,
    actual_share, reachable, steps, converged``. tokens: of the documents that carry the source;
    expected_tokens: with the memberships of unlabelled ones. A source is unreachable if the fit of the
    labelled documents leaves it short of its share with its rate at the cap.
    Without documents all tokens and shares are 0 and every source reaches its share of nothing.
    Null token counts count 0, null and empty sources are classified by their text, sources without
    a target count to the whole but not to the mix; a target named twice is one with the sum of its shares.
    """
    spark = documents.sparkSession
    want = read_targets(targets)
    docs = labelled(documents, want)
    domains = [s for s, _, _ in want] + [OTHER]
    at = {s: i for i, s in enumerate(domains)}
    # one row a target, one of the others, one of the unlabelled
    groups = docs.groupBy("domain").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    own = np.zeros(len(domains))
    for r in groups:
        if r["domain"] is not None:
            own[at[r["domain"]]] = r["n"]
    model = fit_classifier(docs, domains, n=sum(r["rows"] for r in groups))
    members = memberships(docs.where(F.col("domain").isNull()), model).persist()
    fit = fit_rates(own, float(sum(r["n"] for r in groups)), members, want, steps)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = _projected(batch.column(2), batch.column(3), fit.caps, fit.total)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rate)], names=["doc_id", "n_tokens", "rate"])

    by_domain = spark.createDataFrame([(s, float(r)) for s, r in zip(domains, fit.rate)], "domain string, rate double")
    sure = join_on(docs.where(F.col("domain").isNotNull()).select("doc_id", "domain", F.col("n").alias("n_tokens")), F.broadcast(by_domain), ["domain"])
    unsure = members.mapInArrow(project, "doc_id bigint, n_tokens double, rate double").withColumn("domain", F.lit(None).cast("string"))
    rates = sure.select("doc_id", "domain", "n_tokens", "rate").unionByName(unsure)
    whole = fit.mixed[:-1].sum()
    rows = []
    for i, (source, share, repeats) in enumerate(want):
        left = fit.want[i] - fit.own[i] * fit.sure[i]  # what the labelled documents leave open
        short = bool(left > 1e-12 * fit.want[i] and (fit.own[i] == 0 or fit.sure[i] >= fit.caps[i]))
        rows.append((
            source, share, repeats, int(fit.own[i]), float(fit.mass[i]), float(fit.mixed[i]), float(fit.mixed[i] / whole) if whole else 0.0,
            not short, fit.steps, fit.converged,
        ))
    schema = T.StructType.fromDDL(
        "source string, target_share double, max_repeats int, tokens bigint, expected_tokens double, "
        "mixed_tokens double, actual_share double, reachable boolean, steps int, converged boolean"
    )
    return rates, spark.createDataFrame(rows, schema)


def unreachable_sources(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``: sources of the mix that the fit cannot bring to their share."""
    _, report = mix(documents, targets)
    return report.where(~F.col("reachable")).select("source")


def copies(rates: DataFrame) -> DataFrame:
    """``doc_id, domain, copies``: whole copies, the fraction of a rate drawn by the id's hash,
    so that expected totals stay; documents with none do not appear."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / F.lit(1 << 20)
    whole = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")
    return rates.select("doc_id", "domain", whole.cast("int").alias("copies")).where("copies > 0")
