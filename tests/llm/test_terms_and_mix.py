"""Term counters and source mixing."""

from collections import Counter, defaultdict
import random
import re

import pytest
from pyspark.sql import functions as F

from voxcorpus.llm import mixing as M
from voxcorpus.llm.term_counts import brand_count_terms, count_terms, text_terms

DOC = "corpus_id string, doc_seq int, text string, loaded_at int, term string"


def test_counts_against_sets(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}'{chr(97 + i)}" for i in range(12)] + ["It's", "A-b", "x", "naïve", ""]
    rows = [("c", i, " ".join(rng.choices(words, k=rng.randrange(9))), 1, "t") for i in range(60)]
    rows += [(r[0], r[1], r[2], 2, "t") for r in rows[:20]] + [("c", 99, None, 1, "t"), (None, 1, "wa'a", 1, "t"), ("c", 100, "it's " * 50_000, 1, "t")]
    df = spark.createDataFrame(rows, DOC)
    seen, occurrences, records = {}, Counter(), defaultdict(set)
    for c, s, t, at, _ in rows:
        if t is not None and at == 1:
            seen[c, s] = t
    for k, t in seen.items():
        for w in re.findall(r"[a-z][a-z'\-]+", t.lower()):
            occurrences[w] += 1
            records[w].add(k)
    for most in (1_000_000, 2):
        got = count_terms(df.where("text IS NOT NULL"), ["corpus_id", "doc_seq"], F.col("text"), F.col("loaded_at"), most_terms=most).collect()
        assert {r["term"]: (r["occurrences"], r["records"]) for r in got if r["term"] is not None} == {w: (n, len(records[w])) for w, n in occurrences.items()}
        assert sum(r["records"] for r in got if r["term"] is None) == len(seen)
    marks = {r["term"]: r["mark"] for r in text_terms(df).collect()}
    share = len(seen) * 0.15
    assert marks == {w: "rare" if len(r) <= 2 else "common" if len(r) > share else None for w, r in records.items()}
    assert text_terms(df.where("false")).count() == 0


def test_values(spark):
    rows = [("c", str(i), 3 if i < 8 else i, 1) for i in range(10)] + [("c", "n", None, 1), ("c", "0", 3, 2)]
    df = spark.createDataFrame(rows, "corpus_id string, token string, brand_count bigint, computed_at int")
    got = {r["term"]: (r["records"], r["mark"]) for r in brand_count_terms(df).collect()}
    assert got == {"3": (8, "common"), "8": (1, "rare"), "9": (1, "rare")}


DOCS = "doc_id bigint, text string, source string, n_tokens bigint, rate double"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix_meets_its_targets(spark):
    rows = [(i, "apples pears", "a", 10, 0.0) for i in range(60)] + [(100 + i, "nails bolts", " B ", 10, 0.0) for i in range(30)]
    rows += [(200 + i, "soup", "other", 10, 0.0) for i in range(8)] + [(300, "nails bolts", None, 10, 0.0), (301, None, "", None, 0.0)]
    df = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.5, 3), ("none", 0.05, 9), ("c", 0.05, 4), (None, 0.1, 1)], TARGETS)
    rates, report = M.mix(df, targets)
    got = {r["source"]: r for r in report.collect()}
    total = 990
    assert got["a"]["tokens"] == 600 and got["b"]["tokens"] == 300 and got["b"]["expected_tokens"] == pytest.approx(310, abs=1)
    assert got["a"]["mixed_tokens"] == pytest.approx(0.4 * total, rel=1e-3) and got["b"]["mixed_tokens"] == pytest.approx(0.5 * total, rel=1e-3)
    assert {s for s, r in got.items() if not r["reachable"]} == {"none", "c"}
    assert {r["source"] for r in M.unreachable_sources(df, targets).collect()} == {"none", "c"}
    assert all(r["converged"] for r in got.values()) and sum(r["actual_share"] for r in got.values()) == pytest.approx(1)
    assert rates.count() == len(rows) and rates.where("rate < 0").count() == 0
    whole = M.copies(rates).groupBy("domain").agg(F.sum("copies")).collect()
    assert dict(map(tuple, whole))["b"] == pytest.approx(50, abs=12)


def test_mix_of_nothing(spark):
    empty, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    assert M.unreachable_sources(empty, targets).count() == 0
    assert M.unreachable_sources(spark.createDataFrame([(1, "x", "a", 5, 0.0)], DOCS), targets.where("false")).count() == 0


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(5)
    sets = {s: [f"{s}{i}" for i in range(40)] for s in ("a", "b", "c")}
    common = [f"w{i}" for i in range(80)]
    text = lambda s: " ".join(rng.choices(sets[s], k=4) + rng.choices(common, k=20))
    rows = [(i, text(s), s, s) for i, s in enumerate(rng.choices("abc", k=300))]
    model = M.fit_classifier(spark.createDataFrame(rows[:200], "doc_id bigint, text string, source string, domain string"), ["a", "b", "c"])
    right = sum("abc"[M.posterior(model, t).argmax()] == s for _, t, _, s in rows[200:])
    assert right >= 90


def test_unlabelled_documents_fill_what_labelled_ones_leave_open(spark):
    rows = [(i, "apples pears plums", "a", 10, 0.0) for i in range(50)] + [(100 + i, "nails bolts screws", "b", 10, 0.0) for i in range(10)]
    rows += [(200 + i, "nails bolts screws", None, 10, 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    rates, report = M.mix(df, targets)
    got = {r["source"]: r for r in report.collect()}
    assert not got["b"]["reachable"] and got["a"]["reachable"] and got["a"]["converged"]
    assert got["b"]["mixed_tokens"] == pytest.approx(500, rel=1e-2) and got["a"]["mixed_tokens"] == pytest.approx(500, rel=1e-2)
    assert rates.where("domain IS NULL AND rate > 0.9").count() == 40 and rates.where("rate > 1").count() == 0


def test_reachable_is_exact_at_the_edge(spark):
    rows = [(i, "x", s, 7, 0.0) for i, s in enumerate("abc" * 10)]
    targets = spark.createDataFrame([("a", 2 / 3, 2), ("b", 2 / 3 + 1e-9, 2), ("c", 0.0, 0)], TARGETS)
    assert [r["source"] for r in M.unreachable_sources(spark.createDataFrame(rows, DOCS), targets).collect()] == ["b"]


def test_more_domains_than_the_model_has_room_for(spark):
    rows = [(i, f"word{i}", f"s{i}", 5, 0.0) for i in range(1500)] + [(5000, "word7", None, 5, 0.0)]
    targets = spark.createDataFrame([(f"s{i}", 1 / 1500, 1) for i in range(1500)], TARGETS)
    rates, report = M.mix(spark.createDataFrame(rows, DOCS), targets)
    assert report.count() == 1500 and rates.count() == 1501


def test_mix_with_clashing_columns_and_nulls(spark):
    schema = "doc_id bigint, text string, source string, n_tokens bigint, rate double, domain string, n string, rows int, idx int"
    rows = [(1, "x", "a", 5, 0.0, "z", "q", 1, 2), (None, None, None, None, None, None, None, None, None), (1, "x", "A ", 5, 0.0, "z", "q", 1, 2)]
    rates, report = M.mix(spark.createDataFrame(rows, schema), spark.createDataFrame([("a", 1.0, 1), ("b", 0.0, 0)], TARGETS))
    assert rates.count() == 3 and {r["source"]: r["reachable"] for r in report.collect()} == {"a": True, "b": True}
    assert {r["doc_id"] for r in M.copies(rates).collect()} == {1}
