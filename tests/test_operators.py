"""Cadence, vocabulary, vectors, clusters and tone on small inputs."""

import math
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import numpy as np
from pyspark.sql import functions as F
import pytest

from voxcorpus.functions import text as T
from voxcorpus.functions.rows import running
from voxcorpus.operators import cadence as C
from voxcorpus.operators import clusters as K
from voxcorpus.operators import tone as N
from voxcorpus.operators import vectors as V
from voxcorpus.operators import vocabulary as W
from voxcorpus.sources.tables import first_delivery

BY = ["corpus_id"]


def docs(spark, *texts, corpus="c"):
    return spark.createDataFrame([(corpus, i, t) for i, t in enumerate(texts, 1)], "corpus_id string, doc_seq int, text string")


def cadence(spark, *texts, **kw):
    return C.cadence(docs(spark, *texts), BY, **kw).first()


def test_cadence_of_simple_text(spark):
    r = cadence(spark, "I love coding. You should too. It's great!")
    assert (r["sentence_count"], r["word_count"]) == (3, 9)
    assert r["exclamation_rate"] == pytest.approx(1 / 3)
    assert r["pronoun_ratio_first"] > 0 and r["pronoun_ratio_second"] > 0
    r = cadence(spark, "Short. Punchy. To the point.")
    assert (r["sentence_count"], r["fragment_rate"]) == (3, 1.0)
    assert cadence(spark, "Hello, world! How are you? Fine, thanks.")["punct_density"] == pytest.approx(5 / 7 * 100)
    assert cadence(spark, "One, two, three, four, five.")["punct_density"] == pytest.approx(100.0)


def test_cadence_of_nothing(spark):
    for texts in ([""], [None], ["  \n "], ["...!!"]):
        r = cadence(spark, *texts)
        assert r["sentence_count"] == r["word_count"] == 0 and all(r[m] == 0.0 for m in C.MEASURES)
    assert C.cadence(docs(spark, "a").where("false"), BY).count() == 0


def test_cadence_by_document_and_joined(spark):
    two = ("I write. You read.", "We ship. Fast. Always.")
    assert cadence(spark, *two)["sentence_count"] == cadence(spark, *two, exact=True)["sentence_count"] == 5
    open_end = ("A heading without an end", "And a sentence.")
    assert cadence(spark, *open_end)["sentence_count"] == 2 and cadence(spark, *open_end, exact=True)["sentence_count"] == 1


def joined_sentences(texts):
    import re

    whole = "\n\n".join(t or "" for t in texts)
    return [s for s in (p.strip() for p in re.sub("([.!?][.!?\"”’')\\]]*)\\s+", "\\1\x1e", whole).split("\x1e")) if s]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text("ab.!? \n\"", max_size=14)), min_size=1, max_size=7))
def test_exact_sentences_are_those_of_the_joined_text(spark, texts):
    rows = C.split_sentences(docs(spark, *texts), BY, exact=True).collect()
    assert [r["sentence"] for r in sorted(rows, key=lambda r: (r["doc_seq"], r["sent_seq"]))] == joined_sentences(texts)


def test_running_sums_of_a_cut_group(spark):
    rows = [(g, k, n) for g in ("a", None) for k in (2, 1) for n in range(0, 50, 3)] + [("a", 1, None)]
    df = spark.createDataFrame(rows, "g string, k int, n int")
    got = running(df, ["g"], [F.col("k")], "n", F.lit(1), "before", span=7).collect()
    assert sorted((r["g"] or "", r["before"]) for r in got) == [("", i) for i in range(34)] + [("a", i) for i in range(35)]
    places = sorted((r for r in got if r["g"] == "a"), key=lambda r: r["before"])
    assert [(r["k"], r["n"]) for r in places] == sorted(((k, n) for g, k, n in rows if g == "a"), key=lambda x: (x[0], x[1] is not None, x[1]))


def test_null_corpus_is_a_group(spark):
    df = docs(spark, "One two three four five.").unionByName(docs(spark, "Six.", corpus=None))
    assert {r["corpus_id"]: r["sentence_count"] for r in C.cadence(df, BY).collect()} == {"c": 1, None: 1}
    rates = W.brand_rates(W.token_counts(df, BY), BY)
    assert rates.where("corpus_id IS NULL").first()["brand_rate"] == 1e6


def test_histogram(spark):
    text = " ".join(" ".join(["word"] * n) + "." for n in (3, 5, 7, 9, 11, 13, 15, 4, 6, 8, 10))
    h = C.length_histogram(C.measure_sentences(C.split_sentences(docs(spark, text), BY)), BY).orderBy("bin").collect()
    assert len(h) == 10 and sum(r["n"] for r in h) == 11 and h[-1]["hi"] == 15 and any("█" in r["bar"] for r in h)
    same = C.length_histogram(C.measure_sentences(C.split_sentences(docs(spark, "a b. c d."), BY)), BY).orderBy("bin").collect()
    assert sum(r["n"] for r in same) == 2 and (same[0]["lo"], same[-1]["hi"]) == (1.5, 2.5)


def test_signature_and_avoided(spark):
    text = "Infrastructure matters. We build infrastructure for teams. " * 5
    base = spark.createDataFrame(
        [("teams", 9, 40.0, 2), ("however", 50, 900.0, 1), ("first", 40, 800.0, 3), ("matters", 2, None, 4), (None, 1, 1.0, 5)],
        "token string, cnt bigint, rate double, rnk int",
    )
    d = docs(spark, text, None, "")
    rates = W.brand_rates(W.token_counts(d, BY), BY)
    top = W.signature_words(rates, base, BY).orderBy("rank").collect()
    assert top[0]["token"] == "infrastructure" and top[0]["brand_count"] == 10 and top[0]["ratio"] > 5
    bad = W.forbidden_candidates(rates, base, d, BY).orderBy("rank").collect()
    assert [r["token"] for r in bad] == ["however"]  # "first" is noise, "teams" and "matters" are used
    assert W.signature_words(rates.where("false"), base, BY).count() == 0


def test_noise_floor(spark):
    rates = W.brand_rates(W.token_counts(docs(spark, "alpha alpha alpha beta beta beta beta beta gamma gamma"), BY), BY)
    base = spark.createDataFrame([("zeta", 1, 1.0, 1)], "token string, cnt bigint, rate double, rnk int")
    assert [r["token"] for r in W.signature_words(rates, base, BY).collect()] == ["beta"]


def test_tfidf_is_the_known_formula(spark):
    d = docs(spark, "apple apple pear", "pear plum", "plum")
    got = {r["token"]: r["weight"] for r in W.tfidf(d, BY).collect()}
    idf = {t: math.log(4 / (1 + n)) + 1 for t, n in (("apple", 1), ("pear", 2), ("plum", 2))}
    rows = [{"apple": 2 * idf["apple"], "pear": idf["pear"]}, {"pear": idf["pear"], "plum": idf["plum"]}, {"plum": idf["plum"]}]
    want = dict.fromkeys(idf, 0.0)
    for r in rows:
        norm = math.sqrt(sum(w * w for w in r.values()))
        for t, w in r.items():
            want[t] += w / norm
    assert got == pytest.approx(want)


@pytest.mark.parametrize("most", [500_000, 1, 0])
def test_first_delivery(spark, most):
    t = lambda m: datetime(2024, m, 1)
    rows = [("c", 1, "late", t(2)), ("c", 1, "first", t(1)), (None, 1, "x", None), ("c", 2, "dated", t(3)), ("c", 2, "undated", None),
            ("c", 3, "b", t(1)), ("c", 3, "a", t(1)), ("c", 3, "0", t(2)), ("c", 4, "u2", None), ("c", 4, "u1", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "corpus_id string, doc_seq int, text string, loaded_at timestamp")
    got = {(r["corpus_id"], r["text"]) for r in first_delivery(df, ["corpus_id", "doc_seq"], "loaded_at", ["text"], most).collect()}
    assert got == {("c", "first"), (None, "x"), ("c", "dated"), ("c", "a"), ("c", "u1"), (None, None)}
    assert first_delivery(df.where("false"), ["corpus_id", "doc_seq"], "loaded_at").count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "token string, cluster int, embedding array<float>")


def test_centroid_and_extremes(spark):
    v = vectors(spark, [("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 2.0]), ("c", 0, [1.0, 1.0]), ("n", 0, None), ("z", 0, [0.0, 0.0])])
    c = V.centroids(v.where("token <> 'z'"), ["cluster"]).first()["centroid"]
    assert c == pytest.approx([math.sqrt(0.5)] * 2)
    d = V.distances(v.where("embedding IS NOT NULL"), V.centroids(v.where("token <> 'z'"), []), [])
    near = V.extremes(d, [], ["token"], k=2).orderBy("rank").collect()
    assert [r["token"] for r in near] == ["c", "a"]
    assert V.extremes(d, [], ["token"], k=1, nearest=False).first()["token"] == "z"


def test_learned_words_know_what_occurs_together(spark):
    rows = ["the harbour boats sail tide", "boats tide harbour", "sail boats tide", "bread oven flour yeast", "flour yeast bread", "oven bread yeast"] * 3
    e = V.learn_words(docs(spark, *[f"{t} x{i % 7}y" for i, t in enumerate(rows)]), dim=32)
    v = e.encode(["boats", "tide", "yeast", "unknownword", ""])
    assert v[0] @ v[1] > v[0] @ v[2] + 0.3 and abs(v[3] @ v[3] - 1) < 1e-9
    s = V.HashedNgrams().encode(["harbour", "harbours", "quietly", None, "\ud800"])
    assert s[0] @ s[1] > 0.5 > s[0] @ s[2] and s.shape == (5, 64)
    assert (V.HashedNgrams().encode(["harbour"]) == s[:1]).all() and V.HashedNgrams().encode([]).shape == (0, 64)


def test_semantic_partition(spark):
    middles = vectors(spark, [("m", 0, [1.0, 0.0])]).select(F.col("embedding").cast("array<double>").alias("centroid"))
    got = V.semantic_partition(vectors(spark, [("in", 0, [0.9, 0.1]), ("out", 0, [0.0, 1.0])]), middles).collect()
    assert {r["token"]: r["stylistic"] for r in got} == {"in": True, "out": False}


def test_kmeans_keeps_every_row(spark):
    rows = [(f"a{i}", 0, [1.0, 0.01 * i]) for i in range(6)] + [(f"b{i}", 0, [0.01 * i, 1.0]) for i in range(6)]
    got = K.kmeans(vectors(spark, rows).drop("cluster"), k=2, seeds=2).collect()
    assert len(got) == 12 and len({r["cluster"] for r in got if r["token"][0] == "a"}) == 1 and len({r["cluster"] for r in got}) == 2
    assert K.kmeans(vectors(spark, rows[:1]).drop("cluster"), k=6).first()["cluster"] == 0
    assert K.kmeans(vectors(spark, rows).where("false").drop("cluster")).count() == 0
    assert [r["cluster"] for r in K.kmeans(vectors(spark, [("n", 0, None), ("a", 0, [1.0, 0.0])]).drop("cluster")).collect()] == [None, 0]
    same = K.kmeans(vectors(spark, rows[:1] * 5).drop("cluster"), k=3).collect()
    assert len(same) == 5 and len({r["cluster"] for r in same}) == 1


def test_kmeans_in_the_tasks_is_the_same(spark, monkeypatch):
    rows = [(f"{g}{i}", 0, [float(g == "a") + 0.01 * i, float(g == "b"), float(g == "c")]) for g in "abc" for i in range(6)]
    v = vectors(spark, rows).drop("cluster")
    parts = lambda: {frozenset(t) for t in K.kmeans(v, k=3).groupBy("cluster").agg(F.collect_set("token").alias("t")).toPandas()["t"]}
    here = parts()
    monkeypatch.setattr(K, "SMALL", 5)
    assert parts() == here == {frozenset(f"{g}{i}" for i in range(6)) for g in "abc"}


def test_clusters_dropped(spark):
    rows = [(w, 0, 5.0) for w in ("several", "many", "other", "some")] + [(f"w{i}", 1, float(i)) for i in range(5)] + [("x", 2, 1.0)]
    m = spark.createDataFrame(rows, "token string, cluster int, weight double")
    got = K.surviving(m, ["cluster"], ["several", "many", "other", "some"]).collect()
    assert [(r["cluster"], r["label"], r["size"]) for r in got] == [(1, "w4, w3, w2", 5)]


BASE = dict(sentence_count=100, word_count=1200, mean_length=13.0, std_length=6.0, p25_length=8.0, p50_length=12.0, p75_length=17.0,
            pronoun_ratio_first=0.004, pronoun_ratio_second=0.004, punct_density=14.0, question_rate=0.01, exclamation_rate=0.001,
            fragment_rate=0.12, sig_tokens=["plain"])
SCHEMA = ", ".join(["sentence_count bigint", "word_count bigint", *(f"{s} double" for s in N.SIGNALS), "sig_tokens array<string>"])


def tone(spark, **changes):
    return N.classify(spark.createDataFrame([BASE | changes], SCHEMA)).first()


def test_tone(spark):
    r = tone(spark, sentence_count=0, word_count=0)
    assert (r["primary_tone"], r["uncertain"], r["rationale"]) == ("unknown", True, ["empty input"])
    r = tone(spark, mean_length=8.0, fragment_rate=0.35, p75_length=13.0, p50_length=6.0, std_length=5.0, punct_density=12.0)
    assert (r["primary_tone"], r["confidence"]) == ("direct", 1.0)
    r = tone(spark, mean_length=22.0, pronoun_ratio_first=0.001, pronoun_ratio_second=0.001, fragment_rate=0.05)
    assert (r["primary_tone"], r["confidence"]) == ("formal", 1.0)
    r = tone(spark, mean_length=14.0, pronoun_ratio_first=0.01, pronoun_ratio_second=0.04, sig_tokens=["you're", "it's"])
    assert "conversational" in (r["primary_tone"], r["secondary_tone"])
    assert any(c.isdigit() for c in "".join(r["rationale"])) and len(r["rationale"]) <= 5
    r = tone(spark, **{s: None for s in N.SIGNALS}, sig_tokens=None)
    assert r["primary_tone"] != "unknown" and r["score_conversational"] == 0.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_cadence_never_fails(spark, texts):
    r = cadence(spark, *texts)
    assert r["word_count"] >= r["sentence_count"] >= 0


def test_marks_in_order_count_as_words_and_marks(spark):
    texts = ["I paid 3.5, not 2 ..5 -- or a---b 12:30:5.", "\x1e… «oui»!", "us_we 9us us, US us", "", "  "]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    m, t = T.marks_in_order(F.col("t")), F.col("t")
    got = d.select(F.size(F.filter(m, lambda x: x == "")), T.count_words(t), F.size(F.array_remove(m, "")), T.count_marks(t)).collect()
    assert all(a == b and c == e for a, b, c, e in got) and got[0][1:3] == (10, 5)
    assert [r[0] for r in d.select(T.count_of(t, ["we", "us"])).collect()] == [0, 0, 5, 0, 0]


def test_sums_by_length_give_the_cadence(spark):
    text = "Do you see it? I do! " + "Three plain words. We walk and you talk, as before. " * 5 + "!!! ??? ..."
    d = spark.createDataFrame([("c", 1, text), ("c", 2, None), ("c", 3, "One")], "corpus_id string, doc_seq int, text string")
    sentences = C.split_sentences(d, BY)
    rows, middle = C.lengths_and_mean(sentences, T.is_usable_sentence(F.col("sentence")), V.HashedNgrams())
    table = spark.createDataFrame(rows, ", ".join(["n_words int", *(f"{c} bigint" for c in C.SUMS)]))
    measured = C.measure_sentences(sentences)
    got, want = C.cadence_of_lengths(table, []).first().asDict(), C.aggregate_cadence(measured, BY).first().asDict()
    assert got == {k: pytest.approx(v) for k, v in want.items() if k != "corpus_id"}
    vectors = V.embed(sentences.where(T.is_usable_sentence(F.col("sentence"))), "sentence", V.HashedNgrams())
    assert list(middle) == pytest.approx(V.centroids(vectors, BY).first()["centroid"])


def test_extreme_texts_are_those_of_all_distances(spark):
    texts = [f"the {w} walks {n} times" for w in ("harbour", "lantern", "editor") for n in range(9)] * 3
    d = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "corpus_id string, n int, t string").repartition(3)
    vectors = V.embed(d, "t", V.HashedNgrams())
    middle = V.centroids(vectors, BY)
    measured = V.distances(vectors, middle, BY)
    some = V.extreme_texts(d, "t", V.HashedNgrams(), np.array(middle.first()["centroid"]), k=4)
    for nearest in (True, False):
        want, got = ([r["n"] for r in V.extremes(x, BY, ["n"], 4, nearest).orderBy("rank").collect()] for x in (measured, some))
        assert got == want
    assert some.count() < len(texts)


@pytest.mark.parametrize("most", [W.MOST_KNOWN, 2])
def test_weights_of_known_tokens_are_those_of_all(spark, monkeypatch, most):
    texts = ["Plain words, plain sentences; the words stay.", "Sentences stay plain", None, "", "quite another text's own words"]
    d = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "corpus_id string, doc_seq int, text string")
    monkeypatch.setattr(W, "HELD", 2)
    stats = W.token_spread(d)
    assert {tuple(r) for r in stats.select("token", "brand_count").collect()} == {tuple(r) for r in W.token_counts(d, []).collect()}
    monkeypatch.setattr(W, "MOST_KNOWN", most)
    keep = W.in_cluster_vocabulary(1)
    want = {r["token"]: pytest.approx(r["weight"]) for r in W.tfidf(d, BY, keep).collect()}
    assert {r["token"]: r["weight"] for r in W.tfidf_known(d, stats, len(texts), keep).collect()} == want and len(want) > 5


def test_kmeans_in_the_tasks_does_not_hang_on_their_number(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"t{i}", 0, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 3)))]
    monkeypatch.setattr(K, "SMALL", 5)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("kmeans", "")
    found = [{r["token"]: r["cluster"] for r in K.kmeans(vectors(spark, rows).drop("cluster").repartition(n), k=4).collect()} for n in (1, 7)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and set(found[0].values()) == {0, 1, 2, 3}
    assert len(jobs.getJobIdsForGroup("kmeans")) < 100  # ten runs share each pass


def test_summary_is_what_the_parts_say(spark):
    rows = [(w, 0, [1.0, 0.1 * i], 5.0) for i, w in enumerate(("several", "many", "other", "some"))]
    rows += [(f"w{i}", 1, [0.1 * i, 1.0], float(i)) for i in range(5)] + [("x", 2, [1.0, 1.0], 1.0)]
    m = spark.createDataFrame(rows, "token string, cluster int, embedding array<double>, weight double")
    got, middles, found = K.summary(m, ["several", "many", "other", "some"])
    want = K.surviving(m, ["cluster"], ["several", "many", "other", "some"]).join(K.exemplars(m, ["cluster"]), "cluster").drop("stop_share").collect()
    assert got == [r.asDict(recursive=True) for r in want] and found == 3 and len(got) == 1
    assert list(middles[0]) == pytest.approx(V.centroids(m, ["cluster"]).where("cluster = 1").first()["centroid"])
