"""Queries over small literal inputs, with the rows they must give written out in SQL.

For operators SQL cannot express (HTML, crawls, clusters, files for people): the inputs stand here, and the
expected rows were worked out by hand from what each operator is said to do. They read no tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcorpus.cli import report, summary
from voxcorpus.functions import html as H
from voxcorpus.operators import clusters as K
from voxcorpus.operators import vectors as V
from voxcorpus.plans.fingerprint import fingerprint
from voxcorpus.plans.queries import query
from voxcorpus.sources import pages as P
from voxcorpus.sources import sinks
from voxcorpus.sources.folder import documents_of_files


def values(columns: str, *rows: tuple) -> str:
    """The rows as SQL."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


# Files

_FILES = [
    ("site/page.html", "<html><head><title>Tab</title><style>p{}</style></head><body><h1>Harbour &amp; Quay</h1><script>x()</script><p>Boats leave at dawn.</p></body></html>"),
    ("site/bare.HTM", "<p>No heading stands in this page at all.</p>"),
    ("post.md", "# The Post\n\nSee [the quay](http://q.example/a) and `code` in **bold**.\n\n## Next part\n\n- one\n- two"),
    ("late.markdown", "Words before it.\n  # Late heading  \nWords after it."),
    ("note.txt", "First line\n\n\n \nSecond   paragraph\tis here."),
    ("long.txt", "w" * 121 + " and more words"),
    ("bad.txt", "Some bytes �were lost in this file."),
    ("tiny.md", "# Hi\n"),
    ("skip.pdf", "Text enough, but of another kind."),
    ("nosuffix", "Text enough, but without a suffix."),
    ("null.txt", None),
]


@query(values(
    "path, title, text",
    ("site/page.html", "Harbour & Quay", "Tab Harbour & Quay Boats leave at dawn."),
    ("site/bare.HTM", "No heading stands in this page at all.", "No heading stands in this page at all."),
    ("post.md", "The Post", "The Post\n\nSee the quay and code in **bold**. Next part\n\n- one - two"),  # a heading takes the blank line before it along
    ("late.markdown", "Late heading", "Words before it. Late heading Words after it."),
    ("note.txt", "First line", "First line\n\nSecond paragraph is here."),
    ("long.txt", "long", "w" * 121 + " and more words"),
    ("bad.txt", "Some bytes were lost in this file.", "Some bytes were lost in this file."),
))
def folder_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder by their suffixes: Markdown, HTML and plain text to documents with titles."""
    files = spark.createDataFrame(_FILES, "path string, text string")
    return documents_of_files(files, F.col("path"), F.col("text"))


# Pages

_P = "The harbour wakes before the town does, and the first boats are out while the streets are still dark and quiet."
_LONG = " ".join([_P] * 4)
_LINKS = "".join(f'<a href="/{i}">Link number {i}</a> ' for i in range(7))
_PAGES = [
    # tags that go, a junk class by its substring, the title tag, direct blocks of main
    (1, f"<title> Own title </title><body><nav>Menu</nav><header>Head</header><main><h1>Heading</h1><div class='canvas'>gone</div><p>{_LONG}</p>"
        f"<form>Form</form><aside>Aside</aside></main><footer>Foot</footer><script>s()</script></body>"),
    # no title tag: the root's h1; blocks that are links or trails go, tags that are no blocks are not walked into
    (2, f"<article><h1>Only heading</h1><div>{_LINKS}</div><p>Home → Blog → Post</p><p>{_LONG}</p><span>{_P}</span></article>"),
    # a section with much text of its own is kept whole, one with little is walked into
    (3, f"<main><section>{_P}<p>Inner.</p></section><section>Short.<p>{_LONG}</p><ul><li>One</li><li>Two</li></ul></section></main>"),
    # nothing kept: all text of the root
    (4, f"<title>Plain</title><body><span>{_LONG}</span></body>"),
    # too little text, or too few words
    (5, "<main><p>Too short to count.</p></main>"),
    (6, f"<main><p>{'w' * 300}</p></main>"),
    # a body whose class names a sidebar loses all it has
    (7, f"<html><body class='has-sidebar'><p>{_LONG}</p></body></html>"),
    # open tags, no title anywhere, many links in little text
    (8, f"<main><p>{_LONG}<div>{''.join(f'<a>l{i}</a>' for i in range(6))}{'x' * 60}</div>"),
    (9, None), (10, ""),
]


@query(values(
    "page_id, title, text",
    (1, "Own title", f"Heading\n\n{_LONG}"),
    (2, "Only heading", f"Only heading\n\n{_LONG}"),
    (3, "Untitled", f"{_P} Inner.\n\n{_LONG}\n\nOne Two"),
    (4, "Plain", f"{_LONG}"),
    (8, "Untitled", f"{_LONG} " + " ".join(f"l{i}" for i in range(6)) + " " + "x" * 60),
))
def page_walk(spark: SparkSession, d: str) -> DataFrame:
    """The main content of pages: what is dropped, what is walked into, what is kept whole, what is too little."""
    pages = spark.createDataFrame(_PAGES, "page_id int, html string")
    made = pages.select("page_id", H.page_content_column(F.col("html")).alias("c"))
    return made.where(F.col("c.text").isNotNull()).select("page_id", "c.title", "c.text")


_SITE = {
    "http://h.example/robots.txt": "User-agent: *\nDisallow: /closed/",
    "http://h.example/": f"<main><p>{_LONG}</p><a href='/blog/b'>b</a><a href='/about'>about</a><a href='closed/x'>x</a><a href='/gone'>g</a>"
                         "<a href='/login'>in</a><a href='http://o.example/'>o</a><a href='/pic.png'>p</a></main>",
    "http://h.example/about": f"<main><h1>About</h1><p>{_LONG}</p><a href='./blog/../blog/a?x=1#y'>a</a></main>",
    "http://h.example/blog/b": f"<main><p>{_LONG}</p></main>",
    "http://h.example/blog/a": "<main><p>Too short.</p><a href='/late'>late</a></main>",
    "http://h.example/late": f"<main><p>{_LONG}</p></main>",
    "http://h.example/closed/x": f"<main><p>{_LONG}</p></main>",
}


@query(values("doc_seq, path, title", (1, "/", "Untitled"), (2, "/about", "About"), (3, "/blog/b", "Untitled"), (4, "/late", "Untitled")))
def crawl_site(spark: SparkSession, d: str) -> DataFrame:
    """A crawl by priority within one host: robots, missing, skipped and foreign addresses, pages with too little text."""
    rows = [(i, u, h, 200) for i, (u, h) in enumerate(_SITE.items())]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, status_code int")
    return P.crawl(spark, "http://H.example", P.table_fetcher(pages, "h.example")).select("doc_seq", "path", "title")


@query(values("attempts, documents", (1, 1), (2, 2), (3, 3), (5, 3), (20, 4)))
def crawl_attempts(spark: SparkSession, d: str) -> DataFrame:
    """How many documents come of a bound on attempts: skipped, forbidden and failed ones count."""
    rows = [(i, u, h, 200) for i, (u, h) in enumerate(_SITE.items())]
    fetch = P.table_fetcher(spark.createDataFrame(rows, "page_id int, url string, html string, status_code int"), "h.example")
    made = [(n, P.crawl(spark, "http://h.example/", fetch, max_pages=n).count()) for n in (1, 2, 3, 5, 20)]
    return spark.createDataFrame(made, "attempts int, documents int")


# Vectors and clusters

_POINTS = [(f"{name}{i}", weight - i, [x + 0.01 * i, y, z]) for name, weight, x, y, z in (
    ("boat", 9.0, 1.0, 0.0, 0.0), ("bread", 7.0, 0.0, 1.0, 0.0), ("the", 5.0, 0.0, 0.0, 1.0), ("lone", 3.0, -1.0, 0.0, 0.0),
) for i in range(1 if name == "lone" else 4)]


@query(values(
    "label, size, centroid_token, top_tokens",
    ("boat0, boat1, boat2", 4, "boat0", "boat0 boat1 boat2 boat3"),
    ("bread0, bread1, bread2", 4, "bread1", "bread0 bread1 bread2 bread3"),
))
def clusters_of_points(spark: SparkSession, d: str) -> DataFrame:
    """Clusters far apart: labels, exemplars; one is dropped for its size, one as stopwords."""
    rows = spark.createDataFrame(_POINTS, "token string, weight double, embedding array<double>")
    members = K.kmeans(rows, k=4).persist()
    stop = [t for t, _, _ in _POINTS if t.startswith("the")]
    alive = K.surviving(members, ["cluster"], stop).join(K.exemplars(members, ["cluster"]), "cluster")
    return alive.select("label", F.col("size").cast("int").alias("size"), "centroid_token", F.array_join(F.transform("top_tokens", lambda t: t["token"]), " ").alias("top_tokens"))


_NAMES = ["harbour", "harbours", "Harbour", "quietly", ""]


@query(values("text, length_one, same_as_first, near_first", ("harbour", True, True, True), ("harbours", True, False, True), ("Harbour", True, True, True),
              ("quietly", True, False, False), ("", False, False, False)))
def embedded_spelling(spark: SparkSession, d: str) -> DataFrame:
    """The embedder that needs no model: unit vectors, letter case aside, near for near spellings."""
    rows = V.embed(spark.createDataFrame([(t,) for t in _NAMES], "text string"), "text", V.HashedNgrams())
    first = V.embed(spark.createDataFrame([(_NAMES[0],)], "w string"), "w", V.HashedNgrams()).select(F.col("embedding").alias("f"))
    e = F.col("embedding")
    both = rows.crossJoin(F.broadcast(first))  # one row beside five
    return both.select(
        "text", (F.abs(V.dot(e, e) - 1) < 1e-9).alias("length_one"), (V.dot(e, F.col("f")) > 1 - 1e-9).alias("same_as_first"),
        (V.dot(e, F.col("f")) > 0.5).alias("near_first"),
    )


# The pipeline's ends

_DOC = "corpus_id string, doc_seq int, text string"
_BASE = [("teams", 9, 40.0, 2), ("however", 50, 900.0, 1), ("harbour", 12, 100.0, 3)]


def _empty(spark: SparkSession, texts: list) -> dict:
    docs = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], _DOC)
    return fingerprint(spark, docs, spark.createDataFrame(_BASE, "token string, cnt bigint, rate double, rnk int"))


@query(values(
    "case_name, documents, empty, words, vocabulary, nearest, dimension, signature, note, tone",
    ("no documents", 0, True, None, None, None, None, None, None, None),
    ("no text", 2, False, 0, 0, 0, 0, 0, "empty input", "unknown"),
    ("marks only", 1, False, 0, 0, 0, 0, 0, "empty input", "unknown"),
    ("no usable sentence", 1, False, 2, 0, 0, 0, 0, None, "punchy"),
))
def pipeline_of_nothing(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline over corpora without documents, words or usable sentences."""
    rows = []
    for name, texts in (("no documents", []), ("no text", [None, " \n "]), ("marks only", ["... !!"]), ("no usable sentence", ["Harbour wakes."])):
        f = _empty(spark, texts)
        if f.get("empty"):
            rows.append((name, f["doc_count"], True, *[None] * 7))
        else:
            v = f["voice"]
            rows.append((
                name, f["doc_count"], False, f["cadence"]["word_count"], len(v["top_vocab"]), len(v["closest_to_centroid"]), v["embedding_dim"],
                len(f["signature_words"]), f["stats"].get("note"), f["tone"]["primary_tone"],
            ))
    return spark.createDataFrame(
        rows, "case_name string, documents int, empty boolean, words int, vocabulary int, nearest int, dimension int, signature int, note string, tone string"
    )


#: A finished fingerprint, as the pipeline makes them.
FINISHED = {
    "brand_name": "Quay", "source": "folder:quay", "generated_at": "2024-05-01 10:00:00", "doc_count": 3, "thin_corpus": True,
    "cadence": {
        "sentence_count": 40, "word_count": 500, "mean_length": 12.46, "std_length": 6.2, "p25_length": 7.0, "p50_length": 12.0, "p75_length": 16.0,
        "pronoun_ratio_first": 0.00449, "pronoun_ratio_second": 0.021, "punct_density": 13.26, "question_rate": 0.0255, "exclamation_rate": 0.0251,
        "fragment_rate": 0.2125, "histogram": [{"bin": 0, "lo": 2.0, "hi": 8.5, "n": 4, "bar": "████"}], "sentence_lengths": [2, 15],
    },
    "voice": {
        "top_vocab": [["harbour", 9], ["quay", 4]], "closest_to_centroid": [{"text": "Boats leave\nat dawn.", "distance": 0.25}, {"text": "x" * 230, "distance": 0.3}],
        "farthest_from_centroid": [{"text": "Nobody knows.", "distance": 0.9}], "embedding_dim": 64, "embed_model": "hashed-ngrams",
    },
    "clusters": {"clusters": [{"id": 2, "label": "boats, tide, quay", "size": 9, "centroid_token": "tide", "top_tokens": [[t, 1.0] for t in "boats tide quay mast rope sail oars keel hull".split()]}]},
    "signature_words": [{"token": t, "ratio": r, "brand_count": n} for t, r, n in (("harbour", 31.416, 9), ("www", 9.0, 5), ("it's", 8.0, 4), ("sea", 7.0, 3), ("quays", 6.25, 4))],
    "forbidden_words": [{"token": f"word{i}"} for i in range(25)], "forbidden_irrelevant": [], "baseline": "general", "relevance_threshold": 0.55,
    "tone": {"primary_tone": "conversational", "secondary_tone": "direct", "confidence": 0.5, "uncertain": True, "rationale": [], "tone_scores": {"conversational": 0.5, "direct": 0.5}},
    "timings_ms": {"cadence": 1.0},
}


@query(values(
    "key, value",
    ("baseline_corpus", '"general"'), ("brand_name", '"Quay"'), ("cadence.exclamation_rate", "0.025"), ("cadence.first_person_ratio", "0.0045"),
    ("cadence.fragment_rate", "0.212"), ("cadence.mean_sentence_length", "12.5"), ("cadence.punct_density", "13.3"), ("cadence.question_rate", "0.025"),
    ("cadence.second_person_ratio", "0.021"), ("cadence.target_range", "[6, 18]"), ("embedding_model", '"hashed-ngrams"'),
    ("exemplar_sentences", json.dumps(["Boats leave\nat dawn.", "x" * 230])), ("forbidden_words", json.dumps([f"word{i}" for i in range(20)])),
    ("generated_at", '"2024-05-01 10:00:00"'), ("schema_version", '"0.1"'),
    ("signature_words", '[{"token": "harbour", "ratio": 31.42, "count": 9}, {"token": "quays", "ratio": 6.25, "count": 4}]'), ("source", '"folder:quay"'),
    ("tone.confidence", "0.5"), ("tone.primary", '"conversational"'), ("tone.secondary", '"direct"'), ("tone.uncertain", "true"),
    ("vocabulary_clusters", '[{"label": "boats, tide, quay", "exemplar": "tide", "top_tokens": ["boats", "tide", "quay", "mast", "rope", "sail", "oars", "keel"], "size": 9}]'),
))
def brand_config_entries(spark: SparkSession, d: str) -> DataFrame:
    """The configuration of a brand, entry by entry."""
    flat = {}
    for k, v in sinks.brand_config(FINISHED).items():
        flat |= {f"{k}.{a}": b for a, b in v.items()} if isinstance(v, dict) else {k: v}
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in flat.items()], "key string, value string")


@query(values(
    "line_no, line",
    *enumerate([
        "# Quay: how it sounds", "From folder:quay, measured 2024-05-01 10:00:00 against general.",
        "## Tone", "- conversational (50% of its marks): you and its forms: over 0.015; I, we and their forms: over 0.005; words a sentence: from 10 to 18; contractions: over 0.5",
        "- direct (50% of its marks): words a sentence: under 12; sentences under five words: over 0.25; upper quartile of sentences: under 18; marks in a hundred words: under 15",
        "- confidence is only 50%: where the lines disagree, the first one holds",
        "## Figures", "- words a sentence: 12.5 (keep within 6 to 18)", "- you and its forms: 2.10% (often)", "- I, we and their forms: 0.45% (hardly ever)",
        "- sentences under five words: 21% (many)", "- marks in a hundred words: 13.3 (middling)", "- exclamations: 2.5% (part of the voice)",
        "## Its own words", "- harbour", "- quays", "## Not its words", *(f"- word{i}" for i in range(5)),
        "## Fields of words", "- boats, tide, quay: boats tide quay mast rope sail", "## Heard in", '- "Boats leave at dawn."', f'- "{"x" * 217}..."',
        "## To check", "- [ ] words a sentence: keep within 6 to 18", "- [ ] you and its forms: often", "- [ ] I, we and their forms: hardly ever",
        "- [ ] sentences under five words: many", "- [ ] marks in a hundred words: middling", "- [ ] exclamations: part of the voice",
        "- [ ] none of 5 words that are not its own",
    ], 1),
))
def style_prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    """The style prompt, line by line, blank ones aside; of a thin corpus, so only five avoided words."""
    lines = [x for x in sinks.style_prompt(FINISHED).split("\n") if x]
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")


@query(values(
    "line_no, line",
    *enumerate([
        "tone conversational (50%)", "signature words: harbour, www, it's, sea, quays", "forbidden words: " + ", ".join(f"word{i}" for i in range(8)),
        "fewer than 3,000 words: the list of avoided words is noisy",
        "sentences 40, words 500, mean 12.5, deviation 6.2", "   2.0-   8.5      4 ████", "  1. harbour              9", "  2. quay                 4",
        "closest_to_centroid", "  0.2500 'Boats leave\\nat dawn.'", f"  0.3000 '{'x' * 180}'", "farthest_from_centroid", "  0.9000 'Nobody knows.'",
        "first person 0.4%, second person 2.1%", "milliseconds {'cadence': 1.0}",
    ], 1),
))
def console_lines(spark: SparkSession, d: str) -> DataFrame:
    """What the command line prints of a fingerprint: the summary, then the inspection."""
    lines = [*summary(FINISHED), *report(FINISHED).split("\n")]
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")


@query(values("key, kind", *((k, "dict" if isinstance(v, dict) else "list" if isinstance(v, list) else type(v).__name__) for k, v in FINISHED.items())))
def fingerprint_file(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the written fingerprint, read back."""
    back = json.loads(sinks.fingerprint_json(FINISHED))
    return spark.createDataFrame([(k, type(v).__name__) for k, v in back.items()], "key string, kind string")
