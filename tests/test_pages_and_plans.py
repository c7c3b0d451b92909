"""Pages, crawl, pipeline, sinks, command line, streaming and the entry points."""

import http.server
import importlib
import json
import threading

import pytest

from voxcorpus.cli import main
from voxcorpus.functions.html import page_content
from voxcorpus.operators.vocabulary import baseline_from
from voxcorpus.plans.fingerprint import fingerprint
from voxcorpus.sources import pages as P
from voxcorpus.sources import sinks
from voxcorpus.streaming.cadence import windowed_cadence

PROSE = "The harbour wakes before the town does, and the first boats are out while the streets are still dark and quiet. " * 4


def test_page_content():
    links = "<div>" + "".join(f"<a href='/{i}'>link number {i}</a>" for i in range(8)) + "</div>"
    assert page_content(f"<body><main>{links}</main></body>") is None
    assert page_content("<main></main>") is None and page_content(None) is None and page_content("") is None
    title, text = page_content(
        f"<title>Post</title><nav>Menu</nav><main><div>Home → Blog → Post</div><div class='canvas'>gone</div>"
        f"<article><h1>Head</h1><p>{PROSE}<b>open<p>{PROSE}</article></main><footer>Foot</footer>"
    )
    assert title == "Post" and "→" not in text and "Foot" not in text and "gone" not in text and len(text.split()) > 100


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id bigint, url string, html string, status_code int")


def test_links_and_crawl(spark):
    body = f"<main><p>{PROSE}</p><a href='/blog/a'>a</a> <a href=\"/about\">b</a> <a href='/x.pdf'>c</a> <a href='http://o.com/'>o</a><a href='/about'>again</a></main>"
    p = pages(spark, (1, "https://Ex.com/", body, 200), (2, "https://ex.com/about", f"<main><h1>About</h1><p>{PROSE}</p></main>", 200),
              (3, "https://ex.com/blog/a", None, 200), (4, None, None, None), (5, "https://ex.com/gone", body, 404))
    links = {(r["page_id"], r["position"], r["link"]) for r in P.page_links(p).collect()}
    assert {x for x in links if x[0] == 1} == {(1, 0, "https://ex.com/blog/a"), (1, 1, "https://ex.com/about")}
    docs = P.crawl(spark, "https://ex.com", P.table_fetcher(p, "ex.com")).collect()
    assert [(r["doc_seq"], r["path"]) for r in docs] == [(1, "/"), (2, "/about")]
    assert P.crawl(spark, "https://ex.com", P.table_fetcher(p, "ex.com"), max_pages=1).count() == 1
    assert P.crawl(spark, "nothing", P.table_fetcher(p, "ex.com")).count() == 0
    assert [r["page_id"] for r in P.page_documents(p).orderBy("page_id").collect()] == [1, 2]
    order = [(r["page_id"], r["place"]) for r in P.crawl_order(p).orderBy("place").collect()]
    assert order == [(1, 1), (2, 2), (3, 3), (5, 4)]


def test_crawl_over_http(spark):
    body = f"<main><p>{PROSE}</p><a href='/old'>a</a> <a href='../gone'>b</a> <a href='/pic'>c</a> <a href='/private/x'>d</a></main>"
    answers = {"/": (200, "text/html", body), "/new": (200, "text/html; charset=latin-1", f"<main><p>{PROSE} café</p></main>"), "/pic": (200, "image/png", "x"),
               "/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /private/")}
    asked = []

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["User-Agent"]))
            if self.path == "/old":
                self.send_response(301)
                self.send_header("Location", "/new")
                self.end_headers()
                return
            status, kind, text = answers.get(self.path, (404, "text/html", ""))
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(text.encode("latin-1"))

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        docs = P.crawl(spark, f"http://127.0.0.1:{server.server_port}/", P.http_fetcher("tester", 5.0)).collect()
    finally:
        server.shutdown()
    assert [(r["path"], "café" in r["text"]) for r in docs] == [("/", False), ("/old", True)]
    assert ("/new", "tester") in asked and not any(p.startswith("/private") for p, _ in asked)


def test_a_table_is_asked_for_several_pages_at_once(spark):
    links = "".join(f"<a href='/p{i}'>x</a>" for i in range(8))
    rows = [(0, "http://e.com/", f"<main><p>{PROSE}</p>{links}</main>", 200)] + [(i + 1, f"http://e.com/p{i}", f"<main><p>{PROSE}</p></main>", 200) for i in range(8)]
    fetch = P.table_fetcher(pages(spark, *rows), "e.com")
    looked = []
    inner = fetch.prefetch
    fetch.prefetch = lambda urls: (looked.append([u for u in urls if u not in fetch.held]), inner(urls))
    assert P.crawl(spark, "http://e.com/", fetch).count() == 9
    assert len([x for x in looked if x]) == 3  # robots, the root, all others


@pytest.fixture(scope="module")
def measured(spark):
    text = "We build careful infrastructure. You can trust our careful infrastructure! Is the work careful? " * 6
    docs = spark.createDataFrame([("c", i, f"p{i}", "t", text + PROSE) for i in range(3)], "corpus_id string, doc_seq int, path string, title string, text string")
    return fingerprint(spark, docs, baseline_from(docs), "Brand", "folder:x")


def test_fingerprint(measured):
    f = measured
    assert f["doc_count"] == 3 and f["thin_corpus"] and f["cadence"]["sentence_count"] > 20
    assert f["voice"]["closest_to_centroid"][0]["distance"] <= f["voice"]["farthest_from_centroid"][0]["distance"]
    assert f["voice"]["top_vocab"][0] == ["careful", 54]
    assert f["tone"]["primary_tone"] in f["tone"]["tone_scores"]
    assert set(f["timings_ms"]) == {"cadence", "voice", "clusters", "forbidden", "tone"}


def test_empty_fingerprint(spark, tmp_path):
    docs = spark.createDataFrame([], "corpus_id string, doc_seq int, text string")
    f = fingerprint(spark, docs, spark.createDataFrame([("a", 1, 1.0, 1)], "token string, cnt bigint, rate double, rnk int"))
    assert f["empty"] and sinks.brand_config(f)["empty"] and "empty" in sinks.style_prompt(f)


def test_sinks(measured, tmp_path):
    path = sinks.write_fingerprint(measured, tmp_path / "new" / "f.json")
    assert path.is_absolute() and json.loads(path.read_text())["brand_name"] == "Brand"
    config = json.loads(sinks.write_brand_config(measured, tmp_path / "c.json").read_text())
    lo, hi = config["cadence"]["target_range"]
    assert config["schema_version"] == "0.1" and 3 <= lo < hi and len(config["exemplar_sentences"]) <= 5
    prompt = sinks.write_style_prompt(measured, tmp_path / "p.md").read_text()
    assert prompt.startswith("# Brand: how it sounds") and "## Figures" in prompt and "against baseline" in prompt
    assert sinks.shortened("x" * 300) == "x" * 217 + "..." and sinks.shortened(" a\nb ") == "a b"


def test_command_line(spark, tmp_path, capsys):
    assert main([], spark) == 1 and main(["--url", "x", "--folder", "y"], spark) == 1
    (tmp_path / "in").mkdir()
    cache = ["--baseline-cache", str(tmp_path / "cache" / "b.parquet")]
    assert main(["--folder", str(tmp_path / "in"), *cache], spark) == 1 and "no baseline" in capsys.readouterr().err
    (tmp_path / "general").mkdir()
    (tmp_path / "general" / "g.txt").write_text("Plain words of general writing, as people write them every day. " * 9)
    build = ["--baseline-texts", str(tmp_path / "general"), *cache]
    assert main(["--folder", str(tmp_path / "in"), *build], spark) == 1 and "no documents" in capsys.readouterr().err
    (tmp_path / "in" / "a.md").write_text("# Title\n\n" + PROSE)
    assert main(["--folder", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--inspect", *cache], spark) == 0
    assert json.loads((tmp_path / "out" / "brand-config.json").read_text())["baseline_corpus"] == "general"
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"voice-fingerprint.json", "brand-config.json", "style-prompt.md"}
    assert "3,000 words" in capsys.readouterr().out


def test_streaming(spark, tmp_path):
    rows = [("c", 1, "One two three four five six. Short.", "2024-01-01 10:00:00"), ("c", 2, "Again here.", "2024-01-01 12:00:00")]
    df = spark.createDataFrame(rows, "corpus_id string, doc_seq int, text string, t string").selectExpr("corpus_id", "doc_seq", "text", "timestamp(t) fetched_at")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_cadence(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("cadence_stream").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("cadence_stream").first()
    assert (r["sentence_count"], r["word_count"]) == (3, 9)


def test_entry_points():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 40
