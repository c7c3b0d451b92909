"""Text functions, files and addresses."""

from pyspark.sql import functions as F
import pytest

from voxcorpus.functions import text as T
from voxcorpus.functions import url as U
from voxcorpus.sources.folder import read_folder
from voxcorpus.sources.pages import normalize_url


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a  b\n \n\n c d ", "a b\n\nc d"), ("", ""), ("\n\n", ""), (None, None), ("x" * 100_000, "x" * 100_000),
    ],
)
def test_normalize_whitespace(spark, text, want):
    assert one(spark, T.normalize_whitespace, text) == want


def test_words_and_noise(spark):
    assert one(spark, T.words, "It's a well-known TEST, naïve ’tis") == ["it's", "well-known", "test", "na", "ve", "tis"]
    assert one(spark, T.words, None) == []
    got = {w: one(spark, T.is_display_noise, w) for w in ("it's", "www", "abc", "plain")}
    assert got == {"it's": True, "www": True, "abc": True, "plain": False}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I love coding. You should too. It's great!", ["I love coding.", "You should too.", "It's great!"]),
        ('He said "Stop!" Then left...  Why?', ['He said "Stop!"', "Then left...", "Why?"]),
        ("   ", []), ("", []), ("No mark", ["No mark"]),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, T.sentences, text) == want


def test_usable(spark):
    cases = {"one two three": True, "one two": False, "w " * 61: False, "a b " + "c" * 500: False, "a b\n\nc d": False}
    assert {s: one(spark, T.is_usable_sentence, s) for s in cases} == cases


def test_markdown(spark):
    text = "Intro\n# The Title \n\nSee [this](http://x.y) and `code` **bold**\n## Next"
    assert one(spark, T.markdown_heading, text) == "The Title"
    assert one(spark, T.strip_markdown, text) == "Intro\nThe Title \n\nSee this and code **bold**\nNext"


@pytest.mark.parametrize(
    ("line", "want"),
    [("Home → Blog → Post", True), ("a | b", False), ("x | " + "y" * 70 + " | z", False), (None, False), ("plain", False)],
)
def test_trail(spark, line, want):
    assert one(spark, T.is_trail, line) is want


def test_urls(spark):
    assert one(spark, U.normalize, "HTTPS://WWW.Ex.com/foo/?q=1#x") == "https://www.ex.com/foo/"
    assert one(spark, U.normalize, "https://ex.com") == "https://ex.com/"
    assert one(spark, U.normalize, "/relative") == ""
    paths = ["/", "/about", "/about/team", "/blog", "/blog/post", "/pricing", "/contact", "/blogger"]
    assert [one(spark, U.priority, p) for p in paths] == [10, 8, 8, 6, 5, 4, 2, 2]
    skips = ["/api/v1/thing", "/assets/img.png", "/wp-login.php", "/static/main.js", "/", "/about", "/blog/post-slug"]
    assert [one(spark, U.should_skip, p) for p in skips] == [True] * 4 + [False] * 3


HREFS = ["b.html", "/r?x", "//o.com/z", "../about", "./x", "../../../y/", "a/./b/../c", "..", ".", "/a//b", "/a/../../c", "#top", "?q=1", "", "x/..",
         "https://Ex.com/a/../b", "/blog/", "p;v=1", "../a?b=../c#../d"]


@pytest.mark.parametrize("base", ["https://Ex.com/a/c.html", "https://ex.com", "https://ex.com/blog/a/post", "http://ex.com/blog/"])
def test_resolve_as_the_standard_library(spark, base):
    df = spark.createDataFrame([(h, base) for h in HREFS], "h string, b string")
    got = [r[0] for r in df.select(U.resolve(F.col("h"), F.col("b"))).collect()]
    assert got == [normalize_url(h, base) for h in HREFS]


def test_folder(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "post.md").write_text("# A Post\n\nSome **bold** text with a [link](http://x.y) in it.")
    (tmp_path / "sub dir" / "page.html").write_text("<title>t</title><style>p{}</style><h1>Head</h1><p>Body text of the page</p><script>var x</script>")
    (tmp_path / "note.txt").write_text("First line\n\nAnd a paragraph after it.")
    (tmp_path / "long.txt").write_text("w" * 300)
    (tmp_path / "tiny.md").write_text("hi\n")
    (tmp_path / "skip.pdf").write_text("x" * 100)
    (tmp_path / ".drafts").mkdir()
    (tmp_path / ".drafts" / "_hidden.txt").write_text("A hidden file\n\nwith a paragraph in it.")
    rows = read_folder(spark, str(tmp_path)).collect()
    assert [(r["doc_seq"], r["path"], r["title"]) for r in rows] == [
        (1, ".drafts/_hidden.txt", "A hidden file"), (2, "long.txt", "long"), (3, "note.txt", "First line"), (4, "post.md", "A Post"),
        (5, "sub dir/page.html", "Head"),
    ]
    assert rows[4]["text"] == "t Head Body text of the page"
    assert "`" not in rows[3]["text"] and "http" not in rows[3]["text"]
