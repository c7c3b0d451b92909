"""Main body of pages and repeated lines."""

from collections import defaultdict
import random

import pytest

from voxcorpus.llm import boilerplate
from voxcorpus.llm.boilerplate import Page, frame_lines, page_bodies, page_frames
from voxcorpus.llm.site_lines import repeated_lines, without_repeated_lines

SCHEMA = "corpus_id string, doc_seq int, path string, title string, text string, loaded_at int, h int, site string"
WORDS = "harbour morning paper quiet letter window garden bridge answer market silver winter road music river story".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6, 12))).capitalize() + ", as ever."


def make_page(rng, i):
    """(text, numbers of the frame's lines, title) of a page of one site."""
    lines, frame = [], set()

    def put(text, is_frame=False):
        lines.append(text)
        if is_frame and text:
            frame.add(len(lines))

    for x in ("Home", "Blog", "Team", "Contact us"):
        put(x, True)
    put(f"Home / Blog / Post number {'x' * i}", True)
    put("")
    title = f"A {rng.choice(WORDS)} title {'x' * i}"
    put(title)
    put("By Ada Example")
    for _ in range(3):
        put(" ".join(sentence(rng) for _ in range(3)))
        if rng.random() < 0.5:
            put("12 shares", True)
            put(f"Next: Another {rng.choice(WORDS)} post {rng.choice(WORDS)}", True)
        put("")
    put("12 shares", True)
    put("Keep reading", True)
    put(f"The {rng.choice(WORDS)} behind the {rng.choice(WORDS)}", True)
    put(f"Bo: {sentence(rng)[:40]} …", True)
    put("Sign up for the letter.", True)
    put("All rights reserved.", True)
    return "\n".join(lines), frame, title


@pytest.fixture(scope="module")
def site(spark):
    rng = random.Random(1)
    made = {i: make_page(rng, i) for i in range(1, 21)}
    rows = [("c", i, f"{'WWW.' * (i % 2)}Ex.example/p/{i}", h, t, 1, 7, "z") for i, (t, _, h) in made.items()]
    rows += [("c", 1, "www.ex.example/p/1", made[1][2], made[1][0], 2, 7, "z"), ("c", 90, "ex.example/n", None, None, 1, 1, ""),
             ("c", 91, None, None, "x\ny", 1, 1, ""), ("c", 92, "ex.example/e", None, "", 1, 1, ""), ("c", 93, "notes/x", None, "Home", 1, 1, "")]
    return spark.createDataFrame(rows, SCHEMA), {i: f for i, (_, f, _) in made.items()}


def test_page_frames(site):
    df, want = site
    got = defaultdict(set)
    for r in page_frames(df).collect():
        got[r["doc_seq"]].add(r["line_no"])
    assert dict(got) == want
    bodies = {r["doc_seq"]: r["text"] for r in page_bodies(df).collect()}
    assert len(bodies) == 21 and "Sign up" not in bodies[3] and "By Ada Example" in bodies[3]


def test_pages_alone():
    assert frame_lines("", None, [], [], {}) == [] and frame_lines("\n \n", "t", [None] * 3, [None] * 3, {}) == []
    text = "Title\n\n" + "Word here. " * 50_000
    assert frame_lines(text, "Title", [1, None, 2], [None] * 3, {}) == []


def test_no_pages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert page_frames(empty).count() == repeated_lines(empty).count() == without_repeated_lines(empty).count() == 0


def test_repeated_lines_against_brute_force(site):
    df, _ = site
    docs = {}
    for r in df.collect():
        if r["path"] and "." in r["path"].split("/")[0] and r["text"] is not None:
            docs[r["doc_seq"]] = r["text"]
    letters = lambda s: "".join(c for c in s if c.isalpha()).lower()
    on = defaultdict(set)
    for k, t in docs.items():
        for line in t.split("\n"):
            on[letters(line)].add(k)
    want = {(k, n) for k, t in docs.items() for n, line in enumerate(t.split("\n"), 1) if letters(line) and len(on[letters(line)]) >= 6}
    assert {(r["doc_seq"], r["line_no"]) for r in repeated_lines(df).collect()} == want
    clean = {r["doc_seq"]: r for r in without_repeated_lines(df).collect()}
    assert clean[2]["removed"] == sum(1 for k, _ in want if k == 2) and "12 shares" not in clean[2]["text"]


def test_points_pass_to_parent_and_grandparent():
    """Two regions of paragraphs with a wall of links between: the better one is the container, the other is kept as its
    sibling; a region of single lines behind it is not."""
    long = "The harbour wakes, the boats leave, the town sleeps. Nobody speaks, nobody waits. " * 3
    wall = ["Home | Blog | Team | Contact", "A | B | C | D"]
    lines = ["A title", "", long, long, "", *wall, "", long, "", *wall, "", "Teaser one", "Teaser two"]
    page = Page(lines, [0.0] * len(lines), [0.0] * len(lines), "A title")
    assert page.body() == {0, 2, 3, 8}
    scored = Page(["One, two, three. Four, five."] + [""] + ["Home | Blog | Team"], [0.0] * 3, [0.0] * 3, None)
    assert scored.link_density([0]) == 0 and scored.link_density([0, 2]) == 0.5 and scored.points(0) > 4 > scored.points(2) == 0


def test_lines_decided_by_their_share_are_not_measured_again():
    """Sentences are not counted in a line of a share of 0.2 or more, rows of links not looked for from 0.6 on: the
    outcome is the same as if they were, whatever else such a line holds."""
    rng = random.Random(4)
    for _ in range(300):
        lines = [rng.choice(["Home | Blog | Team", "Words here. More words follow, as ever.", "Short", "By Ada", ""]) for _ in range(12)]
        share = [rng.choice([0.0, 0.1, 0.2, 0.3, 0.5, 0.6, 0.9]) for _ in lines]
        page = Page(lines, share, [0.0] * 12, "Short")
        full = Page(lines, share, [0.0] * 12, "Short")
        full.breaks = [len(boilerplate._SENTENCE.findall(x)) for x in full.lines]
        full.paragraphs = [full._paragraph(i) for i in range(12)]
        full.density = [max(full.share[i], 1.0 if full._row_of_links(i) else 0.0) if full.lines[i] else 0.0 for i in range(12)]
        assert page.body() == full.body()
