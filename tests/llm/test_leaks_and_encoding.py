"""Leaked evaluation items and garbled text."""

import random

import pytest

from voxcorpus.llm import encoding as E
from voxcorpus.llm import leaks as S

DOCS = "doc_id bigint, text string, item_id bigint, suite string"
ITEMS = "item_id bigint, text string, suite string"


def brute(document, item):
    """All alignments, all windows."""
    d, i = S.words(document), S.words(item)
    for offset in range(-len(i), len(d)):
        same = [0 <= offset + k < len(d) and d[offset + k] == w for k, w in enumerate(i)]
        for a in range(len(same)):
            for b in range(a + 13, len(same) + 1):
                if all(same[a:b]) or (
                    b - a >= 30 and same[a] and same[b - 1] and same[a:b].count(False) * 7 <= b - a
                    and not any(not x and not y for x, y in zip(same[a : b - 1], same[a + 1 : b]))
                ):
                    return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    stock = rng.choices(vocab, k=9)
    items = [(i, " ".join(stock + rng.choices(vocab, k=rng.randrange(30, 60))).capitalize() + ".", "s") for i in range(12)]
    items += [(99, items[0][1], "s"), (50, "too short", "s"), (51, None, "s"), (52, "", "s")]
    docs = []
    for n in range(140):
        words = rng.choices(vocab, k=rng.randrange(40))
        source = rng.choice(items[:12])[1].split()
        kind = n % 5
        if kind == 0:
            k = rng.choice([11, 12, 13, 14, 20])
            at = rng.randrange(len(source) - k)
            part = source[at : at + k]
        elif kind == 1:
            step = rng.choice([4, 6, 7, 8, 9])
            part = [("other" if k % step == step - 1 else w) for k, w in enumerate(source)]
        elif kind == 2:
            part = [w.upper() + rng.choice(["", ",", " —", "\n"]) for w in source]
        else:
            part = rng.sample(source, len(source)) if kind == 3 else []
        docs.append((n, " ".join(words[: len(words) // 2] + part + words[len(words) // 2 :]), 1, "x"))
    docs += [(900, None, 1, "x"), (901, "", 1, "x"), (902, " ".join(vocab) * 3000, 1, "x"), (3, docs[3][1], 1, "x")]
    want = {(d, i) for d, t, _, _ in docs if t and len(t) < 5000 for i, u, _ in items if u and brute(t, u)}
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = [tuple(r) for r in S.find_leaks(df, it).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 30
    report = {r["item_id"]: r["documents"] for r in S.leaked_items(df, it).collect()}
    assert report[50] == 0 and report[0] == report[99] == sum(1 for _, i in want if i == 0)
    assert S.find_leaks(df, it.where("false")).count() == S.find_leaks(df.where("false"), it).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item {i} " + " ".join(f"t{i}x{k}" for k in range(20)), "s") for i in range(9)], ITEMS)
    docs = spark.createDataFrame([(i, r["text"], 0, "") for i, r in enumerate(items.collect())], DOCS)
    monkeypatch.setattr(S, "BLOCK_ITEMS", 4)
    assert sorted(map(tuple, S.find_leaks(docs, items).collect())) == [(i, i) for i in range(9)]


CLEAN = {
    1: "Die Gründerin hört größere Wünsche über den Büros.", 2: "Le café préféré était à côté, déjà fermé.", 3: "Правка помогает читателю без лишнего шума сегодня вечером.",
    4: "Don’t say “never” — it’s 20 °C.", 5: "短い文は読者の印象を静かに支える。記録は長い説明を減らす。",
}


@pytest.mark.parametrize(
    ("doc", "right", "wrong"),
    [
        (1, "utf-8", "cp1252"), (1, "utf-8", "latin-1"), (1, "utf-8", "mac_roman"), (1, "utf-8", "cp850"), (2, "utf-8", "cp1252"),
        (3, "utf-8", "cp1251"), (3, "utf-8", "cp866"), (3, "cp1251", "latin-1"), (3, "koi8-r", "cp1251"), (4, "utf-8", "cp1252"),
        (5, "utf-8", "latin-1"), (5, "shift_jis", "latin-1"), (5, "utf-8", "mac_roman"),
    ],
)
def test_round_trip_of_words(doc, right, wrong):
    for word in CLEAN[doc].split():
        bad = E.garble(word, right, wrong)
        assert bad is None or E.ungarble(bad, right, wrong) == word


def test_found_and_restored(spark):
    rows, want, lossless = [], set(), {}
    n = 100
    for k, text in CLEAN.items():
        rows += [(k * 10 + j, text, 0, "") for j in range(3)]  # the corpus holds its clean words
        for right, wrong in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1252", "utf-8")):
            bad = E.garble(text, right, wrong)
            if bad is None or bad == text or (wrong == "utf-8" and "\ufffd" not in bad):
                continue
            n += 1
            rows.append((n, "plain words before. " + bad, 0, ""))
            want.add(n)
            if wrong != "utf-8":
                lossless[n] = "plain words before. " + text
    twice = E.garble(E.garble(CLEAN[2], "utf-8", "cp1252"), "utf-8", "cp1252")
    rows += [(500, twice, 0, ""), (501, None, 0, ""), (502, "", 0, ""), (503, "NÃO ACEITA À NOITE. Âge d’or : « oui »", 0, ""), (504, "ascii only", 0, "")]
    want.add(500)
    df = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"] for r in E.garbled_documents(df).collect()} == want
    back = {r["doc_id"]: r for r in E.restored_documents(df).collect()}
    assert set(back) == want
    right = sum(back[k]["text"] == t for k, t in lossless.items())
    assert right >= 0.9 * len(lossless)
    assert E.garbled_documents(df.where("false")).count() == 0


def test_a_garbled_text_in_many_copies(spark):
    bad = E.garble("Привет читателям", "cp1251", "latin-1")
    rows = [(1, "Привет читателям", 0, ""), (2, "Привет! Ещё одно слово", 0, "")] + [(10 + k, bad, 0, "") for k in range(9)]
    rows += [(30 + k, f"{bad.split()[0]} {k}", 0, "") for k in range(4)]  # garbled in more texts than clean
    df = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"] for r in E.garbled_documents(df).collect()} == {r[0] for r in rows[2:]}
    back = {r["doc_id"]: r["text"] for r in E.restored_documents(df).collect()}
    assert back[10] == "Привет читателям" and back[30] == "Привет 0"


SHORT = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "koi8-r"), ("utf-8", "cp866"),
    ("utf-8", "gbk"), ("utf-8", "shift_jis"), ("euc_jp", "latin-1"), ("euc_kr", "cp1252"),
]


def test_short_pieces_and_long_words(spark):
    clean = "東京都の天気はとても良いです"
    rows, want = [(1, clean, 0, ""), (2, "Straßen" + "öäü" * 30, 0, ""), (3, "x" + "äöü" * 8 + "y", 0, ""), (4, "한국 ไทยแลนด์ Привет", 0, "")], set()
    for k, (right, wrong) in enumerate(SHORT, 10):
        for n, term in enumerate(("東京", "東京都", clean)):
            if bad := E.garble(term, right, wrong):
                rows.append((k * 10 + n, f"Plain words about {bad} and more.", 0, ""))
                want.add(k * 10 + n)
    for k, (text, wrong) in enumerate([(rows[1][1], "cp1252"), ("z" + "äöü" * 8 + "w", "cp1252"), ("ไทย", "cp1252"), ("Привет", "gbk")], 900):
        rows.append((k, "Words " + E.garble(text, "utf-8", wrong), 0, ""))
        want.add(k)
    rows.append((950, "on " + E.garble(E.garble("東京", "utf-8", "cp1252"), "utf-8", "cp1252"), 0, ""))
    want.add(950)
    got = {r["doc_id"] for r in E.garbled_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want


def test_a_longer_stretch_of_which_only_stock_phrases_are_left():
    head, tail = [f"h{k}" for k in range(6)], [f"t{k}" for k in range(8)]
    items = [(n, " ".join(head + [f"i{n}x{k}" for k in range(21)] + tail)) for n in range(3)]
    left = [("other" if k in (7, 12, 17, 22, 27) else w) for k, w in enumerate(items[0][1].split(), 1)]
    text = "Before it. " + " ".join(left) + " After it."
    assert brute(text, items[0][1]) and not brute(text, items[1][1])
    assert S.Index(items).search([text]) == [(0, 0)]


def test_what_is_left_out_loses_no_leak():
    """Items of one stock text: all their shingles are shared, so as many as may be are left out. Any run and any
    stretch with the most others allowed, wherever they stand, is still found."""
    rng = random.Random(8)
    stock = [f"s{k}" for k in range(70)]
    items = [(n, " ".join(stock[:60 + n])) for n in range(4)]
    index = S.Index(items)
    assert len(index.item) < sum(60 + n - 4 for n in range(4))
    for k in range(58):
        assert {i for _, i in index.search([" ".join(["a"] + stock[k : k + 13] + ["b"])])} == {n for n, _ in items if k + 13 <= 60 + n}
    for _ in range(400):
        size = rng.choice([30, 34, 35, 36, 41, 42, 48, 49, 56, 60])
        begin = rng.randrange(60 - size + 1)
        part = stock[begin : begin + size]
        if rng.random() < 0.5:  # evenly: every sixth or seventh
            step = rng.choice([6, 7])
            gone = list(range(rng.randrange(1, step), size - 1, step))
        else:
            gone = rng.sample(range(1, size - 1), size // 7)
        gone = [g for g in gone if g - 1 not in gone][: size // 7]
        text = " ".join("other" if k in gone else w for k, w in enumerate(part))
        want = {n for n, t in items if brute(text, t)}
        assert {i for _, i in index.search([text])} == want and want


@pytest.mark.parametrize(("right", "wrong"), [c for c in E.CHAINS if c[1] != "utf-8"])
def test_texts_are_turned_back_under_every_chain(right, wrong):
    """Of the texts a chain can garble without loss, at least nine in ten come back whole. Cyrillic in Shift-JIS
    is left out: half of its bytes stay ASCII, which is a limit the README names."""
    done = []
    for text in (t for k, t in CLEAN.items() if (k, right) != (3, "shift_jis")):
        bad = E.garble(text, right, wrong)
        if bad is None or bad == text or E.ungarble(bad, right, wrong) != text:
            continue
        known = {}
        for token, kind in E.tokens(text):
            form = E.garble(token, right, wrong)
            if form and form != token and (kind == E.WORD or len(form) > 2):
                known[form] = token, f"{right}>{wrong}"
        if known:
            done.append(E.repair(f"Plain words before.\n{bad}\nAnd after.", known) == f"Plain words before.\n{text}\nAnd after.")
    assert sum(done) >= 0.9 * len(done)


def test_garbled_text_under_a_null_number(spark):
    bad = E.garble("Привет читателям", "utf-8", "cp1252")
    rows = [(1, "Привет читателям", 0, ""), (None, bad, 0, ""), (3, bad, 0, ""), (3, bad, 0, ""), (4, None, 0, ""), (5, "x" * 200_000 + " é " * 1000, 0, "")]
    df = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"item_id": "h", "suite": "token"})
    assert {r["doc_id"] for r in E.garbled_documents(df).collect()} == {None, 3}
    back = E.restored_documents(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == [(0, "Привет читателям"), (3, "Привет читателям")]
