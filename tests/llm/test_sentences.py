import pytest

from voxcorpus.llm import sentences as S
from voxcorpus.llm.lexicon import count_pieces, learn
from voxcorpus.llm.sentences import sentence_spans, sentence_units, sentences

CASES = [
    ("Dr. Brown came at 1:30 p.m. and left. The call ends at 6 p.m. So what?", ["Dr. Brown came at 1:30 p.m. and left.", "The call ends at 6 p.m.", "So what?"]),
    ("By 6 a.m. Tuesday it rained. J. R. Smith wrote it (see sec. 5.3). We cut slogans, etc. Then it broke.",
     ["By 6 a.m. Tuesday it rained.", "J. R. Smith wrote it (see sec. 5.3).", "We cut slogans, etc.", "Then it broke."]),
    ('Ann said, "We trim. We ship." "Cut it. Go," Bo said. “Is it ours? Really?” Cy asked, and left.',
     ['Ann said, "We trim. We ship."', '"Cut it. Go," Bo said.', "“Is it ours? Really?” Cy asked, and left."]),
    ("The score (it was old!) went out. Well… maybe not. Then silence... Rain fell. Costs rose 3.5 percent, i.e. more.",
     ["The score (it was old!) went out.", "Well… maybe not.", "Then silence...", "Rain fell.", "Costs rose 3.5 percent, i.e. more."]),
    ("Am 9. Oktober kam Dr. Weiß. Es gibt Regeln, z. B. für Titel. Wir streichen usw. Das war im 4. Quartal!",
     ["Am 9. Oktober kam Dr. Weiß.", "Es gibt Regeln, z. B. für Titel.", "Wir streichen usw.", "Das war im 4. Quartal!"]),
    ("M. Petit arrive à 7 h. Voir p. ex. la page 7. « On coupe. On publie », dit Anne. Pourquoi pas ?",
     ["M. Petit arrive à 7 h.", "Voir p. ex. la page 7.", "« On coupe. On publie », dit Anne.", "Pourquoi pas ?"]),
    ("¿Quién va? ¡Qué frase! La Dra. Gil leyó la pág. 9.", ["¿Quién va?", "¡Qué frase!", "La Dra. Gil leyó la pág. 9."]),
    ("См. стр. 6 и рис. 1. Есть письма и т. д. Правка помогает, т. е. ясна.", ["См. стр. 6 и рис. 1.", "Есть письма и т. д.", "Правка помогает, т. е. ясна."]),
    ("Γιατί όχι σήμερα; Ο κ. Πάνος ήρθε. Τέλος!", ["Γιατί όχι σήμερα;", "Ο κ. Πάνος ήρθε.", "Τέλος!"]),
    ("“काटो। भेजो।” संपादक ने कहा। डॉ. राम आए। क्या यह सही है?", ["“काटो। भेजो।” संपादक ने कहा।", "डॉ. राम आए।", "क्या यह सही है?"]),
    ("هل هذا صوتنا؟ قرأ د. سامي 5.3 صفحات. نعم!", ["هل هذا صوتنا؟", "قرأ د. سامي 5.3 صفحات.", "نعم!"]),
    ("价格降了4.7%。“先删。再发。”编辑说。后来……没有人回答。“好。”", ["价格降了4.7%。", "“先删。再发。”编辑说。", "后来……没有人回答。", "“好。”"]),
    ("「削る。出す。」と彼は言った。第4版（Ver.3.1）が最後だ。長すぎる！", ["「削る。出す。」と彼は言った。", "第4版（Ver.3.1）が最後だ。", "長すぎる！"]),
    ("ใช้รุ่น 2.9 แล้ว เราแก้ไข 7 หน้าแล้ว ทำไมไม่ใช่วันนี้? เสียงของเรา", ["ใช้รุ่น 2.9 แล้ว", "เราแก้ไข 7 หน้าแล้ว", "ทำไมไม่ใช่วันนี้?", "เสียงของเรา"]),
    ("A heading\n\nOne line\nbroken in two. Next.\r\n \r\nLast", ["A heading", "One line\nbroken in two.", "Next.", "Last"]),
    ("One.Two follows. See a.example/start.html now.", ["One.", "Two follows.", "See a.example/start.html now."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert [text[a:b] for a, b in sentences(text)] == want


@pytest.mark.parametrize("text", [None, "", "  \n\t\n", "\xa0"])
def test_nothing(text):
    assert sentences(text) == []


@pytest.mark.parametrize("text", ["We go on! " * 20_000, "先删。再发。" * 20_000, "ไปเลย " * 20_000, '("' * 20_000, "x" * 500_000])
def test_long_texts_are_covered(text):
    got = sentences(text)
    assert "".join(text[a:b] for a, b in got).replace(" ", "") == text.replace(" ", "")
    assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))


def test_frames(spark):
    rows = [("c", 1, "notes/a.txt", "Go. Stop.", 1), ("c", 1, "notes/a.txt", "Go. Stop.", 2), ("c", 2, "notes/b.txt", None, 1),
            ("c", 3, None, "Out.", 1), (None, 4, "notes/c", "In", 1), ("c", 5, "drafts/x", "Out.", 1)]
    df = spark.createDataFrame(rows, "corpus_id string, doc_seq int, path string, text string, sent_start int")
    assert sorted(map(tuple, sentence_spans(df).collect()), key=str) == sorted([("c", 1, 0, 3), ("c", 1, 4, 9), (None, 4, 0, 2)], key=str)
    assert sentence_units(df).count() == 5 and sentence_spans(df.where("false")).count() == 0


def test_any_number_of_terminators_within_a_sentence():
    for n in (39, 41, 120, 3000):
        one = "Ann read the list (" + "it was old. We saw it. " * n + "so it went) and left."
        two = "See " + "J. R. Smith, " * n + "and others."
        text = f"It began. {one} {two} It ended."
        assert [text[a:b] for a, b in sentences(text)] == ["It began.", one, two, "It ended."]


@pytest.mark.parametrize("word", sorted(S._DICTIONARY - {"ๆ"}))
def test_each_word_of_the_dictionary_is_seen(word):
    assert S._edge_words(f"{word} {word}", len(word), len(word) + 1) == (word, word)


THAI = [
    ("เสียงของเรา และ ความจริง", ["เสียงของเรา และ ความจริง"]),
    ("เขาพูดชัด แต่ ข้อความยาว", ["เขาพูดชัด แต่ ข้อความยาว"]),
    ("ตัดคำออก หรือ เก็บไว้", ["ตัดคำออก หรือ เก็บไว้"]),
    ("เราส่งงานให้ Google แล้ว เมื่อวานเขาตอบ", ["เราส่งงานให้ Google แล้ว", "เมื่อวานเขาตอบ"]),
]


@pytest.mark.parametrize(("text", "want"), THAI)
def test_thai_words_with_marks(text, want):
    assert [text[a:b] for a, b in sentences(text)] == want


WITHOUT_TERMINATORS = [
    ("今天开会了\n但是没有人来\n我们明天再说吗\n标题太长", ["今天开会了", "但是没有人来\n我们明天再说吗", "标题太长"]),
    ("会議は昨日でした 明日は休みです\nしかし記録は続く", ["会議は昨日でした", "明日は休みです", "しかし記録は続く"]),
    ("这份草稿很长\n标题也很长。我们改了", ["这份草稿很长\n标题也很长。", "我们改了"]),
    ("品牌 Ruvenol 的价格（你好吗 我很好）降了", ["品牌 Ruvenol 的价格（你好吗 我很好）降了"]),
]


@pytest.mark.parametrize(("text", "want"), WITHOUT_TERMINATORS)
def test_chinese_and_japanese_without_terminators(text, want):
    assert [text[a:b] for a, b in sentences(text)] == want


def test_a_long_run_is_cut_as_a_whole():
    text = "字" * 200_000 + "了 但是" + "字" * 200_000
    assert len(sentences(text)) == 2


def test_blanks_of_scripts_with_full_stops_and_of_short_phrases():
    for text, want in (
        ("ສະບາຍດີ ເຈົ້າ ສະບາຍດີ ບໍ່", 1), ("ខ្ញុំទៅផ្សារ ហើយ ទិញ បាយ។ គាត់មកផ្ទះ", 2), ("မြန်မာ စာ ကောင်း သည်။ သူ လာ သည်။", 2), ("เราแก้ไขหน้าแล้ว เสียงของเราชัดเจน", 2),
    ):
        assert len(sentences(text)) == want, text


def test_a_lexicon_is_learned_and_decides_where_marks_are_missing(spark):
    told = [f"{a}は{b}を{c}。" for a in ("短文", "記録", "口調") for b in ("印象", "説明", "会議") for c in ("支える", "減らす", "示した")]
    rows = [(i, "".join(told[i % 27 :] + told[: i % 5]) + ("\n\n" if i % 2 else "")) for i in range(40)] + [(90, None), (91, ""), (92, "plain")]
    lexicon = learn(spark.createDataFrame(rows, "doc_seq int, text string"))
    words = lexicon.words("短文は印象を支える")
    assert "".join(words) == "短文は印象を支える" and 1 < len(words) < 6
    assert lexicon.closing[words[-1]] > 1 > lexicon.closing[words[0]] and lexicon.opening[words[0]] > 1 > lexicon.opening[words[-1]]
    text = "短文は印象を支える 記録は説明を減らす 口調は 会議を示した"
    assert [text[a:b] for a, b in sentences(text, lexicon)] == ["短文は印象を支える", "記録は説明を減らす", "口調は 会議を示した"]
    assert len(sentences(text)) == 1
    assert learn(spark.createDataFrame(rows[-3:], "doc_seq int, text string")) is None
    assert learn(spark.createDataFrame([], "doc_seq int, text string")) is None


def test_counts_of_pieces_against_a_plain_count(spark):
    texts = ["他们来了。他们走了！\n\n来了 12 走", "เรา 9 ไป", None, "了" * 3000]
    got = {(r["piece"], r["n"], r["ends"], r["begins"]) for r in count_pieces(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert {("他们", 2, 0, 2), ("来了", 2, 1, 1), ("走了", 1, 1, 0), ("走", 2, 1, 0), ("เรา", 1, 0, 1), ("ไป", 1, 1, 0), ("了", 3003, 3, 1)} <= got
