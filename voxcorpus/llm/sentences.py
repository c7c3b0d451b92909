"""Sentences of texts in any language and script.

Method. Blank lines part paragraphs. Within a paragraph of a spaced script every
terminator with its closing marks is a node of a lattice; an edge is a sentence from one
node to another. A node's score says how much it looks like an end (abbreviations,
initials, ordinals, times, the word that follows), and pays for brackets and quotations
it cuts open. The best path is found by dynamic programming; an edge may pass any number of nodes.

Scripts without blanks between words are cut into words first: a lattice over a dictionary,
unknown runs between the words, fewest costs win. The gaps (blanks; in Chinese and Japanese
terminators too) are then classified by the word before (final particles) and the word after
(opening words). Chinese and Japanese terminators other than dots decide by themselves.

The dictionary is learned from the collection (``lexicon.py``) beside a fixed list of function
words, and with it how much each word speaks for an end before or a beginning behind it: by
how often it stands at the sure ends of the collection (full stops of its script, paragraphs).

Segmentation is pure Python on one text; texts are never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcorpus.llm.common import KEY, flat_map, in_folder
from voxcorpus.llm.lexicon import Lexicon, learn

# Abbreviations, without their last full stop, in lower case.
#: Stand before a name or a figure and never end a sentence.
LEADING = frozenset(
    """mr mrs ms dr prof st mt fr rev hon capt col gen lt sgt gov sen rep pres no nos fig figs pp p vol vols ch sec
    secs eq eqs art cf vs v viz approx est ca ed eds ref refs tab e.g i.e al jan feb mar apr jun jul aug sep sept
    oct nov dec mon tue wed thu fri sat sun messrs mme mmes mlle mlles m mm nr abb abs bd hrsg hr frl bzw z d z.b
    d.h u.a vgl s evtl ggf inkl max min tel zzgl sr sra srta dra dña ud uds pág págs núm p.ej p.ex av env
    n art chap éd vol г ул д стр рис см им т т.е гл п пп ред проф акад др κ κα κος δρ π.χ δηλ αρ σελ βλ डॉ श्री पं
    प्रो د أ م ص st.e""".split()
)
#: May end a sentence; they do if a sentence can begin after them.
FINAL = frozenset(
    """etc inc ltd co corp llc plc bros jr sr. esq ph.d m.d b.a m.a d.c u.s u.k u.n e.u a.m p.m usw u.s.w ua usf
    т.д т.п др г гг руб κ.λπ κλπ κ.ά c.v s.a s.l gmbh dept univ assn""".split()
)
#: Second parts of abbreviations written apart ("z. B.", "т. д."), by their first part.
PAIRS = {
    "z": ("b",), "d": ("h",), "u": ("a", "u"), "i": ("d", "e"), "e": ("g",), "p": ("ex", "ej", "s", "m"),
    "т": ("е", "д", "п", "к", "н"), "и": ("о",), "s": ("o", "u"), "a": ("m",), "o": ("ä",),
}
#: Of these the last may end a sentence.
PAIRS_FINAL = frozenset(("т д", "т п", "a m", "p m"))
#: Words of time that continue "6 a.m.".
TIMES = frozenset(
    """monday tuesday wednesday thursday friday saturday sunday january february march april may june july august
    september october november december est edt pst pdt gmt utc cet""".split()
)
#: Words before a German ordinal.
ORDINAL_LEADS = frozenset("am vom zum im den dem der die das des beim bis seit ab ins und jeder jede jedes dieser".split())
GERMAN_MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember quartal jahrhundert".split()
)
#: Begin a sentence even in lower case, after an abbreviation that may end one.
SUBJECTS = frozenset("i you he she it we they there ich er sie es wir il elle nous on ils elles".split())
#: Verbs that report a quotation (stems).
REPORTING = re.compile(
    r"\b(?:said|says|say|asked|asks|wrote|writes|replied|added|answered|told|thought|called|shouted|cried|whispered|explained|"
    r"insisted|noted|warned|sagte|sagt|fragte|fragt|schrieb|meinte|rief|antwortete|erklärte|dit|disait|demanda|demande|"
    r"écrit|répondit|répond|ajouta|dijo|dice|preguntó|pregunta|escribió|respondió|añadió|disse|diz|perguntou|escreveu|"
    r"respondeu|сказал\w*|говорит|спросил\w*|написал\w*|ответил\w*|добавил\w*|είπε|λέει|ρώτησε|έγραψε|απάντησε)\b"
    r"|कहा|पूछा|लिखा|बोल|قال|قالت|سأل|كتب|أجاب",
    re.I,
)
#: Chinese and Japanese words right after a quotation, up to the next mark, that report it.
REPORTING_CJK = re.compile(r"^(?:と|って|という|との)|^[^。！？!?…，、]{0,12}(?:说|說|问|問|道|写|寫|回答|表示|喊|答)")

# A dictionary of function words for the lattices of spaceless scripts.
#: Close a sentence.
CLOSING_WORDS = frozenset(
    """แล้ว ครับ ค่ะ คะ นะ จ้ะ จ้า เลย ไหม หรือไม่ หรือยัง เหรอ มั้ย ด้วย วันนี้ พรุ่งนี้ เสมอ ກໍ ແລ້ວ ເດີ ບໍ
    ហើយ ទេ ណា သည် တယ် ပါ ပြီ လား 了 吗 呢 吧 啊 呀 嘛 啦 哦 です ます だ した ました でした ない る か ね よ な ぞ""".split()
)
#: Open a sentence.
OPENING_WORDS = frozenset(
    """ทำไม เรา ผม ฉัน เขา เธอ มัน พวกเขา ใคร อะไร เมื่อ ถ้า หาก แม้ ดังนั้น อย่างไรก็ตาม นอกจากนี้ การ ความ ทุก ผู้ นัก
    ใช้ ยัง ຂ້ອຍ ເຮົາ ខ្ញុំ យើង ကျွန်တော် 我 我们 你 他 她 它 这 那 这份 为什么 但是 然而 所以 因此 如果 后来 于是
    私 私たち 彼 彼女 この その あの なぜ しかし だから もし また そして""".split()
)
#: Go on with a sentence.
CONTINUING_WORDS = frozenset(
    """และ หรือ แต่ ที่ ซึ่ง อัน ว่า กับ ของ เพราะ จึง ก็ ๆ ฯลฯ ແລະ ຫຼື ທີ່ និង ឬ ដែល နှင့် 和 或 与 と や が を に は
    の で から まで より""".split()
)
#: Say nothing about a gap; they end like words that do.
OTHER_WORDS = frozenset("กว่า หน้าที่ เจ้าหน้าที่ พื้นที่ สถานที่ ทันที่ เต็มที่".split())
_DICTIONARY = CLOSING_WORDS | OPENING_WORDS | CONTINUING_WORDS | OTHER_WORDS
_LONGEST = max(map(len, _DICTIONARY))
#: Runs between blanks, punctuation and symbols. Vowel signs and tone marks are no word characters to ``re``, but
#: belong to the words.
_STRETCH = re.compile(
    "[^\\s\U0001f000-\U0001faff"
    + "".join(f"\\u{c:04x}" for c in range(0x10000) if unicodedata.category(chr(c))[0] in "PSZ")
    + "]+"
)

_BLANK_LINES = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_BLANKED = re.compile("[฀-໿က-႟ក-៿]")
_THAI = re.compile("[฀-๿]")
_BLANKED_STOP = re.compile("[។៕။]")
#: Letters and marks a Lao, Khmer or Burmese sentence hardly stays under.
LEAST_LETTERS = 12
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]")
_OPEN = "([{（［｛「『【〈《〔"
_CLOSE = ")]}）］｝」』】〉》〕"
_PARTNER = dict(zip(_OPEN, _CLOSE))
_QUOTE_PAIRS = {"“": "”", "„": "“", "«": "»", "‘": "’", "‹": "›"}
_CLOSERS = "\"'”’“»›" + _CLOSE
_TERMINATOR = re.compile(
    r"(?P<mark>[.!?…;;؟।॥։۔⸮‼⁇⁈⁉。！？｡]+)(?P<close>[" + re.escape(_CLOSERS) + r"]*)(?P<gap>\s+|$|(?=[^\W\d_]))"
)
#: Chinese and Japanese words that hardly stand but at the end of a sentence.
SURE_CLOSING_WORDS = frozenset("吗 呢 です ます ました でした".split())
_CJK_CLOSERS = _CLOSERS.replace("“", "").replace("»", "")
_CJK_TERMINATOR = re.compile(r"(?:[。！？｡!?…]+|\.(?=\s|$))[" + re.escape(_CJK_CLOSERS) + r"]*")
_CJK_GAP = re.compile(_CJK_TERMINATOR.pattern + r"|\s+")
_LAST_TOKEN = re.compile(r"\S+$")
_NEXT_WORD = re.compile(r"[\s\"'“”„«»‘’‹›(\[¿¡–—-]*([^\W_]+)")
_URL = re.compile(r"@|/|^www\.|\.\w+\.\w", re.I)
#: Characters before and after a place that may decide on it.
WINDOW = 160


def strip_span(text: str, a: int, b: int) -> tuple[int, int] | None:
    while a < b and (text[a].isspace() or text[a] in "﻿​"):
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in "﻿​"):
        b -= 1
    return (a, b) if a < b else None


def enclosures(text: str) -> list[tuple[int, int, bool]]:
    """Spans of brackets and quotations (begin, end, is a quotation); unpaired marks make none."""
    out, stack = [], []
    for i, c in enumerate(text):
        if stack and c == stack[-1][1]:
            begin, _, quote = stack.pop()
            out.append((begin, i + 1, quote))
        elif c in _PARTNER:
            stack.append((i, _PARTNER[c], c in "「『"))
        elif c in _QUOTE_PAIRS:
            before = text[i - 1] if i else " "
            if c == "‘" and before.isalnum():
                continue
            stack.append((i, _QUOTE_PAIRS[c], True))
        elif c == '"':
            stack.append((i, '"', True))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] == c and c in _CLOSE:
                    begin, _, quote = stack[k]
                    del stack[k:]
                    out.append((begin, i + 1, quote))
                    break
    return out


class Around:
    """The enclosures around rising positions, found in one pass."""

    def __init__(self, text: str) -> None:
        self.spans = sorted(enclosures(text))
        self.next = 0
        self.open: list[tuple[int, int, bool]] = []

    def at(self, begin: int) -> list[tuple[int, int, bool]]:
        """Enclosures that begin before ``begin`` and end after it."""
        while self.next < len(self.spans) and self.spans[self.next][0] < begin:
            self.open.append(self.spans[self.next])
            self.next += 1
        self.open = [e for e in self.open if e[1] > begin]
        return self.open


def before(text: str, at: int) -> str:
    """What stands before a position, as far as a decision needs it."""
    return text[max(0, at - WINDOW) : at]


def reported(text: str, begin: int, end: int, after: int) -> bool:
    """Whether the quotation text[begin:end] is joined to a clause; ``after``: where the clause
    behind it would end."""
    lead_in = before(text, begin).rstrip()
    if lead_in and lead_in[-1] not in ".!?…؟।。！？":
        return True
    inner = text[max(begin, end - WINDOW) : end].rstrip(_CLOSERS)
    tail = text[end:after]
    lead = tail.lstrip()
    if inner[-1:] in ",،，、" or lead[:1] in (",", "،", "–", "—", "-") or lead[:1].islower():
        return True
    if _CJK.search(tail[:1]):
        return bool(REPORTING_CJK.search(tail))
    return len(lead.split()) <= 12 and bool(REPORTING.search(lead))


def _score(text: str, m: re.Match) -> float:
    """Log odds that a terminator of a spaced script ends a sentence."""
    mark, end = m["mark"], m.end("close")
    past = before(text, m.start())
    last = _LAST_TOKEN.search(past)
    token = last.group().lstrip("\"'“„«‘‹([{¿¡") if last else ""
    low = token.lower()
    nxt = _NEXT_WORD.match(text, end)
    word = nxt[1] if nxt else ""
    lower = word[:1].islower()
    glued = not m["gap"]
    if glued:  # "one.Two": only after a word, and no address or file
        rest = re.match(r"\S+", text[end : end + WINDOW])
        tail = (last.group() if last else "") + (rest.group() if rest else "")
        good = token.isalpha() and len(token) > 1 and token[-1].islower() and word[:1].isupper() and word[1:2].islower()
        good = good or (mark[-1] in "।。！？؟" and word != "")
        return 1.5 if good and not _URL.search(tail) and low not in LEADING else -9.0
    if mark in (";", ";"):
        greek = re.search("[Ͱ-Ͽ]", text[max(0, m.start() - 20) : m.start()])
        return 4.0 if greek and not lower else -9.0
    if mark[0] in "।॥։۔。｡" or mark[-1] in "؟।":
        return 6.0
    if mark == ".":
        if re.fullmatch(r"[^\W\d_]", token):  # an initial, or part of an abbreviation written apart
            earlier = _LAST_TOKEN.search(past[: last.start()].rstrip().rstrip("."))
            first = earlier.group().lower() if earlier else ""
            if low in PAIRS.get(first, ()):
                return -6.0 if f"{first} {low}" not in PAIRS_FINAL or lower or not word else 3.0
            if low in PAIRS and word.lower() in PAIRS[low]:
                return -9.0
            if token.isupper() or low in LEADING:
                return -6.0
            return 2.0 if not lower else -3.0
        earlier = _LAST_TOKEN.search(past[: last.start()].rstrip()) if last else None
        first = earlier.group().lower().rstrip(".") if earlier else ""
        if low in PAIRS.get(first, ()) and earlier and earlier.group().endswith("."):
            return -6.0 if f"{first} {low}" not in PAIRS_FINAL or lower else 3.0
        bare = low.split("'")[-1].split("’")[-1]
        if low in FINAL:
            if lower and word in SUBJECTS:
                return 0.3
            if lower or word[:1].isdigit() or not word:
                return -6.0
            return -6.0 if low in ("a.m", "p.m") and word.lower() in TIMES else (-6.0 if low in ("ph.d", "u.s", "u.k") and lower else 3.0)
        if low in LEADING or bare in LEADING:
            return -6.0
        if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token):
            return -4.0 if lower or not word else 1.0
        if token.isdigit():
            if first in ORDINAL_LEADS or word.lower() in GERMAN_MONTHS:
                return -5.0 if not lower else -6.0
            if len(token) <= 3 and not earlier and m.start() == len(token):
                return -5.0  # "3. Point": a list's number
            return 4.0 if not lower else -1.0
        if re.fullmatch(r"[IVXLC]+", token) and word and lower:
            return -4.0
        if lower:
            return 1.5 if token.isalpha() and len(token) > 3 or token.endswith(("'", ")")) else 0.5
        return 5.0
    if not lower:
        return 4.0
    if set(mark) <= {".", "…"}:  # "Well… maybe": one word and a pause
        alone = re.split(r"[.!?…\n]\s", past)[-1].split()
        return -5.0 if len(alone) <= 1 or m["close"] else 0.5
    return 0.5 if not m["close"] else -4.0


def split_spaced(text: str) -> Iterator[tuple[int, int]]:
    """Best path through the terminators of one paragraph."""
    marks = [m for m in _TERMINATOR.finditer(text) if m.end("close") < len(text)]
    if not marks:
        yield 0, len(text)
        return
    ends = [m.end("close") for m in marks]
    around = Around(text)
    scores = []
    for k, m in enumerate(marks):
        s = _score(text, m)
        spans = around.at(m.start())
        inside = [e for e in spans if ends[k] < e[1]]
        closing = [e for e in spans if m.end("mark") < e[1] <= ends[k]]
        if any(not quote for _, _, quote in inside):
            s -= 20
        elif inside:
            b, e, _ = max(inside)
            at = bisect_right(ends, e)
            nxt = ends[at] if at < len(ends) else len(text)
            s = s - 20 if reported(text, b, e, nxt) else s
        elif any(quote for _, _, quote in closing):
            # the end of a quotation: the clause around it goes on, or ends with it
            b, e, _ = min(x for x in closing if x[2])
            nxt = ends[k + 1] if k + 1 < len(ends) else len(text)
            lead = text[e:nxt].lstrip()
            lead_in = before(text, b).rstrip()
            goes_on = lead[:1] in (",", "،", "–", "—") or lead[:1].islower() and lead_in[-1:] not in (",", ":")
            opened = not lead_in or lead_in[-1] in ".!?…؟।。！？" + _CLOSERS
            if lead[:1].islower() and not goes_on:
                s = max(s, 0.5)
            elif goes_on or (opened and lead and REPORTING.search(lead) and reported(text, b, e, nxt)):
                s -= 20
        elif any(not quote for _, _, quote in closing) and text[ends[k] : ends[k] + WINDOW].lstrip()[:1].islower():
            s -= 20
        scores.append(s)
    # A path's worth: the scores of its nodes, less the scores of the nodes it passes by. With the sums of
    # the scores so far, the best node before is the one of the largest best + sum: a running maximum.
    back = [0] * (len(ends) + 1)
    top, at, total = 0.0, 0, 0.0
    for j, s in enumerate(scores, 1):
        back[j] = at
        worth = top - total + s
        total += s
        if worth + total >= top:
            top, at = worth + total, j
    cuts = []
    while at:
        cuts.append(ends[at - 1])
        at = back[at]
    begin = 0
    for c in reversed(cuts):
        yield begin, c
        begin = c
    yield begin, len(text)


def lattice_words(text: str) -> list[str]:
    """Cheapest path through the dictionary lattice: a known word costs 1, an unknown character
    1.2, so that unknown runs stay between the longest known words."""
    n = len(text)
    cost = [0.0] + [1e18] * n
    back = [0] * (n + 1)
    for i in range(n):
        if cost[i] + 1.2 < cost[i + 1]:
            cost[i + 1], back[i + 1] = cost[i] + 1.2, i
        for size in range(1, min(_LONGEST, n - i) + 1):
            if text[i : i + size] in _DICTIONARY and cost[i] + 1 < cost[i + size]:
                cost[i + size], back[i + size] = cost[i] + 1, i
    spans: list[tuple[int, int, bool]] = []
    at = n
    while at:
        begin = back[at]
        known = text[begin:at] in _DICTIONARY
        if spans and not known and not spans[-1][2]:
            spans[-1] = begin, spans[-1][1], False
        else:
            spans.append((begin, at, known))
        at = begin
    return [text[a:b] for a, b, _ in reversed(spans)]


class Stretches:
    """The runs of a text between blanks and punctuation, each cut into words as a whole and once."""

    def __init__(self, text: str, lexicon: Lexicon | None = None) -> None:
        self.text, self.lexicon = text, lexicon
        spans = [m.span() for m in _STRETCH.finditer(text)]
        self.begins, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.edges: dict[int, tuple[str, str]] = {}
        self.learned: dict[int, tuple[str, str]] = {}

    def edge(self, k: int) -> tuple[str, str]:
        """First and last word of a run."""
        if k not in self.edges:
            words = lattice_words(self.text[self.begins[k] : self.ends[k]])
            self.edges[k] = words[0], words[-1]
        return self.edges[k]

    def runs(self, a: int, b: int) -> tuple[int, int]:
        """The numbers of the run that ends before text[a:] and of the one that begins behind text[:b], past
        quotation marks and brackets; -1 for none."""
        left = a
        while left and self.text[left - 1] in _CLOSERS + "。！？!?….":
            left -= 1
        right = b
        while right < len(self.text) and self.text[right] in "\"'“„«‘‹([{（「『":
            right += 1
        i, j = bisect_left(self.ends, left), bisect_left(self.begins, right)
        return (
            i if i < len(self.ends) and self.ends[i] == left else -1,
            j if j < len(self.begins) and self.begins[j] == right else -1,
        )

    def around(self, a: int, b: int) -> tuple[str, str]:
        """The last word of text[:a] and the first of text[b:]."""
        i, j = self.runs(a, b)
        return self.edge(i)[1] if i >= 0 else "", self.edge(j)[0] if j >= 0 else ""

    def weight(self, a: int, b: int, most: float) -> float:
        """How much the learned words on both sides of text[a:b] speak for an end, each up to ``most``."""
        if self.lexicon is None:
            return 0.0
        for k in (pair := self.runs(a, b)):
            if k >= 0 and k not in self.learned:
                words = self.lexicon.words(self.text[self.begins[k] : self.ends[k]])
                self.learned[k] = words[0], words[-1]
        i, j = pair
        closes = self.lexicon.closing.get(self.learned[i][1], 0.0) if i >= 0 else 0.0
        opens = self.lexicon.opening.get(self.learned[j][0], 0.0) if j >= 0 else 0.0
        return max(-most, min(most, closes)) + max(-most, min(most, opens))


def _edge_words(text: str, a: int, b: int) -> tuple[str, str]:
    """The last word of text[:a] and the first of text[b:], of the lattice over their runs."""
    return Stretches(text).around(a, b)


def split_blanked(text: str, lexicon: Lexicon | None = None) -> Iterator[tuple[int, int]]:
    """Thai and its neighbours: blanks are the gaps; beside figures they do not part.

    In Thai a blank parts sentences unless something speaks against it. Khmer and Burmese have full stops, so
    that a blank where they use them parts phrases; in Lao too a blank beside a phrase of a word or two does.
    """
    around = Around(text)
    stretches = Stretches(text, lexicon)
    thai = 2 * len(_THAI.findall(text)) > len(_BLANKED.findall(text))
    stops = bool(_BLANKED_STOP.search(text))
    places = [m.span() for m in re.finditer(r"\s+", text)]
    begin = 0
    for n, (a, b) in enumerate(places):
        if a <= begin or b >= len(text):
            continue
        if any(b < y for _, y, _ in around.at(a)):
            continue
        left, right = text[a - 1], text[b]
        bare = before(text, a).rstrip(_CLOSERS)
        if bare[-1:] in "!?。！？…။។៕":
            score = 5.0
        else:
            score = 2.0
            if left.isdigit() or right.isdigit() or left in "%$฿€+-=" or right in "%$฿€+-=&(（":
                score -= 9
            if left in ",;:：–—&" or right in ",;:：–—":
                score -= 9
            closes, opens = stretches.around(a, b)
            if opens in CONTINUING_WORDS:
                score -= 4
            if closes in CONTINUING_WORDS:
                score -= 4
            if closes in CLOSING_WORDS:
                score += 2
            if opens in OPENING_WORDS:
                score += 2
            score += stretches.weight(a, b, 0.75)
            if not thai:
                behind = places[n + 1][0] if n + 1 < len(places) else len(text)
                if stops:
                    score -= 4
                if min(a - begin, behind - b) < LEAST_LETTERS:
                    score -= 4
            if left.isascii() and left.isalpha() or right.isascii() and right.isalpha():
                score -= 3
        if score > 0:
            yield begin, a
            begin = b
    yield begin, len(text)


def _blank_score(text: str, a: int, b: int, stretches: Stretches) -> float:
    """Log odds that the blanks text[a:b] part sentences of Chinese or Japanese: both words must say so, or a
    closing one that stands nowhere else."""
    left, right = text[a - 1], text[b]
    if not _CJK.match(right) and right not in _OPEN + "“‘" or not _CJK.match(left) and left not in _CLOSERS:
        return -9.0
    closes, opens = stretches.around(a, b)
    score = -3.0 + stretches.weight(a, b, 2.0)
    if opens in CONTINUING_WORDS:
        score -= 4
    if closes in CONTINUING_WORDS:
        score -= 4
    if closes in CLOSING_WORDS:
        score += 4 if closes in SURE_CLOSING_WORDS else 2
    if opens in OPENING_WORDS:
        score += 2
    return score


def split_unspaced(text: str, lexicon: Lexicon | None = None) -> Iterator[tuple[int, int]]:
    """Chinese and Japanese: terminators, blanks and line feeds are the gaps. Terminators other than dots end a
    sentence unless a quotation or bracket goes on; at the other gaps the words on both sides decide."""
    around = Around(text)
    stretches = Stretches(text, lexicon)
    begin = 0
    for m in _CJK_GAP.finditer(text):
        a, b = m.span()
        if b >= len(text):
            continue
        spans = around.at(a)
        if text[a].isspace():
            if a > begin and not any(b < y for _, y, _ in spans) and _blank_score(text, a, b, stretches) > 0:
                yield begin, a
                begin = b
            continue
        inside = [e for e in spans if b < e[1]]
        closing = [e for e in spans if e[1] <= b]
        nxt = next((x.end() for x in _CJK_TERMINATOR.finditer(text, b)), len(text))
        score = 4.0
        mark = m.group().rstrip(_CJK_CLOSERS)
        if inside:
            x, y, quote = max(inside)
            after = next((t.end() for t in _CJK_TERMINATOR.finditer(text, y)), len(text))
            score -= 20 if not quote or reported(text, x, y, after) else 0
        elif closing:
            x, y, quote = min(closing)
            rest = text[y:nxt].lstrip()
            if not quote:  # marks in brackets do not end the sentence around them
                score -= 20 if rest else 0
            elif reported(text, x, y, nxt) and (
                REPORTING_CJK.search(rest) or rest[:1] in "，、,"
            ):
                score -= 20
        if set(mark) <= set("…."):
            closes, opens = stretches.around(a, b)
            if closes not in CLOSING_WORDS and opens not in OPENING_WORDS:
                score += stretches.weight(a, b, 2.0) - 7
        if text[b : b + 1] in "，、,；：":
            score -= 9
        if score > 0:
            yield begin, b
            begin = b
    yield begin, len(text)


def script_of(part: str) -> str:
    """How a paragraph is cut: "blanked" (Thai, Lao, Khmer, Burmese), "unspaced" (Chinese, Japanese) or "spaced"."""
    if 2 * len(_BLANKED.findall(part)) > sum(map(str.isalpha, part)) * 0.6:
        return "blanked"
    return "unspaced" if 3 * len(_CJK.findall(part)) > len(part) * 0.6 else "spaced"


def sentences(text: str | None, lexicon: Lexicon | None = None) -> list[tuple[int, int]]:
    """Spans of the sentences, in order, without blanks at their ends; every visible character
    is in exactly one. Null, empty and blank texts have none. lexicon: learned words; without it the fixed
    function words decide alone."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    plain = text.replace("\r", " ")
    begin = 0
    for m in [*_BLANK_LINES.finditer(plain), None]:
        end = m.start() if m else len(plain)
        if span := strip_span(plain, begin, end):
            a, b = span
            part = plain[a:b]
            script = script_of(part)
            if script == "spaced":
                made = split_spaced(part)
            else:
                made = (split_blanked if script == "blanked" else split_unspaced)(part, lexicon)
            for x, y in made:
                if s := strip_span(plain, a + x, a + y):
                    out.append(s)
        begin = m.end() if m else end
    # A piece without a letter or figure belongs to the sentence before it.
    joined: list[tuple[int, int]] = []
    for a, b in out:
        gap = plain[joined[-1][1] : a] if joined else "\n\n"
        if joined and "\n" not in gap.strip(" ") and not any(c.isalnum() for c in plain[a:b]):
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    return joined


def sentence_spans(documents: DataFrame) -> DataFrame:
    """``corpus_id, doc_seq, sent_start, sent_end`` of the texts under notes/, each span once. The lexicon is
    learned from all of these texts in a job of its own."""
    rows = in_folder(documents, "notes").where(F.col("text").isNotNull()).select(*KEY, "text")
    lexicon = learn(rows.select("text"))

    def make():
        return lambda corpus, seq, text: ((corpus, seq, a, b) for a, b in sentences(text, lexicon))

    return flat_map(rows, make, "corpus_id string, doc_seq int, sent_start int, sent_end int").distinct()


def sentence_units(documents: DataFrame) -> DataFrame:
    """``corpus_id, doc_seq, sent_no, sentence`` of all texts, whatever their path."""
    rows = documents.where(F.col("text").isNotNull()).select(*KEY, "text")
    lexicon = learn(rows.select("text"))

    def make():
        return lambda corpus, seq, text: (
            (corpus, seq, n, text[a:b]) for n, (a, b) in enumerate(sentences(text, lexicon), 1)
        )

    return flat_map(rows, make, "corpus_id string, doc_seq int, sent_no int, sentence string").distinct()
