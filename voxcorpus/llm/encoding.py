"""Text that was decoded with a wrong character encoding.

Method: the corpus is its own dictionary. Of every distinct clean word with a character
beyond ASCII, the garbled form under each chain (right encoding, wrong decoder, once or
twice) is generated; the forms are hash-joined with the distinct words of the corpus, and
the matches with the documents. A match names the original, which is substituted.

Each text is taken apart once. Its tokens are exchanged once, by (token, salt), with the hash of
the text and the document's number; the counts of distinct texts and the join with the garbled
words both read that one exchange. The salt is the text's, so the counts of the parts add up.

Words of scripts without blanks are pairs of neighbouring characters; besides whole words,
runs of characters beyond ASCII within a word count as words of their own, so that a word
that stands in the corpus in its garbled form only is found by its accents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcorpus.llm.common import flat_map, join_on, salted, salts, spread

#: Right encoding and wrong decoder.
CHAINS: tuple[tuple[str, str], ...] = (
    ("utf-8", "latin-1"),
    ("utf-8", "cp1252"),
    ("utf-8", "mac_roman"),
    ("utf-8", "cp850"),
    ("utf-8", "cp437"),
    ("utf-8", "cp1250"),
    ("utf-8", "cp1251"),
    ("utf-8", "cp1253"),
    ("utf-8", "cp1254"),
    ("utf-8", "cp866"),
    ("utf-8", "koi8-r"),
    ("utf-8", "shift_jis"),
    ("utf-8", "cp932"),
    ("utf-8", "gbk"),
    ("utf-8", "big5"),
    ("utf-8", "euc_kr"),
    ("cp1252", "utf-8"),
    ("cp1252", "mac_roman"),
    ("mac_roman", "cp1252"),
    ("cp1252", "cp850"),
    ("cp850", "cp1252"),
    ("cp1252", "cp437"),
    ("cp437", "cp1252"),
    ("cp1252", "cp1251"),
    ("cp1251", "latin-1"),
    ("cp1251", "cp1252"),
    ("cp1251", "koi8-r"),
    ("cp1251", "cp866"),
    ("cp1251", "mac_roman"),
    ("cp1251", "utf-8"),
    ("koi8-r", "cp1251"),
    ("koi8-r", "latin-1"),
    ("koi8-r", "cp1252"),
    ("koi8-r", "cp866"),
    ("cp866", "cp1251"),
    ("cp866", "latin-1"),
    ("cp866", "cp1252"),
    ("cp1253", "latin-1"),
    ("cp1253", "cp1252"),
    ("shift_jis", "latin-1"),
    ("shift_jis", "cp1252"),
    ("euc_jp", "latin-1"),
    ("euc_jp", "cp1252"),
    ("gbk", "latin-1"),
    ("gbk", "cp1252"),
    ("big5", "latin-1"),
    ("big5", "cp1252"),
    ("euc_kr", "latin-1"),
    ("euc_kr", "cp1252"),
)
#: Chains that are also applied twice.
TWICE = (("utf-8", "cp1252"), ("utf-8", "latin-1"))
#: Decoders of more than one byte.
WIDE = ("utf-8", "shift_jis", "cp932", "gbk", "big5", "euc_kr")
#: A task hands on what it found when it holds so many places of tokens.
CHUNK = 500_000
#: Words up to this length are taken apart once a worker.
KEPT_LENGTH = 24
#: Up to this difference in ``accents`` two words look about alike.
ALIKE = 0.5

WORD, PART, PAIR = 0, 1, 2

_TOKEN = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_SPACELESS = re.compile(
    "[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿]{2,}"
)
_LOST = re.compile("[�\x80-\x9f─-▟]")


def encode_loosely(text: str, encoding: str) -> bytes | None:
    """As a decoder that passes unassigned bytes through would have read them; else None."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if "\x80" <= c <= "\x9f":
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def decode_wrongly(data: bytes, encoding: str) -> str:
    """Unassigned bytes of an eight-bit encoding stay as C1 controls; others become U+FFFD."""
    if encoding in WIDE:
        return data.decode(encoding, "replace")
    out = data.decode(encoding, "replace")
    if "�" in out:
        out = "".join(chr(b) if c == "�" else c for b, c in zip(data, out))
    return out


def garble(text: str, right: str, wrong: str) -> str | None:
    try:
        data = text.encode(right)
    except UnicodeEncodeError:
        return None
    return decode_wrongly(data, wrong)


def ungarble(text: str, right: str, wrong: str) -> str | None:
    """The one original of a garbled text, or None."""
    if wrong == "utf-8":
        return None
    data = encode_loosely(text, wrong)
    if data is None:
        return None
    try:
        back = data.decode(right)
    except UnicodeDecodeError:
        return None
    return back if garble(back, right, wrong) == text else None


def forms(word: str) -> Iterable[tuple[str, str]]:
    """(garbled form, chain) of a clean word under all chains."""
    for right, wrong in CHAINS:
        once = garble(word, right, wrong)
        if once is None or once == word or (wrong == "utf-8" and "\ufffd" not in once):
            continue
        yield once, f"{right}>{wrong}"
        if (right, wrong) in TWICE:
            for r, w in TWICE:
                again = garble(once, r, w)
                if again is not None:
                    yield again, f"{right}>{wrong}>{r}>{w}"


def looks_clean(word: str) -> bool:
    """No lost characters, and not itself the garbled form of another word's UTF-8."""
    if _LOST.search(word):
        return False
    eight_bit = (w for r, w in CHAINS if r == "utf-8" and w not in WIDE)
    return all(ungarble(word, "utf-8", w) is None for w in eight_bit)


def _class(encoding: str, begin: int, end: int) -> str:
    """The characters that the bytes from ``begin`` to ``end`` are decoded to, as a class of a regular expression."""
    chars = decode_wrongly(bytes(range(begin, end + 1)), encoding)
    return "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(set(chars))) + "]"


def _three_bytes(encoding: str) -> str:
    """One character of a spaceless script under UTF-8, read as an eight-bit encoding."""
    return f"{_class(encoding, 0xE0, 0xE9)}{_class(encoding, 0x80, 0xBF)}{{2}}"


_EIGHT_BIT = [w for r, w in CHAINS if r == "utf-8" and w not in WIDE]
#: Two such characters, at any place of a run of whatever length; the classes leave out nearly all clean words.
_SIX = re.compile("(?=((?:" + "|".join(f"(?:{_three_bytes(w)}){{2}}" for w in _EIGHT_BIT) + ")))")
_C2, _C3 = (
    "(?:" + "|".join(_class(w, a, b) + "(?:" + _class("latin-1", 0x80, 0xBF) + "|" + _class("cp1252", 0x80, 0xBF) + ")" + f"{{{n}}}" for _, w in TWICE) + ")"
    for a, b, n in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2))
)
#: The same read wrongly twice.
_SIX_TWICE = re.compile(f"(?=((?:{_C2}|{_C3}){{6}}))")
#: Two characters of two bytes each, read as latin-1 or cp1252.
_FOUR = re.compile("(?=((?:" + _class("latin-1", 0x80, 0xFF) + "|" + _class("cp1252", 0x80, 0xFF) + "){4}))")
#: Two characters of a spaceless script as bytes of UTF-8.
_PAIR_BYTES = re.compile(rb"(?:[\xe0-\xe9][\x80-\xbf]{2}){2}")


def read_wide(run: str) -> bool:
    """Whether a run holds UTF-8 of a spaceless script that was read as an encoding of two bytes."""
    return any(_PAIR_BYTES.search(run.encode(w, "replace")) for w in WIDE[1:])


def grams(run: str) -> Iterable[str]:
    """The pieces of a run beyond ASCII that can be garbled pairs of characters: 3 to 6 characters long, and
    longer where they were read wrongly twice."""
    if len(run) >= 3 and (not run.isalpha() or _LOST.search(run) or max(run) >= "\u2e80" and read_wide(run)):
        for n in (3, 4, 5, 6):
            yield from (run[i : i + n] for i in range(len(run) - n + 1))
    if len(run) >= 4:
        yield from (m[1] for m in _FOUR.finditer(run))
    if len(run) >= 6:
        yield from (m[1] for m in _SIX.finditer(run))
    if len(run) >= 12:
        yield from (m[1] for m in _SIX_TWICE.finditer(run))


def tokens(text: str) -> set[tuple[str, int]]:
    """Words with characters beyond ASCII, the runs of such characters, neighbouring characters
    of spaceless scripts, and what can be garbled ones within a run; words and runs of any length."""
    out: set[tuple[str, int]] = set()
    for piece in set(text.split(" ")):  # most pieces are ASCII, which is cheaper to see than to match
        if piece.isascii():
            continue
        for word in _TOKEN.findall(piece):
            if not word.isascii():
                out.update(_short_word(word) if len(word) <= KEPT_LENGTH else word_tokens(word))
    return out


def word_tokens(word: str) -> set[tuple[str, int]]:
    out = set()
    spaceless = _SPACELESS.search(word)
    if not spaceless or any(ungarble(word, "utf-8", w) is not None for w in WIDE[1:]):
        out.add((word, WORD))
    for run in _BEYOND.findall(word):
        if spaceless:
            for s in _SPACELESS.findall(run):
                out.update((s[i : i + 2], PAIR) for i in range(len(s) - 1))
        elif run != word:
            out.add((run, PART))
        out.update((g, PAIR) for g in grams(run))
    return out


#: Words repeat; those of up to ``KEPT_LENGTH`` characters are taken apart once a worker, as far as they are kept.
_short_word = lru_cache(maxsize=50_000)(word_tokens)


def accents(word: str) -> float:
    """Share of a word's letters that would surprise in a word of one script: higher is stranger."""
    odd = sum(1 for c in word if not c.isalpha())
    latin = sum(1 for c in word if "\xc0" <= c <= "ɏ")
    upper = sum(1 for a, b in zip(word, word[1:]) if a.islower() and b.isupper())
    scripts = [c < "ɐ" for c in word if c.isalpha()]
    mixed = sum(1 for a, b in zip(scripts, scripts[1:]) if a != b)
    lost = len(_LOST.findall(word))
    return (odd * 2 + latin + upper + mixed * 2 + lost) / max(1, len(word))


def strangeness(form: str, original: str) -> float:
    """By how much a garbled form looks the stranger; one of a repeated mark or two ("───") never does."""
    more = accents(form) - accents(original)
    return more if len(set(form)) > 2 or any(c.isalpha() for c in form) else min(more, 0.0)


def beyond_ascii(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("text").rlike(r"[^\x00-\x7F]"))


def corpus_tokens(documents: DataFrame) -> DataFrame:
    """``token, kind, salt, hashes, docs``: where each token stands, in pieces: the hashes of the texts and the
    numbers of their documents, a document once a token. A task hands on a piece for each token (and salt) of
    every ``CHUNK`` places, so that common words are few rows."""
    n = salts(documents)
    rows = spread(beyond_ascii(documents).select("doc_id", F.xxhash64("text").alias("h"), "text"), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int], list[int]] = {}
        hashes: list[int] = []
        docs: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            at = np.fromiter((i for v in seen.values() for i in v), "int64", held)
            ends = pa.array(np.cumsum([0, *map(len, seen.values())], dtype="int32"))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64()).take(pa.array(at))) for x in (hashes, docs)]
            words, kinds, parts = zip(*seen)
            made = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), *lists],
                names=["token", "kind", "salt", "hashes", "docs"],
            )
            seen.clear(), hashes.clear(), docs.clear()
            return made

        for batch in batches:
            for doc, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                me = len(docs)
                docs.append(doc)
                hashes.append(h)
                part = h % n
                for token, kind in tokens(text):
                    key = token, kind, part
                    if (got := seen.get(key)) is None:
                        seen[key] = [me]
                    else:
                        got.append(me)
                    held += 1
                if held >= CHUNK:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    found = rows.mapInArrow(run, "token string, kind int, salt int, hashes array<bigint>, docs array<bigint>")
    # no token is null; said here, as the joins would say it for some readers of the exchange only
    return found.where("token IS NOT NULL AND kind IS NOT NULL AND salt IS NOT NULL").repartition("token", "kind", "salt")


def _either(one: str, other: str) -> Column:
    """The values of one of two arrays of the same length. Names both, so that all readers of the tokens need
    the same columns and share their exchange."""
    return F.explode(F.when(F.size(other) >= 0, F.col(one)))


def corpus_words(found: DataFrame) -> DataFrame:
    """``token, kind, texts`` of ``corpus_tokens``: in how many distinct texts a token stands; copies of a text
    count once."""
    once = found.select("token", "kind", "salt", _either("hashes", "docs").alias("h")).distinct()
    parts = once.groupBy("token", "kind", "salt").agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("token", "kind").agg(F.sum("n").alias("texts"))


def garbled_words(words: DataFrame) -> DataFrame:
    """``token, kind, original, chain``: the garbled words of the corpus with their verified originals.

    A form longer or shorter than its original is too particular to be chance, and so is UTF-8
    read as an encoding of two bytes; another form of the same length must be of three letters and look the stranger of the two, however often
    it stands. Only where both look about alike (``ALIKE``) must it stand in fewer distinct
    texts than its original. Of several originals the one in most texts is taken.
    """

    def make():
        def one(token: str, kind: int, n: int):
            if looks_clean(token):
                for form, chain in forms(token):
                    form = form.rstrip("�") if kind == PAIR else form
                    lossy = kind != PAIR and "\ufffd" in form
                    if kind != WORD and not lossy and (form.isascii() or len(form) < 2):
                        continue
                    wide = chain.split(">")[0] == "utf-8" and chain.split(">")[1] in WIDE and len(form) > 2
                    same = len(form) == len(token) and not wide
                    if same and not lossy and (kind != WORD or len(token) < 3):
                        continue
                    if kind == PAIR and len(form) < 3:
                        continue
                    yield form, kind, token, chain, n, strangeness(form, token), same

        return one

    # words are few bytes and much work: as many parts as there are cores, not as their size would have it
    cores = words.sparkSession.sparkContext.defaultParallelism
    made = flat_map(
        words.repartition(cores, "token"),
        make,
        "token string, kind int, original string, chain string, o_texts bigint, stranger double, same boolean",
    )
    stranger = F.col("stranger") > 0
    often = (F.col("stranger") >= -ALIKE) & (F.col("o_texts") > F.col("texts"))
    lossy = F.col("token").contains("�")
    return (
        made.join(words, ["token", "kind"])
        .where(~F.col("same") | stranger | often | lossy)
        .groupBy("token", "kind")
        .agg(F.max(F.struct("o_texts", "original", "chain")).alias("best"))
        .select("token", "kind", "best.original", "best.chain")
    )


def garbled_tokens(documents: DataFrame) -> DataFrame:
    """``doc_id, token, kind, original, chain`` of each garbled word of each document."""
    found = corpus_tokens(documents)
    bad = garbled_words(corpus_words(found))
    met = found.join(salted(bad, salts(documents)), ["token", "kind", "salt"])
    return met.select(_either("docs", "hashes").alias("doc_id"), "token", "kind", "original", "chain")


def garbled_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of each document with garbled text. Null, empty and ASCII texts are never garbled."""
    return garbled_tokens(documents).select("doc_id").distinct()


def undone(text: str, chain: str) -> str | None:
    """The original of a garbled text under a chain, or None where there is none or it is the text itself."""
    steps = chain.split(">")
    now: str | None = text
    for i in range(len(steps) - 2, -1, -2):
        now = ungarble(now, steps[i], steps[i + 1]) if now is not None else None
    return now if now != text else None


def repair(text: str, known: dict[str, tuple[str, str]]) -> str:
    """Substitutes the originals.

    The garbled words of a document vote for its chain. A text, or else a line, most of whose words beyond
    ASCII are garbled ones is turned back as a whole by the first chain that can (so also single marks and the
    bytes that stayed ASCII); in other lines words are turned back one by one, by their own chain or the one
    voted for, where they then look less strange.
    """
    votes = Counter(c for _, c in known.values())
    chains = [c for c, _ in votes.most_common()]

    def better(old: str, new: str) -> bool:
        return strangeness(old, new) > 0

    def word_of(word: str) -> str:
        own = known.get(word) if not _SPACELESS.search(word) else None
        for c in chains:
            if own and votes[own[1]] * 3 >= votes[c]:
                return own[0]
            new = undone(word, c)
            if new is not None and (own or better(word, new)):
                return new
        return own[0] if own else ""

    def part(m: re.Match) -> str:
        run = m.group()
        if run in known and len(known[run][0]) < len(run):
            return known[run][0]
        return next((new for c in chains if (new := undone(run, c)) is not None and better(run, new)), run)

    def word(m: re.Match) -> str:
        return m.group() if m.group().isascii() else word_of(m.group()) or _BEYOND.sub(part, m.group())

    def whole(piece: str) -> str | None:
        words = [w for w in _TOKEN.findall(piece) if not w.isascii() and (len(w) > 1 or w.isalpha())]
        hits = sum(any(t in known for t, _ in tokens(w)) for w in words)
        if 2 * hits <= len(words):
            return None
        made = (undone(piece, c) for c in chains)
        return next((new for new in made if new is not None and not _LOST.search(new)), None)

    if (new := whole(text)) is not None:
        return new
    return "\n".join(whole(line) or _TOKEN.sub(word, line) if not line.isascii() else line for line in text.split("\n"))


def restored_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, text, restored, chains``: each garbled document, with its text as far as it could be
    restored; ``restored`` is false if a replacement character or C1 control is left. A document that
    stands there twice appears once."""
    known = (
        garbled_tokens(documents)
        .groupBy("doc_id")
        .agg(
            F.collect_list(F.struct("token", "original", "chain")).alias("known"),
            F.array_sort(F.collect_set("chain")).alias("chains"),
        )
    )
    # only rows of garbled documents are compared with each other
    rows = join_on(beyond_ascii(documents).select("doc_id", "text"), known, ["doc_id"])
    rows = rows.dropDuplicates(["doc_id", "text"])

    def make():
        def one(doc, text, known, chains):
            sure = [k for k in known if re.search(r"[^\W_]", k["token"].replace("\ufffd", "")) or "\ufffd" not in k["token"]]
            new = repair(text, {k["token"]: (k["original"], k["chain"]) for k in sorted(sure, key=lambda k: k["chain"])})
            yield doc, new, not _LOST.search(new), chains

        return one

    return flat_map(rows, make, "doc_id bigint, text string, restored boolean, chains array<string>")
