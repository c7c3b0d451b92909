"""Column functions over text: everything here runs in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxcorpus.functions import lists as L

MARK = "\u001e"


def normalize_whitespace(text: Column) -> Column:
    """Paragraphs parted by one blank line, blanks within them single; empty paragraphs go."""
    clean = F.transform(
        F.split(text, r"\n(?U)\s*\n"), lambda p: F.regexp_replace(F.regexp_replace(p, r"(?U)\s+", " "), "^ | $", "")
    )
    return F.array_join(F.filter(clean, lambda p: p != ""), "\n\n")


def markdown_heading(text: Column) -> Column:
    """The first first-level heading, "" without one."""
    return F.regexp_extract(text, r"(?md)^\s*#\s+(.+?)\s*$", 1)


def strip_markdown(text: Column) -> Column:
    """Text without heading marks, link targets and backticks; emphasis and bullets stay."""
    t = F.regexp_replace(text, r"(?md)^\s{0,3}#{1,6}\s+", "")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.replace(t, F.lit("`"), F.lit(""))


def pick_title(heading: Column, text: Column, stem: Column) -> Column:
    """The heading cut to 120 characters; else the text's first line of at most 120; else the file's stem."""
    first = F.trim(F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(1)))
    return F.coalesce(
        F.when(F.trim(heading) != "", F.substring(F.trim(heading), 1, L.MAX_TITLE_CHARS)),
        F.when(F.length(first) <= L.MAX_TITLE_CHARS, first),
        stem,
    )


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(L.WORD), F.lit(1)), F.array().cast("array<string>"))


def is_content(token: Column) -> Column:
    """No stopword, and of at least three characters."""
    return ~token.isin(*L.STOPWORDS) & (F.length(token) >= L.MIN_TOKEN_CHARS)


def is_display_noise(token: Column) -> Column:
    """Tokens with an apostrophe, parts of addresses, and tokens under four characters."""
    return token.contains("'") | token.isin(*L.URL_NOISE) | (F.length(token) < 4)


def part_clitics(text: Column) -> Column:
    return F.when(text.contains("'") | text.contains("’"), F.regexp_replace(text, L.CLITIC, "$1 $2")).otherwise(text)


def stripped(text: Column) -> Column:
    """Without the blanks around it, and those before a last line or paragraph separator; a regular expression only there."""
    parted = text.endswith("\u0085") | text.endswith("\u2028") | text.endswith("\u2029")
    return F.when(parted, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(F.btrim(text, F.lit(" \t\n\x0b\f\r")))


def sentences(text: Column) -> Column:
    """Array of the trimmed sentences of a text, empty ones left out."""
    parts = F.split(F.regexp_replace(text, L.SENTENCE_END, "$1" + MARK), MARK)
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def open_pieces(text: Column) -> Column:
    """Array of the untrimmed pieces of a text that a blank line and more text may follow; the last one is
    open, and "" if the text ends with a sentence. A null text is an empty one."""
    followed = F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n"))
    return F.split(F.regexp_replace(followed, L.SENTENCE_END, "$1" + MARK), MARK)


def count_words(sentence: Column) -> Column:
    return F.regexp_count(sentence, F.lit(L.COUNTED_WORD))


def count_marks(sentence: Column) -> Column:
    """Marks outside of words: what is a word or a mark, less the words."""
    return F.regexp_count(sentence, F.lit(f"{L.COUNTED_WORD}|{L.COUNTED_MARK}")) - count_words(sentence)


def marks_in_order(sentence: Column) -> Column:
    """An entry for each word and mark of a sentence, in one pass: the mark, or "" for a word. Of both there are as
    many as ``count_words`` and ``count_marks`` say."""
    return F.regexp_extract_all(sentence, F.lit(f"{L.COUNTED_WORD}|({L.COUNTED_MARK})"), F.lit(1))


def count_of(sentence: Column, forms: Sequence[str]) -> Column:
    """How many words of a sentence are one of the forms (of small letters)."""
    # the first letter is looked at before what stands around it, which costs more
    whole = f"(?=[{''.join(sorted({w[0] for w in forms}))}])" + r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(forms, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
    return F.regexp_count(F.lower(sentence), F.lit(whole))


def is_usable_sentence(sentence: Column) -> Column:
    """Three to sixty blank-parted tokens, at most 500 characters, no blank line within."""
    # looked at no farther than it takes: 61 tokens are 121 characters at least
    three, more = (sentence.rlike(r"(?U)^\s*+(?:\S++\s++){%d}\S" % n) for n in (2, 60))
    return (F.length(sentence) <= 500) & ~sentence.contains("\n\n") & three & ((F.length(sentence) < 121) | ~more)


def is_trail(text: Column) -> Column:
    """Short pieces joined by one separator at least twice."""

    def by(separator: str) -> Column:
        pieces = F.filter(
            F.transform(F.split(text, r"\Q" + separator + r"\E"), lambda p: F.trim(p)), lambda p: p != ""
        )
        count = F.size(F.split(text, r"\Q" + separator + r"\E")) - 1
        return (count >= 2) & (F.size(pieces) > 0) & F.forall(pieces, lambda p: F.length(p) < 60)

    out = by(L.TRAIL_SEPARATORS[0])
    for s in L.TRAIL_SEPARATORS[1:]:
        out = out | by(s)
    return F.coalesce(out, F.lit(False))
