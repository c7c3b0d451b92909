"""Statistics of texts, and the texts that are not running prose.

Method: gradient-boosted trees over the statistics of a document. They are trained on
weakly labelled texts: prose is what stands under notes/ (a sample of ``TRAIN_TEXTS``
rows at most, taken by the hash of their key), in the shapes prose comes in (capitals, no
marks, broken lines, dialogue, a short list within); junk is made of the same words with
the structure of lists, tables, logs, dumps and keyword strings. The scores are calibrated
to probabilities on the hand-checked texts in ``holdout.py``, which are never trained on.

The model is fitted when a query is built: one job that sends ``TRAIN_TEXTS`` texts to the driver, whatever
the size of the collection, and some two seconds there.
"""

from __future__ import annotations

from collections.abc import Iterator
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcorpus.llm.common import KEY, in_folder
from voxcorpus.llm.holdout import HOLDOUT, SEED_PROSE
from voxcorpus.llm.trees import Trees

#: Rows under notes/ the trees are trained on, at most.
TRAIN_TEXTS = 1_000
#: With fewer prose texts than this the built-in ones are added. It bears on the training set alone: a collection
#: with hardly any notes has no prose of its own to learn from.
LEAST_TEXTS = 150
#: Notes up to this length are not trained on (all lengths are judged).
SHORTEST = 80
JUNK = 0.5

#: Some of the commonest words of several languages.
COMMON_WORDS = frozenset(
    """the a an and of to is it in that you not for with we they i when at as what if be then this was are but
    der die das und ist nicht ein eine den dem zu mit für auf im von
    le la les un une et est des du que pour pas dans il elle ce avec
    el los las una y en es por con para se no más su al del
    o os as um uma e que não com na ao à em já do da
    и в не на с что это как для по из за у к от мы без при после уже все
    και το η ο τα σε την του για με δεν που από κάθε
    है का की को ने के में और यह पर हर से
    في من على هذا هل إلى كل و لا ولا ما لم أن عن منذ قبل بعد""".split()
)
#: Characters and words that join clauses of scripts without blanks.
_PARTICLES = re.compile("[的了是不在有让被把和这那我们着过没]|[のはをがにでとも]|ที่|และ|ของ|การ|ใน|ให้|เรา|ไม่|แล้ว|โดย|ทุก|หลัง|ก่อน|ตั้งแต่")
_SPACELESS = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿]")
_END = re.compile(r"[.!?…。！？।؟;:,\"”’»)]$")
_BULLET = re.compile(r"^\s*(?:[-*•–—+·▪◦‣]|\(?\d{1,3}[.)]|[a-z][.)])\s+\S")
_COLUMNS = re.compile(r"\t|\|| {2,}\S|;\S*;")
_LEAD = re.compile(r"^\s*(?:\d{4}-\d\d|\d\d:\d\d|/|https?:|[{}<\[]|\|)")
_SENTENCE = re.compile(r"[.!?…。！？।؟](?=\s|$|[\"”’»)])|[。！？]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CLUSTER = re.compile(r"[b-df-hj-np-tv-xz]{4,}|[;,.!?/\\]\w|\d[a-z]\d|[a-z]\d[a-z]", re.I)
_REPEATED = re.compile(r"([^\w\s])\1{3,}")

NAMES = [
    "chars", "words", "lines", "mean_word_length", "longest_word", "symbol_ratio", "digit_ratio", "upper_ratio",
    "common_share", "common_gap", "particle_share", "spaceless_ratio", "end_mark_share", "bullet_share",
    "column_share", "lead_share", "words_per_line", "line_spread", "short_line_share", "comma_rate",
    "sentence_words", "distinct_share", "single_letter_share", "wordless_share", "repeat_ratio", "cluster_share",
]


def statistics(text: str | None) -> list[float]:
    """The statistics in the order of NAMES; all 0 for null, empty and blank texts.

    Without lines, words or sentences their shares are 0.
    """
    t = (text or "").replace("\r", "")
    lines = [x for x in t.split("\n") if x.strip()]
    if not lines:
        return [0.0] * len(NAMES)
    tokens = t.split()
    words = _WORD.findall(t)
    low = [w.lower() for w in words]
    visible = sum(map(len, tokens))
    letters = sum(map(len, words)) or 1
    n = len(words) or 1
    at = [i for i, w in enumerate(low) if w in COMMON_WORDS or w.split("'")[0].split("’")[0] in COMMON_WORDS]
    gaps = [b - a for a, b in zip([-1, *at], [*at, len(low)])] if words else [0]
    spaceless = len(_SPACELESS.findall(t))
    per_line = np.array([len(x.split()) if not _SPACELESS.search(x) else len(x) / 2 for x in lines])
    alnum = sum(map(str.isalnum, t))
    digits = sum(map(str.isdigit, t))
    marks = len(_SENTENCE.findall(t))
    count = len(lines)
    return [
        float(visible),
        float(len(words)),
        float(count),
        letters / n,
        float(max(map(len, tokens))) if not spaceless else min(30.0, float(max(map(len, tokens)))),
        1 - (alnum + spaceless * 0) / max(1, visible),
        digits / max(1, visible),
        sum(map(str.isupper, t)) / letters,
        len(at) / n,
        float(np.quantile(gaps, 0.9)) if not spaceless else 0.0,
        len(_PARTICLES.findall(t)) / max(1, spaceless),
        spaceless / max(1, visible),
        sum(bool(_END.search(x.rstrip())) for x in lines) / count,
        sum(bool(_BULLET.match(x)) for x in lines) / count,
        sum(bool(_COLUMNS.search(x.strip())) for x in lines) / count,
        sum(bool(_LEAD.match(x)) for x in lines) / count,
        float(np.median(per_line)),
        float(per_line.std() / (per_line.mean() + 1e-9)),
        float((per_line <= 4).mean()),
        (t.count(",") + t.count("，") + t.count("、")) / n,
        min(80.0, (len(words) + spaceless / 2) / max(1, marks)),
        len(set(low)) / n,
        sum(len(w) == 1 for w in low) / n if not spaceless else 0.0,
        1 - len(words) / max(1, len(tokens)) if not spaceless else 0.0,
        sum(len(m.group()) for m in _REPEATED.finditer(t)) / max(1, visible),
        sum(bool(_CLUSTER.search(w)) for w in tokens) / len(tokens),
    ]


def _wrapped(words: list[str], width: int) -> str:
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def shapes_of_prose(text: str, rng: random.Random) -> Iterator[str]:
    """The text, and the shapes prose comes in."""
    yield text
    if _SPACELESS.search(text):
        return
    flat = " ".join(text.split())
    units = [u for u in re.split(r"(?<=[.!?…])\s+", flat) if u]
    kind = rng.randrange(7)
    if len(units) > 3 and rng.random() < 0.5:
        begin = rng.randrange(len(units) - 2)
        units = units[begin : begin + rng.randrange(2, len(units))]
        flat = " ".join(units)
    bare = [re.sub(r"[.!?…]+$", "", u).lower() for u in units]
    words = flat.split()
    if kind == 0:
        yield flat.upper()
    elif kind == 1:
        yield "\n".join(bare)
    elif kind == 2:
        yield rng.choice([" ", ", "]).join(bare)
    elif kind == 3:
        yield _wrapped(words, rng.randrange(5, 10))
    elif kind == 4:
        yield "\n".join(f"{rng.choice(words).strip('.,').title()}: {u}" for u in units)
    elif kind == 5:
        items = "\n".join(f"- {' '.join(rng.sample(words, 2))}" for _ in range(rng.randrange(2, 5)))
        half = len(units) // 2
        yield " ".join(units[:half]) + f"\n\n{items}\n\n" + " ".join(units[half:])
    else:
        yield re.sub(r"\b([a-zà-ÿ]{7,})\b", lambda m: m[1] if rng.random() < 0.7 else str(rng.randrange(1000)), flat)


def junk_of(words: list[str], rng: random.Random) -> str:
    """A list, table or other junk of the given words."""
    pick = lambda k=1: " ".join(rng.choice(words) for _ in range(k))
    rows = rng.randrange(6, 30)
    kind = rng.randrange(17)
    if kind == 0:
        bullet = rng.choice("-*•–+")
        return "\n".join(f"{bullet} {pick(rng.randrange(1, 4))}" for _ in range(rows))
    if kind == 1:
        return "\n".join(f"{i}{rng.choice('.)')} {pick(rng.randrange(1, 4)).capitalize()}" for i in range(1, rows))
    if kind == 2:
        mark = rng.choice(["\t", ";", ",", " | "])
        return "\n".join(mark.join([pick(), str(rng.randrange(999)), f"{rng.random() * 99:.2f}"]) for _ in range(rows))
    if kind == 3:
        states = [pick(), "n/a", "ok", "yes", "-", pick()]
        width = rng.randrange(1, 3)
        return "\n".join(f"| {pick(width)} | {rng.randrange(999)} | {rng.choice(states)} |" for _ in range(rows))
    if kind == 4:
        return "\n".join(f"{pick():<24}{rng.randrange(9999):>6}{rng.random():>10.3f}" for _ in range(rows))
    if kind == 5:
        level = ("INFO", "WARN", "DEBUG", "ERROR")
        return "\n".join(
            f"2024-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02} {rng.randrange(24):02}:{rng.randrange(60):02}:00 "
            f"{rng.choice(level)} {pick()} id={rng.randrange(10**6)}"
            for _ in range(rows)
        )
    if kind == 6:
        return "\n".join(f"/{pick()}/{pick()}-{pick()}.html" for _ in range(rows))
    if kind == 7:
        chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        return "\n".join("".join(rng.choice(chars) for _ in range(64)) for _ in range(rows // 2 + 2))
    if kind == 8:
        return "\n".join(rng.choice("-=*_.#~") * rng.randrange(8, 44) + rng.choice(["", " " + pick()]) for _ in range(rows))
    if kind == 9:
        return " ".join("".join(pick(rows // 2)).replace(" ", ""))
    if kind == 10:
        return ", ".join(pick(rng.randrange(1, 3)) for _ in range(rows * 2))
    if kind == 11:
        return "\n".join(pick(rng.randrange(1, 3)) for _ in range(rows))
    if kind == 12:
        return pick(rows * 4) + rng.choice(["", "."])
    if kind in (13, 14):
        keys = rng.choice(["asdfghjkl;qwevxzc", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "qwertyuiop[]{}#@!%&"])
        mash = ("".join(rng.choice(keys) for _ in range(rng.randrange(2, 15))) for _ in range(rows * 3))
        return rng.choice([" ", " ", "\n"]).join(mash)
    text = pick(rows * 3).split()
    return " ".join(w.capitalize() if rng.random() < 0.15 else w for w in text) + "."


def training_set(prose: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: junk) of prose and of junk made of its words."""
    rng = random.Random(seed)
    texts, labels = [], []
    content: list[str] = []
    for text in prose:
        for shape in shapes_of_prose(text, rng):
            texts.append(shape)
            labels.append(0.0)
        content += [w.lower() for w in _WORD.findall(text) if len(w) > 3 and w.lower() not in COMMON_WORDS]
    spaced = [w for w in content if not _SPACELESS.search(w)] or ["word"]
    for _ in range(2 * len(texts)):
        some = rng.sample(spaced, min(len(spaced), 40))
        texts.append(junk_of(some, rng))
        labels.append(1.0)
    return np.array([statistics(t) for t in texts]), np.array(labels)


def fit(prose: list[str]) -> Trees:
    """Trees trained on the weak labels, calibrated on the hand-checked texts."""
    prose = [t for t in prose if t and t.strip()]
    if len(prose) < LEAST_TEXTS:  # the built-in texts too, all of them in several shapes
        prose = prose + SEED_PROSE
        prose *= -(-LEAST_TEXTS // len(prose))
    x, y = training_set(prose)
    trees = Trees(rounds=60).fit(x, y)
    held = np.array([statistics(t) for t, _ in HOLDOUT])
    return trees.calibrate(held, np.array([float(label) for _, label in HOLDOUT]))


def sample_prose(documents: DataFrame, most: int = TRAIN_TEXTS) -> list[str]:
    """At most ``most`` texts under notes/, those with the smallest hashes of a part of the keys
    that holds about twice as many, so that the tasks send no more than that."""
    rows = in_folder(documents, "notes")
    part = max(1, rows.count() // (2 * most))
    h = F.xxhash64(*KEY)
    rows = rows.where((F.pmod(h, F.lit(part)) == 0) & (F.length(F.trim("text")) > SHORTEST))
    picked = rows.select("text", h.alias("h")).orderBy("h").limit(most).collect()
    return list(dict.fromkeys(r["text"] for r in picked))


def text_statistics(documents: DataFrame) -> DataFrame:
    """The key and all statistics of every text, null texts included (all 0)."""
    schema = ", ".join(["corpus_id string", "doc_seq int", *(f"{n} double" for n in NAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c) for c in x.T)], names=[*KEY, *NAMES]
            )

    return documents.select(*KEY, "text").mapInArrow(run, schema).dropDuplicates(KEY)


def junk_probabilities(documents: DataFrame, folder: str = "inbox") -> DataFrame:
    """``corpus_id, doc_seq, junk``: the probability that a text under the folder is not running
    prose. Null, empty and blank texts are no texts and do not appear."""
    trees = fit(sample_prose(documents))
    rows = in_folder(documents, folder).where(F.col("text").rlike(r"\S")).select(*KEY, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(trees.probability(x))], names=[*KEY, "junk"]
            )

    return rows.mapInArrow(run, "corpus_id string, doc_seq int, junk double")


def junk_documents(documents: DataFrame) -> DataFrame:
    """``corpus_id, doc_seq`` of the texts under inbox/ that are not running prose, each once."""
    return junk_probabilities(documents).where(F.col("junk") > JUNK).select(*KEY).distinct()
