"""``python -m voxcorpus.cli --folder DIR | --url URL``: measures a corpus and writes its files.

A corpus is measured against a baseline of other writing: a table (``--baseline``), or a folder of general texts
(``--baseline-texts``), whose counts are kept in ``--baseline-cache`` for the next time. A corpus is never measured
against itself.
"""

from __future__ import annotations

import argparse
from pathlib import Path
import sys
import time
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from voxcorpus.functions import lists as L
from voxcorpus.operators.cadence import total_words
from voxcorpus.operators.vocabulary import baseline_from
from voxcorpus.plans.fingerprint import fingerprint
from voxcorpus.shipping import ship
from voxcorpus.sources import pages as P
from voxcorpus.sources import sinks
from voxcorpus.sources.folder import read_folder


def options(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="voxcorpus", description=__doc__)
    p.add_argument("--url", help="address to begin a crawl at")
    p.add_argument("--pages", help="table of pages (page_id, url, html, status_code) that stands for the web; else HTTP")
    p.add_argument("--folder", help="folder of Markdown, HTML and text files")
    p.add_argument("--baseline", help="table of (token, cnt, rate, rnk)")
    p.add_argument("--baseline-texts", help="folder of general texts a baseline is built from")
    p.add_argument("--baseline-cache", default=str(Path.home() / ".cache" / "voxcorpus" / "baseline.parquet"))
    p.add_argument("--delay", type=float, default=1.0, help="seconds between two requests")
    p.add_argument("--timeout", type=float, default=10.0)
    p.add_argument("--output-dir", "-o", default="./fingerprint")
    p.add_argument("--brand-name")
    p.add_argument("--max-pages", type=int, default=20)
    p.add_argument("--inspect", action="store_true", help="print histogram, vocabulary and distances too")
    return p.parse_args(args)


def summary(f: dict) -> list[str]:
    """Tone, the first words of both lists, and a warning where there is little text."""
    lines = [f"tone {f['tone']['primary_tone']} ({f['tone']['confidence']:.0%})"]
    for key in ("signature_words", "forbidden_words"):
        lines.append(key.replace("_", " ") + ": " + ", ".join(w["token"] for w in f[key][:8]))
    if f["thin_corpus"]:
        lines.append(f"fewer than {L.THIN_WORDS:,} words: the list of avoided words is noisy")
    return lines


def report(f: dict) -> str:
    """The inspection: histogram, most frequent words, nearest and farthest sentences, ratios, timings."""
    c, v = f["cadence"], f["voice"]
    lines = [f"sentences {c['sentence_count']}, words {c['word_count']}, mean {c['mean_length']:.1f}, deviation {c['std_length']:.1f}"]
    lines += [f"{h['lo']:6.1f}-{h['hi']:6.1f} {h['n']:6d} {h['bar']}" for h in c["histogram"]] or ["(no sentences)"]
    lines += [f"{i:3d}. {t:<20} {n}" for i, (t, n) in enumerate(v["top_vocab"][:20], 1)]
    for name in ("closest_to_centroid", "farthest_from_centroid"):
        lines += [name, *(f"  {x['distance']:.4f} {x['text'][:180]!r}" for x in v[name][:5])]
    lines.append(f"first person {c['pronoun_ratio_first']:.1%}, second person {c['pronoun_ratio_second']:.1%}")
    lines.append(f"milliseconds {f['timings_ms']}")
    return "\n".join(lines)


def find_baseline(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame, str] | None:
    """The baseline and its name, or None if there is none to be had. A cache that cannot be read is built anew."""
    if o.baseline:
        return spark.read.parquet(o.baseline), Path(o.baseline).stem
    if o.baseline_texts:
        texts = Path(o.baseline_texts).resolve()
        built = baseline_from(read_folder(spark, str(texts)))
        built.coalesce(1).write.mode("overwrite").parquet(o.baseline_cache)  # BASELINE_TOP rows at most
        Path(o.baseline_cache, "_name").write_text(texts.name, encoding="utf-8")
    try:
        cached = spark.read.parquet(o.baseline_cache)
        if not {"token", "cnt", "rate", "rnk"} <= set(cached.columns):
            return None
        name = Path(o.baseline_cache, "_name")
        return cached, name.read_text(encoding="utf-8") if name.exists() else Path(o.baseline_cache).stem
    except AnalysisException:
        return None


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = options(args)
    if bool(o.url) == bool(o.folder):
        print("give either --url or --folder", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("voxcorpus").getOrCreate()
    ship(spark)
    began = time.perf_counter()
    base = find_baseline(spark, o)
    if base is None:
        print("there is no baseline: give --baseline TABLE, or once --baseline-texts FOLDER", file=sys.stderr)
        return 1
    if o.url:
        host = urlparse(o.url).netloc
        name, source = o.brand_name or host.removeprefix("www.") or "Unknown", o.url
        if o.pages:
            docs = P.crawl(spark, o.url, P.table_fetcher(spark.read.parquet(o.pages), host), o.max_pages)
        else:
            docs = P.crawl(spark, o.url, P.http_fetcher(timeout=o.timeout), o.max_pages, o.delay)
    else:
        folder = Path(o.folder).resolve()
        name, source = o.brand_name or folder.name, f"folder:{folder.name}"
        docs = read_folder(spark, str(folder))
    docs = docs.persist()
    try:
        return measure(spark, o, docs, name, source, base, began)
    finally:
        docs.unpersist()


def measure(spark: SparkSession, o: argparse.Namespace, docs: DataFrame, name: str, source: str, base: tuple[DataFrame, str], began: float) -> int:
    """Measures documents, writes the files and prints the summary."""
    n = docs.count()
    if not n:
        print("no documents", file=sys.stderr)
        return 1
    words = total_words(docs, []).first()["total_words"]
    print(f"{n} documents, {words:,} words")
    f = fingerprint(spark, docs, base[0], name, source, baseline_name=base[1])
    out = Path(o.output_dir)
    for path in (
        sinks.write_fingerprint(f, out / "voice-fingerprint.json"),
        sinks.write_brand_config(f, out / "brand-config.json"),
        sinks.write_style_prompt(f, out / "style-prompt.md"),
    ):
        print(path)
    print("\n".join(summary(f)))
    print(f"{time.perf_counter() - began:.1f} s")
    if o.inspect:
        print(report(f))
    return 0


if __name__ == "__main__":
    sys.exit(main())
