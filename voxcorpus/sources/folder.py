"""A folder of Markdown, HTML and text files as a corpus."""

from __future__ import annotations

import re

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxcorpus.functions import lists as L
from voxcorpus.functions import text as T
from voxcorpus.functions.html import file_content_column

SUFFIXES = (*L.MARKDOWN_SUFFIXES, *L.HTML_SUFFIXES, *L.TEXT_SUFFIXES)


def documents_of_files(files: DataFrame, path: Column, text: Column) -> DataFrame:
    """``path, title, text`` of whole files; other suffixes, and texts under 20 characters, are left out.

    Undecodable characters are dropped. HTML goes through Python in Arrow batches, the other
    files never leave the JVM.
    """
    rows = files.select(
        path.alias("path"),
        F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("suffix"),
        F.replace(text, F.lit("�"), F.lit("")).alias("raw"),
    ).where(F.col("suffix").isin(*SUFFIXES))
    plain = rows.where(~F.col("suffix").isin(*L.HTML_SUFFIXES)).select(
        "path",
        F.when(F.col("suffix").isin(*L.MARKDOWN_SUFFIXES), T.markdown_heading(F.col("raw"))).otherwise("").alias("heading"),
        F.when(F.col("suffix").isin(*L.MARKDOWN_SUFFIXES), T.strip_markdown(F.col("raw"))).otherwise(F.col("raw")).alias("body"),
    )
    html = rows.where(F.col("suffix").isin(*L.HTML_SUFFIXES)).withColumn("c", file_content_column(F.col("raw")))
    html = html.select("path", F.col("c.title").alias("heading"), F.col("c.text").alias("body"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    out = plain.unionByName(html).withColumn("text", T.normalize_whitespace(F.col("body")))
    return out.where(F.length("text") >= L.MIN_FILE_CHARS).select(
        "path", T.pick_title(F.col("heading"), F.col("text"), stem).alias("title"), "text"
    )


def hidden_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, value`` of the files the file source passes over: those with a dot or underscore before their
    name or that of a folder below the root. The driver lists names only; tasks read the files."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = len(store.makeQualified(root).toUri().getPath())
    files, names = store.listFiles(root, True), []
    while files.hasNext():
        uri = files.next().getPath().toUri()
        below = uri.getPath()[top:]
        if re.search(r"/[._]", below) and below.rsplit(".", 1)[-1].lower() in SUFFIXES:
            names.append((uri.toString(), uri.getPath()))

    def read(parts):
        for part in parts:
            texts = []
            for uri, path in zip(part["uri"], part["file"]):
                try:
                    store, where = (pafs.LocalFileSystem(), path) if uri.startswith(("file:", "/")) else pafs.FileSystem.from_uri(uri)
                    with store.open_input_stream(where) as f:
                        texts.append(f.read().decode("utf-8", "ignore"))
                except OSError:
                    texts.append(None)
            yield pd.DataFrame({"file": part["file"], "value": texts})

    listed = spark.createDataFrame(names, "uri string, file string")
    return listed.repartition(max(1, min(len(names), 256))).mapInPandas(read, "file string, value string")


def read_folder(spark: SparkSession, folder: str, corpus_id: str = "folder") -> DataFrame:
    """A folder and those below it as ``corpus_id, doc_seq, path, title, text``, in order of their paths.

    Names that begin with a dot or underscore count too; unreadable files do not.
    """
    files = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .load(folder)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    # file:///a/b.md, with its name percent-encoded, below the folder
    named = files.select(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("file"), "value")
    below = "/" + re.sub("^[a-z]+:/+", "", folder).strip("/") + "/"
    both = named.unionByName(hidden_files(spark, folder))
    docs = documents_of_files(both, F.substring_index("file", below, -1), F.col("value"))
    seq = F.row_number().over(Window.orderBy("path"))  # a folder's files, of one corpus
    return docs.select(F.lit(corpus_id).alias("corpus_id"), seq.alias("doc_seq"), "path", "title", "text")
