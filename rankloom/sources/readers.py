"""Scans with fixed schemas: CSV catalogues, strict JSON lines, runs, HTML."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import normalize_space
from rankloom.operators.quality import require_columns, require_unique

RUN_SCHEMA = "query_id string, doc_id string, score double, scores map<string,double>"


def read_catalog(spark: SparkSession, paths: list[str], columns: list[str], *, separator: str = ",") -> DataFrame:
    """Delimited files as strings, white space normalised, missing as '', with file and line order in row_id.

    Headers are checked; row_id follows the order of ``paths`` and the place in each file.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    parts = []
    for i, p in enumerate(paths):
        header = spark.read.option("header", True).option("sep", separator).option("encoding", "UTF-8").csv(p).columns
        require_columns(spark.createDataFrame([], T.StructType([T.StructField(c.lstrip("﻿"), T.StringType()) for c in header])), columns)
        df = spark.read.schema(schema).option("header", True).option("sep", separator).option("multiLine", True).option("mode", "FAILFAST").csv(p)
        parts.append(df.select(*[normalize_space(F.coalesce(c, F.lit(""))).alias(c) for c in columns], F.lit(i).alias("file_no"), F.monotonically_increasing_id().alias("line_no")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a closed schema; a malformed line, NaN or infinity fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", False).json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A stored run, rows or one map of scores per query; keys must be unique."""
    raw = spark.read.schema(RUN_SCHEMA).option("mode", "FAILFAST").json(path)
    rows = raw.filter("doc_id is not null").select("query_id", "doc_id", "score")
    maps = raw.filter("doc_id is null").select("query_id", F.explode("scores").alias("doc_id", "score"))
    return require_unique(rows.unionByName(maps), ["query_id", "doc_id"])


def first_known(*names: str):  # noqa: ANN201 - a Column
    """The first non-empty of alternative fields."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])


class _Page(HTMLParser):
    SKIP = {"script", "style", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.links, self.hidden, self.in_title = "", [], [], 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.hidden += tag in self.SKIP
        self.in_title |= tag == "title"
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in self.SKIP and self.hidden > 0
        self.in_title &= tag != "title"

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.hidden and data.strip():
            self.parts.append(data.strip())


def parse_page(source: str | None) -> tuple[str, str, list[str]]:
    """(title, text, links) of an HTML page."""
    p = _Page()
    p.feed(source or "")
    p.close()
    return p.title.strip(), html.unescape(" ".join(p.parts)), p.links


def html_pages(pages: DataFrame, *, key: str, source: str) -> DataFrame:
    """(key, title, text, links) of each page, in Arrow batches."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse_page(s) for s in pdf["s"]]
            yield pd.DataFrame({"k": pdf["k"], "title": [g[0] for g in got], "text": [g[1] for g in got], "links": [g[2] for g in got]})

    return pages.select(F.col(key).alias("k"), F.col(source).alias("s")).mapInPandas(run, f"k {kind}, title string, text string, links array<string>").withColumnRenamed("k", key)
