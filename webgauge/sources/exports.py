"""Exports of a run: CSV and JSON by Spark's writers, reports as small files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib import request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgauge.operators.diff import Report
from webgauge.operators.scan import placed
from webgauge.operators.views import export_rows, sort_keys
from webgauge.sources.tables import stored


def write_csv(views: DataFrame, path: str, sort: str = "score", descending: bool = False, files: int = 1) -> None:
    """Rows in order, in ``files`` files that follow each other."""
    ordered = views.orderBy(*sort_keys(sort, descending))
    rows = export_rows(ordered)
    (rows.coalesce(1) if files == 1 else rows).write.option("header", True).option("escape", '"').csv(path)


def write_json(run: DataFrame, summary: DataFrame, views: DataFrame, path: str) -> None:
    """A folder each for the run, its summary and its pages, one JSON object a line."""
    for name, df in (("run", run), ("summary", summary), ("pages", views)):
        df.write.json(f"{path}/{name}")


def document_lines(run: DataFrame, summary: DataFrame, ai: DataFrame, views: DataFrame, sort: str = "score", descending: bool = False) -> DataFrame:
    """at, line: one JSON document of a run, a page a line in the order asked for. run, summary and ai are of one row each."""
    spark = views.sparkSession
    one = lambda df, at, name, end: df.limit(1).select(F.lit(at).cast("long").alias("at"), F.concat(F.lit(f'"{name}":'), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), F.lit(end)).alias("line"))
    placed_ = placed(views, sort_keys(sort, descending), stored)
    last = placed_.agg(F.max("place")).first()[0]
    text = F.to_json(F.struct(*views.columns), {"ignoreNullFields": "false"})
    pages = placed_.select((F.col("place") + 10).alias("at"), F.concat(text, F.when(F.col("place") < last, ",").otherwise("")).alias("line"))
    fixed = spark.createDataFrame([(0, "{"), (5, '"pages":['), ((last or 0) + 11, "]}")], "at long, line string")
    return fixed.union(one(run, 1, "run", ",")).union(one(summary, 2, "summary", ",")).union(one(ai, 3, "ai", ",")).union(pages)


def write_document(run: DataFrame, summary: DataFrame, ai: DataFrame, views: DataFrame, path: str, sort: str = "score", descending: bool = False) -> None:
    """The document as one file at ``path``. Lines are sorted in ranges and passed on in order by one writer that holds none of them.

    The file appears when all of it is written; a run that fails leaves nothing there.
    """
    spark = views.sparkSession
    beside = f"{path}.writing-{uuid.uuid4().hex}"
    lines = document_lines(run, summary, ai, views, sort, descending).orderBy("at").select("line")
    lines.coalesce(1).write.text(beside)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(beside).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        part = next(x.getPath() for x in fs.listStatus(path_of(beside)) if x.getPath().getName().startswith("part-"))
        fs.delete(path_of(path), False)
        if not fs.rename(part, path_of(path)):
            raise OSError(f"{path} can't be written")
    finally:
        fs.delete(path_of(beside), True)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_report(report: Report, folder: str) -> list[str]:
    """run-N.json (JSON lines) and run-N.md of a difference, each a folder of text files that follow each other."""
    out = []
    for suffix, lines in (("json", report.as_json()), ("md", report.markdown())):
        out.append(f"{folder}/run-{report.runs[1]}.{suffix}")
        lines.write.text(out[-1])
    return out


def post_line(url: str, text: str, send: Callable[[str, bytes], int] | None = None) -> bool:
    """Tells a webhook; whether it took it. Never raises for what the other side does."""

    def by_http(to: str, body: bytes) -> int:
        with request.urlopen(request.Request(to, body, {"Content-Type": "application/json"}), timeout=10) as r:
            return r.status

    try:
        return 200 <= (send or by_http)(url, json.dumps({"text": text}).encode()) < 300
    except (OSError, ValueError):
        return False
