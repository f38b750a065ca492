"""Landing of workbooks as bronze rows, spread over the cluster by file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staffloom.sources.xlsx import sheet_rows

LANDED_SCHEMA = "source_path string, source_file string, sheet string, row_idx long, cells array<string>, error string"
BATCH_ROWS = 10_000


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _files(spark: SparkSession, path: str | list[str], exclude: Sequence[str]) -> DataFrame:
    """``source_path, source_file`` and what the listing and the files hold; full paths tell files of one name apart."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{xlsx,xlsm,xls}")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("path").alias("source_path"), file_name(F.col("path")).alias("source_file"), "length", "modificationTime", "content")
    )
    for prefix in exclude:
        files = files.filter(~F.col("source_file").startswith(prefix))
    return files


def discover_sources(spark: SparkSession, path: str, exclude: Sequence[str] = ("~$",)) -> DataFrame:
    """Workbook files under ``path``, without those whose name starts with an excluded prefix.

    File contents are pruned away: only the listing is read.
    """
    return _files(spark, path, exclude).drop("content")


def _land(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["source_path", "source_file", "sheet", "row_idx", "cells", "error"]
    for batch in batches:
        for *name, content in zip(batch["source_path"], batch["source_file"], batch["content"]):
            page: list[tuple] = []
            try:
                for sheet, number, cells in sheet_rows(content):
                    page.append((*name, sheet, number, cells, None))
                    if len(page) == BATCH_ROWS:
                        yield pd.DataFrame(page, columns=columns)
                        page = []
            except Exception as problem:  # a broken file is a finding, not a failed job
                page.append((*name, None, None, None, f"{type(problem).__name__}: {problem}"))
            if page:
                yield pd.DataFrame(page, columns=columns)


def land_workbooks(spark: SparkSession, path: str | list[str], exclude: Sequence[str] = ("~$",)) -> DataFrame:
    """All rows of all sheets of the workbooks under ``path``.

    Every file is read by one task and its rows leave in small batches.  A file
    that cannot be read gives one row with ``error`` set.  Write the result
    once and start from the written table, as each use of it reads the files;
    ``staffloom.sources.landing`` does so, and reads only files that are new.
    """
    return _files(spark, path, exclude).select("source_path", "source_file", "content").mapInPandas(_land, LANDED_SCHEMA)


def bronze_rows(landed: DataFrame) -> DataFrame:
    return landed.filter(F.col("error").isNull()).drop("error")


def landing_errors(landed: DataFrame) -> DataFrame:
    return landed.filter(F.col("error").isNotNull()).select("source_path", "source_file", "error")
