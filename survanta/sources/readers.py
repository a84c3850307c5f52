"""Readers for uploaded tables and text files."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that stand for a missing value in a text table.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
           "NaN", "None", "n/a", "nan", "null")


class ReadError(ValueError):
    """The file cannot be read as a table."""


def _sniff(spark: SparkSession, path: str) -> str:
    head = [r[0] for r in spark.read.text(path).limit(20).collect()]
    try:
        return csv.Sniffer().sniff("\n".join(head), delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def _with_nulls(df: DataFrame) -> DataFrame:
    cells = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return df.select(*[F.when(~c.isin(*MISSING), c).alias(n) for c, n in zip(cells, df.columns)])


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV with a header, every column as text, missing-value words as null; the delimiter is guessed from the first lines."""
    return _with_nulls(spark.read.csv(path, header=True, sep=sep or _sniff(spark, path), quote='"', escape='"'))


def read_csv_gz(spark: SparkSession, path: str) -> DataFrame:
    """Gzip CSV. One file is one task to read, so the rows are spread out afterwards."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return _with_nulls(spark.read.csv(path, header=True, quote='"', escape='"').repartition(n))


def read_zip_csv(spark: SparkSession, path: str) -> DataFrame:
    """First CSV member of each zip file, every column as text, missing-value words as null. Many zips are read in
    parallel; the format lets one task read one zip, and that holds its packed content in memory."""
    blobs = spark.read.format("binaryFile").load(path).select("path", "content")

    def member(name, content):
        archive = zipfile.ZipFile(io.BytesIO(content))
        first = next((m for m in archive.namelist() if m.lower().endswith(".csv")), None)
        if first is None:
            raise ValueError(f"no CSV file in {name}")
        lines = csv.reader(io.TextIOWrapper(archive.open(first), "utf-8", newline=""))
        return next(lines, []), lines

    def headers(batches):
        for batch in batches:
            yield pd.DataFrame({"names": [member(*x)[0] for x in zip(batch["path"], batch["content"])]})

    found = blobs.mapInPandas(headers, "names array<string>").first()
    if found is None or not found["names"]:
        raise ReadError("the zip holds no rows")
    names = list(found["names"])

    def rows(batches):
        # Files may order their columns differently, so cells are put in the order of ``names`` once per file.
        for batch in batches:
            for x in zip(batch["path"], batch["content"]):
                own, lines = member(*x)
                at = [own.index(n) if n in own else None for n in names]
                while block := list(itertools.islice(lines, 10000)):
                    yield pd.DataFrame({"cells": [[r[i] if i is not None and i < len(r) else None for i in at] for r in block]})

    cells = blobs.mapInPandas(rows, "cells array<string>")
    return _with_nulls(cells.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]))


def read_table(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Reader chosen by suffix: ``.csv``, ``.csv.gz``, ``.zip`` or none (CSV); ``max_bytes`` refuses larger files."""
    if max_bytes is not None:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        if size > max_bytes:
            raise ReadError(f"the file is larger than {max_bytes // (1024 * 1024)} MB")
    suffixes = re.findall(r"\.[a-z0-9]+", path.rsplit("/", 1)[-1].lower())
    last = suffixes[-1] if suffixes else ""
    if last == ".zip":
        return read_zip_csv(spark, path)
    if last == ".gz" and ".csv" in suffixes:
        return read_csv_gz(spark, path)
    if last in (".csv", ""):
        return read_csv(spark, path)
    raise ReadError("CSV, CSV.GZ and ZIP with a CSV are supported")


def read_texts(spark: SparkSession, paths) -> DataFrame:
    """Whole text files as ``source, text``; bytes that are not UTF-8 are left out."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("source"),
                      F.translate("value", "\ufffd", "").alias("text"))
