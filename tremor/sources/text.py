"""Raw exports read as text: types are decided by the mapping, never inferred."""

from __future__ import annotations

import csv as csv_module
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import with_position_id

# Texts that stand for a missing value.
NULL_VALUES = ("", "NULL", "null", "NA", "N/A")
_MORE = "__more"


def read_source(spark: SparkSession, path, file_format: str = "csv",
                options: dict | None = None) -> DataFrame:
    """A firm's file as a frame of text columns (Parquet keeps its own types).

    Options: separator, skip_rows, encoding, null_values, truncate_ragged_lines,
    multi_line (quoted line breaks; such a file is read by one task).

    A line with more fields than the header fails the read, whichever columns are
    used later, unless ``truncate_ragged_lines`` cuts it.  A line with fewer is
    filled up with nulls.
    """
    options = options or {}
    if file_format == "parquet":
        return spark.read.parquet(*_paths(path))
    csv = csv_options(options)
    cut = bool(options.get("truncate_ragged_lines"))
    skip = int(options.get("skip_rows", 0))
    if skip:
        raw = _after_preamble(spark, path, skip, csv, cut)
    else:
        raw = _with_header(spark, path, csv, bool(options.get("multi_line")), cut)
    missing = list(options.get("null_values", NULL_VALUES))
    cleaned = {c: F.when(~F.col(f"`{c}`").isin(missing), F.col(f"`{c}`")) for c in raw.columns}
    return raw.select(*[v.alias(c) for c, v in cleaned.items()])


def csv_options(options: dict) -> dict:
    """Spark's CSV options for a profile's read options."""
    encoding = {"utf8": "UTF-8", "utf-8": "UTF-8"}.get(
        options.get("encoding", "utf8").lower(), options.get("encoding"))
    return {
        "sep": options.get("separator", ","), "encoding": encoding,
        "mode": "PERMISSIVE",
        # Quotes are doubled inside quoted fields, as spreadsheets write them.
        "escape": '"', "nullValue": "", "emptyValue": "",
    }


def _paths(path) -> list[str]:
    return [str(p) for p in path] if isinstance(path, (list, tuple)) else [str(path)]


def _surplus(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Fail on a row whose line went on after its last column.

    The check sits in the value of every column, so it holds for whatever is selected or counted.
    """
    fine = F.col(_MORE).isNull() | F.raise_error(F.concat(F.lit("more fields than the header has: "), F.col(_MORE))).cast("boolean")
    return rows.where(fine).select(*[F.col(f"`{c}`") for c in columns])


def local_name(path: str) -> str:
    """A file URI as a plain path."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme == "file" else path


def read_lines(spark: SparkSession, files, encoding: str = "UTF-8", whole: bool = False) -> DataFrame:
    """``key, part, line, value, size``: the lines of several files, numbered from 0 within each part.

    ``files`` are (path, key); a path may be a folder, whose files are the parts.  Empty lines are
    left out.  With ``whole`` all lines are there, as bytes, cut at line feeds alone: the parts' bytes are
    the lines joined by line feeds, with one more at the end if ``size`` says so.  One row a part comes to
    the driver, to tell whose it is.
    """
    text = spark.read.option("lineSep", "\n").text([p for p, _ in files]) if whole else spark.read.text([p for p, _ in files])
    tagged = text.select("value", F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_size").alias("size"))
    if whole:
        tagged = tagged.withColumn("value", F.col("value").cast("binary"))
    else:
        if encoding != "UTF-8":
            # The line reader keeps bytes as they are.
            tagged = tagged.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
        tagged = tagged.where(F.length("value") > 0)
    lines = with_position_id(tagged, "line", per_file=True)
    keys = {local_name(p).rstrip("/"): key for p, key in files}
    owners = []
    for row in text.select(F.col("_metadata.file_path").alias("part")).distinct().collect():
        place = local_name(row["part"])
        while place not in keys and "/" in place:
            place = place.rsplit("/", 1)[0]
        owners.append((row["part"], keys[place]))
    named = spark.createDataFrame(owners, "__part string, key string")
    return lines.join(F.broadcast(named), F.col("part") == F.col("__part")).select("key", "part", "line", "value", "size")


def _with_header(spark: SparkSession, path, csv: dict, multi_line: bool, cut: bool) -> DataFrame:
    paths = _paths(path)
    reader = spark.read.options(**csv, multiLine=multi_line)
    columns = reader.csv(paths, header=True, inferSchema=False).columns
    if cut:
        return reader.csv(paths, header=True, inferSchema=False)
    # One more column than the header takes what should not be there.
    schema = ", ".join(f"`{c}` string" for c in (*columns, _MORE))
    wide = reader.option("enforceSchema", True).option("header", True).schema(schema).csv(paths)
    return _surplus(wide, columns)


def _after_preamble(spark: SparkSession, path, skip: int, csv: dict, cut: bool) -> DataFrame:
    """Drop the first lines of every file; the next one is the header."""
    text = spark.read.text(_paths(path))
    if csv["encoding"] != "UTF-8":
        # The line reader keeps bytes as they are.
        text = text.select(F.decode(F.col("value").cast("binary"), csv["encoding"]).alias("value"))
    lines = with_position_id(text, "__line", per_file=True)
    header = lines.where(F.col("__line") == skip).select("value").first()
    if header is None:
        raise ValueError(f"no header after {skip} skipped rows")
    columns = next(csv_module.reader([header["value"]], delimiter=csv["sep"]))
    schema = ", ".join(f"`{c}` string" for c in (*columns, _MORE))
    rows = lines.where(F.col("__line") > skip).where(F.length("value") > 0)
    parsed = rows.select(F.from_csv("value", schema, csv).alias("r")).select("r.*")
    return parsed.drop(_MORE) if cut else _surplus(parsed, columns)
