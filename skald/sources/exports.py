"""Readers and writers of chat exports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MESSAGE = "struct<author: string, content: string, timestamp: string>"


def _author(raw: str = "author"):
    """A plain name, or the name inside an object."""
    return F.coalesce(F.get_json_object(raw, "$.name"), F.col(raw))


def read_json_exports(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(export, pos, author, content, ts) of files holding {"messages": [...]} or a bare list.

    A file of any other shape fails the job, or is left out where not ``strict``.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    raw = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("export"), "value")
    kind = f"array<{_MESSAGE}>"
    wrapped = F.from_json("value", f"messages {kind}")["messages"]
    bare = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", kind))
    found = F.coalesce(wrapped, bare)
    if strict:
        found = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no messages in the export "), "export")).cast(kind)).otherwise(found)
    each = raw.select("export", F.posexplode(found).alias("pos", "m"))
    return each.select("export", F.col("pos").cast("long").alias("pos"), _author("m.author").alias("author"), F.coalesce("m.content", F.lit("")).alias("content"), _time("m.timestamp").alias("ts"))


def _csv_rows(text: str) -> list[tuple[int, str, str, str]]:
    """(place, author, content, timestamp) of a CSV text with a header; the delimiter is found in its first 4096 characters."""
    import csv
    import io

    text = text.removeprefix("\ufeff")
    try:
        delimiter = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        delimiter = ","
    out = []
    for n, row in enumerate(csv.DictReader(io.StringIO(text, newline=""), delimiter=delimiter)):
        named = {k.strip().lower(): v for k, v in row.items() if isinstance(k, str) and isinstance(v, str)}
        author, content, at = (named.get(c, "").strip() for c in ("author", "content", "timestamp"))
        if content:
            out.append((n, author, content, at))
    return out


def read_csv_exports(spark: SparkSession, path: str) -> DataFrame:
    """The same of CSV files with a header, each with its own delimiter (comma, semicolon, tab or bar); rows with empty content are left out.

    ``pos`` is the row's place in its file.  A file is read in one task, as
    quoted line breaks let no reader begin in the middle.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.csv")
    raw = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1).alias("export"), "value")

    def run(it):
        for batch in it:
            for export, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = _csv_rows(text)
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    columns = [[export] * len(part), *map(list, zip(*part))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["export", "pos", "author", "content", "at"])

    rows = raw.mapInArrow(run, "export string, pos long, author string, content string, at string")
    return rows.select("export", "pos", "author", "content", _time_of(F.col("at")).alias("ts"))


def read_exports(spark: SparkSession, path: str, default_author: str | None = None) -> DataFrame:
    """All JSON and CSV exports below a folder; messages without an author get the default."""
    both = read_json_exports(spark, path).unionByName(read_csv_exports(spark, path))
    return both if default_author is None else both.withColumn("author", F.coalesce(F.nullif("author", F.lit("")), F.lit(default_author)))


def _time(name: str):
    return _time_of(F.col(name))


def _time_of(value):
    """Full ISO dates only; anything else is null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value))


def write_scenes(scenes: DataFrame, path: str) -> None:
    scenes.write.mode("overwrite").partitionBy("export").parquet(path)


def write_chat_lines(examples: DataFrame, column: str, path: str) -> None:
    examples.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
