"""YAML documents at the edge of the engine; inside, tables are Parquet."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # YAML is optional
    yaml = None


def _parser():
    if yaml is None:
        raise RuntimeError("reading and writing YAML needs the yaml package")
    return yaml


def read_yaml_docs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file that holds a mapping, with its name's stem as ``_file``; other files are left out."""
    parser = _parser()

    def run(it):
        for batch in it:
            stems, docs = [], []
            for stem, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    doc = parser.safe_load(body)
                except parser.YAMLError:
                    continue
                if isinstance(doc, dict):
                    stems.append(stem)
                    docs.append(json.dumps(doc, default=str))
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(docs, pa.string())], names=["_file", "_doc"])

    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.yaml")
    raw = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.yaml$", 1).alias("_file"), "value")
    return raw.mapInArrow(run, "_file string, _doc string").select("_file", F.from_json("_doc", schema).alias("_d")).select("_file", "_d.*")


def yaml_text(rows: DataFrame, name: str) -> DataFrame:
    """(name, body): each row's other columns as a YAML document, nulls left out."""
    parser = _parser()
    rest = [c for c in rows.columns if c != name]

    def run(it):
        for batch in it:
            bodies = [parser.safe_dump(json.loads(x), allow_unicode=True, sort_keys=False) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], names=["name", "body"])

    return rows.select(F.col(name).cast("string").alias("name"), F.to_json(F.struct(*rest)).alias("doc")).mapInArrow(run, "name string, body string")
