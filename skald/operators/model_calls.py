"""The boundary to a language model: prompts out, records in.

The caller is given, so the engine depends on no model.  Calls run where the
rows are; a failed or unreadable answer is an empty record, so that the
columns take their defaults.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.documents import salvage_json


def ask(rows: DataFrame, prompt: Column, open_caller: Callable[[], Callable[[str], str]], schema: str, into: str = "answer") -> DataFrame:
    """Adds the answer as a struct of ``schema``; ``open_caller`` runs once a task and returns the caller."""
    given = rows.withColumn("_prompt", prompt)
    out = T.StructType([*rows.schema.fields, T.StructField("_json", T.StringType())])
    at, names = len(rows.columns), [*rows.columns, "_json"]

    def run(it):
        import json

        call = None
        for batch in it:
            answers = []
            for p in batch.column(at).to_pylist():
                try:
                    call = call or open_caller()
                    found = salvage_json(call(p)) if p is not None else {}
                except Exception:  # a model that fails is a model that says nothing
                    found = {}
                answers.append(json.dumps(found if isinstance(found, dict) else {}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(answers, pa.string())], names=names)

    return given.mapInArrow(run, out).withColumn(into, F.from_json("_json", schema)).drop("_json")


def ask_text(rows: DataFrame, prompt: Column, open_caller: Callable[[], Callable[[str], str]], into: str = "answer") -> DataFrame:
    """Adds the answer as plain text; null where there is no prompt or the model fails."""
    given = rows.withColumn("_prompt", prompt)
    at, names = len(rows.columns), [*rows.columns, into]

    def run(it):
        call = None
        for batch in it:
            answers = []
            for p in batch.column(at).to_pylist():
                try:
                    call = call or open_caller()
                    answers.append(None if p is None else call(p))
                except Exception:
                    answers.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(answers, pa.string())], names=names)

    return given.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))


def translated(rows: DataFrame, text: str, answer: Column) -> DataFrame:
    """Adds ``content_en``: the answer, or the text itself where there is none."""
    return rows.withColumn("content_en", F.coalesce(F.nullif(F.trim(answer), F.lit("")), F.col(text)))
