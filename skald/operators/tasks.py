"""The questions put to a language model, as a table: what each is told, what it must answer, and what holds where it does not.

A task runs over rows that have its inputs as columns.  Answers come from a
model (``open_caller``) or from a recording (prompt digest to answer), which is
a join and makes a run repeatable without a model.  An answer that is missing
or cannot be read, even after cut JSON is closed, gives the task's defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.documents import salvage_json
from .model_calls import ask, ask_text

RECORDING = "prompt_sha string, answer string"


@dataclass(frozen=True)
class Task:
    """``answer`` is the schema of the JSON answer, or empty for plain text; ``defaults`` are SQL expressions by field."""

    told: str
    inputs: tuple[str, ...]
    answer: str = ""
    defaults: dict[str, str] = field(default_factory=dict)
    tokens: int = -1
    context: int = 8192
    #: SQL condition on the inputs without which the task is not put at all.
    when: str = "true"

    def prompt(self) -> Column:
        parts = [F.lit(self.told)]
        for name in self.inputs:
            parts.append(F.concat(F.lit(f"\n\n{name.replace('_', ' ').capitalize()}:\n"), F.coalesce(F.col(name).cast("string"), F.lit("none"))))
        if self.answer:
            parts.append(F.lit(f"\n\nAnswer with JSON of the shape: {self.answer}"))
        return F.when(F.expr(self.when), F.concat(*parts))

    def run(self, rows: DataFrame, open_caller: Callable[[], Callable[[str], str]] | None = None, recording: DataFrame | None = None, into: str = "answer") -> DataFrame:
        """Adds the answer, as a struct with defaults filled in or as text."""
        if (open_caller is None) == (recording is None):
            raise ValueError("give a caller or a recording")
        if recording is not None:
            raw = recorded_answers(rows, self.prompt(), recording, into)
            found = parsed(raw, into, self.answer) if self.answer else raw
        elif self.answer:
            found = ask(rows, self.prompt(), open_caller, self.answer, into)
        else:
            found = ask_text(rows, self.prompt(), open_caller, into)
        if not self.answer:
            return found.withColumn(into, F.coalesce(F.col(into), F.lit(self.defaults.get("text", "''").strip("'"))))
        fields = T.StructType.fromDDL(self.answer).fields
        filled = [F.coalesce(F.col(f"{into}.{f.name}"), F.expr(self.defaults.get(f.name, "null")).cast(f.dataType)).alias(f.name) for f in fields]
        return found.withColumn(into, F.struct(*filled))


def recorded_answers(rows: DataFrame, prompt: Column, recording: DataFrame, into: str) -> DataFrame:
    """Adds the recorded answer to each row's prompt; null where none is recorded."""
    known = recording.groupBy(F.col("prompt_sha").alias("_sha")).agg(F.max("answer").alias(into))
    return rows.withColumn("_sha", F.sha2(prompt, 256)).join(known, "_sha", "left").drop("_sha")


def record(rows: DataFrame, task: Task, open_caller: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(prompt_sha, answer): what a model says to the task's prompts, each asked once."""
    asked = rows.select(task.prompt().alias("prompt")).where("prompt is not null").distinct()
    return ask_text(asked, F.col("prompt"), open_caller, "answer").select(F.sha2("prompt", 256).alias("prompt_sha"), "answer").where("answer is not null")


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The column's JSON texts, cut ones closed, as structs."""
    names = rows.columns
    at = names.index(column)

    def run(it):
        import json

        for batch in it:
            found = [salvage_json(x) if x else {} for x in batch.column(at).to_pylist()]
            texts = pa.array([json.dumps(x if isinstance(x, dict) else {}) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return rows.mapInArrow(run, rows.schema).withColumn(column, F.from_json(column, schema))


_NAMES = "array<string>"
_SCENE = ("text",)
_WHEN = "`when` struct<period: string, time_of_day: string, duration: string>"
_WHERE = "`where` struct<locations: array<struct<canonical_name: string, description: string, attributes: array<string>>>>"
_CHARACTER = "struct<canonical_name: string, author: string, appellations: array<string>, description_physical: string, description_psychological: string, job: string, relations: array<struct<character: string, relation: string>>>"
_EMPTY = "array()"

#: Token and context limits are fixed values of the tasks, as are the defaults.
TASKS: dict[str, Task] = {
    "translate": Task("Translate these role-play messages from French to English; keep names, *actions* and quotes.", _SCENE, "messages array<struct<index: int, content_en: string>>", {"messages": _EMPTY}, 2048),
    "boundaries": Task("Say before which messages a new scene begins.", _SCENE, "boundaries array<int>, reasons array<string>", {"boundaries": _EMPTY, "reasons": _EMPTY}, 200, when="n_messages >= 4"),
    "same_scene": Task("Does the talk before belong to the scene that opens with an action?", ("prefix", "opening"), "same_scene boolean", {"same_scene": "false"}, 50),
    "merge": Task("Is the second segment the first one going on? Think of the cast, the place and the gap in hours.", ("before", "after", "gap_hours"), "merge boolean", {"merge": "false"}, 60),
    "synthesis": Task("Tell what happens, who does what and what stays open.", ("known_names", *_SCENE), "characters array<struct<name: string, action: string>>, tensions array<string>, narrative string", {"characters": _EMPTY, "tensions": _EMPTY, "narrative": "''"}, 2048),
    "gate": Task("Is this role-play, or talk of the players?", ("lore", *_SCENE), "is_rp boolean, score double, reason string, flags array<string>", {"is_rp": "true", "score": "1.0", "reason": "''", "flags": _EMPTY}, 256, 4096),
    "context": Task("When and where does the scene take place?", ("earlier", *_SCENE), f"{_WHEN}, {_WHERE}", {}, 2048),
    "who": Task("Who takes part, and which author plays whom?", ("earlier", "authors", *_SCENE), f"characters array<{_CHARACTER}>, author_to_character map<string, string>, ooc array<string>, inconsistencies array<string>", {"characters": _EMPTY, "author_to_character": "map()", "ooc": _EMPTY, "inconsistencies": _EMPTY}, 6144, 12288),
    "which": Task("Which things, groups and ideas of this world matter here?", ("known_names", *_SCENE), "concepts array<struct<canonical_name: string, type: string, description: string>>, inconsistencies array<string>", {"concepts": _EMPTY, "inconsistencies": _EMPTY}, 2048, 12288),
    "what": Task("What happens, event by event?", ("earlier", "characters", *_SCENE), "summary string, events array<struct<description: string, type: string, characters: array<string>>>, inconsistencies array<string>", {"summary": "''", "events": _EMPTY, "inconsistencies": _EMPTY}, 3072),
    "how": Task("How do the events follow from each other, and how do the characters stand to each other?", ("earlier", "events", *_SCENE), "links array<struct<from_event: string, to_event: string, type: string, strength: string>>, character_relations array<struct<from_char: string, to_char: string, relation_type: string, sentiment: string>>, synthesis string, inconsistencies array<string>", {"links": _EMPTY, "character_relations": _EMPTY, "synthesis": "''", "inconsistencies": _EMPTY}, 3072),
    "voice": Task("How does this character speak?", ("name", *_SCENE), "tone string, vocabulary string, rhythm string, verbal_tics array<string>, favourite_topics array<string>, examples array<string>, style_break string, voice_prompt string", {"verbal_tics": _EMPTY, "favourite_topics": _EMPTY, "examples": _EMPTY}, 1024, 6144, when="length(text) >= 30"),
    "recurrences": Task("What returns over these scenes?", ("digest",), "themes array<string>, actions array<string>, objects array<string>, interactions array<string>, summary string", {"themes": _EMPTY, "actions": _EMPTY, "objects": _EMPTY, "interactions": _EMPTY, "summary": "''"}, 1024, when="n_scenes >= 2"),
    "axes": Task("Along which lines does the story move over these scenes?", ("digest",), "axes array<struct<name: string, strength: string>>, strongest_links array<string>, summary string", {"axes": _EMPTY, "strongest_links": _EMPTY, "summary": "''"}, 2048, when="n_scenes >= 2"),
    "same_entity": Task("Which of these names are the same person?", ("names", "contexts"), "groups array<struct<canonical: string, variants: array<string>>>", {"groups": _EMPTY}, 512),
    "answer": Task("Answer the question from the context alone.", ("context", "question"), context=16384),
    "creative": Task("Suggest scenes that take up what the story has left aside.", ("context", "question"), context=16384),
    "catch_up": Task("Tell a player what the character missed, and what the character cannot know.", ("context", "question"), context=12000),
    "goals": Task("Tell the character's aims and how far they have come.", ("context", "question")),
    "missing": Task("Which scenes are spoken of but were not played?", ("context", "question")),
    "validate": Task("Does the draft agree with what is known?", ("context", "question"), context=10000),
    "role_play": Task("Answer as the character would.", ("context", "question")),
    "react": Task("How would the character react?", ("context", "question"), context=10000),
    "when": Task("When does the scene take place?", _SCENE, "period string, time_of_day string, duration string", {"period": "''", "time_of_day": "''", "duration": "''"}, 512),
    "where": Task("Where does the scene take place?", _SCENE, "locations array<struct<canonical_name: string, description: string>>", {"locations": _EMPTY}, 2048),
    "cast": Task("Who takes part in the scene?", _SCENE, f"characters array<{_CHARACTER}>", {"characters": _EMPTY}, 2048),
}
