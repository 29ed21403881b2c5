"""Nested merges against a plain fold, overrides on literals, containment, translation and tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skald.operators import containment, nested_merge, overrides, tasks, translation

RECORD = (
    "canonical_name string, at long, description_physical string, gender string, likes array<string>, relations array<struct<character: string, relation: string>>, "
    "dominant_emotions array<string>, personality_axes map<string, string>, competency_axes map<string, string>, emotional_range string"
)


def _union(old, new, low):
    out = list(old)
    for x in new or []:
        if x and x.lower() not in [y.lower() for y in out]:
            out.append(x.lower() if low else x)
    return out


def _fold(parts):
    """The record of one character by folding its partial records one after another."""
    out = {"description_physical": None, "gender": None, "likes": [], "relations": [], "dominant_emotions": [], "personality_axes": {}, "competency_axes": {}, "emotional_range": None}
    emotions: list = []
    for p in sorted(parts, key=lambda p: p[1]):
        _, _, text, gender, likes, relations, felt, axes, ranks, range_ = p
        text = (text or "").strip().lower()
        if len(text) > len(out["description_physical"] or ""):
            out["description_physical"] = text
        gender = (gender or "").strip().lower()
        if gender and gender != "unknown":
            out["gender"] = gender
        out["likes"] = _union(out["likes"], likes, True)
        for c, r in relations or []:
            if c and (c.lower(), (r or "").lower()) not in out["relations"]:
                out["relations"].append((c.lower(), (r or "").lower()))
        emotions = _union(emotions, felt, True)
        for a, v in (axes or {}).items():
            try:
                v = int(v)
            except (TypeError, ValueError):
                continue
            out["personality_axes"][a] = round((out["personality_axes"][a] + v) / 2) if a in out["personality_axes"] else v
        for a, v in (ranks or {}).items():
            v = (v or "").lower()
            if v and (a not in out["competency_axes"] or nested_merge.RANKS.get(v, 0) > nested_merge.RANKS.get(out["competency_axes"][a], 0)):
                out["competency_axes"][a] = v
        if range_:
            out["emotional_range"] = range_
    out["dominant_emotions"] = emotions[-5:]
    return out


def test_characters_equal_a_plain_fold(spark):
    rng = random.Random(9)
    pick = lambda *xs: rng.choice(xs)
    parts = []
    for at in range(200):
        words = [rng.choice(["Ale", "ale", "Rain", "the sea", "", None, "ÉTÉ", "été"]) for _ in range(rng.randint(0, 4))]
        parts.append((
            pick("Lena", " lena ", "BOB", "Cid", "", None), at, pick("tall", " Tall ", "a scar", "", None, "grey eyes"), pick("Unknown", "F", "m", "", None), words, pick([], None, [("Bob", "Ally"), ("bob", "ally"), (None, "x"), ("Cid", None)]),
            [rng.choice("abcdefgh")], {pick("calm", "loyal"): pick("2", "-1", "1", "x", None)}, {pick("stealth", "empathy"): pick("low", "HIGH", "odd", "", None, "none")}, pick("wide", "narrow", "", None),
        ))
    rows = spark.createDataFrame(parts, RECORD).repartition(5)
    rules = {k: nested_merge.CHARACTER_SCENES[k] for k in ("description_physical", "gender", "likes", "relations", "dominant_emotions", "personality_axes", "competency_axes", "emotional_range")}
    got = {r.canonical_name: r.asDict() for r in nested_merge.merge_records(rows, "canonical_name", "at", rules).collect()}
    names = {n.strip().lower() for n, *_ in parts if n}
    assert set(got) == names
    for name in names:
        want = _fold([p for p in parts if (p[0] or "").strip().lower() == name])
        r = got[name]
        assert {**r, "relations": [tuple(x) for x in r["relations"]]} == {"canonical_name": name, **want}


def test_chunk_rules_on_literals(spark):
    rows = spark.createDataFrame([("a", 0, "unknown", "One", "x", [("d1", "t"), ("", "t")]), ("a", 1, "F", "two", None, None), ("a", 2, "m", "", "y", [("d2", None)]), ("b", 0, None, None, None, None), ("b", 1, "Unknown", "z", "", None), ("b", 2, " F ", "zz", "q", None)],
        "k string, at int, gender string, prompt string, style_break string, events array<struct<description: string, type: string>>")
    got = nested_merge.merge_records(rows, "k", "at", {"gender": "started", "prompt": "joined", "style_break": "first", "events": "events"}).orderBy("k").collect()
    assert [(r.gender, r.prompt, r.style_break, [e.description for e in r.events]) for r in got] == [("unknown", "One two", "x", ["d1", "d2"]), ("f", "z zz", "q", [])]
    assert [tuple(r) for r in nested_merge.compiled(rows.select("k", "at", "gender"), "k", "at").orderBy("k").collect()] == [("a", 2, "m"), ("b", 2, " F ")]
    with pytest.raises(ValueError):
        nested_merge.merge_records(rows, "k", "at", {"gender": "loudest"})


def test_overrides_put_get_delete_on_three_levels(spark):
    rows = [
        ("character", " Lena", "job", '"smith"', 1), ("character", "lena", "goals", '{"short": ["a"], "long": {"first": "b", "deep": {"er": 1}}}', 2), ("character", "LENA", "goals.long.first", '"c"', 3),
        ("character", "lena", "goals.short", None, 4), ("character", "lena", "age", "not json", 5), ("character", "bob", "goals.long.first", '"gone"', 1), ("character", "bob", "goals", '{"short": "new"}', 2),
        ("place", "lena", "job", '"inn"', 1), ("character", "bob", "job", "12", 7),
    ]
    table = overrides.put(spark.createDataFrame([], overrides.TABLE), spark.createDataFrame(rows, overrides.TABLE))
    got = {(r.kind, r.name): json.loads(r.record) for r in overrides.laid_over(table).collect()}
    assert got == {("character", "lena"): {"job": "smith", "goals": {"long": {"first": "c", "deep": {"er": 1}}}}, ("character", "bob"): {"job": 12, "goals": {"short": "new"}}, ("place", "lena"): {"job": "inn"}}
    base = spark.createDataFrame([("Lena", "baker", "30"), ("Cid", "cook", None)], "name string, job string, age string")
    assert [tuple(r) for r in overrides.with_overrides(base, "name", table, "character", ["job", "age"]).orderBy("name").collect()] == [("Cid", "cook", None), ("Lena", "smith", "30")]
    less = overrides.delete(table, spark.createDataFrame([("character", "LENA ")], "kind string, name string"))
    assert {(r.kind, r.name) for r in overrides.laid_over(less).collect()} == {("character", "bob"), ("place", "lena")}
    again = overrides.put_all(less, base.withColumn("tags", F.array(F.lit("t"))), "character", ["job", "age", "tags"], F.lit(9).cast("long"))
    assert json.loads(overrides.laid_over(again).where("name = 'lena' and kind = 'character'").first().record) == {"job": "baker", "age": "30", "tags": ["t"], "_manual": True}


def test_names_in_texts_equal_brute_force_without_nested_loops(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "É", *("".join(rng.choices("abcÉ ", k=rng.randint(1, 60))) for _ in range(80)), "ab" * 30_000]
    names = [None, "", "A", "é", "ab", "abc", "bca", "zzz", "abz", *("".join(rng.choices("abcé ", k=rng.randint(1, 6))) for _ in range(60))]
    t, n = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(x,) for x in names], "n string")
    found = containment.names_in_texts(n, "n", t, "id", "text")
    assert {tuple(r) for r in found.collect()} == {(x.lower(), i) for x in names if x for i, y in enumerate(texts) if y and x.lower() in y.lower()}
    assert found.count() == found.distinct().count()
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_names_across_pieces_of_a_long_text_and_no_row_for_each_gram(spark):
    border = containment.CHUNK
    long = "x" * (border - 5) + "lena of marchal" + "y" * border + "é" * 7
    texts = [(1, long), (2, "LENA OF MARCHA"), (3, "lena of marchall"), (4, "")]
    names = ["Lena of Marchal", "ma", "É", "yéé", "xlena o", "marchaly", "marchalz", "éééééééé"]
    t, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in names], "n string")
    found = containment.names_in_texts(n, "n", t, "id", "text")
    assert sorted(tuple(r) for r in found.collect()) == sorted((x.lower(), i) for x in names for i, y in texts if x.lower() in y.lower())
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_details_of_a_character(spark):
    entities = spark.createDataFrame([("Lena", [1, 2, 2, None]), ("", [1]), (None, [1]), ("Bob", None)], "name string, appearances array<long>")
    details = spark.createDataFrame([(1, 1, "the LENA one"), (1, 0, "young lena"), (2, 0, None), (3, 0, "lena"), (2, 1, "lenah")], "scene long, pos long, canonical_name string")
    assert {tuple(r) for r in containment.details_of(entities, details).select("name", "scene", "pos").collect()} == {("Lena", 1, 0), ("Lena", 2, 1)}


def test_translation_asks_only_for_what_is_missing(spark, tmp_path):
    def _noting(folder):
        """A model that notes how many messages each call has, and answers them."""
        import os
        import uuid

        def call(prompt):
            lines = [x for x in prompt.split("\n") if x.startswith("[")]
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(str(len(lines)))
            return json.dumps({"messages": [{"index": i, "content_en": x.split("] ", 1)[1].upper()} for i, x in enumerate(lines)]})

        return call

    rows = [("e", s, p, f"t{s}-{p}", "kept" if (s, p) == (0, 3) else None) for s in range(2) for p in range(45)]
    messages = spark.createDataFrame(rows, "export string, scene long, pos long, content string, content_en string")
    none = spark.createDataFrame([], "export string, scene long, pos long, content_en string")
    folder = str(tmp_path)
    first = translation.translate(messages.where("scene = 0 and pos < 30"), none, lambda: _noting(folder)).select("export", "scene", "pos", "content_en").cache()
    assert {r.pos: r.content_en for r in first.collect()} == {p: "kept" if p == 3 else f"T0-{p}" for p in range(30)}
    calls = lambda: sorted(int(p.read_text()) for p in tmp_path.iterdir())
    assert calls() == [9, 20]
    whole = translation.translate(messages, first, lambda: _noting(folder)).cache()
    assert whole.where("content_en = upper(content) or pos = 3 and scene = 0").count() == 90
    assert calls() == [5, 9, 15, 20, 20, 20]  # 15 are left of scene 0, scene 1 is whole
    assert translation.translate(messages, whole, lambda: _noting(folder)).where("content_en is null").count() == 0 and len(calls()) == 6
    assert translation.passthrough(messages).where("content_en = content").count() == 89


@pytest.mark.parametrize("name", sorted(tasks.TASKS))
def test_every_task_answers_or_gives_its_defaults(spark, name):
    task = tasks.TASKS[name]
    inputs = {c for c in (*task.inputs, "n_messages", "n_scenes", "text")}
    row = spark.range(3).select("id", *(F.lit(9).alias(c) if c.startswith("n_") else F.concat(F.lit(f"{c} of the scene that is long enough "), F.col("id").cast("string")).alias(c) for c in sorted(inputs)))
    if task.answer:
        from pyspark.sql import types as T

        blank = {f.name: ([] if isinstance(f.dataType, T.ArrayType) else {} if isinstance(f.dataType, (T.MapType, T.StructType)) else True if isinstance(f.dataType, T.BooleanType) else 2.5 if isinstance(f.dataType, T.DoubleType) else "said") for f in T.StructType.fromDDL(task.answer)}
    else:
        blank = "said"
    recording = tasks.record(row.where("id < 2"), task, lambda: lambda prompt: (json.dumps(blank) if task.answer else blank) if prompt.find("enough 0") >= 0 else "[broken")
    got = {r.id: r.answer for r in task.run(row, recording=recording).collect()}
    live = {r.id: r.answer for r in task.run(row, open_caller=lambda: lambda prompt: (json.dumps(blank) if task.answer else blank) if prompt.find("enough 0") >= 0 else 1 / 0).collect()}
    if not task.answer:
        assert got == {0: "said", 1: "[broken", 2: ""} and live == {0: "said", 1: "", 2: ""}
        return
    for field, value in blank.items():
        if value in ("said", True, 2.5):
            assert got[0][field] == value == live[0][field]
    assert got[1] == got[2] == live[1] == live[2]
    for field, sql in task.defaults.items():
        assert got[2][field] == {"array()": [], "map()": {}, "''": "", "true": True, "false": False, "1.0": 1.0}[sql]
