"""Batch search, sheets and the mended record rules: against plain versions and literals."""

import random

import numpy as np
from pyspark.sql import functions as F

from skald.functions import sheets
from skald.operators import analytics, records, search


def test_nearest_equals_brute_force_in_blocks(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], rng.choice("ab")) for i in range(300)] + [(300, None, "a"), (301, [1.0], "a"), (302, [0.0] * 4, "a")]
    asked = [(f"q{i}", [rng.choice([-1.0, 1.0, 0.5]) for _ in range(4)], rng.choice(["a", "b", None])) for i in range(20)] + [("none", None, "a"), ("zero", [0.0] * 4, "a")]
    v = spark.createDataFrame(vectors, "id long, e array<double>, c string").repartition(5)
    q = spark.createDataFrame(asked, "q string, e array<double>, c string")

    def best(e, c):
        rows = []
        for i, x, kind in vectors[:300]:
            if any(x) and (c is None or kind == c):
                rows.append((-round(float(np.dot(e, x) / np.linalg.norm(e) / np.linalg.norm(x)), 9), i))
        return [i for _, i in sorted(rows)[:7]]

    want = {name: best(e, c) for name, e, c in asked[:20]}
    for block in (1 << 20, 64):
        got: dict = {}
        for r in search.nearest(q, "q", v, "id", "e", 7, "c", block_bytes=block).orderBy("question", "place").collect():
            got.setdefault(r.question, []).append(r.key)
        assert got == want
    assert search.nearest(q.limit(0), "q", v, "id", "e", 7).count() == 0 and search.nearest(q, "q", v.limit(0), "id", "e", 7).count() == 0


def test_nearest_runs_no_job_for_a_block_and_takes_questions_of_any_length(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(3 + i % 2)], "a") for i in range(120)]
    v = spark.createDataFrame(vectors, "id long, e array<double>, c string").repartition(3)
    q = spark.createDataFrame([(i, e) for i, e, _ in vectors[:40]], "q long, e array<double>")
    sc = spark.sparkContext
    sc.setJobGroup("nearest", "")
    found = search.nearest(q, "q", v, "id", "e", 3, block_bytes=64, cell_bytes=256)
    built = len(sc.statusTracker().getJobIdsForGroup("nearest"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert built <= 8, "each block ran its own jobs and sent its questions through the driver"
    got: dict = {}
    for r in found.orderBy("question", "place").collect():
        got.setdefault(r.question, []).append(r.key)
    cosine = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    assert got == {i: [y for _, y in sorted((-cosine(e, x), j) for j, x, _ in vectors if len(x) == len(e))[:3]] for i, e, _ in vectors[:40]}


def test_names_first_then_the_nearest(spark):
    named = spark.createDataFrame([(1, "Lena", 2), (1, "Bob", 1)], "q long, name string, o long")
    near = spark.createDataFrame([(1, "lena", 0), (2, "Cid", 0), (2, "Dan", 1)], "q long, name string, place long")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "q long")
    assert {tuple(r) for r in search.named_or_near(named, near, "q", "name").collect()} == {(1, "lena", True), (1, "bob", True), (2, "cid", False), (2, "dan", False)}
    assert {tuple(r) for r in search.identified(asked, "q", named, near, "name", "o").collect()} == {(1, "Bob"), (2, "Cid"), (3, None)}
    hits = near.withColumns({"category": F.lit("characters"), "summary": F.when(F.col("name") == "Cid", "a cook")})
    assert {tuple(r) for r in search.context_block(hits, "q", "category", "name", "summary", "place").collect()} == {(1, "[characters] lena: "), (2, "[characters] Cid: a cook\n[characters] Dan: ")}


def test_indexed_entities(spark):
    rows = spark.createDataFrame([("Lena", "kept", 1), ("Bob", "", 2), ("", "x", 3), (None, "x", 4), ("Cid", None, 5)], "name string, _summary string, n long")
    card = F.when(F.col("n") == 2, F.concat("name", F.lit(" card")))
    made = search.indexed(rows, F.lit("characters"), card, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert {(r.name, r.summary, tuple(r.embedding or ())) for r in made.collect()} == {("Lena", "kept", (4.0, 1.0)), ("Bob", "Bob card", (8.0, 1.0)), ("Cid", None, ())}


def test_sheets_on_literals(spark, tmp_path):
    who = spark.createDataFrame(
        [("lena marchal", "smith", "", ["Red"], None, "calm", ["fire"], [], [f"s{i}" for i in range(22)]), ("bob", "", "Y", [], "tall", "", [], ["inn"], []), ("", "", "", [], "", "", [], [], [])],
        "name string, job string, author string, appellations array<string>, description_physical string, description_psychological string, beliefs array<string>, main_locations array<string>, appearances array<string>",
    )
    relations = spark.createDataFrame([("s1", 0, "Lena Marchal", "Bob", "ally", "warm"), ("s2", 0, "bob the tall", "lena marchal", None, "cold"), ("s3", 0, "x", "y", "a", "b")], "scene string, pos long, from_char string, to_char string, relation_type string, sentiment string")
    summaries = spark.createDataFrame([("s0", "It begins"), ("s1", "")], "scene string, summary string")
    made = sheets.character_sheets(who, relations, summaries)
    got = {r.slug: r.sheet for r in made.collect()}
    scenes = "\n".join(["- `s0`: It begins", *(f"- `s{i}`" for i in range(1, 20))])
    assert got["lena_marchal"] == (
        f"# Lena Marchal\n\n## Identity\n**Role:** smith\n**Known as:** Red\n\n## Psychology\ncalm\n\n## Beliefs & values\n- fire\n\n## Relations\n- **bob**: ally (warm)\n- **bob the tall**: ? (cold)\n\n"
        f"## Scene appearances (22)\n{scenes}\n- _... 2 more_\n\n_First appearance: s0_"
    )
    assert got["bob"] == "# Bob\n\n## Identity\n**Author:** Y\n\n## Physical description\ntall\n\n## Main locations\n- inn\n\n## Relations\n- **lena marchal**: ? (cold)\n\n_First appearance: ?_" and set(got) == {"lena_marchal", "bob"}
    where = spark.createDataFrame([("old inn", ["inn"], "dark", ["warm", "loud"], ["s0"])], "name string, appellations array<string>, description string, attributes array<string>, appearances array<string>")
    assert sheets.place_sheets(where, summaries).first().sheet == "# Old Inn\n\n**Also called:** inn\n\n## Description\ndark\n\n## Attributes\n- warm\n- loud\n\n## Scene appearances (1)\n- `s0`: It begins\n\n_First appearance: s0_"
    lines = [r.line for r in sheets.index_lines(who.where("name <> ''"), where).orderBy("part", "name").collect()]
    assert lines == ["## Characters (2)", "- [Bob](characters/bob.md) — ? (0 scenes)", "- [Lena Marchal](characters/lena_marchal.md) — smith (22 scenes)", "## Places (1)", "- [Old Inn](places/old_inn.md) (1 scenes)"]
    sheets.write_sheets(made, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True).collect()
    assert {r.slug: r.value.removesuffix("\n") for r in back} == got


def test_relations_meet_characters_as_pairs_of_ends(spark):
    who = spark.createDataFrame([("lena",), ("bob",)], "name string")
    said = [(i, i % 3, "Lena" if i % 2 else "old Lena", "Bob" if i % 5 else None, f"r{i}", "s") for i in range(400)]
    relations = spark.createDataFrame(said, "scene long, pos long, from_char string, to_char string, relation_type string, sentiment string")
    made = sheets._last_relations(who, relations, rows_per_task=50)
    assert {r.who: r.related for r in made.collect()} == {"lena": "## Relations\n- ****: r395 (s)\n- **bob**: r399 (s)\n", "bob": "## Relations\n- **lena**: r399 (s)\n- **old lena**: r398 (s)\n"}
    parts = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert len(parts) == 2 and all(x.rstrip().endswith("8") for x in parts), parts


def test_anchors_join_names(spark):
    rows = [("Lena", 0), ("red (x)", 1), ("Red", 2), ("Marchal", 3), ("lena marchal", 4), ("Gaul", 5), ("gaull", 6), ("", 7), (None, 8)]
    names = spark.createDataFrame(rows, "n string, place long")
    anchors = spark.createDataFrame([("Lena", ["red", None]), ("Nobody", [])], "canonical string, aliases array<string>")
    got: dict = {}
    for r in records.anchored_clusters(names, "n", anchors).collect():
        got.setdefault(r.canonical, set()).add(r.name)
    assert got == {"Lena": {"lena", "red (x)", "red", "marchal", "lena marchal"}, "gaull": {"gaul", "gaull"}}


def test_gaps_degrees_and_unions(spark):
    found = spark.createDataFrame([("Lena", "unknown", ["a"], [], []), ("bob", "cook", None, ["g"], []), ("cid", "", ["x"], None, None)], "name string, job string, likes array<string>, short array<string>, long array<string>")
    lore = spark.createDataFrame([(" lena", "smith", ["A", "B", "b", "c"], ["s"], ["l"]), ("BOB", "unknown", ["z"], ["q"], ["r"]), ("cid", "unknown", None, None, ["w"])], "name string, job string, likes array<string>, short array<string>, long array<string>")
    got = {r.name: tuple(r)[1:] for r in records.gap_filled(found, lore, "name", ["job"], ["likes"], ["short", "long"]).collect()}
    assert got == {"Lena": ("smith", ["a", "B", "c"], ["s"], ["l"]), "bob": ("cook", ["z"], ["g"], []), "cid": ("", ["x"], [], ["w"])}
    edges = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a")], "x string, y string")
    assert {tuple(r) for r in records.scaled_degrees(edges, "x", "y").collect()} == {("a", 1, 1800.0), ("b", 1, 1800.0)}
    items = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    assert spark.range(1).select(analytics.ordered_union(items("b", "C", "B", "A"), items("A", "Dd"))).first()[0] == ["A", "Dd", "b", "c"]
    spoken = records.spoken_names(items("moi", "the", "Your", "qui", "Lena"), items("x"))
    assert spark.range(1).select(spoken).first()[0] == ["Lena"]
