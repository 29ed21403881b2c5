import pytest
from pyspark.sql import functions as F

from skald.operators import merges as M
from skald.operators import model_calls
from skald.plans.catalogue import QUERIES
from skald.sources import yaml_docs

SF = "/root/testdata/sf0.001"


def test_priority_union_keeps_order(spark):
    row = spark.sql("select array('B', 'a') as m, array('A', 'c') as o, cast(null as array<string>) as n")
    got = row.select(M.priority_union(F.col("m"), F.col("o")).alias("x"), M.priority_union(F.col("n"), F.col("o")).alias("y")).first()
    assert (got.x, got.y) == (["b", "a", "c"], ["a", "c"])


def test_priority_map_skips_blank(spark):
    row = spark.sql("select map('a', '1', 'b', ' ') as m, map('b', '2', 'c', '3') as o")
    assert row.select(M.priority_map(F.col("m"), F.col("o")).alias("x")).first().x == {"a": "1", "b": "2", "c": "3"}


def test_aliases(spark):
    row = spark.sql("select array('b', 'x', 'a') as v, 'x' as c")
    assert row.select(M.aliases(F.col("v"), F.col("c")).alias("x")).first().x == ["a", "b"]


def test_highest_takes_first_of_equals_and_skips_empty(spark):
    rows = spark.createDataFrame([(1, "low"), (2, "high"), (3, "high"), (4, ""), (5, None)], "o int, v string")
    assert rows.agg(M.highest("v", "o", {"low": 1, "high": 3}).alias("x")).first().x == "high"
    assert rows.where("o > 3").agg(M.highest("v", "o", {"low": 1}).alias("x")).first().x is None


def test_upsert_ignores_empty_values(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, version int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 2, " "), ("c", 2, None)], "k string, version int, v string")
    got = {r.k: r.v for r in M.upsert(old, new, ["k"], "version", "v").collect()}
    assert got == {"a": "z", "b": "y"}


def test_short_scenes_merge_into_grown_one(spark):
    rows = [(1, 0, 20, 0, 1), (1, 1, 5, 2, 3), (1, 2, 5, 4, 5), (1, 3, 5, 1000, 1001), (1, 4, 20, 1002, 1003)]
    scenes = spark.createDataFrame(rows, "k int, o int, n int, a int, b int").selectExpr("k", "o", "n", "timestamp_seconds(a * 3600) as a", "timestamp_seconds(b * 3600) as b")
    got = M.merge_short_scenes(scenes, ["k"], ["o"], "n", "a", "b").orderBy("o").collect()
    assert [r.merged for r in got] == [0, 0, 0, 1, 2]
    refused = M.merge_short_scenes(scenes, ["k"], ["o"], "n", "a", "b", F.lit(False)).orderBy("o").collect()
    assert [r.merged for r in refused] == [0, 1, 2, 3, 4]


def test_model_answers_are_salvaged_and_failures_are_empty(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "cut"), (3, "bad"), (4, None)], "i int, p string")

    def caller():
        def call(p):
            if p == "bad":
                raise RuntimeError
            return '{"is_rp": true, "tags": ["a"' if p == "cut" else '{"is_rp": true}'

        return call

    got = {r.i: r.answer for r in model_calls.ask(rows, F.col("p"), caller, "is_rp boolean, tags array<string>").collect()}
    assert [got[i].is_rp for i in (1, 2, 3, 4)] == [True, True, None, None]
    assert got[2].tags == ["a"]


def test_translation_falls_back(spark):
    rows = spark.createDataFrame([("un", "one"), ("deux", ""), ("trois", None)], "t string, a string")
    assert [r.content_en for r in model_calls.translated(rows, "t", F.col("a")).collect()] == ["one", "deux", "trois"]


def test_yaml_round_trip(spark, tmp_path):
    pytest.importorskip("yaml")
    rows = spark.createDataFrame([("anna", "Ämter", ["a", "b"]), ("ben", None, [])], "name string, about string, tags array<string>")
    for r in yaml_docs.yaml_text(rows, "name").collect():
        (tmp_path / f"{r.name}.yaml").write_text(r.body)
    (tmp_path / "bad.yaml").write_text("a: [1")
    got = {r._file: (r.about, r.tags) for r in yaml_docs.read_yaml_docs(spark, str(tmp_path), "about string, tags array<string>").collect()}
    assert got == {"anna": ("Ämter", ["a", "b"]), "ben": (None, [])}


def test_synthesis_merge_joins_whole_texts(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("turn").collect():
        turns.setdefault(r.conv_id, []).append(r.text)
    want = {k: (" ".join(t for t in texts if t is not None), len(texts)) for k, texts in turns.items()}
    assert {r.conv_id: (r.narrative, r.parts) for r in QUERIES["synthesis_merge"](spark, SF).collect()} == want


def test_scene_gaps_has_a_row_for_every_scene(spark):
    want, last = {}, {}
    for r in spark.read.parquet(f"{SF}/orders.parquet").orderBy("o_orderdate", "o_orderkey").selectExpr("*", "unix_micros(cast(o_orderdate as timestamp)) as us").collect():
        before = last.get(r.o_custkey)
        want[r.o_custkey, r.o_orderkey] = None if before is None else r.us - before - 3_600_000_000
        last[r.o_custkey] = r.us
    got = QUERIES["scene_gaps"](spark, SF).collect()
    assert {(r.o_custkey, r.o_orderkey): r.gap_us if r.has_gap else None for r in got} == want and len(got) == len(want)
    assert all(r.gap_us == 0 for r in got if not r.has_gap)
    assert sum(not r.has_gap for r in got) == len(last)
