"""State of scenes, manifests, resumed work and joins: against plain versions, restarts and literals."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from skald.operators import carried
from skald.plans.state import order_scenes
from skald.streaming.carried import carry_stream

SF = "/root/testdata/sf0.001"


def _plain(r):
    return r.asDict(recursive=True)


def _carried(df):
    return {(r["export"], r["scene"]): (r["previous_characters"], r["previous_authors"], [(e["scene"], e["narrative"]) for e in r["context"]]) for r in map(_plain, df.collect())}


SCENES = [
    ("a", 1, ["Ann", None], {"p": "Ann"}, "one"), ("a", 2, [], None, "two"), ("a", 3, ["ann ", "Bob"], {}, None), ("a", 5, None, {"q": "Bob"}, "five"),
    ("a", 7, ["BOB", "bob"], {}, "seven"), ("b", 1, ["Ann"], {}, "other"), (None, 1, ["x"], {}, ""), ("a", None, ["x"], {}, ""), ("a", 5, None, {"q": "Bob"}, "five"),
]
SCENE_TYPE = "export string, scene long, characters array<string>, authors map<string,string>, narrative string"


def test_carried_scenes_on_literals(spark):
    got = _carried(carried.carry(spark.createDataFrame(SCENES, SCENE_TYPE), most=2))
    assert got == {
        ("a", 1): ([], {}, []),
        ("a", 2): (["Ann", None], {"p": "Ann"}, [(1, "one")]),
        ("a", 3): ([], {}, [(1, "one")]),
        ("a", 5): (["ann ", "Bob"], {}, [(2, "two"), (3, None)]),
        ("a", 7): ([], {"q": "Bob"}, [(3, None)]),
        ("b", 1): ([], {}, []),
    }


def test_carried_stream_equals_batch_over_restarts(spark, tmp_path):
    scenes = order_scenes(spark, SF).where("export < 60").unionByName(spark.createDataFrame(SCENES, SCENE_TYPE).select(F.lit(-1).cast("long").alias("export"), "scene", "characters", "authors", "narrative").where("scene < 6"))
    want = _carried(carried.carry(scenes, most=3))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    cuts = [r[0] for r in scenes.selectExpr("percentile(scene, array(0.3, 0.6))").collect()][0]
    for low, high in [(-1, cuts[0]), (cuts[0], cuts[1]), (cuts[1], 1e9)]:
        scenes.where(F.col("scene") > low).where(F.col("scene") <= high).repartition(2).write.mode("append").parquet(source)
        stream = carry_stream(spark.readStream.schema(scenes.schema).parquet(source), most=3)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(300)
    rows = spark.read.parquet(out)
    assert _carried(rows) == want and rows.count() == len(want)


# --- steps and manifests

TALK = "export string, scene long, pos long, author string, content string, content_en string, ts timestamp"
ACT = "*Ann slowly opens the heavy door of the old inn*"


def _talk(spark, scenes):
    rows = [(export, scene, pos, "a", text, None, None) for (export, scene), texts in scenes.items() for pos, text in enumerate(texts)]
    return spark.createDataFrame(rows, TALK)


TALES = {
    ("x", 0): ["lol ok see you", "brb", ACT, "he speaks of the long road north to the sea", ACT.replace("Ann", "Bob")],
    ("x", 1): [ACT.replace("Ann", "Bob"), "  He speaks of THE long road north to the sea", "*Cid walks all the way back to the silent city*", "then the rain falls over the field and the road"],
    ("x", 2): ["ok", "lol", "^^", "brb ok now"],
    ("x", 3): ["the inn is warm tonight, she says to herself", "a man from the north asks for a bed here", ACT, ACT],
    ("y", 0): [ACT, "so it is, says the old man by the fire to all of them", "*the night comes down on the quiet harbour town*", "*and then at last the ship comes in again*", ACT],
}


def _no_cuts(rows):
    return rows.select("export", "scene").distinct().withColumn("boundaries", F.array().cast("array<int>"))


def _texts(scenes):
    out = {}
    for r in scenes.orderBy("export", "scene", "pos").collect():
        out.setdefault((r.export, r.scene), []).append(r.content)
    return out


def test_subdivide_on_literals(spark):
    from skald.operators import scene_steps as S

    cuts = spark.createDataFrame([("y", 0, [0, 2, 2, 9, -1]), ("x", 9, [1])], "export string, scene long, boundaries array<int>")
    asked = []

    def decide(groups):
        asked.extend(tuple(r) for r in groups.collect())
        return groups.withColumn("same", F.lit(True))

    kept, queue = S.subdivide(_talk(spark, TALES), cuts, decide)
    got = _texts(kept)
    assert got[("x", 0)] == TALES[("x", 0)][2:]  # talk before the first action goes
    assert got[("x", 1)] == TALES[("x", 1)][2:]  # what repeats the part before goes, case and spaces aside
    assert ("x", 2) not in got and got[("x", 3)] == TALES[("x", 3)]  # the queued part has a number of its own; a prefix like that stays
    assert got[("y", 0)] == TALES[("y", 0)][:2] and got[("y", 1)] == TALES[("y", 0)][2:]
    assert [(r.export, r.source_scene, r.scene, r.reason, r.n_messages, r.preview) for r in queue.collect()] == [("x", 2, 2, "no_narrative", 4, "ok")]
    assert [a[:2] for a in asked] == [("x", 3)] and asked[0][-2].startswith("a: the inn is warm") and asked[0][-1] == f"a: {ACT}\na: {ACT}"
    trimmed, _ = S.subdivide(_talk(spark, TALES), cuts)  # nobody to ask: what is unclear goes
    assert _texts(trimmed)[("x", 3)] == [ACT, ACT]


def test_purge_and_clean_on_literals(spark):
    import datetime as dt

    from skald.operators import scene_steps as S

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("e", p, "a", t, None, m if m is None else at(m)) for p, (t, m) in enumerate([("hello there", 0), ("---", 20), ("late one", 45), ("gone", 200), ("x y zz", None), ("more here", 210)])]
    messages = spark.createDataFrame(rows, "export string, pos long, author string, content string, content_en string, ts timestamp")
    got = [(r.scene, r.pos, r.content) for r in S.purge(messages, 1800, 2).orderBy("scene", "pos").collect()]
    assert got == [(0, 0, "x y zz"), (0, 1, "hello there"), (0, 2, "late one"), (1, 0, "gone"), (1, 1, "more here")]  # the separator bridges the gap, but is no message

    long = [(0, 5_000, 12, "ok"), (1, 0, 16, ACT), (2, 100, 4, ACT), (3, 1_000_000, 9, ACT), (4, 1_000_100, 3, ACT)]
    rows = [("e", s, p, "a", "ok" if t == "ok" else ACT, None, at(m + p)) for s, m, n, t in long for p in range(n)] + [("e", 1, 99, "a", "ok", None, at(50))]
    cleaned = S.clean_scenes(spark.createDataFrame(rows, TALK))
    sizes = {r.scene: (r["n"], r["first"]) for r in cleaned.groupBy("scene").agg(F.count("*").alias("n"), F.min("ts").alias("first")).collect()}
    # the earliest takes what follows within ten days: 16 (its last talk trimmed) + 4 + 12; the two of later on, 9 + 3, are one
    assert sizes == {0: (32, at(0)), 1: (12, at(1_000_000))}
    apart = S.clean_scenes(spark.createDataFrame(rows, TALK), lambda pairs: pairs.withColumn("same", F.col("after").contains("ok")))
    assert sorted(r["count"] for r in apart.groupBy("scene").count().collect()) == [32 - 4] or sorted(r["count"] for r in apart.groupBy("scene").count().collect())[-1] >= 16


class _Killed(Exception):
    pass


def _files(path):
    from pathlib import Path

    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("part-*"))


def test_processed_items_are_done_once_whatever_dies(spark, tmp_path):
    from skald.streaming.processed import subdivider

    talk = _talk(spark, TALES)
    steps = [talk.where("scene < 2"), talk.where("scene = 2"), talk.where("scene >= 1")]  # the last repeats scenes that are done
    clean, broken = subdivider(spark, str(tmp_path / "clean"), _no_cuts), subdivider(spark, str(tmp_path / "broken"), _no_cuts)
    for n, rows in enumerate(steps):
        clean(rows, n)
    items = talk.select("export", "scene").schema
    want = {name: sorted(map(str, clean.table(name, items).collect())) for name in ("scenes", "queue")}
    assert len({r.scene for r in clean.table("scenes", items).where("export = 'x'").collect()}) == 3 and clean.done(items).count() == 5

    made = broken.make
    for n, rows in enumerate(steps):
        def dies(fresh, before, made=made):
            out = made(fresh, before)
            return {"scenes": out["scenes"]}  # the second output is missing: the batch dies after the first is written

        broken.make = dies
        with pytest.raises(KeyError):
            broken(rows, n)
        assert broken.done(items).where(F.col("batch") == n).count() == 0 and broken.table("scenes", items).count() == sum(1 for _ in broken.table("scenes", items, but=n).collect())
        broken.make = made
        broken(rows, n)
        broken(rows, n)  # repeated after it was noted
    assert {name: sorted(map(str, broken.table(name, items).collect())) for name in ("scenes", "queue")} == want


def test_processed_in_a_stream_with_restart(spark, tmp_path):
    from skald.streaming.processed import subdivider

    talk = _talk(spark, TALES)
    sink = subdivider(spark, str(tmp_path / "out"), _no_cuts)
    source = str(tmp_path / "in")
    for part in (talk.where("scene < 2"), talk.where("scene >= 2"), talk.where("scene = 0")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(talk.schema).parquet(source).writeStream.foreachBatch(sink)
        stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(300)
    items = talk.select("export", "scene").schema
    other = subdivider(spark, str(tmp_path / "byhand"), _no_cuts)
    other(talk.where("scene < 2"), 0)
    other(talk.where("scene >= 2"), 1)
    assert sorted(map(str, sink.table("scenes", items).collect())) == sorted(map(str, other.table("scenes", items).collect()))
