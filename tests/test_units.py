from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skald.functions.documents import salvage_json
from skald.operators import analytics as A
from skald.operators import sessions, text
from skald.sources import exports

T0 = datetime(2024, 1, 1)


def _messages(spark, seconds, contents=None):
    rows = [(1, i, None if s is None else T0 + timedelta(seconds=s), (contents or ["text"] * len(seconds))[i]) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "k int, pos int, ts timestamp, content string")


def test_gap_is_strict(spark):
    got = sessions.mark_sessions(_messages(spark, [0, 1800, 3601]), ["k"], "ts", "pos").orderBy("pos").collect()
    assert [r.session for r in got] == [0, 0, 1]


def test_gap_counts_dropped_messages(spark):
    rows = _messages(spark, [0, 1500, 3000], ["text", "---", "text"])
    got = sessions.gap_sessions(rows, ["k"], "ts", "pos", min_size=1, keep=~text.drop_message(F.col("content"))).collect()
    assert [r.n for r in got] == [2]


def test_missing_time_comes_first(spark):
    got = sessions.mark_sessions(_messages(spark, [0, None, 10]), ["k"], "ts", "pos").collect()
    assert {r.session for r in got} == {0}


def test_drop_rules(spark):
    cases = [("", True), ("---", True), ("> quote", True), ("[15/01/2024] x", True), ("[12:30] x", True), ("<:smile:123>", True), ("https://x.y", True), ("[Yaya entre]", False), (None, True),
             ("[Today at 20:30] hi there", True), ("[2024-01-15] he said", True), ("[Bob — 15/01/2024 20:30] he said", True), ("[15 jan. 2024 à 20:30] il dit", True), ("[lundi 15.01.] il dit", True), (">quote", False), ("<@&12> ab", False)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r.i: r.d for r in rows.select("i", text.drop_message(F.col("c")).alias("d")).collect()}
    assert [got[i] for i in range(len(cases))] == [d for _, d in cases]


def test_chunk_counts(spark):
    for n, chunks in ((40, 1), (41, 2), (75, 2), (76, 3)):
        rows = spark.range(n).select(F.lit(1).alias("k"), "id")
        assert sessions.overlapping_chunks(rows, ["k"], "id").agg(F.max("chunk") + 1).first()[0] == chunks


def test_axis_fold_is_half_even_from_the_left(spark):
    rows = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, -1)], "k int, o int, v int")
    assert A.ordered(rows, ["k"], ["o"], "v").select(A.axis_fold(F.col("items"))).first()[0] == 0


def test_names(spark):
    rows = spark.createDataFrame([("lena",), ("lena marchal",), ("gaulthier",), ("gaultier",), ("go",)], "n string")
    assert {(r.a, r.b) for r in A.name_pairs(rows, "n").collect()} == {("lena", "lena marchal"), ("gaulthier", "gaultier")}


def test_longest_wins_first_on_ties(spark):
    rows = spark.createDataFrame([(1, 1, "abc"), (1, 2, "xyz")], "k int, o int, v string")
    assert A.longest_first(rows, ["k"], "v", "o").first().v == "abc"


def test_salvage():
    assert salvage_json('{"a": ["x", "y') == {"a": ["x"]}
    assert salvage_json('{"a": 1}') == {"a": 1}
    assert salvage_json("") == {} and salvage_json("nonsense") == {}


def test_exports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"messages": [{"author": {"name": "x"}, "content": "hi", "timestamp": "2022-03-09 10:39:43+00:00"}]}')
    (tmp_path / "b.json").write_text('[{"author": "y", "content": "ho", "timestamp": "soon"}]')
    got = {r.export: (r.author, r.content, r.ts is not None) for r in exports.read_json_exports(spark, str(tmp_path)).collect()}
    assert got == {"a": ("x", "hi", True), "b": ("y", "ho", False)}
    (tmp_path / "c.csv").write_text('author,content,timestamp\nx,"say ""hi""",2022-03-09T10:39:43Z\ny,,\n')
    assert [(r.author, r.content) for r in exports.read_csv_exports(spark, str(tmp_path)).collect()] == [("x", 'say "hi"')]


def test_stream_sessions(spark, tmp_path):
    from skald.streaming.sessions import stream_sessions

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        writer = stream_sessions(stream, ["k"], "ts", min_size=2).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    rows = _messages(spark, [0, 60, 120, 9000, 9060, 40000])
    rows.write.parquet(str(tmp_path / "in"))
    run()
    _messages(spark, [80000]).write.mode("append").parquet(str(tmp_path / "in"))  # the watermark passes what was open
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start_ts").collect()
    assert [(r.n, r.start_ts) for r in got] == [(3, T0), (2, T0 + timedelta(seconds=9000))]


def test_roleplay_words(spark):
    long = "x" * 80
    cases = [("*tire son épée lentement*", True, False), (f"désolé demain connexion {long}", False, True), (f"pas là {long}", False, True), (f"lolita {long}", True, False), (f"Ok, {long}", True, False), (f"ok alors {long}", False, True), (long, True, False), ("x" * 79, False, False)]
    rows = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(cases)], "i int, c string")
    got = {r.i: (r.rp, r.ooc) for r in rows.select("i", text.is_roleplay(F.col("c")).alias("rp"), text.is_ooc(F.col("c")).alias("ooc")).collect()}
    assert [got[i] for i in range(len(cases))] == [(a, b) for _, a, b in cases]
    first = rows.select(text.preferred(F.lit(""), F.lit(" a ")).alias("a"), text.preferred(F.lit("b"), F.lit("a")).alias("b"), text.is_meta(F.lit("C'était génial, cette session")).alias("m"), text.is_ooc(F.lit("^^"), smileys=True).alias("s")).first()
    assert (first.a, first.b, first.m, first.s) == ("a", "b", True, True)


def test_scene_check_and_prefix(spark):
    act = "*il avance vers la grande porte noire*"
    rows = [(1, 0, "")] + [(2, i, act + " " + "y" * 90) for i in range(4)] + [(3, i, "lol ok") for i in range(3)] + [(4, i, "salut toi") for i in range(3)] + [(5, 0, "«dit il"), (5, 1, "encore»"), (6, 0, "a" * 50), (7, 0, "a" * 30), (8, 0, "a" * 30), (8, 1, "b" * 30)]
    scenes = spark.createDataFrame(rows, "k int, pos int, t string")
    got = {r.k: (r.is_rp, r.score, r.flags) for r in text.scene_check(scenes, ["k"], ["pos"], "t").collect()}
    assert got[1] == (False, 0.0, ["no_narrative"]) and got[2] == (True, 0.8, []) and got[3] == (False, 0.0, ["ooc", "no_narrative"])
    assert got[4] == (False, 0.0, ["no_narrative"]) and got[5][1] == 0.1
    verdicts = {r.k: r.verdict for r in text.prefix_verdict(scenes, ["k"], "t").collect()}
    assert verdicts == {1: "trim", 2: "keep", 3: "trim", 4: "trim", 5: "trim", 6: "keep", 7: "trim", 8: "ask"}


def test_clusters_of_a_long_chain(spark):
    chain = spark.range(199).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(500, 501)], "a long, b long"))
    got = {r.node: r.root for r in A.clusters(chain).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 500: 500, 501: 500}


def test_tasks_of_co_occurrence_and_last_scenes_stay_small(spark):
    rows = spark.range(4_000).selectExpr("id % 1000 as scene", "id % 37 as who")
    # Parts follow the rows and are not joined to larger ones again.
    pairs = A.co_occurrence(rows, "scene", "who", rows_per_task=100)
    back = sessions.last_overlapping(rows, "scene", "who", 2, rows_per_task=100)
    assert pairs.rdd.getNumPartitions() == 40 and back.rdd.getNumPartitions() == 80
    held = {(i % 1000, i % 37) for i in range(4_000)}
    assert sorted(tuple(r) for r in pairs.collect()) == sorted((s, a, b) for s, a in held for b in range(a + 1, 37) if (s, b) in held)
