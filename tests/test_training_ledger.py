"""Training examples by step and the ledger of scenes, on literals."""

import json

from skald.functions import training
from skald.operators import ledger as L


def test_examples_of_confirmed_scenes(spark):
    confirmed = spark.createDataFrame(
        [("a", "confirmed", '{"t":1}', None, "{}", "", '{"e":[1]}', '{"l":2}'), ("b", "rejected", "{}", "{}", '{"w":1}', "", "", ""), ("c", "confirmed", "{}", "", "", "", '{"e":2}', None), ("d", "confirmed", '{"t":1}', "", "", "", "", "")],
        "scene string, status string, `when` string, `where` string, who string, which string, what string, how string",
    )
    texts = spark.createDataFrame([("a", "A: hi"), ("b", "x"), ("c", "C: ho"), ("d", "")], "scene string, text string")
    made = training.step_examples(confirmed, texts)
    got = {(r.scene, r.step): (r.user, r.assistant) for r in made.collect()}
    base = "Analyze this RP scene:\n---\nA: hi\n---"
    context = '\n\nContext from previous steps:\nWHEN:\n{"t":1}'
    assert got == {
        ("a", "when"): (base, '{"t":1}'), ("a", "what"): (base + context, '{"e":[1]}'), ("a", "how"): (base + context + '\n\nWHAT:\n{"e":[1]}', '{"l":2}'), ("c", "what"): ("Analyze this RP scene:\n---\nC: ho\n---", '{"e":2}'),
    }
    line = json.loads(training.chat_lines(made).where("step = 'when'").first().line)
    assert [m["role"] for m in line["messages"]] == ["system", "user", "assistant"] and line["messages"][2]["content"] == '{"t":1}'
    assert {tuple(r) for r in training.examples_by_step(made).collect()} == {("when", 1), ("where", 0), ("who", 0), ("which", 0), ("what", 2), ("how", 1)}


def test_the_ledger_grows_and_is_corrected(spark):
    first = spark.createDataFrame([("s1", "It begins", [("Ann", "runs")], ["t1", "t2", "t3"], False), ("s2", "", [], [], False)], L.ENTRY)
    more = spark.createDataFrame([("s1", "other", [], [], False), ("s3", None, [], [], False)], L.ENTRY)
    held = L.appended(first, more)
    assert {r.scene: r.narrative for r in held.collect()} == {"s1": "It begins", "s2": "", "s3": None}
    who = spark.createDataFrame([("s2", ["Bob", "", None, "Cid"]), ("s4", None)], "scene string, characters array<string>")
    event = "array<struct<description: string, type: string, characters: array<string>>>"
    what = spark.createDataFrame([("s2", "Told", [("", "decision", ["Bob"]), ("x" * 200, "decision", ["Dan"]), ("y" * 90, "action", ["Bob"]), ("z", "revelation", ["Bob"])]), ("s1", "", None)], f"scene string, summary string, events {event}")
    got = {r.scene: r for r in L.corrected(held, who, what).collect()}
    assert (got["s2"].narrative, [tuple(c) for c in got["s2"].characters], got["s2"].tensions, got["s2"].corrected) == ("Told", [("Bob", "y" * 80), ("Cid", "present")], ["x" * 120, "z"], True)
    assert (got["s1"].narrative, got["s1"].characters, got["s1"].tensions) == ("It begins", [], []) and not got["s3"].corrected and got["s4"].narrative == ""
    assert {tuple(r) for r in L.scene_synthesis(held).collect()} == {("s1", "It begins  [tensions: t1; t2]"), ("s2", "none"), ("s3", "none")}
    assert {r.line for r in L.entry_line(held).collect()} == {"- s1: It begins  [chars: Ann (runs)]  [tensions: t1; t2]", "- s2: ", "- s3: "}
