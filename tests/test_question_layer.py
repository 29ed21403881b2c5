"""The question layer on literals: routing by a table, dispatch, and what the handlers gather."""

from pyspark.sql import functions as F

from skald.operators import questions as Q

ENTITIES = [
    ("characters", "Lena Marchal", ["Red"], "[CHARACTERS] Lena", ["s1", "s3"]), ("characters", "Bob", [], "[CHARACTERS] Bob", ["s2"]), ("places", "Old Inn", None, "[PLACES] Inn", [f"s{i}" for i in range(10, 30)]), ("concepts", "Al", [], "too short", []),
]


def _lore(spark):
    entities = spark.createDataFrame(ENTITIES, "category string, name string, appellations array<string>, profile string, appearances array<string>")
    relations = spark.createDataFrame([("s1", 0, "Lena Marchal", "BOB", "ally", "warm", "x" * 100), ("s2", 0, "Cid", "Dan", "foe", "cold", "")], "scene string, pos long, from_char string, to_char string, relation_type string, sentiment string, description string")
    axes = spark.createDataFrame([(0, "The red war", "it burns", ["fire", "north"], "strong", ["s1", "s2", "s3"]), (1, "Peace", None, [], "moderate", ["s1"]), (2, "Trade", "gold", ["inn"], "weak", ["a", "b", "c"])], "place long, name string, summary string, elements array<string>, strength string, scenes array<string>")
    cards = spark.createDataFrame([(f"s{i}", f"[s{i}] card", f"synth {i}" if i != 2 else None) for i in range(1, 30)], "scene string, card string, synthesis string")
    return entities, relations, axes, cards


def test_entity_questions(spark):
    entities, relations, axes, cards = _lore(spark)
    asked = spark.createDataFrame([(1, "What did RED do?"), (2, "Who is in the old inn with Bob?"), (3, "Anything new?"), (4, "Does Marchalia know?"), (5, None)], "question_id long, question string")
    got = {r.question_id: r.context for r in Q.about_entities(asked, entities, relations, axes, cards).collect()}
    relation = f"  lena marchal → bob (ally, warm): {'x' * 80}"
    assert got[1] == f"[CHARACTERS] Lena\n\n[CHARACTER RELATIONS]\n{relation}\n\n[NARRATIVE AXES]\n• The red war: it burns\n  elements: fire, north\n\n[RELEVANT SCENES]\n[s1] card\n\n[s3] card"
    parts = got[2].split("\n\n")
    assert parts[:3] == ["[CHARACTERS] Bob", "[PLACES] Inn", f"[CHARACTER RELATIONS]\n{relation}"] and parts[3:] == ["[RELEVANT SCENES]\n[s10] card", *(f"[s{i}] card" for i in range(11, 18))]  # "old inn" is in no axis; 8 scenes by id: s10 to s17
    latest = "[RECENT NARRATIVE CONTEXT]\n" + "\n".join(f"- s{i}: synth {i}" for i in (29, 3, 4, 5, 6, 7, 8, 9))
    assert got[3] == got[5] == latest and got[4] == "too short"  # a name of two letters is known by a longer term that holds it
    near = spark.createDataFrame([(3, "BOB")], "question_id long, name string")
    assert {r.question_id: r.context for r in Q.about_entities(asked, entities, relations, axes, cards, near).collect()}[3].startswith("[CHARACTERS] Bob\n\n[CHARACTER RELATIONS]")


def test_story_creative_and_voice(spark):
    entities, _, axes, _ = _lore(spark)
    asked = spark.createDataFrame([(1, "How does Lena Marchal speak?"), (2, "Voices?"), (3, "And bob?")], "question_id long, question string")
    overview = spark.createDataFrame([("All burns", "", ["war", "love"])], "narrative string, summary string, themes array<string>")
    links = spark.createDataFrame([(0, "a", "causes", "b", "why")], "place long, from_element string, link_type string, to_element string, description string")
    told = {r.context for r in Q.story(asked, overview, axes, links).collect()}
    assert told == {"## Overall narrative\nAll burns\n\n## Active narrative axes\n**The red war**: it burns\n  elements: fire, north\n\n**Recurring themes**: war, love\n\n## Strongest causal links\n- a —causes→ b: why"}
    people = spark.createDataFrame([(i, f"c{i}", "cook", "calm" if i == 6 else "", ["s"] * i) for i in range(7)], "place long, name string, job string, description_psychological string, appearances array<string>")
    ideas = Q.creative(asked.limit(1), people, axes, overview).first().context.split("\n\n")
    assert ideas[0] == "Underexploited characters:\n" + "\n".join(f"- c{i} ({i} scenes): cook" for i in range(5))
    assert ideas[1].startswith("Narrative axes:\n- The red war: it burns (elements: fire, north)\n- Peace:  (elements: )") and ideas[2] == "Recurring themes: war, love" and ideas[3] == "Open / underdeveloped threads:\n- Peace: "
    voices = spark.createDataFrame([("lena marchal", "high", "", "long", "", ["hm"], "Speak so.", ["s1", "s2"])], "name string, formality_level string, vocabulary_register string, avg_sentence_length string, communication_style string, speech_quirks array<string>, roleplay_prompt string, scenes_analyzed array<string>")
    got = {r.question_id: r.context for r in Q.voice(asked, entities, voices).collect()}
    assert got[1] == "## Voice profile — Lena Marchal\n\n**Formality:** high | **Register:** ? | **Sentence length:** long\n\n**Speech quirks:** hm\n\n### Write in their voice:\n_Speak so._\n\n_Based on 2 scene(s)_"
    assert got[2] == "Available voice profiles (1):\n\n- **lena marchal** — high, ?, 2 scenes" and got[3] == "No voice profile for Bob yet."
    assert Q.voice(asked, entities, voices.limit(0)).where("question_id = 2").first().context == "No voice profiles yet."


def test_routing_by_a_table_and_dispatch(spark):
    table = spark.createDataFrame([(2, "story", r"\bso far\b"), (0, "voice", "speak"), (1, "voice", r"\bvoice"), (3, "story", "story")], "place long, intent string, pattern string")
    intents = Q.intents_of(table)
    assert intents == {"voice": ("speak", r"\bvoice"), "story": (r"\bso far\b", "story")} and list(intents) == ["voice", "story"]
    asked = spark.createDataFrame([(1, "the STORY so far"), (2, "speak of the story"), (3, "who?"), (4, None), (5, "voice")], "question_id long, question string")
    routed = Q.routed(asked, intents)
    assert {r.question_id: r.intent for r in routed.collect()} == {1: "story", 2: "voice", 3: "entity", 4: "entity", 5: "voice"}
    say = lambda name: lambda rows: rows.where("question_id <> 5").select("question_id", F.concat(F.lit(f"{name} "), F.repeat(F.lit("x"), 20_000)).alias("context"))
    got = {r.question_id: (r.context[:8], len(r.context)) for r in Q.dispatched(routed, {"story": say("story"), "voice": say("voice"), "entity": say("entity")}).collect()}
    assert got == {1: ("story xx", 14_000), 2: ("voice xx", 14_000), 3: ("entity x", 14_000), 4: ("entity x", 14_000), 5: ("", 0)}
