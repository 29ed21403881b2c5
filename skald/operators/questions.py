"""The question layer: many questions at once are routed to intents, and each intent's handler gathers its context from the lore tables.

Questions are (question_id, question).  Entities are (category, name,
appellations, profile, appearances), with names unique in a category; handlers
return (question_id, context).  What is said at last, ``tasks.TASKS["answer"]``
or another task asks a model for, with the context as input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import router
from .containment import names_in_texts
from .records import MAX_ANSWER_CONTEXT

# Fixed values of the handlers.
RELATIONS_SHOWN, RELATION_TEXT, AXES_SHOWN, SCENES_SHOWN, LEDGER_SHOWN = 15, 80, 3, 8, 8
LEAST_TERM = 3
CATEGORIES = ("characters", "places", "concepts")
#: A table of patterns is read by the driver; it is the size of a word list.
MOST_PATTERNS = 5_000

Handler = Callable[[DataFrame], DataFrame]


def intents_of(patterns: DataFrame) -> dict[str, tuple[str, ...]]:
    """Intents of a table (place, intent, pattern), in order of their first place."""
    rows = patterns.orderBy("place").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    out: dict[str, tuple[str, ...]] = {}
    for r in rows:
        out[r["intent"]] = (*out.get(r["intent"], ()), r["pattern"])
    return out


def routed(questions: DataFrame, intents: dict[str, tuple[str, ...]], fallback: str = "entity") -> DataFrame:
    """Adds ``intent``."""
    return questions.withColumn("intent", router.detect_intent(F.col("question"), intents, fallback))


def dispatched(questions: DataFrame, handlers: dict[str, Handler], fallback: str = "entity") -> DataFrame:
    """(question_id, intent, context) of routed questions: each goes to the handler of its intent, or to the fallback's; contexts are cut to what an answer takes.

    A question that its handler finds nothing for has an empty context.
    """
    at = F.when(F.col("intent").isin(list(handlers)), F.col("intent")).otherwise(fallback)
    given = questions.withColumn("_handler", at)
    parts = [handler(given.where(F.col("_handler") == name).select("question_id", "question")).select("question_id", "context") for name, handler in handlers.items()]
    found = reduce(DataFrame.unionAll, parts)
    context = F.substring(F.coalesce("context", F.lit("")), 1, MAX_ANSWER_CONTEXT)
    return questions.join(found, "question_id", "left").select("question_id", "intent", context.alias("context"))


def entity_names(entities: DataFrame) -> DataFrame:
    """(category, name, alias): all names of the entities in lower case."""
    every = F.filter(F.concat(F.array("name"), F.coalesce("appellations", F.array().cast("array<string>"))), lambda n: F.length(n) > 0)
    return entities.select("category", "name", F.explode(F.array_distinct(F.transform(every, F.lower))).alias("alias"))


def terms_of(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, term): the known names of three letters or more in a question, else its capitalised words, in lower case."""
    names = entity_names(entities).select("alias").where(F.length("alias") >= LEAST_TERM).distinct()
    known = names_in_texts(names, "alias", questions, "question_id", "question").select(F.col("key").alias("question_id"), F.col("name").alias("term"))
    words = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit(r"(?U)\b([A-ZÀ-Ÿ][a-zà-ÿ]{2,})\b"), F.lit(1)), F.lower)))
    other = questions.join(known.select("question_id").distinct(), "question_id", "left_anti").select("question_id", words.alias("term"))
    return known.union(other)


def matched(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, category, name): entities with a name that holds a term of three letters or more, or that such a term holds."""
    names, asked = entity_names(entities), terms.where(F.length(F.trim("term")) >= LEAST_TERM).withColumn("term", F.trim("term"))
    distinct_names, distinct_terms = names.select("alias").distinct(), asked.select("term").distinct()
    inside = names_in_texts(distinct_terms, "term", distinct_names, "alias", "alias").select(F.col("name").alias("term"), F.col("key").alias("alias"))
    around = names_in_texts(distinct_names, "alias", distinct_terms, "term", "term").select(F.col("key").alias("term"), F.col("name").alias("alias"))
    pairs = inside.union(around).distinct()
    return asked.join(pairs, "term").join(names, "alias").select("question_id", "category", "name").distinct()


def _lines(rows: DataFrame, key: str, order: list[str], line: Column, most: int | None = None, title: Column | None = None, sep: str = "\n") -> DataFrame:
    """(question_id, part): the first lines of each question, under a title."""
    if most is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), sep)
    return rows.groupBy(key).agg((text if title is None else F.concat(title, text)).alias("part"))


def _assembled(parts: list[DataFrame]) -> DataFrame:
    """(question_id, context): the parts of each question in order, an empty line between."""
    every = reduce(DataFrame.unionAll, [p.select("question_id", F.lit(i).alias("_place"), "part") for i, p in enumerate(parts)])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "part"))), lambda x: x["part"]), "\n\n")
    return every.where(F.coalesce("part", F.lit("")) != "").groupBy("question_id").agg(text.alias("context"))


def about_entities(questions: DataFrame, entities: DataFrame, relations: DataFrame, axes: DataFrame, cards: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """The context of questions about whoever they name: profiles, relations, narrative axes and scenes; else the latest scenes.

    ``relations`` is (scene, pos, from_char, to_char, relation_type, sentiment,
    description), ``axes`` (place, name, summary, elements), ``cards`` (scene,
    card, synthesis), ``near`` (question_id, name) of a vector search.
    """
    terms = terms_of(questions, entities)
    hits = matched(terms, entities)
    if near is not None:
        by_name = near.select("question_id", F.lower("name").alias("_low"))
        hits = hits.union(by_name.join(entities.select("category", "name", F.lower("name").alias("_low")), "_low").select("question_id", "category", "name")).distinct()
    kind = F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("category"))
    full = hits.join(entities, ["category", "name"]).withColumn("_kind", kind)
    profiles = _lines(full, "question_id", ["_kind", "name"], F.col("profile"), sep="\n\n")

    who = hits.where("category = 'characters'").select("question_id", F.lower("name").alias("_who")).distinct()
    rel = relations.select("scene", "pos", F.lower(F.coalesce("from_char", F.lit(""))).alias("a"), F.lower(F.coalesce("to_char", F.lit(""))).alias("b"), "relation_type", "sentiment", "description")
    ends = rel.join(who.withColumnRenamed("_who", "a"), "a").select("question_id", *rel.columns).union(rel.join(who.withColumnRenamed("_who", "b"), "b").select("question_id", *rel.columns)).distinct()
    told = F.concat(F.lit("  "), "a", F.lit(" → "), "b", F.lit(" ("), F.coalesce("relation_type", F.lit("?")), F.lit(", "), F.coalesce("sentiment", F.lit("?")), F.lit("): "), F.substring(F.coalesce("description", F.lit("")), 1, RELATION_TEXT))
    related = _lines(ends, "question_id", ["scene", "pos"], told, RELATIONS_SHOWN, F.lit("[CHARACTER RELATIONS]\n"))

    elements = F.array_join(F.coalesce("elements", F.array().cast("array<string>")), ", ")
    axis_text = axes.select("place", "name", "summary", elements.alias("elements"), F.concat_ws(" ", "name", F.array_join(F.coalesce("elements", F.array().cast("array<string>")), " ")).alias("_text"))
    held = names_in_texts(terms.select("term").distinct(), "term", axis_text, "place", "_text").select(F.col("name").alias("term"), F.col("key").alias("place"))
    on = terms.join(held, "term").select("question_id", "place").distinct().join(axis_text, "place")
    axis_line = F.concat(F.lit("• "), "name", F.lit(": "), F.coalesce("summary", F.lit("")), F.lit("\n  elements: "), "elements")
    lines = _lines(on, "question_id", ["place"], axis_line, AXES_SHOWN, F.lit("[NARRATIVE AXES]\n"))

    seen = full.select("question_id", F.explode("appearances").alias("scene")).distinct()
    first = seen.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy("scene"))).where(F.col("_n") <= SCENES_SHOWN)
    scenes = _lines(first.join(cards.where("card <> ''"), "scene"), "question_id", ["scene"], F.col("card"), title=F.lit("[RELEVANT SCENES]\n"), sep="\n\n")

    found = _assembled([profiles, related, lines, scenes])
    latest = cards.where(F.coalesce("synthesis", F.lit("")) != "").orderBy(F.desc("scene")).limit(LEDGER_SHOWN)
    recent = latest.agg(F.concat(F.lit("[RECENT NARRATIVE CONTEXT]\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene", "synthesis"))), lambda x: F.concat(F.lit("- "), x["scene"].cast("string"), F.lit(": "), x["synthesis"])), "\n")).alias("_recent"), F.count(F.lit(1)).alias("_any"))
    asked = questions.select("question_id").join(found, "question_id", "left").join(F.broadcast(recent))  # one row
    return asked.select("question_id", F.coalesce("context", F.when(F.col("_any") > 0, F.col("_recent"))).alias("context"))


def strong(axes: DataFrame) -> DataFrame:
    return axes.where("strength = 'strong'")


def underdeveloped(axes: DataFrame) -> DataFrame:
    """Axes of moderate strength, or of two scenes at most."""
    return axes.where((F.col("strength") == "moderate") | (F.size(F.coalesce("scenes", F.array().cast("array<string>"))) <= 2))


def _one_text(rows: DataFrame, order: list[str], line: Column, most: int, title: str, sep: str = "\n") -> DataFrame:
    """One row with the first lines as one text; null without any."""
    kept = rows.withColumn("_line", line).orderBy(*order).limit(most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_line"))), lambda x: x["_line"]), sep)
    return kept.agg(F.when(F.count(F.lit(1)) > 0, F.concat(F.lit(title), text)).alias("part"))


def _for_all(questions: DataFrame, parts: list[DataFrame]) -> DataFrame:
    whole = reduce(DataFrame.unionAll, [p.select(F.lit(i).alias("place"), "part") for i, p in enumerate(parts)])
    text = whole.where("part is not null").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "\n\n").alias("context"))
    return questions.select("question_id").join(F.broadcast(text))  # one row


def _items(name: str, most: int) -> Column:
    return F.array_join(F.slice(F.coalesce(name, F.array().cast("array<string>")), 1, most), ", ")


def story(questions: DataFrame, overview: DataFrame, axes: DataFrame, links: DataFrame) -> DataFrame:
    """The story so far: overview(narrative, summary, themes) of one row, strong axes and the strongest links(place, from_element, link_type, to_element, description)."""
    said = lambda c, title: overview.agg(F.max(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(title), c))).alias("part"))
    themes = overview.agg(F.max(F.when(F.size("themes") > 0, F.concat(F.lit("**Recurring themes**: "), _items("themes", 8)))).alias("part"))
    axis = F.concat(F.lit("**"), "name", F.lit("**: "), F.coalesce("summary", F.lit("")), F.lit("\n  elements: "), _items("elements", 6))
    link = F.concat(F.lit("- "), "from_element", F.lit(" —"), "link_type", F.lit("→ "), "to_element", F.lit(": "), F.substring(F.coalesce("description", F.lit("")), 1, RELATION_TEXT))
    return _for_all(questions, [said("narrative", "## Overall narrative\n"), _one_text(strong(axes), ["place"], axis, 5, "## Active narrative axes\n"), said("summary", "## Recurring content\n"), themes, _one_text(links, ["place"], link, 6, "## Strongest causal links\n")])


def creative(questions: DataFrame, characters: DataFrame, axes: DataFrame, overview: DataFrame) -> DataFrame:
    """What new scenes could take up: the least seen characters(place, name, job, description_psychological, appearances), axes, themes and open threads."""
    seen = characters.withColumn("n", F.size(F.coalesce("appearances", F.array().cast("array<string>"))))
    about = F.coalesce(F.nullif("description_psychological", F.lit("")), F.nullif("job", F.lit("")), F.lit("?"))
    low = F.concat(F.lit("- "), "name", F.lit(" ("), F.col("n").cast("string"), F.lit(" scenes): "), about)
    told = F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce("summary", F.lit("")))
    themes = overview.agg(F.max(F.when(F.size("themes") > 0, F.concat(F.lit("Recurring themes: "), _items("themes", 8)))).alias("part"))
    whole = F.concat(told, F.lit(" (elements: "), _items("elements", 1 << 20), F.lit(")"))
    return _for_all(questions, [_one_text(seen, ["n", "place"], low, 5, "Underexploited characters:\n"), _one_text(axes, ["place"], whole, 4, "Narrative axes:\n"), themes, _one_text(underdeveloped(axes), ["place"], told, 3, "Open / underdeveloped threads:\n")])


def voice(questions: DataFrame, entities: DataFrame, voices: DataFrame) -> DataFrame:
    """How the first character that a question names speaks, by voices(name, formality_level, vocabulary_register, avg_sentence_length, communication_style, speech_quirks, roleplay_prompt, scenes_analyzed); without one, the list of voices."""
    people = entities.where("category = 'characters'")
    first = matched(terms_of(questions, entities), people).groupBy("question_id").agg(F.min("name").alias("name"))
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?"))
    scenes = F.size(F.coalesce("scenes_analyzed", F.array().cast("array<string>"))).cast("string")
    sheet = F.concat_ws(
        "\n", F.concat(F.lit("## Voice profile — "), F.initcap("name"), F.lit("\n")), F.concat(F.lit("**Formality:** "), known("formality_level"), F.lit(" | **Register:** "), known("vocabulary_register"), F.lit(" | **Sentence length:** "), known("avg_sentence_length")),
        F.concat(F.lit("\n**Communication style:** "), F.nullif("communication_style", F.lit(""))), F.when(F.size("speech_quirks") > 0, F.concat(F.lit("\n**Speech quirks:** "), _items("speech_quirks", 1 << 20))),
        F.concat(F.lit("\n### Write in their voice:\n_"), F.nullif("roleplay_prompt", F.lit("")), F.lit("_")), F.concat(F.lit("\n_Based on "), scenes, F.lit(" scene(s)_")),
    )
    own = voices.select(F.lower("name").alias("_low"), sheet.alias("sheet"))
    listed = F.concat(F.lit("- **"), "name", F.lit("** — "), known("formality_level"), F.lit(", "), known("vocabulary_register"), F.lit(", "), scenes, F.lit(" scenes"))
    whole = voices.agg(F.concat(F.lit("Available voice profiles ("), F.count(F.lit(1)).cast("string"), F.lit("):\n\n"), F.array_join(F.array_sort(F.collect_list(listed)), "\n")).alias("_list"), F.count(F.lit(1)).alias("_any"))
    asked = questions.select("question_id").join(first, "question_id", "left").join(own, F.lower("name") == F.col("_low"), "left").join(F.broadcast(whole))  # one row
    none = F.concat(F.lit("No voice profile for "), "name", F.lit(" yet."))
    return asked.select("question_id", F.when(F.col("name").isNotNull(), F.coalesce("sheet", none)).when(F.col("_any") > 0, F.col("_list")).otherwise("No voice profiles yet.").alias("context"))
