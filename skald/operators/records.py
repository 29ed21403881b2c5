"""Rules over extracted records: names, authors, relations, digests and the names that stand for clusters.

Column functions take array columns of names; comparisons ignore case and outer
white space.  Nulls in arrays and null arrays count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import clusters, name_pairs
from .text import name_norm, strip

# Fixed values of the record rules: words that are no names, in the languages of the logs.
#: In what a scene's synthesis tells.
PRONOUNS = (
    "he", "she", "it", "they", "him", "her", "his", "hers", "their", "theirs",
    "i", "me", "my", "you", "we", "us", "one", "someone", "anyone", "nobody",
    "il", "elle", "ils", "elles", "lui", "leur", "je", "tu", "nous", "vous", "on",
    "ce", "ceci", "cela", "ça", "celui", "celle", "ceux",
)
#: In the entities of a scene.
ENTITY_PRONOUNS = (
    "he", "she", "it", "they", "him", "her", "his", "hers", "their", "theirs",
    "i", "me", "my", "mine", "you", "your", "yours", "we", "us", "our", "ours",
    "this", "that", "these", "those", "who", "whom", "whose", "one", "someone",
    "anyone", "everyone", "nobody", "somebody", "the", "a", "an",
    "il", "elle", "ils", "elles", "lui", "leur", "leurs",
    "je", "moi", "tu", "te", "toi", "nous", "vous", "on", "se", "soi",
    "ce", "ceci", "cela", "ça", "qui", "que", "quoi", "dont", "où",
    "celui", "celle", "ceux", "celles", "lequel", "laquelle", "lesquels", "lesquelles",
    "le", "la", "les", "un", "une", "des", "du",
)
MAX_ANSWER_CONTEXT = 14_000
EVENTS_IN_DIGEST, LINKS_IN_DIGEST, RELATIONS_IN_DIGEST = 10, 8, 6


def folded(name: Column) -> Column:
    return F.lower(strip(F.coalesce(name, F.lit(""))))


def _list(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull())


def _holds(items: Column, name: Column) -> Column:
    return F.exists(_list(items), lambda x: folded(x) == folded(name))


def authors_of(messages: DataFrame, keys: list[str], author: str) -> DataFrame:
    """Per scene, its distinct authors that are not empty, in order of their names."""
    return messages.where(F.coalesce(F.col(author), F.lit("")) != "").groupBy(*keys).agg(F.sort_array(F.collect_set(author)).alias("authors"))


def spoken_names(names: Column, authors: Column, pronouns: tuple[str, ...] = ENTITY_PRONOUNS) -> Column:
    """The names that are neither empty, a pronoun nor an author's."""
    return F.filter(_list(names), lambda x: (folded(x) != "") & ~folded(x).isin(*pronouns) & ~_holds(authors, x))


def is_character(name: Column, author: Column, authors: Column) -> Column:
    """Whether a record names a character: not an author, and not played by someone who wrote nothing."""
    return (folded(name) != "") & ~_holds(authors, name) & ((folded(author) == "") | _holds(authors, author))


def filled_author(name: Column, author: Column, played: Column, authors: Column) -> Column:
    """The author, else whoever plays the name by ``played`` (author to character) and wrote in the scene; the last of several."""
    fits = F.filter(F.map_entries(played), lambda e: _holds(authors, e["key"]) & (F.lower(e["value"]) == folded(name)))
    return F.coalesce(F.nullif(author, F.lit("")), F.try_element_at(fits, F.lit(-1))["key"], F.lit(""))


def is_named(name: Column) -> Column:
    """Not empty and not unknown."""
    return (folded(name) != "") & ~F.startswith(folded(name), F.lit("unknown"))


def is_synthesis_name(name: Column, pronouns: tuple[str, ...] = PRONOUNS) -> Column:
    """A name and no pronoun, single letter or piece of a sentence."""
    n = strip(F.coalesce(name, F.lit("")))
    return ~F.lower(n).isin(*pronouns) & (F.length(n) >= 2) & ~(F.contains(n, F.lit(" ")) & (F.length(n) > 30))


def without_known(concepts: DataFrame, name: str, *known: tuple[DataFrame, str]) -> DataFrame:
    """The concepts that are not the name of something else that is known."""
    for table, column in known:
        taken = table.select(folded(F.col(column)).alias("_taken")).distinct()
        concepts = concepts.join(taken, folded(F.col(name)) == F.col("_taken"), "left_anti")
    return concepts


def present_only(names: Column, present: Column) -> Column:
    """The names that are present; all if nobody is known to be."""
    return F.when(F.size(_list(present)) == 0, _list(names)).otherwise(F.filter(_list(names), lambda x: _holds(present, x)))


def both_present(a: Column, b: Column, present: Column) -> Column:
    """Whether both ends of a relation are present, or nobody is known to be."""
    return (F.size(_list(present)) == 0) | (_holds(present, a) & _holds(present, b))


def related_pairs(relations: Column) -> Column:
    """Relations (structs of character and relation) in lower case, each once, those without a character left out."""
    kept = F.filter(relations, lambda r: F.coalesce(r["character"], F.lit("")) != "")
    return F.array_distinct(F.transform(kept, lambda r: F.struct(F.lower(r["character"]).alias("character"), F.lower(F.coalesce(r["relation"], F.lit(""))).alias("relation"))))


def _told(value: Column) -> Column:
    """The text unless it is empty or says unknown."""
    return F.when(~value.isin("", "unknown"), value)


def _filled_list(own: Column, lore: Column) -> Column:
    """The own items, then those of the lore that are not there yet, each once; case is ignored."""
    more = F.aggregate(_list(lore), F.array().cast("array<string>"), lambda kept, x: F.when(_holds_case(F.concat(own, kept), x), kept).otherwise(F.concat(kept, F.array(x))))
    return F.concat(own, more)


def _holds_case(items: Column, x: Column) -> Column:
    return F.exists(items, lambda y: F.lower(y) == F.lower(x))


def gap_filled(found: DataFrame, lore: DataFrame, name: str, fields: list[str], lists: list[str], goals: list[str] = []) -> DataFrame:
    """Extracted records with what they lack taken from the lore.

    A field that is empty or says unknown takes the lore's, unless that says no
    more; a list gets the lore's items that it lacks; the lists of ``goals`` are
    taken from the lore only if all of them are empty.  Of several lore records
    of a name (case ignored) the least one counts.
    """
    taken = [*fields, *lists, *goals]
    old = lore.where(F.col(name).isNotNull()).groupBy(folded(F.col(name)).alias("_name")).agg(F.min(F.struct(*taken)).alias("_old"))
    joined = found.join(old, folded(F.col(name)) == F.col("_name"), "left")
    made = {c: F.coalesce(_told(F.col(c)), _told(F.col(f"_old.{c}")), F.col(c), F.lit("")) for c in fields}
    made |= {c: _filled_list(_list(F.col(c)), F.col(f"_old.{c}")) for c in lists}
    aimless = F.lit(True)
    for c in goals:
        aimless = aimless & (F.size(_list(F.col(c))) == 0)
    made |= {c: F.when(aimless, _list(F.col(f"_old.{c}"))).otherwise(_list(F.col(c))) for c in goals}
    return joined.select(*(made[c].alias(c) if c in made else F.col(c) for c in found.columns))


def manual_first(manual: Column, found: Column) -> Column:
    """Manual items, then the others."""
    return F.concat(_list(manual), _list(found))


def overlap(a: Column, b: Column) -> Column:
    """Whether two lists of names share one."""
    return F.exists(_list(a), lambda x: _holds(b, x))


def covers(a: Column, b: Column) -> Column:
    """Whether the first list has every name of the second."""
    return F.forall(_list(b), lambda x: _holds(a, x))


def last_wins(rows: DataFrame, keys: list[str], entry: str, value: str, order: list[str]) -> DataFrame:
    """Per key a map of entries to values; of equal entries the last in order."""
    one = rows.where(F.col(entry).isNotNull()).groupBy(*keys, entry).agg(F.max_by(value, F.struct(*order)).alias("_value"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(entry, "_value")))).alias("entries"))


def digest(items: Column, most: int) -> Column:
    """The first items of a scene's list."""
    return F.slice(items, 1, most)


def lacking_description(rows: DataFrame, scenes: str, description: str, beyond: int = 2) -> DataFrame:
    """Records seen in more scenes than ``beyond`` that nobody has described."""
    return rows.where((F.col(scenes) > beyond) & (F.trim(F.coalesce(F.col(description), F.lit(""))) == ""))


def scaled_degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, degree, size): distinct neighbours, and a size from 300 to 1800 by the largest degree; loops are no edges."""
    edges = edges.where(F.col(a) != F.col(b))
    ends = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).distinct()
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    largest = degree.agg(F.max("degree").alias("_largest"))  # one row
    return degree.join(F.broadcast(largest)).select("node", "degree", (F.lit(300) + F.lit(1500) * F.col("degree") / F.col("_largest")).alias("size"))


def inconsistencies(rows: DataFrame, keys: list[str], step: str, found: str) -> DataFrame:
    """Per scene, the inconsistencies of all steps as one text, a line each, in order of the steps."""
    each = rows.select(*keys, F.col(step).alias("_step"), F.posexplode(_list(F.col(found))).alias("_pos", "_what"))
    lines = F.array_sort(F.collect_list(F.struct("_step", "_pos", F.concat(F.lit("- ["), F.col("_step"), F.lit("] "), F.col("_what")).alias("_line"))))
    return each.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["_line"]), "\n").alias("text"))


def names_of(name: Column, appellations: Column) -> Column:
    """All names of an entity in lower case."""
    return F.filter(F.transform(F.concat(F.array(name), _list(appellations)), F.lower), lambda x: F.coalesce(x, F.lit("")) != "")


def matches_terms(names: Column, terms: Column, least: int = 3) -> Column:
    """Whether a term of three letters or more is in a name or holds one."""
    return F.exists(_list(terms), lambda t: (F.length(folded(t)) >= least) & F.exists(names, lambda n: F.contains(n, folded(t)) | F.contains(folded(t), n)))


def question_terms(question: Column, names: Column) -> Column:
    """The known names (of three letters or more) in a question, else its capitalised words, in lower case."""
    q = F.coalesce(question, F.lit(""))
    known = F.array_distinct(F.filter(_list(names), lambda n: (F.length(n) >= 3) & F.contains(F.lower(q), F.lower(n))))
    words = F.transform(F.regexp_extract_all(q, F.lit(r"(?U)\b([A-ZÀ-Ÿ][a-zà-ÿ]{2,})\b"), F.lit(1)), F.lower)
    return F.when(F.size(known) > 0, F.transform(known, F.lower)).otherwise(words)


def within_budget(text: Column, most: int = MAX_ANSWER_CONTEXT) -> Column:
    return F.substring(text, 1, most)


def elect_names(members: DataFrame, root: str, name: str, order: str, anchors: DataFrame | None = None) -> DataFrame:
    """(root, canonical): the name that stands for each cluster.

    A manual anchor of some member wins (``anchors(alias, canonical)``, by its whole name;
    the earliest member's), else the longest base name among members without
    parentheses, or among all where every member has some; the earliest of
    equals.
    """
    rows = members.select(F.col(root).alias("root"), F.col(name).alias("name"), F.col(order).alias("place"))
    if anchors is not None:
        known = anchors.select(F.lower("alias").alias("_alias"), F.col("canonical").alias("anchor")).dropDuplicates(["_alias"])
        rows = rows.join(known, F.lower("name") == F.col("_alias"), "left").drop("_alias")
    else:
        rows = rows.withColumn("anchor", F.lit(None).cast("string"))
    plain = (~F.contains("name", F.lit("("))).cast("int")
    best = F.max_by("name", F.struct(plain, F.length(name_norm(F.col("name"))), -F.col("place")))
    anchor = F.min_by("anchor", F.when(F.col("anchor").isNotNull(), F.col("place")))
    return rows.groupBy("root").agg(F.coalesce(anchor, best).alias("canonical"))


def anchored_clusters(names: DataFrame, name: str, anchors: DataFrame) -> DataFrame:
    """(canonical, name) of all distinct names in lower case: names of one cluster with the name that stands for it.

    ``anchors`` is (canonical, aliases).  A name that is an anchor's canonical
    name or alias, as it stands or without what is in parentheses, is in that
    anchor's cluster; then names that match join.  The earliest member by
    ``place``, a column of ``names``, elects where others are equal.
    """
    own = names.where(F.length(name) > 0).groupBy(F.lower(name).alias("name")).agg(F.min("place").alias("place"))
    known = anchors.select("canonical", F.explode(F.concat(F.array("canonical"), _list(F.col("aliases")))).alias("alias"))
    known = known.groupBy(F.lower("alias").alias("alias")).agg(F.min("canonical").alias("canonical"))
    by_name = own.join(known, F.col("alias") == F.col("name")).select("name", "canonical")
    by_base = own.join(known, F.col("alias") == name_norm(F.col("name"))).select("name", F.col("canonical").alias("other"))
    seeded = own.join(by_name, "name", "left").join(by_base, "name", "left").select("name", F.coalesce("canonical", "other").alias("canonical"))
    # An anchor is a node of its own kind: a name cannot be one.
    seeds = seeded.where("canonical is not null").select(F.col("name").alias("a"), F.concat(F.lit("\x00"), F.lower("canonical")).alias("b"))
    roots = clusters(name_pairs(own, "name").union(seeds))
    members = own.join(roots.select(F.col("node").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    elected = elect_names(members, "root", "name", "place", known.select("alias", "canonical"))
    return members.join(elected, "root").select("canonical", "name")


def voice_lines(messages: DataFrame, keys: list[str], order: str, text: str, name: str) -> DataFrame:
    """(keys, order, n, line): what a character does and says, of the messages that name it.

    Actions between asterisks that name it, everything in quotes, and what is
    left of the text (200 characters) if it names it.  ``name`` is a column; its
    parts of three letters or more count.
    """
    parts = F.filter(F.split(F.lower(F.col(name)), r"(?U)\s+"), lambda p: F.length(p) > 2)
    named = lambda t: F.exists(parts, lambda p: F.contains(F.lower(t), p))
    star, quote = r"\*([^*]+)\*", r"\"([^\"]+)\""
    t = F.coalesce(F.col(text), F.lit(""))
    acts = F.transform(F.filter(F.regexp_extract_all(t, F.lit(star), F.lit(1)), named), lambda a: F.concat(F.lit("*"), a, F.lit("*")))
    said = F.transform(F.regexp_extract_all(t, F.lit(quote), F.lit(1)), lambda a: F.concat(F.lit('"'), a, F.lit('"')))
    rest = strip(F.regexp_replace(F.regexp_replace(t, star, ""), quote, ""))
    plain = F.when((rest != "") & named(rest), F.array(F.substring(rest, 1, 200))).otherwise(F.array().cast("array<string>"))
    return messages.where(named(t)).select(*keys, order, F.posexplode(F.concat(acts, said, plain)).alias("n", "line"))


def with_summaries(entities: DataFrame, scene: str, summaries: DataFrame, summary: str) -> DataFrame:
    """Appearances with the summaries of their scenes, where there are some."""
    return entities.join(summaries.select(scene, summary), scene, "left")


def by_name(rows: DataFrame, name: str) -> DataFrame:
    """A master index, sorted by name."""
    return rows.orderBy(F.lower(F.col(name)), name)


def sorted_export(rows: DataFrame, time: str, order: str) -> DataFrame:
    """Merged exports by time; messages without a time come first."""
    return rows.orderBy(F.col(time).asc_nulls_first(), order)
