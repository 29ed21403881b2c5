"""Message filters, scene quality and name normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the message rules.
SEPARATOR = r"^[\-_*=~]{2,}\s*$"
#: A quote, or brackets that hold a year, a date or a clock time.
QUOTES = (r">\s+", r"\[[^\n]{0,60}?\d{4}[^\n]{0,30}?\]", r"\[[^\n]{0,30}?\d{1,2}[/\.]\d{1,2}[/\.]", r"\[[^\n]{0,30}?\d{1,2}:\d{2}")
WORD = "[a-zA-ZÀ-ÿ0-9]{2,}"
MENTION, EMOJI, URL = r"<@!?\d+>", r"<:\w+:\d+>", r"https?://\S+"
#: Words of players who talk beside the play; each stands between word borders.
OOC_TERMS = (
    "lol", "lmao", "mdr", "xd", "haha", "hihi", "ahah", "irl", "ooc", "brb", "afk", r"ok\s", "okay",
    r"ce\s+soir", "demain", r"ce\s+week", "disponible", "dispo", r"pas\s+là", "absent",
    r"on\s+joue", r"on\s+reporte", r"on\s+reprend", "prêt", "ready",
    "désolé", "sorry", "connexion", "internet", "reboot", r"bug\s+technique",
)
SMILEY = r"\^\^+"
#: Players' remarks on the play as a whole.
META_TERMS = (
    "comme personnage", "en tant que", "la scène (?:où|d[eu])", "vous avez (?:joué|fait)", "cette session", "le RP (?:d[eu]|hier)",
    "incroyable comme", "j'ai adoré", "c'était (?:bien|super|génial|trop)", "trop (?:bien|bon|fort) (?:ce|cette|le|la)", "cette scène (?:était|a été)",
)
QUOTED = '[«»"][^«»"]{5,}[«»"]'


def _between_borders(terms: tuple[str, ...]) -> str:
    return r"(?iU)\b(?:" + "|".join(terms) + r")\b"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Without mentions, custom emoji and links; white space collapsed."""
    for pattern in (MENTION, EMOJI, URL):
        text = F.regexp_replace(text, f"(?U){pattern}", "")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def drop_message(text: Column) -> Column:
    """Whether a message is noise: empty, a separator, a quote or time stamp, or without a word once cleaned."""
    t = strip(F.coalesce(text, F.lit("")))
    quote = "(?iU)^(?:" + "|".join(QUOTES) + ")"
    return (t == "") | t.rlike(f"(?U){SEPARATOR}") | t.rlike(quote) | ~clean(t).rlike(WORD)


def preferred(translated: Column, original: Column) -> Column:
    """The translation unless empty, else the original, stripped."""
    return strip(F.coalesce(F.nullif(translated, F.lit("")), original, F.lit("")))


def is_ooc(text: Column, smileys: bool = False) -> Column:
    """Whether players talk beside the play; ``smileys``: ^^ counts as well."""
    found = text.rlike(_between_borders(OOC_TERMS))
    return found | text.rlike(SMILEY) if smileys else found


def is_meta(text: Column) -> Column:
    """Whether players remark on the play from outside."""
    return text.rlike(_between_borders(META_TERMS))


def meaningful_length(text: Column) -> Column:
    """Letters and digits."""
    return F.length(F.regexp_replace(text, "[^a-zA-ZÀ-ÿ0-9]", ""))


def normalized(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def slug_ws(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip(name)), r"(?U)\s+", "_")


def slug_word(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip(name)), r"(?U)[^\w]", "_")


def name_norm(name: Column) -> Column:
    """Without qualifiers in parentheses, collapsed, lower case."""
    return normalized(F.regexp_replace(name, r"\([^)]*\)", ""))


def is_narrative(inner: Column) -> Column:
    """An action between asterisks: 25 letters or more and two distinct words."""
    return (F.length(inner) >= 25) & (F.size(F.array_distinct(F.regexp_extract_all(inner, F.lit("([a-zA-ZÀ-ÿ]{3,})"), F.lit(1)))) >= 2)


def is_roleplay(text: Column) -> Column:
    """A stripped message with an action of 10 characters between asterisks, or a long one without talk beside the play."""
    return text.rlike(r"\*[^*]{10,}\*") | ((F.length(text) >= 80) & ~is_ooc(text))


def has_narrative(text: Column) -> Column:
    """Whether some text between asterisks is a narrative action."""
    return F.exists(F.regexp_extract_all(text, F.lit(r"\*([^*]+)\*"), F.lit(1)), is_narrative)


def scene_check(messages: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Per scene: is_rp, score and flags, from stripped messages; a scene without any text has score 0 and ``no_narrative``."""
    t = F.col(text)
    said = t != ""
    share = lambda c: F.coalesce(F.avg(F.when(said, c.cast("int"))), F.lit(0.0))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said, F.struct(*order, t.alias("_t"))))), lambda x: x["_t"]), "\n")
    scene = messages.groupBy(*keys).agg(
        F.count(F.when(said, 1)).alias("n"), share(has_narrative(t)).alias("narrative"), F.coalesce(F.avg(F.when(said, F.length(t))), F.lit(0.0)).alias("length"),
        whole.rlike(QUOTED).alias("quotes"), share(is_ooc(t, smileys=True)).alias("ooc"), share(is_meta(t)).alias("meta"))
    flags = F.filter(
        F.array(F.when(F.col("ooc") >= 0.3, "ooc"), F.when(F.col("meta") >= 0.2, "meta_rp"), F.when((F.col("narrative") == 0) & (F.col("length") < 80), "no_narrative")), lambda x: x.isNotNull()
    )
    flags = F.when((F.size(flags) == 0) & (F.col("length") < 40), F.array(F.lit("too_casual"))).otherwise(flags)
    score = quality_score(*(F.col(c) for c in ("narrative", "length", "quotes", "ooc", "meta")))
    score = F.when(F.col("n") > 0, score).otherwise(F.lit(0.0))
    flags = F.when(F.col("n") > 0, flags).otherwise(F.array(F.lit("no_narrative")))
    return scene.select(*keys, (score >= 0.5).alias("is_rp"), score.alias("score"), flags.alias("flags"))


def prefix_verdict(messages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per group of messages before a scene's first action: whether to ``keep`` or ``trim`` them, or to ``ask``; stripped messages."""
    t = F.col(text)
    said = t != ""
    mean = lambda c: F.avg(F.when(said, c.cast("int")))
    groups = messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), mean(F.length(t)).alias("length"), mean(meaningful_length(t)).alias("meaningful"), mean(is_ooc(t, smileys=True)).alias("ooc"))
    verdict = F.when(F.col("length").isNull() | (F.col("meaningful") < 5), "trim").when((F.col("length") >= 45) & (F.col("ooc") < 0.25), "keep")
    verdict = verdict.when((F.col("length") < 25) | (F.col("ooc") >= 0.35), "trim").when(F.col("n") >= 2, "ask").otherwise("trim")
    return groups.select(*keys, verdict.alias("verdict"))


def quality_score(narrative: Column, length: Column, quotes: Column, ooc: Column, meta: Column) -> Column:
    """The score ladder of a scene, 0..1 with three places."""
    s = F.when(narrative >= 0.4, 0.55).when(narrative >= 0.15, 0.35).when(narrative >= 0.05, 0.15).otherwise(0.0)
    s = s + F.when(length >= 120, 0.25).when(length >= 60, 0.15).when(length >= 30, 0.05).otherwise(0.0)
    s = s + F.when(quotes, 0.1).otherwise(0.0)
    s = s - F.when(ooc >= 0.5, 0.4).when(ooc >= 0.25, 0.2).when(ooc >= 0.1, 0.05).otherwise(0.0)
    s = s - F.when((meta >= 0.3) & (ooc >= 0.15), 0.35).when(meta >= 0.2, 0.15).when(meta >= 0.1, 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)), 3)


def card(parts: list[Column], limit: int = 200) -> Column:
    """A summary card: the parts that are there, joined, cut at the limit."""
    return F.substring(F.concat_ws(" | ", *parts), 1, limit)
