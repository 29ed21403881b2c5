"""Queries of the message and scene rules, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text
from .catalogue import _t, query

_W = r"[\p{L}\p{N}_]"


def _found(column: str, terms: tuple[str, ...]) -> str:
    """SQL: whether a term stands between word borders; one that ends in white space needs a word right after it."""
    plain = "|".join(t for t in terms if not t.endswith(r"\s")).replace("'", "''")
    tests = [rf"regexp_matches({column}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{plain})(?:$|[^\p{{L}}\p{{N}}_])')"]
    tests += [rf"regexp_matches({column}, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){t}{_W}')" for t in terms if t.endswith(r"\s")]
    return f"({' or '.join(tests)})"


_OOC, _META = _found("t", text.OOC_TERMS), _found("t", text.META_TERMS)
_SMILEY = rf"({_OOC} or regexp_matches(t, '{text.SMILEY}'))"
_DOCS = r"select doc_id, trim(text, E' \t\n\r') as t from documents"
_SAID = r"select conv_id, turn, trim(coalesce(text, ''), E' \t\n\r') as t from conversations"


def _messages(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", text.preferred(F.lit(None).cast("string"), F.col("text")).alias("t"))


@query(rf"with d as ({_DOCS}) select doc_id, (regexp_matches(t, '\*[^*]{{10,}}\*') or (length(t) >= 80 and not {_OOC})) as is_rp from d")
def rp_rule(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.is_roleplay(text.strip(F.col("text"))).alias("is_rp"))


@query(rf"with d as ({_DOCS}) select doc_id, {_SMILEY} as ooc, {_META} as meta, length(regexp_replace(t, '[^a-zA-ZÀ-ÿ0-9]', '', 'g')) as meaningful from d")
def meta_rp(spark, sf):
    t = text.strip(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", text.is_ooc(t, smileys=True).alias("ooc"), text.is_meta(t).alias("meta"), text.meaningful_length(t).cast("long").alias("meaningful"))


@query(rf"""with m as ({_SAID}), g as (select conv_id, count(*) as n, avg(length(t)) filter (where t <> '') as len, avg(length(regexp_replace(t, '[^a-zA-ZÀ-ÿ0-9]', '', 'g'))) filter (where t <> '') as meaningful, avg({_SMILEY}::int) filter (where t <> '') as ooc from m group by 1)
select conv_id, case when len is null or meaningful < 5 then 'trim' when len >= 45 and ooc < 0.25 then 'keep' when len < 25 or ooc >= 0.35 then 'trim' when n >= 2 then 'ask' else 'trim' end as verdict from g""")
def prefix_verdict(spark, sf):
    return text.prefix_verdict(_messages(spark, sf), ["conv_id"], "t")


_NARRATIVE = r"len(list_filter(regexp_extract_all(t, '\*([^*]+)\*', 1), lambda x: length(x) >= 25 and len(list_distinct(regexp_extract_all(x, '[a-zA-ZÀ-ÿ]{3,}'))) >= 2)) > 0"


@query(rf"""with m as ({_SAID}), g as (select conv_id, count(*) filter (where t <> '') as n, coalesce(avg(({_NARRATIVE})::int) filter (where t <> ''), 0) as narrative, coalesce(avg(length(t)) filter (where t <> ''), 0) as len,
  coalesce(regexp_matches(string_agg(t, E'\n' order by turn) filter (where t <> ''), '{text.QUOTED}'), false) as quotes, coalesce(avg({_SMILEY}::int) filter (where t <> ''), 0) as ooc, coalesce(avg({_META}::int) filter (where t <> ''), 0) as meta from m group by 1),
s as (select *, case when n = 0 then 0.0::double else round(least(1.0, greatest(0.0, (case when narrative >= .4 then .55 when narrative >= .15 then .35 when narrative >= .05 then .15 else 0 end) + (case when len >= 120 then .25 when len >= 60 then .15 when len >= 30 then .05 else 0 end) + (case when quotes then .1 else 0 end)
  - (case when ooc >= .5 then .4 when ooc >= .25 then .2 when ooc >= .1 then .05 else 0 end) - (case when meta >= .3 and ooc >= .15 then .35 when meta >= .2 then .15 when meta >= .1 then .05 else 0 end)))::double, 3) end as score,
  list_filter([case when n > 0 and ooc >= .3 then 'ooc' end, case when n > 0 and meta >= .2 then 'meta_rp' end, case when n = 0 or (narrative = 0 and len < 80) then 'no_narrative' end], lambda x: x is not null) as f from g)
select conv_id, score >= 0.5 as is_rp, score, array_to_string(case when len(f) = 0 and len < 40 then ['too_casual'] else f end, ',') as flags from s""".replace("len < 40", "s.len < 40"))
def scene_flags(spark, sf):
    scenes = text.scene_check(_messages(spark, sf), ["conv_id"], ["turn"], "t")
    return scenes.select("conv_id", "is_rp", "score", F.array_join("flags", ",").alias("flags"))
