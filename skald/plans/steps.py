"""Queries of the scene steps, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scene_steps as S
from ..operators import text
from .catalogue import ORACLE_SQL, _t, query
from .messages import _META, _NARRATIVE, _SMILEY

_COLUMNS = ["export", "scene", "pos", "author", "content", "content_en", "ts"]
_STRIPPED = r"trim(coalesce(nullif(content_en, ''), content, ''), E' \t\n\r')"


def _chat(spark, sf) -> DataFrame:
    """Documents as messages of an export for each source, ten minutes apart but for a pause now and then."""
    seconds = F.col("doc_id") * 600 + F.floor(F.col("doc_id") / 97) * 7200
    d = _t(spark, sf, "documents")
    return d.select(F.col("source").alias("export"), F.col("doc_id").alias("pos"), F.col("lang").alias("author"), F.col("text").alias("content"), F.lit(None).cast("string").alias("content_en"), F.when(F.col("doc_id") % 13 != 0, F.timestamp_seconds(seconds)).alias("ts"))


_DROPPED = ORACLE_SQL["drop_rules"].replace("select doc_id, (t = ''", "select doc_id as id, (t = ''")


@query(f"""with dr as ({_DROPPED}),
m as (select source as export, doc_id as pos, case when doc_id % 13 <> 0 then doc_id * 600 + (doc_id // 97) * 7200 end as s, dropped from documents join dr on id = doc_id),
g as (select *, last_value(s ignore nulls) over (partition by export order by s nulls first, pos rows between unbounded preceding and 1 preceding) as prev from m),
n as (select *, sum(case when s - prev > 14400 then 1 else 0 end) over (partition by export order by s nulls first, pos rows unbounded preceding) as session from g),
k as (select *, count(*) over (partition by export, session) as size from n where not dropped),
p as (select *, dense_rank() over (partition by export order by session) - 1 as scene from k where size >= 5)
select export, scene, row_number() over (partition by export, scene order by s nulls first, pos) - 1 as pos, pos as doc_id from p""")
def step_purge(spark, sf):
    messages = _chat(spark, sf).withColumn("doc_id", F.col("pos"))
    return S.purge(messages, 4 * 3600, 5).select("export", "scene", "pos", "doc_id")


def _talk(spark, sf) -> DataFrame:
    """Turns as messages: some are actions, some short talk; a translation now and then."""
    c = _t(spark, sf, "conversations")
    short = F.substring("text", F.lit(1), (F.col("conv_id") * 7 + F.col("turn") * 11).cast("int") % 60)
    content = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("*"), F.substring(F.translate("text", "*", ""), 1, 40), F.lit("* "), short)).when(F.col("conv_id") % 5 == 0, F.concat(short, F.lit(" lol"))).otherwise(short)
    return c.select((F.col("conv_id") % 9).cast("string").alias("export"), F.col("conv_id").alias("scene"), F.col("turn").alias("pos"), F.col("role").alias("author"), content.alias("content"), F.when(F.col("turn") % 5 == 4, F.col("text")).alias("content_en"), F.timestamp_seconds(F.col("conv_id") * 90_000 + F.col("turn") * 60).alias("ts"))


_TALK = """talk as (select (conv_id % 9)::varchar as export, conv_id as scene, turn as pos, role as author, case when turn % 4 = 3 then '*' || substring(replace(text, '*', ''), 1, 40) || '* ' || sh when conv_id % 5 = 0 then sh || ' lol' else sh end as content, case when turn % 5 = 4 then text end as content_en
  from (select *, substring(text, 1, (conv_id * 7 + turn * 11) % 60) as sh from conversations))"""


def _prefix_sql(source: str, keys: str, out: str) -> str:
    """SQL: CTEs that cut the prefixes of ``source``; borderline groups stay where their prefix has an even number of characters."""
    on = " and ".join(f"{{a}}.{k} = {{b}}.{k}" for k in keys.split(", "))
    return rf"""{out}_a as (select *, {_STRIPPED} as t, min(case when regexp_matches(coalesce(nullif(content_en, ''), content, ''), '\*[^*]{{15,}}\*') then pos end) over (partition by {keys}) as anchor from {source}),
{out}_v as (select {keys}, count(*) as n, avg(length(t)) filter (where t <> '') as len, avg(length(regexp_replace(t, '[^a-zA-ZÀ-ÿ0-9]', '', 'g'))) filter (where t <> '') as meaningful, avg({_SMILEY}::int) filter (where t <> '') as ooc, string_agg(author || ': ' || t, E'\n' order by pos) as prefix from {out}_a where pos < anchor group by {keys}),
{out}_w as (select *, case when len is null or meaningful < 5 then 'trim' when len >= 45 and ooc < 0.25 then 'keep' when len < 25 or ooc >= 0.35 then 'trim' when n >= 2 then 'ask' else 'trim' end as verdict from {out}_v),
{out} as (select a.* exclude (t, anchor) from {out}_a a left join {out}_w w on {on.format(a='a', b='w')} where anchor is null or a.pos >= anchor or verdict is null or verdict = 'keep' or (verdict = 'ask' and length(prefix) % 2 = 0))"""


def _even(groups: DataFrame) -> DataFrame:
    return groups.withColumn("same", F.length("prefix") % 2 == 0)


@query(f"with {_TALK}, {_prefix_sql('talk', 'export, scene', 'cut')} select export, scene, pos from cut")
def step_prefix(spark, sf):
    return S.trim_prefix(_talk(spark, sf), ["export", "scene"], _even).select("export", "scene", "pos")


def _check_sql(source: str, keys: str, out: str) -> str:
    """SQL: CTEs with score and flags (a list) of each scene of ``source``(keys, pos, t)."""
    return rf"""{out}_g as (select {keys}, count(*) filter (where t <> '') as n, coalesce(avg(({_NARRATIVE})::int) filter (where t <> ''), 0) as narrative, coalesce(avg(length(t)) filter (where t <> ''), 0) as len,
  coalesce(regexp_matches(string_agg(t, E'\n' order by pos) filter (where t <> ''), '{text.QUOTED}'), false) as quotes, coalesce(avg({_SMILEY}::int) filter (where t <> ''), 0) as ooc, coalesce(avg({_META}::int) filter (where t <> ''), 0) as meta from {source} group by {keys}),
{out}_s as (select *, case when n = 0 then 0.0::double else round(least(1.0, greatest(0.0, (case when narrative >= .4 then .55 when narrative >= .15 then .35 when narrative >= .05 then .15 else 0 end) + (case when {out}_g.len >= 120 then .25 when {out}_g.len >= 60 then .15 when {out}_g.len >= 30 then .05 else 0 end) + (case when quotes then .1 else 0 end)
  - (case when ooc >= .5 then .4 when ooc >= .25 then .2 when ooc >= .1 then .05 else 0 end) - (case when meta >= .3 and ooc >= .15 then .35 when meta >= .2 then .15 when meta >= .1 then .05 else 0 end)))::double, 3) end as score,
  list_filter([case when n > 0 and ooc >= .3 then 'ooc' end, case when n > 0 and meta >= .2 then 'meta_rp' end, case when n = 0 or (narrative = 0 and {out}_g.len < 80) then 'no_narrative' end], lambda x: x is not null) as f from {out}_g),
{out} as (select {keys}, score, case when len(f) = 0 and {out}_s.len < 40 then ['too_casual'] else f end as flags from {out}_s)"""


_QUEUED = "(list_contains(flags, 'too_casual') or list_contains(flags, 'no_narrative'))"


@query(rf"""with {_TALK}, sized as (select *, count(*) over (partition by export, scene) as n from talk),
cut_at as (select distinct scene, pos from talk where pos >= 1 and (pos + scene) % 3 = 0),
parts as (select t.export, t.scene, case when t.n >= 4 then (select count(*) from cut_at b where b.scene = t.scene and b.pos <= t.pos and b.pos < t.n) else 0 end as part, t.pos as old, author, content, content_en from sized t),
p as (select * exclude (old), row_number() over (partition by export, scene, part order by old) - 1 as pos, {_STRIPPED} as t from parts),
{_check_sql('p', 'export, scene, part', 'raw')},
before as (select *, max(case when not {_QUEUED} then at_ end) over (partition by export order by at_ rows between unbounded preceding and 1 preceding) as before_ from (select *, row_number() over (partition by export order by scene, part) as at_ from raw)),
known as (select distinct a.export, a.scene, a.part, lower(regexp_replace(q.t, '[ \t\n\r]+', ' ', 'g')) as t from before a join before b on a.export = b.export and a.before_ = b.at_ join p q on q.export = b.export and q.scene = b.scene and q.part = b.part where q.t <> ''),
dup as (select p.*, k.t is not null as seen from p left join known k on k.export = p.export and k.scene = p.scene and k.part = p.part and k.t = lower(regexp_replace(p.t, '[ \t\n\r]+', ' ', 'g'))),
fresh as (select * exclude (t, seen, fr) from (select *, least(coalesce(min(case when not seen then pos end) over (partition by export, scene, part), 10), 10) as fr from dup) where pos >= fr),
{_prefix_sql('fresh', 'export, scene, part', 'cut')},
e as (select * exclude (pos), row_number() over (partition by export, scene, part order by pos) - 1 as pos, {_STRIPPED} as t from cut),
{_check_sql('e', 'export, scene, part', 'fin')},
num as (select *, row_number() over (partition by export order by scene, part) - 1 as number from fin)
select e.export, e.scene as source_scene, number as scene, count(*) as n_messages, any_value(score) as score, array_to_string(any_value(flags), ',') as flags, {_QUEUED.replace('flags', 'any_value(flags)')} as queued, case when not {_QUEUED.replace('flags', 'any_value(flags)')} then md5(string_agg(e.t, '|' order by e.pos)) end as digest
from e join num on num.export = e.export and num.scene = e.scene and num.part = e.part group by e.export, e.scene, e.part, number""")
def step_subdivide(spark, sf):
    talk = _talk(spark, sf)
    cuts = talk.where((F.col("pos") + F.col("scene")) % 3 == 0).groupBy("export", "scene").agg(F.collect_list(F.col("pos").cast("int")).alias("boundaries"))
    kept, queue = S.subdivide(talk, cuts, _even)
    digest = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", S.said().alias("t")))), lambda x: x["t"]), "|"))
    made = kept.groupBy("export", "source_scene", "scene", "score", "flags").agg(F.count(F.lit(1)).alias("n_messages"), digest.alias("digest"))
    queued = queue.withColumn("digest", F.lit(None).cast("string"))
    columns = ["export", "source_scene", "scene", "n_messages", "score", F.array_join("flags", ",").alias("flags"), "digest"]
    return made.select(*columns, F.lit(False).alias("queued")).union(queued.select(*columns, F.lit(True).alias("queued")))


def _session_talk(spark, sf) -> DataFrame:
    """Events as messages: an action every third, a long one every fifth, else talk; sessions of a day as scenes."""
    content = F.when(F.col("event_id") % 3 == 0, F.lit("*walks slowly on*")).when(F.col("event_id") % 5 == 0, F.repeat(F.lit("a long tale "), 8)).otherwise(F.lit("ok then"))
    e = _t(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("export"), F.datediff(F.lit("2100-01-01"), F.col("ts")).cast("long").alias("scene"), F.col("event_id").alias("pos"), F.col("event_type").alias("author"), content.alias("content"), F.lit(None).cast("string").alias("content_en"), F.when(F.col("event_id") % 19 != 0, F.col("ts")).alias("ts"))


_TIMES = """{o}_t as (select export, scene, min(ts) as nothing, arg_min(ts, pos) filter (where ts is not null) as first from {s} group by 1, 2),
{o}_p as (select export, scene, row_number() over (partition by export order by first nulls first, scene) - 1 as place from {o}_t),
{o} as (select s.* exclude (scene), place as scene from {s} s join {o}_p using (export, scene))"""


@query(rf"""with m as (select user_id::varchar as export, datediff('day', ts::date, date '2100-01-01') as scene, event_id as pos, case when event_id % 3 = 0 then '*walks slowly on*' when event_id % 5 = 0 then repeat('a long tale ', 8) else 'ok then' end as t, case when event_id % 19 <> 0 then ts end as ts from events),
{_TIMES.format(o='o', s='m')},
i as (select *, min(case when t <> 'ok then' then pos end) over (partition by export, scene) as lo, max(case when t <> 'ok then' then pos end) over (partition by export, scene) as hi from o),
inner_ as (select * exclude (lo, hi) from i where lo is null or pos between lo and hi),
sized as (select export, scene, count(*) as n, arg_min_null(ts, pos) as start, arg_max_null(ts, pos) as fin from inner_ group by 1, 2),
gaps as (select *, (epoch_us(start) - epoch_us(lag(fin) over (partition by export order by scene))) / 3.6e9 as gap, row_number() over (partition by export order by scene) = 1 as first_ from sized),
groups as (select *, sum(case when n < 15 and not first_ and coalesce(gap <= 240, true) and coalesce(gap < 40, true) then 0 else 1 end) over (partition by export order by scene rows unbounded preceding) - 1 as merged from gaps),
grown as (select x.export, g.merged as scene, x.scene as old, x.pos as at_, x.ts, count(*) over (partition by x.export, g.merged) as size from inner_ x join groups g using (export, scene)),
left_ as (select export, scene, row_number() over (partition by export, scene order by old, at_) - 1 as pos, at_ as event_id, ts from grown where size >= 10),
{_TIMES.format(o='z', s='left_')} select export, scene, pos, event_id from z""")
def step_clean(spark, sf):
    near = lambda pairs: pairs.withColumn("same", F.coalesce(F.col("gap_hours") < 40, F.lit(True)))
    messages = _session_talk(spark, sf).withColumn("event_id", F.col("pos"))
    return S.clean_scenes(messages, near).select("export", "scene", "pos", "event_id")
