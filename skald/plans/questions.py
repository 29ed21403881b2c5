r"""Queries of containment, translation and model tasks, and the same in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import containment, tasks, translation
from ..operators.scene_steps import scene_text
from .catalogue import _t, query


@query(r"""with n as (select distinct lower(name) as name from (select substring(text, 1, 1 + item_id % 9) as name from benchmark union all select regexp_extract(text, '([^ ]+ [^ ]+)$', 1) from benchmark) where length(name) > 0)
select name, doc_id from n, documents where contains(lower(text), name)""")
def names_in_texts(spark, sf):
    b = _t(spark, sf, "benchmark")
    names = b.select(F.substring("text", F.lit(1), (1 + F.col("item_id") % 9).cast("int")).alias("name")).union(b.select(F.regexp_extract("text", r"([^ ]+ [^ ]+)$", 1)))
    return containment.names_in_texts(names, "name", _t(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


_LADY = "'Lady S' || (l_suppkey % 20) || ' of ' || l_returnflag"


@query(f"""with d as (select distinct l_orderkey as scene, l_partkey as pos, l_suppkey % 20 as s, {_LADY} as canonical_name from lineitem),
e as (select distinct 's' || s as name, scene from d where scene % 3 = 0 union select distinct 's1', scene from d where scene % 5 = 0),
m as (select name, d.scene, pos, canonical_name, row_number() over (partition by name, d.scene order by pos, canonical_name) as n from e join d on d.scene = e.scene where contains(lower(canonical_name), name))
select name, scene, pos from m where n = 1""")
def arc_details(spark, sf):
    lines = _t(spark, sf, "lineitem").withColumn("s", F.col("l_suppkey") % 20)
    details = lines.select(F.col("l_orderkey").alias("scene"), F.struct(F.col("l_partkey").alias("at"), F.concat(F.lit("Lady S"), "s", F.lit(" of "), "l_returnflag").alias("name")).alias("pos"), "s").distinct()
    details = details.withColumn("canonical_name", F.col("pos.name"))
    third = details.where("scene % 3 = 0").groupBy(F.concat(F.lit("s"), "s").alias("name")).agg(F.collect_set("scene").alias("appearances"))
    fifth = details.where("scene % 5 = 0").agg(F.collect_set("scene").alias("appearances")).select(F.lit("s1").alias("name"), "appearances")
    both = third.union(fifth).select("name", F.explode("appearances").alias("scene")).groupBy("name").agg(F.collect_set("scene").alias("appearances"))
    return containment.details_of(both, details.select("scene", "pos", "canonical_name")).select("name", "scene", F.col("pos.at").alias("pos"))


def _turns(spark, sf) -> DataFrame:
    c = _t(spark, sf, "conversations")
    given = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("T:"), "text")).when(F.col("turn") % 3 == 1, F.lit(""))
    return c.select((F.col("conv_id") % 5).cast("string").alias("export"), F.col("conv_id").alias("scene"), F.col("turn").alias("pos"), F.col("text").alias("content"), given.alias("content_en"))


def _done(messages: DataFrame) -> DataFrame:
    """What an earlier run got to: the messages of every second scene that are at the place 4 or later."""
    return messages.where("scene % 2 = 0 and pos >= 4").select("export", "scene", "pos", F.concat(F.lit("D:"), "content").alias("content_en"))


_TURNS = """m as (select (conv_id % 5)::varchar as export, conv_id as scene, turn as pos, coalesce(text, '') as content, case when conv_id % 2 = 0 and turn >= 4 then 'D:' || text when turn % 3 = 0 then 'T:' || text end as known from conversations),
q as (select *, row_number() over (partition by scene order by pos) - 1 as n from m where known is null)"""


@query(f"with {_TURNS} select export, scene, n // 2 as batch, md5(string_agg('[' || (n % 2) || '] ' || content, chr(10) order by n)) as lines, string_agg(pos::varchar, ',' order by n) as places from q group by 1, 2, 3")
def translation_batches(spark, sf):
    calls = translation.packed(translation.resumed(_turns(spark, sf), _done(_turns(spark, sf))), 2)
    lines = F.md5(F.substring("prompt", len(translation.INSTRUCTION) + 1, 1 << 30))
    return calls.select("export", "scene", "batch", lines.alias("lines"), F.array_join(F.transform("places", lambda p: p.cast("string")), ",").alias("places"))


def _shouting():
    """A stand-in for a model: the first message of a call with a mark, the second left out, nothing for the third."""
    import json

    def call(prompt: str) -> str:
        texts = re.split(r"(?m)^\[(\d+)\] ", prompt)[1:]
        found = {int(i): t.removesuffix("\n") for i, t in zip(texts[::2], texts[1::2])}
        return json.dumps({"messages": [{"index": i, "content_en": "E:" + t if i == 0 else ""} for i, t in found.items() if i != 1] + [{"index": 99, "content_en": "x"}, {"content_en": "y"}]})

    return call


@query(f"with {_TURNS} select m.export, m.scene, m.pos, coalesce(m.known, case n % 3 when 0 then 'E:' || m.content when 1 then m.content else '' end) as content_en from m left join q on q.scene = m.scene and q.pos = m.pos")
def translation_resume(spark, sf):
    messages = _turns(spark, sf)
    return translation.translate(messages, _done(messages), lambda: _shouting(), 3).select("export", "scene", "pos", "content_en")


def _scene_inputs(spark, sf) -> DataFrame:
    c = _t(spark, sf, "conversations").select(F.col("conv_id").alias("scene"), F.col("turn").alias("pos"), F.col("role").alias("author"), F.col("text").alias("content"), F.lit(None).cast("string").alias("content_en"))
    return c.groupBy("scene").agg(F.count(F.lit(1)).alias("n_messages"), scene_text(["scene"]).alias("text")).withColumns({"lore": F.lit("none"), "earlier": F.lit(None).cast("string"), "characters": F.lit("")})


@query("""with s as (select conv_id as scene, count(*) as n from conversations group by 1)
select scene, case when scene % 3 = 0 then false else true end as is_rp, case when scene % 3 = 0 then scene / 1000.0 when scene % 3 = 1 then 0.5 else 1.0 end::double as score, case when scene % 3 = 0 then 'cut' else '' end as reason,
case when n >= 4 and scene % 2 = 0 then '1,2' else '' end as boundaries, case when scene % 3 = 1 then 'told' else '' end as summary, case when scene % 3 = 1 then 2 else 0 end as n_events from s""")
def model_tasks(spark, sf):
    """Three tasks on recorded answers: whole ones, cut ones, wrong ones and none."""
    scenes = _scene_inputs(spark, sf)
    gate, cuts, what = (tasks.TASKS[k] for k in ("gate", "boundaries", "what"))
    sha = lambda task: F.sha2(task.prompt(), 256).alias("prompt_sha")
    cut = F.concat(F.lit('{"is_rp": false, "score": '), (F.col("scene") / 1000).cast("string"), F.lit(', "reason": "cut", "flags": ["a", "b'))
    gates = scenes.where("scene % 3 < 2").select(sha(gate), F.when(F.col("scene") % 3 == 0, cut).otherwise(F.lit('{"score": 0.5, "flags": null, "more": 1}')).alias("answer"))
    bounds = scenes.select(sha(cuts), F.when(F.col("scene") % 2 == 0, F.lit('{"boundaries": [1, 2]}')).otherwise(F.lit("no JSON at all")).alias("answer"))
    whats = scenes.where("scene % 3 = 1").select(sha(what), F.lit('{"summary": "told", "events": [{"description": "a"}, {"description": "b"}').alias("answer"))
    done = gate.run(scenes, recording=gates, into="g")
    done = cuts.run(done, recording=bounds, into="b")
    done = what.run(done, recording=whats, into="w")
    listed = F.array_join(F.transform("b.boundaries", lambda x: x.cast("string")), ",")
    return done.select("scene", "g.is_rp", "g.score", "g.reason", listed.alias("boundaries"), "w.summary", F.size("w.events").cast("long").alias("n_events"))
