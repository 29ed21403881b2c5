"""Queries of state, manifests and joins over records, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import carried
from .catalogue import _t, query


def order_scenes(spark, sf):
    """Orders of a customer as the scenes of an export: suppliers are its cast, flags their authors."""
    lines = _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("scene"), F.concat(F.lit("S"), (F.col("l_suppkey") % 50).cast("string")).alias("name"), F.concat("l_returnflag", "l_linestatus").alias("author"), "l_linenumber"
    )
    cast_ = lines.groupBy("scene").agg(F.array_sort(F.collect_set("name")).alias("characters"))
    plays = lines.groupBy("scene", "author").agg(F.max_by("name", F.struct("l_linenumber", "name")).alias("name"))
    plays = plays.groupBy("scene").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("author", "name")))).alias("authors"))
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").alias("export"), F.col("o_orderkey").alias("scene"), F.col("o_orderpriority").alias("narrative"))
    return orders.join(cast_, "scene", "left").join(plays, "scene", "left")


@query("""with l as (select l_orderkey as scene, 'S' || (l_suppkey % 50) as c, l_returnflag || l_linestatus as a, l_linenumber as n from lineitem),
cast_ as (select scene, list_sort(list(distinct c)) as cs from l group by scene),
plays as (select scene, string_agg(a || '=' || c, ',' order by a) as p from (select scene, a, arg_max(c, (n, c)) as c from l group by scene, a) group by scene),
s as (select o_custkey as export, o_orderkey as scene, o_orderpriority as narrative, cs, coalesce(p, '') as p, row_number() over (partition by o_custkey order by o_orderkey) as pos from orders left join cast_ on o_orderkey = cast_.scene left join plays on plays.scene = o_orderkey),
named as (select export, scene, unnest(cs) as c from s),
shared as (select distinct a.export, a.scene, b.scene as before from named a join named b on a.export = b.export and a.c = b.c and b.scene < a.scene),
last12 as (select *, row_number() over (partition by export, scene order by before desc) as back from shared),
ctx as (select export, l.scene, string_agg(before || ':' || s.narrative, ',' order by before) as context from last12 l join (select scene as k, narrative from s) s on k = before where back <= 12 group by export, l.scene),
walk(export, pos, scene, cs, p, prev_cs, prev_p) as (with recursive w as (select export, pos, scene, cs, p, []::varchar[] as prev_cs, '' as prev_p from s where pos = 1
  union all select s.export, s.pos, s.scene, s.cs, s.p, w.cs, w.p from w join s on s.export = w.export and s.pos = w.pos + 1) select * from w)
select walk.export, walk.scene, coalesce(array_to_string(prev_cs, ','), '') as previous_characters, prev_p as previous_authors,
case when cs is null then coalesce((select string_agg(s.scene || ':' || s.narrative, ',' order by s.scene) from s where s.export = walk.export and s.pos between walk.pos - 12 and walk.pos - 1), '') else coalesce(context, '') end as context
from walk left join ctx on ctx.export = walk.export and ctx.scene = walk.scene""")
def carried_scenes(spark, sf):
    made = carried.carry(order_scenes(spark, sf))
    plays = F.array_sort(F.transform(F.map_entries("previous_authors"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    context = F.transform("context", lambda e: F.concat(e["scene"].cast("string"), F.lit(":"), e["narrative"]))
    return made.select("export", "scene", F.array_join("previous_characters", ",").alias("previous_characters"), F.array_join(plays, ",").alias("previous_authors"), F.array_join(context, ",").alias("context"))
