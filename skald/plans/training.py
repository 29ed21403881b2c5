r"""Queries of training examples and of the ledger, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import training
from ..operators import ledger
from .catalogue import _t, query

_CONFIRMED = """c as (select conv_id as scene, case when conv_id % 4 = 0 then 'rejected' else 'confirmed' end as status, string_agg(text, chr(10) order by turn) as text, count(*) as n from conversations group by 1),
r as (select *, case when scene % 2 = 0 then '{"p":"night"}' else '{}' end as w, case when n > 4 then '{"n":' || n || '}' end as o, '{"e":' || scene || '}' as t, case when scene % 3 <> 0 then '[1]' else ' ' end as h from c where status = 'confirmed' and text <> '')"""


@query(rf"""with {_CONFIRMED}, base as (select *, 'Analyze this RP scene:' || chr(10) || '---' || chr(10) || text || chr(10) || '---' as u from r),
ctx as (select *, concat_ws(chr(10) || chr(10), case when w <> '{{}}' then 'WHEN:' || chr(10) || w end, 'WHO:' || chr(10) || o) as k from base),
e as (select scene, 'when' as step, u as asked, w as told from ctx where w <> '{{}}' union all select scene, 'who', u, o from ctx where o is not null
 union all select scene, 'what', case when k <> '' then u || chr(10) || chr(10) || 'Context from previous steps:' || chr(10) || k else u end, t from ctx
 union all select scene, 'how', u || chr(10) || chr(10) || 'Context from previous steps:' || chr(10) || concat_ws(chr(10) || chr(10), nullif(k, ''), 'WHAT:' || chr(10) || t), h from ctx where h <> ' ')
select scene, step, md5(asked) as asked, told from e""")
def training_examples(spark, sf):
    c = _t(spark, sf, "conversations")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    texts = c.where("text is not null").groupBy(F.col("conv_id").alias("scene")).agg(lines.alias("text"))
    counted = c.groupBy(F.col("conv_id").alias("scene")).agg(F.count(F.lit(1)).alias("n"))
    k = F.col("scene")
    confirmed = counted.select(
        "scene", F.when(k % 4 == 0, "rejected").otherwise("confirmed").alias("status"), F.when(k % 2 == 0, '{"p":"night"}').otherwise("{}").alias("when"), F.lit(None).cast("string").alias("where"),
        F.when(F.col("n") > 4, F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit("}"))).alias("who"), F.lit("").alias("which"), F.concat(F.lit('{"e":'), k.cast("string"), F.lit("}")).alias("what"),
        F.when(k % 3 != 0, "[1]").otherwise(" ").alias("how"),
    )
    return training.step_examples(confirmed, texts).select("scene", "step", F.md5("user").alias("asked"), F.col("assistant").alias("told"))


@query("""with l as (select l_orderkey as o, l_linenumber * 1000000 + l_partkey as pos, l_suppkey % 9 as s, l_partkey % 4 as k, l_partkey as p from lineitem),
ev as (select o, pos, case when p % 5 = 0 then '' else repeat('event ' || p || ' ', 12) end as d, case k when 0 then 'revelation' when 1 then 'decision' else 'action' end as t, 'C' || s as c from l),
wh as (select distinct o, 'C' || (l_suppkey % 9) as c from (select l_orderkey as o, l_suppkey from lineitem) where o % 2 = 0),
act as (select wh.o, wh.c, coalesce((select arg_min(left(d, 80), (pos, d)) from ev where ev.o = wh.o and ev.c = wh.c and d <> ''), 'present') as a from wh),
cast_ as (select o, string_agg(c || '=' || a, ';' order by c) as cs from act group by 1),
ten as (select o, string_agg(left(d, 120), ';' order by pos, d) as ts from (select *, row_number() over (partition by o order by pos, d) as n from ev where d <> '' and t in ('revelation', 'decision') and o % 2 = 0) where n <= 4 group by 1)
select o_orderkey::varchar as scene, case when o_orderkey % 2 = 0 and o_orderkey % 6 <> 0 then 'S' || o_orderkey else o_orderpriority end as narrative, case when o_orderkey % 2 = 0 then coalesce(cs, '') else 'old=x' end as cast_, case when o_orderkey % 2 = 0 then coalesce(ts, '') else 't' end as tensions
from orders left join cast_ on cast_.o = o_orderkey left join ten on ten.o = o_orderkey""")
def corrected_ledger(spark, sf):
    lines, orders = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    p = F.col("l_partkey")
    name = F.concat(F.lit("C"), (F.col("l_suppkey") % 9).cast("string"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("revelation", "decision", "action", "action"))), (p % 4 + 1).cast("int"))
    told = F.when(p % 5 == 0, "").otherwise(F.repeat(F.concat(F.lit("event "), p.cast("string"), F.lit(" ")), F.lit(12)))
    event = F.struct((F.col("l_linenumber") * 1_000_000 + p).alias("pos"), told.alias("description"), kind.alias("type"), F.array(name).alias("characters"))
    even = F.col("o_orderkey") % 2 == 0
    events = F.transform(F.array_sort(F.collect_list(event)), lambda e: F.struct(e["description"].alias("description"), e["type"].alias("type"), e["characters"].alias("characters")))
    found = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(name)).alias("characters"), events.alias("events"))
    joined = orders.where(even).join(found, "o_orderkey", "left")
    scene = F.col("o_orderkey").cast("string").alias("scene")
    who, what = joined.select(scene, "characters"), joined.select(scene, F.when(F.col("o_orderkey") % 6 != 0, F.concat(F.lit("S"), F.col("o_orderkey").cast("string"))).alias("summary"), "events")
    old = F.array(F.struct(F.lit("old").alias("name"), F.lit("x").alias("action")))
    held = orders.select(scene, F.col("o_orderpriority").alias("narrative"), old.alias("characters"), F.array(F.lit("t")).alias("tensions"), F.lit(False).alias("corrected"))
    made = ledger.corrected(held, who, what)
    return made.select("scene", "narrative", F.array_join(F.transform("characters", lambda c: F.concat(c["name"], F.lit("="), c["action"])), ";").alias("cast_"), F.array_join("tensions", ";").alias("tensions"))
