"""Queries of merges, handlers and incremental work, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import handlers as H
from ..operators import merges as M
from .catalogue import _t, power_score, query, tension_trend
from .catalogue import ORACLE_SQL as _SQL


@query("""with r as (select l_suppkey % 40 as x, l_partkey % 40 as y, nullif(l_returnflag, 'N') as relation, l_orderkey as o, l_linenumber as l from lineitem)
select least(x, y) as a, greatest(x, y) as b, count(*) as weight, arg_min(relation, (o, l, relation)) filter (where relation is not null) as relation from r where x <> y group by 1, 2""")
def edge_labels(spark, sf):
    r = _t(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("x"), (F.col("l_partkey") % 40).alias("y"), F.nullif("l_returnflag", F.lit("N")).alias("relation"), "l_orderkey", "l_linenumber")
    return M.labelled_edges(r, "x", "y", ["l_orderkey", "l_linenumber", "relation"], ["relation"])


@query("select l_suppkey, l_partkey % 10 as other, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) as relation from lineitem group by 1, 2")
def relation_last(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 10).alias("other"), F.col("l_returnflag").alias("relation"), "l_orderkey", "l_linenumber")
    return M.last_of(rows, ["l_suppkey", "other"], ["l_orderkey", "l_linenumber", "relation"]).select("l_suppkey", "other", "relation")


@query("""with r as (select l_suppkey % 20 as a, l_partkey % 20 as b, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey % 20, l_partkey % 20 order by l_orderkey, l_linenumber) as n from lineitem)
select a, b, l_orderkey, l_linenumber from r where n = 1""")
def how_links(spark, sf):
    rows = _t(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("a"), (F.col("l_partkey") % 20).alias("b"), "l_orderkey", "l_linenumber")
    return M.first_of(rows, ["a", "b"], ["l_orderkey", "l_linenumber"])


@query("""with r as (select role, substr(text, 1, 40) as opening, conv_id, turn, row_number() over (partition by role, substr(text, 1, 40) order by conv_id, turn) as n from conversations)
select role, opening, conv_id, turn from r where n = 1 order by conv_id, turn limit 12""")
def irony_dedup(spark, sf):
    rows = _t(spark, sf, "conversations").select("role", F.substring("text", 1, 40).alias("opening"), "conv_id", "turn")
    return M.first_of(rows, ["role", "opening"], ["conv_id", "turn"]).orderBy("conv_id", "turn").limit(12)


@query("""select o_custkey, arg_max(o_orderpriority, (case o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 when '3-MEDIUM' then 2 else 0 end) * 1000000000000 - o_orderkey) as o_orderpriority from orders group by 1""")
def competency_best(spark, sf):
    best = M.highest("o_orderpriority", "o_orderkey", {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2})
    return _t(spark, sf, "orders").groupBy("o_custkey").agg(best.alias("o_orderpriority"))


@query("select o_custkey, arg_max(s, o_orderkey) filter (where s <> 'unknown') as status from (select *, case o_orderstatus when 'O' then 'unknown' else o_orderstatus end as s from orders) group by 1")
def last_known_state(spark, sf):
    rows = _t(spark, sf, "orders").withColumn("s", F.when(F.col("o_orderstatus") == "O", "unknown").otherwise(F.col("o_orderstatus")))
    return rows.groupBy("o_custkey").agg(M.last_known("s", ["o_orderkey"]).alias("status"))


@query("""with f as (select user_id, event_type, min(event_id) as f from events group by 1, 2)
select user_id, arg_min(event_type, f) as first_appearance, string_agg(event_type, ',' order by f) as appearances from f group by 1""")
def appearance_order(spark, sf):
    firsts = M.first_of(_t(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])
    return firsts.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_appearance"), M.joined_text(F.col("event_type"), ["event_id"], ",").alias("appearances"))


@query("""with c as (select conv_id, turn, role, case role when 'system' then 'unknown' else text end as t, contains(text, '!') as loud from conversations),
f as (select conv_id, role, min(turn) as m from c group by 1, 2)
select conv_id, arg_min(t, turn) filter (where lower(trim(t)) not in ('', 'unknown', '?')) as t, bool_or(loud) as loud, any_value(r.roles) as roles from c join (select conv_id, string_agg(role, ',' order by m) as roles from f group by 1) r using (conv_id) group by conv_id""")
def context_merge(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", F.array("role").alias("roles"), F.when(F.col("role") == "system", "unknown").otherwise(F.col("text")).alias("t"), F.contains("text", F.lit("!")).alias("loud"))
    return M.merge_context(c, ["conv_id"], "turn", ["t"], ["roles"], ["loud"]).select("conv_id", "t", F.concat_ws(",", "roles").alias("roles"), "loud")


@query("""select conv_id, lower(role) as role, arg_max(text, length(text) * 1000000 - turn) as text, arg_max(substr(text, 1, 10), turn) as state from conversations where substr(text, 1, 10) <> '' group by 1, 2""")
def entity_merge(spark, sf):
    c = _t(spark, sf, "conversations").where(F.substring("text", 1, 10) != "").select("conv_id", "turn", "role", "text", F.substring("text", 1, 10).alias("state"))
    return M.merge_entities(c, ["conv_id"], "role", "turn", ["text"], ["state"], []).select("conv_id", "role", "text", "state")


@query("select conv_id, string_agg(text, ' ' order by turn) as narrative, count(*) as parts from conversations group by 1")
def synthesis_merge(spark, sf):
    rows = _t(spark, sf, "conversations")
    return rows.groupBy("conv_id").agg(M.joined_text(F.col("text"), ["turn"]).alias("narrative"), F.count(F.lit(1)).alias("parts"))


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events where event_type in ('purchase', 'signup'))
select user_id, string_agg(event_id, ',' order by n) as tensions from r where n <= 4 group by 1""")
def ledger_tensions(spark, sf):
    rows = _t(spark, sf, "events").where("event_type in ('purchase', 'signup')")
    items = M.items_in_order(F.col("event_id").cast("string"), ["event_id"])
    return rows.groupBy("user_id").agg(F.concat_ws(",", F.slice(items, 1, 4)).alias("tensions"))


def _scenes(spark, sf):
    return _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderkey") % 30).alias("n"), (F.col("o_orderdate") + F.expr("interval 1 hour")).alias("ended"))


@query("""with s as (select o_custkey, o_orderkey, o_orderkey % 30 as n, epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) over w + interval 1 hour) as gap, row_number() over w as r, o_orderdate from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
g as (select *, cast(sum(case when n < 15 and (gap is null or gap <= 864000000000) and r > 1 then 0 else 1 end) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as bigint) - 1 as merged from s)
select o_custkey, merged, cast(sum(n) as bigint) as n, count(*) as scenes from g group by 1, 2""")
def merge_short_scenes(spark, sf):
    merged = M.merge_short_scenes(_scenes(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"], "n", "o_orderdate", "ended")
    return merged.groupBy("o_custkey", "merged").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("scenes"))


@query("""with g as (select o_custkey, o_orderkey, epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) + interval 1 hour) as gap from orders)
select o_custkey, o_orderkey, coalesce(gap, 0) as gap_us, gap is not null as has_gap from g""")
def scene_gaps(spark, sf):
    gaps = M.scene_gaps(_scenes(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate", "ended")
    return gaps.select("o_custkey", "o_orderkey", F.coalesce("gap_us", F.lit(0)).alias("gap_us"), F.col("gap_us").isNotNull().alias("has_gap"))


@query("select s_nationkey, coalesce(max(try_cast(regexp_extract(s_name, '([0-9]+)$', 1) as bigint)), -1) + 1 as next_index from supplier group by 1")
def next_index(spark, sf):
    return M.next_index(_t(spark, sf, "supplier"), ["s_nationkey"], "s_name")


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders) select o_custkey, o_orderkey from r where n <= 4")
def recent_scenes(spark, sf):
    items = A.ordered(_t(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey")
    return items.select("o_custkey", F.explode(A.keep_last(F.col("items"), 4)).alias("o_orderkey"))


@query(f"select day, trend from ({_SQL['tension_trend']}) order by trend desc, day limit 1")
def tension_peak(spark, sf):
    return M.peak(tension_trend(spark, sf).select("day", "trend"), "day", "trend")


@query("select p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_concat(string_split(p_type, ' '), string_split(p_name, ' ')), lambda x: lower(x)))), ',') as tags from part")
def priority_union(spark, sf):
    both = M.priority_union(F.split("p_type", " "), F.split("p_name", " "))
    return _t(spark, sf, "part").select("p_partkey", F.concat_ws(",", F.array_sort(both)).alias("tags"))


@query("select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1, 2")
def upsert_latest(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return M.upsert(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), ["user_id", "event_type"], "event_id")


@query("select n_name from nation where contains('what happened in nation_3 and in nation_7?', lower(n_name)) and length(n_name) >= 3")
def names_in_question(spark, sf):
    return H.named_in("What happened in Nation_3 and in NATION_7?", _t(spark, sf, "nation"), "n_name").select("n_name")


@query("""with s as (select l_orderkey, cast(sum(case l_returnflag when 'R' then 30 when 'A' then 10 else 5 end) as bigint) + 4 * count(*) + 3 * count(distinct l_suppkey) as score from lineitem group by 1)
select l_orderkey, score, row_number() over (order by score desc, l_orderkey) as rank from s order by rank limit 15""")
def scene_importance(spark, sf):
    flag = F.col("l_returnflag")
    own = F.sum(F.when(flag == "R", 30).when(flag == "A", 10).otherwise(5)) + 4 * F.count(F.lit(1)) + 3 * F.count_distinct("l_suppkey")
    scored = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(own.alias("s"))
    return A.top_scores(scored, "l_orderkey", F.col("s"))


@query(f"with p as ({_SQL['power_score']}) select l_suppkey, power, case when power > 0.6::double * (select max(power) from p)::double then 'high' when power > 0.3::double * (select max(power) from p)::double then 'medium' else 'low' end as tier from p")
def power_tiers(spark, sf):
    return H.power_tiers(power_score(spark, sf), "power")


@query("select l_suppkey % 40 as source, l_partkey % 40 as target, cast(sum(case l_returnflag when 'A' then 2 when 'R' then 1 end) as bigint) as weight from lineitem where l_returnflag in ('A', 'R') group by 1, 2")
def influence_edges(spark, sf):
    flag = F.col("l_returnflag")
    rows = _t(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("source"), (F.col("l_partkey") % 40).alias("target"), "l_returnflag")
    return H.influence(rows, "source", "target", F.when(flag == "A", 2).when(flag == "R", 1).otherwise(-1))


@query("""with r as (select c_nationkey, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as n from customer)
select c_nationkey, c_custkey, c_acctbal from r where n <= 3 order by c_acctbal desc, c_custkey limit 10""")
def topk_per_category(spark, sf):
    return H.top_per_category(_t(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_acctbal", "c_custkey", 3, 10)


def _story(spark, sf):
    lines = _t(spark, sf, "lineitem")
    events = lines.select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("kind"))
    return events, lines.select(F.col("l_orderkey").alias("scene"), F.col("l_suppkey").alias("who"))


@query("select l_orderkey as scene, l_linenumber as pos, l_returnflag as kind from lineitem where l_returnflag in ('A', 'R') and l_orderkey in (select l_orderkey from lineitem where l_suppkey = 1) order by 1, 2, 3 limit 12")
def goals(spark, sf):
    return H.own_events(*_story(spark, sf), 1, ["A", "R"])


@query("""with e as (select l_orderkey as scene, l_linenumber as pos, l_returnflag as kind, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag) as n, l_orderkey in (select l_orderkey from lineitem where l_suppkey = 1) as seen from lineitem),
s as (select * from e where seen and n <= 3 order by scene, pos, kind limit 20), m as (select * from e where not seen and n <= 2 order by scene, pos, kind limit 15)
select scene, pos, kind, seen from s union all select scene, pos, kind, seen from m""")
def catch_up(spark, sf):
    return H.catch_up(*_story(spark, sf), 1)


@query("select l_orderkey as scene, substr(string_agg(l_returnflag, '' order by l_linenumber, l_returnflag), 1, 100) as state from lineitem group by 1 having bool_or(l_suppkey = 1)")
def character_arc(spark, sf):
    events, members = _story(spark, sf)
    return H.character_arc(events.groupBy("scene").agg(M.joined_text(F.col("kind"), ["pos"], "").alias("state")), members, 1, "state")


@query(r"select conv_id, turn from conversations where regexp_matches(lower(text), '\b(the|der|les|una)\b') order by conv_id, turn limit 25")
def missing_references(spark, sf):
    return H.references(_t(spark, sf, "conversations"), ["conv_id", "turn"], "text", r"\b(the|der|les|una)\b").select("conv_id", "turn")


@query("select max(doc_id) as scene from documents where doc_id not in (select doc_id from labels)")
def latest_unconfirmed(spark, sf):
    scene = F.col("doc_id").alias("scene")
    return H.latest_unconfirmed(_t(spark, sf, "documents").select(scene), _t(spark, sf, "labels").select(scene))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def unprocessed(spark, sf):
    done = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return H.unprocessed(_t(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])
