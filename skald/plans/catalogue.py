"""All queries over the test tables, and the same in DuckDB SQL.

The tables hold no chat lore, so each operator is bound to columns that have
the same shape: users' events for messages, orders' lines for scenes' casts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.documents import dataset_triples, lore_counts
from ..operators import analytics as A
from ..operators import router, sessions, text

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_SESSION_SQL = """
with m as (select user_id, event_id, {ts} as ts from events),
g as (select *, last_value(ts ignore nulls) over (partition by user_id order by ts nulls first, event_id rows between unbounded preceding and 1 preceding) as prev from m),
s as (select *, sum(case when epoch_us(ts) - epoch_us(prev) > {gap} then 1 else 0 end) over (partition by user_id order by ts nulls first, event_id rows unbounded preceding) as session from g),
a as (select user_id, session, count(*) as n, min(ts) as start_ts, max(ts) as end_ts from s group by all having count(*) >= {least})
select user_id, n, start_ts, end_ts, row_number() over (partition by user_id order by session) - 1 as scene from a"""


@query(_SESSION_SQL.format(ts="ts", gap="43200000000", least=5))
def gap_sessions(spark, sf):
    return sessions.gap_sessions(_t(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", 12 * 3600, 5)


@query(_SESSION_SQL.format(ts="case when event_id % 17 = 0 then null else ts end", gap="21600000000", least=3))
def gap_sessions_nullsafe(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("ts"))
    return sessions.gap_sessions(rows, ["user_id"], "ts", "event_id", 6 * 3600, 3)


@query(r"""with c as (select doc_id, trim(text, E' \t\n\r') as t, trim(regexp_replace(regexp_replace(regexp_replace(text, '<@!?[0-9]+>', '', 'g'), '<:[\p{L}\p{N}_]+:[0-9]+>', '', 'g'), 'https?://[^ \t\n\r]+', '', 'g'), E' \t\n\r') as k from documents)
select doc_id, (t = '' or regexp_matches(t, '^[-_*=~]{2,}[ \t\n\r]*$') or regexp_matches(t, '^>[ \t\n\r]+') or regexp_matches(t, '^\[[^\n]{0,60}?[0-9]{4}[^\n]{0,30}?\]') or regexp_matches(t, '^\[[^\n]{0,30}?[0-9]{1,2}[/.][0-9]{1,2}[/.]')
  or regexp_matches(t, '^\[[^\n]{0,30}?[0-9]{1,2}:[0-9]{2}') or not regexp_matches(k, '[a-zA-ZÀ-ÿ0-9]{2,}')) as dropped from c""")
def drop_rules(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.drop_message(F.col("text")).alias("dropped"))


@query("""with s as (select conv_id, avg(case when role = 'assistant' then 1.0 else 0.0 end) as narrative, avg(length(text)) as len, bool_or(contains(text, ',')) as quotes, avg(case when role = 'system' then 1.0 else 0.0 end) as ooc, avg(case when contains(text, '!') then 1.0 else 0.0 end) as meta from conversations group by conv_id)
select conv_id, round(least(1.0, greatest(0.0, (case when narrative >= .4 then .55 when narrative >= .15 then .35 when narrative >= .05 then .15 else 0 end) + (case when len >= 120 then .25 when len >= 60 then .15 when len >= 30 then .05 else 0 end) + (case when quotes then .1 else 0 end) - (case when ooc >= .5 then .4 when ooc >= .25 then .2 when ooc >= .1 then .05 else 0 end) - (case when meta >= .3 and ooc >= .15 then .35 when meta >= .2 then .15 when meta >= .1 then .05 else 0 end)))::double, 3) as score from s""")
def quality_score(spark, sf):
    share = lambda c: F.avg(c.cast("int"))
    s = _t(spark, sf, "conversations").groupBy("conv_id").agg(
        share(F.col("role") == "assistant").alias("narrative"), F.avg(F.length("text")).alias("len"), F.bool_or(F.contains("text", F.lit(","))).alias("quotes"),
        share(F.col("role") == "system").alias("ooc"), share(F.contains("text", F.lit("!"))).alias("meta"))
    return s.select("conv_id", text.quality_score(*(F.col(c) for c in ("narrative", "len", "quotes", "ooc", "meta"))).alias("score"))


@query("""with p as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as pos, count(*) over (partition by user_id) as n from events),
c as (select *, case when n <= 40 then 1 else cast(ceil((n - 40) / 35.0) as bigint) + 1 end as chunks from p)
select user_id, event_id, pos, k.chunk from c, (select unnest(generate_series(0, 20000)) as chunk) k where k.chunk < chunks and 35 * k.chunk <= pos and pos < 35 * k.chunk + 40""")
def chunk_overlap(spark, sf):
    return sessions.overlapping_chunks(_t(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("""with b as (select *, min(case when role <> 'system' and length(text) >= 80 then turn end) over (partition by conv_id) as lo, max(case when role <> 'system' and length(text) >= 80 then turn end) over (partition by conv_id) as hi from conversations)
select conv_id, turn, role from b where lo is null or turn between lo and hi""")
def trim_edges(spark, sf):
    inner = (F.col("role") != "system") & (F.length("text") >= 80)
    return sessions.trim_edges(_t(spark, sf, "conversations"), ["conv_id"], "turn", inner).select("conv_id", "turn", "role")


@query("select conv_id, coalesce(min(case when role = 'assistant' and length(text) >= 100 then turn end), -1) as anchor from conversations group by conv_id")
def prefix_anchor(spark, sf):
    return sessions.first_anchor(_t(spark, sf, "conversations"), ["conv_id"], "turn", (F.col("role") == "assistant") & (F.length("text") >= 100)).select("conv_id", F.coalesce("anchor", F.lit(-1)).alias("anchor"))


@query("""with d as (select l_orderkey as scene, l_linenumber as pos, l_suppkey % 10 as word from lineitem), p as (select distinct scene + 1 as scene, word from d),
m as (select d.*, p.word is not null as dup from d left join p using (scene, word)), c as (select *, least(coalesce(min(case when not dup then pos end) over (partition by scene), 10), 10) as cut from m)
select scene, pos, word from c where pos >= cut""")
def dup_opening(spark, sf):
    d = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 10).alias("word"))
    previous = d.select((F.col("scene") + 1).alias("scene"), "word")
    return sessions.duplicate_opening(d, ["scene"], "pos", "word", previous).select("scene", "pos", "word")


@query("select user_id, event_id, (row_number() over (partition by user_id order by event_id) - 1) // 20 as batch from events")
def batch_ids(spark, sf):
    return sessions.batch_ids(_t(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("""with b as (select user_id, event_id, case when row_number() over (partition by user_id order by event_id) = 1 then 0 when event_type = 'signup' then 1 else 0 end as b from events)
select user_id, event_id, cast(sum(b) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as segment from b""")
def boundaries_to_segments(spark, sf):
    return sessions.segments(_t(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type") == "signup").select("user_id", "event_id", "segment")


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate nulls first, o_orderkey) - 1 as scene from orders")
def scene_renumber(spark, sf):
    return sessions.renumber(_t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("select o_custkey, o_orderkey, lag(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous from orders")
def prev_group_lookup(spark, sf):
    return sessions.previous_of(_t(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority").select("o_custkey", "o_orderkey", "previous")


@query("""with l as (select distinct l_orderkey as o, l_partkey as p from lineitem), j as (select distinct a.o, b.o as before from l a join l b on a.p = b.p and b.o < a.o),
r as (select *, row_number() over (partition by o order by before desc) as back from j) select o, before, back from r where back <= 3""")
def last_k_overlap(spark, sf):
    return sessions.last_overlapping(_t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")), "o", "p", 3)


@query("""with r as (select conv_id, role, turn, substr(text, 1, 70) as s, row_number() over (partition by conv_id, role order by turn) as n from conversations)
select conv_id, role, string_agg(s, ' / ' order by turn) as hint from r where n <= 3 group by conv_id, role""")
def author_snippets(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))).where("n <= 3")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 70).alias("s")))), lambda x: x["s"])
    return c.groupBy("conv_id", "role").agg(F.concat_ws(" / ", parts).alias("hint"))


_KIND = "case event_type when 'purchase' then 'revelation' when 'signup' then 'decision' when 'click' then 'emotional' when 'view' then 'action' else 'conversation' end"
_WEIGHTS = "case {k} when 'revelation' then 30 when 'decision' then 20 when 'emotional' then 20 when 'action' then 10 else {d} end"


@query(f"""with s as (select user_id, cast(sum({_WEIGHTS.format(k=_KIND, d=5)}) as bigint) as score from events group by user_id)
select user_id, score, row_number() over (order by score desc, user_id) as rank from s order by rank limit 15""")
def importance_rank(spark, sf):
    return A.top_scores(_t(spark, sf, "events"), "user_id", A.weight(F.expr(_KIND), A.IMPORTANCE, 5))


@query(f"select strftime(ts, '%Y-%m-%d') as day, cast(sum({_WEIGHTS.format(k=_KIND, d=3)}) as bigint) as tension from events group by 1")
def tension_series(spark, sf):
    return _t(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(A.weight(F.expr(_KIND), A.TENSION, 3)).alias("tension"))


@query(f"""with d as (select strftime(ts, '%Y-%m-%d') as day, cast(sum({_WEIGHTS.format(k=_KIND, d=3)}) as bigint) as tension from events group by 1)
select day, tension, sum(tension) over (order by day rows between 1 preceding and 1 following)::double / 3 as trend from d""")
def tension_trend(spark, sf):
    return A.trend(tension_series(spark, sf), "day", "tension", 3)


@query("""with c as (select user_id, hour(ts) // 6 as part, count(*) as n, min(event_id) as f from events group by all), r as (select *, cast(sum(n) over (partition by user_id) as bigint) as total, row_number() over (partition by user_id order by n desc, f, part) as r from c)
select user_id, part, n, total from r where r = 1 and total >= 2 and n >= 0.3 * total""")
def temporal_dominant(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_id", F.floor(F.hour("ts") / 6).cast("long").alias("part"))
    return A.dominant(rows, "user_id", "part", "event_id", least_share=0.3)


@query("""with m as (select p_brand, o_orderkey > (select max(o_orderkey) // 2 from orders) as late from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey where l_quantity > 45),
c as (select p_brand, count(*) filter (not late) as early, count(*) filter (late) as late from m group by 1)
select p_brand, early, late, late / greatest(early::double, 0.5) as ratio from c where early + late >= 2 and late > 0 and late > 1.5 * early order by ratio desc, p_brand limit 10""")
def foreshadow(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey")
    mid = orders.agg(F.expr("max(o_orderkey) div 2").alias("mid"))
    lines = _t(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey")
    rows = lines.join(_t(spark, sf, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey")).crossJoin(F.broadcast(mid))
    return A.rising(rows, "p_brand", F.col("o_orderkey") > F.col("mid"))


@query("select c_nationkey, count(distinct c_mktsegment) as versions from customer group by 1 having count(distinct c_mktsegment) > 1")
def description_drift(spark, sf):
    return _t(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("versions")).where("versions > 1")


@query("select l_partkey, count(*) as n from lineitem group by 1 having count(*) <= 20 order by n, l_partkey limit 5")
def low_usage(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n <= 20").orderBy("n", "l_partkey").limit(5)


_EDGES = "with l as (select distinct l_orderkey as o, l_suppkey as s from lineitem), e as (select x.s as a, y.s as b, count(*) as weight from l x join l y on x.o = y.o and x.s < y.s group by 1, 2) "


def _edges(spark, sf):
    return A.undirected_edges(A.co_occurrence(_t(spark, sf, "lineitem"), "l_orderkey", "l_suppkey"), "a", "b")


@query(_EDGES + "select a, b, weight from e")
def social_edges(spark, sf):
    return _edges(spark, sf)


@query(_EDGES + "select node, count(*) as degree from (select a as node from e union all select b from e) group by node")
def social_degree(spark, sf):
    return A.degrees(_edges(spark, sf))


@query("""select c_custkey, count(distinct s_suppkey) as authors, case when count(distinct s_suppkey) >= 3 then 'NPC' when count(distinct s_suppkey) = 1 then 'PC (likely)' else 'PC/NPC (unclear)' end as role
from customer join supplier on s_nationkey = c_nationkey group by 1""")
def role_heuristic(spark, sf):
    # Customers of a nation meet the same suppliers, so these are counted once for each nation.
    counted = A.roles(_t(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey"), "c_nationkey", "s_suppkey")
    return _t(spark, sf, "customer").select("c_custkey", "c_nationkey").join(counted, "c_nationkey").drop("c_nationkey")


@query("""select l_suppkey, greatest(0, cast(sum(case l_returnflag when 'A' then 2 when 'N' then 1 else -1 end) as bigint)) as power from lineitem group by 1""")
def power_score(spark, sf):
    flag = F.col("l_returnflag")
    w = F.when(flag == "A", 2).when(flag == "N", 1).otherwise(-1)
    return _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.greatest(F.lit(0).cast("long"), F.sum(w)).alias("power"))


@query("""select l_orderkey, l_linenumber, l_suppkey, case l_returnflag when 'A' then 2 when 'N' then 0 else -2 end as score from lineitem where l_suppkey in (1, 2)""")
def pair_evolution(spark, sf):
    flag = F.col("l_returnflag")
    return _t(spark, sf, "lineitem").where(F.col("l_suppkey").isin(1, 2)).select("l_orderkey", "l_linenumber", "l_suppkey", F.when(flag == "A", 2).when(flag == "N", 0).otherwise(-2).alias("score"))


@query("select l_orderkey from lineitem where l_suppkey in (1, 2) group by 1 having count(distinct l_suppkey) = 2")
def combo_division(spark, sf):
    return A.containing_all(_t(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", [1, 2])


@query("select o_orderkey, o_orderkey in (select l_orderkey from lineitem where l_suppkey = 1) as knows from orders where o_orderpriority = '1-URGENT'")
def knows_split(spark, sf):
    own = _t(spark, sf, "lineitem").where("l_suppkey = 1").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("k", F.lit(True))
    return _t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").join(own, "o_orderkey", "left").select("o_orderkey", F.coalesce("k", F.lit(False)).alias("knows"))


@query("""with c as (select r_name, event_type, min(event_id) as f from region, (select distinct event_type, event_id, user_id from events) e where not exists (select 1 from nation where n_regionkey = r_regionkey and n_nationkey = e.user_id % 25) group by 1, 2)
select r_name, event_type, f as first_event from c""")
def irony_pairs(spark, sf):
    # Regions are a handful of rows: each event meets all of them, minus the one it happened in.
    names = _t(spark, sf, "region").select("r_regionkey", "r_name")
    homes = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey")
    events = _t(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 25).alias("k")).join(homes, "k", "left")
    met = events.join(F.broadcast(names), F.col("n_regionkey").isNull() | (F.col("n_regionkey") != F.col("r_regionkey")))
    return met.groupBy("r_name", "event_type").agg(F.min("event_id").alias("first_event"))


@query("select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def pending_queue(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "lang").join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select doc_id from documents where contains(lower(text), 'idiot') or contains(lower(text), 'license') order by doc_id limit 20")
def keyword_events(spark, sf):
    t = F.lower("text")
    return _t(spark, sf, "documents").where(F.contains(t, F.lit("idiot")) | F.contains(t, F.lit("license"))).select("doc_id").orderBy("doc_id").limit(20)


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag in ('R') or (l_suppkey = 1 and l_linestatus = 'O')")
def link_filter_or(spark, sf):
    return _t(spark, sf, "lineitem").where("l_returnflag = 'R' or (l_suppkey = 1 and l_linestatus = 'O')").select("l_orderkey", "l_linenumber")


_PAIRS = """n as (select distinct p_name as x from part where length(p_name) > 0),
p as (select a.x as a, b.x as b from n a join n b on a.x < b.x where (least(length(a.x), length(b.x)) >= 4 and (contains(a.x, b.x) or contains(b.x, a.x))) or levenshtein(a.x, b.x) <= greatest(1, least(length(a.x), length(b.x)) // 5))"""


@query(f"with {_PAIRS} select a, b from p")
def name_similarity(spark, sf):
    return A.name_pairs(_t(spark, sf, "part"), "p_name")


@query(f"with recursive {_PAIRS}, e as (select a, b from p union select b, a from p), r(node, root) as (select a, a from e union select e.b, r.root from r join e on e.a = r.node) select node, min(root) as root from r group by node")
def entity_clusters(spark, sf):
    return A.clusters(A.name_pairs(_t(spark, sf, "part"), "p_name"))


@query("select n_name, r_name as canonical from nation join region on r_regionkey = n_regionkey")
def alias_lookup(spark, sf):
    return _t(spark, sf, "nation").join(F.broadcast(_t(spark, sf, "region")), F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", F.col("r_name").alias("canonical"))


@query("""with f as (select conv_id, lower(role) as role, min(turn) as t from conversations group by 1, 2)
select conv_id, row_number() over (partition by conv_id order by t) - 1 as pos, role from f""")
def ordered_union(spark, sf):
    items = A.ordered(_t(spark, sf, "conversations"), ["conv_id"], ["turn"], "role")
    out = items.select("conv_id", F.posexplode(A.ordered_union(F.col("items"))).alias("pos", "role"))
    return out.select("conv_id", F.col("pos").cast("long").alias("pos"), "role")


@query("""with l as (select user_id, list(floor(value)::bigint % 5 - 2 order by event_id) as axes from events where value is not null group by 1)
select user_id, cast(list_reduce(list_transform(axes, lambda x: x::double), lambda s, x: round_even((s + x) / 2, 0)) as bigint) as axis from l""")
def axes_fold(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_id", (F.floor("value") % 5 - 2).alias("axis"))
    return A.ordered(rows, ["user_id"], ["event_id"], "axis").select("user_id", A.axis_fold(F.col("items")).alias("axis"))


@query("""select o_custkey, arg_max(o_orderpriority, (length(o_orderpriority), -o_orderkey)) as o_orderpriority from orders group by 1""")
def rank_max(spark, sf):
    return A.longest_first(_t(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("select d.doc_id, coalesce(nullif(trim(case when l.quality = 1 then 'good' else '' end), ''), d.lang) as label from documents d left join labels l using (doc_id)")
def manual_override(spark, sf):
    joined = _t(spark, sf, "documents").select("doc_id", "lang").join(_t(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", A.override(F.when(F.col("quality") == 1, "good").otherwise(""), F.col("lang")).alias("label"))


@query("select s_suppkey, substr(concat_ws(' | ', s_name, n_name, r_name), 1, 200) as card from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey")
def summary_cards(spark, sf):
    nation = _t(spark, sf, "nation").join(F.broadcast(_t(spark, sf, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    joined = _t(spark, sf, "supplier").join(F.broadcast(nation), F.col("n_nationkey") == F.col("s_nationkey"))
    return joined.select("s_suppkey", text.card([F.col("s_name"), F.col("n_name"), F.col("r_name")]).alias("card"))


@query("""select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 5) as score from embeddings order by score desc, vec_id limit 20""")
def cosine_topk(spark, sf):
    vectors = _t(spark, sf, "embeddings")
    return A.cosine_top(vectors, vectors.where("vec_id = 0").first()["embedding"], "vec_id", "embedding", 20)


@query("""with s as (select conv_id, turn, regexp_matches(lower(text), 'ing')::int + regexp_matches(lower(text), 'que')::int as a, regexp_matches(lower(text), 'the')::int + regexp_matches(lower(text), 'der')::int as b from conversations)
select conv_id, turn, case when a = 0 and b = 0 then 'entity' when a >= b then 'events' else 'links' end as intent from s""")
def intent_router(spark, sf):
    intents = {"events": ("ing", "que"), "links": ("the", "der")}
    return _t(spark, sf, "conversations").select("conv_id", "turn", router.detect_intent(F.col("text"), intents).alias("intent"))


@query("select event_id, user_id, case when event_id % 2 = 0 then 'a' else 'b' end as source from events")
def merge_exports(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id")
    return e.where("event_id % 2 = 0").withColumn("source", F.lit("a")).unionByName(e.where("event_id % 2 <> 0").withColumn("source", F.lit("b")), allowMissingColumns=True)


@query("""select a.conv_id, a.turn, a.text as user_text, b.text as assistant_text from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'""")
def dataset_pairs(spark, sf):
    return dataset_triples(_t(spark, sf, "conversations"))


@query("select event_type, count(*) as n, count(props) as with_props, cast(sum(length(props)) as bigint) as chars from events group by 1")
def json_props(spark, sf):
    e = _t(spark, sf, "events")
    valid = F.when(F.try_parse_json("props").isNotNull(), F.col("props"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(valid).alias("with_props"), F.sum(F.length(valid).cast("long")).alias("chars"))


@query("select 'customer' as category, count(*) as n from customer union all select 'part', count(*) from part union all select 'supplier', count(*) from supplier")
def lore_stats(spark, sf):
    return lore_counts({name: _t(spark, sf, name) for name in ("customer", "part", "supplier")})
