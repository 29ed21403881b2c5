r"""Queries of nested merges and overrides, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested_merge as N
from ..operators import overrides as O
from ..operators import scene_scores as S
from .catalogue import _t, query

_PART = """p as (select l_suppkey % 60 as s, l_orderkey * 100 + l_partkey % 100 as w, l_returnflag as r, l_linestatus as st, l_partkey as k, l_quantity::int as q from lineitem)"""


def _parts(spark, sf):
    """Lines of an order as partial records of their supplier; (at, k) tells them apart."""
    r, k = F.col("l_returnflag"), F.col("l_partkey")
    item = lambda n: F.concat(F.substring("l_returnflag", 1, 1), (k % n).cast("string"))
    return _t(spark, sf, "lineitem").select(
        F.concat(F.lit(" S"), (F.col("l_suppkey") % 60).cast("string")).alias("canonical_name"), (F.col("l_orderkey") * 100 + k % 100).alias("at"),
        F.repeat(F.lit("d"), (k % 7).cast("int")).alias("description_physical"), F.when(k % 5 == 0, F.lit("Unknown")).when(k % 5 == 1, F.lit("")).otherwise(r).alias("gender"),
        F.array(item(9), F.lower(item(4)), F.lit(None).cast("string"), F.lit("")).alias("likes"), F.array(item(11)).alias("dominant_emotions"),
        F.array(F.struct(item(3).alias("character"), F.col("l_linestatus").alias("relation"))).alias("relations"),
        F.create_map(F.lit("stealth"), F.element_at(F.array(F.lit("low"), F.lit("HIGH"), F.lit(None), F.lit("none"), F.lit("odd")), (k % 5 + 1).cast("int"))).alias("competency_axes"),
    )


_ITEMS = """select s, f, lower(x) as id, min((w, n, x)) as place from (
  select s, w, 'likes' as f, 0 as n, r || k % 9 as x from p union all select s, w, 'likes', 1, lower(r || k % 4) from p union all select s, w, 'emotions', 0, r || k % 11 from p
  union all select s, w, 'relations', 0, lower(r || k % 3) || '>' || lower(st) from p) group by s, f, lower(x)"""


@query(f"""with {_PART}, i as ({_ITEMS}), l as (select s, list(lower(place[3]) order by place) filter (where f = 'likes') as likes, list(lower(place[3]) order by place) filter (where f = 'emotions') as em, list(place[3] order by place) filter (where f = 'relations') as rel from i group by s),
c as (select s, repeat('d', max(k % 7)::int) as description, arg_max(lower(r), (w, r)) filter (where k % 5 > 1) as gender,
  case max(case k % 5 when 1 then 3 when 0 then 1 when 3 then 0 when 4 then 0 end) when 3 then 'high' when 1 then 'low' when 0 then arg_min(case k % 5 when 3 then 'none' else 'odd' end, (w, case k % 5 when 3 then 'none' else 'odd' end)) filter (where k % 5 in (3, 4)) end as stealth from p group by s)
select 's' || s as name, nullif(description, '') as description, gender, array_to_string(likes, ',') as likes, array_to_string(em[greatest(1, len(em) - 4):], ',') as emotions, array_to_string(rel, ',') as relations, stealth from c join l using (s)""")
def merged_characters(spark, sf):
    rules = {k: N.CHARACTER_SCENES[k] for k in ("description_physical", "gender", "likes", "dominant_emotions", "relations", "competency_axes")}
    made = N.merge_records(_parts(spark, sf), "canonical_name", "at", rules)
    pairs = F.transform("relations", lambda r: F.concat_ws(">", r["character"], r["relation"]))
    return made.select(
        F.col("canonical_name").alias("name"), F.col("description_physical").alias("description"), "gender", F.array_join("likes", ",").alias("likes"), F.array_join("dominant_emotions", ",").alias("emotions"),
        F.array_join(pairs, ",").alias("relations"), F.try_element_at("competency_axes", F.lit("stealth")).alias("stealth"),
    )


@query("""with p as (select conv_id % 12 as c, conv_id * 1000 + turn as pl, text from conversations), q as (select c, pl, regexp_extract_all(text, '[A-Za-z]{3,}') as ws, text from p),
i as (select c, min((pl, n, w)) as place from (select c, pl, unnest(ws[1:4]) as w, unnest(range(len(ws[1:4]))) as n from q) group by c, lower(w)),
l as (select c, list(place[3] order by place) as names from i group by c),
d as (select c, arg_min(trim(text), (-length(trim(text)), pl, trim(text))) as description from p group by c)
select 'c' || c as name, md5(description) as description, md5(array_to_string(names, ',')) as names from d left join l using (c)""")
def merged_concepts(spark, sf):
    c = _t(spark, sf, "conversations")
    words = F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})")), 1, 4)
    rows = c.select(F.concat(F.lit("C"), (F.col("conv_id") % 12).cast("string")).alias("canonical_name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.col("text").alias("description"), words.alias("appellations"))
    made = N.merge_records(rows, "canonical_name", "at", {k: N.CONCEPT_CHUNKS[k] for k in ("description", "appellations")})
    return made.select(F.col("canonical_name").alias("name"), F.md5("description").alias("description"), F.md5(F.array_join("appellations", ",")).alias("names"))


_STEPS = """r as (select user_id % 40 as u, event_id as v, case event_id % 6 when 0 then 'goals.short' when 1 then 'goals.long.first' when 2 then 'job' when 3 then 'goals' when 4 then 'job' else 'goals.long' end as path,
  case when event_id % 6 = 4 then case when event_id % 4 = 0 then null else '"x' || event_id || '"' end when event_id % 6 = 3 then '{}' when event_id % 6 = 5 then '{}' else '"v' || event_id || '"' end as value, event_id % 6 = 3 as whole, event_id % 6 = 5 as long from events),
x as (select u, v, path, value from r union all select u, v, 'goals.short', '"s' || v || '"' from r where whole)"""


@query(f"""with {_STEPS}, n as (select u, path, max(v) as v, arg_max_null(value, (v, coalesce(value, ''))) as value from x group by 1, 2),
k as (select n.* from n where not exists (select 1 from n m where m.u = n.u and m.v > n.v and (n.path like m.path || '.%')) and value is not null)
select 's' || u as name, max(value) filter (where path = 'job') as job, max(value) filter (where path = 'goals.short') as short, max(value) filter (where path = 'goals.long.first') as first,
count(*) as n_paths from k group by u""")
def nested_overrides(spark, sf):
    """Events as edits of three levels: values, whole objects that replace what was below, deletions."""
    e = _t(spark, sf, "events")
    kind = F.col("event_id") % 6
    text = lambda p: F.concat(F.lit(f'"{p}'), F.col("event_id").cast("string"), F.lit('"'))
    path = F.element_at(F.array(*(F.lit(p) for p in ("goals.short", "goals.long.first", "job", "goals", "job", "goals.long"))), (kind + 1).cast("int"))
    value = F.when(kind == 4, F.when(F.col("event_id") % 4 != 0, text("x"))).when(kind == 3, F.concat(F.lit('{"short": '), text("s"), F.lit("}"))).when(kind == 5, F.lit("{}")).otherwise(text("v"))
    rows = e.select(F.lit("character").alias("kind"), F.concat(F.lit("S"), (F.col("user_id") % 40).cast("string")).alias("name"), path.alias("path"), value.alias("value"), F.col("event_id").alias("version"))
    table = O.put(spark.createDataFrame([], O.TABLE), rows)
    records = O.laid_over(table)
    quoted = lambda p: F.when(O.value_at(F.col("record"), p).isNotNull(), F.concat(F.lit('"'), O.value_at(F.col("record"), p), F.lit('"'))).alias(p.rsplit(".", 1)[-1])
    counts = O.current(table).groupBy("name").agg(F.count(F.lit(1)).alias("n_paths"))
    return records.join(counts, "name").select("name", quoted("job"), quoted("goals.short"), quoted("goals.long.first"), "n_paths")


_CHRONICLE = """l as (select l_orderkey as o, l_linenumber as n, l_partkey as p, l_suppkey as s, l_returnflag as r, l_linestatus as t from lineitem),
sc as (select o_custkey % 200 as export, o_orderkey as scene, o_orderpriority as pr from orders),
ev as (select o as scene, case p % 6 when 0 then 'revelation' when 1 then 'decision' when 2 then 'emotional' when 3 then 'action' when 4 then 'conversation' else 'odd' end as kind, p % 3 as cast_ from l),
rel as (select o as scene, case s % 4 when 0 then 'Fear' when 1 then 'love' when 2 then 'RIVALRY' end as sentiment from l where r = 'A'),
li as (select o as scene from l where r = 'N')"""


def _chronicle(spark, sf):
    """Orders as scenes, their lines as events, relations and links."""
    lines, p, s = _t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "scene"), F.col("l_partkey"), F.col("l_suppkey")
    pick = lambda xs, k: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % len(xs) + 1).cast("int"))
    events = lines.select("scene", pick(("revelation", "decision", "emotional", "action", "conversation", "odd"), p).alias("type"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (p % 3).cast("int")).alias("characters"))
    relations = lines.where("l_returnflag = 'A'").select("scene", pick(("Fear", "love", "RIVALRY", None), s).alias("sentiment"))
    scenes = _t(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("export"), F.col("o_orderkey").alias("scene"), F.when(F.col("o_orderkey") % 3 != 0, F.array(F.lit("x"), F.lit("y"))).alias("characters"))
    return scenes, events, relations, lines.where("l_returnflag = 'N'").select("scene")


@query(f"""with {_CHRONICLE}, parts as (select scene, case kind when 'revelation' then 30 when 'decision' then 20 when 'emotional' then 20 when 'action' then 10 else 3 end as w from ev union all select scene, 15 from rel where lower(sentiment) in ('fear', 'rivalry') union all select scene, 4 from li union all select scene, 0 from sc),
sums as (select scene, sum(w) / 10 as score from parts group by 1),
x as (select export, sc.scene, score, row_number() over (partition by export order by sc.scene) as pos, count(*) over (partition by export) as n from sc join sums on sums.scene = sc.scene),
t as (select a.export, a.scene, any_value(a.score) as score, any_value(a.n) as n, any_value(a.pos) as pos, round(sum(b.score) / greatest(1, any_value(a.n) // 8), 9) as trend from x a join x b on a.export = b.export and b.pos between a.pos - greatest(1, a.n // 8) // 2 and a.pos + (greatest(1, a.n // 8) - 1) // 2 group by a.export, a.scene)
select export, scene, score, round(trend, 6) as trend, n > 2 and row_number() over (partition by export order by trend desc, pos) = 1 as peak from t""")
def tension_curve(spark, sf):
    scenes, events, relations, links = _chronicle(spark, sf)
    scores = S.scene_tension(scenes, ["scene"], events, relations, links).join(scenes.select("export", "scene"), "scene")
    made = S.curve(scores.select("export", "scene", "score"), ["export"], "scene", "score")
    return made.withColumn("trend", F.round("trend", 6))


@query(f"""with {_CHRONICLE}, parts as (select scene, case kind when 'revelation' then 30 when 'decision' then 20 when 'emotional' then 20 when 'action' then 10 else 5 end + 3 * cast_ as w from ev union all select scene, 5 from rel union all select scene, 4 from li union all select scene, case when scene % 3 <> 0 then 6 else 0 end from sc)
select scene, sum(w) / 10 as score from parts group by 1""")
def importance_scores(spark, sf):
    scenes, events, relations, links = _chronicle(spark, sf)
    return S.scene_importance(scenes, ["scene"], events, relations, links)


@query("""select 'c' || s_suppkey as name, greatest(0, case s_suppkey % 5 when 0 then 40 when 1 then 30 when 2 then 20 when 3 then 10 else 0 end + case s_suppkey % 3 when 0 then 20 else 0 end + 5 * (s_suppkey % 5 - 2) - 3 * (s_suppkey % 4)) / 10 as power from supplier""")
def power_scores(spark, sf):
    k = F.col("s_suppkey")
    level = F.element_at(F.array(*(F.lit(x) for x in ("exceptional", "HIGH", "medium", "low", "odd"))), (k % 5 + 1).cast("int"))
    axes = F.create_map(F.lit("leadership"), level, F.lit("magic_power"), F.when(k % 3 == 0, "medium"), F.lit("stealth"), F.lit("high"))
    traits = F.create_map(F.lit("humble_vs_arrogant"), k % 5 - 2, F.lit("conformist_vs_rebel"), k % 4)
    rows = _t(spark, sf, "supplier").select(F.concat(F.lit("C"), k.cast("string")).alias("name"), k.alias("place"), axes.alias("competency_axes"), traits.alias("personality_axes"))
    return S.character_power(rows)
