r"""Queries of vector search for many questions and of sheets, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sheets
from ..operators import search
from .catalogue import _t, query

_NEAR = """q as (select vec_id as question, embedding::double[] as e, (vec_id // 50 + 1) % 3 as c from embeddings where vec_id % 50 = 0),
s as (select question, vec_id as key, round(list_cosine_similarity(q.e, v.embedding::double[]), 9) as score, c as qc, vec_id % 3 as vc from q, embeddings v)"""


@query(f"""with {_NEAR}, r as (select *, row_number() over (partition by question order by score desc, key) - 1 as place from s where qc = 0 or qc = vc)
select question, key, round(score, 6) as score, place from r where place < 5""")
def nearest_rows(spark, sf):
    v = _t(spark, sf, "embeddings").withColumn("category", (F.col("vec_id") % 3).cast("string"))
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), "embedding", F.nullif(((F.floor(F.col("vec_id") / 50) + 1) % 3).cast("string"), F.lit("0")).alias("category"))
    found = search.nearest(asked, "question", v, "vec_id", "embedding", 5, "category", block_bytes=4_000)
    return found.select("question", "key", F.round("score", 6).alias("score"), "place")


_SHEET = r"""l as (select l_suppkey as s, l_orderkey as o, l_linenumber as n, l_partkey as p, l_returnflag as r, l_linestatus as t from lineitem),
apps as (select s, list(o::varchar order by o) as a from (select distinct s, o from l) group by s),
c as (select s_suppkey as s, lower(s_name) as name, case when s_suppkey % 3 <> 0 then n_name else '' end as job, coalesce(a, []) as a from supplier join nation on n_nationkey = s_nationkey left join apps on apps.s = s_suppkey)"""


@query(rf"""with {_SHEET}, x as (select s, a, unnest(a[:20]) as o, unnest(range(1, len(a[:20]) + 1)) as i from c),
lines as (select s, '## Scene appearances (' || any_value(len(a)) || ')' || chr(10) || string_agg('- `' || o || '`' || case when o_orderpriority like '5%' then '' else ': ' || o_orderpriority end, chr(10) order by i) || case when any_value(len(a)) > 20 then chr(10) || '- _... ' || (any_value(len(a)) - 20) || ' more_' else '' end || chr(10) as t from x join orders on o_orderkey::varchar = o group by s),
rel as (select lower(a.s_name) as f, lower(b.s_name) as g, (o, p, n) as at_, r || ' (' || t || ')' as told from l join supplier a on a.s_suppkey = l.s join supplier b on b.s_suppkey = l.p % 7 + 1),
ends as (select distinct f as who, f, g, g as other, at_, told from rel union select g, f, g, f, at_, told from rel where f <> g),
last_ as (select who, other, arg_max(told, (at_, told)) as told from ends group by 1, 2),
related as (select who, '## Relations' || chr(10) || string_agg('- **' || other || '**: ' || told, chr(10) order by other) || chr(10) as t from last_ group by who)
select replace(name, ' ', '_') as slug, md5(concat_ws(chr(10), '# ' || upper(name[1]) || name[2:] || chr(10), concat_ws(chr(10), '## Identity', '**Role:** ' || nullif(job, ''), ''), related.t, lines.t, '_First appearance: ' || coalesce(a[1], '?') || '_')) as digest
from c left join lines using (s) left join related on related.who = c.name""")
def character_sheets(spark, sf):
    l, supplier = _t(spark, sf, "lineitem"), _t(spark, sf, "supplier")
    none = F.array().cast("array<string>")
    apps = l.select("l_suppkey", "l_orderkey").distinct().groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list("l_orderkey")), lambda o: o.cast("string")).alias("appearances"))
    nation = F.broadcast(_t(spark, sf, "nation"))
    who = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).join(apps, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        F.lower("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("n_name")).otherwise("").alias("job"), F.lit("").alias("author"), none.alias("appellations"), F.lit(None).cast("string").alias("description_physical"),
        F.lit("").alias("description_psychological"), none.alias("beliefs"), none.alias("main_locations"), F.coalesce("appearances", none).alias("appearances"))
    ends = lambda c: supplier.select(F.col("s_suppkey").alias(f"_{c}"), F.col("s_name").alias(c))
    relations = l.withColumns({"_from_char": F.col("l_suppkey"), "_to_char": F.col("l_partkey") % 7 + 1}).join(ends("from_char"), "_from_char").join(ends("to_char"), "_to_char").select(
        F.col("l_orderkey").alias("scene"), F.struct("l_partkey", "l_linenumber").alias("pos"), "from_char", "to_char", F.col("l_returnflag").alias("relation_type"), F.col("l_linestatus").alias("sentiment"))
    summaries = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("scene"), F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")).alias("summary"))
    return sheets.character_sheets(who, relations, summaries).select("slug", F.md5("sheet").alias("digest"))


_LORE = r"""s as (select s_suppkey as k, s_name as name, r_name as region from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where s_suppkey < 60),
ent as (select 'characters' as category, name, 'P:' || name as profile, k from s union all select 'places', r_name, 'R:' || r_name, -1 - r_regionkey from region),
app as (select distinct l_suppkey as k, l_orderkey as scene from lineitem where l_suppkey < 60),
q as (select k as question_id, case when k % 3 = 0 then 'Where is ' || upper(name) || ' of ' || region || '?' when k % 3 = 1 then 'And ' || lower(region) || '?' else 'Whatever' end as question from s where k < 30),
hit as (select question_id, category, name, profile, ent.k from q join ent on contains(lower(question), lower(name))),
rel as (select l_orderkey as scene, (l_partkey, l_linenumber) as pos, a.name as f, b.name as t, l_returnflag as r, l_linestatus as st from lineitem join s a on a.k = l_suppkey join s b on b.k = l_partkey % 60),
rn as (select *, row_number() over (partition by question_id order by scene, pos) as n from (select distinct question_id, scene, pos, lower(f) as f, lower(t) as t, r, st from rel join hit on category = 'characters' and (f = name or t = name))),
p1 as (select question_id, string_agg(profile, chr(10) || chr(10) order by category, name) as part from hit group by 1),
p2 as (select question_id, '[CHARACTER RELATIONS]' || chr(10) || string_agg('  ' || f || ' → ' || t || ' (' || r || ', ' || st || '): ', chr(10) order by scene, pos) as part from rn where n <= 15 group by 1),
sn as (select question_id, scene, row_number() over (partition by question_id order by scene) as n from (select distinct question_id, scene from hit join app using (k))),
p3 as (select question_id, '[RELEVANT SCENES]' || chr(10) || string_agg('card ' || scene, chr(10) || chr(10) order by scene) as part from sn where n <= 8 group by 1),
late as (select '[RECENT NARRATIVE CONTEXT]' || chr(10) || string_agg('- ' || scene || ': x', chr(10) order by scene) as part from (select o_orderkey as scene from orders order by 1 desc limit 8))"""


@query(rf"""with {_LORE} select q.question_id, case when question_id % 3 = 2 then 'entity' when question like 'And%' then 'and' else 'where' end as intent,
md5(coalesce(nullif(concat_ws(chr(10) || chr(10), p1.part, p2.part, p3.part), ''), late.part)) as context from q left join p1 using (question_id) left join p2 using (question_id) left join p3 using (question_id), late""")
def question_contexts(spark, sf):
    """Questions routed by a table of patterns, each with the context of whoever it names."""
    from ..operators import questions as Q

    regions, nations = _t(spark, sf, "region"), _t(spark, sf, "nation")
    who = _t(spark, sf, "supplier").where("s_suppkey < 60").join(F.broadcast(nations), F.col("n_nationkey") == F.col("s_nationkey")).join(F.broadcast(regions), F.col("r_regionkey") == F.col("n_regionkey")).select("s_suppkey", "s_name", "r_name")
    lines = _t(spark, sf, "lineitem")
    apps = lines.where("l_suppkey < 60").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_set("l_orderkey").alias("appearances"))
    none = F.array().cast("array<string>")
    people = who.join(apps, "s_suppkey", "left").select(F.lit("characters").alias("category"), F.col("s_name").alias("name"), none.alias("appellations"), F.concat(F.lit("P:"), "s_name").alias("profile"), "appearances")
    places = regions.select(F.lit("places").alias("category"), F.col("r_name").alias("name"), none.alias("appellations"), F.concat(F.lit("R:"), "r_name").alias("profile"), F.array().cast("array<bigint>").alias("appearances"))
    ends = lambda key, c: who.select(F.col("s_suppkey").alias(key), F.col("s_name").alias(c))
    relations = lines.withColumns({"_a": F.col("l_suppkey"), "_b": F.col("l_partkey") % 60}).join(ends("_a", "from_char"), "_a").join(ends("_b", "to_char"), "_b").select(
        F.col("l_orderkey").alias("scene"), F.struct("l_partkey", "l_linenumber").alias("pos"), "from_char", "to_char", F.col("l_returnflag").alias("relation_type"), F.col("l_linestatus").alias("sentiment"), F.lit("").alias("description"))
    axes = spark.createDataFrame([], "place long, name string, summary string, elements array<string>")
    cards = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("scene"), F.concat(F.lit("card "), F.col("o_orderkey").cast("string")).alias("card"), F.lit("x").alias("synthesis"))
    kind = F.col("s_suppkey") % 3
    said = F.when(kind == 0, F.concat(F.lit("Where is "), F.upper("s_name"), F.lit(" of "), "r_name", F.lit("?"))).when(kind == 1, F.concat(F.lit("And "), F.lower("r_name"), F.lit("?"))).otherwise("Whatever")
    asked = who.where("s_suppkey < 30").select(F.col("s_suppkey").alias("question_id"), said.alias("question"))
    intents = Q.intents_of(spark.createDataFrame([(0, "where", r"\bwhere\b"), (1, "and", "^and ")], "place long, intent string, pattern string"))
    about = lambda rows: Q.about_entities(rows, people.union(places), relations, axes, cards)
    found = Q.dispatched(Q.routed(asked, intents), {"entity": about})
    return found.select("question_id", "intent", F.md5("context").alias("context"))
