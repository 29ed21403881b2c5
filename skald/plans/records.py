"""Queries of the record rules, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from .catalogue import _t, query


@query("""with r as (select n_regionkey as root, n_name as name, n_nationkey as place, case when n_name = 'NATION_11' then 'The Eleventh' end as anchor from nation)
select root, coalesce(arg_min(anchor, place) filter (where anchor is not null), arg_max(name, length(name) * 1000 - place)) as canonical from r group by root""")
def canonical_names(spark, sf):
    anchors = spark.createDataFrame([("nation_11", "The Eleventh")], "alias string, canonical string")
    return R.elect_names(_t(spark, sf, "nation"), "n_regionkey", "n_name", "n_nationkey", anchors)


@query("""with e as (select l_suppkey % 40 as a, l_partkey % 40 as b from lineitem), n as (select distinct a as node, b as other from e where a <> b union select distinct b, a from e where a <> b), d as (select node, count(*) as degree from n group by 1)
select node, degree, 300 + 1500 * degree / (select max(degree) from d)::double as size from d""")
def degree_sizes(spark, sf):
    edges = _t(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("a"), (F.col("l_partkey") % 40).alias("b"))
    return R.scaled_degrees(edges, "a", "b")


@query("""select p_partkey, (contains(lower(p_name), 'blue') or contains('blue', lower(p_name)) or contains(lower(p_brand), 'blue') or contains('blue', lower(p_brand)) or contains(lower(p_name), 'brand') or contains('brand', lower(p_name)) or contains(lower(p_brand), 'brand') or contains('brand', lower(p_brand))) as hit from part""")
def terms_in_names(spark, sf):
    hit = R.matches_terms(R.names_of(F.col("p_name"), F.array("p_brand")), F.array(F.lit("Blue "), F.lit("xy"), F.lit("brand")))
    return _t(spark, sf, "part").select("p_partkey", hit.alias("hit"))


@query("select conv_id, turn, role from conversations c where role is not null and not exists (select 1 from (select distinct lower(event_type) as t from events union select 'system') k where k.t = lower(trim(c.role)))")
def concepts_left(spark, sf):
    known = spark.createDataFrame([("System",)], "k string")
    return R.without_known(_t(spark, sf, "conversations").select("conv_id", "turn", "role"), "role", (_t(spark, sf, "events"), "event_type"), (known, "k"))


@query("select l_orderkey, l_linenumber from lineitem where l_suppkey % 5 in (1, 2, 3) and l_partkey % 5 in (1, 2, 3)")
def present_relations(spark, sf):
    end = lambda c: (F.col(c) % 5).cast("string")
    present = F.array(*(F.lit(x) for x in ("1", "2", "3")))
    return _t(spark, sf, "lineitem").where(R.both_present(end("l_suppkey"), end("l_partkey"), present)).select("l_orderkey", "l_linenumber")


@query("""select d.doc_id, case when d.doc_id % 3 = 0 then case when l.doc_id is null then '' when l.quality = 1 then 'good' else 'poor' end else d.lang end as lang, case when l.doc_id is not null and d.source <> 'lore' then d.source || ',lore' else d.source end as tags
from documents d left join labels l using (doc_id)""")
def lore_gap_fill(spark, sf):
    lang = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    docs = _t(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), lang.alias("lang"), F.array("source").alias("tags"))
    lore = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("lang"), F.array(F.lit("lore")).alias("tags"))
    return R.gap_filled(docs, lore, "name", ["lang"], ["tags"]).select("doc_id", "lang", F.array_join("tags", ",").alias("tags"))


@query("select conv_id, string_agg(role, ',' order by role) as authors from (select distinct conv_id, role from conversations where role <> '') group by 1")
def scene_authors(spark, sf):
    return R.authors_of(_t(spark, sf, "conversations"), ["conv_id"], "role").select("conv_id", F.array_join("authors", ",").alias("authors"))


@query("""with r as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by event_id) as n from events)
select user_id, string_agg('- [' || event_type || '] ' || event_id, E'\\n' order by event_type, n) as text from r where n <= 2 group by 1""")
def inconsistency_rollup(spark, sf):
    items = F.slice(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), 1, 2)
    rows = _t(spark, sf, "events").groupBy("user_id", "event_type").agg(items.alias("found"))
    return R.inconsistencies(rows, ["user_id"], "event_type", "found")


@query("select c_custkey, count(*) as scenes from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING' group by 1 having count(*) > 2")
def undescribed(spark, sf):
    seen = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("scenes"))
    about = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("").alias("about"))
    return R.lacking_description(seen.join(about, "c_custkey"), "scenes", "about").select("c_custkey", "scenes")


@query("""with f as (select user_id, event_type, arg_max(event_id, event_id) as last from events group by 1, 2) select user_id, string_agg(event_type || '=' || last, ',' order by event_type) as entries from f group by 1""")
def last_entries(spark, sf):
    made = R.last_wins(_t(spark, sf, "events"), ["user_id"], "event_type", "event_id", ["event_id"])
    pairs = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return made.select("user_id", F.array_join(F.array_sort(pairs), ",").alias("entries"))


@query("""select conv_id, turn, list_filter([split_part(text, ' ', 1), role, 'Moi', 'the', ' Your', 'qui'], lambda x: x <> '' and lower(trim(x)) not in ('moi', 'the', 'your', 'qui', 'system') and lower(trim(x)) not in (
  'le', 'la', 'les', 'un', 'une', 'des', 'du', 'ce', 'que', 'où', 'on', 'he', 'she', 'it', 'this', 'that', 'a', 'an', 'il', 'elle', 'te', 'se', 'dont', 'who', 'one')).array_to_string('|') as names from conversations
  where lower(regexp_extract(text, '^([^ ]+)', 1)) not in ('the', 'of')""")
def spoken(spark, sf):
    c = _t(spark, sf, "conversations").where(~F.lower(F.regexp_extract("text", "^([^ ]+)", 1)).isin("the", "of"))
    names = F.array(F.split_part("text", F.lit(" "), F.lit(1)), F.col("role"), *(F.lit(x) for x in ("Moi", "the", " Your", "qui")))
    return c.select("conv_id", "turn", F.array_join(R.spoken_names(names, F.array(F.lit("System"))), "|").alias("names"))


@query("""with l as (select least(lang, 'fr') as lang, doc_id from documents),
n as (select lower(source) as name, min(doc_id) as k from documents group by 1)
select doc_id, case when doc_id % 4 = 0 then source when doc_id % 4 = 1 then 'Own' when doc_id % 4 = 2 then 'unknown' else source end as job,
case when doc_id % 3 = 0 then 'A|a|' || lang || '|lore' when doc_id % 3 = 1 then 'Lore|' || lang || case when lang = 'en' then '' else '' end || '|a' else lang || '|a|lore' end as tags,
case when doc_id % 5 = 0 then 'lorea' else 'own' end as short from documents""")
def lore_gaps(spark, sf):
    """Empty and unknown fields, list items in other case, repeated lore records, goals."""
    d = _t(spark, sf, "documents")
    kind, third = F.col("doc_id") % 4, F.col("doc_id") % 3
    found = d.select(
        "doc_id", F.upper(F.concat(F.lit("n"), F.col("doc_id").cast("string"))).alias("name"), F.when(kind == 0, F.lit("")).when(kind == 1, F.lit("Own")).otherwise(F.lit("unknown")).alias("job"),
        F.when(third == 0, F.array(F.lit("A"), F.lit("a"))).when(third == 1, F.array(F.lit("Lore"))).otherwise(F.lit(None)).alias("tags"),
        F.when(F.col("doc_id") % 5 != 0, F.array(F.lit("own"))).alias("short"), F.array().cast("array<string>").alias("long"))
    lore = d.select(F.concat(F.lit(" n"), F.col("doc_id").cast("string")).alias("name"), F.when(kind == 2, F.lit("unknown")).otherwise(F.col("source")).alias("job"), F.array("lang", F.lit("a"), F.lit("lore"), F.lit("A")).alias("tags"), F.array(F.lit("lorea")).alias("short"), F.array().cast("array<string>").alias("long"))
    lore = lore.union(lore.withColumn("job", F.concat("job", F.lit("zz"))))
    made = R.gap_filled(found, lore, "name", ["job"], ["tags"], ["short", "long"])
    return made.select("doc_id", "job", F.array_join("tags", "|").alias("tags"), F.array_join("short", "|").alias("short"))


@query("""with recursive n as (select n_nationkey as place, lower(case n_nationkey % 5 when 0 then 'Lena' || n_regionkey when 1 then 'Red (' || n_nationkey || ')' when 2 then 'Smith of ' || n_name when 3 then 'lena' || n_regionkey || ' Marchal' else n_name || ' Rouge' end) as name from nation),
u as (select name, min(place) as place from n group by 1),
k as (select lower(alias) as alias, min(canonical) as canonical from (select 'Lena0' as canonical, unnest(['Lena0', 'red']) as alias union all select 'Old Smith', unnest(['Old Smith', 'smith of nation_2'])) group by 1),
s as (select name, coalesce(a.canonical, b.canonical) as canonical from u left join k a on a.alias = name left join k b on b.alias = trim(regexp_replace(regexp_replace(name, '\\([^)]*\\)', '', 'g'), ' +', ' ', 'g'))),
e as (select x.name as a, y.name as b from u x join u y on x.name <> y.name and ((least(length(x.name), length(y.name)) >= 4 and (contains(x.name, y.name) or contains(y.name, x.name))) or levenshtein(x.name, y.name) <= greatest(1, least(length(x.name), length(y.name)) // 5))
  union select x.name, y.name from s x join s y on lower(x.canonical) = lower(y.canonical)),
r(name, root) as (select name, name from u union select e.b, r.root from r join e on e.a = r.name),
c as (select name, min(root) as root from r group by name),
m as (select c.*, u.place, k.canonical as anchor from c join u using (name) left join k on k.alias = name),
g as (select root, arg_min(anchor, place) filter (where anchor is not null) as anchor, arg_max(name, ((not contains(name, '('))::int, length(trim(regexp_replace(name, '\\([^)]*\\)', '', 'g'))), -place)) as best from m group by root)
select coalesce(anchor, best) as canonical, name from m join g using (root)""".replace("select coalesce(anchor, best)", "select coalesce(g.anchor, best)"))
def anchored_names(spark, sf):
    n = F.element_at(F.array(
        F.concat(F.lit("Lena"), F.col("n_regionkey").cast("string")), F.concat(F.lit("Red ("), F.col("n_nationkey").cast("string"), F.lit(")")), F.concat(F.lit("Smith of "), "n_name"),
        F.concat(F.lit("lena"), F.col("n_regionkey").cast("string"), F.lit(" Marchal")), F.concat("n_name", F.lit(" Rouge"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    names = _t(spark, sf, "nation").select(n.alias("n"), F.col("n_nationkey").alias("place"))
    anchors = spark.createDataFrame([("Lena0", ["red"]), ("Old Smith", ["smith of nation_2"])], "canonical string, aliases array<string>")
    return R.anchored_clusters(names, "n", anchors)
