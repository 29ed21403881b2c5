from pyspark.sql import functions as F

from skald.operators import records as R


def _one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def _array(*items):
    return F.array(*(F.lit(x) for x in items)).cast("array<string>")


def test_names_and_authors(spark):
    authors = _array("Yaya", "Bob")
    played = F.create_map(F.lit("yaya"), F.lit("Lena"), F.lit("Zed"), F.lit("Gaul"), F.lit("Bob"), F.lit("LENA"))
    r = _one(
        spark, spoken=R.spoken_names(_array("Lena", " elle ", None, "", "bob", "The Red"), authors), a=R.is_character(F.lit("Bob"), F.lit(""), authors), b=R.is_character(F.lit("Lena"), F.lit("Zed"), authors),
        c=R.is_character(F.lit("Lena"), F.lit("yaya"), authors), d=R.filled_author(F.lit("lena "), F.lit(""), played, authors), e=R.filled_author(F.lit("Gaul"), F.lit(None).cast("string"), played, authors), f=R.filled_author(F.lit("x"), F.lit("Q"), played, authors),
        g=R.is_named(F.lit(" Unknown man")), h=R.is_synthesis_name(F.lit("Elle")), i=R.is_synthesis_name(F.lit("a b" * 11)), j=R.is_synthesis_name(F.lit("Lena")),
    )
    assert (r.spoken, r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j) == (["Lena", "The Red"], False, False, True, "Bob", "", "Q", False, False, False, True)


def test_presence_and_lists(spark):
    none = F.array().cast("array<string>")
    relations = F.array(*(F.struct(F.lit(a).cast("string").alias("character"), F.lit(b).cast("string").alias("relation")) for a, b in (("Lena", "Ally"), ("lena", "ally"), (None, "x"), ("Bob", None))))
    r = _one(
        spark, a=R.present_only(_array("Lena", "Bob"), _array("LENA")), b=R.present_only(_array("Lena", "Bob"), none), c=R.both_present(F.lit("a"), F.lit("b"), none), d=R.both_present(F.lit("a"), F.lit("b"), _array("A")),
        e=R.related_pairs(relations), f=R.overlap(_array("a", None), _array("A ")), g=R.covers(_array("a", "b"), _array("B")), h=R.covers(_array("a"), _array("B")), i=R.manual_first(_array("m"), _array("x", None)),
        j=R.question_terms(F.lit("What did Lena do in Paris?"), _array("lena", "go")), k=R.question_terms(F.lit("What about Paris?"), _array("lena")), m=R.matches_terms(R.names_of(F.lit("Lena Marchal"), _array("Red")), _array("lena", "xx")),
    )
    assert r.a == ["Lena"] and r.b == ["Lena", "Bob"] and r.c and not r.d and [tuple(x) for x in r.e] == [("lena", "ally"), ("bob", "")]
    assert r.f and r.g and not r.h and r.i == ["m", "x"] and r.j == ["lena"] and r.k == ["what", "paris"] and r.m


def test_elected_names(spark):
    rows = [(1, "lena", 0), (1, "lena marchal", 1), (1, "lena marchal (young)", 2), (2, "go (a)", 3), (2, "gaul (bb)", 4), (3, "abc", 5), (3, "xyz", 6), (4, "red", 7), (4, "the red one", 8)]
    members = spark.createDataFrame(rows, "r int, n string, p int")
    anchors = spark.createDataFrame([("RED", "Red Lena")], "alias string, canonical string")
    assert {x.root: x.canonical for x in R.elect_names(members, "r", "n", "p", anchors).collect()} == {1: "lena marchal", 2: "gaul (bb)", 3: "abc", 4: "Red Lena"}
    assert {x.root: x.canonical for x in R.elect_names(members, "r", "n", "p").collect()}[4] == "the red one"


def test_voice_lines(spark):
    rows = [(0, 'Lena *lena draws her sword* says "go" and *runs* now'), (1, "nobody"), (2, None), (3, "for marchal only")]
    got = R.voice_lines(spark.createDataFrame(rows, "pos int, t string").withColumn("name", F.lit("Lena Marchal")), [], "pos", "t", "name").orderBy("pos", "n").collect()
    assert [(r.pos, r.line) for r in got] == [(0, "*lena draws her sword*"), (0, '"go"'), (0, "Lena  says  and  now"), (3, "for marchal only")]
