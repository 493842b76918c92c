"""The query planner, and text functions at their edges."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import tokens as T
from lexmill.plans import ftsquery as Q


@pytest.mark.parametrize("said, cleaned", [(' "GDPR" (Article) 6* ', "GDPR Article 6*"), ("control*", "control*"), ("a*b", "a b"), ('"a b" AND (c)', '"a b" AND (c)'), ("{x}:[y]^~", "x y"), ("§", "§")])
def test_sanitize(spark, said, cleaned):
    assert Q.sanitize(said) == cleaned
    assert spark.range(1).select(X.sanitized(F.lit(said))).first()[0] == cleaned


def test_variants():
    assert Q.variants("") == [] and Q.variants("x") == ["x"] and Q.variants("adat") == ["adat", "adat*"]
    assert Q.variants("személyes adat") == ['"személyes adat"', "személyes AND adat", "személyes AND adat*", "személy* AND adat", "személyes OR adat"]
    assert Q.like_pattern(" a  b ") == "%a%b%" and Q.like_pattern(" ") == "%"
    assert [Q.clamp(x, 10, 50) for x in (None, 0, 7, 99)] == [10, 1, 7, 50]


def test_parse():
    p = lambda *w, prefix=False: Q.Phrase(w, prefix)
    assert Q.parse("a OR b AND c NOT d e") == Q.Op("or", (p("a"), Q.Op("and", (p("b"), Q.Op("not", (p("c"), Q.Op("and", (p("d"), p("e")))))))))
    assert Q.parse('"Ő ű" + x*') == p("o", "u", "x", prefix=True) and Q.parse("§".join(['"', '"'])) == p()
    for bad in ("NOT a", "a AND", "(a", "a-b", "a)", "", "a,b", "*"):
        with pytest.raises(Q.QuerySyntaxError):
            Q.parse(bad)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_entities_and_markup(spark):
    assert one(spark, X.decode_entities(F.lit("&amp;lt; &#337;&#x151; &shy;&ndash; &#39; &#99999999; &#xD800;"))) == "< őő - ' &#99999999; &#xD800;"
    assert one(spark, X.html_to_text(F.lit('<p>a<br/>b</p> , (  c )<sup class="fnSup">1</sup> d'))) == "a b, (c) d"
    assert one(spark, X.html_to_text_spaced(F.lit("<b>a</b>,<i>b</i>"))) == "a , b"


def test_tokens_and_snippets(spark):
    assert one(spark, T.tokens(F.lit("Személyes ADATOK, §37/A ßø"))) == ["szemelyes", "adatok", "37", "a", "ßø"]
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []
    long = " ".join(f"w{i}" for i in range(100))
    rows = spark.createDataFrame([(1, "One, two three."), (2, long), (3, None), (4, "")], "id int, t string")
    got = {r["id"]: r["s"] for r in T.with_snippet(rows, "t", [(("two", "three"), False), (("w60",), False)], "s").collect()}
    assert got[1] == "One, >>>two<<< >>>three<<<." and got[4] == "" and got[3] is None
    assert got[2].startswith("...>>>w60<<< w61") and got[2].endswith("w91...")
    assert T.with_snippet(rows, "t", [], "s").where("id = 2").first()["s"].startswith("w0 w1")


def test_identity(spark):
    assert one(spark, X.roman_to_arabic(F.lit("mcmxcix"))) == 1999 and one(spark, X.roman_to_arabic(F.lit(""))) == 0
    assert one(spark, X.formal_ref_to_id(F.lit("A 2012. évi CXII. Törvény"))) == "hu-law-2012-112-00-00"
    assert one(spark, X.stem(F.lit("hasták"))) is None and one(spark, X.stem(F.lit("running"))) == "runn"
    assert one(spark, X.two_digit_year(F.lit("49"))) == 2049 and one(spark, X.two_digit_year(F.lit("883"))) == 883
    assert one(spark, X.age_days(F.lit("no"), F.lit("2020-01-01").cast("timestamp"))) is None
