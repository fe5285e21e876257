import pytest
from pyspark.sql import functions as F

from hearthline.functions import geo, labels, text, urls


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [tuple(r) for r in df.select(*(c.alias(k) for k, c in columns.items())).collect()]


def test_norm(spark):
    got = values(spark, [("  Jardín  ÑAME ",), ("É x﻿",), (None,), ("Ciudad\nJardín",)], "s string", n=text.norm(F.col("s")))
    assert got == [("jardin name",), ("e x",), ("",), ("ciudad jardin",)]
    assert text.norm_text("  Jardín  ÑAME ") == "jardin name"


def test_title_case(spark):
    got = values(spark, [("EL CANEY del-prado",), ("belén",), (None,)], "s string", t=text.title_case(F.col("s")))
    assert got == [("El Caney Del-Prado",), ("Belén",), ("",)]


@pytest.mark.parametrize(("s", "want"), [("$ 1.450.000", 1_450_000.0), ("1.450.000 COP$", 1_450_000.0), ("3,800,000", 3_800_000.0), ("nada", None), ("0", None), (None, None)])
def test_price(spark, s, want):
    assert values(spark, [(s,)], "s string", p=text.price(F.col("s"))) == [(want,)]


def test_area_int_phone(spark):
    rows = [("90 m2", "3 habitaciones", "tel +57 300 123-4567"), ("120,5 m²", "-2", "602 123 4567 x"), ("x", "y", "12"), (None, None, None)]
    got = values(spark, rows, "a string, i string, p string", a=text.area(F.col("a")), i=text.first_int(F.col("i")), p=text.phone(F.col("p")))
    assert got == [(90.0, 3, "3001234567"), (120.5, -2, "6021234567"), (None, None, None), (None, None, None)]


def test_round_half_up(spark):
    assert values(spark, [(-76.5355,), (2.5,), (-2.5,)], "x double", a=text.round_half_up(F.col("x"), 3), b=text.round_half_up(F.col("x"))) == [(-76.535, -77.0), (2.5, 3.0), (-2.5, -2.0)]


def test_overlaps(spark):
    rows = [("El Caney", "caney"), ("sur", "Valle del Sur"), ("", "x"), (None, "x"), ("a", "b")]
    assert values(spark, rows, "a string, b string", o=text.overlaps(F.col("a"), F.col("b"))) == [(True,), (True,), (False,), (False,), (False,)]


def test_distance_and_slack(spark):
    got = values(spark, [(3.4, -76.5, "rooftop"), (4.4, -76.5, None), (None, -76.5, "city"), (float("nan"), 1.0, "what")], "lat double, lng double, p string", km=F.round(geo.haversine_km(F.col("lat"), F.col("lng"), 3.4, -76.5), 1), s=geo.slack_km(F.col("p")))
    assert got == [(0.0, 0.0), (111.2, 4.0), (None, 4.0), (None, 4.0)]


def test_point_and_precision(spark):
    got = values(spark, [("3.4, -76.5",), ("3.4",), ("a,b",), ("1,2,3",), (None,)], "s string", p=geo.point(F.col("s")))
    assert [x and tuple(x) for (x,) in got] == [(3.4, -76.5), None, None, None, None]
    assert values(spark, [("street", "city"), ("city", "rooftop"), ("source", "rooftop")], "a string, b string", c=geo.coarser(F.col("a"), F.col("b"))) == [("city",), ("city",), ("source",)]
    assert values(spark, [("ROOFTOP",), ("APPROXIMATE",), (None,)], "k string", c=geo.precision_of_location_type(F.col("k"))) == [("rooftop",), ("city",), ("city",)]


def test_geocode_query(spark):
    rows = [("Calle 5 # 10", None, None, "Cali"), (None, "Verde", "Pance", "Cali"), (None, None, "Pance", None), (None, None, None, "Cali"), ("x", "y", "z", None)]
    got = values(spark, rows, "a string, k string, b string, c string", q=geo.geocode_query(*(F.col(x) for x in "akbc")))
    assert [x and tuple(x) for (x,) in got] == [("Calle 5 # 10, Cali, Valle del Cauca, Colombia", "street"), ("Verde, Pance, Cali, Valle del Cauca, Colombia", "barrio_centroid"), ("Pance, Colombia", "barrio_centroid"), ("Cali, Valle del Cauca, Colombia", "city"), None]


def test_urls(spark):
    rows = [("https://www.Example.com:80/a?b",), ("http://user@m.example.com",), ("nothing",), (None,), ("https://ñandú.co/x",)]
    assert values(spark, rows, "u string", d=urls.root_domain(F.col("u"))) == [("example.com",), ("m.example.com",), (None,), (None,), ("ñandú.co",)]
    rows = [("https://site.com/x",), ("https://a.site.com/x",), ("https://site.com.evil.org/x",), ("ftp://site.com/x",), ("http://127.0.0.1/x",)]
    assert [bool(x) for (x,) in values(spark, rows, "u string", s=urls.safe_site_url(F.col("u"), "site.com"))] == [True, True, False, False, False]
    rows = [("/l/1",), ("l/1",), ("//x.org/1",), ("https://y.org/",), ("#top",), ("mailto:a@b",), ("",)]
    assert [x for (x,) in values(spark, rows, "h string", a=urls.absolutize(F.col("h"), F.lit("https://b.org/dir/page?x")))] == ["https://b.org/l/1", "https://b.org/dir/l/1", "https://x.org/1", "https://y.org/", None, None, None]


def test_labels(spark):
    assert values(spark, [(1_450_000.4,), (None,), (-3.0,)], "n double", p=labels.pesos(F.col("n"))) == [("$1.450.000",), ("—",), ("$-3",)]
    assert values(spark, [("=1+1",), ("-x",), ("ok",), ("",), (None,)], "s string", c=labels.safe_cell(F.col("s"))) == [("'=1+1",), ("'-x",), ("ok",), ("",), (None,)]
    assert values(spark, [(True, True), (True, None), (None, False)], "s boolean, e boolean", r=labels.review_state(F.col("s"), F.col("e"))) == [("eligible",), ("seen",), ("none",)]
    got = values(spark, [("a", "1", "u1", [("a", "u1"), ("b", "u2"), ("b", None)]), ("a", "2", "", None)], "s string, i string, u string, l array<struct<source:string,url:string>>", k=labels.identity_keys(*(F.col(c) for c in "siul")))
    assert got == [(["u:u1", "u:u2", "s:a:1"],), (["s:a:2"],)]


def test_norm_of_odd_white_space(spark):
    import random

    from hearthline.functions.text import norm, norm_text

    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "É", "ñ", " ", "  ", "\t", "\n", " ", " ", "　", "﻿", "́", "x"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", norm(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [norm_text(r.t) for r in got]
