"""What normalize_all does with many pages: small files, plain pages read without the parser, objects parsed once."""

import random
from functools import partial
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from hearthline.operators import extract
from hearthline.schemas import PAYLOAD
from hearthline.sources import registry, stored


def test_files_of_payloads_are_small(spark, monkeypatch):
    """Pages of a site pack to next to nothing: one file of all is one task's to read and to normalise."""
    monkeypatch.setattr(stored, "FILE_PAGES", 300)
    rows = spark.range(0, 1000, 1, 1).select(F.lit("bienco").alias("source"), F.col("id").cast("string").alias("url"), F.lit("Cali").alias("city"), F.lit(1).alias("page_no"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(200).alias("status"), F.lit("{}").alias("body"))
    routed = registry.route_payloads(spark.createDataFrame(rows.rdd, PAYLOAD))
    counts = [r["count"] for r in routed.groupBy(F.input_file_name()).count().collect()]
    assert sum(counts) == 1000 and max(counts) <= 300


_BITS = [
    "<li>", "</li>", '<li class="a b">', '<div class="card x" data-a="1&amp;2">', "</div>", '<a href="/x?a&b=1">', "</a>", "text ", "a&ntilde;o ", "&amp", "&", "x: 1", "<br>", "<br />", '<span class="k"/>', '<p class="card">', "</p>",
    "<script>", "</script>", '<script type="x">a&amp;b', "<style>", "</style>", "<", ">", '"', "<b a='1'>", "</b>", "<B>", "</ b>", "<!-- c -->", "<!doctype html>", "<?pi?>", "<td>", "<tr>", "</tr>", "<dt>", "</dt>", "<dl>", "</dl>",
    "<title>", "</title>", "<textarea>", "<li a=b>", '<div class="card" class="y">', '<p data-x="<b>">', '<span\n data-b="2" >', "</script >", '<a  href="">', "<x-y>", "é ²", "<li", '<img src="a" class="card" />', "\x85", '<p class="card"id="3">',
]


def test_plain_pages_are_read_as_the_parser_reads_them():
    """On random pages, most of them broken, the tokens of plain pages give what the parser's feed gives."""

    def fed(make, page):
        parser = make()
        parser.feed(page)
        parser.close()
        return parser

    rng, plain = random.Random(3), 0
    for k in range(4000):
        page = '<div class="card">' * (k % 2) + "".join(rng.choice(_BITS[: 24 if k % 3 else None]) for _ in range(rng.randrange(20)))
        assert extract.cards(page, "card") == fed(partial(extract._Cards, "card"), page).cards, page
        items = extract._parsed(extract._Items, page).items
        assert items == fed(extract._Items, page).items, page
        plain += extract._read_plain(extract._Items(), page)
    assert plain > 400


def test_plain_pages_need_no_parser(monkeypatch):
    monkeypatch.setattr(HTMLParser, "feed", lambda *_: pytest.fail("the parser was asked"))
    page = '<div class="card" data-n="1"><a href="/d/5">x</a><script type="t">var a = "b&amp;";</script><p class="t">2 ba&ntilde;os<br></p></div><ul><li><b>Área:</b> 90</li></ul>'
    assert extract.cards(page, "card") == [{"@class": "card", "@data-n": "1", "data-n": "1", "href": "/d/5", ".t": "2 baños", ".card": 'xvar a = "b&amp;";2 baños'}]
    assert extract.labelled_values(page) == {"area": "90"}
    assert extract.cards(None, "card") == [] and extract.labelled_values("") == {}


@pytest.mark.parametrize(("source", "times"), [("metrocuadrado", 1), ("inmobiliariajr", 2), ("naranjoduque", 1)])
def test_objects_are_parsed_once(spark, source, times):
    """No filter or column of a source's listings parses its objects anew (inmobiliariajr: the page, then each object)."""
    normalize = next(s.normalize for s in registry.SOURCES if s.id == source)
    pages = spark.createDataFrame([], PAYLOAD)
    plan = normalize(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == times


@pytest.mark.parametrize("source", ["arriendo", "rentola"])
def test_what_is_not_asked_of_a_page_is_not_searched_for(spark, source):
    """A query for prices alone searches pages for less than one for all columns."""
    normalize = next(s.normalize for s in registry.SOURCES if s.id == source)
    out = normalize(spark.createDataFrame([], PAYLOAD))
    searches = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("<(script|style)")
    assert searches(out.select("price")) < searches(out)


def test_of_a_page_with_escapes_the_graph_is_found(spark):
    """A node is read for its graph where the key is spelled out, or written with escapes; scripts' types come in any case."""
    page = lambda key: f'<SCRIPT type="Application/LD+JSON">{{"{key}":[{{"@type":"House","n":1}}]}}</script>'
    df = spark.createDataFrame([(page("@graph"),), (page("\\u0040graph"),), (page("graph"),), (None,)], "b string")
    assert [r.x for r in df.select(extract.first_node(F.col("b"), "House").alias("x")).collect()] == ['{"@type":"House","n":1}'] * 2 + [None, None]


def test_text_of_pages_with_and_without_scripts_and_references(spark):
    pages = ["<p>a&nbsp;&amp;lt; b</p>", "x<STYLE>y</style><!-- z -->w", "a  b", "<b>1</b>&#39;<script>2</script>", "", None]
    df = spark.createDataFrame([(p,) for p in pages], "b string")
    assert [r.t for r in df.select(extract.strip_tags(F.col("b")).alias("t")).collect()] == ["a &lt; b", "x w", "a b", "1 '", "", None]


def test_titles_of_each_type(spark):
    from hearthline.sources.json_portals import of_type

    df = spark.createDataFrame([("Casa lote",), ("CASA  en Pance",), ("Apartamento",), ("Local",), (None,)], "t string").select(of_type(F.col("t"), "casa"), of_type(F.col("t"), "apartamento"))
    assert [tuple(r) for r in df.collect()] == [(False, False), (True, False), (False, True), (False, False), (False, True)]


def test_pages_of_adverts(spark):
    """Payloads of a page hold its adverts in order, and a page has one payload a city."""
    from hearthline.plans.source_queries import pages_of

    rows = spark.createDataFrame([(str(n), "Cali" if n % 2 else "Palmira") for n in (7, 3, 26, 1, 2)], "source_listing_id string, city string")
    got = sorted((r.page_no, r.city, r.body) for r in pages_of(rows, "x", "source_listing_id", "array_join(items, ' ')").collect())
    assert got == [(0, "Cali", "1 3 7"), (0, "Palmira", "2"), (1, "Palmira", "26")]


def test_catalogue_pages_are_dealt_afresh(spark):
    """Catalogue pages lie in a few files next to many of details: what is cut out of them is as many tasks' work as there are cores."""
    plan = next(s.normalize for s in registry.SOURCES if s.id == "naranjoduque")(spark.createDataFrame([], PAYLOAD))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [url" in plan
