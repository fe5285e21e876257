"""What a page gives is worked out once, in slices, and kept from being repeated by the optimizer."""

import pyarrow as pa
import pytest


def test_settled_columns_are_worked_out_once(spark):
    """Filters on what a page gave don't reach below the search of the page, whose expressions would be repeated for each of them."""
    from pyspark.sql import functions as F

    from hearthline.functions.patterns import settled

    df = spark.createDataFrame([("a1", 1), (None, 2), ("b22", 3)], "s string, n int")
    out = settled(df, d=F.regexp_extract("s", r"(\d+)", 1), n=F.col("n") + 1)
    assert sorted(map(tuple, out.where("d <> '' and d is not null and n > 1").select("s", "d", "n").collect())) == [("a1", "1", 2), ("b22", "22", 4)]
    plan = out.where("d <> '' and length(d) > 0 and d is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


@pytest.mark.parametrize("source", ["properati", "century21", "mitula", "elpaisfincaraiz", "arriendo", "inmoalfaguara", "ciencuadras"])
def test_pages_are_searched_once(spark, source):
    """No filter of a source's listings holds the patterns that search its pages: the plan stays short."""
    from hearthline.plans.source_queries import PAYLOADS
    from hearthline.schemas import SNAPSHOT
    from hearthline.sources import registry

    normalize = next(s.normalize for s in registry.SOURCES if s.id == source)
    plan = normalize(PAYLOADS[source](spark.createDataFrame([], SNAPSHOT)))._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if x.lstrip(" :+-").startswith(("Filter", "Join"))]
    assert all(len(x) < 4000 for x in filters), [len(x) for x in filters]


def test_meta_tags_read_once(spark):
    """Of a page of many tags, the first of a name, a property, and one without either."""
    from pyspark.sql import functions as F

    from hearthline.operators.extract import meta_tags

    body = '<meta content="7" name="a"><meta content="no"><meta name=\'b\' content=\'x &amp; y\'><meta property="a" content="8"><meta name="c">'
    df = spark.createDataFrame([(body,), ("",), (None,)], "body string")
    m = meta_tags(F.col("body"))
    assert [r.m for r in df.select(m.alias("m")).collect()] == [{"a": "7", "b": "x & y", "c": ""}, {}, None]
    assert str(df.select(m.alias("m"))._jdf.queryExecution().optimizedPlan()).count("regexp_extract_all") == 1


def test_finds_of_a_slice_of_pages(spark, monkeypatch):
    """A worker holds the finds of so many pages at a time, however long a batch is."""
    from hearthline.operators import extract

    seen = []

    class Batch:
        num_rows, columns = 300, []

        def slice(self, at, n):
            seen.append(n)
            return pa.RecordBatch.from_arrays([pa.array(["u"] * min(n, 300 - at)), pa.array(["b"] * min(n, 300 - at))], ["url", "body"])

    held = {}
    frame = spark.createDataFrame([("u", "b")], "url string, body string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: held.setdefault("f", f))
    extract.map_items(frame, lambda body: [body], "string", ("url",))
    rows = [b.num_rows for b in held["f"](iter([Batch()]))]
    assert sum(rows) == 300 and max(rows) <= 128
