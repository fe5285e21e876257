import random

import pytest
from pyspark.sql import functions as F

from hearthline.operators import dedup, filters, geocode, merge, rank, verify
from hearthline.plans.search import rank as rank_plan
from hearthline.plans.search import search
from hearthline.schemas import violations
from tests.listings import frame, make


def test_dedupe_prefers_phone_and_fills(spark):
    a = make(source="a", source_listing_id="1", price=1_300_000.0, phone=None, estrato=4, lat=3.40001)
    b = make(source="b", source_listing_id="2", price=1_290_000.0, phone="3001112233", estrato=None, has_whatsapp=True, lat=3.40002)
    (row,) = dedup.dedupe(frame(spark, a, b)).collect()
    assert (row.source, row.estrato, row.phone, row.has_whatsapp) == ("b", 4, "3001112233", True)
    assert row.merged_sources == ["a", "b"]
    assert [x.url for x in row.source_links] == [b["url"], a["url"]]


def test_dedupe_edges(spark):
    nowhere = {"lat": None, "lng": None, "barrio": None, "conjunto": ""}
    rows = [make(**nowhere), make(**nowhere), make(lat=None, lng=None, barrio="Pánce"), make(lat=None, lng=None, barrio="pance "), make(price=None), make(price=None), make(area_m2=99.6), make(area_m2=100.4)]
    assert dedup.dedupe(frame(spark, *rows)).count() == 5
    assert dedup.dedupe(frame(spark)).count() == 0


def brute_dedupe(rows):
    groups = {}
    half = lambda x: None if x is None else int((x + 0.5) // 1)
    norm = lambda s: (s or "").lower().strip()
    for r in sorted(rows, key=lambda r: (r["source"], r["source_listing_id"])):
        bucket, area = half(r["price"] / 50000) if r["price"] is not None else None, half(r["area_m2"])
        if r["lat"] is not None:
            key = ("geo", half(r["lat"] * 1000), half(r["lng"] * 1000), bucket, area, r["bedrooms"])
        elif norm(r["barrio"]) or norm(r["conjunto"]):
            key = ("txt", norm(r["barrio"]), norm(r["conjunto"]), bucket, area)
        else:
            key = ("uniq", r["source"], r["source_listing_id"])
        groups.setdefault(key, []).append(r)
    weight = lambda r: 5 * bool(r["phone"]) + 2 * (r["lat"] is not None) + sum(r[c] is not None for c in ("area_m2", "price", "estrato")) + sum(bool(r[c]) for c in ("barrio", "conjunto", "agency"))
    out = []
    for g in groups.values():
        order = sorted(g, key=lambda r: -weight(r))
        base = dict(order[0])
        for other in order[1:]:
            for k, v in other.items():
                if base[k] in (None, "") and v not in (None, ""):
                    base[k] = v
            base["has_whatsapp"] |= other["has_whatsapp"]
        links = list(dict.fromkeys(r["url"] for r in order if r["url"]))
        out.append((base["source_listing_id"], base["phone"], base["estrato"], base["agency"], base["has_whatsapp"], base["title"], tuple(dict.fromkeys(r["source"] for r in g)), tuple(links)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_dedupe_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        make(source=rng.choice("abc"), source_listing_id=f"{i:03}", url=f"u{rng.randrange(60)}" if rng.random() < 0.9 else "", lat=(lat := rng.choice([None, 3.4, 3.401])), lng=lat and -76.5, barrio=rng.choice([None, "", "Pance", "PANCE"]), conjunto=rng.choice([None, "x"]), price=rng.choice([None, 1e6, 1.01e6, 2e6]), area_m2=rng.choice([None, 80.0]), bedrooms=rng.choice([None, 2]), phone=rng.choice([None, "", f"3{i}"]), estrato=rng.choice([None, i % 6 + 1]), agency=rng.choice([None, f"a{i}"]), title=rng.choice([None, f"t{i}"]), has_whatsapp=rng.random() < 0.1)
        for i in range(80)
    ]
    got = [(r.source_listing_id, r.phone or None, r.estrato, r.agency, r.has_whatsapp, r.title, tuple(r.merged_sources), tuple(x.url for x in r.source_links)) for r in dedup.dedupe(frame(spark, *rows)).collect()]
    want = [(a, b or None, *rest) for a, b, *rest in brute_dedupe(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hard_filters(spark):
    rows = [make(area_m2=70.0), make(price=None), make(price=0.0), make(lat=None, lng=None), make(lat=4.5), make(bedrooms=2), make(bedrooms=None), make(price=5e6), make()]
    o = rank.RankOptions(lat=3.4, lng=-76.53, min_bedrooms=3, max_price=4e6, zone_filter=False)
    e = rank.evaluate(frame(spark, *rows), o)
    got = {r.reason: r.n for r in rank.reasons(e).collect()}
    assert got == {"area # < min #": 1, "missing price": 2, "no location / distance": 1, "distance #km > max #km": 1, "bedrooms # < min #": 1, "price # > max #": 1}
    s = rank.stats(e).first()
    assert (s.input, s.kept, s.dropped, s.with_location) == (9, 2, 7, 8)


def test_centroid_tolerance(spark):
    o = rank.RankOptions(lat=3.4, lng=-76.53, max_km=10, zone_filter=False)
    far = 3.4 + 10.5 / 111.195
    e = rank.evaluate(frame(spark, make(lat=far, geocode_precision="barrio_centroid"), make(lat=far, geocode_precision="rooftop")), o)
    assert sorted((r.geocode_precision, r.reason is None) for r in e.collect()) == [("barrio_centroid", True), ("rooftop", False)]


def test_zone_filter(spark):
    rows = [make(barrio="Ciudad Jardín"), make(barrio="Granada"), make(barrio=None), make(barrio="Granada", city="Jamundí"), make(barrio="valle del lili norte")]
    kept = rank.evaluate(frame(spark, *rows), rank.RankOptions(lat=3.4, lng=-76.53)).where("in_zone").count()
    assert kept == 3


def test_scores(spark):
    best, mid, worst = make(price=1e6, area_m2=200.0), make(price=2e6, area_m2=120.0, lat=3.41), make(price=3e6, area_m2=90.0, lat=3.42)
    o = rank.RankOptions(lat=3.4, lng=-76.53, zone_filter=False, top=2)
    result = rank_plan(frame(spark, mid, worst, best), o)
    assert [(r.source_listing_id, r.rank) for r in result.top.orderBy("rank").collect()] == [(best["source_listing_id"], 1), (mid["source_listing_id"], 2)]
    every = {r.source_listing_id: (r.rank, round(r.score, 6)) for r in rank.rank_all(result.ranked).collect()}
    assert every[best["source_listing_id"]] == (1, 1.0) and every[worst["source_listing_id"]] == (3, 0.0)
    one = rank_plan(frame(spark, make()), rank.RankOptions(lat=3.4, lng=-76.53, w_cost=0, w_area=0, w_dist=0, zone_filter=False)).top.first()
    assert (one.rank, one.score) == (1, 0.0)
    assert rank_plan(frame(spark), o).top.count() == 0


def test_driving(spark):
    rows = [make(), make(lat=3.41)]
    driving = spark.createDataFrame([(3.41, -76.53, 30.0, 40.0)], "dest_lat double, dest_lng double, km double, min double")
    o = rank.RankOptions(lat=3.4, lng=-76.53, zone_filter=False)
    result = rank_plan(frame(spark, *rows), o, driving=driving)
    assert {r.reason for r in result.reasons.collect()} == {rank.TOO_FAR_BY_ROAD}
    assert result.stats.first().driving_computed == 1


def test_driving_from_another_point(spark):
    """Only answers from the options' own point count."""
    rows = [make(lat=3.41)]
    driving = spark.createDataFrame([(3.4, -76.53, 3.41, -76.53, 6.0, 9.0), (9.0, -70.0, 3.41, -76.53, 1.0, 2.0)], "origin_lat double, origin_lng double, dest_lat double, dest_lng double, km double, min double")
    result = rank_plan(frame(spark, *rows), rank.RankOptions(lat=3.4, lng=-76.53, zone_filter=False), driving=driving)
    assert result.top.first().driving_km == 6.0


def test_rank_all_is_the_order(spark):
    rows = [("s", str(k), (k * 37 % 100) / 100) for k in range(100)] + [("s", "x", 0.5), ("r", "y", 0.5), ("s", "z", None)]
    scored = spark.createDataFrame(rows, "source string, source_listing_id string, score double")
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0], r[1]))
    assert [tuple(r)[:3] for r in rank.rank_all(scored).orderBy("rank").collect()] == want
    assert sorted(r["rank"] for r in rank.rank_all(scored).collect()) == list(range(1, 104))


def test_visible_columns(spark):
    top = rank_plan(frame(spark, make(barrio="Pance", conjunto=None)), rank.RankOptions(lat=3.4, lng=-76.53, zone_filter=False)).top
    row = filters.visible_columns(top).first()
    assert row.place == "Pance" and row.distance == top.first().distance_km and row.verdict is None and "phone" not in row.asDict()
    assert filters.visible_columns(top.withColumn("verdict", F.lit("ok")), ["verdict", "phone"]).columns == ["phone", "verdict"]


def test_search_city_filter(spark):
    rows = frame(spark, make(city="Cali"), make(city="Palmira", lat=3.5)).withColumn("is_active", F.lit(True))
    assert search(rows, rank.RankOptions(lat=3.4, lng=-76.53, max_km=50, cities=("CALI",), zone_filter=False)).ranked.count() == 1


@pytest.mark.parametrize(("expr", "passing", "invalid"), [("<2M", [1e6], False), (">=800k", [1e6, 2e6, 3e6], False), ("1M-2M", [1e6, 2e6], False), ("2M-1M", [1e6, 2e6], False), ("=2000000", [2e6], False), ("1.5M", [2e6, 3e6], False), ("", [None, 1e6, 2e6, 3e6], False), ("1,5M", None, True), ("abc", None, True), ("<", None, True)])
def test_numeric_filter(spark, expr, passing, invalid):
    condition, bad = filters.numeric_filter(expr, F.col("x"))
    assert bad is invalid
    if not bad:
        rows = spark.createDataFrame([(None,), (1e6,), (2e6,), (3e6,), (float("nan"),)], "x double")
        got = [r.x for r in (rows.where(condition) if condition is not None else rows.where("x is null or x < 9e9")).collect()]
        assert sorted(got, key=lambda v: (v is not None, v)) == passing


def test_user_sort(spark):
    df = spark.createDataFrame([(1, "Ñame", 5.0), (2, "", 1.0), (3, "nube", None), (4, "Ola", 5.0)], "rank int, city string, price double")
    order = lambda *k: [r["rank"] for r in filters.user_sort(df, k).collect()]
    assert order(("city", "asc")) == [3, 1, 4, 2]
    assert order(("city", "desc")) == [4, 1, 3, 2]
    assert order(("price", "desc")) == [1, 4, 2, 3]
    assert order(("price", "asc"), ("city", "desc")) == [2, 4, 1, 3]
    assert order(("nothing", "asc")) == [1, 2, 3, 4]


def test_violations(spark):
    rows = [make(area_m2=-1.0), make(estrato=9), make(url="x"), make(geocode_precision="here"), make()]
    assert sorted(r.violation for r in violations(frame(spark, *rows)).collect()) == ["area_m2", "estrato", "geocode_precision", "url"]


def snapshot(spark, *rows):
    return spark.createDataFrame(rows, "source string, source_listing_id string, price double, first_seen timestamp, last_seen timestamp, last_verified_at timestamp, is_active boolean")


def test_merge_and_diff(spark):
    from datetime import datetime

    t0, t1, t2 = (datetime(2024, 1, d) for d in (1, 2, 3))
    old = snapshot(spark, ("a", "1", 1.0, t0, t0, None, True), ("a", "2", 2.0, t0, t0, None, True), ("b", "1", 3.0, t0, t0, None, True))
    batch = spark.createDataFrame([("a", "1", 9.0, t1), ("a", "1", 10.0, t2), ("a", "3", 5.0, t1)], "source string, source_listing_id string, price double, seen_at timestamp")
    got = {(r.source, r.source_listing_id): (r.price, r.first_seen, r.last_seen, r.is_active) for r in merge.merge_snapshot(old, batch).collect()}
    assert got == {("a", "1"): (10.0, t0, t2, True), ("a", "2"): (2.0, t0, t2, False), ("a", "3"): (5.0, t1, t1, True), ("b", "1"): (3.0, t0, t0, True)}
    kept = merge.merge_snapshot(old, batch, deactivate=False).where("is_active").count()
    assert kept == 4
    (d,) = merge.crawl_diff(old, batch).collect()
    assert (d.source, d.listed, d.inserted, d.updated, d.deactivated) == ("a", 3, 1, 1, 1)
    again = merge.merge_snapshot(merge.merge_snapshot(old, batch), batch)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merge.merge_snapshot(old, batch).collect()))


def test_caps_and_runs(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "source string, seq int")
    assert merge.cap_per_source(df, 2, ["seq"]).count() == 3
    assert merge.cap_per_source(df, 0, ["seq"]).count() == merge.cap_per_source(df, None, ["seq"]).count() == 6
    run = spark.createDataFrame([("r", None, "{}")], "id string, started_at timestamp, params string")
    none = spark.createDataFrame([], "seen_at timestamp")
    assert merge.close_run(run, spark.createDataFrame([("e",)], "error string"), none).first().status == "failed"
    assert merge.close_run(run, spark.createDataFrame([], "error string"), none).first().status == "completed"


def test_geocode_cache(spark):
    from datetime import datetime

    rows = frame(spark, make(lat=None, lng=None, barrio="Pance", geocode_precision=None), make(geocode_precision=None), make(lat=None, lng=None, barrio=None, city=None))
    q = "pance, cali, valle del cauca, colombia"
    cache = spark.createDataFrame([(q, 3.3, -76.5, "rooftop", "google", None, datetime(2024, 1, 1))], "query string, lat double, lng double, precision string, provider string, place_id string, created_at timestamp")
    got = sorted((r.lat or 0, r.geocode_precision) for r in geocode.fill_coordinates(rows, cache).collect())
    assert got == [(0, "source"), (3.3, "barrio_centroid"), (3.4, "source")]
    now = F.expr("timestamp '2024-03-01 00:00:00'")
    assert [r.query for r in geocode.worklist(rows, cache, now).collect()] == [q]
    assert geocode.worklist(rows, cache, F.expr("timestamp '2024-01-05 00:00:00'")).count() == 0


def test_verdicts(spark):
    rows = [("u1", "u1", 404, None, None), ("https://a.co/x", "https://a.co/", 200, "", None), ("https://a.co/y", "https://a.co/buscar/1", 200, "", None), ("u4", "u4", 503, None, None), ("u5", "u5", 200, "Este inmueble YA NO se encuentra", None), ("u6", "u6", 200, "ok", None), ("u7", None, None, None, "timeout")]
    got = {r.url: (r.is_active, r.reason) for r in verify.verdicts(spark.createDataFrame(rows, "url string, final_url string, status int, body string, error string")).collect()}
    assert [v[0] for v in got.values()] == [False, False, False, True, False, True, True]
    assert got["u5"][1] == 'marker: "este inmueble ya no se encuentra"'
