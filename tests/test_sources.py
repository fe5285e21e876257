import base64
import json

from pyspark.sql import functions as F

from hearthline.operators import extract
from hearthline.plans.entries import ingest, rank_list
from hearthline.operators.rank import RankOptions
from hearthline.schemas import LISTING, PAYLOAD
from hearthline.sources import html_portals, json_portals, registry, userlist


def payloads(spark, *pages, source="x", city="cali"):
    return spark.createDataFrame([(source, url, city, 1, None, 200, body) for url, body in pages], PAYLOAD)


def same_types(df):
    return [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in LISTING]


def one(df):
    assert same_types(df)
    (row,) = df.collect()
    return row


def test_json_ld(spark):
    page = '<script type="application/ld+json">[{"@type":"A"},{"@graph":[{"@type":["B","house"],"n":1}]}]</script><script type="application/ld+json">{"@type":"C"} {"@type":"D"}</script><script type="application/ld+json">{bad</script>'
    nodes = extract.json_ld_nodes(payloads(spark, ("u", page)))
    assert nodes.count() == 4
    assert json.loads(extract.first_of_type(nodes, "House").first().node)["n"] == 1
    assert extract.first_of_type(nodes, "d").count() == 1 and extract.first_of_type(nodes, "zzz").count() == 0


def test_scanners():
    assert extract.coded_state("x&q;k&q;:{&q;a&q;:&q;}&a;&q;,&q;b&q;:{}}tail", "k") == ['{"a":"}&","b":{}}']
    assert extract.coded_state(None, "k") == extract.coded_state("k&q;:{", "k") == []
    flight = json.dumps('{"id":"1","t":"a{"},{"id":"2"},{"id":"1"}')
    assert extract.streamed_objects(f"self.__next_f.push([1,{flight}])", "id") == ['{"id":"1","t":"a{"}', '{"id":"2"}']
    assert extract.labelled_values("<li><strong>Área:</strong> 90 m²</li><li><b>Baños</b><span>2</span></li><li>area: x</li>") == {"area": "90 m²", "banos": "2"}


def test_streamed_objects_nest():
    flight = json.dumps('1:["$",{"list":[{"id":"7","in":{"id":"8"}}]}]\n2:{broken {"id":"9","s":"} {"}')
    page = f"self.__next_f.push([1,{flight}])self.__next_f.push([1,broken])"
    assert [json.loads(x)["id"] for x in extract.streamed_objects(page, "id")] == ["7", "8", "9"]
    assert extract.streamed_objects(None, "id") == extract.streamed_objects("", "id") == []


def test_a_page_fetched_twice_counts_twice(spark):
    """Facts of a page are its own, not its url's: no fetch is multiplied by another."""
    body = '<script type="application/ld+json">{"@type":"House","numberOfRooms":"3"}</script><ul><li><strong>Alcobas:</strong> 2</li></ul>'
    for normalize, url in ((html_portals.inmoalfaguara, "https://inmoalfaguara.co/a-b-c-cali/5"), (html_portals.arriendo, "https://arriendo.com/co/casas/cali/pance/ar-5/")):
        assert normalize(payloads(spark, (url, body), (url, body), (url, body))).count() == 3
    cards = '<script type="application/ld+json">{"@type":"SearchResultsPage","about":[{"name":"n"}]}</script><div class="snippet__content"><a href="/d/5">x</a></div><div class="snippet__content"><a href="/d/6">y</a></div>'
    assert html_portals.properati(payloads(spark, ("https://p/1", cards), ("https://p/1", cards))).count() == 4
    ld = '<script type="application/ld+json">{"@type":"RealEstateListing","name":"x"}</script>'
    assert html_portals.rentola(payloads(spark, *[("https://rentola.co.com/x/casa-p1a", ld)] * 3)).count() == 3


def test_links_and_sitemaps(spark):
    page = '<a href="/a">1</a><a href="/a">2</a><A HREF="https://o.org/b?x&amp;y">3</A><a href="#t">4</a>'
    assert sorted(r.link for r in extract.links(payloads(spark, ("https://h.org/p/", page))).collect()) == ["https://h.org/a", "https://o.org/b?x&y"]
    maps = payloads(spark, ("i", "<loc>s1.xml</loc><loc>other.xml</loc>"), ("s1.xml", "<loc> https://h.org/1 </loc>"))
    assert [r.loc for r in extract.child_sitemaps(maps, "^s").collect()] == ["https://h.org/1"]
    assert spark.range(1).select(extract.meta_tags(F.lit('<meta name="a" content="1&amp;2"><meta content=\'3\' property="og:t"><meta name="a" content="x">')).alias("m")).first().m == {"a": "1&2", "og:t": "3"}


def test_rentola(spark):
    ld = json.dumps({"@type": "RealEstateListing", "name": "Casa", "offers": {"price": 1000000, "itemOffered": {"address": {"streetAddress": "Calle 1", "addressLocality": "Bogotá"}, "geo": {"latitude": 3.4, "longitude": "-76.5"}, "floorSize": {"value": 90}, "numberOfBedrooms": {"value": 3}, "numberOfBathrooms": {"value": "2"}}}})
    body = f'<script type="application/ld+json">{ld}</script><p>Con parqueadero</p>'
    url = "https://rentola.co.com/listings/casa-en-arriendo-en-cali-en-villa-del-prado-99622-1-000-000-pcec8fd"
    r = one(html_portals.rentola(payloads(spark, (url, body), ("https://rentola.co.com/api/events/1-p1a", body))))
    assert (r.source_listing_id, r.city, r.barrio, r.area_m2, r.bedrooms, r.bathrooms, r.parking, r.price, r.lat) == ("99622", "Cali", "Villa Del Prado", 90.0, 3, 2, 1, 1_000_000.0, 3.4)


def test_inmoalfaguara(spark):
    body = '<meta property="og:title" content="Casa en Verona - $1.100.000 COP"><ul><li class="col-md-8"><strong>Zona / barrio:</strong> VERONA</li><li class="col-md-8"><strong>Área Construida:</strong> 80 m2</li><li class="col-md-8"><strong>Alcobas:</strong> 3</li><li class="col-md-8"><strong>Baños:</strong> 2</li><li class="col-md-8"><strong>Estrato:</strong> 9</li></ul>'
    r = one(html_portals.inmoalfaguara(payloads(spark, ("https://inmoalfaguara.co/casa-alquiler-conjunto-residencial-verona-jamundi/10071877", body))))
    assert (r.source_listing_id, r.price, r.barrio, r.conjunto, r.city, r.area_m2, r.bedrooms, r.bathrooms, r.estrato) == ("10071877", 1_100_000.0, "Verona", "Conjunto Residencial Verona", "Jamundi", 80.0, 3, 2, None)


def test_properati(spark):
    about = {"@type": "SearchResultsPage", "about": [{"address": {"streetAddress": "Conjunto Sol, Calle 5, Pance, Cali, Valle del Cauca, Colombia", "addressLocality": "Cali"}, "geo": {"latitude": 3.3, "longitude": -76.5}, "numberOfBedrooms": 4}]}
    body = f'<script type="application/ld+json">{json.dumps(about)}</script><div class="snippet__content"><a class="snippet__title" href="/detalle/abc123">Casa en Arriendo en Cali</a><span class="snippet__price">$ 1.500.000</span><span class="area-value">90 m²</span></div>'
    r = one(html_portals.properati(payloads(spark, ("https://p/1", body))))
    assert (r.source_listing_id, r.barrio, r.conjunto, r.city, r.area_m2, r.bedrooms, r.price, r.lng) == ("abc123", "Pance", "Conjunto Sol", "Cali", 90.0, 4, 1_500_000.0, -76.5)


def test_naranjoduque(spark):
    ficha = 'id_user:"CÓDIGO 2474",description:"ALQUILER Casa <br />Baños 2",link:{html:"<a href="<!--base_url_placeholder-->casa-1.html">"},properties:{"1 TIPO DE BÚSQUEDA":"Arriendo","2 TIPO DE INMUEBLE":"Casa","3 CIUDAD":"Jamundí","5 BARRIO":"CENTRO","6 ALCOBAS":"3"},schemaOrg:{offers:{"@type":"Offer",priceCurrency:"COP",price:"1200000"}}'
    other = ficha.replace("Arriendo", "Venta").replace("2474", "1")
    detail = "<body>Casa - 60m² Estrato: 3</body>"
    p = payloads(spark, ("https://www.inmobiliarianaranjoduque.com/cart/x5cart.js", f"x={{{ficha}}},{{{other}}}"), ("https://www.inmobiliarianaranjoduque.com/casa-1.html", detail))
    r = one(html_portals.naranjoduque(p))
    assert (r.source_listing_id, r.price, r.barrio, r.city, r.area_m2, r.bedrooms, r.bathrooms, r.estrato) == ("2474", 1_200_000.0, "Centro", "Jamundí", 60.0, 3, 2, 3)


def test_ciencuadras_fallback_and_details(spark):
    ld = {"@type": "ItemList", "itemListElement": [{"item": {"url": "/inmueble/casa-77", "name": "Casa en arriendo en Calle 1, CONJUNTO SOL, Cali - Cód. 9", "offers": {"price": "1500000", "itemOffered": {"floorSize": {"value": "80"}, "numberOfRooms": 3}}}}]}
    r = one(json_portals.ciencuadras(payloads(spark, ("https://c/1", f'<script type="application/ld+json">{json.dumps(ld)}</script>'))))
    assert (r.source_listing_id, r.barrio, r.conjunto, r.city, r.price, r.area_m2, r.bedrooms) == ("77", "Conjunto Sol", "Conjunto Sol", "Cali", 1_500_000.0, 80.0, 3)
    blob = json.dumps({"generalData": {"whatsAppContact": "3001234567", "stratum": "4"}, "dataStrip": {"realStateName": "Casa SA"}}).replace('"', "&q;")
    details = json_portals.ciencuadras_details(payloads(spark, ("https://www.ciencuadras.com/inmueble/casa-77", f"&q;detail&q;:{blob}")))
    base = json_portals.ciencuadras(payloads(spark, ("https://c/1", f'<script type="application/ld+json">{json.dumps(ld)}</script>')))
    full = json_portals.enrich(base, details).first()
    assert (full.phone, full.estrato, full.agency, full.bedrooms, full.has_whatsapp) == ("3001234567", 4, "Casa SA", 3, True)


def test_mitula_relative_link(spark):
    coded = base64.b64encode(b"/adform/1").decode()
    r = one(html_portals.mitula(payloads(spark, ("https://m/1", f'<div class="listing-card" data-listingid="1" data-clickdestination="{coded}" data-price="900000"></div>'))))
    assert (r.url, r.price) == ("https://casas.mitula.com.co/adform/1", 900_000.0)


def test_registry_and_ingest(spark):
    assert [s.id for s in registry.select_sources(only=["metrocuadrado"])] == ["metrocuadrado"]
    assert len(registry.select_sources()) == 12 and len(registry.select_sources(hard=True)) == 13
    assert registry.registry_table(spark).count() == 13
    body = json.dumps({"data": [{"codpro": 1, "rent": 1000000, "city": "Cali"}, {"city": "Cali"}]})
    p = spark.createDataFrame([("bienco", "u", "cali", 1, __import__("datetime").datetime(2024, 1, 1), 200, body)], PAYLOAD)
    old = spark.createDataFrame([], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LISTING.fields) + ", first_seen timestamp, last_seen timestamp, last_verified_at timestamp, is_active boolean")
    out = ingest(p, old, only=["bienco"])
    assert out.snapshot.count() == 1 and out.diff.first().inserted == 1
    assert {r.source: r.n for r in out.counts.collect()}["bienco"] == 1


def test_user_list(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('Barrio;Conjunto;Área m2;Precio;Enlace;Otro\nPance;;90;"$ 1.500.000";https://a.co/1;x\n\nSur;;;;;\nLili;Sol;80,5;2M;bad;y\nmal\n')
    rows = userlist.read_list(spark, str(path))
    got = userlist.listings_from_list(rows)
    assert same_types(got)
    assert sorted((r.source_listing_id, r.barrio, r.area_m2, r.price) for r in got.collect()) == [("https://a.co/1", "Pance", 90.0, 1_500_000.0), ("row-3", "Lili", 80.5, 2.0)]
    assert [r.warning for r in userlist.list_warnings(rows, got).collect()] == ["CSV: malformed line (row 4)"]
    empty = tmp_path / "empty.csv"
    empty.write_text("Barrio\tPrecio\n")
    rows = userlist.read_list(spark, str(empty))
    assert userlist.list_warnings(rows, userlist.listings_from_list(rows)).count() == 1
    result = rank_list(spark, str(path), RankOptions())
    assert result.parsed.first().parsed == 2 and {r.reason for r in result.result.reasons.collect()} == {"no location / distance"}


def test_stream(spark, tmp_path):
    from datetime import datetime

    from hearthline.streaming.ingest import merge_stream

    schema = spark.createDataFrame([], "source string, source_listing_id string, price double, seen_at timestamp").schema
    old = "source string, source_listing_id string, price double, first_seen timestamp, last_seen timestamp, last_verified_at timestamp, is_active boolean"
    state = {"at": None}

    def load():
        return spark.read.schema(old).parquet(state["at"]) if state["at"] else spark.createDataFrame([], old)

    def store(df, batch_id):
        path = str(tmp_path / f"snapshot-{batch_id}")
        df.write.mode("overwrite").parquet(path)
        state["at"] = path

    for k, price in enumerate((1.0, 2.0)):
        spark.createDataFrame([("a", "1", price, datetime(2024, 1, 1 + k)), ("a", str(k + 2), 5.0, datetime(2024, 1, 1 + k))], schema).write.mode("append").parquet(str(tmp_path / "in"))
        merge_stream(spark, str(tmp_path / "in"), schema, load, store, str(tmp_path / "checkpoint")).awaitTermination()
    want = {"1": (2.0, True), "2": (5.0, True), "3": (5.0, True)}
    assert {r.source_listing_id: (r.price, r.is_active) for r in load().collect()} == want
    merge_stream(spark, str(tmp_path / "in"), schema, load, store, str(tmp_path / "again")).awaitTermination()  # the same files once more
    assert {r.source_listing_id: (r.price, r.is_active) for r in load().collect()} == want


def test_agencies_reach_the_registry(spark):
    page = '<title>Renta de Casa en X, Cali, Valle</title><meta content="Cali" name="municipio"><meta content="2000000" name="precio">'
    url = "https://century21colombia.com/propiedad/5_casa"
    agencies = spark.createDataFrame([(url, "Century Sur", "6021234567")], "url string, agency string, phone string")
    pages = payloads(spark, (url, page), source="century21")
    (row,) = registry.normalize_all(pages, agencies=agencies).collect()
    assert (row.agency, row.phone) == ("Century Sur", "6021234567")
    assert registry.normalize_all(pages).first().agency is None


def test_payloads_are_kept_by_source(spark, tmp_path):
    from hearthline.sources.stored import read_payloads, write_payloads

    both = payloads(spark, ("u", "a"), source="bienco").unionByName(payloads(spark, ("v", "b"), source="mitula"))
    write_payloads(both, f"{tmp_path}/p")
    again = read_payloads(spark, f"{tmp_path}/p")
    assert sorted((r.source, r.url, r.body) for r in again.collect()) == [("bienco", "u", "a"), ("mitula", "v", "b")]
    assert again.where("source = 'mitula'").inputFiles() and "PartitionFilters: [isnotnull(source" in again.where("source = 'mitula'")._jdf.queryExecution().toString()


def _payload(spark, *rows):
    from datetime import datetime

    return spark.createDataFrame([("x", u, "Cali", n, datetime(2024, 1, d), 200, b) for u, n, d, b in rows], "source string, url string, city string, page_no int, fetched_at timestamp, status int, body string")


def test_deeply_nested_objects_stop_nothing():
    from hearthline.operators.extract import coded_state, streamed_objects

    page = lambda text: "<script>self.__next_f.push([1," + __import__("json").dumps(text) + "])</script>"
    deep = '{"a":' * 50_000 + "1" + "}" * 50_000
    assert streamed_objects(page(f'{deep} {{"id":"7","x":{{"id":"8"}}}} {{"id":"7","y":1}}'), "id") == ['{"id":"7","x":{"id":"8"}}', '{"id":"8"}']
    within = '{"b":' * 500 + '{"id":"deep"}' + "}" * 500
    assert streamed_objects(page(within), "id") == ['{"id":"deep"}']
    assert coded_state("results&q;:" + "{&q;a&q;:" * 200_000, "results") == [] and coded_state("results&q;:{&q;a&q;:[1]}x", "results") == ['{"a":[1]}']


def test_the_first_of_an_advert_on_several_pages(spark):
    import json

    coded = lambda cards: "results&q;:" + json.dumps({"data": {"results": cards}}).replace('"', "&q;")
    card = lambda i, price: {"id": i, "url": f"/inmueble/casa-{i}", "city": "Cali", "rentPrice": str(price)}
    pages = [("u2", 2, 1, coded([card("1", 200), card("2", 300)])), ("u1", 1, 1, coded([card("1", 100), card("1", 150)])), ("u3", 3, 1, coded([card("2", 400)]))]
    for order in (pages, pages[::-1]):
        got = json_portals.ciencuadras(_payload(spark, *order).repartition(3))
        assert sorted((r.source_listing_id, r.price) for r in got.collect()) == [("1", 100.0), ("2", 300.0)]


def test_details_of_the_last_fetch(spark):
    import json

    coded = lambda d: "detail&q;:" + json.dumps(d).replace('"', "&q;")
    detail = lambda fee: coded({"generalData": {"adminValue": str(fee)}, "dataStrip": {"realStateName": " A "}})
    found = json_portals.ciencuadras_details(_payload(spark, ("u", 1, 2, detail(20)), ("u", 1, 3, detail(30)), ("u", 1, 1, detail(10)), ("v", 1, 1, "no state")))
    assert [(r.url, r.admin, r.agency) for r in found.collect()] == [("u", 30.0, "A")]
    listings = json_portals.ciencuadras(_payload(spark)).limit(0)
    assert json_portals.enrich(listings, found).columns == listings.columns


def test_payloads_are_routed_once(spark):
    rows = _payload(spark, ("u1", 1, 1, "{}"), ("u2", 1, 1, "{}")).withColumn("source", F.when(F.col("url") == "u1", "bienco").otherwise("elsewhere"))
    routed = registry.route_payloads(rows)
    assert routed.columns == rows.columns and [(r.source, r.url) for r in routed.collect()] == [("bienco", "u1")]
    plan = routed.where("source = 'bienco'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(source" in plan
    assert registry.normalize_all(rows).count() == 0 and registry.normalize_all(rows.limit(0)).count() == 0


def test_estate_words_and_scripts_are_looked_for_once(spark):
    """A text is normalised once for all words of an estate, and a page without JSON-LD isn't searched for its scripts."""
    from pyspark.sql import functions as F

    from hearthline.operators.extract import coded_state, json_ld_blocks
    from hearthline.sources.json_portals import _conjunto

    df = spark.createDataFrame([("Unidad  RÍO",), ("casa",), (None,), ("URBANIZACIÓN x",)], "a string")
    out = df.select(_conjunto(F.col("a")).alias("c"))
    assert [r.c for r in out.collect()] == ["Unidad  Río", None, None, "Urbanización X"]
    assert "exists(" not in out._jdf.queryExecution().analyzed().toString()
    page = '<SCRIPT type="Application/LD+Json">{"a":1}</script>'
    pages = spark.createDataFrame([(page,), ("<script>1</script>",), (None,)], "b string").select(json_ld_blocks(F.col("b")).alias("x"))
    assert [r.x for r in pages.collect()] == [['{"a":1}'], [], None]
    assert coded_state("&q;k&q;:{&q;a&q;:&q;&a;q; &a;a; &l;&g; &x;&q;} more", "k") == ['{"a":"&q; &a; <> &x;"}']
