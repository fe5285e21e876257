"""Checked queries: sources. Their payloads are written from the derived listings, so what a source reads must be those listings again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import html_portals, json_portals, registry
from . import data
from .data import LISTINGS_CTE
from .registry import query  # of queries; the other registry is of sources

_BARRIO = "CASE WHEN barrio = 'EL CANEY' THEN 'El Caney' ELSE barrio END"
_SHOWN = f"source_listing_id, {_BARRIO} AS barrio, city, area_m2, bedrooms, price"
_COLUMNS = ("source_listing_id", "barrio", "city", "area_m2", "bedrooms", "price")


def oracle(columns: str = _SHOWN, where: str = "true") -> str:
    return f"WITH {LISTINGS_CTE} SELECT {columns} FROM active WHERE {where}"


def pages_of(rows: DataFrame, source: str, item: str, body: str, per_page: int = 25) -> DataFrame:
    """Payloads of up to per_page listings: `item` is SQL of one, `body` SQL over items, their list. Rows are dealt by page before they
    become items, which are longer."""
    n = F.col("source_listing_id").cast("bigint")
    dealt = rows.withColumn("page", F.floor(n / per_page).cast("int")).withColumn("city_", F.col("city")).repartition("page", "city_")
    grouped = dealt.groupBy("page", "city_").agg(F.sort_array(F.collect_list(F.struct("source_listing_id", F.expr(item).alias("i")))).alias("l"))
    grouped = grouped.withColumn("items", F.transform("l", lambda x: x["i"]))
    return grouped.select(F.lit(source).alias("source"), F.concat(F.lit(f"https://{source}.example/"), F.col("page").cast("string"), F.lit("/"), F.col("city_")).alias("url"), F.col("city_").alias("city"), F.col("page").alias("page_no"), F.expr("timestamp '2024-06-30 00:00:00'").alias("fetched_at"), F.lit(200).alias("status"), F.expr(body).alias("body"))


def detail_pages(rows: DataFrame, source: str, url: str, body: str) -> DataFrame:
    """One payload a listing. Rows are dealt afresh before they become pages: a file of rows is small where its pages are much work."""
    rows = rows.repartition("source_listing_id")
    return rows.select(F.lit(source).alias("source"), F.expr(url).alias("url"), "city", F.lit(1).alias("page_no"), F.expr("timestamp '2024-06-30 00:00:00'").alias("fetched_at"), F.lit(200).alias("status"), F.expr(body).alias("body"))


#: What a source's payloads look like, made from listings.
PAYLOADS: dict = {}


def payloads(source: str):
    def register(f):
        PAYLOADS[source] = f
        return f

    return register


_PRICE_TEXT = "concat('$ ', translate(format_number(price, 0), ',', '.'))"


@payloads("bienco")
def bienco_payloads(rows: DataFrame) -> DataFrame:
    item = f"named_struct('codpro', bigint(source_listing_id), 'neighborhood', barrio, 'city', city, 'area_cons', area_m2, 'area_lot', 99, 'bedrooms', bedrooms, 'rent', if(bigint(source_listing_id) % 2 = 0, price, null), 'price', {_PRICE_TEXT}, 'administration', admin, 'latitude', string(lat), 'longitude', string(lng), 'stratum', estrato, 'description', concat('Tel +57 ', substr(phone, 1, 3), ' ', substr(phone, 4)))"
    return pages_of(rows, "bienco", item, "to_json(named_struct('data', items))")


@query("source_bienco", oracle(f"source_listing_id, {_BARRIO} AS barrio, city, coalesce(area_m2, 99) AS area_m2, bedrooms, price, admin, estrato, lat, phone", "source_listing_id <> '0'"))
def source_bienco(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_portals.bienco(PAYLOADS["bienco"](data.active(spark, sf_dir))).select(*_COLUMNS, "admin", "estrato", "lat", "phone")


@payloads("fincaraiz")
def fincaraiz_payloads(rows: DataFrame) -> DataFrame:
    item = "named_struct('id', source_listing_id, 'link', concat('/l/', source_listing_id), 'm2Built', area_m2, 'm2', 0, 'rooms', bedrooms, 'bedrooms', 0, 'garage', parking, 'price', named_struct('amount', price), 'commonExpenses', named_struct('amount', admin), 'stratum', 110, 'latitude', lat, 'longitude', string(lng), 'owner', named_struct('name', agency), 'locations', named_struct('neighbourhood', array(named_struct('name', barrio))))"
    body = "concat('<html><script id=\"__NEXT_DATA__\" type=\"application/json\">', to_json(named_struct('props', named_struct('pageProps', named_struct('fetchResult', named_struct('searchFast', named_struct('data', items)))))), '</script></html>')"
    return pages_of(rows, "fincaraiz", item, body)


@query("source_fincaraiz", oracle(f"source_listing_id, {_BARRIO} AS barrio, city, area_m2, bedrooms, price, admin, parking, lng, agency"))
def source_fincaraiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_portals.fincaraiz(PAYLOADS["fincaraiz"](data.active(spark, sf_dir))).select(*_COLUMNS, "admin", "parking", "lng", "agency")


@payloads("ciencuadras")
def ciencuadras_payloads(rows: DataFrame) -> DataFrame:
    item = f"named_struct('id', source_listing_id, 'url', concat('/inmueble/casa-', source_listing_id), 'neighborhood', barrio, 'city', city, 'area', string(area_m2), 'rooms', string(bedrooms), 'rentPrice', {_PRICE_TEXT}, 'stratum', estrato, 'contactWhatsapp', phone, 'userName', 'A & \"B\" {{<>}}', 'coordinates', named_struct('latitude', lat, 'longitude', lng))"
    blob = "to_json(named_struct('data', named_struct('results', slice(items, 1, 5), 'highlights', slice(items, 6, 100))))"
    body = f"concat('<script id=\"state\">{{&q;results&q;:', replace(replace(replace(replace({blob}, '&', '&a;'), '\"', '&q;'), '<', '&l;'), '>', '&g;'), '}}</script>')"
    return pages_of(rows, "ciencuadras", item.replace("{{<>}}", "{<>}"), body)


@query("source_ciencuadras", oracle(f"source_listing_id, {_BARRIO} AS barrio, city, area_m2, bedrooms, price, estrato, phone, phone IS NOT NULL AS has_whatsapp"))
def source_ciencuadras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_portals.ciencuadras(PAYLOADS["ciencuadras"](data.active(spark, sf_dir))).select(*_COLUMNS, "estrato", "phone", "has_whatsapp")


@payloads("inmobiliariajr")
def inmobiliariajr_payloads(rows: DataFrame) -> DataFrame:
    rows = rows.where("bedrooms is not null")
    item = f"to_json(named_struct('id_property', source_listing_id, 'title', concat(if(bigint(source_listing_id) % 3 = 0, 'Local', 'Casa'), '  en  C.R VERDE ', bedrooms), 'for_rent', 'true', 'rent_price_label', {_PRICE_TEXT}, 'city_label', city, 'zone_label', barrio, 'built_area', replace(string(area_m2), '.', ','), 'bedrooms', concat(bedrooms, ' hab'), 'latitude', '0', 'longitude', '0'))"
    body = "concat('{\"status\":\"success\",\"total\":', size(items), ',', array_join(transform(items, (x, k) -> concat('\"', k, '\":', x)), ','), '}')"
    return pages_of(rows, "inmobiliariajr", item, body)


@query("source_inmobiliariajr", oracle(f"source_listing_id, {_BARRIO} AS barrio, city, area_m2, bedrooms, price, 'Verde ' || CAST(bedrooms AS STRING) AS conjunto", "bedrooms IS NOT NULL AND CAST(source_listing_id AS BIGINT) % 3 <> 0"))
def source_inmobiliariajr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_portals.inmobiliariajr(PAYLOADS["inmobiliariajr"](data.active(spark, sf_dir))).select(*_COLUMNS, "conjunto")


@payloads("metrocuadrado")
def metrocuadrado_payloads(rows: DataFrame) -> DataFrame:
    item = "to_json(named_struct('midinmueble', source_listing_id, 'title', 'x {y} \"z\"', 'link', concat('/l/', source_listing_id), 'mtiponegocio', 'Venta y Arriendo', 'mvalorarriendo', price, 'marea', area_m2, 'mnrocuartos', string(bedrooms), 'mciudad', named_struct('nombre', city), 'mbarrio', barrio, 'contactPhone', concat('57', phone), 'localizacion', named_struct('lat', lat, 'lon', lng), 'data', named_struct('mvaloradministracion', string(bigint(admin)))))"
    joined = "concat('{\"items\":[', array_join(concat(items, slice(items, 1, 1)), ','), ']}')"
    coded = f"concat('\"', replace(replace({joined}, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), '\"')"
    body = f"concat('<script>self.__next_f.push([1,\"a:\"])</script><script>self.__next_f.push([1,', {coded}, '])</script>')"
    return pages_of(rows, "metrocuadrado", item, body)


@query("source_metrocuadrado", oracle(f"source_listing_id, {_BARRIO} AS barrio, city, area_m2, bedrooms, price, admin, phone, lat"))
def source_metrocuadrado(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_portals.metrocuadrado(PAYLOADS["metrocuadrado"](data.active(spark, sf_dir))).select(*_COLUMNS, "admin", "phone", "lat")


@payloads("elpaisfincaraiz")
def elpaisfincaraiz_payloads(rows: DataFrame) -> DataFrame:
    item = f"concat('<article class=\"flexArticle x\"><a class=\"link-info\" href=\"/casa/', source_listing_id, '\">ver</a><div class=\"label-list\"><h3>Casa, Alquiler en ', coalesce(barrio, upper(city)), '</h3></div><p class=\"description\">', coalesce(concat(bedrooms, ' alcobas, '), ''), '2 ba&ntilde;os, ', coalesce(concat(translate(format_number(area_m2, 2), ',.', '.,'), 'mts2'), ''), '</p><span class=\"price\">', coalesce({_PRICE_TEXT}, ''), '</span>', coalesce(concat('<a class=\"call\">', phone, '</a>'), ''), '</article>')"
    return pages_of(rows, "elpaisfincaraiz", item, "concat('<html><body>', array_join(items, ''), '</body></html>')")


@query("source_elpaisfincaraiz", oracle(f"source_listing_id, {_BARRIO} AS barrio, city, area_m2, bedrooms, price, phone"))
def source_elpaisfincaraiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_portals.elpaisfincaraiz(PAYLOADS["elpaisfincaraiz"](data.active(spark, sf_dir))).select(*_COLUMNS, "phone")


@payloads("mitula")
def mitula_payloads(rows: DataFrame) -> DataFrame:
    item = "named_struct('c', concat('<div class=\"listing-card\" data-listingid=\"', source_listing_id, '\" data-clickdestination=\"', base64(encode(url, 'UTF-8')), '\" data-price=\"', coalesce(string(bigint(price)), ''), '\" data-neighbourhood=\"', coalesce(barrio, ''), '\" data-city=\"', city, '\" data-rooms=\"', coalesce(string(bedrooms), ''), '\" data-floorarea=\"', coalesce(concat(area_m2, ' m2'), ''), '\"><p class=\"published-date-and-agency\">01/02/2024 en - ', coalesce(agency, ''), '</p></div>'), 'ld', named_struct('numberOfBathroomsTotal', bathrooms, 'geo', named_struct('latitude', lat, 'longitude', lng)))"
    body = "concat('<script type=\"application/ld+json\">', to_json(array(named_struct('@type', 'SearchResultsPage', 'about', items.ld))), '</script>', array_join(items.c, ''))"
    return pages_of(rows, "mitula", item, body)


@query("source_mitula", oracle(f"source_listing_id, {_BARRIO} AS barrio, city, area_m2, bedrooms, price, url, lat, agency, bathrooms"))
def source_mitula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_portals.mitula(PAYLOADS["mitula"](data.active(spark, sf_dir))).select(*_COLUMNS, "url", "lat", "agency", "bathrooms")


_C21_URL = "concat('https://century21colombia.com/propiedad/', source_listing_id, '_casa')"


@payloads("century21")
def century21_payloads(rows: DataFrame) -> DataFrame:
    tag = lambda n, v: f"coalesce(concat('<meta content=\"', {v}, '\" name=\"{n}\">'), '')"
    body = f"concat('<title>', if(bigint(source_listing_id) % 2 = 0, 'Renta', 'Venta'), ' de Casa en X, ', city, ', Valle</title>', {tag('colonia', 'barrio')}, {tag('municipio', 'city')}, {tag('MC', 'string(area_m2)')}, {tag('recamaras', 'string(bedrooms)')}, {tag('precio', 'string(bigint(price))')}, '<meta name=\"precio\" content=\"1\">')"
    return detail_pages(rows.withColumn("price", F.coalesce("price", F.lit(1.0))), "century21", _C21_URL, body)


@query("source_century21", oracle(f"source_listing_id, {_BARRIO} AS barrio, city, area_m2, bedrooms, price, agency, CASE WHEN agency IS NOT NULL THEN '6021234567' END AS phone", "city IN ('Cali', 'Jamundí') AND CAST(source_listing_id AS BIGINT) % 2 = 0"))
def source_century21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.active(spark, sf_dir)
    agencies = rows.select(F.expr(_C21_URL).alias("url"), "agency", F.lit("6021234567").alias("phone"))
    out = html_portals.century21(PAYLOADS["century21"](rows), agencies=agencies)
    return out.withColumn("price", F.when(F.col("price") > 1, F.col("price"))).select(*_COLUMNS, "agency", "phone")


@payloads("arriendo")
def arriendo_payloads(rows: DataFrame) -> DataFrame:
    rows = rows.where("barrio is not null")
    field = lambda label, v: f"coalesce(concat('<li class=\"es-property-field\"><span class=\"es-property-field__label\">{label}:</span><span class=\"es-property-field__value\">', {v}, '</span></li>'), '')"
    body = f"concat('<h1 class=\"property-title\">Casa</h1><div class=\"es-price-container\"><span class=\"es-price\">', coalesce({_PRICE_TEXT}, ''), '</span><p><strong>No disponible</strong></p></div><ul>', {field('Barrio', 'barrio')}, {field('Área, m²', 'string(area_m2)')}, {field('Habitaciones', 'string(bedrooms)')}, '</ul><script>window.ARX_PHONE_DATA = window.ARX_PHONE_DATA || {{\"pc\":\"\",\"pw\":\"', coalesce(phone, ''), '\",\"hw\":true}};', coalesce(concat('window.arxPropertyLatLng = {{\"lat\":', lat, ',\"lng\":', lng, '}};'), ''), '</script>')"
    url = "concat('https://arriendo.com/co/casas/', translate(lower(city), 'í', 'i'), '/', replace(lower(barrio), ' ', '-'), '/ar-', source_listing_id, '/')"
    return detail_pages(rows, "arriendo", url, body)


@query("source_arriendo", oracle(f"'AR-' || source_listing_id AS source_listing_id, {_BARRIO} AS barrio, CASE city WHEN 'Jamundí' THEN 'Jamundi' ELSE city END AS city, area_m2, bedrooms, price, lat, phone, coalesce(phone IS NOT NULL, false) AS has_whatsapp", "barrio IS NOT NULL"))
def source_arriendo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_portals.arriendo(PAYLOADS["arriendo"](data.active(spark, sf_dir))).select(*_COLUMNS, "lat", "phone", "has_whatsapp")




_SLUG = "translate(lower({}), 'áéíóúñ ', 'aeioun-')"


@payloads("rentola")
def rentola_payloads(rows: DataFrame) -> DataFrame:
    rows = rows.where("barrio is not null and city <> 'Palmira'")
    house = "named_struct('floorSize', if(area_m2 is null, null, named_struct('value', area_m2)), 'numberOfBedrooms', if(bedrooms is null, null, named_struct('value', string(bedrooms))), 'geo', named_struct('latitude', lat, 'longitude', string(lng)))"
    body = f"concat('<script type=\"application/ld+json\">', concat('{{\"@graph\":[{{\"@type\":\"Other\"}},', to_json(named_struct('@type', array('Thing', 'RealEstateListing'), 'offers', named_struct('price', price, 'itemOffered', {house}))), ']}}'), '</script>')"
    url = f"concat('https://rentola.co.com/x/casa-en-arriendo-en-', {_SLUG.format('city')}, '-en-', {_SLUG.format('barrio')}, '-', source_listing_id, '-1-200-000-pabc12')"
    return detail_pages(rows, "rentola", url, body)


@query("source_rentola", oracle("source_listing_id, CASE barrio WHEN 'EL CANEY' THEN 'El Caney' WHEN 'Ciudad Jardín' THEN 'Ciudad Jardin' ELSE barrio END AS barrio, CASE city WHEN 'Jamundí' THEN 'Jamundi' ELSE city END AS city, area_m2, bedrooms, price, lat", "barrio IS NOT NULL AND city <> 'Palmira'"))
def source_rentola(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_portals.rentola(PAYLOADS["rentola"](data.active(spark, sf_dir))).select(*_COLUMNS, "lat")


@payloads("inmoalfaguara")
def inmoalfaguara_payloads(rows: DataFrame) -> DataFrame:
    rows = rows.where("barrio is not null")
    field = lambda label, v: f"coalesce(concat('<li class=\"col-md-8\"><strong>{label}:</strong> ', {v}, '</li>'), '')"
    body = f"concat(coalesce(concat('<meta property=\"og:title\" content=\"Casa bonita - ', {_PRICE_TEXT}, ' COP\">'), ''), '<ul>', {field('Zona / barrio', 'barrio')}, {field('Ciudad', 'city')}, {field('Área Construida', 'string(area_m2)')}, {field('Alcobas', 'string(bedrooms)')}, {field('Administración', 'string(bigint(admin))')}, {field('Estrato', 'string(estrato)')}, '</ul>')"
    url = "concat('https://inmoalfaguara.co/casa-alquiler-', 'centro-cali/', source_listing_id)"
    return detail_pages(rows, "inmoalfaguara", url, body)


@query("source_inmoalfaguara", oracle(f"source_listing_id, {_BARRIO} AS barrio, city, area_m2, bedrooms, price, admin, estrato", "barrio IS NOT NULL"))
def source_inmoalfaguara(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_portals.inmoalfaguara(PAYLOADS["inmoalfaguara"](data.active(spark, sf_dir))).select(*_COLUMNS, "admin", "estrato")


@payloads("properati")
def properati_payloads(rows: DataFrame) -> DataFrame:
    street = "concat_ws(', ', conjunto, 'Calle 5 # 3', barrio, city, 'Valle del Cauca', 'Colombia')"
    item = f"named_struct('c', concat('<div class=\"snippet__content\"><a class=\"snippet__title\" href=\"/d/', source_listing_id, '\">Casa en Arriendo en ', upper(city), '</a><span class=\"snippet__price\">', coalesce({_PRICE_TEXT}, ''), '</span></div>'), 'ld', named_struct('address', named_struct('streetAddress', {street}, 'addressLocality', city), 'numberOfBedrooms', bedrooms, 'floorSize', named_struct('value', area_m2), 'geo', named_struct('latitude', lat, 'longitude', lng)))"
    body = "concat('<script type=\"application/ld+json\">', to_json(named_struct('@type', 'SearchResultsPage', 'about', items.ld)), '</script>', array_join(items.c, ''))"
    return pages_of(rows, "properati", item, body)


@query("source_properati", oracle(f"source_listing_id, {_BARRIO} AS barrio, city, area_m2, bedrooms, price, lng, conjunto", "source_listing_id <> ''").replace("conjunto FROM", "CASE WHEN conjunto IS NOT NULL THEN upper(substr(conjunto, 1, 1)) || lower(substr(conjunto, 2, 7)) || ' ' || substr(conjunto, 10, 1) || lower(substr(conjunto, 11)) END AS conjunto FROM"))
def source_properati(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_portals.properati(PAYLOADS["properati"](data.active(spark, sf_dir))).select(*_COLUMNS, "lng", "conjunto")


@payloads("naranjoduque")
def naranjoduque_payloads(rows: DataFrame) -> DataFrame:
    rows = rows.where("barrio is not null")
    props = "to_json(map('1 TIPO DE BÚSQUEDA', if(bigint(source_listing_id) % 3 = 0, 'Venta', 'Arriendo'), '2 TIPO DE INMUEBLE', 'Casa campestre', '3 CIUDAD', city, '5 BARRIO', barrio, '6 ALCOBAS', coalesce(string(bedrooms), '')))"
    ficha = f"concat('id_user:\"CÓDIGO ', source_listing_id, '\",description:\"CASA <br />Baños 2\",href=\"<!--base_url_placeholder-->c-', source_listing_id, '.html\",properties:', {props}, ',schemaOrg:{{', coalesce(concat('\"@type\":\"Offer\",priceCurrency:\"COP\",price:\"', bigint(price), '\"'), ''), '}}')"
    catalogue = pages_of(rows, "naranjoduque", ficha, "concat('var x=[', array_join(items, ','), ']')")
    details = detail_pages(rows, "naranjoduque", "concat('https://www.inmobiliarianaranjoduque.com/c-', source_listing_id, '.html')", "concat('<b>', coalesce(concat(area_m2, 'm²'), ''), '</b> Estrato: ', coalesce(string(estrato), 'x'))")
    return catalogue.unionByName(details)


@query("source_naranjoduque", oracle(f"source_listing_id, {_BARRIO} AS barrio, city, area_m2, bedrooms, price, estrato", "barrio IS NOT NULL AND city <> 'Palmira' AND CAST(source_listing_id AS BIGINT) % 3 <> 0"))
def source_naranjoduque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_portals.naranjoduque(PAYLOADS["naranjoduque"](data.active(spark, sf_dir))).select(*_COLUMNS, "estrato")


# Which adverts each source shows, and what it asks for those without a price; each advert is read from all thirteen.
_READ = {
    "bienco": "source_listing_id <> '0'", "fincaraiz": "true", "ciencuadras": "true", "properati": "true", "rentola": "barrio IS NOT NULL AND city <> 'Palmira'", "inmobiliariajr": "bedrooms IS NOT NULL AND CAST(source_listing_id AS BIGINT) % 3 <> 0",
    "inmoalfaguara": "barrio IS NOT NULL", "naranjoduque": "barrio IS NOT NULL AND city <> 'Palmira' AND CAST(source_listing_id AS BIGINT) % 3 <> 0", "elpaisfincaraiz": "true", "mitula": "true", "metrocuadrado": "true", "arriendo": "barrio IS NOT NULL",
    "century21": "city IN ('Cali', 'Jamundí') AND CAST(source_listing_id AS BIGINT) % 2 = 0",
}


@query("all_sources", f"WITH {LISTINGS_CTE} " + " UNION ALL ".join(f"SELECT '{s}' AS source, count(*) AS n, sum(price) + {'count(*) FILTER (price IS NULL)' if s == 'century21' else '0'} AS total, count(area_m2) {'+ count(*) FILTER (area_m2 IS NULL)' if s == 'bienco' else ''} AS areas, count(bedrooms) AS bedrooms FROM active WHERE {w}" for s, w in _READ.items()))
def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all thirteen sources in one table, read and written once, by normalize_all."""
    from ..sources.registry import normalize_all
    from ..staging import staged

    rows = staged(data.active(spark, sf_dir).repartition("source_listing_id"), "every-advert")
    every = reduce(DataFrame.unionByName, (f(rows) for f in PAYLOADS.values()))
    return normalize_all(every).groupBy("source").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.count("area_m2").alias("areas"), F.count("bedrooms").alias("bedrooms"))


@query("crawl_details", f"""WITH {LISTINGS_CTE}, d AS (SELECT *, CAST(source_listing_id AS BIGINT) % 3 = 0 AS told FROM active)
SELECT source_listing_id, price, CASE WHEN told THEN admin END AS admin, CASE WHEN told THEN coalesce(estrato % 6 + 1, estrato) ELSE estrato END AS estrato, coalesce(CASE WHEN told THEN agency END, 'A & "B" {{<>}}') AS agency, is_active FROM d""")
def crawl_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl whose adverts are completed by their own pages, of which every third has one, some fetched twice."""
    from ..schemas import SNAPSHOT
    from .entries import ingest

    rows = data.active(spark, sf_dir)
    told = rows.where("bigint(source_listing_id) % 3 = 0")
    blob = "to_json(named_struct('generalData', named_struct('adminValue', string(bigint(admin)), 'stratum', string({})), 'dataStrip', named_struct('realStateName', agency)))"
    coded = lambda e: f"concat('<script>{{&q;detail&q;:', replace(replace({blob.format(e)}, '&', '&a;'), '\"', '&q;'), '}}</script>')"
    url = "concat('https://www.ciencuadras.com/inmueble/casa-', source_listing_id)"
    pages = detail_pages(told, "ciencuadras", url, coded("estrato % 6 + 1"))
    stale = detail_pages(told.where("bigint(source_listing_id) % 2 = 0"), "ciencuadras", url, coded("7 - estrato")).withColumn("fetched_at", F.expr("timestamp '2024-06-01 00:00:00'"))
    details = json_portals.ciencuadras_details(pages.unionByName(stale))
    done = ingest(PAYLOADS["ciencuadras"](rows), spark.createDataFrame([], SNAPSHOT), only=["ciencuadras"], details=details)
    return done.snapshot.select("source_listing_id", "price", "admin", "estrato", "agency", "is_active")


_REGISTERED = ", ".join(f"('{s.id}', '{s.tier}', '{s.domain}')" for s in registry.SOURCES)
_SOURCE_OF = ", ".join(f"'{s.id}'" for s in registry.SOURCES[:11])


@query("sources_counted", f"WITH {LISTINGS_CTE}, r(id, tier, domain) AS (VALUES {_REGISTERED}), c AS (SELECT [{_SOURCE_OF}][1 + CAST(source_listing_id AS BIGINT) % 11] AS id, count(*) AS n FROM active GROUP BY 1) SELECT id, tier, domain, coalesce(n, 0) AS n FROM r LEFT JOIN c USING (id)")
def sources_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with the adverts of each source; two have none."""
    from ..operators.merge import counts_by_source

    table = registry.registry_table(spark)
    rows = data.active(spark, sf_dir).withColumn("source", F.expr(f"array({_SOURCE_OF})[bigint(source_listing_id) % 11]"))
    counts = counts_by_source(rows, table).withColumnRenamed("source", "id")
    return table.join(counts, "id").select("id", "tier", "domain", "n")


@query("user_list", f"""WITH {LISTINGS_CTE}, n AS (SELECT *, row_number() OVER (ORDER BY CAST(source_listing_id AS BIGINT)) AS k FROM active)
SELECT CASE WHEN CAST(source_listing_id AS BIGINT) % 2 = 0 THEN url ELSE 'row-' || source_listing_id END AS source_listing_id, barrio, city, area_m2, price FROM n WHERE area_m2 IS NOT NULL OR price IS NOT NULL""")
def user_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.userlist import listings_from_list

    n = F.col("source_listing_id").cast("bigint")
    rows = data.active(spark, sf_dir).select(n.alias("n"), F.col("barrio").alias("Sector"), F.concat(F.col("area_m2").cast("int").cast("string"), F.lit(" m2")).alias("Área (m2)"), F.expr(_PRICE_TEXT).alias("CANON"), F.when(n % 2 == 0, F.col("url")).otherwise("no link").alias("Enlace"), F.col("city").alias(" Ciudad "), F.lit("x").alias("Notas"))
    return listings_from_list(rows).select("source_listing_id", "barrio", "city", "area_m2", "price")


@query("user_list_read", f"""WITH {LISTINGS_CTE}, n AS (SELECT *, row_number() OVER (ORDER BY CAST(source_listing_id AS BIGINT)) AS k, CAST(source_listing_id AS BIGINT) AS i FROM active)
SELECT CASE WHEN i % 2 = 0 THEN url ELSE 'row-' || k END AS source_listing_id, CASE i % 4 WHEN 0 THEN 'Torre "' || i || '", etapa' || chr(10) || trim('dos; ' || coalesce(barrio, '')) WHEN 1 THEN 'Casa; ' || i || chr(10) || chr(10) || 'fin' ELSE barrio END AS barrio, city, area_m2, price FROM n WHERE i % 7 <> 3 AND (area_m2 IS NOT NULL OR price IS NOT NULL)""")
def user_list_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same adverts written as a list whose cells hold separators, quotes and line breaks, with blank lines between, and read
    back; every seventh record has no area and no price."""
    from ..sources.userlist import listings_from_list, read_list
    from ..staging import new_folder

    n = F.col("source_listing_id").cast("bigint")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    barrio = F.when(n % 4 == 0, F.concat(F.lit('Torre "'), n.cast("string"), F.lit('", etapa\ndos; '), F.coalesce("barrio", F.lit("")))).when(n % 4 == 1, F.concat(F.lit("Casa; "), n.cast("string"), F.lit("\n\nfin"))).otherwise(F.col("barrio"))
    none = n % 7 == 3
    cells = [quoted(barrio), F.when(~none, F.concat(F.col("area_m2").cast("int").cast("string"), F.lit(" m2"))), F.when(~none, F.expr(_PRICE_TEXT)), F.when(n % 2 == 0, F.col("url")).otherwise("no link"), quoted(F.col("city")), F.lit("x y")]
    line = F.concat(*(x for c in cells for x in (F.coalesce(c, F.lit("")), F.lit(";"))), F.when(n % 5 == 0, "\n   ").otherwise(""))
    rows = data.active(spark, sf_dir).select(n.alias("k"), line.alias("line"))
    head = spark.createDataFrame([(-1, 'Sector;"Área\n(m2)";CANON;Enlace; Ciudad ;"Notas; varias";')], "k bigint, line string")
    at = new_folder(spark, "user-list")
    head.unionByName(rows).orderBy("k").select("line").write.text(at)
    return listings_from_list(read_list(spark, at)).select("source_listing_id", "barrio", "city", "area_m2", "price")


@query("user_list_warnings", f"""WITH {LISTINGS_CTE}, n AS (SELECT *, row_number() OVER (ORDER BY CAST(source_listing_id AS BIGINT)) AS k, CAST(source_listing_id AS BIGINT) AS i FROM active)
SELECT 'CSV: malformed line (row ' || k || ')' AS warning FROM n WHERE i % 5 = 2 ORDER BY k LIMIT 3""")
def user_list_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of a list in which every fifth record has a cell too many."""
    from ..sources.userlist import list_warnings, listings_from_list, read_list
    from ..staging import new_folder

    n = F.col("source_listing_id").cast("bigint")
    line = F.concat(F.lit('"a\tb\nc"\t'), F.col("area_m2").cast("string"), F.when(n % 5 == 2, "\tmore").otherwise(""))
    rows = data.active(spark, sf_dir).select(n.alias("k"), F.coalesce(line, F.when(n % 5 == 2, "x\t\t").otherwise("x\t")).alias("line"))
    at = new_folder(spark, "user-list")
    spark.createDataFrame([(-1, "Barrio\tm2")], "k bigint, line string").unionByName(rows).orderBy("k").select("line").write.text(at)
    found = read_list(spark, at)
    return list_warnings(found, listings_from_list(found))


@query("json_ld_by_type", f"WITH {LISTINGS_CTE} SELECT source_listing_id, city FROM active WHERE CAST(source_listing_id AS BIGINT) % 4 < 3")
def json_ld_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.extract import first_of_type, json_ld_nodes

    node = "to_json(named_struct('@type', 'House', 'id', source_listing_id, 'city', city))"
    body = f"concat('<script type=\"application/ld+json\">', case bigint(source_listing_id) % 4 when 0 then {node} when 1 then concat('{{\"@type\":\"A\"}} ', {node}) when 2 then concat('[{{\"@graph\":[', {node}, ']}}]') else '{{broken' end, '</script>')"
    nodes = json_ld_nodes(detail_pages(data.active(spark, sf_dir), "x", "url", body))
    found = first_of_type(nodes, "house")
    return found.select(F.get_json_object("node", "$.id").alias("source_listing_id"), F.get_json_object("node", "$.city").alias("city"))


@query("sitemap_links", f"WITH {LISTINGS_CTE} SELECT DISTINCT url AS loc FROM active WHERE city <> 'Cali'")
def sitemap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.extract import child_sitemaps

    maps = pages_of(data.active(spark, sf_dir), "x", "concat('<loc> ', url, ' </loc>')", "array_join(items, '')")
    index = maps.groupBy(F.lit("index").alias("url")).agg(F.array_join(F.transform(F.collect_list("url"), lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>"))), "").alias("body"))
    return child_sitemaps(maps.select("url", "body").unionByName(index), r"/(Jamundí|Palmira)$")
