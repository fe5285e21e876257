"""Sources whose payloads are pages: repeated cards, label lists, JSON-LD, slugs and script variables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import once, settled
from ..functions.text import area, estrato, first_int, norm, number, phone, positive, price
from ..functions.urls import absolutize, safe_site_url
from ..operators.extract import canonical, cards, catalogue_blocks, decoded_link, first_node, labelled_values, map_items, map_pages, meta_tags, strip_tags, title, zipped
from ..schemas import as_listing, missing
from .json_portals import located, shown, trimmed


def _kept(listings: DataFrame) -> DataFrame:
    return listings.where("source_listing_id is not null and source_listing_id <> '' and url is not null and url <> ''")


def _get(m: str, key: str) -> Column:
    return missing(F.try_element_at(F.col(m), F.lit(key)))


def _found(s: Column, pattern: str, group: int = 1) -> Column:
    return once(F.regexp_extract(s, pattern, group), missing)


# How a street, rather than a district, begins.
_STREET = r"(?i)\d|^(calle|carrera|cra\.?|cl\.?|av\.?|avenida|cr\.?|kr\.?|diagonal|dg\.?|transversal|tv\.?|autopista)\b|^conjunto\b"


def address_parts(street: Column, city: Column) -> tuple[Column, Column]:
    """(barrio, conjunto) of "[Conjunto X,] [street,] [barrio,] city, region, country"."""
    parts = F.filter(F.transform(F.split(street, ","), lambda p: F.btrim(p)), lambda p: p != "")
    conjunto = F.get(F.filter(parts, lambda p: p.rlike(r"(?i)^conjunto\b")), F.lit(0))
    known = lambda here: F.array(F.lit("colombia"), F.lit("col"), F.lit("valle del cauca"), here)
    inner = once(norm(city), lambda here: F.filter(parts, lambda p: ~F.array_contains(known(here), norm(p))))
    last = F.try_element_at(inner, F.lit(-1))
    return once(last, lambda p: F.when(~p.rlike(_STREET), shown(p))), shown(conjunto)


_ABOUT = "array<struct<name:string,numberOfBedrooms:string,numberOfBathroomsTotal:string,address:struct<streetAddress:string,addressLocality:string>,floorSize:struct<value:string>,geo:struct<latitude:string,longitude:string>>>"


def _cards_and_items(payloads: DataFrame, card_class: str) -> DataFrame:
    """url, city, item and ld: the cards of each page, each with the JSON-LD item of its place in the page's result list."""
    pages = payloads.withColumn("node", first_node(F.col("body"), "SearchResultsPage"))
    found = map_items(pages, partial(cards, card_class=card_class), "map<string,string>", ("url", "city", "node"))
    about = F.coalesce(F.from_json("node", f"about {_ABOUT}")["about"], F.array().cast(_ABOUT))
    return zipped(found, about)


def properati(payloads: DataFrame) -> DataFrame:
    """Cards, each with the JSON-LD item of its place; the card's values first."""
    x = _cards_and_items(payloads, "snippet__content")
    c = F.col
    x = settled(x.withColumn("href", _get("item", "href")), link=absolutize(c("href"), F.lit("https://www.properati.com.co/")), name=F.coalesce(_get("item", ".snippet__title"), _get("item", "@title")))
    url, name = c("link"), c("name")
    x = settled(x, ident=F.coalesce(_found(url, r"/([0-9a-f]{8}-[0-9a-f-]{20,})"), _found(url, r"([^/?#]+)/?(?:[?#].*)?$")))
    street = c("ld.address.streetAddress")
    in_title = once(_found(name, r"(?i)\barriendo\s+en\s+(.+)$"), lambda t: F.when(norm(t) != norm(c("city")), shown(t)))
    barrio, conjunto = address_parts(street, c("city"))
    return _kept(as_listing(
        x, source=F.lit("properati"), source_listing_id=c("ident"), url=url, title=F.coalesce(name, c("ld.name")),
        barrio=F.coalesce(in_title, barrio), conjunto=conjunto, city=F.coalesce(trimmed(c("ld.address.addressLocality")), shown(c("city"))), address=trimmed(street), **located(number(c("ld.geo.latitude")), number(c("ld.geo.longitude"))),
        area_m2=F.coalesce(area(_get("item", ".area-value")), positive(number(c("ld.floorSize.value")))), bedrooms=F.coalesce(first_int(_get("item", ".bedrooms-value")), first_int(c("ld.numberOfBedrooms"))),
        bathrooms=F.coalesce(first_int(_get("item", ".full-bathrooms-value")), first_int(c("ld.numberOfBathroomsTotal"))), price=price(_get("item", ".snippet__price")), agency=_get("item", ".agency-name"), raw_json=F.to_json(F.struct("item", "ld")),
    ))


# Paths that the site's robots file keeps out.
BANNED_PATHS = ("/api/events", "/ads-map/", "/api/")


def allowed(url: Column, banned: tuple[str, ...] = BANNED_PATHS) -> Column:
    out = F.lit(True)
    for path in banned:
        out = out & ~F.contains(url, F.lit(path))
    return out


def rentola(payloads: DataFrame) -> DataFrame:
    """Detail pages: JSON-LD of the advert, the slug's city, district and id, and the panel's text."""
    pages = payloads.where(allowed(F.col("url"))).select("url", "body", first_node(F.col("body"), "RealEstateListing").alias("node"))
    schema = "name string, url string, offers struct<price:string,itemOffered:struct<address:struct<streetAddress:string,addressLocality:string>,geo:struct<latitude:string,longitude:string>,floorSize:struct<value:string>,numberOfBedrooms:struct<value:string>,numberOfBathroomsTotal:struct<value:string>,numberOfBathrooms:struct<value:string>>>"
    x = pages.withColumn("ld", F.from_json("node", schema))
    x = settled(x, slug=_found(F.regexp_replace("url", r"[?#].*$|/+$", ""), r"([^/]+)$"))
    c = F.col
    text = strip_tags(c("body"))  # not settled, as most adverts ask for it once, or never
    house = c("ld.offers.itemOffered")
    tail = r"\d{1,3}(?:-\d{3})+-p[0-9a-f]+$"  # fixed value: how the site ends its slugs
    x = settled(x, ident=F.coalesce(_found(c("slug"), rf"(?i)-(\d+)-{tail}"), _found(c("slug"), r"(?i)-p([0-9a-f]+)$")), link=F.coalesce(missing(c("ld.url")), c("url")))
    city = F.lower(_found(c("slug"), r"(?i)-en-(cali|jamundi)\b"))
    barrio = F.replace(_found(c("slug"), rf"(?i)-en-(?:cali|jamundi)-en-(.+?)-\d{{1,7}}-{tail}"), F.lit("-"), F.lit(" "))
    return _kept(as_listing(
        x, source=F.lit("rentola"), source_listing_id=c("ident"), url=c("link"), title=trimmed(c("ld.name")), barrio=shown(barrio), city=F.coalesce(shown(city), trimmed(house["address"]["addressLocality"])),
        address=trimmed(house["address"]["streetAddress"]), **located(number(house["geo"]["latitude"]), number(house["geo"]["longitude"])), area_m2=F.coalesce(positive(number(house["floorSize"]["value"])), area(_found(text, r"(?i)(\d+(?:[.,]\d+)?)\s*m(?:²|2)"))),
        bedrooms=F.coalesce(first_int(house["numberOfBedrooms"]["value"]), first_int(_found(text, r"(?i)(\d+)\s*(?:habitaci|alcoba|dormitorio)"))), bathrooms=first_int(F.coalesce(house["numberOfBathroomsTotal"]["value"], house["numberOfBathrooms"]["value"])),
        parking=F.when(text.rlike(r"(?i)\b(?:parqueadero|estacionamiento|garaje)\b"), 1), price=price(F.regexp_replace(c("ld.offers.price"), r"\.0$", "")), raw_json=F.coalesce("node", F.to_json(F.struct("url", "slug"))),
    ))


def _labels(payloads: DataFrame, *carry: str) -> DataFrame:
    """carry... and labels: each page with the map of its label list."""
    found = map_items(payloads, lambda page: [labelled_values(page)], "map<string,string>", carry)
    return found.withColumn("labels", F.get("items", F.lit(0))).drop("items")


def inmoalfaguara(payloads: DataFrame) -> DataFrame:
    """Detail pages: label list, JSON-LD of the house, price in the page's title tag, place in the slug. Agency and phone are the site's."""
    pages = settled(payloads.select("url", "body"), og=F.coalesce(_get_meta("og:title"), F.lit("")), node=first_node(F.col("body"), "House"))
    asked = price(F.when(F.contains("og", F.lit("$")), F.substring_index("og", "$", -1)))
    pages = settled(pages, asked=F.coalesce(asked, price(_found(strip_tags(F.col("body")), r"(?i)Precio de alquiler\s*\$?\s*([\d.,]+)"))))
    x = _labels(pages, "url", "node", "og", "asked")
    x = x.withColumn("ld", F.from_json("node", "url string, name string, address string, geo struct<latitude:string,longitude:string>, numberOfRooms string, telephone string"))
    x = x.withColumn("toks", F.split(F.coalesce(_found(F.col("url"), r"://[^/]+/(?:[^?#]*/)?([^/?#]+)/[^/?#]+/?$"), F.lit("")), "-"))
    c = F.col
    middle = F.when(F.size("toks") > 3, F.array_join(F.slice("toks", 3, F.size("toks") - 3), " "))
    slug_city = F.when(F.size("toks") >= 3, F.element_at("toks", -1))
    zone = F.coalesce(_get("labels", "zona / barrio"), _get("labels", "barrio"))
    x = settled(x, ident=F.coalesce(_found(c("url"), r"/(\d+)/?$"), _found(_get("labels", "codigo"), r"(\d+)")), link=F.coalesce(F.when(F.startswith("ld.url", F.lit("http")), c("ld.url")), c("url")))
    return _kept(as_listing(
        x, source=F.lit("inmoalfaguara"), source_listing_id=c("ident"), url=c("link"),
        title=F.coalesce(trimmed(c("ld.name")), trimmed(F.substring_index("og", " - $", 1))), barrio=F.coalesce(shown(zone), shown(middle)), conjunto=F.when(middle.rlike("conjunto|residencial|condominio"), shown(middle)),
        city=F.coalesce(shown(_get("labels", "ciudad")), shown(slug_city)), address=trimmed(c("ld.address")), **located(number(c("ld.geo.latitude")), number(c("ld.geo.longitude"))),
        area_m2=F.coalesce(*(area(_get("labels", k)) for k in ("area construida", "area privada", "area terreno"))), bedrooms=F.coalesce(first_int(_get("labels", "alcobas")), first_int(c("ld.numberOfRooms"))), bathrooms=first_int(_get("labels", "banos")),
        parking=first_int(_get("labels", "garaje")), price=c("asked"),
        admin=price(_get("labels", "administracion")), estrato=estrato(first_int(_get("labels", "estrato"))), agency=F.lit("Inmobiliaria Alfaguara"), phone=phone(c("ld.telephone")), has_whatsapp=F.lit(True), raw_json=F.to_json(F.struct("url", "labels", "og")),
    ))


def _get_meta(name: str) -> Column:
    return missing(F.try_element_at(meta_tags(F.col("body")), F.lit(name)))


def naranjoduque(payloads: DataFrame, property_type: str = "casa", cities: tuple[str, ...] = ("cali", "jamundi")) -> DataFrame:
    """A catalogue script cut at each advert, joined with the adverts' detail pages among the payloads for area and estrato. Rentals only."""
    c = F.col
    base = F.lit("https://www.inmobiliarianaranjoduque.com/")
    marker = 'id_user:"CÓDIGO'
    # Catalogue pages are dealt afresh: their files, the largest among many small ones, are read by the same few tasks.
    catalogue = payloads.where(F.contains("body", F.lit(marker))).select("url", "body").repartition("url")
    blocks = catalogue.select(F.explode(catalogue_blocks(c("body"), marker)).alias("b"))
    props = F.from_json(F.regexp_extract("b", r"properties:(\{.*?\})\s*,\s*schemaOrg", 1), "map<string,string>")
    x = settled(settled(blocks, p=props).where("p is not null"), kind=norm(_get("p", "2 TIPO DE INMUEBLE")), deal=norm(_get("p", "1 TIPO DE BÚSQUEDA")), place=norm(_get("p", "3 CIUDAD")))
    kind, deal, city = c("kind"), c("deal"), c("place")
    of_kind = F.contains(kind, F.lit("casa")) if property_type == "casa" else F.contains(kind, F.lit("apartamento")) | F.contains(kind, F.lit("apartaestudio"))
    x = x.where((F.contains(deal, F.lit("arriendo")) | F.contains(deal, F.lit("alquiler"))) & of_kind & F.exists(F.array(*map(F.lit, cities)), lambda w: F.contains(city, w)))
    offer = r'"@type":"Offer"[^}]*priceCurrency:"([A-Z]+)",price:"([^"]+)"'
    x = settled(x, code=_found(c("b"), r'id_user:"CÓDIGO\s*(\d+)'), link=absolutize(_found(c("b"), r'href="<!--base_url_placeholder-->([^"]+?)"'), base))
    x = x.withColumn("said", F.regexp_extract("b", r'description:"((?:[^"\\]|\\.)*)"', 1)).withColumn("offer", F.when(F.regexp_extract("b", offer, 1) == "COP", F.regexp_extract("b", offer, 2)))
    detail = payloads.groupBy(c("url").alias("link")).agg(F.max_by("body", F.struct("fetched_at", "body")).alias("b_"))
    x = x.join(detail, "link", "left").withColumn("t", strip_tags(c("b_")))  # only of adverts that are kept
    return _kept(as_listing(
        x, source=F.lit("naranjoduque"), source_listing_id=c("code"), url=c("link"), title=trimmed(F.substring_index("said", "<br", 1)), barrio=shown(F.coalesce(trimmed(_get("p", "5 BARRIO")), trimmed(_get("p", "4 ZONA")))), city=trimmed(_get("p", "3 CIUDAD")),
        area_m2=area(_found(c("t"), r"(\d+(?:[.,]\d+)?)\s*m²")), bedrooms=first_int(_get("p", "6 ALCOBAS")), bathrooms=first_int(_found(c("said"), r"Baños\s*:?\s*(\d+)")), price=F.coalesce(price(c("offer")), price(_found(c("t"), r"(?:Valor|Canon|Precio)\s*:?\s*\$?\s*([\d.,]+)"))),
        estrato=estrato(_found(c("t"), r"Estrato:\s*(\d)")), agency=F.lit("Inmobiliaria Naranjo Duque"), phone=F.lit("3241000095"), has_whatsapp=F.lit(True), raw_json=F.to_json(F.struct("p", "said")),
    ))


def elpaisfincaraiz(payloads: DataFrame) -> DataFrame:
    """Cards whose description holds rooms and an area with dots between thousands."""
    x = map_pages(payloads, partial(cards, card_class="flexArticle"), "map<string,string>")
    c = F.col
    x = settled(x, said=F.coalesce(_get("item", ".description"), F.lit("")), head=_get("item", ".label-list"), href=_get("item", "href"))
    x = settled(x, link=absolutize(c("href"), F.lit("https://fincaraiz.elpais.com.co/")))
    x = settled(x, ident=_found(c("link"), r"(\d+)(?:[/?#.]|$)"))
    said, url, head = c("said"), c("link"), c("head")
    where = _found(head, r"(?i)Alquiler\s+en\s+(.+)$")
    size = once(_found(said, r"(?i)([\d.,]+)\s*mts?2"), lambda s: F.when(F.contains(s, F.lit(",")), F.replace(s, F.lit("."), F.lit(""))).otherwise(s))
    called = phone(F.coalesce(_get("item", "data-phone"), _get("item", ".wasa"), _get("item", ".call")))
    return _kept(as_listing(
        x, source=F.lit("elpaisfincaraiz"), source_listing_id=c("ident"), url=url, title=head, barrio=once(where, lambda w: F.when(norm(w) != norm(c("city")), shown(w))), city=c("city"), area_m2=area(size),
        bedrooms=first_int(_found(said, r"(?i)(\d+)\s*alcoba")), bathrooms=first_int(_found(said, r"(?i)(\d+)\s*ba[ñn]o")), price=price(_get("item", ".price")), phone=called, has_whatsapp=F.try_element_at("item", F.lit(".wasa")).isNotNull(), raw_json=F.to_json("item"),
    ))


def mitula(payloads: DataFrame) -> DataFrame:
    """Cards with data attributes, each with the JSON-LD item of its place; links are base64."""
    x = _cards_and_items(payloads, "listing-card")
    c = F.col
    barrio, district = _get("item", "data-neighbourhood"), _get("item", "data-district")
    coded = _get("item", "data-clickdestination")
    x = settled(x, clear=F.decode(F.try_to_binary(coded, F.lit("base64")), "UTF-8"))
    x = settled(x, link=F.coalesce(decoded_link(coded, absolutize(c("clear"), F.lit("https://casas.mitula.com.co/"))), c("url")), ident=F.coalesce(_get("item", "data-listingid"), _get("item", "data-pageviewid")))
    dated = _get("item", ".published-date-and-agency")
    return _kept(as_listing(
        x, source=F.lit("mitula"), source_listing_id=c("ident"), url=c("link"), title=F.coalesce(trimmed(c("ld.name")), missing(F.concat_ws(", ", shown(barrio), shown(district)))), barrio=shown(barrio),
        city=_get("item", "data-city"), address=trimmed(c("ld.address.streetAddress")), **located(number(c("ld.geo.latitude")), number(c("ld.geo.longitude"))), area_m2=F.coalesce(area(_get("item", "data-floorarea")), area(c("ld.floorSize.value"))),
        bedrooms=first_int(_get("item", "data-rooms")), bathrooms=first_int(c("ld.numberOfBathroomsTotal")), price=price(_get("item", "data-price")), agency=trimmed(_found(dated, r"en -(.*)$")), raw_json=F.to_json(F.struct("item", "ld")),
    ))


def arriendo(payloads: DataFrame) -> DataFrame:
    """Detail pages: label list, script variables for phone and coordinates, place and id in the slug."""
    c = F.col
    part = lambda k: F.when(F.size("seg") >= 4, F.element_at("seg", -k))
    ident = F.coalesce(F.upper(_found(part(1), r"(?i)^(AR-\d+)$")), F.upper(_found(strip_tags(c("body")), r"(?i)C[oó]digo del inmueble:\s*(AR-\d+)")))
    # The names of the page's script variables.
    called = F.from_json(F.regexp_extract("body", r"ARX_PHONE_DATA\s*=\s*window\.ARX_PHONE_DATA\s*\|\|\s*(\{[^}]*\})", 1), "pc string, pw string, hw boolean")
    at = F.from_json(F.regexp_extract("body", r"(?s)arxPropertyLatLng\s*=\s*(\{.*?\});", 1), "lat double, lng double")
    digits = lambda s: F.when(s.rlike(r"\d{7,}"), s)
    inner = lambda pattern: once(strip_tags(F.regexp_extract("body", pattern, 1)), missing)
    asked = price(inner(r'(?is)class="[^"]*\bes-price\b[^"]*"[^>]*>(.*?)</(?:span|p|div|strong|h1)>'))
    fee = inner(r'(?is)es-price-container.*?<strong[^>]*>(.*?)</strong>')
    agency = inner(r'(?is)intro-info-agencia.*?<p[^>]*>(.*?)</p>')
    wa = digits(c("called.pw"))
    # What is asked of the page behind Python is searched for only where a query takes it; the page is handed back for that.
    x = _labels(payloads.select("url", "body"), "url", "body")
    x = x.withColumn("seg", F.filter(F.split(F.regexp_replace("url", r"^[a-z]+://[^/]+|[?#].*$", ""), "/"), lambda s: s != ""))
    x = settled(x, ident=ident).withColumns({"called": called, "at": at, "fee": fee, "agency": agency})
    return _kept(as_listing(
        x, source=F.lit("arriendo"), source_listing_id=c("ident"), url=c("url"), title=inner(r"(?is)<h1[^>]*>(.*?)</h1>"), barrio=F.coalesce(shown(_get("labels", "barrio")), shown(F.replace(part(2), F.lit("-"), F.lit(" ")))),
        city=shown(part(3)), lat=c("at.lat"), lng=c("at.lng"), geocode_precision=F.when(c("at.lat").isNotNull() & c("at.lng").isNotNull(), "source"), area_m2=area(_get("labels", "area, m²")), bedrooms=first_int(_get("labels", "habitaciones")),
        bathrooms=first_int(_get("labels", "banos")), parking=first_int(_get("labels", "parqueaderos")), price=asked, admin=F.when(~c("fee").rlike("(?i)no disponible"), price(c("fee"))), estrato=estrato(first_int(_get("labels", "estrato"))),
        agency=F.when(~c("agency").rlike("(?i)no asignada"), c("agency")), phone=F.coalesce(wa, digits(c("called.pc"))), has_whatsapp=F.coalesce(c("called.hw") & wa.isNotNull(), F.lit(False)), raw_json=F.to_json(F.struct("url", "labels")),
    ))


#: Rents above this are sale prices.
MOST_RENT = 50_000_000


def century21(payloads: DataFrame, property_types: tuple[str, ...] = ("casa",), cities: tuple[str, ...] = ("cali", "jamundi"), agencies: DataFrame | None = None) -> DataFrame:
    """Detail pages by their meta tags; rentals of the wanted types and cities. agencies(url, agency, phone) adds whose they are."""
    c = F.col
    # Fixed value: the form of the site's titles.
    deal = r"(?i)^(renta|venta)\s+de\s+([a-zñáéíóú]+)\s+en\b"
    rent = (norm(F.regexp_extract("t", deal, 1)) == "renta") & norm(F.regexp_extract("t", deal, 2)).isin(*property_types)
    x = settled(payloads.select("url", "body"), t=title(c("body"))).where(rent)  # only of these the tags are read
    x = settled(x, m=meta_tags(c("body")), own=safe_site_url(canonical(c("body")), "century21colombia.com")).drop("body")
    city = F.coalesce(_get("m", "municipio"), trimmed(_found(c("t"), r"\ben\s+[^,]+,\s*([^,]+),")))
    ident = F.coalesce(_found(c("url"), r"/propiedad/(\d+)_?"), first_int(_get("m", "clave")).cast("string"))
    x = settled(x, place=city, amount=first_int(_get("m", "precio")).cast("double"), ident=ident, link=F.coalesce("own", "url"))
    amount = c("amount")
    x = x.where(norm(c("place")).isin(*cities) & (amount.isNull() | (amount <= MOST_RENT)))
    if agencies is not None:
        phones = agencies.where("agency is not null").groupBy(norm(c("agency")).alias("_k")).agg(F.min("phone").alias("_phone"))
        own = agencies.groupBy("url").agg(F.min("agency").alias("_agency"))
        x = x.join(own, "url", "left").withColumn("_k", norm(c("_agency"))).join(phones, "_k", "left")
    else:
        x = x.withColumns({"_agency": F.lit(None).cast("string"), "_phone": F.lit(None).cast("string")})
    size = lambda k: positive(F.replace(_get("m", k), F.lit(","), F.lit(".")).try_cast("double"))
    return _kept(as_listing(
        x, source=F.lit("century21"), source_listing_id=c("ident"), url=c("link"), title=_get("m", "og:title"),
        barrio=shown(_get("m", "colonia")), city=shown(c("place")), area_m2=F.coalesce(size("MC"), size("MT")), bedrooms=first_int(_get("m", "recamaras")), bathrooms=first_int(_get("m", "banio")), parking=first_int(_get("m", "estacionamiento")), price=amount,
        currency=F.coalesce(_get("m", "moneda"), F.lit("COP")), agency=c("_agency"), phone=c("_phone"), raw_json=F.to_json(F.struct("url", "m")),
    ))
