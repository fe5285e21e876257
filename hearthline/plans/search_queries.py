"""Checked queries: stored listings, duplicates, filters, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, labels, text
from ..operators import dedup, filters, geocode, rank
from ..schemas import violations
from . import data
from .data import LISTINGS_CTE
from .registry import query
from .search import search

OPTIONS = rank.RankOptions(cities=("Cali", "jamundi"))

# Portable pieces of the oracles.
NORM = r"trim(regexp_replace(lower(strip_accents(coalesce({}, ''))), '\s+', ' ', 'g'))"
HAVERSINE = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(3.4516 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(3.4516)) * pow(sin(radians(-76.532 - lng) / 2), 2))))"
SLACK = "CASE geocode_precision WHEN 'rooftop' THEN 0 WHEN 'source' THEN 0.2 WHEN 'street' THEN 0.3 WHEN 'barrio_centroid' THEN 1.0 ELSE 4.0 END"
COMPLETE = "(CASE WHEN phone IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN 2 ELSE 0 END + CAST(area_m2 IS NOT NULL AS INT) + CAST(price IS NOT NULL AS INT) + CAST(barrio IS NOT NULL AS INT) + CAST(conjunto IS NOT NULL AS INT) + CAST(estrato IS NOT NULL AS INT) + CAST(agency IS NOT NULL AS INT))"
ZONES = ", ".join(f"'{z}'" for z in rank.SOUTHERN_ZONES)
_FIELDS = ("title", "barrio", "conjunto", "city", "address", "lat", "lng", "geocode_precision", "area_m2", "bedrooms", "bathrooms", "parking", "price", "admin", "estrato", "agency", "phone")


def merged_cte(source: str = "active") -> str:
    """CTEs `tagged` and `merged`: dedup of a relation, in DuckDB."""
    fields = ", ".join(f"arg_min({c}, row(-complete, source, source_listing_id)) FILTER ({c} IS NOT NULL) AS {c}" for c in _FIELDS)
    return f"""
tagged AS (SELECT *, {COMPLETE} AS complete, CASE WHEN lat IS NOT NULL AND lng IS NOT NULL
    THEN concat_ws('|', 'geo', CAST(floor(lat * 1000 + 0.5) AS BIGINT), CAST(floor(lng * 1000 + 0.5) AS BIGINT), coalesce(CAST(CAST(floor(price / 50000 + 0.5) AS BIGINT) AS STRING), '?'), coalesce(CAST(CAST(floor(area_m2 + 0.5) AS BIGINT) AS STRING), '?'), coalesce(CAST(bedrooms AS STRING), '?'))
    WHEN barrio IS NOT NULL OR conjunto IS NOT NULL
    THEN concat_ws('|', 'txt', {NORM.format("barrio")}, {NORM.format("conjunto")}, coalesce(CAST(CAST(floor(price / 50000 + 0.5) AS BIGINT) AS STRING), '?'), coalesce(CAST(CAST(floor(area_m2 + 0.5) AS BIGINT) AS STRING), '?'))
    ELSE concat_ws('|', 'uniq', source, source_listing_id) END AS sig FROM {source}),
merged AS (SELECT arg_min(source, row(-complete, source, source_listing_id)) AS source, arg_min(source_listing_id, row(-complete, source, source_listing_id)) AS source_listing_id, arg_min(url, row(-complete, source, source_listing_id)) AS url, {fields},
    bool_or(has_whatsapp) AS has_whatsapp, string_agg(DISTINCT source, '+' ORDER BY source) AS sources, string_agg(source || ' ' || url, ',' ORDER BY -complete, source, source_listing_id) AS links FROM tagged GROUP BY sig)"""


SEARCHED_CTE = f"""{LISTINGS_CTE}, chosen AS (SELECT * FROM active WHERE {NORM.format("city")} IN ('cali', 'jamundi')), {merged_cte("chosen")},
far AS (SELECT *, CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN {HAVERSINE} END AS distance_km,
    {NORM.format("city")} <> 'cali' OR ({NORM.format("barrio")} <> '' AND len(list_filter([{ZONES}], lambda z: contains({NORM.format("barrio")}, z) OR contains(z, {NORM.format("barrio")}))) > 0) AS in_zone FROM merged),
evaluated AS (SELECT *, CASE WHEN NOT in_zone THEN 'outside southern Cali' WHEN area_m2 IS NULL THEN 'missing area' WHEN area_m2 < 80 THEN 'area # < min #' WHEN price IS NULL OR price <= 0 THEN 'missing price'
    WHEN distance_km IS NULL THEN 'no location / distance' WHEN distance_km > 8 + {SLACK} THEN 'distance #km > max #km' END AS reason FROM far),
priced AS (SELECT *, (price + coalesce(admin, 0)) / area_m2 AS cost_per_m2 FROM evaluated WHERE reason IS NULL),
bounds AS (SELECT min(cost_per_m2) c0, max(cost_per_m2) c1, min(area_m2) a0, max(area_m2) a1, min(distance_km) d0, max(distance_km) d1 FROM priced),
scored AS (SELECT priced.*, (0.5 * CASE WHEN c1 <= c0 THEN 1 ELSE (c1 - cost_per_m2) / (c1 - c0) END + 0.3 * CASE WHEN a1 <= a0 THEN 1 ELSE (area_m2 - a0) / (a1 - a0) END + 0.2 * CASE WHEN d1 <= d0 THEN 1 ELSE (d1 - distance_km) / (d1 - d0) END) / (0.5 + 0.3 + 0.2) AS score FROM priced, bounds),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, source, source_listing_id) AS rank FROM scored)"""

R6 = lambda c: F.round(c, 6).alias(c)


def _searched(spark: SparkSession, sf_dir: str, options=OPTIONS):
    return search(data.listings(spark, sf_dir), options)


def _ranked(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    scored = _searched(spark, sf_dir).ranked.withColumn("score", F.round("score", 9))
    return rank.top(scored, n)


@query("scan_active", f"WITH {LISTINGS_CTE} SELECT source, count(*) AS n, sum(price) AS total_price FROM active GROUP BY source")
def scan_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.active(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("price").alias("total_price"))


@query("dedup", f"WITH {LISTINGS_CTE}, {merged_cte()} SELECT source, source_listing_id, url, {', '.join(_FIELDS)}, has_whatsapp, sources, links FROM merged")
def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = dedup.dedupe(data.active(spark, sf_dir))
    return merged.select("source", "source_listing_id", "url", *_FIELDS, "has_whatsapp", F.array_join("merged_sources", "+").alias("sources"), F.array_join(F.transform("source_links", lambda x: F.concat_ws(" ", x["source"], x["url"])), ",").alias("links"))


@query("dedup_signatures", f"WITH {LISTINGS_CTE}, {merged_cte()} SELECT split_part(sig, '|', 1) AS kind, count(*) AS n_listings, count(DISTINCT sig) AS n_groups FROM tagged GROUP BY 1")
def dedup_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = data.active(spark, sf_dir).groupBy(dedup.signature().alias("sig")).count()
    return groups.groupBy(F.col("sig.kind").alias("kind")).agg(F.sum("count").alias("n_listings"), F.count("*").alias("n_groups"))


_TOP = "source, source_listing_id, rank, barrio, city, area_m2, price, round(cost_per_m2, 6) AS cost_per_m2, round(distance_km, 6) AS distance_km, round(round(score, 9), 6) AS score"


@query("search_top", f"WITH {SEARCHED_CTE} SELECT {_TOP} FROM ranked WHERE rank <= 10")
def search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, 10).select("source", "source_listing_id", "rank", "barrio", "city", "area_m2", "price", R6("cost_per_m2"), R6("distance_km"), R6("score"))


@query("search_ranked", f"WITH {SEARCHED_CTE} SELECT {_TOP} FROM ranked")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _searched(spark, sf_dir).ranked.withColumn("score", F.round("score", 9))
    return rank.rank_all(scored.select("source", "source_listing_id", "barrio", "city", "area_m2", "price", R6("cost_per_m2"), R6("distance_km"), "score")).withColumn("score", F.round("score", 6))


@query("result_columns", f"WITH {SEARCHED_CTE} SELECT rank, round(score, 6) AS score, coalesce(CASE WHEN barrio IS NOT NULL OR conjunto IS NOT NULL THEN concat_ws(' / ', barrio, conjunto) END, address, '') AS place, city, area_m2, price, admin, round(cost_per_m2, 6) AS cost_per_m2, round(distance_km, 6) AS distance, bedrooms, estrato, sources AS source, CAST(NULL AS VARCHAR) AS verdict, url FROM ranked WHERE rank <= 40")
def result_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = filters.visible_columns(_ranked(spark, sf_dir, 40))
    return shown.withColumns({c: F.round(c, 6) for c in ("score", "cost_per_m2", "distance")})


@query("search_reasons", f"WITH {SEARCHED_CTE} SELECT reason, count(*) AS n FROM evaluated WHERE reason IS NOT NULL GROUP BY reason")
def search_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir).reasons


@query("search_stats", f"WITH {SEARCHED_CTE} SELECT count(*) AS input, count(distance_km) AS with_location, count(*) FILTER (in_zone) AS after_zone, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS dropped, CAST(0 AS BIGINT) AS driving_computed, greatest(1.0, max(CASE WHEN reason IS NULL THEN 0.5 END)) AS scale FROM evaluated")
def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _searched(spark, sf_dir)
    return found.stats.crossJoin(rank.best_score(found.ranked).select(F.round("best_score", 6).alias("scale")))


@query("bounded_reasons", f"""WITH {LISTINGS_CTE}, far AS (SELECT *, CASE WHEN lat IS NOT NULL THEN {HAVERSINE} END AS distance_km FROM active),
e AS (SELECT CASE WHEN area_m2 IS NULL THEN 'missing area' WHEN area_m2 < 60 THEN 'area # < min #' WHEN bedrooms < 3 THEN 'bedrooms # < min #' WHEN price IS NULL THEN 'missing price' WHEN price < 1000000 THEN 'price # < min #' WHEN price > 4000000 THEN 'price # > max #'
  WHEN distance_km IS NULL THEN 'no location / distance' WHEN distance_km > 12 + {SLACK} THEN 'distance #km > max #km' END AS reason FROM far)
SELECT reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY reason""")
def bounded_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rank.RankOptions(max_km=12, min_area=60, min_bedrooms=3, min_price=1e6, max_price=4e6, zone_filter=False)
    return rank.reasons(rank.evaluate(data.active(spark, sf_dir), o))


DRIVING = "SELECT DISTINCT lat AS dest_lat, lng AS dest_lng, {km} * 1.35 AS km, {km} * 2 AS min FROM active WHERE lat IS NOT NULL AND CAST(floor(lat * 1000 + 0.5) AS BIGINT) % 3 <> 0"


@query("driving_refined", f"""WITH {LISTINGS_CTE}, far AS (SELECT *, CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN {HAVERSINE} END AS km0 FROM active), driving AS ({DRIVING.format(km=f"({HAVERSINE})")}),
e AS (SELECT *, CASE WHEN area_m2 IS NULL THEN 'missing area' WHEN area_m2 < 80 THEN 'area # < min #' WHEN price IS NULL THEN 'missing price' WHEN km0 IS NULL THEN 'no location / distance' WHEN km0 > 8 + {SLACK} THEN 'distance #km > max #km' END AS r0 FROM far),
j AS (SELECT e.*, CASE WHEN r0 IS NULL THEN d.km END AS driving_km FROM e LEFT JOIN driving d ON lat = dest_lat AND lng = dest_lng)
SELECT CASE WHEN r0 IS NULL AND driving_km > 8 + {SLACK} THEN 'driving distance > max' ELSE r0 END AS reason, count(*) AS n, count(driving_km) AS driven, round(sum(coalesce(driving_km, km0)), 4) AS km FROM j GROUP BY 1""")
def driving_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rank.RankOptions(zone_filter=False)
    rows = data.active(spark, sf_dir)
    km = geo.haversine_km(F.col("lat"), F.col("lng"), o.lat, o.lng)
    driving = rows.where((F.col("lat").isNotNull()) & (F.floor(F.col("lat") * 1000 + 0.5) % 3 != 0)).select(F.lit(o.lat).alias("origin_lat"), F.lit(o.lng).alias("origin_lng"), F.col("lat").alias("dest_lat"), F.col("lng").alias("dest_lng"), (km * 1.35).alias("km"), (km * 2).alias("min")).distinct()
    driving = driving.unionByName(driving.withColumns({"origin_lat": F.lit(4.6), "km": F.col("km") / 10}))  # another point's answers
    e = rank.with_driving(rank.evaluate(rows, o), driving, o)
    return e.groupBy("reason").agg(F.count("*").alias("n"), F.count("driving_km").alias("driven"), F.round(F.sum("distance_km"), 4).alias("km"))


@query("column_filters", f"WITH {LISTINGS_CTE} SELECT source, source_listing_id, price, area_m2 FROM active WHERE price >= 1500000 AND price <= 2500000 AND area_m2 >= 100")
def column_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.column_filters(data.active(spark, sf_dir), {"price": "2.5M-1500k", "area": "100", "beds": "9"}).select("source", "source_listing_id", "price", "area_m2")


@query("user_sort", f"WITH {SEARCHED_CTE}, s AS (SELECT *, row_number() OVER (ORDER BY {NORM.format('city')} DESC, admin ASC NULLS LAST, rank) AS position FROM ranked WHERE rank <= 200) SELECT position, source, source_listing_id, city, admin FROM s WHERE position <= 50")
def user_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = filters.user_sort(_ranked(spark, sf_dir, 200).withColumn("driving_km", F.lit(None).cast("double")), [("city", "desc"), ("admin", "asc"), ("nothing", "asc")]).limit(50)
    listed = ordered.agg(F.collect_list(F.struct("source", "source_listing_id", "city", "admin")).alias("l"))  # 50 rows
    return listed.select(F.posexplode("l").alias("p", "x")).select((F.col("p") + 1).cast("bigint").alias("position"), "x.*")


@query("map_points", f"WITH {SEARCHED_CTE} SELECT rank, source, source_listing_id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM ranked WHERE lat IS NOT NULL ORDER BY rank LIMIT 50")
def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.map_points(_ranked(spark, sf_dir, 100), 50).select("rank", "source", "source_listing_id", R6("lat"), R6("lng"))


@query("violations", f"WITH {LISTINGS_CTE}, v AS (SELECT unnest(list_filter([CASE WHEN area_m2 - 45 <= 0 THEN 'area_m2' END, CASE WHEN price - 900000 <= 0 THEN 'price' END, CASE WHEN estrato + 1 > 6 THEN 'estrato' END, CASE WHEN geocode_precision = 'source' THEN 'geocode_precision' END], lambda x: x IS NOT NULL)) AS violation FROM active) SELECT violation, count(*) AS n FROM v GROUP BY 1")
def violations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bent = data.active(spark, sf_dir).withColumns({"area_m2": F.col("area_m2") - 45, "price": F.col("price") - 900000, "estrato": F.col("estrato") + 1, "geocode_precision": F.when(F.col("geocode_precision") == "source", "somewhere").otherwise(F.col("geocode_precision"))})
    return violations(bent).groupBy("violation").agg(F.count("*").alias("n"))


@query("number_parsing", f"""WITH {LISTINGS_CTE}, t AS (SELECT source_listing_id, '$ ' || CAST(CAST(price AS BIGINT) AS STRING) || '.000 COP' AS p, 'unos ' || replace(CAST(area_m2 + 0.5 AS STRING), '.', ',') || ' m2' AS a, 'tiene ' || CAST(bedrooms AS STRING) || ' alcobas' AS b,
  'llamar +57 ' || substr(phone, 1, 3) || ' ' || substr(phone, 4, 3) || '-' || substr(phone, 7) AS f, CAST(lat AS STRING) || ', ' || CAST(lng AS STRING) AS g FROM active)
SELECT source_listing_id, CAST(regexp_replace(p, '[^0-9]', '', 'g') AS DOUBLE) AS price, CAST(replace(regexp_extract(a, '(\\d+(?:[.,]\\d+)?)', 1), ',', '.') AS DOUBLE) AS area, CAST(regexp_extract(b, '-?\\d+') AS INT) AS beds,
  regexp_replace(regexp_extract(f, '(3\\d{{2}}[\\s-]?\\d{{3}}[\\s-]?\\d{{4}})', 1), '[\\s-]', '', 'g') AS phone, round(CAST(split_part(g, ', ', 1) AS DOUBLE), 6) AS lat FROM t""")
def number_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = data.active(spark, sf_dir).select(
        "source_listing_id",
        F.concat(F.lit("$ "), F.col("price").cast("bigint").cast("string"), F.lit(".000 COP")).alias("p"),
        F.concat(F.lit("unos "), F.replace((F.col("area_m2") + 0.5).cast("string"), F.lit("."), F.lit(",")), F.lit(" m2")).alias("a"),
        F.concat(F.lit("tiene "), F.col("bedrooms").cast("string"), F.lit(" alcobas")).alias("b"),
        F.concat(F.lit("llamar +57 "), F.substring("phone", 1, 3), F.lit(" "), F.substring("phone", 4, 3), F.lit("-"), F.substring("phone", 7, 9)).alias("f"),
        F.concat(F.col("lat").cast("string"), F.lit(", "), F.col("lng").cast("string")).alias("g"),
    )
    return t.select("source_listing_id", text.price(F.col("p")).alias("price"), text.area(F.col("a")).alias("area"), text.first_int(F.col("b")).alias("beds"), text.phone(F.col("f")).alias("phone"), F.round(geo.point(F.col("g"))["lat"], 6).alias("lat"))


@query("normalised_text", f"SELECT doc_id, md5({NORM.format('text')}) AS digest, length({NORM.format('text')}) AS n FROM documents")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = data.table(spark, sf_dir, "documents").select("doc_id", text.norm(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


@query("distances", f"WITH {LISTINGS_CTE} SELECT source_listing_id, CASE WHEN lat IS NOT NULL THEN round({HAVERSINE}, 6) END AS km, {SLACK} AS slack, coalesce(geocode_precision NOT IN ('source', 'rooftop'), false) AS approximate FROM active")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("geocode_precision")
    return data.active(spark, sf_dir).select("source_listing_id", F.round(geo.haversine_km(F.col("lat"), F.col("lng"), 3.4516, -76.532), 6).alias("km"), geo.slack_km(p).alias("slack"), labels.approximate(p).alias("approximate"))


# Geocoding: the cache holds the queries of every fourth district, some of them old.
_QUERY_SQL = f"""CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN NULL WHEN length({NORM.format('address')}) > 4 THEN address || ', ' || city || ', Valle del Cauca, Colombia'
  WHEN length({NORM.format('conjunto')}) > 2 THEN conjunto || coalesce(', ' || barrio, '') || ', ' || city || ', Valle del Cauca, Colombia'
  WHEN length({NORM.format('barrio')}) > 2 THEN barrio || ', ' || city || ', Valle del Cauca, Colombia' ELSE city || ', Valle del Cauca, Colombia' END"""
_PREC_SQL = f"CASE WHEN length({NORM.format('address')}) > 4 THEN 'street' WHEN length({NORM.format('conjunto')}) > 2 OR length({NORM.format('barrio')}) > 2 THEN 'barrio_centroid' ELSE 'city' END"
_GEO_CTE = f"""{LISTINGS_CTE}, asked AS (SELECT *, {NORM.format('q')} AS query FROM (SELECT *, {_QUERY_SQL} AS q, {_PREC_SQL} AS qp FROM active)),
cache AS (SELECT query, 3.4 + length(query) / 1000.0 AS clat, -76.5 - length(query) / 1000.0 AS clng, CASE WHEN length(query) % 2 = 0 THEN 'rooftop' ELSE 'city' END AS cp, CASE WHEN length(query) % 3 = 0 THEN 'google' ELSE 'manual' END AS provider, CASE WHEN length(query) % 4 = 0 THEN 60 ELSE 5 END AS age
  FROM (SELECT DISTINCT query FROM asked WHERE query <> '') WHERE length(query) % 5 <> 0)"""
NOW = "timestamp '2024-06-30 00:00:00'"


def _cache(rows: DataFrame) -> DataFrame:
    n = F.length("query")
    q = geocode.with_query(rows).select("query").where("query is not null").distinct().where(n % 5 != 0)
    return q.select("query", (F.lit(3.4) + n / 1000.0).alias("lat"), (F.lit(-76.5) - n / 1000.0).alias("lng"), F.when(n % 2 == 0, "rooftop").otherwise("city").alias("precision"), F.when(n % 3 == 0, "google").otherwise("manual").alias("provider"), F.lit(None).cast("string").alias("place_id"), F.when(n % 4 == 0, F.expr(f"{NOW} - interval 60 days")).otherwise(F.expr(f"{NOW} - interval 5 days")).alias("created_at"))


@query("geocode_fill", f"""WITH {_GEO_CTE} SELECT source_listing_id, round(coalesce(lat, clat), 6) AS lat, round(coalesce(lng, clng), 6) AS lng,
CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN coalesce(geocode_precision, 'source') WHEN cp = 'city' OR (cp IS NOT NULL AND qp = 'city') THEN 'city' WHEN cp IS NOT NULL THEN qp ELSE geocode_precision END AS geocode_precision FROM asked LEFT JOIN cache USING (query)""")
def geocode_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.active(spark, sf_dir)
    return geocode.fill_coordinates(rows, _cache(rows)).select("source_listing_id", R6("lat"), R6("lng"), "geocode_precision")


@query("geocode_worklist", f"WITH {_GEO_CTE} SELECT DISTINCT query FROM asked WHERE query <> '' AND query NOT IN (SELECT query FROM cache WHERE NOT (provider = 'google' AND age > 30))")
def geocode_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.active(spark, sf_dir)
    return geocode.worklist(rows, _cache(rows), F.expr(NOW))


@query("geocode_refresh", f"""WITH {_GEO_CTE}, work AS (SELECT DISTINCT query FROM asked WHERE query <> '' AND query NOT IN (SELECT query FROM cache WHERE NOT (provider = 'google' AND age > 30)))
SELECT query, round(coalesce(w.lat, clat), 6) AS lat, CASE WHEN w.query IS NULL THEN provider ELSE 'google' END AS provider FROM cache FULL JOIN (SELECT query, 3.5 AS lat FROM work) w USING (query)""")
def geocode_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.active(spark, sf_dir)
    cache = _cache(rows)
    answers = geocode.worklist(rows, cache, F.expr(NOW)).select("query", F.lit(3.5).alias("lat"), F.lit(-76.5).alias("lng"), F.lit("city").alias("precision"), F.lit("google").alias("provider"), F.lit(None).cast("string").alias("place_id"), F.expr(NOW).alias("created_at"))
    return geocode.refresh_cache(cache, answers).select("query", R6("lat"), "provider")


_OTHER = "CASE CAST(source_listing_id AS BIGINT) % 4 WHEN 0 THEN ' PANCE  alto' WHEN 1 THEN 'caney' WHEN 2 THEN '' END"


@query("places_overlap", f"WITH {LISTINGS_CTE}, n AS (SELECT source_listing_id, {NORM.format('barrio')} AS a, {NORM.format(_OTHER)} AS b FROM active) SELECT source_listing_id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS alike FROM n")
def places_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import overlaps

    return data.active(spark, sf_dir).select("source_listing_id", overlaps(F.col("barrio"), F.expr(_OTHER)).alias("alike"))


_TYPES = "CASE CAST(source_listing_id AS BIGINT) % 6 WHEN 0 THEN 'ROOFTOP' WHEN 1 THEN 'RANGE_INTERPOLATED' WHEN 2 THEN 'GEOMETRIC_CENTER' WHEN 3 THEN 'APPROXIMATE' WHEN 4 THEN 'ELSEWHERE' END"


@query("location_types", f"WITH {LISTINGS_CTE}, t AS (SELECT {_TYPES} AS kind FROM active) SELECT CASE kind WHEN 'ROOFTOP' THEN 'rooftop' WHEN 'RANGE_INTERPOLATED' THEN 'street' WHEN 'GEOMETRIC_CENTER' THEN 'barrio_centroid' ELSE 'city' END AS precision, count(*) AS n FROM t GROUP BY 1")
def location_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geo import precision_of_location_type

    return data.active(spark, sf_dir).groupBy(precision_of_location_type(F.expr(_TYPES)).alias("precision")).agg(F.count("*").alias("n"))
