"""Checked queries: crawls merged into snapshots, availability, saved searches, review marks, reports. A day of events is a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marked, merge, report, verify
from . import data
from .data import LISTINGS_CTE
from .registry import ORACLES, query
from .search_queries import NORM, OPTIONS, SEARCHED_CTE, _ranked

DAY = 20  # crawls before this day of January make the snapshot, the crawl of the day is merged

_EVENTS_CTE = f"""rows_ AS (SELECT event_type AS source, CAST(user_id AS STRING) AS source_listing_id, value AS price, props AS raw_json, ts AS seen_at, event_id FROM events),
older AS (SELECT *, row_number() OVER (PARTITION BY source, source_listing_id ORDER BY seen_at DESC, price, raw_json) AS rn, min(seen_at) OVER (PARTITION BY source, source_listing_id) AS first_seen FROM rows_ WHERE day(seen_at) < {DAY}),
old AS (SELECT source, source_listing_id, price, raw_json, first_seen, seen_at AS last_seen, true AS is_active FROM older WHERE rn = 1),
batch AS (SELECT * FROM rows_ WHERE day(seen_at) = {DAY} AND source <> 'error'),
now_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_listing_id ORDER BY seen_at DESC, price, raw_json) AS rn FROM batch) WHERE rn = 1),
crawled AS (SELECT source, max(seen_at) AS at FROM now_ GROUP BY source)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_listing_id"), F.col("value").alias("price"), F.col("props").alias("raw_json"), F.col("ts").alias("seen_at"), "event_id")


def _old(rows: DataFrame) -> DataFrame:
    before = rows.where(F.dayofmonth("seen_at") < DAY)
    first = before.groupBy(*merge.KEY).agg(F.min("seen_at").alias("first_seen"))
    last = merge.first_of(before, merge.KEY, [F.desc("seen_at"), "price", "raw_json"])
    return last.join(first, list(merge.KEY)).select(*merge.KEY, "price", "raw_json", "first_seen", F.col("seen_at").alias("last_seen"), F.lit(None).cast("timestamp").alias("last_verified_at"), F.lit(True).alias("is_active"))


def _batch(rows: DataFrame) -> DataFrame:
    return rows.where((F.dayofmonth("seen_at") == DAY) & (F.col("source") != "error")).drop("event_id")


@query("crawl_merge", f"""WITH {_EVENTS_CTE} SELECT source, source_listing_id, CASE WHEN n.rn = 1 THEN n.price ELSE o.price END AS price, coalesce(o.first_seen, n.seen_at) AS first_seen,
coalesce(n.seen_at, CASE WHEN c.at IS NOT NULL THEN c.at END, o.last_seen) AS last_seen, n.rn IS NOT NULL OR c.at IS NULL AS is_active
FROM old o FULL JOIN now_ n USING (source, source_listing_id) LEFT JOIN crawled c USING (source)""")
def crawl_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return merge.merge_snapshot(_old(rows), _batch(rows)).select(*merge.KEY, "price", "first_seen", "last_seen", "is_active")


_STREAMED = ORACLES["crawl_merge"].replace("now_ AS (", "began AS (SELECT source, source_listing_id, min(seen_at) AS began FROM batch GROUP BY 1, 2), now_ AS (").replace("coalesce(o.first_seen, n.seen_at)", "least(o.first_seen, b.began)").replace("LEFT JOIN crawled", "LEFT JOIN began b USING (source, source_listing_id) LEFT JOIN crawled")


@query("crawl_streamed", _STREAMED)
def crawl_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same crawl in four batches that arrive out of order, merged into a store of 16 buckets; then what it hasn't seen is gone."""
    from ..sources.snapshot_store import SnapshotStore
    from ..staging import new_folder
    from ..streaming.ingest import merge_stream_into

    rows = _rows(spark, sf_dir)
    batch, at = _batch(rows.withColumn("k", F.pmod(F.xxhash64("event_id"), F.lit(4)))), new_folder(spark, "streamed")
    batch.repartition(4, "k").drop("k").write.parquet(f"{at}/incoming")
    store = SnapshotStore.create(_old(rows), f"{at}/store", n_buckets=16)
    merge_stream_into(store, f"{at}/incoming", batch.drop("k").schema, f"{at}/checkpoint", files=1).awaitTermination()
    began = rows.where(F.dayofmonth("seen_at") == DAY).agg(F.date_trunc("day", F.min("seen_at")).alias("t")).first()["t"]  # one row
    if began is not None:
        store.end_crawl(F.lit(began))
    return store.read().select(*merge.KEY, "price", "first_seen", "last_seen", "is_active")


@query("crawl_diff", f"""WITH {_EVENTS_CTE}, l AS (SELECT source, count(*) AS listed, count(DISTINCT source_listing_id) AS ids FROM batch GROUP BY source),
i AS (SELECT source, count(*) AS inserted FROM now_ ANTI JOIN old USING (source, source_listing_id) GROUP BY source), d AS (SELECT source, count(*) AS deactivated FROM old ANTI JOIN now_ USING (source, source_listing_id) GROUP BY source)
SELECT source, listed, coalesce(inserted, 0) AS inserted, ids - coalesce(inserted, 0) AS updated, coalesce(deactivated, 0) AS deactivated FROM l LEFT JOIN i USING (source) LEFT JOIN d USING (source)""")
def crawl_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return merge.crawl_diff(_old(rows), _batch(rows))


@query("crawl_capped", f"WITH {_EVENTS_CTE} SELECT source, source_listing_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_id) AS n FROM rows_) WHERE n <= 40")
def crawl_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.cap_per_source(_rows(spark, sf_dir), 40, ["event_id"]).select("source", "source_listing_id", "event_id")


@query("details_capped", f"WITH {_EVENTS_CTE}, s AS (SELECT CASE source WHEN 'view' THEN 'arriendo' WHEN 'click' THEN 'rentola' WHEN 'error' THEN 'century21' ELSE source END AS source, event_id FROM rows_), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_id) AS n FROM s) SELECT source, count(*) AS n, max(event_id) AS last FROM n WHERE n <= CASE source WHEN 'arriendo' THEN 100 WHEN 'rentola' THEN 60 WHEN 'century21' THEN 40 ELSE n END GROUP BY source")
def details_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).replace({"view": "arriendo", "click": "rentola", "error": "century21"}, subset=["source"])
    return merge.cap_details(rows, 2, ["event_id"]).groupBy("source").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("crawl_first_of_key", f"WITH {_EVENTS_CTE} SELECT source, source_listing_id, min(event_id) AS event_id FROM rows_ GROUP BY 1, 2")
def crawl_first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_of(_rows(spark, sf_dir), merge.KEY, ["event_id"]).select(*merge.KEY, "event_id")


@query("crawl_counts", f"WITH {_EVENTS_CTE}, registry AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'other']) AS source) SELECT source, coalesce(n, 0) AS n FROM registry LEFT JOIN (SELECT source, count(*) AS n FROM batch GROUP BY 1) USING (source)")
def crawl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([(s,) for s in ("click", "error", "purchase", "signup", "view", "other")], "id string")
    return merge.counts_by_source(_batch(_rows(spark, sf_dir)), registry)


@query("run_log", f"""WITH {_EVENTS_CTE}, days AS (SELECT day(seen_at) AS d, count(*) FILTER (source = 'error') AS errors, count(*) FILTER (source <> 'error') AS persisted, min(seen_at) AS started_at, max(seen_at) AS finished_at FROM rows_ GROUP BY 1)
SELECT 'run-' || CAST(d AS STRING) AS id, finished_at, 'completed' AS status FROM days WHERE persisted > 0 OR errors = 0 ORDER BY finished_at DESC LIMIT 1""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _rows(spark, sf_dir).groupBy(F.dayofmonth("seen_at").alias("d")).agg(F.count_if(F.col("source") == "error").alias("errors"), F.count_if(F.col("source") != "error").alias("persisted"), F.min("seen_at").alias("started_at"), F.max("seen_at").alias("finished_at"))
    status = F.when((F.col("errors") > 0) & (F.col("persisted") == 0), "failed").otherwise("completed")
    runs = days.select(F.concat(F.lit("run-"), F.col("d").cast("string")).alias("id"), "started_at", "finished_at", status.alias("status"))
    return merge.newest_completed(runs).select("id", "finished_at", "status")


@query("run_closed", f"WITH {_EVENTS_CTE} SELECT 'run' AS id, max(seen_at) FILTER (source <> 'error') AS finished_at, 'completed' AS status, '{{\"persisted\":' || CAST(count(*) FILTER (source <> 'error') AS STRING) || ',\"errors\":' || CAST(count(*) FILTER (source = 'error') AS STRING) || '}}' AS stats FROM rows_")
def run_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    run = spark.createDataFrame([("run", None, "{}")], "id string, started_at timestamp, params string")
    return merge.close_run(run, rows.where("source = 'error'"), rows.where("source <> 'error'")).select("id", "finished_at", "status", "stats")


# Responses: every document is the answer to a URL; some are gone, some moved, some say so in words.
_MARKERS = ("licensed under", "the and attion to", "no disponible")
_RESP_CTE = f"""resp AS (SELECT 'https://p.example.com/l/' || CAST(doc_id AS STRING) AS url, CASE doc_id % 7 WHEN 3 THEN 'https://p.example.com/' WHEN 4 THEN 'https://p.example.com/buscar/casas?x=1' ELSE 'https://p.example.com/l/' || CAST(doc_id AS STRING) END AS final_url,
  CASE doc_id % 11 WHEN 1 THEN 404 WHEN 2 THEN 410 WHEN 5 THEN 503 ELSE 200 END AS status, {NORM.format('text')} AS b, CASE WHEN doc_id % 13 = 0 THEN 'timeout' END AS error FROM documents),
judged AS (SELECT url, CASE WHEN error IS NOT NULL THEN 'fetch error (kept): ' || error WHEN status IN (404, 410) THEN 'HTTP ' || CAST(status AS STRING) WHEN final_url <> url THEN 'redirected to search/index' WHEN status >= 500 THEN 'server ' || CAST(status AS STRING) || ' (kept)'
  WHEN contains(b, 'licensed under') THEN 'marker: "licensed under"' WHEN contains(b, 'the and attion to') THEN 'marker: "the and attion to"' WHEN contains(b, 'no disponible') THEN 'marker: "no disponible"' ELSE 'ok' END AS reason, status FROM resp)"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    url = F.concat(F.lit("https://p.example.com/l/"), n.cast("string"))
    return data.table(spark, sf_dir, "documents").select(
        url.alias("url"),
        F.when(n % 7 == 3, "https://p.example.com/").when(n % 7 == 4, "https://p.example.com/buscar/casas?x=1").otherwise(url).alias("final_url"),
        F.when(n % 11 == 1, 404).when(n % 11 == 2, 410).when(n % 11 == 5, 503).otherwise(200).alias("status"),
        F.col("text").alias("body"),
        F.when(n % 13 == 0, "timeout").alias("error"),
    )


@query("verify", f"WITH {_RESP_CTE} SELECT url, NOT (reason LIKE 'HTTP%' OR reason LIKE 'redirected%' OR reason LIKE 'marker%') AS is_active, reason, status FROM judged")
def verify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verdicts(_responses(spark, sf_dir), _MARKERS)


@query("verify_marked_dead", f"WITH {_RESP_CTE}, s AS (SELECT 'https://p.example.com/l/' || CAST(event_id AS STRING) AS url, event_type <> 'error' AS is_active FROM events), d AS (SELECT url FROM judged WHERE reason LIKE 'HTTP%' OR reason LIKE 'redirected%' OR reason LIKE 'marker%') SELECT is_active AND d.url IS NULL AS is_active, d.url IS NOT NULL AS verified, count(*) AS n FROM s LEFT JOIN d USING (url) GROUP BY 1, 2")
def verify_marked_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = data.table(spark, sf_dir, "events").select(F.concat(F.lit("https://p.example.com/l/"), F.col("event_id").cast("string")).alias("url"), (F.col("event_type") != "error").alias("is_active"), F.lit(None).cast("timestamp").alias("last_verified_at"))
    out = verify.mark_dead(s, verify.verdicts(_responses(spark, sf_dir), _MARKERS), F.expr("timestamp '2024-06-30 00:00:00'"))
    return out.groupBy("is_active", F.col("last_verified_at").isNotNull().alias("verified")).agg(F.count("*").alias("n"))


@query("verify_first", f"WITH {_RESP_CTE}, first AS (SELECT 'https://p.example.com/l/' || CAST(doc_id AS STRING) AS url FROM documents ORDER BY doc_id % 101, doc_id LIMIT 60) SELECT url, NOT (reason LIKE 'HTTP%' OR reason LIKE 'redirected%' OR reason LIKE 'marker%') AS is_active, reason FROM judged SEMI JOIN first USING (url)".replace("contains(b, 'licensed under')", "false").replace("contains(b, 'the and attion to')", "false"))
def verify_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first responses as sent, by the markers of gone adverts (of which these texts can hold one)."""
    from .entries import verify_urls

    n = F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint")
    sent = _responses(spark, sf_dir).withColumn("sent", (n % 101) * 1_000_000_000 + n)
    return verify_urls(sent, None, None)[0].select("url", "is_active", "reason")


@query("listings_with_verdicts", f"WITH {_RESP_CTE}, s AS (SELECT event_id, 'https://p.example.com/l/' || CAST(event_id AS STRING) AS url FROM events) SELECT event_id, reason AS verdict FROM s LEFT JOIN judged USING (url)")
def listings_with_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = data.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("https://p.example.com/l/"), F.col("event_id").cast("string")).alias("url"))
    return verify.with_verdicts(s, verify.verdicts(_responses(spark, sf_dir), _MARKERS)).select("event_id", "verdict")


# Saved searches: the adverts of a customer's orders, one entry a customer and year; links overlap through the part of the key.
_HIST_CTE = f"""{LISTINGS_CTE}, h AS (SELECT source, source_listing_id, url, last_seen, 'e' || CAST(CAST(source_listing_id AS BIGINT) % 37 AS STRING) AS entry_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (CAST(source_listing_id AS BIGINT) % 37) AS ts,
  'https://alias.example.com/' || CAST(CAST(source_listing_id AS BIGINT) // 10 AS STRING) AS alias, price, area_m2 FROM active),
hp AS (SELECT *, row_number() OVER (ORDER BY ts DESC, entry_id, CAST(source_listing_id AS BIGINT)) AS pos FROM h),
k AS (SELECT pos, unnest(['u:' || url, 's:' || source || ':' || source_listing_id, 'u:' || alias]) AS key FROM hp),
f AS (SELECT key, min(pos) AS first FROM k GROUP BY key),
kept AS (SELECT pos FROM k JOIN f USING (key) GROUP BY pos HAVING bool_and(pos = first)),
reviews AS (SELECT 'u:' || alias AS key, bool_or(CAST(source_listing_id AS BIGINT) % 3 = 0) AS seen, bool_or(CAST(source_listing_id AS BIGINT) % 50 = 0) AS eligible FROM hp GROUP BY 1),
marked AS (SELECT hp.*, CASE WHEN coalesce(r.eligible, false) THEN 'eligible' WHEN coalesce(r.seen, false) THEN 'seen' ELSE 'none' END AS state FROM hp JOIN kept USING (pos) LEFT JOIN reviews r ON r.key = 'u:' || alias)"""


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the saved searches, reviews)"""
    n = F.col("source_listing_id").cast("bigint")
    alias = F.concat(F.lit("https://alias.example.com/"), F.floor(n / 10).cast("string"))
    rows = data.active(spark, sf_dir).withColumns({
        "entry_id": F.concat(F.lit("e"), (n % 37).cast("string")), "ts": F.timestamp_micros(F.lit(1_704_067_200_000_000) + (n % 37) * 3_600_000_000), "row_pos": n, "alias": alias,
        "source_links": F.array(F.struct(F.col("source").alias("source"), alias.alias("url"))),
    })
    reviews = rows.groupBy(F.concat(F.lit("u:"), "alias").alias("key")).agg(F.bool_or(n % 3 == 0).alias("seen"), F.bool_or(n % 50 == 0).alias("eligible"))
    return rows, reviews


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, reviews = _history(spark, sf_dir)
    return marked.first_marked(rows, reviews)


@query("marked_first_occurrences", f"WITH {_HIST_CTE} SELECT source, source_listing_id, state FROM marked")
def marked_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("source", "source_listing_id", "state")


_UPDATED = _HIST_CTE.replace("price, area_m2 FROM active)", "price, area_m2 FROM active WHERE CAST(source_listing_id AS BIGINT) % 37 NOT IN (3, 11, 31))")


@query("marked_updated", f"WITH {_UPDATED} SELECT source, source_listing_id FROM marked")
def marked_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of the searches up to e29, brought up to date with the later ones but e31 and without e3 and e11."""
    from ..staging import staged

    rows, _ = _history(spark, sf_dir)
    k = F.col("source_listing_id").cast("bigint") % 37
    before, later = rows.where(k < 30), rows.where((k >= 30) & (k != 31))
    old = marked.occurrences(before)
    old = marked.Occurrences(staged(old.first, "first-keys"), staged(old.kept, "first-rows"))
    now = marked.update_occurrences(old, before, later, ["e3", "e11"])
    return marked.with_keys(before.unionByName(later)).join(now.kept, "pos").select("source", "source_listing_id")


@query("marked_houses", f"""WITH {_HIST_CTE} SELECT 'counts' AS part, s.state AS name, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(['eligible', 'seen', 'none']) AS state) s LEFT JOIN (SELECT state, count(*) AS n FROM marked GROUP BY state) m USING (state)
UNION ALL SELECT 'chosen', state, count(*) FROM marked WHERE state IN ('eligible', 'seen') GROUP BY state UNION ALL SELECT 'exported', CASE state WHEN 'eligible' THEN 'Elegible' ELSE 'Vista' END, count(*) FROM marked WHERE state IN ('eligible', 'seen') GROUP BY state""")
def marked_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved searches written as JSON lines, read back, and the page of marked houses made of them."""
    from ..operators.rank import cost_per_m2
    from ..sources.stored import read_history
    from ..staging import new_folder
    from .entries import marked_houses as page

    rows, reviews = _history(spark, sf_dir)
    fields = ("source", "source_listing_id", "url", "source_links", "barrio", "conjunto", "city", "address", "area_m2", "price", "admin", "cost_per_m2", "bedrooms")
    ranked = F.sort_array(F.collect_list(F.struct("row_pos", F.struct(*fields).alias("l"))))
    entries = rows.withColumn("cost_per_m2", cost_per_m2()).groupBy(F.col("entry_id").alias("id"), "ts").agg(F.transform(ranked, lambda x: x["l"]).alias("ranked"))
    entries = entries.select("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts"), F.lit("scrape").alias("mode"), F.struct(F.lit("here").alias("refLabel")).alias("meta"), F.struct("ranked").alias("result"))
    at = new_folder(spark, "history")
    entries.write.json(at)
    counts, chosen, exported = page(read_history(spark, at), reviews)
    tally = lambda part, df, name: df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    return counts.select(F.lit("counts").alias("part"), F.col("state").alias("name"), "n").unionByName(tally("chosen", chosen, "state")).unionByName(tally("exported", exported, "Estado"))


@query("marked_counts", f"WITH {_HIST_CTE} SELECT s.state, coalesce(n, 0) AS n FROM (SELECT unnest(['eligible', 'seen', 'none']) AS state) s LEFT JOIN (SELECT state, count(*) AS n FROM marked GROUP BY state) m USING (state)")
def marked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked.state_counts(_marked(spark, sf_dir))


@query("marked_export", f"""WITH {_HIST_CTE} SELECT coalesce(CASE WHEN barrio IS NOT NULL OR conjunto IS NOT NULL THEN concat_ws(' / ', barrio, conjunto) END, address, '') AS "Barrio/Conjunto", city AS "Ciudad", m.area_m2 AS "m²", m.price AS "Precio", floor((m.price + coalesce(admin, 0)) / m.area_m2 + 0.5) AS "$/m²",
CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN floor(abs(lat - 3.4) * 1000 + 0.5) / 10 END AS "Distancia (km)", bedrooms AS "Habitaciones", CASE state WHEN 'eligible' THEN 'Elegible' ELSE 'Vista' END AS "Estado", m.url AS "Enlace" FROM marked m JOIN active a USING (source, source_listing_id) WHERE state IN ('eligible', 'seen')""")
def marked_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.filters import by_state
    from ..operators.rank import cost_per_m2

    m = by_state(_marked(spark, sf_dir), ["eligible", "seen"])
    m = m.withColumns({"cost_per_m2": cost_per_m2(), "driving_km": F.lit(None).cast("double"), "distance_km": F.when(F.col("lng").isNotNull(), F.abs(F.col("lat") - 3.4) * 100)})
    return marked.export_rows(m)


@query("reviews_patched", f"""WITH {_HIST_CTE}, p AS (SELECT unnest(['u:' || alias, 'u:' || url, 's:' || source || ':' || source_listing_id]) AS key, true AS eligible FROM hp WHERE CAST(source_listing_id AS BIGINT) % 20 = 7), pp AS (SELECT key, bool_or(eligible) AS eligible FROM p GROUP BY key)
SELECT r.seen, coalesce(pp.eligible, r.eligible) AS eligible, count(*) AS n FROM reviews r FULL JOIN pp USING (key) GROUP BY 1, 2""")
def reviews_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.labels import identity_keys

    rows, reviews = _history(spark, sf_dir)
    n = F.col("source_listing_id").cast("bigint")
    patches = rows.where(n % 20 == 7).select(identity_keys(F.col("source"), F.col("source_listing_id"), F.col("url"), F.col("source_links")).alias("keys"), F.lit(None).cast("boolean").alias("seen"), F.lit(True).alias("eligible"))
    return marked.set_reviews(reviews, patches).groupBy("seen", "eligible").agg(F.count("*").alias("n"))


# Entries of the search history: every customer's last search, by what it asked for.
_ENTRIES = "e AS (SELECT o_orderkey AS id, o_orderdate AS ts, CASE o_orderstatus WHEN 'F' THEN 'list' ELSE 'scrape' END AS mode, concat_ws('|', CAST(o_custkey % 400 AS STRING), o_orderpriority) AS sig FROM orders)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderstatus") == "F", "list").otherwise("scrape").alias("mode"), F.concat_ws("|", (F.col("o_custkey") % 400).cast("string"), F.col("o_orderpriority")).alias("sig"))


@query("history_added", f"WITH {_ENTRIES} SELECT id, ts, mode, sig FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY ts DESC, id DESC) AS n FROM e) WHERE n = 1 ORDER BY ts DESC, id DESC LIMIT 15")
def history_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return marked.add_entries(e.where("id % 2 = 0"), e.where("id % 2 = 1"), keep=15)


@query("history_trimmed", f"WITH {_ENTRIES}, r AS (SELECT o_custkey AS id, count(*) AS n, list(o_orderkey ORDER BY o_orderkey) AS ranked FROM orders GROUP BY 1) SELECT CASE WHEN n > 5 THEN 5 ELSE n END AS kept, sum(list_sum(ranked[1:5])) AS keys, count(*) AS entries FROM r WHERE id <> 7 GROUP BY 1")
def history_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the ranked rows of an entry, the first five of them; one entry removed."""
    orders = data.table(spark, sf_dir, "orders")
    history = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ranked"))
    kept = marked.remove_entry(marked.trim_entries(history, 5), 7)
    total = F.aggregate("ranked", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return kept.groupBy(F.size("ranked").cast("bigint").alias("kept")).agg(F.sum(total).alias("keys"), F.count("*").alias("entries"))


@query("history_modes", f"WITH {_ENTRIES} SELECT mode, sig, count(*) AS n FROM e WHERE mode <> 'list' GROUP BY 1, 2")
def history_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.labels import search_signature

    e = marked.of_mode(_entries(spark, sf_dir), "list", keep=False)
    parts = F.split("sig", r"\|")
    return e.withColumn("sig", search_signature(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).groupBy("mode", "sig").agg(F.count("*").alias("n"))


@query("history_latest", f"WITH {_ENTRIES} SELECT id, ts, mode, sig FROM e WHERE mode = 'list' AND id <> (SELECT max(id) FROM e) ORDER BY ts DESC, id DESC LIMIT 1")
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    last = e.agg(F.max("id").alias("last"))
    return marked.latest_of_mode(e.crossJoin(F.broadcast(last)).where("id <> last").drop("last"), "list")


_MONEY = "coalesce('$' || replace(format('{{:,}}', CAST(floor({} + 0.5) AS BIGINT)), ',', '.'), '—')"


@query("report_rows", f"""WITH {SEARCHED_CTE} SELECT rank, CAST(rank AS STRING) AS c0, coalesce(CASE WHEN barrio IS NOT NULL OR conjunto IS NOT NULL THEN concat_ws(' / ', barrio, conjunto) END, address, '—') AS c1, coalesce(CAST(CAST(floor(area_m2 + 0.5) AS BIGINT) AS STRING), '—') AS c2,
{_MONEY.format('price')} AS c3, {_MONEY.format('admin')} AS c4, {_MONEY.format('cost_per_m2')} AS c5, printf('%.1f', floor(distance_km * 10 + 0.5) / 10) || ' km' AS c6, coalesce(CAST(bedrooms AS STRING), '—') || '/' || coalesce(CAST(bathrooms AS STRING), '—') AS c7,
coalesce(CAST(estrato AS STRING), '—') AS c8, coalesce(agency, '—') AS c9, coalesce(phone || CASE WHEN has_whatsapp THEN ' (WA)' ELSE '' END, '—') AS c10, sources AS c11, '[ver](' || url || ')' AS c12 FROM ranked WHERE rank <= 25""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_rows(_ranked(spark, sf_dir, 25).withColumns({"driving_km": F.lit(None).cast("double"), "driving_min": F.lit(None).cast("double")}))


_HEAD = "# Rental search report\n\nCities: Cali, jamundi. Reference point: 3.4516, -76.532. Max distance: 8.0 km. Min area: 80.0 m². Weights: cost 0.5, area 0.3, distance 0.2.\n\n| # | Barrio / Conjunto | Area m² | Price | Admin | Cost/m² | Dist | Beds/Baths | Estrato | Agency | Contact | Source | Link |\n|---|---|---|---|---|---|---|---|---|---|---|---|---|\n"
_ROWS = ORACLES["report_rows"].replace("rank <= 25", "rank <= 10")


@query("report_text", f"""WITH t AS ({_ROWS}), l AS (SELECT string_agg('| ' || concat_ws(' | ', c0, c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, c11, c12) || ' |', chr(10) ORDER BY rank) AS body, max(CASE WHEN rank = 1 THEN 'Best value: #1 ' || c1 || ' — ' || c2 || ' m² at ' || c3 || ' (' || c5 || '/m²), ' || c6 || ' away.' END) AS best FROM t)
SELECT '{_HEAD}' || body || chr(10) || chr(10) || best || chr(10) AS text FROM l""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _ranked(spark, sf_dir, 10).withColumns({"driving_km": F.lit(None).cast("double"), "driving_min": F.lit(None).cast("double")})
    return report.report_text(top, OPTIONS)
