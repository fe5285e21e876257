"""Checked queries: domains of search hits, how pages read, links and texts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import root_domain
from ..operators import discovery, extract
from ..operators.numbering import number_rows
from . import data
from .registry import query
from .search_queries import NORM

IMPLEMENTED = ("ththth.example.net", "therha.example.com")

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1))"
_HITS = f"hits AS (SELECT page_id, url, 'q' || CAST(page_id % 3 AS STRING) AS query, regexp_replace({_HOST}, '^www\\.', '') AS domain FROM pages WHERE url LIKE '%://%')"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    return data.table(spark, sf_dir, "pages").select("url", F.concat(F.lit("q"), (n % 3).cast("string")).alias("query"), F.lit("engine").alias("engine"), F.lit("").alias("title"))


@query("hits_by_domain", f"WITH {_HITS} SELECT domain, count(*) AS mention_count, count(DISTINCT query) AS n_queries, min(url) AS first_url FROM hits WHERE domain <> '' GROUP BY domain")
def hits_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = discovery.by_domain(_hits(spark, sf_dir), ["url", "query"])
    return g.select("domain", "mention_count", F.size("queries").cast("bigint").alias("n_queries"), F.col("first_seen.url").alias("first_url"))


@query("domain_hits", f"WITH {_HITS} SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY query, url) AS place, query, url FROM hits WHERE domain <> ''")
def domain_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.domain_hits(_hits(spark, sf_dir)).select("domain", "place", "query", "url")


@query("examined_found_via", f"""WITH {_HITS}, g AS (SELECT domain, count(*) AS n, min(query || ' ' || url) AS first_seen, string_agg(query || ' ' || url, ' ' ORDER BY query, url) AS via FROM hits WHERE domain <> '' AND ('.' || domain) NOT LIKE '%.ththth.example.net' AND ('.' || domain) NOT LIKE '%.therha.example.com' GROUP BY domain)
SELECT domain, via FROM g ORDER BY n DESC, first_seen, domain LIMIT 12""")
def examined_found_via(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    g = discovery.classify_domains(discovery.by_domain(hits), discovery.domain_rules(spark, IMPLEMENTED)).withColumn("status", F.coalesce("reason", F.lit("new")))
    chosen = discovery.to_examine(g.withColumn("first_seen", F.concat_ws(" ", "first_seen.query", "first_seen.url")), 12)
    found = discovery.with_found_via(chosen, discovery.domain_hits(hits))
    return found.select("domain", F.array_join(F.transform("found_via", lambda h: F.concat_ws(" ", h["query"], h["url"])), " ").alias("via"))


# Domains with country suffixes, made from the pages' hosts.
_SUFFIX = "CASE page_id % 6 WHEN 0 THEN '.com.mx' WHEN 1 THEN '.cl' WHEN 2 THEN '.co' WHEN 3 THEN '' WHEN 4 THEN '.facebook.com' ELSE '.habi.co' END"


@query("domains_classified", f"""WITH {_HITS}, d AS (SELECT DISTINCT domain || {_SUFFIX} AS domain FROM hits WHERE domain <> '')
SELECT domain, CASE WHEN ('.' || domain) LIKE '%.ththth.example.net' OR ('.' || domain) LIKE '%.therha.example.com' THEN 'known_implemented' WHEN domain LIKE '%.habi.co' THEN 'known_excluded' WHEN domain LIKE '%.facebook.com' THEN 'blocklisted' WHEN domain LIKE '%.mx' OR domain LIKE '%.cl' THEN 'foreign' END AS reason,
CASE WHEN ('.' || domain) LIKE '%.ththth.example.net' OR ('.' || domain) LIKE '%.therha.example.com' THEN NULL WHEN domain LIKE '%.habi.co' THEN 'solo venta, sin arriendos' WHEN domain LIKE '%.mx' THEN 'TLD .mx (México)' WHEN domain LIKE '%.cl' THEN 'TLD .cl (Chile)' END AS note FROM d""")
def domains_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 6
    suffix = F.when(n == 0, ".com.mx").when(n == 1, ".cl").when(n == 2, ".co").when(n == 3, "").when(n == 4, ".facebook.com").otherwise(".habi.co")
    d = data.table(spark, sf_dir, "pages").select(root_domain(F.col("url")).alias("d"), suffix.alias("s")).where("d is not null").select(F.concat("d", "s").alias("domain")).distinct()
    return discovery.classify_domains(d, discovery.domain_rules(spark, IMPLEMENTED)).select("domain", "reason", "note")


_CANDIDATES = f"""{_HITS}, g AS (SELECT domain, count(*) AS mention_count, min(query || ' ' || url) AS first_seen FROM hits WHERE domain <> '' GROUP BY domain),
c AS (SELECT *, CASE WHEN ('.' || domain) LIKE '%.ththth.example.net' OR ('.' || domain) LIKE '%.therha.example.com' THEN 'known_implemented' ELSE 'new' END AS status FROM g)"""


@query("candidates_to_examine", f"WITH {_CANDIDATES} SELECT domain, mention_count, status FROM c WHERE status = 'new' ORDER BY mention_count DESC, first_seen, domain LIMIT 12")
def candidates_to_examine(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = discovery.classify_domains(discovery.by_domain(_hits(spark, sf_dir)), discovery.domain_rules(spark, IMPLEMENTED)).withColumn("status", F.coalesce("reason", F.lit("new")))
    g = g.withColumn("first_seen", F.concat_ws(" ", "first_seen.query", "first_seen.url"))
    return discovery.to_examine(g, 12).select("domain", "mention_count", "status")


@query("candidates_split", f"WITH {_CANDIDATES} SELECT domain, status = 'new' AS is_new FROM c")
def candidates_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = discovery.classify_domains(discovery.by_domain(_hits(spark, sf_dir)), discovery.domain_rules(spark, IMPLEMENTED)).withColumn("status", F.coalesce("reason", F.lit("new")))
    new, known = discovery.split_new(g)
    return new.select("domain", F.lit(True).alias("is_new")).unionByName(known.select("domain", F.lit(False).alias("is_new")))


@query("page_relevance", f"""WITH t AS (SELECT page_id, {NORM.format("html || CASE WHEN page_id % 2 = 0 THEN ' Arriendo en Cali, canon 900 y arriendo; calidad ' ELSE '' END")} AS x FROM pages)
SELECT page_id, round(CASE WHEN length(x) < 20 THEN 0 ELSE least(1.0, (len(regexp_extract_all(x, '\\b(arriendo|alquiler|inmobiliaria|arrendar|canon|cali)\\b'))) / sqrt(len(string_split(x, ' '))) / 3) END, 9) AS relevance FROM t""")
def page_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("html", F.when(F.col("page_id") % 2 == 0, " Arriendo en Cali, canon 900 y arriendo; calidad ").otherwise(""))
    return data.table(spark, sf_dir, "pages").select("page_id", F.round(discovery.relevance(body, ["Cali"]), 9).alias("relevance"))


_SAID = """CASE page_id % 8 WHEN 0 THEN ' renta $18,000 MXN en Guadalajara ' WHEN 1 THEN ' estrato 4, NIT 900, cop 1.500.000 ' WHEN 2 THEN ' desde 3.500 UF en Las Condes ' WHEN 3 THEN ' Santiago de Cali ' WHEN 4 THEN ' Lima y Monterrey ' WHEN 5 THEN ' estrato 5 en Santiago ' WHEN 6 THEN ' precio S/ 800 en Lima ' ELSE '' END"""


def _country_sql() -> str:
    """Every sign searched in the page's text. There is no looking ahead in the twin's expressions, so "santiago de cali" is taken out first."""
    money, home, places = discovery.FOREIGN_MONEY, discovery.HOME_SIGNS, discovery.FOREIGN_PLACES
    hit = lambda pattern, x="x": f"CAST(regexp_matches({x}, '{pattern}') AS INT)"
    signs = {c: " + ".join([hit(p) for k, p, _ in money if k == c] + [hit(rf"\b{w}\b", "y" if w in discovery.NOT_AFTER else "x") for k, w in places if k == c]) for c in sorted({k for k, *_ in (*money, *places)})}
    columns = ", ".join(f"{e} AS n_{c}" for c, e in signs.items())
    return f"""WITH h AS (SELECT page_id, {NORM.format("coalesce(html, '') || " + _SAID)} AS x FROM pages), t AS (SELECT *, regexp_replace(x, 'santiago\\s+de\\s+cali', ' ', 'g') AS y FROM h),
s AS (SELECT page_id, {columns}, {" + ".join(hit(p) for _, p, _ in home)} AS home FROM t), f AS (SELECT *, {" + ".join(f"n_{c}" for c in signs)} AS away FROM s)
SELECT page_id, CASE WHEN home = 0 AND greatest({", ".join(f"n_{c}" for c in signs)}) >= 2 THEN 'foreign' WHEN home > 0 AND away = 0 THEN 'co' ELSE 'unknown' END AS verdict, CAST(home + away AS INT) AS signs FROM f"""


@query("page_country", _country_sql())
def page_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = data.table(spark, sf_dir, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.expr(_SAID)))
    return discovery.country_verdicts(pages).select("page_id", "verdict", "signs")


_ROBOTS = r"""'# ' || CAST(page_id AS STRING) || chr(10) || 'User-agent: a' || chr(10) || CASE page_id % 3 WHEN 0 THEN 'User-agent: GPTBot' || chr(10) || chr(10) || 'Disallow: /' WHEN 1 THEN 'Disallow: /x' || chr(10) || 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || 'Disallow: /' ELSE 'Disallow: /' || chr(10) || 'User-agent: CCBot' || chr(10) || 'Disallow: /private/' END"""


_BANNED = f"""WITH r AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN {_ROBOTS} END AS text FROM pages),
l AS (SELECT page_id, generate_subscripts(x, 1) AS n, trim(unnest(x)) AS raw FROM (SELECT page_id, string_split(text, chr(10)) AS x FROM r)),
d AS (SELECT page_id, n, lower(regexp_extract(raw, '^([A-Za-z-]+)\\s*:', 1)) AS field, lower(trim(regexp_extract(raw, ':\\s*(.*)$', 1))) AS value FROM l WHERE raw NOT LIKE '#%' AND regexp_matches(raw, '^[A-Za-z-]+\\s*:')),
o AS (SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER w <> 'user-agent', true) THEN 1 ELSE 0 END AS starts FROM d WINDOW w AS (PARTITION BY page_id ORDER BY n)),
b AS (SELECT *, sum(starts) OVER (PARTITION BY page_id ORDER BY n) AS block FROM o),
a AS (SELECT u.page_id, u.value AS agent, min(u.n) AS n FROM b u JOIN b x ON u.page_id = x.page_id AND u.block = x.block AND x.field = 'disallow' AND x.value = '/' WHERE u.field = 'user-agent' AND u.value IN ({", ".join(f"'{w}'" for w in discovery.WATCHED_AGENTS)}) GROUP BY 1, 2),
g AS (SELECT page_id, string_agg(agent, ',' ORDER BY n) AS agents FROM a GROUP BY 1)
SELECT CAST(r.page_id AS STRING) AS domain, coalesce(trim(text) <> '', false) AS fetched, g.agents IS NOT NULL AS ai_blocked, coalesce(g.agents, '') AS agents FROM r LEFT JOIN g USING (page_id)"""


@query("robots_bans", _BANNED)
def robots_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    robots = data.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("domain"), F.when(F.col("page_id") % 5 != 0, F.expr(_ROBOTS)).alias("text"))
    return discovery.robots_bans(robots).select("domain", "fetched", "ai_blocked", F.array_join("blocked_agents", ",").alias("agents"))


@query("challenge_signs", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Cloudflare (cf-ray),Cloudflare (server)' WHEN 1 THEN 'Imperva Incapsula,CAPTCHA mention' WHEN 2 THEN 'Cloudflare challenge page' ELSE '' END AS signals FROM pages")
def challenge_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    headers = F.when(k == 0, F.create_map(F.lit("CF-Ray"), F.lit("1"), F.lit("Server"), F.lit("cloudflare"))).when(k == 1, F.create_map(F.lit("SERVER"), F.lit("Incapsula"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    body = F.concat(F.when(k == 1, "solve the CAPTCHA ").when(k == 2, "Just a moment... ").otherwise(""), "html")
    return data.table(spark, sf_dir, "pages").select("page_id", F.array_join(discovery.challenge_signs(headers, body), ",").alias("signals"))


# Candidate tables of two runs: the pages' hosts by even and by odd ids.
_MERGED = f"""{_HITS}, o AS (SELECT domain, count(DISTINCT url) AS n, list(DISTINCT url) AS urls FROM hits WHERE domain <> '' AND page_id % 3 < 2 GROUP BY domain), n AS (SELECT domain, count(DISTINCT url) AS n, list(DISTINCT url) AS urls FROM hits WHERE domain <> '' AND page_id % 3 > 0 GROUP BY domain)"""


_BOTH = "CASE WHEN n.n IS NULL THEN 'old' WHEN o.n IS NULL THEN 'new' WHEN length(domain) % 2 = 0 THEN 'new' ELSE 'old' END"


@query("candidates_merged", f"""WITH {_MERGED}, m AS (SELECT domain, {_BOTH} AS status, CAST(CASE WHEN o.n IS NULL THEN n.n WHEN n.n IS NULL THEN o.n ELSE len(list_distinct(list_concat(o.urls, n.urls))) END AS BIGINT) AS mention_count,
CASE WHEN length(domain) % 3 = 0 AND o.n IS NOT NULL THEN 'unknown' WHEN length(domain) % 3 = 1 AND n.n IS NOT NULL THEN 'co' END AS country FROM o FULL JOIN n USING (domain)) SELECT *, row_number() OVER (ORDER BY status, mention_count DESC, domain) AS place FROM m""")
def candidates_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, _ = _merged(spark, sf_dir)
    return discovery.listing_places(merged).select("domain", "status", "mention_count", F.col("recon.country.verdict").alias("country"), "place")


@query("hits_merged", f"""WITH {_MERGED}, u AS (SELECT domain, {_BOTH} AS won, o.urls AS a, n.urls AS b FROM o FULL JOIN n USING (domain)),
w AS (SELECT domain, unnest(CASE won WHEN 'old' THEN a ELSE b END) AS url, false AS lost FROM u), l AS (SELECT domain, unnest(CASE won WHEN 'old' THEN b ELSE a END) AS url, true AS lost FROM u),
e AS (SELECT * FROM w UNION ALL SELECT * FROM l ANTI JOIN w USING (domain, url)) SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY lost, url) AS place FROM e""")
def hits_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[1].select("domain", "url", "place")


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs merged; the older one's recon was stored without a country."""
    pages = data.table(spark, sf_dir, "pages").withColumn("domain", root_domain(F.col("url"))).where("domain is not null and domain <> ''")
    shape = "struct<country:struct<verdict:string,evidence:array<string>>>"

    def run(rows: DataFrame, status: str, country, length: int) -> tuple[DataFrame, DataFrame]:
        hits = number_rows(rows.select("domain", "url").distinct(), ["url"], ["domain"])
        t = F.when(F.length("domain") % 2 == 0, F.expr(f"timestamp '2024-01-0{2 if status == 'new' else 1} 00:00:00'")).otherwise(F.expr(f"timestamp '2024-01-0{1 if status == 'new' else 2} 00:00:00'"))
        recon = F.struct(country.alias("country")).cast(shape)
        g = hits.groupBy("domain").agg(F.count("*").alias("mention_count")).withColumns({"status": F.lit(status), "recon": F.when(F.length("domain") % 3 == length, recon), "discovered_at": t})
        return discovery.backfill_country(g), hits

    none = F.array().cast("array<string>")
    old = run(pages.where("page_id % 3 < 2"), "old", F.lit(None), 0)
    new = run(pages.where("page_id % 3 > 0"), "new", F.struct(F.lit("co").alias("verdict"), none.alias("evidence")), 1)
    return discovery.merge_candidate_tables(*old, *new)


@query("search_results_parsed", "SELECT page_id % 7 AS bucket, count(*) AS n FROM pages WHERE page_id % 4 <> 0 AND page_id % 5 <> 0 AND url <> '' GROUP BY 1")
def search_results_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    item = F.struct(F.when(n % 4 != 0, F.col("url")).alias("link"), F.when(n % 2 == 0, "t").alias("title"))
    body = F.when(n % 5 == 0, "not json").otherwise(F.to_json(F.struct(F.array(item).alias("organic"))))
    results = data.table(spark, sf_dir, "pages").select((n % 7).cast("string").alias("query"), F.lit("e").alias("engine"), body.alias("body"))
    return discovery.hits_from_results(results).groupBy(F.col("query").cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


# What a domain's home page says beside its own words, by the page's number.
_HOME_SAID = "CASE page_id % 5 WHEN 0 THEN ' renta $18,000 MXN en Guadalajara ' WHEN 1 THEN ' arriendo en Cali, canon y alquiler <script type=\"application/ld+json\">{}</script> ' WHEN 2 THEN ' estrato 4 ' ELSE '' END"


@query("discover", f"""WITH {_CANDIDATES}, top AS (SELECT domain FROM c WHERE status = 'new' ORDER BY mention_count DESC, first_seen, domain LIMIT 20), q AS (SELECT domain, string_agg(DISTINCT query, '; ' ORDER BY query) AS queries FROM hits GROUP BY domain),
p AS (SELECT h.domain, min(page_id) AS page_id FROM hits h GROUP BY domain), b AS (SELECT p.domain, p.page_id, coalesce(pages.html, '') || {_HOME_SAID.replace('page_id', 'p.page_id')} AS body FROM p JOIN pages USING (page_id)), t AS (SELECT *, {NORM.format('body')} AS x FROM b SEMI JOIN top USING (domain)),
r AS (SELECT domain, page_id, CASE WHEN length(x) < 20 THEN 0 ELSE least(1.0, (len(regexp_extract_all(x, '\\b(arriendo|alquiler|inmobiliaria|arrendar|canon|cali)\\b'))) / sqrt(len(string_split(x, ' '))) / 3) END AS rel FROM t)
SELECT c.domain, CASE WHEN r.page_id % 5 = 0 THEN 'foreign' ELSE c.status END AS status, CASE WHEN r.page_id % 5 = 1 THEN 'JSON-LD: yes' ELSE 'JSON-LD: no' END AS json_ld, CASE WHEN r.domain IS NULL THEN 'robots: not read' WHEN r.page_id % 3 = 0 THEN 'robots: bans gptbot' WHEN r.page_id % 3 = 1 THEN 'robots: bans *' ELSE 'robots: open' END AS robots,
  'challenges: none seen' AS challenges, 'relevance: ' || printf('%.2f', coalesce(rel, 0.0)) AS relevance, 'country: ' || CASE WHEN r.page_id % 5 = 0 THEN 'foreign' WHEN r.page_id % 5 = 2 THEN 'co' ELSE 'unknown' END AS country, 'queries: ' || q.queries AS queries FROM c LEFT JOIN r USING (domain) JOIN q USING (domain)""")
def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = data.table(spark, sf_dir, "pages").withColumn("domain", root_domain(F.col("url"))).where("domain is not null and domain <> ''")
    body = F.concat(F.coalesce("html", F.lit("")), F.expr(_HOME_SAID))
    homes = pages.groupBy("domain").agg(F.min_by(body, "page_id").alias("body"), F.lit(200).alias("status")).withColumn("headers", F.create_map(F.lit("server"), F.lit("x")))
    robots = pages.groupBy("domain").agg(F.min("page_id").alias("page_id")).select("domain", F.expr(_ROBOTS).alias("text"))
    found = discovery.discover(_hits(spark, sf_dir), homes, robots, IMPLEMENTED, ["Cali"], most=20)
    return discovery.summaries(found)


@query("page_links", r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS h FROM pages)
SELECT page_id, count(DISTINCT h) AS n FROM l WHERE url LIKE '%://%' AND h <> '' GROUP BY page_id""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = data.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body"))
    return extract.links(pages, "page_id").groupBy("page_id").agg(F.count("*").alias("n"))


@query("page_text", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS x FROM a)
SELECT page_id, md5(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS digest FROM b""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.table(spark, sf_dir, "pages").select("page_id", F.md5(extract.strip_tags(F.col("html"))).alias("digest"))


@query("page_titles", r"SELECT page_id, md5(trim(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '\"'), '&amp;', '&'))) AS digest FROM pages".replace('\\"', '"'))
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.table(spark, sf_dir, "pages").select("page_id", F.md5(extract.title(F.col("html"))).alias("digest"))


@query("links_united", r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s+href="/([^"]*)"', 1)) AS h FROM pages WHERE url LIKE '%://%'),
a AS (SELECT DISTINCT h, CASE WHEN length(h) % 2 = 0 THEN 'even' END AS hint FROM l WHERE page_id % 2 = 0), b AS (SELECT DISTINCT h, 'late' AS hint FROM l WHERE page_id % 3 = 0)
SELECT h AS link, coalesce(a.hint, b.hint) AS hint FROM a FULL JOIN b USING (h)""")
def links_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = data.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body"))
    found = extract.links(pages.where("url like '%://%'"), "page_id").withColumn("link", F.regexp_extract("link", r"://[^/]+/(.*)$", 1))
    a = found.where("page_id % 2 = 0").select("link", F.when(F.length("link") % 2 == 0, "even").alias("hint"))
    return extract.union_links(a, found.where("page_id % 3 = 0").select("link", F.lit("late").alias("hint")))


@query("domain_reviews", f"""WITH {_HITS}, d AS (SELECT domain, min(page_id) AS p FROM hits WHERE domain <> '' GROUP BY domain)
SELECT domain, p % 2 = 0 AS seen, CASE WHEN p % 3 = 0 THEN true ELSE CASE WHEN p % 2 = 0 THEN false END END AS eligible FROM d WHERE p % 2 = 0 OR p % 3 = 0""")
def domain_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = data.table(spark, sf_dir, "pages").select(root_domain(F.col("url")).alias("domain"), "page_id").where("domain is not null and domain <> ''").groupBy("domain").agg(F.min("page_id").alias("p"))
    old = d.where("p % 2 = 0").select("domain", F.lit(True).alias("seen"), F.lit(False).alias("eligible"))
    new = d.where("p % 3 = 0").select("domain", F.when(F.col("p") % 2 != 0, False).alias("seen"), F.lit(True).alias("eligible"))
    return discovery.set_domain_reviews(old, new)
