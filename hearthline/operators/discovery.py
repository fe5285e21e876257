"""Looking for new sources: search hits by domain, what is known of a domain, and how its home page reads."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import count_word, first_match, once
from ..functions.text import norm, norm_text
from ..functions.urls import root_domain
from .extract import json_ld_blocks
from .merge import upsert
from .numbering import number_rows

# Domains that are excluded and why, country suffixes of foreign domains, and domains that are no portals.
EXCLUDED = {
    "mercadolibre.com.co": "robots.txt prohíbe crawlers de IA",
    "puntopropiedad.com": "robots.txt prohíbe crawlers de IA",
    "habi.co": "solo venta, sin arriendos",
    "portalinmobiliario.com": "portal de MercadoLibre Chile, precios en CLP/UF",
    "mfserviciosinmobiliarios.com": "inmobiliaria de Guadalajara, México, precios en MXN",
}
FOREIGN_SUFFIXES = {
    "mx": "México", "cl": "Chile", "ar": "Argentina", "pe": "Perú", "ec": "Ecuador", "es": "España", "br": "Brasil", "uy": "Uruguay", "py": "Paraguay", "bo": "Bolivia",
    "ve": "Venezuela", "cr": "Costa Rica", "pa": "Panamá", "do": "República Dominicana", "gt": "Guatemala",
}
NO_PORTALS = (
    "facebook.com", "instagram.com", "youtube.com", "twitter.com", "x.com", "tiktok.com", "linkedin.com", "wikipedia.org", "google.com", "maps.google.com", "play.google.com",
    "apps.apple.com", "pinterest.com", "pinterest.com.co", "yellowpages.com", "paginasamarillas.com.co",
)
# Crawlers that a robots file may ban, words of rental pages, signs of the country.
WATCHED_AGENTS = ("claudebot", "anthropic-ai", "gptbot", "ccbot", "google-extended", "*")
RELEVANT_WORDS = ("arriendo", "alquiler", "inmobiliaria", "arrendar", "canon")
# Signs with what one of their matches is sure to hold, so that the pattern is tried only there.
HOME_SIGNS = (
    ("estrato", r"\bestratos?\b", ("estrato",)),
    ("NIT", r"\bnit\b", ("nit",)),
    ("cánon de arrendamiento", r"\bcanon de arrendamiento\b", ("canon de arrendamiento",)),
    ("COP pegado a un importe", r"\d[\d.,]*\s?cop\b|\bcop\s?\d[\d.,]*", ("cop",)),
    ("Valle del Cauca", r"\bvalle del cauca\b", ("valle del cauca",)),
    ("Jamundí", r"\bjamundi\b", ("jamundi",)),
    ("teléfono +57", r"\+57\s?\(?\d{2}|\+57\s?\(\d\)\s?\d", ("+57",)),
    ("administración junto a un precio", r"administracion[^\n]{0,40}?\d{4,}", ("administracion",)),
)
FOREIGN_MONEY = (
    ("mx", r"\d[\d.,]*\s?mxn\b|\bmxn\s?\$?\s?\d", ("mxn",)),
    ("cl", r"\buf\s?\d[\d.,]*\b|\d[\d.,]*\s?uf\b", ("uf",)),
    ("cl", r"\bclp\$?\s?\d|\d[\d.,]*\s?clp\b", ("clp",)),
    ("pe", r"\bs/\.?\s?\d", ("s/",)),
    ("es", r"\d[\d.,]*\s?€|€\s?\d[\d.,]*", ("€",)),
)
FOREIGN_PLACES = (
    ("mx", "jalisco"), ("mx", "guadalajara"), ("mx", "cdmx"), ("mx", "monterrey"), ("cl", "santiago"), ("cl", "las condes"), ("cl", "providencia"), ("cl", "nunoa"), ("ar", "buenos aires"), ("pe", "lima"),
)
NOT_AFTER = {"santiago": r"(?!\s+de\s+cali)"}
CHALLENGE_HEADERS = (("cf-ray", None, "Cloudflare (cf-ray)"), ("server", "incapsula", "Imperva Incapsula"), ("server", "cloudflare", "Cloudflare (server)"), ("x-akamai-transformed", None, "Akamai"))
CHALLENGE_WORDS = (("just a moment", "Cloudflare challenge page"), ("checking your browser", "browser-check challenge"), ("captcha", "CAPTCHA mention"))
HIT_SCHEMA = "organic array<struct<link:string,title:string,description:string>>"


def hits_from_results(results: DataFrame) -> DataFrame:
    """query, engine, pos, url, title, snippet of search results (query, engine, body as JSON); entries without a link and malformed bodies give none."""
    parsed = results.select("query", "engine", F.posexplode(F.from_json("body", HIT_SCHEMA)["organic"]).alias("pos", "x"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return parsed.where("x.link is not null and x.link <> ''").select("query", "engine", "pos", F.col("x.link").alias("url"), text("x.title").alias("title"), text("x.description").alias("snippet"))


def _tagged(hits: DataFrame) -> DataFrame:
    return hits.withColumn("domain", root_domain(F.col("url"))).where("domain is not null and domain <> ''")


def by_domain(hits: DataFrame, order: Iterable[str] = ("query", "url")) -> DataFrame:
    """domain, mention_count, its distinct queries and first_seen of hits(query, engine, url, title); unparseable URLs are left out.

    The hits themselves stay rows, which domain_hits numbers: no domain's are gathered. queries are those of the searches made.
    """
    return _tagged(hits).groupBy("domain").agg(F.count("*").alias("mention_count"), F.array_sort(F.collect_set("query")).alias("queries"), F.min(F.struct(*order)).alias("first_seen"))


def domain_hits(hits: DataFrame, order: Iterable[str] = ("query", "url")) -> DataFrame:
    """domain, place (from 1, in the order) and query, url, title, engine of each hit. A domain with a third of all hits is as many
    tasks as it needs: places are counted over ranges of (domain, order)."""
    rows = _tagged(hits).select("domain", "query", "url", "title", "engine")
    placed = number_rows(rows, [*order, *(c for c in ("query", "url", "title", "engine") if c not in order)], ["domain"])
    return placed.select("domain", (F.col("place") + 1).alias("place"), "query", "url", "title", "engine")


def with_found_via(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """A few candidates, such as those to examine, with found_via: the hits of each (as domain_hits has them) in their order, as one array."""
    few = hits.join(candidates.select("domain"), "domain", "left_semi")
    names = [c for c in hits.columns if c != "domain"]
    nested = few.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("found_via"))
    return candidates.join(nested, "domain", "left")


def domain_rules(spark: SparkSession, implemented: Iterable[str]) -> DataFrame:
    """suffix, priority, place, reason, note: a few dozen rows."""
    rows = [(d.lower(), 0, k, "known_implemented", None) for k, d in enumerate(implemented)]
    rows += [(d, 1, k, "known_excluded", note) for k, (d, note) in enumerate(EXCLUDED.items())]
    rows += [(d, 2, k, "blocklisted", None) for k, d in enumerate(NO_PORTALS)]
    rows += [(t, 3, k, "foreign", f"TLD .{t} ({c})") for k, (t, c) in enumerate(FOREIGN_SUFFIXES.items())]
    return spark.createDataFrame(rows, "suffix string, priority int, place int, reason string, note string")


#: Rules that are broadcast at most; more are joined by a shuffle.
MAX_RULES = 100_000


def classify_domains(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """domains with reason and note of the first rule whose suffix the domain is or stands below; null: a new one.

    Each domain's own suffixes are joined by equality with the rules, which are broadcast (MAX_RULES at most): no rule is tried on
    every domain.
    """
    rules = F.broadcast(rules) if rules.count() <= MAX_RULES else rules
    labels = F.split(F.regexp_replace(F.lower("domain"), r"^www\.", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keyed = domains.select("domain").distinct().select("domain", F.explode(suffixes).alias("suffix"))
    first = keyed.join(rules, "suffix").groupBy("domain").agg(F.min(F.struct("priority", "place", "reason", "note")).alias("r"))
    return domains.join(first, "domain", "left").select(*domains.columns, F.col("r.reason").alias("reason"), F.col("r.note").alias("note"))


def to_examine(candidates: DataFrame, n: int) -> DataFrame:
    """The n new candidates with the most mentions, earlier ones first among equals."""
    return candidates.where("status = 'new'").orderBy(F.desc("mention_count"), "first_seen", "domain").limit(n)


def listing_order(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy("status", F.desc("mention_count"), "domain")


def with_recon(candidates: DataFrame, recon: DataFrame) -> DataFrame:
    """Candidates with the recon of their domain; a new one that proves foreign gets that status."""
    joined = candidates.join(recon.select("domain", "recon"), "domain", "left")
    return joined.withColumn("status", F.when((F.col("status") == "new") & (F.col("recon.country.verdict") == "foreign"), "foreign").otherwise(F.col("status")))


def backfill_country(candidates: DataFrame) -> DataFrame:
    """An unknown country for recon structs stored without one."""
    unknown = F.struct(F.lit("unknown").alias("verdict"), F.array().cast("array<string>").alias("evidence"))
    return candidates.withColumn("recon", F.when(F.col("recon").isNotNull(), F.col("recon").withField("country", F.coalesce("recon.country", unknown))))


def merge_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidate tables merged by domain: the later discovered_at wins (ties: new), found_via is its hits and the other's with
    other URLs, mention_count their number; recon is the winner's, else the other's."""
    names = [c for c in old.columns if c != "domain"]
    pick = lambda p: F.struct(*(F.col(f"{p}.{c}").alias(c) for c in names))
    o, n = old.select("domain", F.struct(*names).alias("o")), new.select("domain", F.struct(*names).alias("n"))
    both = o.join(n, "domain", "full_outer")
    new_wins = F.col("o").isNull() | (F.col("n.discovered_at") >= F.col("o.discovered_at"))
    both = both.withColumn("w", F.when(new_wins & F.col("n").isNotNull(), pick("n")).otherwise(pick("o"))).withColumn("l", F.when(new_wins & F.col("n").isNotNull(), F.col("o")).otherwise(F.col("n")))
    urls = F.transform(F.col("w.found_via"), lambda x: x["url"])
    other = F.filter(F.coalesce(F.col("l.found_via"), F.expr("filter(w.found_via, x -> false)")), lambda x: ~F.array_contains(urls, x["url"]))
    via = F.concat(F.col("w.found_via"), other)
    merged = F.col("l").isNotNull()
    value = {c: F.col(f"w.{c}") for c in names} | {"found_via": via, "mention_count": F.when(merged, F.size(via).cast("bigint")).otherwise(F.col("w.mention_count")), "recon": F.coalesce("w.recon", "l.recon")}
    return both.select("domain", *(value[c].alias(c) for c in names)).select(*old.columns)


def merge_candidate_tables(old: DataFrame, old_hits: DataFrame, new: DataFrame, new_hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, hits): merge_candidates where each table's hits are rows (domain, place and more) beside it.

    Of a domain in both tables the winner's hits come first, then the other's with URLs that the winner lacks; they are told apart by
    (domain, url) and numbered by ranges, so a domain's hits need no task, and no array, of their own.
    """
    names = [c for c in old.columns if c != "domain"]
    o, n = old.select("domain", F.struct(*names).alias("o")), new.select("domain", F.struct(*names).alias("n"))
    both = o.join(n, "domain", "full_outer").withColumn("newer", F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n.discovered_at") >= F.col("o.discovered_at"))))
    both = both.withColumns({"w": F.when(F.col("newer"), F.col("n")).otherwise(F.col("o")), "l": F.when(F.col("newer"), F.col("o")).otherwise(F.col("n"))})
    sides = both.select("domain", "newer")
    tagged = [h.withColumn("_new", F.lit(k)).join(sides, "domain").withColumn("_lost", F.col("_new") != F.col("newer")).drop("_new", "newer") for k, h in ((False, old_hits), (True, new_hits))]
    every = tagged[0].unionByName(tagged[1])
    won, lost = every.where("not _lost"), every.where("_lost")
    kept = lost.join(won.select("domain", "url").distinct(), ["domain", "url"], "left_anti").select(*every.columns)
    hits = number_rows(won.unionByName(kept), ["_lost", "place", "url"], ["domain"], "_place").drop("place", "_lost").withColumn("place", F.col("_place") + 1).select(*old_hits.columns)
    counts = hits.groupBy("domain").agg(F.count("*").alias("_n"))
    merged = F.col("l").isNotNull()
    value = {c: F.col(f"w.{c}") for c in names} | {"mention_count": F.when(merged, F.coalesce("_n", F.lit(0)).cast("bigint")).otherwise(F.col("w.mention_count")), "recon": F.coalesce("w.recon", "l.recon")}
    return both.join(counts, "domain", "left").select("domain", *(value[c].alias(c) for c in names)).select(*old.columns), hits


def listing_places(candidates: DataFrame) -> DataFrame:
    """candidates with place (from 1) in the order of listing_order."""
    placed = number_rows(candidates, ["status", F.desc("mention_count"), "domain"], name="_place")
    return placed.select(*candidates.columns, (F.col("_place") + 1).alias("place"))


def relevance(body: Column, cities: Iterable[str] = ()) -> Column:
    """0 to 1: whole-word hits of rental words and city names over the root of the word count; 0 for texts under 20 characters."""
    names = [re.sub(r"([^a-z0-9 ])", r"\\\1", w) for w in (*RELEVANT_WORDS, *(norm_text(c) for c in cities if norm_text(c)))]

    def rate(text: Column) -> Column:
        hits = sum((count_word(text, w) for w in names), F.lit(0))
        words = F.greatest(F.size(F.split(text, " ")), F.lit(1))
        return F.when(F.length(text) < 20, 0.0).otherwise(F.least(F.lit(1.0), hits / F.sqrt(words) / 3))

    return once(norm(body), rate)


def country_verdicts(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """key, verdict, evidence, signs: "foreign" with two signs or more of one foreign country and none of home, "co" with home
    signs alone, else "unknown". evidence holds six at most.

    The signs are Column expressions over one normalised text, counted by country within the row: no join, no shuffle. A sign's
    pattern is tried only on texts that hold a literal of it.
    """
    text = F.col("_t")

    def sign(kind: str, pattern: str, literals: tuple[str, ...], label: str | None) -> Column:
        hit = first_match(text, pattern, literals)
        said = F.lit(f"{kind}: {label}") if label else F.concat(F.lit(f'{kind}: "'), F.btrim(hit), F.lit('"'))
        return F.when(hit.isNotNull(), said)

    found = lambda rules: F.array_compact(F.array(*rules))
    countries = sorted({x[0] for x in (*FOREIGN_MONEY, *FOREIGN_PLACES)})
    ordered = list(dict.fromkeys([x[0] for x in FOREIGN_MONEY] + [x[0] for x in FOREIGN_PLACES]))
    per = {c: found([sign("moneda extranjera", p, has, None) for k, p, has in FOREIGN_MONEY if k == c] + [sign("topónimo", rf"\b{w}\b{NOT_AFTER.get(w, '')}", (w,), None) for k, w in FOREIGN_PLACES if k == c]) for c in countries}
    home = found([sign("señal CO", p, has, label) for label, p, has in HOME_SIGNS])
    signs = pages.select(key, norm(F.col(body)).alias("_t")).select(key, *(per[c].alias(f"_{c}") for c in countries), home.alias("_home"))
    foreign = F.concat(*(F.col(f"_{c}") for c in ordered))
    most = F.greatest(*(F.size(f"_{c}") for c in countries))
    verdict = F.when((F.size("_home") == 0) & (most >= 2), "foreign").when((F.size("_home") > 0) & (F.size(foreign) == 0), "co").otherwise("unknown")
    evidence = F.slice(F.array_distinct(F.concat(foreign, F.col("_home"))), 1, 6)
    return signs.select(key, verdict.alias("verdict"), evidence.alias("evidence"), (F.size(foreign) + F.size("_home")).alias("signs"))


def challenge_signs(headers: Column, body: Column) -> Column:
    """Distinct hints of bot challenges in the headers (a map, names in any case) and the first 5000 characters."""
    lower = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    seen = [F.when(F.try_element_at(lower, F.lit(h)).isNotNull() & (F.lit(True) if m is None else F.contains(F.lower(F.try_element_at(lower, F.lit(h))), F.lit(m))), label) for h, m, label in CHALLENGE_HEADERS]
    start = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 5000))
    seen += [F.when(F.contains(start, F.lit(w)), label) for w, label in CHALLENGE_WORDS]
    return F.array_distinct(F.array_compact(F.array(*seen)))


def robots_bans(robots: DataFrame) -> DataFrame:
    """domain, fetched, ai_blocked, blocked_agents of robots(domain, text): watched agents whose block holds "Disallow: /".

    One fold over the array of a text's lines, in its own row: nothing is exploded or shuffled. The state is the block's agents,
    whether the last line was one of them, and what is banned so far. An agent line after another kind of line begins a new block;
    blank, comment and malformed lines count for nothing. A ban counts for all agents of its block, and agents are listed in the order of their first lines.
    """
    rule = r"^([A-Za-z-]+)\s*:\s*(.*)$"
    raw = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    rules = F.filter(raw, lambda x: ~F.startswith(x, F.lit("#")) & x.rlike(rule))
    lines = F.transform(rules, lambda x: F.struct(F.lower(F.regexp_extract(x, rule, 1)).alias("field"), F.btrim(F.regexp_extract(x, rule, 2)).alias("value")))
    none = F.array().cast("array<struct<n:int,agent:string>>")
    start = F.struct(F.lit(0).alias("n"), none.alias("block"), F.lit(False).alias("open"), none.alias("banned"))

    def step(s: Column, line: Column) -> Column:
        agent = line["field"] == "user-agent"
        one = F.struct(s["n"].alias("n"), F.lower(line["value"]).alias("agent"))
        block = F.when(agent, F.array_append(F.when(s["open"], s["block"]).otherwise(none), one)).otherwise(s["block"])
        ban = ~agent & (line["field"] == "disallow") & (line["value"] == "/")
        return F.struct((s["n"] + 1).alias("n"), block.alias("block"), agent.alias("open"), F.when(ban, F.array_union(s["banned"], s["block"])).otherwise(s["banned"]).alias("banned"))

    banned = F.array_sort(F.aggregate(lines, start, step)["banned"])
    agents = F.array_distinct(F.filter(F.transform(banned, lambda x: x["agent"]), lambda a: a.isin(*WATCHED_AGENTS)))
    read = F.coalesce(F.btrim("text", F.lit(" \t\r\n")) != "", F.lit(False))
    out = robots.select("domain", read.alias("fetched"), agents.alias("blocked_agents"))
    return out.select("domain", "fetched", (F.size("blocked_agents") > 0).alias("ai_blocked"), "blocked_agents")


def recon(homes: DataFrame, robots: DataFrame, cities: Iterable[str] = ()) -> DataFrame:
    """domain and recon struct of homes(domain, status, headers, body): reachable, status_code, robots, anti_bot, relevance, has_json_ld, country."""
    verdicts = country_verdicts(homes, "domain", "body")
    bans = robots_bans(robots).select("domain", F.struct("fetched", "ai_blocked", "blocked_agents").alias("robots"))
    j = homes.join(bans, "domain", "left").join(verdicts, "domain", "left")
    hints = challenge_signs(F.col("headers"), F.col("body"))
    none = F.struct(F.lit(False).alias("fetched"), F.lit(False).alias("ai_blocked"), F.array().cast("array<string>").alias("blocked_agents"))
    return j.select(
        "domain",
        F.struct(
            F.coalesce(F.col("status").between(200, 399), F.lit(False)).alias("reachable"), F.col("status").alias("status_code"), F.coalesce("robots", none).alias("robots"),
            F.struct((F.size(hints) > 0).alias("hinted"), hints.alias("signals")).alias("anti_bot"),
            F.when(F.col("body").isNull(), 0.0).otherwise(relevance(F.col("body"), cities)).alias("relevance"),
            (F.size(json_ld_blocks(F.coalesce("body", F.lit("")))) > 0).alias("has_json_ld"),
            F.struct(F.coalesce("verdict", F.lit("unknown")).alias("verdict"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence")).alias("country"),
        ).alias("recon"),
    )


def summaries(candidates: DataFrame) -> DataFrame:
    """domain, status and one line of facts each on robots, challenges, relevance, JSON-LD, country and queries."""
    r = F.col("recon")
    robots = F.when(r.isNull() | ~r["robots"]["fetched"], "robots: not read").when(r["robots"]["ai_blocked"], F.concat(F.lit("robots: bans "), F.array_join(r["robots"]["blocked_agents"], ", "))).otherwise("robots: open")
    bots = F.when(r["anti_bot"]["hinted"], F.concat(F.lit("challenges: "), F.array_join(r["anti_bot"]["signals"], ", "))).otherwise("challenges: none seen")
    country = F.concat(F.lit("country: "), F.coalesce(r["country"]["verdict"], F.lit("unknown")))
    data = F.when(F.coalesce(r["has_json_ld"], F.lit(False)), "JSON-LD: yes").otherwise("JSON-LD: no")
    return candidates.select("domain", "status", data.alias("json_ld"), robots.alias("robots"), bots.alias("challenges"), F.concat(F.lit("relevance: "), F.format_string("%.2f", F.coalesce(r["relevance"], F.lit(0.0)))).alias("relevance"), country.alias("country"), F.concat(F.lit("queries: "), F.array_join("queries", "; ")).alias("queries"))


def discover(hits: DataFrame, homes: DataFrame, robots: DataFrame, implemented: Iterable[str], cities: Iterable[str] = (), most: int = 20) -> DataFrame:
    """Candidates of search hits: grouped by domain, classified, the most mentioned new ones examined, foreign ones marked."""
    spark = hits.sparkSession
    grouped = classify_domains(by_domain(hits), domain_rules(spark, implemented)).withColumn("status", F.coalesce("reason", F.lit("new")))
    chosen = to_examine(grouped, most).select("domain")
    return with_recon(grouped, recon(homes.join(chosen, "domain", "left_semi"), robots.join(chosen, "domain", "left_semi"), cities))


def split_new(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, evaluated) candidates."""
    return candidates.where("status = 'new'"), candidates.where("status <> 'new'")


def set_domain_reviews(reviews: DataFrame, patches: DataFrame) -> DataFrame:
    """Reviews of domains (domain, seen, eligible) with patches of the same columns; null fields leave what is there."""
    return upsert(reviews, patches, "domain", keep_null=True)
