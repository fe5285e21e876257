import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline.operators import discovery, marked, report
from hearthline.operators.rank import RankOptions

LINKS = "array<struct<source:string,url:string>>"
ROW = f"entry_id string, ts timestamp, row_pos int, source string, source_listing_id string, url string, source_links {LINKS}"


def rows_of(spark, entries):
    t0 = datetime(2024, 1, 1)
    out = [(f"e{e:03}", t0 - timedelta(hours=e), k, "s", i, u, [("s", x) for x in links]) for e, rows in enumerate(entries) for k, (i, u, links) in enumerate(rows)]
    return spark.createDataFrame(out, ROW)


def brute(entries):
    seen, kept = set(), []
    for rows in entries:
        for i, u, links in rows:
            keys = {f"u:{x}" for x in links if x} | ({f"u:{u}"} if u else set()) | {f"s:s:{i}"}
            if not keys & seen:
                kept.append(i)
            seen |= keys
    return sorted(kept)


def test_alias_chain(spark):
    entries = [[("x", "a", []), ("w", "a", ["c"]), ("v", "c", [])]]
    assert [r.source_listing_id for r in marked.first_occurrences(rows_of(spark, entries)).collect()] == ["x"] == brute(entries)


@pytest.mark.parametrize("seed", range(4))
def test_first_occurrences_brute_force(spark, seed):
    rng = random.Random(seed)
    entries = [[(f"i{rng.randrange(500)}", f"u{rng.randrange(40)}", [f"u{rng.randrange(60)}" for _ in range(rng.randrange(3))]) for _ in range(rng.randrange(6))] for _ in range(12)]
    assert sorted(r.source_listing_id for r in marked.first_occurrences(rows_of(spark, entries)).collect()) == brute(entries)


def test_reviews_states_export(spark):
    rows = rows_of(spark, [[("1", "a", ["b"]), ("2", "c", []), ("3", "https://manual.local/row-1", [])]])
    for name, value in {"barrio": "=x", "conjunto": None, "address": None, "city": "Cali", "area_m2": 100.0, "price": None, "cost_per_m2": 10.5, "distance_km": 1.25, "driving_km": None, "bedrooms": 3}.items():
        rows = rows.withColumn(name, F.lit(value).cast("double" if name.endswith(("_m2", "_km", "price")) else "string"))
    reviews = spark.createDataFrame([("u:b", True, None), ("s:s:2", True, True)], "key string, seen boolean, eligible boolean")
    m = marked.with_reviews(marked.first_occurrences(rows), reviews)
    assert {r.source_listing_id: r.state for r in m.collect()} == {"1": "seen", "2": "eligible", "3": "none"}
    assert {r.state: r.n for r in marked.state_counts(m.where("state <> 'none'")).collect()} == {"eligible": 1, "seen": 1, "none": 0}
    out = marked.export_rows(m)
    assert out.columns == ["Barrio/Conjunto", "Ciudad", "m²", "Precio", "$/m²", "Distancia (km)", "Habitaciones", "Estado", "Enlace"]
    got = {r["Estado"]: r for r in out.collect()}
    assert (got["Vista"]["Barrio/Conjunto"], got["Vista"]["$/m²"], got["Vista"]["Distancia (km)"], got["Sin estado"]["Enlace"]) == ("'=x", 11.0, 1.3, "")
    new = marked.set_reviews(reviews, spark.createDataFrame([(["u:b", "u:z"], None, True)], "keys array<string>, seen boolean, eligible boolean"))
    assert {r.key: (r.seen, r.eligible) for r in new.collect()} == {"u:b": (True, True), "s:s:2": (True, True), "u:z": (None, True)}


def test_history(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    old = spark.createDataFrame([("1", t(1), "a", "list"), ("2", t(2), "b", "scrape")], "id string, ts timestamp, sig string, mode string")
    new = spark.createDataFrame([("3", t(3), "a", "list")], old.schema)
    assert [r.id for r in marked.add_entries(old, new, 15).collect()] == ["3", "2"]
    assert marked.latest_of_mode(old, "list").first().id == "1"
    assert marked.remove_entry(old, "1").count() == 1 and marked.of_mode(old, "list", keep=False).first().id == "2"


@pytest.mark.parametrize(("text", "want"), [
    ("User-agent: GPTBot\nDisallow: /", ["gptbot"]),
    ("User-agent: a\nUser-agent: CCBot\n\n# x\nDisallow: /\nUser-agent: gptbot\nDisallow: /x", ["ccbot"]),
    ("User-agent: *\nDisallow: /privado/", []),
    ("User-agent: *\nAllow: /\nDisallow: /", ["*"]),
    ("User-agent: gptbot\nDisallow: /\nUser-agent: gptbot\nDisallow: /", ["gptbot"]),
    ("", None), (None, None),
])
def test_robots(spark, text, want):
    r = discovery.robots_bans(spark.createDataFrame([("d", text)], "domain string, text string")).first()
    assert (r.fetched, r.ai_blocked, r.blocked_agents) == (want is not None, bool(want), want or [])


def brute_robots(text):
    agents, previous, out = [], False, []
    for line in text.split("\n"):
        field, mark, value = line.partition(":")
        if line.startswith("#") or not mark:
            continue
        if field.lower() == "user-agent":
            agents = [*agents, value.strip().lower()] if previous else [value.strip().lower()]
            previous = True
        else:
            previous = False
            if field.lower() == "disallow" and value.strip() == "/":
                out += [a for a in agents if a in discovery.WATCHED_AGENTS]
    return list(dict.fromkeys(out))


def test_robots_brute_force(spark):
    rng = random.Random(5)
    lines = ["User-agent: gptbot", "User-agent: x", "User-Agent: *", "Disallow: /", "Disallow: /a", "Allow: /", "", "# c", "nonsense"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))) + "\nX: y" for _ in range(60)]
    got = {r.domain: sorted(r.blocked_agents) for r in discovery.robots_bans(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "domain string, text string")).collect()}
    assert got == {str(k): sorted(brute_robots(t)) for k, t in enumerate(texts)}


@pytest.mark.parametrize(("html", "want"), [
    ("$18,000 MXN en Guadalajara", "foreign"), ("18,000 MXN y Lima", "unknown"), ("Estrato 4 en Cali", "co"), ("estrato 4, desde 3.500 UF en Santiago", "unknown"),
    ("Santiago de Cali", "unknown"), ("moneda: USD MXN CLP", "unknown"), ("", "unknown"), (None, "unknown"), ("Colombia (+57)", "unknown"), ("+57 300", "co"),
])
def test_country(spark, html, want):
    assert discovery.country_verdicts(spark.createDataFrame([(1, html)], "page_id int, html string")).first().verdict == want


def test_relevance(spark):
    rows = [("arriendo de casas en Cali, canon bajo",), ("calidad y localidad de nada en absoluto",), ("corto",), (None,), ("arriendo " * 400,)]
    got = [r.r for r in spark.createDataFrame(rows, "h string").coalesce(1).select(discovery.relevance(F.col("h"), ["Cali"]).alias("r")).collect()]
    assert 0 < got[0] < 1 and got[1:4] == [0.0, 0.0, 0.0] and got[4] == 1.0


def test_classification(spark):
    rules = discovery.domain_rules(spark, ["portal.co"])
    names = ["m.portal.co", "habi.co", "m.facebook.com", "casas.com.mx", "nueva.com.co", "notportal.co", "mx"]
    got = {r.domain: r.reason for r in discovery.classify_domains(spark.createDataFrame([(n,) for n in names], "domain string"), rules).collect()}
    assert got == {"m.portal.co": "known_implemented", "habi.co": "known_excluded", "m.facebook.com": "blocklisted", "casas.com.mx": "foreign", "nueva.com.co": None, "notportal.co": None, "mx": "foreign"}


CANDIDATE = "domain string, status string, found_via array<struct<url:string>>, mention_count bigint, recon struct<country:struct<verdict:string,evidence:array<string>>>, discovered_at timestamp"


@pytest.mark.parametrize("seed", range(2))
def test_merge_candidates(spark, seed):
    rng = random.Random(seed)
    t = lambda: datetime(2024, 1, rng.randrange(1, 4))
    recon = lambda: ((("co", []),) if rng.random() < 0.5 else None)
    make = lambda status: [(f"d{k}", status, [(f"u{rng.randrange(6)}",) for _ in range(2)], 2, recon(), t()) for k in range(20) if rng.random() < 0.7]
    old, new = make("old"), make("new")
    want = {c[0]: c for c in old}
    for n in new:
        p = want.get(n[0])
        if p:
            a, b = (n, p) if n[5] >= p[5] else (p, n)
            via = [*a[2], *(x for x in b[2] if x not in a[2])]
            want[n[0]] = (n[0], a[1], via, len(via), a[4] or b[4], a[5])
        else:
            want[n[0]] = n
    o, n = spark.createDataFrame(old, CANDIDATE), spark.createDataFrame(new, CANDIDATE)
    hits = lambda df: df.select("domain", F.posexplode("found_via").alias("place", "x")).select("domain", "place", "x.url")
    merged, rows = discovery.merge_candidate_tables(o.drop("found_via"), hits(o), n.drop("found_via"), hits(n))
    by_place = {}
    for r in sorted(rows.collect(), key=lambda r: r.place):
        by_place.setdefault(r.domain, []).append((r.place, r.url))
    assert by_place == {d: list(enumerate((x[0] for x in c[2]), 1)) for d, c in want.items()}
    assert {r.domain: (r.status, r.mention_count, r.recon is not None, r.discovered_at) for r in merged.collect()} == {d: (c[1], c[3], c[4] is not None, c[5]) for d, c in want.items()}
    got = discovery.merge_candidates(o, n).collect()
    assert {r.domain: (r.status, [x.url for x in r.found_via], r.mention_count, r.recon is not None, r.discovered_at) for r in got} == {d: (c[1], [x[0] for x in c[2]], c[3], c[4] is not None, c[5]) for d, c in want.items()}


def test_hits(spark):
    body = '{"organic":[{"link":"https://a.co/1","title":"t"},{"title":"no link"},{"link":"https://www.a.co/2"}]}'
    results = spark.createDataFrame([("q", "g", body), ("q", "g", "{bad"), ("q", "g", '{"organic":"no"}')], "query string, engine string, body string")
    hits = discovery.hits_from_results(results)
    assert hits.count() == 2
    (g,) = discovery.by_domain(hits).collect()
    assert (g.domain, g.mention_count, g.queries) == ("a.co", 2, ["q"])


def test_a_domain_of_most_hits(spark):
    """Its hits are rows of many tasks, and in their order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hits = spark.range(4000).select(F.lit("q").alias("query"), F.lit("g").alias("engine"), F.concat(F.when(F.col("id") % 4 < 3, "https://hot.co/").otherwise("https://d.co/"), F.format_string("%05d", "id")).alias("url"), F.lit("t").alias("title"))
        placed = discovery.domain_hits(hits)
        parts = placed.where("domain = 'hot.co'").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) >= 3 and max(r["count"] for r in parts) < 2000
        rows = sorted((r.place, r.url) for r in placed.where("domain = 'hot.co'").collect())
        assert [p for p, _ in rows] == list(range(1, 3001)) and [u for _, u in rows] == sorted(u for _, u in rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_report(spark):
    top = spark.createDataFrame([(1, "Pance", None, None, 100.0, 2e6, None, 20000.0, None, None, 1.25, 3, None, 4, None, "300", True, ["a", "b"], "a", "u")], f"rank int, barrio string, conjunto string, address string, area_m2 double, price double, admin double, cost_per_m2 double, driving_km double, driving_min double, distance_km double, bedrooms int, bathrooms int, estrato int, agency string, phone string, has_whatsapp boolean, merged_sources array<string>, source string, url string")
    (r,) = report.report_rows(top).collect()
    assert list(r)[1:] == ["1", "Pance", "100", "$2.000.000", "—", "$20.000", "1.3 km", "3/—", "4", "—", "300 (WA)", "a+b", "[ver](u)"]
    text = report.report_text(top, RankOptions()).first().text
    assert "Best value: #1 Pance" in text and text.count("| Pance |") == 1
    assert "No listing" in report.report_text(top.limit(0), RankOptions()).first().text


def test_candidates_split_and_signature(spark):
    from hearthline.functions.labels import search_signature
    from hearthline.operators.discovery import split_new

    c = spark.createDataFrame([("a", "new"), ("b", "foreign"), ("c", "new")], "domain string, status string")
    assert [sorted(r.domain for r in part.collect()) for part in split_new(c)] == [["a", "c"], ["b"]]
    assert spark.range(1).select(search_signature(F.lit("x"), F.lit(None).cast("string"), F.lit(2))).first()[0] == "x||2"


@pytest.mark.parametrize("seed", range(3))
def test_kept_occurrences_follow_updates(spark, seed):
    """Adding and removing entries gives what working all histories anew gives; untouched keys keep their rows."""
    rng = random.Random(seed)
    shape = "entry_id string, ts timestamp, row_pos int, source string, source_listing_id string, url string, source_links array<struct<source:string,url:string>>"
    make = lambda e: [(f"e{e}", datetime(2024, 1, 1 + e % 20), k, "s", str(rng.randrange(60)), rng.choice(["", f"u{rng.randrange(40)}"]), [("x", f"v{rng.randrange(40)}")] * rng.randrange(2)) for k in range(8)]
    entries = {f"e{e}": make(e) for e in range(14)}
    frame = lambda names: spark.createDataFrame([r for n in names for r in entries[n]], shape)
    before, later, removed = [f"e{k}" for k in range(10)], [f"e{k}" for k in range(10, 14)], rng.sample([f"e{k}" for k in range(10)], 3)
    got = marked.update_occurrences(marked.occurrences(frame(before)), frame(before), frame(later), removed)
    want = marked.occurrences(frame([n for n in before if n not in removed] + later))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(got.first) == plain(want.first) and plain(got.kept) == plain(want.kept)
    nothing = marked.update_occurrences(want, frame([n for n in before if n not in removed] + later), frame(before).limit(0), [])
    assert plain(nothing.first) == plain(want.first) and plain(nothing.kept) == plain(want.kept)


def test_read_history_and_marked_houses(spark, tmp_path):
    from hearthline.plans.entries import marked_houses
    from hearthline.sources.stored import read_history

    (tmp_path / "h.json").write_text(
        '{"id":"a","ts":"2024-01-02T00:00:00Z","sig":"s","mode":"scrape","label":"l","meta":{"refLabel":"Pance"},"result":{"ranked":[{"source":"x","source_listing_id":"1","url":"https://x/1","barrio":"=Sur","price":2.0,"area_m2":1.0,"cost_per_m2":2.0},{"source":"x","source_listing_id":"2","url":"https://x/2"}]}}\n'
        '{"id":"b","ts":"2024-01-01T00:00:00Z","result":{"ranked":[{"source":"y","source_listing_id":"9","url":"https://x/1"}]}}\n{"id":"c","ts":"2024-01-03T00:00:00Z"}\n'
    )
    history = read_history(spark, str(tmp_path))
    assert {r.id: (r.ref_label, len(r.ranked or [])) for r in history.collect()} == {"a": ("Pance", 2), "b": (None, 1), "c": (None, 0)}
    reviews = spark.createDataFrame([("u:https://x/1", True, None)], "key string, seen boolean, eligible boolean")
    counts, chosen, exported = marked_houses(history, reviews)
    assert {r.state: r.n for r in counts.collect()} == {"eligible": 0, "seen": 1, "none": 1}
    assert [(r.entry_id, r.source_listing_id) for r in chosen.collect()] == [("a", "1")] and exported.first()["Barrio/Conjunto"] == "'=Sur"
    assert chosen.select("state").first()[0] == "seen" and marked_houses(history, reviews, [])[1].count() == 0


def test_large_update_is_worked_out_anew(spark, monkeypatch):
    """With more keys than are broadcast, the update is what all histories give anew, and its plans hold no join of all rows."""
    rng = random.Random(7)
    entries = [[(f"i{rng.randrange(60)}", f"u{rng.randrange(40)}", [f"u{rng.randrange(60)}" for _ in range(rng.randrange(3))]) for _ in range(rng.randrange(6))] for _ in range(14)]
    rows = rows_of(spark, entries)
    before, later = rows.where("entry_id < 'e010'"), rows.where("entry_id >= 'e010'")
    old = marked.occurrences(before)
    monkeypatch.setattr(marked, "MAX_TOUCHED", 0)
    got, want = marked.update_occurrences(old, before, later, ["e003", "e007"]), marked.occurrences(rows.where("entry_id not in ('e003', 'e007')"))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(got.first) == plain(want.first) and plain(got.kept) == plain(want.kept)
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in got)


def test_first_marked(spark):
    """Reviews by key and reviews by house tell the same; a key may be reviewed more than once. Of rows at one place that share a key one is kept."""
    rng = random.Random(3)
    entries = [[(f"i{rng.randrange(90)}", f"u{rng.randrange(60)}", [f"u{rng.randrange(60)}" for _ in range(rng.randrange(3))]) for _ in range(rng.randrange(6))] for _ in range(12)]
    rows = rows_of(spark, entries)
    reviews = spark.createDataFrame([(f"u:u{rng.randrange(60)}", rng.choice([True, False, None]), rng.choice([True, False, None])) for _ in range(60)], "key string, seen boolean, eligible boolean")
    got, want = marked.first_marked(rows, reviews), marked.with_reviews(marked.first_occurrences(rows), reviews)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    twice = rows_of(spark, [[("1", "a", []), ("2", "a", []), ("3", "b", [])]]).withColumn("row_pos", F.lit(0))
    assert sorted(r.source_listing_id for r in marked.first_occurrences(twice).collect()) in (["1", "3"], ["2", "3"])


def test_marked_houses_read_entries_once(spark, tmp_path):
    """Counts, houses and export rows come from one written table, not from the entries again."""
    from hearthline.plans.entries import marked_houses
    from hearthline.sources.stored import read_history

    (tmp_path / "h.json").write_text('{"id":"a","ts":"2024-01-02T00:00:00Z","result":{"ranked":[{"source":"x","source_listing_id":"1","url":"https://x/1"}]}}\n')
    reviews = spark.createDataFrame([("u:https://x/1", True, None)], "key string, seen boolean, eligible boolean")
    found = marked_houses(read_history(spark, str(tmp_path)), reviews)
    assert [df.count() for df in found] == [3, 1, 1]
    assert all("json" not in df._jdf.queryExecution().executedPlan().toString() for df in found)
