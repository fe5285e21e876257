"""Small tests of the training-data operators: brute force, the library itself, and odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hearthline.llm import ann, decontaminate, html_text, mixing, quality, secrets, simhash, substrings, tokens, url_filter
from hearthline.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows, extra=False):
    """rows: (doc_id, text). extra: columns whose names operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows], DOCS)
    clash = ("fp", "root", "key", "_id", "_hash", "_row", "doc", "sub", "node", "score", "_score", "h", "starts", "nodes", "text_hash", "n", "count", "draw", "part", "_clean", "kept_id", "leak_id", "quality_score", "redacted_text")
    return df.withColumns({c: F.lit("x") for c in clash}) if extra else df


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


WORDS = "the of and to in red blue stone river house tree walks under over quickly Paris Anna seven".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# 1 ---------------------------------------------------------------------------------------------------------------------

ARTICLE = "It is the story of a river that runs to the sea and of the people who live on it, told for those who were not there."


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>", ""), ("<nav>a</nav><ul><li><a href=x>b</a></ul>", ""),
    (f"<body><nav><a href=x>The</a> menu</nav><article><h1>A &amp; B</h1><p>{ARTICLE}<br>x&nbsp;y</p><p>Short.</p></article><footer>&copy; the site</footer>", f"A & B\n{ARTICLE} x y\nShort."),
    (f"<div class='sidebar'>{ARTICLE}</div><div id=content><p>{ARTICLE}</p><form>{ARTICLE}</form><script>var x='<p>';</script></div><div class='comments'><p>{ARTICLE}</p></div>", ARTICLE),
    (f"<html><body><h2>Head of it</h2><p>{ARTICLE} {ARTICLE}</p><p>Yes.</p><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul></body>", f"Head of it\n{ARTICLE} {ARTICLE}\nYes."),
    (f"<article><p>{ARTICLE}</p><aside>{ARTICLE}</aside><div class='cookie-notice'>{ARTICLE}</div><style>p{{}}</style><!-- <p>no</p> --><p>End &#x41;", f"{ARTICLE}\nEnd A"),
    ("<article><p>Thing.</p></article><footer>of the</footer>", "Thing."),
    (f"<main data-hidden=1><p class='overflow-hidden'>{ARTICLE}</p><p style='display: none'>{ARTICLE}</p><div class=commentlist>{ARTICLE}</div><section role=complementary>{ARTICLE}</section><div class=address>{ARTICLE}</div></main>", f"{ARTICLE}\n{ARTICLE}"),
])
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{ARTICLE}</p></article>"), (1, "u", f"<article><p>{ARTICLE}</p></article>"), (None, None, None), (2, "u", "<article>" + f"<p>{ARTICLE}</p>" * 3000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract_main_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert [r[0] for r in got(out, "n_chars")] == sorted([0, len(ARTICLE), len(ARTICLE), 3000 * len(ARTICLE) + 2999], key=str)
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------------


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (r.host.count("."), len(r.path), r.action == "block"), default=None)
    return host, path, best


def test_urls(spark):
    rng = random.Random(1)
    hosts = ["example.com", "WWW.Example.com", "m.www.example.com", "net", "a.net", "com", "notexample.com", "x.org", "", "exampleÉ.com", "example.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/es/", "/fr/x?y", "/english/", "?q=/en/", "#/en/"]
    urls = [f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', ':'])}{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "://", "a://b://c/en/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit(1))
    want = sorted(((k, h, p, b and b.host + b.path, b.action if b else "allow") for k, (h, p, b) in enumerate(map(plain_rule, urls))), key=str)
    assert got(url_filter.filter_urls(pages, URL_RULES), "page_id", "host", "path", "rule", "verdict") == want


def test_trie_prefers_longest_and_block():
    R = url_filter.Rule
    trie = url_filter.RuleTrie([R("allow", "a.b", "/fo"), R("block", "a.b", "/fo"), R("allow", "a.b", "/foo/x"), R("block", "b", "/foo/xyz")])
    assert trie.decide("a.b", "/foo")[0] == "block"
    assert trie.decide("z.a.b", "/foo/xyz") == ("allow", "a.b/foo/x")
    assert trie.decide("c.b", "/foo/xyz1") == ("block", "b/foo/xyz")
    assert trie.decide("", "") is None
    with pytest.raises(ValueError):
        url_filter.RuleTrie([R("maybe", "a", "/")])


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ["", " ", "\n\n  x", "it's I'LL we've", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "naïve café — 1234", "日本語 テスト\u3000x", "a\x1cb\x85c\xa0d", "😀👍🏽", "\t\tx  \r\n", "ﬁ Ⅳ ½ x²", "x" * 5000, prose(rng, 3000)]
    texts += ["".join(rng.choice("ab '\n\t1é.—日\x0b\xa0<|") for _ in range(rng.randrange(60))) for _ in range(300)]
    want = sorted(((i, len(t.encode()), n, n > 512) for i, (t, n) in enumerate((t, len(library.encode(t, add_special_tokens=False).ids)) for t in texts)), key=str)
    rows = list(enumerate(texts))
    assert got(tokens.count_tokens(docs(spark, *rows, extra=True), path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert got(tokens.count_tokens(docs(spark, (None, None), (1, "a"), (1, "a")), path, frequent=10), "doc_id", "n_tokens") == sorted([(None, 0), (1, 1), (1, 1)], key=str)


# 4 ---------------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("index", [ann.Index(), ann.Index(file=300)])
def test_ann_recall(spark, index):
    """Many files under the default settings, and files cut into pieces."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x[100:1400] = x[100]  # a common vector
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS).withColumn("n", F.lit(1))
    found = {}
    for r in ann.search(df, k=10, every=100, index=index).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    d64, hit = x.astype(np.float64), 0
    assert sorted(found) == list(range(0, 6000, 100))
    for q, ranks in found.items():
        dist = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        dist[q] = np.inf
        best = np.argsort(dist, kind="stable")[:10]
        assert sorted(ranks) == list(range(1, 11))
        assert all(abs(dist[v] - s) < 1e-12 for v, s in ranks.values())
        assert [(s, v) for v, s in (ranks[k] for k in range(1, 11))] == sorted((s, v) for v, s in ranks.values())
        hit += len({v for v, _ in ranks.values()} & set(best.tolist()))
    assert hit >= 0.9 * 600
    assert [found[100][k][0] for k in range(1, 11)] == list(range(101, 111))  # ties to the smaller id
    assert [found[200][k][0] for k in range(1, 11)] == list(range(100, 110))


def test_ann_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [1.0, 0.5]), (1, [0.0, 1.0]), (200, [1.0, 2.0, 4.0]), (100, [0.0, 9.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    want = [(0, 1, 100), (0, 2, 1), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 100), (100, 1, 1), (100, 2, 100), (100, 3, 0), (200, 1, 8)]
    assert got(ann.search(df), "query_id", "rank", "vec_id") == sorted(want, key=str)
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 0")).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: prose(rng, rng.randrange(20, 200)).capitalize() + "."
    bad = lambda: " ".join(f"{rng.choice(WORDS)}***" for _ in range(rng.randrange(20, 200)))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(1, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs(spark, *rows, (1000, ""), (None, None), (1001, "short"), (1002, "x " * 100_000), extra=True), labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    by = {r.doc_id: r for r in out.collect()}
    test = [i for i in range(400) if by[i].held_out]
    assert 60 < len(test) < 140
    assert sum(by[i].predicted == int(i % 4 != 0) for i in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in by.values())
    assert by[1000].score == by[None].score and not by[None].held_out
    none = quality.score_quality(docs(spark, (1, "a")), labels.limit(0)).first()
    assert none.score == 0.5
    one = quality.score_quality(docs(spark, (1, "a")), labels.where("quality = 1")).first()
    assert one.predicted == 1
    assert quality.score_quality(docs(spark, (1, "a")).limit(0), labels.limit(0)).count() == 0


def test_scores_are_calibrated_size_differences(spark):
    """Every score against sizes compressed anew with the model's dictionaries; repeated ids teach once."""
    import zstandard

    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randrange(1, 1500)) if i % 2 else " ".join(rng.choice("###$%") + rng.choice(WORDS) for _ in range(300))) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    frame = docs(spark, *rows)
    model = quality.fit(frame, labels)
    assert quality.fit(docs(spark, *rows, *[rows[1]] * 50), labels) == model
    for r in quality.score_quality(frame, labels).collect():
        text, sizes = dict(rows)[r.doc_id].encode(), []
        for d in (model.bad, model.good):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(text[at : at + 2048])) for at in range(0, len(text), 2048)))
        z = model.intercept + model.slope * (sizes[0] - sizes[1]) / len(text)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
    assert model.slope > 0


# 6 ---------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered) if x]
    if not w:
        return 0
    shingles = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, fps, radius):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(fps)):
        for b in range(a + 1, len(fps)):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                label[find(b)] = find(a)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


@pytest.mark.parametrize("piece", [1024, 4])
def test_simhash(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = random.Random(6)
    base = [prose(rng, 300) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "One", "one two", "é É", prose(rng, 20_000)] + base
    for t in base * 4:
        w = t.split()
        w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w) if rng.random() < 0.8 else t)
    rows = list(enumerate(texts)) + [(None, base[0]), (3, "one")]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(((i, format(f, "016x"), c) for (i, _), f, c in zip(rows, fps, components([i for i, _ in rows], fps, 2), strict=True)), key=str)
    frame = docs(spark, *rows, extra=True)
    assert got(simhash.label_near_duplicates(frame), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want if c is not None})
    assert simhash.label_near_duplicates(frame.limit(0)).count() == simhash.keep_one_of_each(frame.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    for _ in range(10):
        base = rng.integers(0, 2**63, 4).astype(np.uint64)
        fps = base[rng.integers(0, 4, 150)]
        for _ in range(4):
            fps ^= np.where(rng.random(150) < 0.6, np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64), np.uint64(0))
        run = np.repeat(np.arange(4), [90, 40, 19, 1])
        rows = simhash.planes(fps)
        for shift in (1, 2, 63, 64, 65, 100):
            close = np.bitwise_count(fps[:-shift] ^ fps[shift:]) <= radius
            assert set(simhash.shifted_pairs(rows, run, shift, radius).tolist()) == set(np.flatnonzero(close & (run[:-shift] == run[shift:])).tolist())


# 7 ---------------------------------------------------------------------------------------------------------------------


def fill(budget, nodes):
    """Water-filling by brute force: nodes are (weight, can); what each gets, before rounding down."""
    given, live = [0.0] * len(nodes), set(range(len(nodes)))
    left = float(budget)
    while live and left > 1e-9:
        total = sum(nodes[k][0] for k in live)
        full = [k for k in live if given[k] + left * nodes[k][0] / total >= nodes[k][1]]
        if not full:
            for k in live:
                given[k] += left * nodes[k][0] / total
            return given
        rest = left
        for k in full:
            rest -= nodes[k][1] - given[k]
            given[k] = nodes[k][1]
        live -= set(full)
        # those that are not full keep their share of what was given so far: start again with the rest among them
        left = rest
    return given


def test_shares(spark):
    rng = random.Random(7)
    for _ in range(4):
        nodes = [(rng.randrange(1, 50), rng.randrange(0, 1000)) for _ in range(9)]
        budget = rng.randrange(0, 6000)
        df = spark.createDataFrame([(str(k), w, c) for k, (w, c) in enumerate(nodes)], "name string, weight long, can long").withColumn("all", F.lit(budget).cast("bigint"))
        out = {int(r["name"]): r["given"] for r in mixing.share(df, [], F.col("all")).collect()}
        want = fill(budget, nodes)
        assert all(abs(out[k] - want[k]) <= 1 for k in out), (nodes, budget, out, want)
        assert sum(out.values()) <= budget


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(300)]
    df = docs(spark, *rows, extra=True).withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "de").when(F.col("doc_id") % 10 == 1, F.lit(None)).otherwise("en"))
    mix = mixing.Mix(budget=3000, epochs=3)
    out = mixing.mix_sources(df, mix).collect()
    assert sum(r.n_tokens * r.copies for r in out) <= 3000
    assert len({r.doc_id for r in out}) == len(out) and max(r.copies for r in out) <= 3
    assert got(mixing.mix_sources(df, mix), "doc_id", "copies") == sorted(((r.doc_id, r.copies) for r in out), key=str)
    everything = mixing.mix_sources(df, mixing.Mix(budget=10**9, epochs=2)).collect()
    assert len(everything) == 300 and {r.copies for r in everything} == {2}
    small = mixing.mix_sources(docs(spark, (None, None), (1, ""), (1, ""), (2, "a b")))
    assert got(small, "doc_id", "n_tokens") == sorted([(None, 0), (1, 0), (1, 0), (2, 2)], key=str)
    carried = mixing.mix_sources(df, mix, keep=("score", "key")).collect()
    assert {(r.score, r.key) for r in carried} == {("x", "x")}
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mix_zero_weights_and_counts(spark):
    """A weight of 0 leaves a language or a source out, its siblings take its part, and a column of counts is the measure."""
    rng = random.Random(18)
    df = docs(spark, *[(i, prose(rng, rng.randrange(1, 40))) for i in range(200)]).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, "de").otherwise("en")).withColumn("tokens", F.lit(7))
    out = mixing.mix_sources(df, mixing.Mix(budget=400, languages=(("de", 0),), sources=(("src1", 0),)), tokens="tokens").collect()
    assert {(r.lang, r.source) for r in out} == {("en", "src0"), ("en", "src2")} and 380 <= sum(7 * r.copies for r in out) <= 400
    assert {r.domain for r in out} == {"src"} and {r.n_tokens for r in out} == {7}
    assert mixing.mix_sources(df, mixing.Mix(other=0, languages=(("de", 0),))).count() == 0


def test_mix_repeated_rows(spark):
    """Null and repeated ids with different texts are drawn one by one; equal rows together."""
    rng = random.Random(19)
    rows = [(None, prose(rng, 10)) for _ in range(100)] + [(5, "a b c")] * 30
    out = mixing.mix_sources(docs(spark, *rows).withColumn("source", F.lit("s")), mixing.Mix(budget=500)).collect()
    assert 450 <= sum(r.n_tokens * r.copies for r in out) <= 500
    assert 20 < sum(r.doc_id is None for r in out) < 80 and sum(r.doc_id == 5 for r in out) in (0, 30)


def test_mix_runs_agree(spark, monkeypatch):
    rng = random.Random(9)
    df = docs(spark, *[(i, prose(rng, rng.randrange(1, 40))) for i in range(200)])
    mix = mixing.Mix(budget=1500)
    whole = got(mixing.mix_sources(df, mix), "doc_id", "copies")
    monkeypatch.setattr(mixing, "RUN", 7)
    assert got(mixing.mix_sources(df, mix), "doc_id", "copies") == whole


# 8 ---------------------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(10)
    q = "A train leaves at 60 km per hour and meets Anna after 3.5 hours near the old bridge with 60 bags"
    short = "why do seven stones sink"
    items = spark.createDataFrame([(1, q), (2, short), (3, None), (4, ""), (5, "hm"), (1, q)], "item_id long, text string")
    other = q.replace("60", "75").replace("3.5", "4").replace("Anna", "Bob")
    rows = [
        (1, f"intro {q} outro"), (2, f"Then {other}."), (3, other.replace("75 bags", "99 sacks of 8 h then 7")), (4, prose(rng, 400)), (5, None), (6, ""), (7, q.upper()), (8, f"so {short} now"), (9, " ".join(q.split()[:9])),
        (10, "*** ".join(q.split())), (None, q), (1, f"intro {q} outro"),
    ]
    frame = docs(spark, *rows, extra=True)
    found = got(decontaminate.leaks(frame, items), "doc_id", "item_id")
    assert found == sorted([(1, 1), (2, 1), (7, 1), (8, 2), (10, 1), (None, 1)] + [x for x in found if x == (3, 1)], key=str)
    kept = decontaminate.without_leaks(frame, items)
    rows = kept.collect()
    assert kept.columns == frame.columns and sorted(r.doc_id for r in rows if r.doc_id != 3) == [4, 5, 6, 9]
    assert {r["leak_id"] for r in rows} == {r["_id"] for r in rows} == {"x"}
    assert decontaminate.leaks(frame.limit(0), items).count() == decontaminate.leaks(frame, items.limit(0)).count() == 0


def test_slots_must_agree(spark):
    q = "box 1 holds red 2 then blue 1 and green 2 or white 1 with black 2 at last"
    same, crossed = q.replace("1", "7").replace("2", "8"), "box 7 holds red 8 then blue 9 and green 8 or white 7 with black 6 at last"
    items = spark.createDataFrame([(1, q)], "item_id long, text string")
    assert got(decontaminate.leaks(docs(spark, (1, same), (2, crossed)), items), "doc_id") == [(1,)]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rng = random.Random(11)
    texts = [prose(rng, 60) for _ in range(5)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    frame = docs(spark, *[(i, prose(rng, 20) + " " + rng.choice(texts)) for i in range(20)])
    want = got(decontaminate.leaks(frame, items), "doc_id", "item_id", "n_windows")
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    monkeypatch.setattr(decontaminate, "MAX_KEYS", 0)
    assert got(decontaminate.leaks(frame, items), "doc_id", "item_id", "n_windows") == want and len(want) == 20


# 9 ---------------------------------------------------------------------------------------------------------------------


def plain_base(text):
    out = []
    for kind, pattern, least, group in (("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out)), [sum(k == x for _, _, x, _ in out) for k in ("assign", "access", "hex")]


def test_secrets(spark):
    rng = random.Random(12)
    pieces = ["token", "TOKEN", "api_key", "apikey", "ſecret", " = ", ": ", '"', "'", "abcdef", "0123456789abcdef01234567", "AKIA", "ABCDEFGHIJKLMNOP", "é", "\n", "=", "x", "/+_.-", "toKen", "passwd", "Password"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(400)] + ["", "token=token :abcdefg", "é token = secret: abcdefgh", "x " * 100_000 + "password=hunter22"]
    rows = list(enumerate(texts))
    want = sorted(((i, *plain_base(t)[1], hashlib.sha256(plain_base(t)[0].encode()).hexdigest()) for i, t in rows), key=str)
    out = secrets.scan_secrets(docs(spark, *rows, extra=True))
    assert got(out, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    for r in out.collect():
        assert set(filter(None, plain_base(texts[r.doc_id])[0].split(","))) <= set(r.spans.split(","))
    none = secrets.scan_secrets(docs(spark, (None, None))).first()
    assert (none.spans, none.base_sha256) == ("", hashlib.sha256(b"").hexdigest())


def test_novelty_rates():
    """Of random keys and ordinary compounds near a sensitive word: misses and false alarms, and novel spans against a plain loop."""
    rng = random.Random(5)
    scanner = secrets.Scanner(secrets.Novelty(), secrets.identifier_dictionary())
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    names = "river house window booking customer annual report summary getting started reference conference results final north bridge".split()
    keys = ["".join(rng.choice(letters) for _ in range(rng.choice((24, 32, 48)))) for _ in range(200)]
    plain = ["-".join(rng.choice([*names, "2023", "v2"]) for _ in range(rng.randrange(1, 8))) for _ in range(200)]
    found = lambda x: bool(scanner.scan(f"so the private key of it is {x} for now")[1])
    assert sum(map(found, keys)) >= 190 and sum(map(found, plain)) <= 4
    for _ in range(40):
        text = " ".join(rng.choice([*names, *keys[:20], "token = abcdef0123", "0123456789abcdef0123456789", "api key", "secret:"]) for _ in range(60))
        base, every = scanner.scan(text)
        want = []
        for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
            near = any(0 <= m.start() - w.end() <= 96 for w in secrets.SENSITIVE.finditer(text))
            if near and not any(s < m.end() and m.start() < e for s, _, e in base) and scanner.added(text, *m.span()) > scanner.novelty.line(len(m[0])):
                want.append((m.start(), 3, m.end()))
        assert [x for x in every if x[1] == 3] == want


def test_novel_secrets(spark):
    key = "Zk8QwP3vLx9RtY2mNc7B"
    texts = [f"private key is {key}", f"the river {key} runs", f"private key: {'abcz1' * 8}", "auth header: Bearer get_attribute_error_1"]
    spans = [r.spans for r in secrets.scan_secrets(docs(spark, *enumerate(texts)).coalesce(1)).orderBy("doc_id").collect()]
    assert spans == [f"novel:15:{15 + len(key)}", "", "", ""]
    scan = secrets.Scanner(secrets.Novelty(), secrets.identifier_dictionary()).scan
    context = "the monkeys in the capital hold a private key: {} and so on for the team"
    for found in ("Zk9xQ2mP7vRt", "kJhTqWmNbVcXzLpRfDgYsA", "aGVsbG8gd29ybGQgdGhpcw=="):
        assert scan(context.format(found))[1] == [(47, 3, 47 + len(found))]
    for ordinary in ("quarterly_results_2023_final", "com/blog/2024/05/annual-report-summary", "/docs/reference/v2/getting-started", "conference-room-12-booking", "internationalisation"):
        assert scan(context.format(ordinary))[1] == []
    assert scan("the author of the capital, rapid monkeys: Zk9xQ2mP7vRtAA")[1] == []
    cleaned = secrets.redact_secrets(docs(spark, (1, texts[0]), (2, "token = abcdef0123456789abcdef01 x"), (3, None), (4, "plain"), extra=True))
    assert {r.doc_id: (r.text, r.n_chars) for r in cleaned.collect()} == {1: ("private key is [novel]", 22), 2: ("[assign] x", 10), 3: (None, None), 4: ("plain", 5)}


# 10 --------------------------------------------------------------------------------------------------------------------


def plain_removal(rows, window):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        i, t = rows[k]
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in first:
                gone[p : p + window] = [True] * window
            else:
                first[key] = (i, p)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [6, 20])
def test_substrings(spark, window):
    rng = random.Random(window)
    passages = [prose(rng, rng.randrange(window - 2, 70)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(f"{rng.choice(WORDS)}{rng.randrange(99)}" for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))]
        rows.append((i, rng.choice([" ", "  \n"]).join(parts)))
    rows += [(60, "same " * 90), (61, "same " * 40), (62, rows[5][1]), (63, rows[5][1]), (64, None), (65, ""), (None, passages[0] + " tail of it"), (67, " ".join(f"w{k}" for k in range(40_000)))]
    assert got(substrings.remove_repeated_spans(docs(spark, *rows, extra=True), window), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_removal(rows, window)


def test_structured_words_are_told_apart(spark):
    """Words whose letters cancel in polynomial hashes; only equal windows may go."""
    rows = []
    for k, size in enumerate((1024, 2048)):
        bits = [bin(j).count("1") % 2 for j in range(size)]
        one, other = ("".join("ab"[b ^ f] for b in bits) for f in (0, 1))
        for f, middle in enumerate((one, other)):
            rows.append((2 * k + f, " ".join([*(f"l{k}_{j}" for j in range(15)), middle, *(f"r{k}_{j}" for j in range(15))])))
    assert got(substrings.remove_repeated_spans(docs(spark, *rows)), "doc_id", "n_removed") == [(k, 0) for k in range(4)]
    words = ["ab"[bin(j).count("1") % 2] for j in range(2048)]
    rows = [(1, " ".join(words)), (2, " ".join("ba"["ab".index(w)] for w in words)), (3, "x " * 9 + " ".join(words[100:900]))]
    assert got(substrings.remove_repeated_spans(docs(spark, *rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_removal(rows, 20)


def test_substrings_repeated_ids(spark):
    """Rows of one id or of none are documents in the order of their texts' hashes: of one passage one stays whole."""
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(None, f"a{k} {passage} z{k}") for k in range(5)] + [(7, f"b {passage}"), (7, f"c {passage} d"), (9, passage)]
    out = got(substrings.remove_repeated_spans(docs(spark, *rows)), "doc_id", "n_removed")
    assert sorted(n for i, n in out if i == 7) == [0, 40]
    assert [n for i, n in out if i != 7] == [40] * 6


def test_words_are_compared_at_their_source(spark):
    rows = docs(spark, (1, "a b c d"), (2, "x a b c")).selectExpr("doc_id as doc", "text", "doc_id as tid", "1L as check")
    texts = substrings.Texts(rows)
    (first,) = (r["rank"] << substrings.PLACE for r in texts.ranked.where("tid = 1").collect())
    claims = lambda *words: spark.createDataFrame([(2, 2, 4, 3, "", [{"n": 3, "source": first + k, "digest": substrings._digest(w.encode().split())} for k, w in words])], substrings.RESULT)
    assert substrings._all_verified(texts, claims((0, "a b c"), (1, "b c d")))
    assert not substrings._all_verified(texts, claims((0, "a b c"), (1, "b c x")))
    texts.drop()


def test_substrings_odd(spark):
    text = " ".join(f"w{k}" for k in range(30))
    out = substrings.remove_repeated_spans(docs(spark, (1, text), (1, text), (2, text)))
    assert got(out, "doc_id", "n_removed") == [(1, 0), (1, 0), (2, 30)]
    assert substrings.remove_repeated_spans(docs(spark, (1, text)).limit(0)).count() == 0
