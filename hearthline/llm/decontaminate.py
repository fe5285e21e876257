"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become templates in two forms. In the plain form words are lower-cased and numbers and units (after a number) are typed
placeholders; in the named form words with capitals are placeholders too. Every window of `window` words is hashed in either form
and joined with the benchmark's windows of the same form: the plain one finds an item in any case, the named one an item told with
other names, wherever in a sentence they stand. Where a matching window holds placeholders, what fills them on either side must
correspond one to one all along an alignment, so a question asked again with other numbers and names is caught, and unrelated text
of the same form isn't. A text leaks an item if `run` of the item's windows (all of a shorter item's) match on one alignment,
adjoining or not. Items of one template, which differ in their fillings alone, are one class: texts are matched with classes, and
template_classes tells a class's items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

#: Words of a window; windows on one alignment that make a leak.
WINDOW, RUN = 8, 6
#: Distinct hashes of benchmark windows that are broadcast at most (16 bytes each); a larger benchmark is joined by a shuffle.
MAX_BROADCAST = 500_000
#: Hashes of texts that are broadcast at most (8 bytes each), to look up or drop the few texts that have hits.
MAX_KEYS = 500_000
NUMBER, UNIT, NAME = "#", "%", "@"  # no letters or digits, so no words
# Units of measurement, as they stand after a number.
UNITS = (
    "km m cm mm kg g mg t l ml cl s min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years "
    "km2 m2 ha mile miles mi ft feet inch inches yard yards lb lbs oz pound pounds ounce ounces gallon gallons litre litres liter liters "
    "meter meters metre metres gram grams kilogram kilograms percent dollar dollars cent cents euro euros usd eur mph kmh watt watts volt volts degree degrees"
).split()
_REST = 1 << 30


def split_words(text: Column) -> Column:
    """Runs of letters, marks and digits; points and commas inside numbers are gone."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"[.,](?<=[0-9][.,])(?=[0-9])", "")
    return F.array_remove(F.split(joined, r"[^\p{L}\p{M}\p{N}]+"), "")


def _digit(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def kinds(low: Column) -> Column:
    """For each lower-cased word NUMBER (it starts with a digit), UNIT (a unit after a number) or null."""
    before = F.slice(F.concat(F.array(F.lit("")), low), F.lit(1), F.size(low))
    return F.zip_with(low, before, lambda w, p: F.when(_digit(w), NUMBER).when(_digit(p) & w.isin(*UNITS), UNIT))


def with_words(df: DataFrame) -> DataFrame:
    """Adds raw, low (words as they stand, and lower-cased) and kind (as kinds gives it) in place of text.

    Each step is a projection of its own: what is used twice, or within a lambda, must be a column by then.
    """
    rest = [c for c in df.columns if c != "text"]
    split = df.select(*rest, split_words(F.col("text")).alias("raw"))
    lowered = split.select("*", F.transform("raw", F.lower).alias("low"))
    return lowered.select("*", kinds(F.col("low")).alias("kind"))


def with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds windows in place of raw, low and kind: array of (n, named, hashes), the hashes of the windows of n words from each
    place on in the plain form and, null where they hold no name, in the named form. lengths: of windows, 1 to 2 WINDOW."""
    rest = [c for c in df.columns if c not in ("raw", "low", "kind")]
    plain = F.zip_with("low", "kind", lambda w, k: F.xxhash64(F.coalesce(k, w)))
    capital = F.zip_with("raw", "low", lambda r, w: r != w)
    df = df.select(*rest, plain.alias("p0"), F.zip_with(capital, "kind", lambda c, k: c & k.isNull()).alias("name"))
    name_hash = F.xxhash64(F.lit(NAME))
    df = df.select(*rest, "p0", F.zip_with("p0", "name", lambda h, c: F.when(c, name_hash).otherwise(h)).alias("n0"))
    top = max(lengths).bit_length() - 1
    for k in range(top):  # hashes of 2^k words, from two of half as many
        pair = lambda c, k=k: F.zip_with(c, F.slice(c, F.lit((1 << k) + 1), F.lit(_REST)), lambda a, b: F.xxhash64(a, b))
        df = df.select("*", pair(f"p{k}").alias(f"p{k + 1}"), pair(f"n{k}").alias(f"n{k + 1}"))
    made = []
    for n in lengths:  # two runs of 2^k words cover a window
        k = n.bit_length() - 1
        over = n - (1 << k)
        for form in "pn":
            c = f"{form}{k}"
            whole = F.zip_with(c, F.slice(c, F.lit(over + 1), F.lit(_REST)), lambda a, b: F.xxhash64(a, b)) if over else F.col(c)
            made.append(F.slice(whole, F.lit(1), F.greatest(F.lit(0), F.size("p0") - (n - 1))).alias(f"{form}_{n}"))
    df = df.select(*rest, *made)
    named = lambda n: F.zip_with(f"p_{n}", f"n_{n}", lambda a, b: F.when(a != b, b))
    rows = [F.struct(F.lit(n).alias("n"), F.lit(f).alias("named"), h.alias("hashes")) for n in lengths for f, h in ((False, F.col(f"p_{n}")), (True, named(n)))]
    return df.select(*rest, F.array(*rows).alias("windows"))


def window_rows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """n, named, at and h of every window in place of raw, low and kind.

    inline_outer, since Spark would test inline's array for emptiness in the scan, by all the expressions that make it.
    """
    rest = [c for c in df.columns if c not in ("raw", "low", "kind")]
    each = with_hashes(df, lengths).select(*rest, F.inline_outer("windows").alias("n", "named", "hashes"))
    return each.select(*rest, "n", "named", F.posexplode("hashes").alias("at", "h")).where("h is not null")


def with_classes(items: DataFrame) -> DataFrame:
    """Adds labels and class to items (of with_words). labels: null for a word that stands for itself, else its placeholder and the
    number of its filling by first occurrence. class: MD5 of the words with labels in their place, so items that differ in
    consistent fillings alone are of one class."""
    fill = F.expr("transform(raw, (w, i) -> case when kind[i] is not null then concat(kind[i], low[i]) when w <> low[i] then concat('@', low[i]) end)")
    df = items.withColumn("fill", fill).withColumn("fillings", F.expr("array_distinct(filter(fill, x -> x is not null))"))
    df = df.withColumn("labels", F.expr("transform(fill, x -> concat(substr(x, 1, 1), array_position(fillings, x)))")).drop("fill", "fillings")
    return df.withColumn("class", F.md5(F.array_join(F.expr("transform(low, (w, i) -> coalesce(labels[i], w))"), " ")))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, raw, low, kind, labels and class of every item that holds a word; equal rows once."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return with_classes(with_words(items).where("size(raw) > 0"))


def template_classes(benchmark: DataFrame) -> DataFrame:
    """class, item_id: which items are of a template's class (distinct rows; null and blank items are of none)."""
    return benchmark_items(benchmark).select("class", "item_id").distinct()


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """class, item_windows, n, named, place, h, slots (places of placeholders), labels and filled (of the slots) and bare of every
    window of items (as benchmark_items gives them); what items of a class have in common is one row.

    An item of fewer than `window` words is one window of its own length. bare: more than half of its words are placeholders.
    """
    items = items.drop("item_id").withColumn("size", F.least(F.size("raw"), F.lit(window)))
    lengths = sorted(r["size"] for r in items.select("size").distinct().collect())  # `window` numbers at most
    if not lengths:
        return items.sparkSession.createDataFrame([], "class string, item_windows int, n int, named boolean, place int, h bigint, slots array<int>, labels array<string>, filled array<string>, bare boolean")
    kept = items.select("*", F.col("raw").alias("w"), F.col("low").alias("l"), F.col("kind").alias("k"))
    rows = window_rows(kept, lengths).where("n = size").withColumnRenamed("at", "place")
    taken = F.expr("filter(sequence(0, n - 1), j -> k[place + j] is not null or (named and w[place + j] <> l[place + j]))")
    rows = rows.withColumn("slots", taken)
    filled = F.expr("transform(slots, j -> concat(coalesce(k[place + j], '@'), l[place + j]))")
    labels = F.expr("transform(slots, j -> labels[place + j])")
    bare = 2 * F.size("slots") > F.col("n")
    return rows.select("class", (F.size("w") - F.col("n") + 1).alias("item_windows"), "n", "named", "place", "h", "slots", labels.alias("labels"), filled.alias("filled"), bare.alias("bare")).distinct()


def _few(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast if its rows are `most` at most."""
    return F.broadcast(df) if df.count() <= most else df


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """text_hash (xxhash64 of the text), class, n_windows, item_windows of every text and class of items (template_classes) that it
    leaks; n_windows as on the best alignment.

    Null and blank texts and items match nothing. Items may repeat, also under one id; each is searched for, however short.
    The whole of every text is searched, once for all lengths of windows. On an alignment count the windows that stand, with their
    fillings, in some item of the class; and, if the fillings of the windows that are no mere placeholders correspond one to one to
    the class's labels, these as well. So a text that leaks an item leaks its class, and rows are as texts times classes, however
    many items a class has. (With one exception: of a text in another case than the item, windows of other items of the class may
    break the correspondence, if the text holds these items' names on the same alignment.)

    The benchmark's distinct hashes are broadcast if they are MAX_BROADCAST at most, else both sides are shuffled by hash. The
    texts themselves are never shuffled: a hit carries its place, and fillings are looked up in a second pass over the few texts
    whose hits have any. Copies of a text are one text from the hits on.
    """
    return _find(docs, staged(benchmark_items(benchmark), "benchmark-items"), window, run)


def _find(docs: DataFrame, items: DataFrame, window: int, run: int) -> DataFrame:
    bench = staged(benchmark_windows(items, window), "benchmark-windows")
    spark = docs.sparkSession
    lengths = sorted(r["n"] for r in bench.select("n").distinct().collect())
    if not lengths:
        return spark.createDataFrame([], "text_hash bigint, class string, n_windows int, item_windows int")
    own = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    wanted = _few(bench.select(F.col("h").alias("wanted")).distinct(), MAX_BROADCAST)
    rows = window_rows(with_words(own), lengths)
    hits = staged(rows.join(wanted, F.col("h") == F.col("wanted"), "left_semi").distinct(), "hits")
    shared = bench.drop("filled").distinct()
    found = hits.join(shared, ["h", "n", "named"])
    plain = found.where(F.size("slots") == 0).withColumn("found", F.array().cast("array<string>")).withColumn("same", F.lit(True))
    asked = found.where(F.size("slots") > 0)
    keys = staged(hits.select(F.col("text_hash").alias("key")).distinct(), "hit-texts")
    texts = own.join(_few(keys, MAX_KEYS), F.col("text_hash") == F.col("key"), "left_semi").dropDuplicates(["text_hash"])
    texts = staged(with_words(texts).select(F.col("text_hash").alias("key"), "low"), "hit-words")
    looked = asked.join(texts, F.col("text_hash") == F.col("key"))
    looked = looked.withColumn("found", F.expr("transform(slots, (j, i) -> concat(substr(labels[i], 1, 1), low[at + j]))")).drop("low", "key")
    told = bench.where(F.size("slots") > 0).select("class", "place", "named", "h", F.col("filled").alias("found"), F.lit(True).alias("told"))
    looked = looked.join(_few(told, MAX_BROADCAST), ["class", "place", "named", "h", "found"], "left").withColumn("same", F.col("told").isNotNull())
    every = plain.unionByName(looked.drop("told")).where("same or not bare")
    pairs = F.when(~F.col("bare"), F.zip_with("labels", "found", lambda b, d: F.struct(b.alias("b"), d.alias("d"))))
    lines = every.groupBy("text_hash", "class", "item_windows", (F.col("at") - F.col("place")).alias("line")).agg(
        F.size(F.collect_set("place")).alias("n_all"), F.size(F.collect_set(F.when(F.col("same"), F.col("place")))).alias("n_same"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    lines = lines.withColumn("bs", F.array_distinct("pairs.b")).withColumn("ds", F.array_distinct("pairs.d"))
    one_to_one = (F.size("bs") == F.size("pairs")) & (F.size("ds") == F.size("pairs"))
    lines = lines.withColumn("n_windows", F.when(one_to_one, F.col("n_all")).otherwise(F.col("n_same")))
    lines = lines.where(F.col("n_windows") >= F.least(F.col("item_windows"), F.lit(run)))
    best = lines.groupBy("text_hash", "class", "item_windows").agg(F.max("n_windows").alias("n_windows"))
    return staged(best.select("text_hash", "class", "n_windows", "item_windows"), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, class, item_id, n_items, n_windows, item_windows of every document and class of items that it leaks (one row, also of
    repeated rows; of different texts under one doc_id the most windows count). item_id is the smallest of the class, n_items how many
    ids it has; template_classes holds them all. Null doc_ids are carried, and an item_id is null if its class has none."""
    items = staged(benchmark_items(benchmark), "benchmark-items")
    found = _find(docs, items, window, run)
    ids = items.groupBy("class").agg(F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("n_items"))
    key = found.select("text_hash").distinct().withColumnRenamed("text_hash", "key")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    own = own.join(_few(key, MAX_KEYS), F.col("text_hash") == F.col("key"), "left_semi")
    best = own.join(found, "text_hash").groupBy("doc_id", "class", "item_windows").agg(F.max("n_windows").alias("n_windows"))
    return best.join(ids, "class").select("doc_id", "class", "item_id", "n_items", "n_windows", "item_windows")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """The rows of docs, all columns, whose text leaks no item (rows with a null text stay)."""
    (key,) = fresh(docs, "leak_hash")
    bad = find_leaks(docs, benchmark, window, run).select(F.col("text_hash").alias(key)).distinct()
    text = F.col("text").cast("string")
    return docs.join(_few(bad, MAX_KEYS), text.isNotNull() & (F.xxhash64(text) == F.col(key)), "left_anti")


#: The templates of both sides in DuckDB's SQL, up to the items' classes.
_CLASSES = r"""
WITH units AS (SELECT unnest(string_split('UNITS', ' ')) AS u),
texts AS (SELECT DISTINCT 'd' AS side, text FROM documents UNION ALL SELECT DISTINCT 'b', text FROM benchmark),
split AS (SELECT side, text, list_filter(string_split_regex(regexp_replace(regexp_replace(text, '([0-9])[.,]([0-9])', '\1\2', 'g'), '([0-9])[.,]([0-9])', '\1\2', 'g'), '[^\pL\pM\pN]+'), lambda x: x <> '') AS raw FROM texts WHERE text IS NOT NULL),
flat AS (SELECT side, text, len(raw) AS size, unnest(range(len(raw))) AS pos, unnest(raw) AS w FROM split),
low AS (SELECT *, lower(w) AS l, lower(w) >= '0' AND lower(w) < ':' AS digit FROM flat),
typed AS (SELECT side, text, size, pos, l, CASE WHEN digit THEN '#' WHEN lag(digit) OVER s AND l IN (SELECT u FROM units) THEN '%' END AS k, w <> l AS cap FROM low WINDOW s AS (PARTITION BY side, text ORDER BY pos)),
forms AS (SELECT side, text, size, pos, named, l, coalesce(k, CASE WHEN named AND cap THEN '@' END) AS slot FROM typed, (VALUES (false), (true)) AS f(named)),
firsts AS (SELECT text, pos, slot, min(pos) OVER (PARTITION BY text, slot || l) AS first FROM forms WHERE side = 'b' AND named AND slot IS NOT NULL),
labels AS (SELECT text, pos, slot || dense_rank() OVER (PARTITION BY text ORDER BY first) AS label FROM firsts),
classes AS (SELECT f.text, md5(string_agg(coalesce(label, f.l), ' ' ORDER BY f.pos)) AS class FROM forms f LEFT JOIN labels t ON f.text = t.text AND f.pos = t.pos WHERE f.side = 'b' AND f.named GROUP BY f.text)
""".replace("UNITS", " ".join(UNITS))
#: template_classes in SQL.
CLASS_SQL = _CLASSES + "SELECT DISTINCT class, item_id FROM benchmark JOIN classes USING (text)"
#: leaks in SQL, with the default window and run.
LEAK_SQL = (
    _CLASSES
    + r""", labelled AS (SELECT f.*, CASE WHEN slot IS NOT NULL THEN label END AS label FROM forms f LEFT JOIN labels t ON f.side = 'b' AND f.text = t.text AND f.pos = t.pos),
sizes AS (SELECT DISTINCT least(size, 8) AS n FROM flat WHERE side = 'b'),
windows AS (
  SELECT side, text, size, pos, named, n, array_agg(coalesce(slot, l)) OVER v AS words, array_agg(slot) OVER v AS slots, array_agg(label) OVER v AS labels, array_agg(coalesce(slot, '') || l) OVER v AS fills, count(*) OVER v AS got
  FROM labelled, (SELECT max(n) AS n FROM sizes) WINDOW v AS (PARTITION BY side, text, named ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
cut AS (SELECT side, text, size, pos, named, sizes.n, words[1:sizes.n] AS words, slots[1:sizes.n] AS slots, labels[1:sizes.n] AS labels, fills[1:sizes.n] AS fills FROM windows JOIN sizes ON got >= sizes.n),
kept AS (SELECT * FROM cut WHERE (NOT named OR list_contains(words, '@')) AND (side = 'd' OR n = least(size, 8))),
bench AS (SELECT DISTINCT class, size - n + 1 AS item_windows, named, n, pos, words, slots, labels, fills FROM kept JOIN classes USING (text) WHERE side = 'b'),
hits AS (
  SELECT d.text AS text, class, item_windows, b.pos AS place, d.pos - b.pos AS line, d.fills = b.fills AS same, 2 * len(list_filter(b.slots, lambda x: x IS NOT NULL)) > b.n AS bare,
    list_filter(list_zip(b.labels, d.fills), lambda x: x[1] IS NOT NULL) AS pairs
  FROM bench b JOIN kept d ON d.side = 'd' AND b.named = d.named AND b.n = d.n AND b.words = d.words),
good AS (SELECT * FROM hits WHERE same OR NOT bare),
counts AS (SELECT text, class, item_windows, line, count(DISTINCT place) AS n_all, count(DISTINCT CASE WHEN same THEN place END) AS n_same FROM good GROUP BY ALL),
slotted AS (SELECT text, class, line, unnest(pairs) AS p FROM good WHERE NOT bare),
maps AS (SELECT text, class, line, count(DISTINCT (p[1], p[2])) AS np, count(DISTINCT p[1]) AS nb, count(DISTINCT p[2]) AS nd FROM slotted GROUP BY ALL),
lines AS (SELECT c.*, CASE WHEN coalesce(np = nb AND np = nd, true) THEN n_all ELSE n_same END AS n_windows FROM counts c LEFT JOIN maps USING (text, class, line)),
leaks AS (SELECT text, class, item_windows, max(n_windows) AS n FROM lines WHERE n_windows >= least(item_windows, 6) GROUP BY ALL),
ids AS (SELECT class, min(item_id) AS item_id, count(DISTINCT item_id) AS n_items FROM benchmark JOIN classes USING (text) GROUP BY ALL)
SELECT doc_id, class, any_value(item_id) AS item_id, any_value(n_items) AS n_items, CAST(max(n) AS INT) AS n_windows, CAST(item_windows AS INT) AS item_windows FROM leaks JOIN documents d USING (text) LEFT JOIN ids USING (class) GROUP BY doc_id, class, item_windows
"""
)
