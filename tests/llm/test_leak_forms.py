"""Benchmark items in another case, retold with other names, of all lengths; and windows and slots against SQL."""

import random

import duckdb
import pyarrow as pa

from hearthline.llm import decontaminate
from tests.llm.test_operators import docs


def found(frame, items):
    return sorted(map(tuple, decontaminate.leaks(frame, items).collect()), key=str)


def test_case_and_names_at_sentence_starts(spark):
    plain = "What did Marie Curie and Pierre Curie discover in Paris in the year 1898 together"
    german = "Welche Stadt liegt an der Mündung der Elbe und hat den schönsten Hafen von ganz Deutschland heute"
    tom = "Tom buys 3 boxes of 12 pencils. Tom gives 5 pencils to Ann. How many pencils does Tom have left?"
    items = spark.createDataFrame([(1, plain), (2, german), (3, tom)], "item_id long, text string")
    retold = tom.replace("Tom", "Ben").replace("Ann", "Eve").replace("12", "15").replace("3", "4")
    mixed = "Ben buys 4 boxes of 15 pencils. Kim gives 6 pencils to Eve. How many pencils does Joe have left?"
    frame = docs(spark, (1, plain.lower()), (2, plain.upper()), (3, german.lower()), (4, "So it goes. " + retold), (5, mixed), (6, german.upper()))
    assert [(x[0], x[2]) for x in found(frame, items)] == [(1, 1), (2, 1), (3, 2), (4, 3), (6, 2)]


def test_windows_and_slots_against_sql(spark):
    rng = random.Random(3)
    vocabulary = "the of a river stone Anna Ben Ulm seven 7 12 3.5 1,000 km min runs over and then why".split()
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(n, " ".join(some(n))) for n in [*range(1, 13), *range(15, 41, 5)] for _ in range(2)]
    items += [(90, None), (91, ""), (92, "?!"), (1, items[0][1])]
    swap = {"Anna": "Eve", "Ben": "Kim", "7": "8", "12": "99", "3.5": "4", "the": "The"}
    texts = []
    for _ in range(250):
        _, item = rng.choice(items)
        words = (item or "").split()
        kind = rng.randrange(5)
        if kind == 1:
            words = [swap.get(w, w) for w in words]
        elif kind == 2:
            words = [swap.get(w, w) if rng.random() < 0.5 else w for w in words]
        elif kind == 3:
            words = [w.upper() for w in words]
        elif kind == 4 and words:
            words[rng.randrange(len(words))] = "else"
        texts.append(" ".join([*some(rng.randrange(6)), *words, *some(rng.randrange(6))]) + rng.choice(["", ".", " !"]))
    texts += [None, "", texts[0]]
    rows = list(enumerate(texts))
    got = found(docs(spark, *rows, extra=True), spark.createDataFrame(items, "item_id long, text string"))
    c = duckdb.connect()
    for name, key, data in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        c.register(name, pa.table({key: [x[0] for x in data], "text": [x[1] for x in data]}))
    assert got == sorted(c.execute(decontaminate.LEAK_SQL).fetchall(), key=str)
    assert {x[2] for x in got} >= set(range(1, 13))


def test_items_of_one_template_are_one_class(spark):
    """200 texts times 200 items of one template: a row a text, and the membership table names every item."""
    names = [f"{a}{b}" for a in ("An", "Be", "Ka", "Lu", "Mo", "Ni", "Ol", "Pe", "Ru", "To") for b in ("na", "ra", "sha", "tte", "vin", "xa", "zel", "bo", "cia", "du")]
    question = "{0} buys {2} boxes of {3} pencils and {0} gives {4} pencils to {1} before lunch. How many pencils does {0} have left?"
    rng = random.Random(5)
    ask = lambda: question.format(*rng.sample(names, 2), *rng.sample(range(10, 1000), 3))
    other = "Why do the tides of the northern sea rise higher in spring than in the late autumn months"
    items = [*((i, ask()) for i in range(200)), (500, other), (501, None), (502, " ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    crossed = "Anna buys 12 boxes of 15 pencils and Kara gives 9 pencils to Lura before lunch. How many pencils does Mora have left?"
    rows = [*((i, ask()) for i in range(200)), (300, items[7][1]), (301, items[7][1].upper()), (302, other), (303, crossed), (304, "no leak at all")]
    got = found(docs(spark, *rows), bench)
    assert [x[0] for x in got] == [*sorted([*range(200), 300, 301, 302], key=lambda i: str((i,)))]
    classes = {x[0]: x[1] for x in got}
    members = {}
    for r in decontaminate.template_classes(bench).collect():
        members.setdefault(r["class"], set()).add(r.item_id)
    assert members[classes[0]] == set(range(200)) and members[classes[302]] == {500} and len(members) == 2
    assert {x[2:4] for x in got} == {(0, 200), (500, 1)}


def test_items_of_classes_against_each_alone(spark):
    """A text leaks a class if it leaks an item of it, searched for alone."""
    rng = random.Random(8)
    form = "{0} walks {1} km along the river with {2} and sees {3} stones near the bridge where {0} met {4} once"
    fill = lambda: form.format(rng.choice(["Ann", "Bob", "Eve"]), rng.randrange(3), rng.choice(["Kim", "Ann"]), rng.randrange(3), rng.choice(["Joe", "Kim"]))
    items = [(i, fill()) for i in range(6)]
    frame = docs(spark, *[(i, fill()) for i in range(40)], *[(100 + i, fill().lower()) for i in range(20)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    of = {r.item_id: r["class"] for r in decontaminate.template_classes(bench).collect()}
    alone = {(x[0], of[i]) for i, text in items for x in found(frame, spark.createDataFrame([(i, text)], bench.schema))}
    assert alone <= {x[:2] for x in found(frame, bench)} and len(alone) > 20
