"""Records of quoted text against a plain reader, with splits of a few bytes."""

import random

import pytest

from hearthline.sources import records, userlist


def plain_records(text, sep):
    """Records, by one state machine over the characters: a quote opens a field only at its beginning."""
    out, record, state = [], "", "begin"
    for c in text:
        if c == "\n" and state != "open":
            out.append(record)
            record, state = "", "begin"
            continue
        record += c
        if state == "open":
            state = "closing" if c == '"' else "open"
        elif state == "closing" and c == '"':
            state = "open"
        elif c == sep:
            state = "begin"
        else:
            state = "open" if state == "begin" and c == '"' else "plain"
    out.append(record)
    return [r for r in out if r.strip(" \t\r") != ""]


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_random_texts(spark, tmp_path, tiny_splits, sep):
    rng = random.Random(ord(sep))
    for k in range(4):
        text = "h" + "".join(rng.choice(['"', '"', sep, sep, "\n", "a", "b ", '""', f'{sep}"', f'"{sep}', "\n\n"]) for _ in range(400)).rstrip("\n")
        path = tmp_path / f"{k}.txt"
        path.write_text(text)
        found = records.records(records.read_lines(spark, str(path)), sep).orderBy("n").collect()
        assert [r.record for r in found] == plain_records(text, sep) and [r.n for r in found] == list(range(len(found)))


def test_a_quote_that_stays_open(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_LINES", 5)
    path = tmp_path / "l.csv"
    path.write_text("Barrio,m2\nA,1\n\"B,2\n" + "x,3\n" * 20)
    rows = userlist.read_list(spark, str(path)).orderBy("n").collect()
    assert [r["_corrupt"] is not None for r in rows] == [False] + [True] * (len(rows) - 1) and len(rows) == 2 + 16
    assert rows[0].Barrio == "A" and sum(x.count("\n") + 1 for x in (r["_corrupt"] for r in rows[1:])) == 21


def test_cells(spark, tmp_path, tiny_splits):
    path = tmp_path / "l.csv"
    path.write_text('﻿"Barrio\nsector",m2, precio ,link,url,x,x\n"a ""b"", c\n\nd",90,"1.000,5",,https://a.co/1,1,2\n\n  \nplain "q" cell,80,,,,,\nfew,1\n', newline="")
    rows = userlist.read_list(spark, str(path))
    assert rows.columns == ["n", "_corrupt", "Barrio\nsector", "m2", "precio", "link", "url", "x", "x#1"]
    got = [tuple(r) for r in rows.orderBy("n").collect()]
    assert got[0] == (1, None, 'a "b", c\n\nd', "90", "1.000,5", None, "https://a.co/1", "1", "2")
    assert got[1][:4] == (2, None, 'plain "q" cell', "80") and got[2][:2] == (3, "few,1")
    for text in ("", "\n \n"):
        path.write_text(text)
        assert userlist.read_list(spark, str(path)).count() == 0


def test_parts_of_a_folder(spark, tmp_path):
    for k, text in enumerate(('m2\tBarrio\n1\t"a\nb"\n2\tc', '3\t"d"\n4\te\n')):
        (tmp_path / f"part-{k}.txt").write_text(text)
    assert [tuple(r) for r in userlist.read_list(spark, str(tmp_path)).orderBy("n").collect()] == [(1, None, "1", "a\nb"), (2, None, "2", "c"), (3, None, "3", "d"), (4, None, "4", "e")]
