"""Pages whose article is known: odd markup, names that only look like boilerplate, other languages, and random pages."""

import html
import random
import time

import pytest

from hearthline.llm.html_text import main_text

A = "It is the story of a river that runs to the sea and of the people who live on it, told for those who were not there."
RUSSIAN = "Река течёт к морю, и люди живут на её берегах с давних времён, помня каждую весну и каждый паводок."


@pytest.mark.parametrize("raw", ["<script/>", "<title/>", "<iframe src=x/>", "<style />", "<textarea/>", "<noscript/>"])
@pytest.mark.parametrize("around", ["{}{}", "<div>{}</div>{}", "<article>{}{}</article>", "<div>{}{}</div>"])
def test_self_closed_raw_tags(raw, around):
    assert main_text(around.format(raw, f"<p>{A}</p>")) == A


@pytest.mark.parametrize(("page", "want"), [
    (f"<div class='layout with-sidebar'><p>{A}</p></div>", A),
    (f"<div class='page no-sidebar'><article><p>{A}</p></article></div>", A),
    (f"<div class='page social-history'><p>{A}</p></div>", A),
    (f"<header class='main-header'><p>{A} site</p></header><div><p>{A}</p></div>", A),
    (f"<div class='main-header'><p>{A} site</p></div><div><p>{A}</p></div>", A),
    (f"<p>{A}</p>", A),
    (f"<p>{RUSSIAN}</p><p>{RUSSIAN} {RUSSIAN}</p><ul><li><a href=/>{RUSSIAN}</a></ul>", f"{RUSSIAN}\n{RUSSIAN} {RUSSIAN}"),
    ("<pre>" + "def f(x):\n    return x\n" * 9 + "</pre>", " ".join(["def f(x): return x"] * 9)),
    (f"<div><p>{A} {A}</p><p>{A} {A}</p></div><article><h3>Other</h3><p>{A}</p></article>", f"{A} {A}\n{A} {A}"),
    (f"<div class='site-footer'>{A}</div><div class=comments-area>{A}</div><div id=post-12><p>{A}</p></div><section class=related-posts>{A}</section>", A),
    (f"<article><p>a &lt; b 1 < 2 {A}</p></article>", f"a < b 1 < 2 {A}"),
    (f"<article data-x='a>b' title=it's><p>{A}</p></article>", A),
])
def test_articles_are_kept(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("piece", ["<a ", "<", "<script/>", '<a href="', "</a ", "<title>", "<!--", "<p class='x ", "<div>", "&"])
def test_linear_time(piece):
    def seconds(size):
        began = time.process_time()
        main_text(f"<p>{A}</p>" + piece * (size // len(piece)))
        return time.process_time() - began

    assert seconds(1_000_000) < max(2.0, 12 * seconds(250_000))


B = A.replace("river", "mountain")


@pytest.mark.parametrize(("page", "want"), [
    (f"<article><h1>Title here</h1><a name='top'><p>{A}</p><p>{B}</p></article>", f"Title here\n{A}\n{B}"),
    (f"<article><h1>Title here</h1><a id='x'/><p>{A}</p><p>{B}</p></article>", f"Title here\n{A}\n{B}"),
    (f"<article><p>It <a name=here>begins. {A}</p><p>{B}</p></article>", f"It begins. {A}\n{B}"),
    (f"<article><p><a href=''>{A}</a></p><p>{B}</p></article>", f"{A}\n{B}"),
    (f"<article><div><a href='/all'>all of them</div><p>{A}</p><p>{B}</p></article>", f"{A}\n{B}"),
    (f"<article><p>{A} <a href=/x>more<p>{B}</p></article>", f"{A} more\n{B}"),
    (f"<article><p><a href=/x>one</a> and <a name=y> {A}</p></article>", f"one and {A}"),
    (f"<form action=/page><div><nav><a href=/>Home</a></nav><h1>Title here</h1><p>{A}</p><p>{B}</p><label>Your name</label><input name=q><select><option>{A}</select><textarea>{A}</textarea><button>Send it</button></div></form>", f"Title here\n{A}\n{B}"),
    (f"<form id=aspnetForm><div class=content><p>{A}</p><form><p>{B}</p></form></div><footer>{B}</footer></form>", A),
    (f"<form><article><p>{A}</p></article><div class=newsletter><p>{B}</p></div></form>", A),
    (f"<div><p>{A} {A}</p><p>{B}</p></div><form><p>{B}</p><label>Your name</label></form>", f"{A} {A}\n{B}"),
])
def test_anchors_and_forms(page, want):
    assert main_text(page) == want


def test_random_pages():
    rng = random.Random(4)
    some = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her".split()
    rest = "river stone house bridge winter market letter garden window journey mountain captain".split()

    def sentence(n):
        return " ".join(rng.choice(some if rng.random() < 0.5 else rest) for _ in range(n)).capitalize() + "."

    for k in range(300):
        paragraphs = [sentence(rng.randrange(30, 90)) for _ in range(rng.randrange(2, 7))]
        article = [rng.choice(["<p>{}</p>", "<p>\n {} </p>", "<p>{}", "<div>{}</div>", "<a name=x><p>{}</p>", "<a id='y'></a><p>{}</p>", "<p><a name=z>{}</p>"]).format(html.escape(p)) for p in paragraphs]
        noise = [
            f"<nav><ul><li><a href=/>{sentence(2)}</a><li><a href=/>{sentence(3)}</a></ul></nav>", f"<div class='{rng.choice(['ad', 'sidebar', 'cookie-notice', 'comments', 'share-buttons', 'newsletter-signup'])}'><p>{sentence(40)}</p></div>",
            f"<aside><p>{sentence(50)}</p></aside>", f"<form><p>{sentence(30)}</p></form>", "<script>var a = '<p>';</script>", f"<!-- <p>{sentence(40)}</p> -->", f"<ul><li><a href=x>{sentence(4)}</a></ul>", f"<footer>{sentence(40)}</footer>",
        ]
        wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class=entry-content>{}</div>", "<div>{}</div>", "<div class='page with-sidebar'>{}</div>"])
        before, after = rng.sample(noise, 3), rng.sample(noise, 3)
        if k % 3 == 0:  # a server's form around everything
            before, after = ["<form method=post action=./ id=form1><input type=hidden name=state value=x>", *(x for x in before if "form>" not in x)], [*(x for x in after if "form>" not in x), "</form>"]
        page = f"<html><head><title>{sentence(5)}</title></head><body>{''.join(before)}{wrap.format(''.join(article))}{''.join(after)}</body></html>"
        assert main_text(page) == "\n".join(paragraphs), page
