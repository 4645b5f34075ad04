"""Page reading on ordinary and hostile markup, and main texts against the articles of the test pages."""

import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from conftest import DATA

from joblattice.llm import html_extract

NAV = '<nav><a href="/">Home</a> <a href="/x">News</a></nav>'
BODY = "<p>The committee met on Tuesday to discuss the new harbour plan, and most members agreed with it.</p><p>Work begins in spring, said the mayor, who thanked everyone for their patience.</p>"
TEXT = "Harbour plan\n\nThe committee met on Tuesday to discuss the new harbour plan, and most members agreed with it.\n\nWork begins in spring, said the mayor, who thanked everyone for their patience."
MAIN = f"<article><h1>Harbour plan</h1>{BODY}</article>"


def main_text(page):
    return html_extract.main_texts([page], html_extract.fitted(400, 11))[0]


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><body>{NAV}{MAIN}</body></html>",
        f"<html><head><title>x</title>{NAV}{MAIN}",
        f"<head><title>x</title><style>p{{}}</style>{MAIN}",
        f"{NAV}<button>Menu{MAIN}<button>ok</button>",
        f"{NAV}<select><option>a<option>b{MAIN}",
        f"{NAV}<select><option>a<option>b</select>{MAIN}",
        f'{NAV}<svg><path d="x">{MAIN}',
        f'{NAV}<noscript><img src="x">{MAIN}',
        f"{NAV}<article><header><h1>Harbour plan</h1></header>{BODY}</article><footer>&copy; x</footer>",
        f'{NAV}{MAIN}<footer>&copy; x</footer><p <a href="cut off',
        f"{NAV}{'<div>' * 3000}{MAIN}{'</div>' * 3000}",
    ],
)
def test_no_page_is_lost(page):
    assert main_text(page) == TEXT


def test_unbalanced_quote_ends_with_its_tag():
    assert main_text(f'{NAV}<article><h1>Harbour plan</h1><p title="x>Hello there, dear reader, it goes on.</p>{BODY}</article>').startswith("Harbour plan\n\nHello there, dear reader, it goes on.\n\nThe committee")
    assert main_text(f'{NAV}<article><h1>Harbour plan</h1><p title="a > b" lang=it\'s>{BODY[3:]}</article>') == TEXT


def test_short_articles_and_odd_characters():
    assert main_text(f"{NAV}<article><p>The harbour is closed.</p></article>") == "The harbour is closed."
    assert main_text(f"{NAV}<main><p>The harbour is closed until noon.</p></main><footer>&copy; 2020</footer>") == "The harbour is closed until noon."
    assert "3 < 4 and 5 > 2" in main_text(f"{NAV}<article><h1>Harbour plan</h1><p>We know that 3 < 4 and 5 > 2, and so on, for all of these numbers.</p>{BODY}</article>")
    assert main_text(NAV) == "" and main_text("<") == "<" and main_text("<!-- x") == ""


@pytest.mark.parametrize("piece", ['<a "', '<a title="', "<button>", '<a title=">"', "<div>", "<noscript>", "<", "<svg><p>", "<!--", "<div><p>x", "<select><option>", "<table><tr><td>", "</div>", '<p x=">'])
def test_time_grows_with_the_length(piece):
    def seconds(n):
        begun = time.process_time()
        html_extract.parse(piece * n)
        return time.process_time() - begun

    seconds(100)
    assert seconds(40_000) < 16 * max(seconds(5_000), 0.02)


@pytest.mark.parametrize("opening,closing", [("<div>", "</section>"), ("<div>", "<dt></dt>"), ("<li><ul><div>", "<li></li>"), ("<title>", "x"), ("<table><div>", "<td></td>"), ("<p>", "</a>")])
def test_time_grows_with_unmatched_tags(opening, closing):
    def seconds(n):
        begun = time.process_time()
        html_extract.parse(opening * n + closing * n)
        return time.process_time() - begun

    seconds(100)
    assert seconds(40_000) < 16 * max(seconds(5_000), 0.02)


def _other_writer(rng, i):
    """A page in another hand: no telling names, real words, a menu and a notice around the article."""
    words = "the harbour master said that boats from all three islands would be moved before winter because repairs to the wall had been put off".split()
    prose = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    menu = "".join(f"<a href='/{k}'>{w.capitalize()}</a> " for k, w in enumerate(rng.choice(words, int(rng.integers(3, 9)))))
    blocks = [prose(int(rng.integers(15, 70))) for _ in range(int(rng.integers(2, 8)))]
    heading = prose(6)
    body = f"<h2>{heading}</h2>" + "".join(f"<p>{b}</p>" for b in blocks)
    body = (f"<div class='k{i}'>{body}</div>", f"<section>{body}</section>", f"<div><div>{body}</div></div>", body)[i % 4]
    foot = ("<div class='y'>All rights reserved</div>", "<div>&copy; 2020 Harbour Times</div>", f"<div>{menu}</div>")[i % 3]
    return f"<html><body><div class='top'>{menu}</div>{body}{foot}</body></html>", "\n\n".join([heading, *blocks])


def test_pages_of_another_writer_without_names():
    rng = np.random.default_rng(5)
    pages = [_other_writer(rng, i) for i in range(120)]
    texts = html_extract.main_texts([p for p, _ in pages], html_extract.fitted(400, 11))
    right = sum(t == want for t, (_, want) in zip(texts, pages, strict=True))
    assert right >= 0.9 * len(pages), right


class _Article(HTMLParser):
    """The blocks of the article element, by the standard library's reader."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("h1", "p"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("h1", "p"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_texts_are_the_articles(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        reader = _Article()
        reader.feed(r.html)
        blocks = [re.sub(r"\s+", " ", b).strip() for b in reader.blocks]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_empty_table_and_repeated_rows(spark):
    rows = [(1, "u", MAIN), (1, "u", MAIN), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len(TEXT), len(TEXT)]
    assert html_extract.extract(df.where("false")).count() == 0
