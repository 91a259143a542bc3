"""Main texts of generated pages: several layouts a host, sibling containers, words that clutter and content share."""

from __future__ import annotations

import time

import numpy as np
from cascadia.llm import html_text

NAMES = "page_id long, url string, html string, host string, paths int, text string"


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghiklmnoprstuvw"), rng.integers(2, 9))) for _ in range(n)).capitalize() + "."


def layout(kind, rng, k):
    """(html, main text) of one page."""
    a, b, c = (words(rng, int(n)) for n in rng.integers(20, 60, 3))
    menu = "<nav><a href=/>Home</a> <a href=/x>Topics</a></nav>"
    foot = "<footer>© All rights</footer>"
    if kind == 0:  # two containers beside each other
        lead = words(rng, 8)
        return f"<html><body>{menu}<div class='wrap'><div class='col content'><p>{lead}</p></div><div class='sidebar'>Most read<ul><li>x</ul></div><div class='col content'><h1>{a}</h1><p>{b}</p></div></div>{foot}</body></html>", f"{lead} {a} {b}"
    if kind == 1:  # parts of the article that are named like clutter
        return f"<html><body>{menu}<article><h2>{a}</h2><p class='legal'>{b}</p><div class='related-work'><p>{c}</p></div><div class='related'><a href=1>{words(rng, 4)}</a> <a href=2>{words(rng, 4)}</a></div><p class='copyright'>Written for the daily post of the north.</p></article>{foot}</body></html>", f"{a} {b} {c}"
    if kind == 2:  # a plain container without a name that says so
        return f"<html><body><div class='top'>{menu}</div><div class='z{k % 3}'><p>{a}<p>{b}<br>{c}</div><div class='comments'><p>{words(rng, 90)}</div>{foot}</body></html>", f"{a} {b} {c}"
    # a long list of reader comments without a telling name is outvoted by the other pages
    tail = f"<div class='talk'><p>{words(rng, 150)}</p></div>" if k % 4 == 0 else ""
    return f"<html><body>{menu}<div class='story'><p>{a}</p><ul><li>{b}</li><li>{c}</li></ul></div>{tail}{foot}</body></html>", f"{a} {b} {c}"


def test_generated_pages(spark):
    rng = np.random.default_rng(21)
    rows, want = [], {}
    for host in range(4):
        for k in range(24):
            page, text = layout(k % 3 if host < 2 else host, rng, k)
            i = len(rows)
            rows.append((i, f"https://h{host}.example/p{k}", page, "x", 1, "y"))
            want[i] = text
    df = spark.createDataFrame(rows, NAMES).repartition(5)
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    wrong = {i: (got[i], want[i]) for i in want if got[i] != want[i]}
    assert not wrong, next(iter(wrong.values()))
    again = html_text.main_text(df.union(df)).collect()
    assert len(again) == 2 * len(rows) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in again)


def test_deep_and_long_pages(spark):
    deep = "<div class='a1'>" * 4000 + "<p>At the bottom of it all.</p>" + "</div>" * 4000
    long = "<article>" + "<p>word and word</p>" * 20_000 + "</article>"
    rows = [(1, "http://d.example/1", deep, "x", 1, "y"), (2, "http://d.example/2", deep, "x", 1, "y"), (3, "http://l.example/", long, "x", 1, "y"), (4, None, long, "x", 1, "y"), (5, "http://d.example/3", None, "x", 1, "y"), (6, "http://d.example/4", "<p", "x", 1, "y"), (7, "", "only text", "x", 1, "y")]
    start = time.time()
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, NAMES)).collect()}
    assert time.time() - start < 60
    assert got[1] == got[2] == "At the bottom of it all." and got[3] == got[4] == " ".join(["word and word"] * 20_000)
    assert got[5] == got[6] == "" and got[7] == "only text"


def test_votes_are_counted_by_page(spark):
    page = "<body><div class='n7'><p>One text that is long enough to count.</p></div></body>"
    rows = [(k, "http://v.example/", page.replace("n7", f"n{k}"), "x", 1, "y") for k in range(3)]
    votes = html_text.host_votes(spark.createDataFrame(rows, NAMES)).collect()
    assert {(r.kind, r.n) for r in votes} == {("path", 3)} and len(votes) == 2  # digits of classes are masked; the container and the body
    assert max(r.votes for r in votes) == 3.0
