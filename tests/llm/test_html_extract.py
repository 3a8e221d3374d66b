"""Tag-path ratios: against sums made by hand, against pages without names to go by, and on pages of several kinds."""

from __future__ import annotations

import html
import re
from collections import Counter

import pytest

from lakeweave.llm import html_extract

LONG = "The committee met on Tuesday, and after a long debate, it agreed to publish the findings in full, with all of the annexes. "
NOTE = "Readers should note that the figures, which were compiled in May, are not final. "


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return [p for p in parts if p]


def bare(page):
    """The page without classes, ids and roles, its semantic elements made divisions."""
    page = re.sub(r'\s(class|id|role)="[^"]*"', "", page)
    return re.sub(r"<(/?)(article|nav|footer|header|aside|main|section)\b", r"<\1div", page)


@pytest.fixture(scope="module")
def pages():
    import duckdb

    return [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]


def test_ratios_are_the_sums_by_path(pages):
    for page in pages[:40]:
        found, _ = html_extract.blocks(page)
        for path, (ratio, unlinked) in html_extract.path_ratios(found).items():
            mine = [b for b in found if b.path == path]
            chars, links = sum(len(b.text) for b in mine), sum(b.link_chars for b in mine)
            marks = sum(c in "。，；：！？、" or (c in ".,;:!?…" and (after == "" or after.isspace() or after in "\"'”’»)]")) for b in mine for c, after in zip(b.text, [*b.text[1:], ""], strict=True))
            assert ratio == pytest.approx((chars - links) * (1 + marks / len(mine))) and unlinked == pytest.approx(1 - links / chars)


def test_ratios_decide_on_pages_without_names(pages):
    both, got_all, want_all, unchanged = 0, 0, 0, 0
    for page in pages:
        want = article(page)
        got = html_extract.main_text(bare(page)).split("\n")
        both += (Counter(want) & Counter(got)).total()
        got_all, want_all = got_all + len(got), want_all + len(want)
        unchanged += got == [b.text for b in html_extract.blocks(bare(page))[0]]
    assert both / got_all >= 0.95 and both / want_all >= 0.95 and unchanged < 0.02 * len(pages)


def test_switching_the_ratios_off_changes_pages(pages, monkeypatch):
    assert all(html_extract.main_text(p).split("\n") == article(p) for p in pages)
    assert all([b.text for b in html_extract.blocks(p)[0]] != article(p) for p in pages)
    monkeypatch.setattr(html_extract, "path_ratios", lambda found: {b.path: (1.0, 1.0) for b in found})
    assert not any(html_extract.main_text(bare(p)).split("\n") == article(p) for p in pages)


def test_an_article_in_a_marked_wrapper_is_kept():
    page = f'<body><div class="wrap side form"><div class=ad>Buy now, today!</div><div class=story><h1>Title</h1><p>{LONG}</p><p>{NOTE}</p></div></div><footer>All rights.</footer></body>'
    assert html_extract.main_text(page).split("\n") == ["Title", LONG.strip(), NOTE.strip()]


def test_a_journal_page():
    page = f"""<html><body class="single comments-open"><div id=page><header id=masthead class=site-header><div class=title>My Blog</div><nav class=main-nav><ul><li><a href=/>Home</a></ul></nav></header>
<div id=content><main><article class=post><header class=entry-header><h1>How it went</h1></header><p>{LONG * 3}</p><h2>Second part</h2><p>{NOTE * 2}</p><ul><li>first thing<li>second thing</ul>
<figure><img src=a><figcaption>A caption here.</figcaption></figure><blockquote><p>{NOTE}</p></blockquote><p>End.</p><table><tr><th>Name<th>Value<tr><td>a<td>1</table><footer class=entry-footer>Posted in <a href=x>News</a></footer></article>
<div id=comments><h2>3 comments</h2><ol><li><p>{NOTE} I agree, really!</p><li><p>{LONG}</p></ol><form>Leave a reply</form></div></main><aside><h3>Recent posts</h3><p>About the author: {NOTE}</p></aside></div>
<footer><p>Copyright 2020. All rights reserved. Terms, privacy.</p></footer></div></body></html>"""
    want = ["How it went", (LONG * 3).strip(), "Second part", (NOTE * 2).strip(), "first thing", "second thing", "A caption here.", NOTE.strip(), "End.", "Name", "Value", "a", "1"]
    assert html_extract.main_text(page).split("\n") == want


def test_comments_longer_than_the_article():
    page = f"<body><article><h1>T</h1><p>{LONG}</p></article><section id=comments>{''.join(f'<div class=comment><p>{NOTE * 3}</p></div>' for _ in range(30))}</section></body>"
    assert html_extract.main_text(page).split("\n") == ["T", LONG.strip()]


def test_comments_that_are_articles():
    page = f"<body><main><h1>T</h1><article><p>{LONG}</p></article><section id=comments>{''.join(f'<article class=comment><p>{NOTE * 3}</p></article>' for _ in range(30))}</section></main></body>"
    assert html_extract.main_text(page).split("\n") == ["T", LONG.strip()]


def test_empty_tables_clashing_names_and_repeated_rows(spark):
    rows = [(1, "u", "<p>Some text, here.", "mine"), (1, "u", "<p>Some text, here.", "mine"), (None, None, None, "x"), (3, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(tuple(r) for r in html_extract.extract(df).select("url", "text").na.fill("-").collect())
    assert got == [("-", ""), ("u", "Some text, here."), ("u", "Some text, here."), ("v", "")]
    assert html_extract.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("name", "share-price side-effects comment-on-law form-and-function ad-hoc legal-basis notice-period story".split())
def test_classes_that_only_hold_a_mark_lose_no_paragraph(name):
    page = f'<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{NOTE}</p><div class="{name}"><p>{LONG}</p></div><p>{NOTE}</p></article><footer>All rights.</footer></body>'
    assert html_extract.main_text(page).split("\n") == ["Title", NOTE.strip(), LONG.strip(), NOTE.strip()]


def test_ratios_decide_where_no_article_is_named(pages, monkeypatch):
    unnamed = [re.sub(r"<(/?)article\b", r"<\1div", p) for p in pages]
    alone = sum(html_extract.main_text(p).split("\n") == article(q) for p, q in zip(unnamed, pages, strict=True))
    assert alone >= 0.95 * len(pages)
    monkeypatch.setattr(html_extract, "path_ratios", lambda found: {b.path: (1.0, 1.0) for b in found})
    assert sum(html_extract.main_text(p).split("\n") == article(q) for p, q in zip(unnamed, pages, strict=True)) < 0.05 * len(pages)


def test_fusion_smoothing_and_threshold_by_hand():
    """Two containers and a footer: the runs' ratios by definition, one after another."""
    page = f"<body><div><h1>Head</h1><p>{LONG}</p></div><div><p>{NOTE}</p><ul><li>one</ul></div><footer>Legal, all of it.</footer></body>"
    found, priors = html_extract.blocks(page)
    chars, marks = [len(b.text) for b in found], [0, 4, 3, 0, 2]
    assert [b.path[-1] for b in found] == ["h1", "p", "p", "li", "footer"]
    of_p = (chars[1] + chars[2]) / 2**0.5 * (1 + (marks[1] + marks[2]) / 2)  # one path, in two containers
    ratio = [chars[0], of_p, of_p, chars[3], chars[4] * 3]
    kernel, box = html_extract.KERNEL, [0, 0, 1, 1, 2]
    smooth = [sum(kernel[abs(i - j)] * ratio[j] for j in range(5) if box[i] == box[j]) / sum(kernel[abs(i - j)] for j in range(5) if box[i] == box[j]) for i in range(5)]
    smooth[1] = smooth[2] = max(smooth[1], smooth[2])
    got = html_extract._smoothed(found, html_extract.path_ratios(found))
    assert [got[b.path] for b in found] == pytest.approx(smooth)
    prior = [1, 1, 1, 1, 0.3]
    mean = sum(s * n * p for s, n, p in zip(smooth, chars, prior, strict=True)) / sum(n * p for n, p in zip(chars, prior, strict=True))
    assert html_extract.content_blocks(found, priors) == [s * p >= 0.25 * mean for s, p in zip(smooth, prior, strict=True)]
