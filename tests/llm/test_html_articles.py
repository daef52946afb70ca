"""What an article holds stays: lists of links, labels, sections with telling names, further articles; and stray tags cost nothing."""

from __future__ import annotations

import time

import pytest

from foliate.llm import html_text

PARAGRAPH = "<p>" + "This is a sentence of the article, with commas, and words. " * 8 + "</p>"


def page(inside, after=""):
    return f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1>{PARAGRAPH}{inside}{PARAGRAPH}</article>{after}<footer>foot</footer></body></html>"


KEPT = [
    ("<ul>" + "".join(f"<li><a href=x>Reference {i}</a></li>" for i in range(9)) + "</ul>", "Reference 8"),
    ("<table><tr><td><a href=y>Cell link</a></td></tr></table>", "Cell link"),
    ("<div><a href=z>See the official report of the year</a></div>", "official report"),
    ("<label>Note</label>", "Note"),
    (f"<section class='social-history'>{PARAGRAPH}SOC</section>", "SOC"),
    (f"<div id='share-price'>{PARAGRAPH}SHP</div>", "SHP"),
    (f"<section class='trending-topic-analysis'>{PARAGRAPH}TTA</section>", "TTA"),
]
CUT = ["<div class='related-posts'><p>BAD one two three</p></div>", "<div class='share-buttons'>BAD</div>", "<section class='comments'><p>BAD comment, yes</p></section>", "<div class='newsletter-box'>BAD</div>", "<aside>BAD</aside>", "<form><label>BAD</label></form>", "<nav><a href=x>BAD</a></nav>"]


@pytest.mark.parametrize(("inside", "text"), KEPT)
def test_text_of_the_article_stays(inside, text):
    assert text in html_text.main_text(page(inside))


@pytest.mark.parametrize("inside", CUT)
def test_parts_that_are_none_go(inside):
    assert "BAD" not in html_text.main_text(page(inside))


def test_further_articles_but_no_teasers():
    assert "SECOND" in html_text.main_text(page("", f"<article>{PARAGRAPH}SECOND{PARAGRAPH}</article>"))
    got = html_text.main_text(page("", "<article><a href=x>TEASER one</a></article>" * 5))
    assert "TEASER" not in got and got.startswith("Title This is")


def test_stray_end_tags_take_no_time():
    began = time.time()
    assert html_text.main_text("<article>" + "<span>" * 20_000 + "text" + "</i>" * 20_000 + "</article>") == "text"
    assert time.time() - began < 5
