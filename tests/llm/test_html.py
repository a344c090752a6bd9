"""What markup drops and keeps, and very long pages."""

import time

import pytest

from trestle.llm import html_diff

PAGE = (
    "<html><body><nav>menu</nav><div class='site-footer'>foot</div><article><h1>Title</h1>{}<p>" + "long text " * 30 + "</p></article>"
    "<section class='comments'>remark</section></body></html>"
)


@pytest.mark.parametrize(
    "inner",
    [
        '<h2 id="related-work">own words</h2>',
        '<section id="social-history"><p>own words</p></section>',
        '<section id="search-algorithms"><p>own words</p></section>',
        '<h3 id="legal-basis">own words</h3>',
        '<h2 id="modal-logic">own words</h2>',
        '<p class="share-price">own words</p>',
        '<blockquote id="reply-of-the-king">own words</blockquote>',
        "<p>some <label>own words</label> more</p>",
        "<header><h2>own words</h2><nav>gone</nav><form>gone</form></header>",
        '<p>own words</p><div class="ad">gone</div><aside>gone</aside><div class="comments"><p>gone</p></div>',
        '<div role="navigation">gone</div><div id="share">gone</div>own words',
    ],
)
def test_an_article_keeps_its_own_text(inner):
    lines, marked = html_diff.lines_of(PAGE.format(inner))
    text = "\n".join(lines)
    assert marked and "own words" in text and lines[0] == "Title"
    assert not any(x in text for x in ("gone", "menu", "foot", "remark"))


def test_words_in_names_count_for_containers_outside_of_articles():
    lines, _ = html_diff.lines_of('<div class="cookie-banner">gone</div><ul id="main-nav"><li>gone</ul><p id="notice-of-war">kept</p><h2 id="tags">kept too</h2>')
    assert lines == ["kept", "kept too"]


@pytest.mark.parametrize("unit", ["<header>a", "<div>x</span>", "</b>", "<span>", "<li>", "<p><b>", "<div>", "<td>x</p>", "<p>a</i></p>"])
def test_long_pages_take_linear_time(unit):
    start = time.process_time()
    html_diff.lines_of("<article>" + unit * 100_000)
    assert time.process_time() - start < 10
