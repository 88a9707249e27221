"""Main text inside elements whose class or id holds a boilerplate word."""

import time

import pytest

from spanlake.llm.html_content import _name_mark, main_text, tokens

WORDS = "these are the words of the story that a reader came for"
PAGE = "<html><body><nav>a b c d</nav>%s<footer>e f g</footer></body></html>"


@pytest.mark.parametrize("wrapper", [
    "<div class='layout with-sidebar'>", "<div id='page' class='has-header'>", "<div class='header'>", "<form id='form'>", "<aside>"])
@pytest.mark.parametrize("name", ["article", "main"])
def test_no_ancestor_covers_an_article(wrapper, name):
    end = "</" + wrapper[1:].split()[0].rstrip(">") + ">"
    page = PAGE % f"{wrapper}<{name}><p>{WORDS}</p></{name}><p>after</p>{end}"
    assert main_text(page, {}) == WORDS
    # the state of the wrapper comes back behind the element
    if wrapper == "<aside>":
        assert [t[2] for t in tokens(page) if t[1] == "after"] == [True]


@pytest.mark.parametrize("tag", ["div class='share-story'", "section class='related-work'"])
def test_parts_of_names_are_negative_tokens_only(tag):
    end = tag.split()[0]
    page = PAGE % f"<article><p>{WORDS}</p><{tag}><p>more of it</p></{end}><p>the end</p></article>"
    assert main_text(page, {}) == f"{WORDS} more of it the end"
    assert f"{end}~" in [t[0] for t in tokens(page)]


def test_whole_names_stay_out():
    page = PAGE % f"<article><p>{WORDS}</p><div class='box ad'>buy this now</div><section id='comments'><article>me too</article></section></article>"
    assert main_text(page, {}) == WORDS


@pytest.mark.parametrize("attrs", ["style=\"overflow:hidden\"", "title='The hidden cost'", "data-id=nav", "data-class='ad'", "title=Bob's", "alt='a=b' title=\"it's id=menu\"", "onclick=\"x('>')\""])
def test_values_are_no_attributes(attrs):
    page = PAGE % f"<div {attrs}><article><p {attrs}>{WORDS}</p><p>it's the end</p></article></div>"
    assert main_text(page, {}) == f"{WORDS} it's the end"
    page = PAGE % f"<div {attrs}><p {attrs}>{WORDS}</p><p>it's the end</p></div>"
    assert main_text(page, {}) == f"{WORDS} it's the end"


@pytest.mark.parametrize("name", ["comment-list", "user-comments", "ad-slot", "cookie-banner", "site-footer", "userComments", "comments__area", "page_sidebar", "newsletter-box", "legal-notice"])
@pytest.mark.parametrize("how", ["class", "id"])
def test_containers_by_parts_of_names_stay_out(name, how):
    block = f"<div {how}='{name}'><p>not a word of this</p></div>"
    long = " ".join([WORDS] * 3)
    assert main_text(PAGE % f"<article><p>{long}</p>{block}<p>the end</p></article>", {}) == f"{long} the end"
    assert main_text(PAGE % f"<div class='story'><p>{long}</p><p>the end</p></div>{block}", {}) == f"{long} the end"


def test_frames_are_no_boilerplate():
    page = PAGE % f"<div id='content-sidebar'><section class='main-nav'><p>{WORDS}</p></section></div>"
    assert main_text(page, {}) == WORDS
    # a long discussion is not the page's frame
    talk = "<div class='post-comments'><p>" + "me too " * 60 + "</p></div>"
    assert main_text(PAGE % f"<article><p>{WORDS}</p>{talk}</article>", {}) == WORDS


def test_names():
    said = {n: _name_mark(n) for n in ("ad", "Footer", "with-sidebar", "no-comments", "share-story", "badge", "shadow", "header-image", "story", "download-ads", "sidebarLeft")}
    assert said == {"ad": "*", "Footer": "*", "with-sidebar": "~", "no-comments": "~", "share-story": "~", "badge": "", "shadow": "", "header-image": "~", "story": "",
                    "download-ads": "*", "sidebarLeft": "?"}


@pytest.mark.parametrize("page", [
    "<b>" * 200_000 + "</i>" * 200_000, "<div>" * 150_000 + "<p>" * 150_000, "<p>" + "<div>" * 100_000 + "<p>x" * 100_000, "</p>" * 250_000,
    "<a title=\"x" * 80_000, "<a b='" * 100_001, "<a " + "=" * 900_000, "<" * 1_000_000])
def test_a_megabyte_of_stray_tags_is_read_in_time(page):
    t = time.process_time()
    main_text(page, {})
    assert time.process_time() - t < 10
