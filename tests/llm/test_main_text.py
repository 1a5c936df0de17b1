"""Main text: pages put together from known parts, so that the right answer is known, and names that must not empty a page."""

import random

import pytest

from tidepanel.llm import html_extract

STATES = """post comments-open|entry has-comments|post no-comments|story comment-count-5|comments-closed post|post comment-status-open|hentry comments-enabled|with-comments
has-sidebar|no-sidebar entry|with-sidebar-left|without-ads|ads-enabled|no-ads story|show-share|share-enabled|is-sponsored-false no-promo|nav-open|menu-open page|has-footer|no-footer
has-related|no-related|has-menu wide|not-search|has-banner|no-banner|alert-closed|with-notice|no-newsletter|has-newsletter|popup-disabled|modal-open|cookies-allowed|subscribe-off|login-status
has-toolbar|no-pagination|has-breadcrumbs|no-overlay-anywhere""".replace("\n", "|").split("|")
WORDS = "river stone market letter winter garden engine window silver journey teacher island record summer bridge".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(9, 22))).capitalize() + rng.choice([".", "!", ", it was said; so we went on.", "?"])


def paragraph(rng):
    return " ".join(sentence(rng) for _ in range(rng.randint(2, 5)))


def test_there_are_forty_names():
    assert len(STATES) >= 40 and len(set(STATES)) == len(STATES)


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_names_that_tell_a_state_keep_the_article(tag):
    rng = random.Random(tag)
    for name in STATES:
        for attribute in ("class", "id"):
            body = [paragraph(rng) for _ in range(6)]
            page = f'<html><body><nav><a href="/">Home</a> <a href="/x">News</a></nav><{tag} {attribute}="{name}"><h1>Head</h1>{"".join(f"<p>{p}</p>" for p in body)}</{tag}><footer>About us</footer></body></html>'
            assert html_extract.main_text(page) == "\n".join(["Head", *body]), (tag, name)


@pytest.mark.parametrize("name", ["comments", "comment-list", "comments-area", "commentlist", "post-comments comments", "comment", "disqus_thread comments-section"])
def test_readers_comments_go_however_long_they_are(name):
    rng = random.Random(name)
    body = [paragraph(rng) for _ in range(3)]
    replies = "".join(f'<article class="comment-body"><p>{paragraph(rng)}</p></article>' for _ in range(8))
    page = f'<html><body><article class="post comments-open"><h1>Head</h1>{"".join(f"<p>{p}</p>" for p in body)}</article><div class="{name}">{replies}</div></body></html>'
    assert html_extract.main_text(page) == "\n".join(["Head", *body])


def test_headings_that_are_links_stay_between_content():
    rng = random.Random(1)
    a, b, c = paragraph(rng), paragraph(rng), paragraph(rng)
    for tag in ("article", "div"):
        page = f'<body><{tag}><p>{a}</p><h2><a href="#x">A linked heading</a></h2><p>{b}</p><h3><a href="#y">Another</a></h3><p>{c}</p></{tag}><div><h3><a href="/more">Read this too</a></h3></div></body>'
        assert html_extract.main_text(page) == f"{a}\nA linked heading\n{b}\nAnother\n{c}"


def built(rng):
    """A page and the blocks of its article."""
    truth = [rng.choice(["A head", "Über alles & more"])]
    body = [f"<h1>{truth[0].replace('&', '&amp;')}</h1>"]
    for _ in range(rng.randint(3, 9)):
        text = paragraph(rng)
        kind = rng.random()
        if kind < 0.6:
            words = text.split(" ")
            shown = [f"<em>{w}</em>" if rng.random() < 0.03 else f'<a href="/{w}">{w}</a>' if rng.random() < 0.03 else w for w in words]
            body.append(f"<p>{(' ' if rng.random() < 0.5 else chr(10) + '  ').join(shown)}</p>")
            truth.append(text)
        elif kind < 0.75:
            items = [sentence(rng) for _ in range(3)]
            body.append("<ul>" + "".join(f"<li>{i}" + ("</li>" if rng.random() < 0.5 else "") for i in items) + "</ul>")
            truth += items
        elif kind < 0.9:
            body.append(f"<h2>Part {len(truth)}</h2><blockquote><p>{text}</p></blockquote>")
            truth += [f"Part {len(truth)}", text]
        else:
            body.append(f"<p>{text}</p><script>var x = '<p>not shown</p>';</script><!-- <p>nor this</p> -->")
            truth.append(text)
    links = lambda n: "".join(f'<li><a href="/{rng.choice(WORDS)}">{rng.choice(WORDS)} {rng.choice(WORDS)}</a></li>' for _ in range(n))
    around = rng.choice(["<article class='post'>{}</article>", "<main><article>{}</article></main>", "<div class='content comments-open'>{}</div>", "<div id='story'><div class='body'>{}</div></div>"])
    before = [f"<nav><ul>{links(6)}</ul></nav>", "<header><p>The Daily Name</p></header>", "<div class='cookie-notice'><p>We use cookies. Accept them all?</p></div>", f"<div class='breadcrumbs'><ul>{links(2)}</ul></div>"]
    after = [f"<aside><h3>More</h3><ul>{links(5)}</ul></aside>", "<form><label>Your name</label><input></form>", f"<section id='comments'><p>{sentence(rng)}</p><p>{sentence(rng)}</p></section>", "<footer><p>All rights reserved. Imprint.</p></footer>", "<div class='ad'><p>Buy now!</p></div>"]
    page = "".join(rng.sample(before, rng.randint(0, 4))) + around.format("".join(body)) + "".join(rng.sample(after, rng.randint(0, 5)))
    return f"<!doctype html><html><head><title>t</title><style>p {{}}</style></head><body>{page}</body></html>", "\n".join(truth)


def test_pages_built_from_known_parts():
    rng = random.Random(7)
    cases = [built(rng) for _ in range(400)]
    wrong = [(page, truth) for page, truth in cases if html_extract.main_text(page) != truth]
    assert len(wrong) <= 4, wrong[0]
