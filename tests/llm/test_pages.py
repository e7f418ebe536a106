"""Main text of generated pages without article elements, names that only sound like junk, and the scores against a plain version."""

import random

import pytest

from foliant.llm import pagetext
from foliant.llm.pagetext import main_text

WORDS = "river stone winter market garden letter window bridge summer village forest candle harbour mountain".split()


def say(rng, n):
    return " ".join(rng.choice(WORDS) + ("," if rng.random() < 0.15 else "") for _ in range(n)).capitalize() + "."


PROSE = [say(random.Random(k), 45) for k in range(8)]
BODY = "".join(f"<p>{p}</p>" for p in PROSE[:4])
TEXT = "\n\n".join(PROSE[:4])


@pytest.mark.parametrize("open_", [
    '<div class="layout no-sidebar">', '<div class="post comments-open">', '<div class="social-policy">', '<div id="legal-history">', '<form action="/x"><div>', '<div class="with-sidebar has-menu">',
    '<div class="alert-fatigue-study">', '<div role="search">', '<div class="widget-free">', '<section id="noticeText">', '<div class="sidebar-off">', '<div class="page"><div class="content">',
])
def test_wrappers_that_sound_like_junk(open_):
    close = "".join(f"</{t.split()[0].rstrip('>')}>" for t in reversed(open_.split("<")[1:]))
    junk = '<nav><a href="/">Home</a> <a href="/a">About us</a></nav><div class="ad">Buy now, cheap.</div>'
    assert main_text(f"<html><body>{junk}{open_}{BODY}{close}<footer>All rights, ours.</footer></body></html>") == TEXT
    assert main_text(f"<html><body>{junk}<article>{open_}{BODY}{close}</article></body></html>") == TEXT


def test_junk_stays_junk():
    for name in ("sidebar", "comment-list", "post-comments", "share-buttons", "related-posts", "newsletter-box", "cookieNotice", "ad-slot-3", "site-header", "promo_box", "breadcrumbs", "story-related"):
        junk = f'<div class="{name}"><p>{PROSE[6][:120]}</p></div>'
        assert main_text(f"<body><div>{BODY}</div>{junk}</body>") == TEXT and main_text(f"<body><article>{BODY}{junk}</article></body>") == TEXT, name
    readers = "".join(f'<article class="comment-body"><p>{p}</p></article>' for p in PROSE[4:])
    assert main_text(f'<body><article>{BODY}<div id="comments">{readers * 3}</div></article></body>') == TEXT  # more than the article has
    links = "".join(f'<li><a href="/{k}">Another story</a></li>' for k in range(6))
    assert main_text(f"<body><article>{BODY}<ul>{links}</ul></article></body>") == TEXT
    assert main_text(f'<body><article>{BODY}<ul><li>one item, long enough</li><li>see <a href="/x">that</a></li></ul></article></body>').endswith("one item, long enough\n\nsee that")


@pytest.mark.parametrize("more", [1, 2, 4])
def test_several_articles(more):
    second = "".join(f"<p>{p}</p>" for p in PROSE[4 : 4 + more])
    page = f'<body><main><article>{BODY}</article><article>{second}</article></main><article class="teaser"><p>Short one.</p></article></body>'
    assert main_text(page) == "\n\n".join(PROSE[: 4 + more])


def test_generated_pages_without_article_elements():
    rng = random.Random(12)
    for _ in range(300):
        want = [say(rng, 6)] + [say(rng, rng.randrange(25, 80)) for _ in range(rng.randrange(3, 9))]
        inner = f"<h1>{want[0]}</h1>" + "".join(f"<p>{p}</p>" for p in want[1:])
        for _ in range(rng.randrange(0, 3)):
            inner = f'<div class="{rng.choice(["content", "wrap", "page", "col-9", "story", "x1", "no-sidebar", "grid"])}">{inner}</div>'
        junk = [
            '<nav><ul><li><a href="/a">First</a></li><li><a href="/b">Second</a></li></ul></nav>', f'<div class="{rng.choice(["sidebar", "left-sidebar", "widget-area"])}"><p>{say(rng, 15)}</p></div>', f'<div class="ad">{say(rng, 10)}</div>',
            f'<form><label>{say(rng, 5)}</label><input name="q"><button>Go</button></form>', f'<div class="comments"><p>{say(rng, 30)}</p><p>{say(rng, 40)}</p></div>', f"<footer>{say(rng, 12)}</footer>", "<script>var a = '<p>no</p>'</script>",
            "<div>" + " ".join(f'<a href="/{k}">{say(rng, 3)}</a>' for k in range(5)) + "</div>",
        ]
        rng.shuffle(junk)
        cut = rng.randrange(len(junk) + 1)
        page = f"<html><body><div>{''.join(junk[:cut])}</div>{inner if inner.startswith('<div') else f'<div>{inner}</div>'}<div>{''.join(junk[cut:])}</div></body></html>"
        assert main_text(page) == "\n\n".join(want)


def test_points_against_a_plain_version():
    rng = random.Random(13)
    for _ in range(60):
        def block(depth):
            if depth == 0 or rng.random() < 0.4:
                return f"<p>{say(rng, rng.randrange(1, 40))}" + (f'<a href="/">{say(rng, 4)}</a>' if rng.random() < 0.3 else "") + "</p>"
            return "<div>" + "".join(block(depth - 1) for _ in range(rng.randrange(1, 4))) + "</div>"

        root = pagetext.parse(f"<body>{block(4)}{block(3)}</body>")
        pagetext.best_container(root)
        points = {}

        def plain(node, above):
            own = "".join(pagetext._text(node).split())
            if node.tag == "p" and node.text_length >= 25:
                links = sum(c.text_length for c in node.children if not isinstance(c, str)) / node.text_length
                worth = (1 + pagetext._text(node).count(",") + min(node.text_length // 100, 3)) * (1 - links)
                for up, share in zip(reversed(above), (1, 1 / 2, 1 / 3)):
                    points[id(up)] = points.get(id(up), 0) + worth * share
            assert own or not node.text_length
            for c in node.children:
                if not isinstance(c, str):
                    plain(c, [*above, node])

        plain(root, [])
        for node in pagetext._below(root):
            if node.tag == "div" and any(not isinstance(c, str) for c in node.children):
                assert abs(node.points - points.get(id(node), 0)) < 1e-9
