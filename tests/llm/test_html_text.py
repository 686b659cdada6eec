import random
import time
from collections import defaultdict

import pytest

from loomlog.llm import html_text


def page(i, body, host="a.example.com"):
    html = (
        f'<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p><article>x</article>";</script></head><body>'
        f'<nav><ul><li><a href="/x">Menu {i}</a></li></ul></nav><!-- note <p>no</p> --><div class="ad">Buy {i}</div>{body}'
        f"<footer>&copy; {host}</footer></body></html>"
    )
    return (i, f"https://{host}/p/{i}?q=1", html)


ARTICLE = "<article><h1>Title  &amp; more</h1><p><b>First\n line<br><p>Second &lt;p&gt;&nbsp;x</p><form><p>Sign up</p></form><div id=comments><p>Nice!</p></div><section class='share-bar social'>Share</section><p>Last</article>"


def texts(spark, rows, extra=()):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n_chars int")
    return [r.text for r in html_text.extract_main_text(df).orderBy("page_id", "url").collect()]


def test_article_pages(spark):
    want = "Title & more\nFirst line\nSecond <p> x\nLast"
    assert texts(spark, [page(i, ARTICLE) for i in range(4)]) == [want] * 4


def test_template_without_semantic_elements(spark):
    rows = [page(i, f"<div class=top>Site</div><div class=x><div class=content><p>{'words ' * (30 + i)}</p><p>Tail {i}</p></div></div>") for i in range(5)]
    assert texts(spark, rows) == [f"{'words ' * (30 + i)}".strip() + f"\nTail {i}" for i in range(5)]


def test_page_that_misses_the_template(spark):
    rows = [page(i, ARTICLE) for i in range(4)] + [page(9, "<div><p>Only this</p></div>")]
    assert texts(spark, rows)[-1] == "Only this"


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain <b>text", "plain text"), ("<article><p>open", "open"), ("<p>a</p></div></p>b", "a\nb"), ("<article>1 < 2 & 3</article>", "1 < 2 & 3"), ("<!-- never closed", ""), ("<article>" + "<p>x " * 3000, "\n".join(["x"] * 3000))])
def test_broken_pages(spark, html, text):
    assert texts(spark, [(1, None, html)]) == [text]


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "https://h.example/1", "<article>one</article>")] * 2 + [(3, "no url", None)]
    assert texts(spark, rows) == ["one", "one", ""]
    assert texts(spark, []) == []


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_equal_vectors_share_a_class(spark):
    df = pages_of(spark, [page(i, ARTICLE + ("<div class=extra>e</div>" if i % 2 else "")) for i in range(6)])
    classes = defaultdict(set)
    for r in html_text.templates(df).collect():
        classes[r.class_id].add(r.label)
    assert any({"html", "body", "article", "h1"} <= c for c in classes.values())
    assert {"div.extra", ""} in classes.values()


def test_classes_match_brute_force(spark):
    """Occurrence vectors gathered in plain Python give the same classes."""
    rng = random.Random(5)
    parts = ["<div class=a>same</div>", "<div class=b><p>one</p></div>", "<ul><li>x<li>y</ul>", "<p>tail</p>"]
    rows = [page(i, "".join(p for p in parts if rng.random() < 0.7) + f"<div><p>own {i}</p></div>", f"h{i % 2}.example") for i in range(24)]
    want = set()
    for host in ("h0.example", "h1.example"):
        own = [(i, {tuple(t[j] for j in (0, 5)): t[6] for t in html_text.page_tokens(h)}) for i, u, h in rows if host in u]
        vectors = defaultdict(set)
        for token in {t for _, p in own for t in p}:
            vector = tuple(p.get(token, 0) for _, p in own)
            if 2 * sum(map(bool, vector)) >= len(own) and (token[1] == 0 or sum(map(bool, vector)) >= html_text.MIN_PAGES):
                vectors[vector].add(token)
        want |= {(host, frozenset(c)) for c in vectors.values()}
    got = defaultdict(set)
    for r in html_text.templates(pages_of(spark, rows)).collect():
        got[r.host, r.class_id].add((r.pid, r.text))
    assert {(h, frozenset(c)) for (h, _), c in got.items()} == want


def test_classes_are_nested(spark):
    rows = [page(i, ("<div class=x><section><p>same text</p></section></div>" if i % 3 else "") + f"<div class=y><p>own {i}</p></div>") for i in range(9)]
    tokens = html_text.templates(pages_of(spark, rows)).collect()
    _, fixed, above = html_text.nested([tuple(t[1:2]) + tuple(t[3:]) for t in tokens])
    by_label = {t.label: t.class_id for t in tokens if t.label}
    assert above[by_label["html"]] is None and above[by_label["div.x"]] == by_label["body"]
    assert by_label["section"] == by_label["div.x"] and len(fixed) == 1


def test_fixed_text_goes_and_prose_stays(spark):
    body = lambda i: f"<div><div>Win ten percent off this week only</div><div><p>{'words ' * (30 + i)}</p><div class=notice>Prose {i}</div></div></div>"
    want = [f"{'words ' * (30 + i)}".strip() for i in range(6)]
    assert [t.split("\n")[0] for t in texts(spark, [page(i, body(i)) for i in range(6)])] == want
    inside = "<article><p>Text {0}</p><div class=notice>Prose {0}</div><section id=related-work>More {0}</section><div>Win ten percent</div><div class='x comments'>Nice {0}</div></article>"
    assert texts(spark, [page(i, inside.format(i)) for i in range(6)]) == [f"Text {i}\nProse {i}\nMore {i}" for i in range(6)]


@pytest.mark.parametrize("on,goes", [(10, True), (9, True), (7, True), (4, False)])
def test_text_of_many_pages_goes_though_not_of_all(spark, on, goes):
    """A promotion among the paragraphs of some of ten pages; the same paragraph on a few pages is prose."""
    promo = "Win ten percent off this week only"
    own = [f"{'words ' * (40 + i)}of {i}" for i in range(10)]
    rows = [page(i, f"<article><p>{own[i]}</p>" + f"<p>{promo}</p>" * (i < on) + f"<p>End {i}</p></article>") for i in range(10)]
    assert texts(spark, rows) == [f"{own[i]}\n" + f"{promo}\n" * (i < on and not goes) + f"End {i}" for i in range(10)]


def test_versions_of_one_article_stay(spark):
    """Eight of ten pages share most of their text: nothing of it varies, so it is no template."""
    shared = "The same long article. " * 20
    rows = [page(i, f"<article><p>{shared if i < 8 else 'Another one. ' * 9}</p><p>Edited {i}</p></article>") for i in range(10)]
    assert texts(spark, rows) == [f"{(shared if i < 8 else 'Another one. ' * 9).strip()}\nEdited {i}" for i in range(10)]


def test_copies_of_a_page_are_no_template(spark):
    rows = [page(1, "<article><p>Copied</p></article>")] * 8 + [page(i, f"<article><p>Own {i}</p></article>") for i in range(2, 7)]
    rows = [(i, u, h) for i, (_, u, h) in enumerate(rows)]
    assert texts(spark, rows) == ["Copied"] * 8 + [f"Own {i}" for i in range(2, 7)]


def test_equal_slots_take_the_first(spark):
    rows = [page(i, f"<main><p>aa{i}</p></main><main class=two><p>bb{i}</p></main>") for i in range(4)]
    assert texts(spark, rows) == [f"aa{i}" for i in range(4)]


@pytest.mark.parametrize("html,text", [("<a " * 350_000, ""), ("<div>" * 100_000 + "x", "x"), ("<div>" * 50_000 + "</b></p></nav>" * 50_000 + "y", "y"), ('<a ="' * 100_000, ""), ("<!--" * 200_000, ""), ("<p>z</p><div " + "a='\" " * 100_000, "z"), ("<article>" + "<p>x</p>" * 20_000, "\n".join(["x"] * 20_000))])
def test_large_broken_pages_take_linear_time(html, text):
    began = time.perf_counter()
    assert html_text.extract(html, html_text._own_slot(html)) == text
    assert time.perf_counter() - began < 20


def test_bytes_that_are_no_utf8(spark):
    df = spark.range(1).selectExpr("id page_id", "'https://h.example/' url", "cast(unhex('3c703e61ff3c2f703e') as string) html")
    assert html_text.extract_main_text(df).first().text == "a\ufffd"


PROSE = "social-history cookies-recipe share-price comment-on-law sponsored-bill menu-of-the-day related-work ad-hoc".split()


def test_names_that_only_contain_a_hint_keep_their_prose():
    for name in PROSE:
        page = f'<body><article><p>First.</p><section class="{name}"><p>Real prose.</p></section></article></body>'
        assert html_text.extract(page, html_text._own_slot(page)) == "First.\nReal prose.", name
        bare = f'<body><div><p>First words of it.</p><div class="{name}"><p>Real prose.</p></div></div></body>'
        assert "Real prose." in html_text.extract(bare, html_text._own_slot(bare)), name
    for name in ("comments", "comment-list", "ad-slot", "share-buttons", "cookie-notice"):
        page = f'<body><article><p>First.</p><div class="{name}"><p>Not of it.</p></div></article></body>'
        assert html_text.extract(page, html_text._own_slot(page)) == "First.", name


def test_end_tags_that_do_not_end_take_linear_time():
    began = time.perf_counter()
    n = 300_000
    assert html_text.extract("<p>a</p>" + "<script>" * n + "</script" * n, None) == "a"
    assert html_text.extract("<p>a</p><script>x</script\n><p>b</p>", None) == "a\nb"
    assert time.perf_counter() - began < 5
