"""op6 and op9: extraction on hand-made pages, WARC round trips, edge cases."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from inkmeter.llm import extract as X, warc as W
from inkmeter.llm.common import read_file
from inkmeter.session import scratch_path

PAGES = "page_id long, url string, html string"

ARTICLE = """<!DOCTYPE html><html><head><title>Site title words here</title><style>p{}</style><script>var a="</p>";</script></head>
<body><header><h1>The Site</h1><a href="/">home</a></header><nav><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this page to make it better for everyone</div><!-- <p>not text</p> -->
<%s><h1>Caf&eacute;  &amp; t&#233;a</h1><p>First   para\n graph with <b>bold</b>, <a href="x">a link</a> &lt;tag&gt; 1 < 2.<br>Next line.
<p>Second paragraph of some length goes here.<ul><li>item one<li>item two</ul><div class="ad">Buy this now, great offer today</div>
<form><input name=q><button>Search</button></form><section id="comments"><p>Reader: I liked it a lot, thanks for this</p></section>
</%s><aside>Related reading that is not the article at all</aside><footer>&copy; 2024 All rights reserved by the site</footer></body></html>"""
TEXT = ("Café & téa\nFirst para graph with bold, a link <tag> 1 < 2. Next line.\nSecond paragraph of some length goes here.\n"
        "item one\nitem two")


@pytest.mark.parametrize("tag", ["article", "main", 'div id="content"', 'div class="post-body"'])
def test_article_without_boilerplate(tag):
    page = ARTICLE % (tag, tag.split()[0])
    assert X.main_text(page) == TEXT


@pytest.mark.parametrize("page", [None, "", "   ", "<p", "<!--", "<script>alert(1)", "<html><body></body></html>",
                                  "<nav>menu words only here</nav>", "</p></div>", "<title>only"])
def test_pages_without_text(page):
    assert X.main_text(page) == ""


def test_broken_and_large_pages():
    assert X.main_text("just words, no markup & so on") == "just words, no markup & so on"
    assert X.main_text("<p>open <b>never <i>closed") == "open never closed"
    assert X.main_text("<") == "<" and X.main_text("<p title='a>b") == "b"  # a plain sign; a quote left open ends with its tag
    big = "<article>" + "<p>word word</p>" * 30_000 + "</article>"
    assert X.main_text(big) == "\n".join(["word word"] * 30_000)
    deep = "<div>" * 3_000 + "<p>deep words</p>" + "</div>" * 3_000
    assert X.main_text(deep) == "deep words"
    assert X.main_text("<p>" + "&amp;lt; " * 3) == "&lt; &lt; &lt;"


def test_names_of_classes():
    page = '<div class="wrap has-sidebar no-comments"><p>The text of the page is here.</p>%s</div>'
    assert X.main_text(page % '<p class="site-notice">A notice</p>') == "The text of the page is here."
    assert X.main_text(page % '<article class="comment"><p>A reader says</p></article>') == "The text of the page is here."
    assert X.main_text(page % '<div role="complementary">Aside words</div>') == "The text of the page is here."


BODY = "The first paragraph of the article has these words.\nThe second one has a few more of them."
PARTS = "<p>%s</p><p>%s</p>" % tuple(BODY.split("\n"))


@pytest.mark.parametrize("wrapper", ['div class="content-sidebar-wrap"', 'div class="layout sidebar-left"', 'div class="page nav-open"',
                                     'div id="page-with-footer"', 'section class="single comments-open"', 'form id=aspnet method=post'])
@pytest.mark.parametrize("inner", ["article", "main", "div", 'div class="widget-area"'])
def test_wrappers_with_names_of_boilerplate(wrapper, inner):
    """A name or a form is no veto for what holds the page's content; inside it boilerplate stays boilerplate."""
    page = (f"<html><body><nav>Menu words</nav><{wrapper}><{inner}>{PARTS}<div class='share'>Share this</div></{inner.split()[0]}>"
            f"<div class='sidebar'><p>Side words</p></div><form><p>Search</p></form><div id='comments'><p>I liked it</p></div>"
            f"</{wrapper.split()[0]}><footer>Foot</footer></body></html>")
    assert X.main_text(page) == BODY


def test_names_stay_a_veto_beside_the_content():
    long = "<p>" + "many other words " * 40 + "</p>"
    for other in (f"<div id='comments'><article>{long}</article></div>", f"<div class='modal'>{PARTS}{PARTS}</div>",
                  f"<section class='replies'>{long}</section>", "<div class='related'><article>A teaser</article></div>"):
        for tag in ("article", "main"):
            assert X.main_text(f"<body><div class='nav-open'><{tag}>{PARTS}</{tag}></div>{other}</body>") == BODY
            assert X.main_text(f"<body><div><{tag}>{PARTS}</{tag}>{other}</div></body>") == BODY
    assert X.main_text(f"<main><article>{PARTS}</article><div class='related'><article>A teaser</article></div></main>") == BODY


MENU = "<ul>" + "".join(f"<li><a href=/{i}>Menu{i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize("page", [
    f"<body>{MENU}{PARTS}</body>",
    f"<body><div class='top-links'>{MENU}</div>{PARTS}</body>",
    f"<body><main>{PARTS}<div class='more'><a href=/a>One more story</a> <a href=/b>And another story</a></div></main></body>",
    f"<body><article>{PARTS}</article><div>Copyright 2024 All rights reserved</div></body>",
    f"<body>{MENU}<div>{PARTS}</div>{MENU}</body>",
])
def test_what_is_outside_the_region_is_left_out(page, monkeypatch):
    """Menus and notices without a telling name fall off because of the region, and come back with the whole page as region."""
    assert X.main_text(page) == BODY
    monkeypatch.setattr(X, "best_region", lambda events, *a: (0, len(events)))
    if "<main>" not in page and "Copyright" not in page:
        assert X.main_text(page) != BODY


def test_names_and_controls_inside_the_article():
    for name in ("share-price-table", "related-work", "search-theory"):
        extra = f"<div class='{name}'><p>These words belong to it.</p></div>"
        assert X.main_text(f"<article>{PARTS}{extra}</article>") == BODY + "\nThese words belong to it."
    for name in ("share", "share-buttons", "related-posts", "site-search", "search-form", "skip-to-content", "cookie-notice"):
        assert X.main_text(f"<article>{PARTS}<div class='{name}'><p>These words do not.</p></div></article>") == BODY
    assert X.main_text("<article><p>Use the <label>red key</label> to sign, press <button>Enter</button> now</p></article>") == \
        "Use the red key to sign, press Enter now"
    assert X.main_text(f"<article>{PARTS}<button>Send</button><label>Name</label></article>") == BODY


def test_boilerplate_between_paragraphs_does_not_end_the_text():
    long = "<div class='ad'>" + "buy this now " * 20 + "</div>"  # under half of the words: no wrapper of the content
    body = "\n".join([BODY] * 4)
    for end, page in (("End.", "<article>%s%s<p>End.</p></article>"), ("the end " * 20, "<div>%s%s<p>" + "the end " * 20 + "</p></div>")):
        assert X.main_text(page % (PARTS * 4, long)) == body + "\n" + end.strip()
    linked = f"<article>{PARTS}{MENU}<p><a href=x>Only a link</a></p><h2><a href=y>Part</a></h2>{PARTS}</article>"
    assert X.main_text(linked).split("\n")[-4:] == ["Only a link", "Part", *BODY.split("\n")]
    assert X.main_text("<article><ul><li><a>First story</a></li><li><a>Second story</a></li></ul></article>") == "First story\nSecond story"


def slow_region(events, weights, declared):
    """All runs, each summed on its own."""
    used, score = {}, []
    for e in events:
        kind = X._kind(e, declared)
        n = len(e[1].split()) if e[0] == "text" else 1
        if kind in ("boiler", "link", "control") and declared and e[2].content:
            n = 0
        elif kind == "boiler":
            room = X.BOUND - used.get(id(e[2].top), 0)
            n = min(n, room)
            used[id(e[2].top)] = used.get(id(e[2].top), 0) + n
        score.append(weights.get(kind, weights["tag"]) * n)
    return max([0.0] + [sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)]), score


def test_region_of_pages_against_all_runs():
    rng = random.Random(4)
    parts = [PARTS, MENU, "<div class='ad'>Buy it</div>", "<p><a href=x>Read on</a></p>", "<button>Go</button>", "<footer>Foot</footer>",
             "<article><p>Short.</p></article>", "<h2>Part</h2>", "<aside>" + "side " * 30 + "</aside>"]
    for _ in range(40):
        events = X.scan("<body>" + "".join(rng.choice(parts) for _ in range(5)) + "</body>")
        declared = X.declares(events)
        i, j = X.best_region(events, X.DEFAULT_WEIGHTS, declared)
        best, score = slow_region(events, X.DEFAULT_WEIGHTS, declared)
        assert sum(score[i:j]) == pytest.approx(best)


def test_names_are_learned_from_labelled_pages(spark):
    side = "<div class='kiosk'>" + "buy our paper today and tomorrow " * 3 + "</div>"
    rows = [(i, "u", f"<body><article>{PARTS} Page {i}</article>{side}</body>") for i in range(30)]
    w = X.learn_weights(spark.createDataFrame(rows, PAGES))
    assert "name:kiosk" in w
    page = f"<body>{PARTS}{side}</body>"
    assert X.main_text(page, w) == BODY and X.main_text(page) != BODY


def test_marks_many_and_deep():
    deep = "<div class='nav-open'>" * 3_000 + PARTS + "</div>" * 3_000
    assert X.main_text(deep) == BODY
    widgets = "".join(f"<div class='widget'><article><p>Story number {i} of the day</p></article></div>" for i in range(50))
    assert X.main_text(f"<main>{widgets}</main>") == "\n".join(f"Story number {i} of the day" for i in range(50))


def test_region_is_the_best_scoring_run():
    rng = random.Random(1)
    kinds = {"plain": 1.0, "tag": -2.5}
    for _ in range(50):
        e = X._Element("p", None, False, False, False)
        events = [("tag", "p", e) if rng.random() < 0.5 else ("text", "w " * rng.randint(0, 4), e, 0) for _ in range(30)]
        score = [kinds["tag"] if x[0] == "tag" else len(x[1].split()) * 1.0 for x in events]
        best = max([0.0] + [sum(score[i:j]) for i in range(30) for j in range(i + 1, 31)])
        i, j = X.best_region(events, kinds)
        assert sum(score[i:j]) == best


def test_weights_have_the_signs_of_the_method(spark):
    rows = [(i, "u", ARTICLE % ("article", "article")) for i in range(30)]
    w = X.learn_weights(spark.createDataFrame(rows, PAGES))
    assert w["plain"] > 0 and all(v < 0 for k, v in w.items() if k != "plain")
    assert X.learn_weights(spark.createDataFrame([], PAGES)) == X.DEFAULT_WEIGHTS


def test_extract_table(spark):
    rows = [(1, "u", ARTICLE % ("article", "article")), (1, "u", None), (None, None, "<p>x y</p>"), (2, "v", "")]
    d = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in X.extract(d).collect())
    assert got == sorted([("1", TEXT, len(TEXT)), ("1", "", 0), ("None", "x y", 3), ("2", "", 0)])
    assert X.extract(spark.createDataFrame([], PAGES)).count() == 0


# --- op9 ------------------------------------------------------------------------------------------------------------

def expected(rows):
    rows = [(k, (h or "").encode()) for k, _, h in rows]
    keeper = {}
    for k, p in rows:
        if len(p) >= 1000 and k is not None:
            keeper[p] = max(keeper.get(p, k), k)
    done, out = set(), []
    for k, p in rows:
        top = keeper.get(p)
        several = sum(q == p for _, q in rows) > 1
        first = top is None or not several or (k == top and p not in done)
        if k == top:
            done.add(p)
        out.append((k, len(p), hashlib.sha1(p).hexdigest(), "response" if first else "revisit", None if first else top))
    return sorted(map(str, out))


def sample():
    rng = random.Random(2)
    bodies = ["<p>" + "é" * 600, "a" * 999, "b" * 1000, "c" * 70_000, "", "\r\n\r\nWARC/1.1\r\n" * 80]
    rows = [(i, f"http://x/{i}", rng.choice(bodies)) for i in range(60)]
    rows += [(60, "http://a b\r\nX: y", "d" * 2000), (60, "u", "d" * 2000), (60, "u", "d" * 2000), (61, None, None),
             (None, "n", "b" * 1000), (None, "n", "e" * 1500), (None, "n", "e" * 1500), (-5, "u", "d" * 2000)]
    return rows


def read_back(df):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


@pytest.mark.parametrize("roll", [1, 1 << 26])
def test_round_trip(spark, roll):
    rows = sample()
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("key", F.lit(0))
    folder = scratch_path(spark, "test-warc")
    manifest = W.write_archives(pages, folder, roll_bytes=roll)
    assert read_back(W.read_archives(manifest, folder)) == expected(rows)
    if roll == 1:
        assert manifest.count() >= len(rows)


def test_files_are_deterministic_and_readable(spark):
    rows = sample()
    sums = []
    for order in (rows, rows[::-1]):
        folder = scratch_path(spark, "test-warc")
        m = W.write_archives(spark.createDataFrame(order, PAGES).repartition(3), folder)
        sums.append(sorted((r.file, r.sha256) for r in m.collect()))
    assert sums[0] == sums[1]
    data = gzip.decompress(read_file(folder, sums[0][0][0]))  # members of an ordinary gzip file
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert b"X: y" not in [line.strip() for line in data.split(b"\r\n")]


def test_damaged_files_are_refused(spark):
    folder = scratch_path(spark, "test-warc")
    m = W.write_archives(spark.createDataFrame(sample()[:5], PAGES), folder).withColumn("sha256", F.lit("0"))
    with pytest.raises(Exception, match="not the file of the manifest"):
        W.read_archives(m, folder).collect()
    with pytest.raises(ValueError):
        list(W.members(W.response_or_revisit(1, "u", b"x" * 50, hashlib.sha1(b"x" * 50).hexdigest(), None)[:-3]))


def test_empty_table(spark):
    assert W.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_reading_many_small_records_is_linear():
    """What is behind a record is not copied for each of them."""
    import time

    one = W.response_or_revisit(1, "u", b"small payload", hashlib.sha1(b"small payload").hexdigest(), None)
    took = []
    for n in (2_000, 16_000):
        data = one * n
        start = time.perf_counter()
        assert sum(1 for _ in W.members(data)) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] * 3
