"""Main text of web pages by the maximum-scoring run of words and tags.

A page is read once, from left to right, into runs of words and tags.  Words
score positive, tags negative; a run of words scores according to where it
stands (:func:`_kind`) and a tag according to its name.  The weights are
log-odds counted on labelled pages: pages of the table that mark their
content themselves with exactly one <article> or <main> element.  Names of
classes and ids whose words stand outside the content on these pages are
learned as boilerplate too.  A linear scan finds the contiguous region with
the largest sum, and the blocks of that region are the main text: a block of
which the region holds a word is taken whole, everything before the first
and after the last one is left out.

Kinds of words:
- ``plain``: positive.  Headings that are links count as plain.
- ``link``: negative, so link lists at the ends of the region fall off.
- ``boiler``: negative; words of elements that never hold content (navigation, asides, page headers and footers ...),
  of forms and of elements whose class, id or role names a menu, sidebar, notice, advert or comment section.  Words
  of one such element count at most ``BOUND`` times, so that a long one between two paragraphs does not part them;
  they are no text, whichever block they stand in.
- ``control``: negative; labels and buttons.  A block of nothing else is left out, in a sentence they stay.
- ``beside``: negative; words outside <article> and <main> on a page whose content these hold.

Inside <article> or <main> on such a page, links, controls and boilerplate score nothing: the page itself says that
they do not end the content.  If a page holds nothing but links there, those are its words.

A form or a name is no mark for an element that holds the page's content
("content-sidebar-wrap" around the article): it costs the element's start tag
a score (``named``) and is not inherited.  :func:`_settle` tells which
elements those are.  Names that only mark in some compounds ("related-posts",
not "related-work") count if nothing but a word for a part of a page follows.

Defined results: null or empty html, and pages without a run that scores
above zero, give the empty string; rows with null or repeated page_id are
extracted like any other; markup that never closes (an open comment, script
or tag) reaches to the end of the page, a quote left open to the end of its
tag; a less-than sign before anything but a name is text; other columns are
ignored.
"""

from __future__ import annotations

import html as _html
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.llm.common import distinct_sample

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_NAMING = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_WORDS = re.compile(r"[a-z]+")

#: Fixed lists of HTML element names.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head nav aside dialog menu fieldset".split()) | RAW
CONTROLS = frozenset("button label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PAGE_PARTS = frozenset("header footer".split())
CONTENT = frozenset("article main".split())
CONTAINERS = frozenset("html body div section article main td th table center".split())
BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul").split())
#: Words in a class, id or role that mark boilerplate; those that mark reader comments even on an <article>.
TALK = frozenset("comment comments commentlist disqus reply replies respond".split())
QUALIFIERS = frozenset("has no with without is".split())
MARKS = TALK | frozenset((
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary consent "
    "contentinfo cookie cookies footer masthead menu menubar modal nav navbar navigation newsletter "
    "pagination popup promo sidebar sidebars signup sponsored subscribe toolbar topbar widget").split())
#: Words that mark boilerplate at the end of a name or before words for parts of a page only.
ENDINGS = frozenset((
    "alert dialog login notice notices notification promotion related search share sharing skip social sponsor").split())
PARTS = frozenset((
    "area articles bar block bottom box button buttons container content form icons inner items left link links list "
    "module outer panel posts right section stories to top wrap wrapper").split())
#: What a start tag closes of the same kind.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",)}

DEFAULT_WEIGHTS = {"plain": 1.0, "link": -1.0, "boiler": -2.0, "control": -1.0, "beside": -1.0, "named": -2.0, "tag": -0.2}
#: Words of one boilerplate element that count at most.
BOUND = 10


class _Element:
    __slots__ = ("name", "parent", "boiler", "link", "depth", "content", "mark", "over", "talk", "heading", "prose", "control",
                 "attributes", "top")

    def __init__(self, name, parent, boiler, link, content, mark=""):
        self.name, self.parent, self.boiler, self.link, self.content = name, parent, boiler, link, content
        self.depth = 0 if parent is None else parent.depth + 1
        self.mark = mark  # "", "name" or "talk": marked by its own name
        self.over = self if mark else None if parent is None else parent.over  # innermost marked element around a word
        self.talk = mark == "talk" or parent is not None and parent.talk
        self.heading = name in HEADINGS or parent is not None and parent.heading
        self.prose = name == "p" or parent is not None and parent.prose and name not in BLOCKS
        self.control = name in CONTROLS or parent is not None and parent.control
        self.attributes = ""
        self.top = None  # the outermost boilerplate element around a word


def _never_content(name: str, in_content: bool) -> bool:
    return name in NEVER or name == "footer" or name in PAGE_PARTS and not in_content


def _names(attributes: str) -> Iterator[list[str]]:
    """The words of each value of the class, id and role attributes."""
    for m in _NAMING.finditer(attributes):
        for value in (m.group(1) or m.group(2) or m.group(3) or "").lower().split():
            yield _NAME_WORDS.findall(value)


def _ends(words: list[str]) -> bool:
    """Whether one of ``ENDINGS`` is followed by nothing but ``PARTS``."""
    for w in reversed(words):
        if w not in PARTS:
            return w in ENDINGS
    return False


def _mark(name: str, attributes: str, learned: frozenset = frozenset()) -> str:
    """"talk" or "name" if the class, id or role (or a form) marks boilerplate, else ""."""
    found = "name" if name == "form" else ""
    if not attributes or name in ("html", "body"):
        return found
    marks, any_name = (TALK, False) if name in CONTENT else (MARKS, True)
    for words in _names(attributes):
        # "has-sidebar" or "no-comments" tell what the page has, not what the element is
        if not words or words[0] in QUALIFIERS:
            continue
        if not TALK.isdisjoint(words):
            return "talk"
        if not marks.isdisjoint(words) or any_name and (_ends(words) or "-".join(words) in learned):
            found = "name"
    return found


def _settle(events: list[tuple], elements: list[_Element]) -> None:
    """Set ``boiler`` below the marked elements that do not hold the page's content.

    The page's content are the words in <article> and <main>, or, where these have less than a tenth of the words
    outside links, all words outside links.  From the outside in, a marked element holds it
    - around <article> or <main>: if it has no fewer of these words than stand clear of every mark, and at least a
      quarter of those of any other marked element of its level (teasers below an article have not);
    - around neither, and on pages without them: if it has more than half.
    Reader comments never do, unless next to nothing stands outside them.
    """
    marked = [e for e in elements if e.mark and not e.boiler]
    if not marked:
        return
    texts = [(e[2], len(e[1].split())) for e in events if e[0] == "text" and not e[2].boiler]
    main = [(e, n) for e, n in texts if e.content]
    plain = [(e, n) for e, n in texts if not e.link]

    def total(words: list) -> int:
        return sum(n for _, n in words)

    def clear(words: list) -> list:
        return [(e, n) for e, n in words if not e.talk]

    talk = (total(clear(main)) * 10 < total(main) and total(clear(plain)) * 2 < total(plain)
            or total(clear(plain)) * 10 < total(plain))
    if not talk:
        main, plain = clear(main), clear(plain)
    by_content = total(main) > 0 and total(main) * 10 >= total(plain)
    words = main if by_content else plain
    every = total(words)
    own: Counter = Counter()
    for e, n in words:
        own[e.over] += n
    held: Counter = Counter(own)
    levels: dict = {}
    level: dict = {None: -1}
    for e in marked:  # an element comes after those around it
        level[e] = level[e.parent.over] + 1
        levels.setdefault(level[e], []).append(e)
    holders = {e.parent.over for e in elements if e.name in CONTENT and not e.boiler and (talk or not e.talk)}
    for e in reversed(marked):
        held[e.parent.over] += held[e]
        if e in holders:
            holders.add(e.parent.over)
    free, kept = own[None], {None}
    for k in sorted(levels):
        here = [e for e in levels[k] if e.parent.over in kept and held[e] and (talk or e.mark != "talk")]
        most = max((held[e] for e in here), default=0)
        for e in here:
            around = by_content and e in holders
            if held[e] >= free and held[e] * 4 >= most if around else held[e] * 2 > every:
                kept.add(e)
        free += sum(own[e] for e in here if e in kept)
    for e in elements:
        if e.over not in kept:
            e.boiler = True


def scan(page: str, learned: frozenset = frozenset()) -> list[tuple]:
    """Events of a page in order: ("tag", name, element) and ("text", raw text, element, block number).

    The start tag of a marked element that holds the page's content is ("named", name, element)."""
    events: list[tuple] = []
    elements: list[_Element] = []
    here = _Element("", None, False, False, False)
    opened: list[tuple] = []  # (event, element) of the start tags of marked elements
    block, at, size = 0, 0, len(page)
    find = page.find
    while at < size:
        lt = find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            events.append(("text", page[at:lt], here, block))
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if m is None:
            following = page[lt + 1:lt + 2]
            if following in ("!", "?", "/") or following.isalpha() and following.isascii():
                end = find(">", lt)
                at = size if end < 0 else end + 1
            else:  # a plain less-than sign
                events.append(("text", "<", here, block))
                at = lt + 1
            continue
        at = m.end()
        closing = m.group(1) or m.group(4)
        name = (m.group(2) or m.group(5)).lower()
        attributes = m.group(3) or m.group(6) or ""
        events.append(("tag", name, here))
        if name in BLOCKS:
            block += 1
        elif name == "br":
            events.append(("text", " ", here, block))
        if closing:
            up = here
            while up is not None and up.name != name:
                if up.name in CONTAINERS and name not in CONTAINERS and up.depth < here.depth and name not in BLOCKS:
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if name in VOID:
            continue
        if name in RAW:
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = size if end is None else end.end()
            continue
        if name in BLOCKS:  # an open paragraph ends here
            up = here
            while up is not None and up.name not in CONTAINERS and up.name != "p":
                up = up.parent
            if up is not None and up.name == "p":
                here = up.parent
        for other in _CLOSES.get(name, ()):
            up = here
            while up is not None and up.name not in ("ul", "ol", "dl", "table", "select", "") and up.name != other:
                up = up.parent
            if up is not None and up.name == other:
                here = up.parent
        mark = _mark(name, attributes, learned)
        here = _Element(name, here, here.boiler or _never_content(name, here.content), here.link or name == "a",
                        here.content or name in CONTENT, mark)
        here.attributes = attributes
        elements.append(here)
        if mark:
            opened.append((len(events) - 1, here))
    _settle(events, elements)
    for e in elements:  # an element comes after those around it
        if e.boiler:
            e.top = e.parent.top or e
    for i, e in opened:
        if not e.boiler:
            events[i] = ("named", e.name, events[i][2])
    return events


def declares(events: list[tuple]) -> bool:
    """Whether <article> and <main> hold the page's content: a tenth or more of its words outside links and boilerplate."""
    inside = plain = 0
    for e in events:
        if e[0] == "text" and not e[2].boiler:
            n = len(e[1].split())
            inside += n if e[2].content else 0
            plain += 0 if e[2].link else n
    return inside > 0 and inside * 10 >= plain


def _kind(event: tuple, declared: bool = False) -> str:
    if event[0] != "text":
        return "tag:" + event[1] if event[0] == "tag" else "named"
    e = event[2]
    if e.boiler:
        return "boiler"
    if declared and not e.content:
        return "beside"
    if e.control:
        return "control"
    return "link" if e.link and not e.heading and not (declared and e.prose) else "plain"


def _amount(event: tuple) -> int:
    return len(event[1].split()) if event[0] == "text" else 1


def best_region(events: list[tuple], weights: dict, declared: bool = False) -> tuple[int, int]:
    """(first, last + 1) of the events whose scores sum highest, the longest of these; (0, 0) if none scores above zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    tag = weights["tag"]
    counted: Counter = Counter()
    for i, e in enumerate(events):
        kind, amount = _kind(e, declared), _amount(e)
        if kind in ("boiler", "link", "control"):
            if declared and e[2].content:
                continue
            if kind == "boiler":
                amount = min(amount, BOUND - counted[e[2].top])
                counted[e[2].top] += amount
        total += weights.get(kind, tag) * amount
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best or total == best and amount and e[0] == "text":
            best, span = total, (start, i + 1)
    return span


def learned_names(weights: dict) -> frozenset:
    return frozenset(k[5:] for k in weights if k.startswith("name:"))


def main_text(page, weights: dict = DEFAULT_WEIGHTS) -> str:
    if not page:
        return ""
    events = scan(page, learned_names(weights))
    declared = declares(events)
    first, last = best_region(events, weights, declared)
    if first == last and declared:  # links only
        for e in events:
            e[2].link = False
        first, last = best_region(events, weights, declared)
    touched = [e[3] for e in events[first:last] if e[0] == "text" and not e[1].isspace() and not e[2].boiler]
    if not touched:
        return ""
    blocks: dict = {}
    prose = set()
    for e in events:
        if e[0] != "text" or not touched[0] <= e[3] <= touched[-1]:
            continue
        kind = _kind(e, declared)
        if kind in ("boiler", "beside"):
            continue
        blocks.setdefault(e[3], []).append(e[1])
        if kind != "control" and not e[1].isspace():
            prose.add(e[3])
    lines = (" ".join(_html.unescape("".join(parts)).split()) for b, parts in blocks.items() if b in prose)
    return "\n".join(x for x in lines if x)


def label_counts(page: str) -> Counter:
    """Counts of (kind, inside the marked content?) of a page that marks its content with one element.

    Kinds are those of :func:`_kind` and, for words, ``name:`` and each class or id around them."""
    events = scan(page or "")
    tops = {id(e[2]) for e in events if e[2].name in CONTENT and not (e[2].parent and e[2].parent.content)}
    out: Counter = Counter()
    if len(tops) == 1:
        named: dict = {}
        for e in events:
            n = _amount(e)
            if n:
                inside = e[2].content and not e[2].boiler
                out[_kind(e), inside] += n
                if e[0] == "text":
                    for name in _around(e[2], named):
                        out["name:" + name, e[2].content] += n
    return out


def _around(e: _Element, known: dict) -> frozenset:
    """Names of the element and of those around it."""
    chain = []
    while e is not None and id(e) not in known:
        chain.append(e)
        e = e.parent
    names = known[id(e)] if e is not None else frozenset()
    for e in reversed(chain):
        own = frozenset("-".join(w) for w in _names(e.attributes) if w)
        names = known[id(e)] = names | own if own else names
    return names


#: Words that a name must have outside the content, for each of them at most a fiftieth inside, to be learned; names kept.
NAME_WORDS, NAMES = 200, 1000


def weights_from(counts: Counter) -> dict:
    """Log-odds of each kind inside against outside the content; plain words stay positive, the rest negative."""
    kinds = {k: v for k, v in counts.items() if not k[0].startswith("name:")}
    inside = sum(v for (_, ok), v in kinds.items() if ok)
    outside = sum(v for (_, ok), v in kinds.items() if not ok)
    if not inside or not outside:
        return dict(DEFAULT_WEIGHTS)

    def odds(kind: str) -> float:
        return math.log((counts[kind, True] + 1) / (inside + 2)) - math.log((counts[kind, False] + 1) / (outside + 2))

    out = dict(DEFAULT_WEIGHTS)
    for kind in {k for k, _ in kinds}:
        low, high = (1.0, 4.0) if kind == "plain" else (-1.0, -0.05) if kind.startswith("tag:") else (-4.0, -0.5)
        out[kind] = min(max(odds(kind), low), high)
    out["beside"] = -out["plain"]
    names = {k for k, _ in counts if k.startswith("name:") and counts[k, False] >= NAME_WORDS
             and counts[k, True] * 50 <= counts[k, False]}
    for name in sorted(names, key=lambda k: (-counts[k, False], k))[:NAMES]:
        out[name] = out["boiler"]
    return out


def _bounded(counts: Counter, names: int = 50 * NAMES) -> Counter:
    """``counts`` with the ``names`` most frequent names only."""
    own = [k for k in counts if k[0].startswith("name:")]
    if len(own) > names:
        for k in sorted(own, key=lambda k: (-counts[k], k))[names:]:
            del counts[k]
    return counts


def learn_weights(pages: DataFrame, sample_rows: int = 500) -> dict:
    """Weights from ``sample_rows`` different labelled pages, counted in parallel; a short dictionary comes back."""
    rows = pages.where(F.lower("html").rlike("<(article|main)[\\s>]")).select("html")
    chosen = distinct_sample(rows, pages, sample_rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for page in b["html"]:
                total.update(label_counts(page))
            total = _bounded(total)
        yield pd.DataFrame([(json.dumps(sorted([k, bool(ok), int(v)] for (k, ok), v in total.items())),)], columns=["c"])

    total: Counter = Counter()
    for row in chosen.mapInPandas(count, "c string").collect():  # one short row a task of a bounded sample
        for k, ok, v in json.loads(row.c):
            total[k, ok] += v
    return weights_from(total)


def extract(pages: DataFrame, sample_rows: int = 500) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = learn_weights(pages, sample_rows)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(h, weights) if isinstance(h, str) else "" for h in s], dtype=object)

    out = pages.select("page_id", "url", text_of("html").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
