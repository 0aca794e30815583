"""Main text of web pages: a maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score positive, by the innermost
block and whether they are in a link; tags score negative, by name. The contiguous
region with the largest sum, found in one scan, is the article; its blocks, without
the elements that are never article text, are the result.

The weights come from labelled pages: those with exactly one ``article`` element, whose
words are in and all others out. The tag itself has no weight, so pages without it are
read alike. A weight is the log odds of in and out, cut to the sign of its kind; elements that are
never article text are left out before, here and when pages are read.
"""

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockyard.llm.common import ship_package, text_slices

FIT_PAGES = 1000
FIT_CHARS = 20_000_000
LEAST, MOST = 0.05, 5.0
UNSEEN_WORD, UNSEEN_LINK_WORD, UNSEEN_TAG, UNSEEN_INLINE_TAG = 1.0, 0.1, -1.0, -0.1

# Names of HTML elements by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q "
             "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = set("head script style noscript template title nav header footer aside form button select option "
            "textarea input iframe svg canvas object audio video menu dialog map".split())
WHOLE = set("html body main article".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Words in class, id or role that mark an element as no article text.
MARKS = set("ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo "
            "promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
            "newsletter subscribe subscription signup login sidebar aside widget widgets related recommended "
            "share sharing social comment comments reply replies disqus discussion breadcrumb breadcrumbs menu "
            "nav navbar navigation topbar footer header masthead toolbar pagination pager search hidden "
            "complementary contentinfo dialog".split())

REPLIES = set("comment comments reply replies disqus discussion".split())
NOT_ITSELF = set("has have no not with without".split())  # "has-sidebar" is no sidebar

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NONE_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _dropped(tag, attributes, whole):
    """2 if an element is never article text, 1 if its marks say so unless it holds most
    of the page's words, else 0. Attributes of ``whole`` elements don't count."""
    if tag in NEVER:
        return 2
    if whole or not attributes:
        return 0
    marked = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden":
            return 2
        if name == "style":
            if NONE_SHOWN.search(value):
                return 2
            continue
        for one in re.sub(r"([a-z])([A-Z])", r"\1-\2", value.strip("\"'")).lower().split():
            parts = [x for x in re.split(r"[^a-z0-9]+", one) if x]
            if parts and REPLIES.issuperset(parts):
                return 2
            if any(x in MARKS and not (k and parts[k - 1] in NOT_ITSELF) for k, x in enumerate(parts)):
                marked = 1
    return marked


def _unclosed(page, name, at):
    """Whether an element whose content begins at ``at`` has no end tag."""
    depth = 1
    for found in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.I).finditer(page, at):
        depth += -1 if found[1] else 1
        if not depth:
            return False
    return True


class _Open:
    """The open elements at a place of a page, innermost last, and what is asked of them:
    each question takes the same time however many are open."""

    def __init__(self):
        self.names, self.drops, self.begins = [], [], []
        self.places, self.blocks, self.dropping = {}, [], []  # by name, not inline, dropped
        self.marks, self.above, self.words = [], [], []       # marked: open ones, parents, own words

    def push(self, name, drops, begin):
        place = len(self.names)
        self.names.append(name)
        self.drops.append(drops)
        self.begins.append(begin)
        self.places.setdefault(name, []).append(place)
        if name not in INLINE:
            self.blocks.append(place)
        if drops:
            self.dropping.append(place)
        if drops == 1:
            self.marks.append((place, self.mark()))

    def close(self, place):
        """Close the element at a place and all inside it."""
        for stack in (self.blocks, self.dropping):
            while stack and stack[-1] >= place:
                stack.pop()
        while self.marks and self.marks[-1][0] >= place:
            self.marks.pop()
        while len(self.names) > place:
            self.places[self.names.pop()].pop()
            self.drops.pop()
            self.begins.pop()

    def count(self, name):
        return len(self.places.get(name, ()))

    def last(self, name):
        return (self.places.get(name) or [None])[-1]

    def block(self):
        return self.names[self.blocks[-1]] if self.blocks else ""

    def mark(self):
        """A new marked element inside the innermost one that is open."""
        self.above.append(self.inner())
        self.words.append(None)
        return len(self.above) - 1

    def inner(self):
        return self.marks[-1][1] if self.marks else -1


def events(page):
    """(kind, key, text, dropped, in_article) of every piece: kind "word" for text, whose
    key is (innermost block, in a link), "tag" for a tag, whose key is its name."""
    open_, result, at, page = _Open(), [], 0, page or ""
    seen = hidden = total = 0  # articles so far, open elements that are never text, words
    held, checked, replies = [], {}, set()  # marks around each piece; by element: unclosed, comments

    def close(place):
        nonlocal hidden
        hidden -= sum(drops == 2 for drops in open_.drops[place:])
        open_.close(place)

    def add(kind, key, text, dropped, inside, mark):
        nonlocal total
        result.append((kind, key, text, dropped, inside))
        held.append(mark)
        if kind == "word" and not dropped:
            n = len(text.split())
            total += n
            if mark >= 0:
                open_.words[mark] = (open_.words[mark] or 0) + n

    while at < len(page):
        found = PIECE.match(page, at)
        at = found.end()
        text = found.group()
        name = found.group(2) or found.group(5)
        articles = open_.count("article")
        if name is None:
            if text[0] != "<" or text == "<":
                add("word", (open_.block(), open_.count("a") > 0), text, hidden > 0, articles > 0, open_.inner())
            continue
        name, closing = name.lower(), bool(found.group(1) or found.group(4))
        if closing:
            place = open_.last(name)
            add("tag", name, "", hidden > 0, articles > 0 and name != "article", open_.inner())
            if place is not None:
                close(place)
            continue
        attributes = found.group(3) or found.group(6) or ""
        shut = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if name in ("article", "main"):  # an element left open before the text
            for place in open_.dropping:
                tag, begin = open_.names[place], open_.begins[place]
                if name == "article" and (tag == "aside" or begin in replies):
                    continue
                if begin not in checked:
                    checked[begin] = _unclosed(page, tag, begin)
                if checked[begin]:
                    close(place)
                    break
        while shut and open_.names and (open_.names[-1] in shut or open_.names[-1] in INLINE):
            outer = open_.blocks[-1] if open_.blocks else None
            if outer is None or open_.names[outer] not in shut:
                break
            close(outer)
        drops = _dropped(name, attributes, name in WHOLE and (name != "article" or not seen))
        seen += name == "article" and not hidden
        if drops == 2 and name not in NEVER:
            replies.add(at)
        articles = open_.count("article")
        if name in VOID or attributes.endswith("/"):
            add("tag", name, "", hidden > 0 or drops == 2, articles > 0, open_.mark() if drops == 1 else open_.inner())
            continue
        if name in RAW:
            mark = open_.mark() if drops == 1 else open_.inner()
            add("tag", name, "", hidden > 0 or drops == 2, articles > 0, mark)
            end = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
            if name not in NEVER:
                add("word", (name, False), page[at : end.start() if end else len(page)], hidden > 0, articles > 0, mark)
            at = end.end() if end else len(page)
            continue
        open_.push(name, drops, at)
        add("tag", name, "", hidden > 0 or drops == 2, articles > 0, open_.inner())
        hidden += drops == 2
    words, above = open_.words, open_.above
    for mark in range(len(words) - 1, -1, -1):  # what is inside comes later
        if above[mark] >= 0 and words[mark] is not None:
            words[above[mark]] = (words[above[mark]] or 0) + words[mark]
    small = []
    for mark, n in enumerate(words):
        few = n is not None and 2 * n <= total  # an element without text stands for nothing
        small.append(few or (above[mark] >= 0 and small[above[mark]]))
    return [
        (kind, key, text, dropped or (mark >= 0 and small[mark]), inside)
        for (kind, key, text, dropped, inside), mark in zip(result, held)
    ]


def learn(pages):
    """Weights by (kind, key) from an iterable of pages; pages without exactly one
    ``article`` teach nothing."""
    counts = {}
    for page in pages:
        if len(re.findall(r"<article[\s>]", page or "", re.I)) != 1:
            continue
        for kind, key, text, dropped, inside in events(page):
            if dropped:
                continue
            n = len(text.split()) if kind == "word" else int(key not in ("article", "main"))
            if n:
                counts.setdefault((kind, key), [0, 0])[inside] += n
    weights = {}
    for (kind, key), (out, within) in counts.items():
        odds = float(np.log((within + 0.5) / (out + 0.5)))
        weights[kind, key] = (
            min(max(odds, LEAST), MOST) if kind == "word" else max(min(odds, -LEAST), -MOST)
        )
    return weights


def extract(page, weights):
    """Text of the best region of a page; empty if it has no words."""
    pieces = events(page)
    best = total = 0.0
    begin, region = 0, (0, 0)
    for i, (kind, key, text, dropped, _) in enumerate(pieces):
        if dropped:
            continue
        if kind == "word":
            total += len(text.split()) * weights.get((kind, key), UNSEEN_LINK_WORD if key[1] else UNSEEN_WORD)
        elif key in ("article", "main"):
            continue
        else:
            total += weights.get((kind, key), UNSEEN_INLINE_TAG if key in INLINE or key == "br" else UNSEEN_TAG)
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, region = total, (begin, i + 1)
    parts = []
    for kind, key, text, dropped, _ in pieces[region[0] : region[1]]:
        if kind == "tag" and key not in INLINE:
            parts.append(" ")
        elif kind == "word" and not dropped:
            parts.append(text)
    return " ".join(html.unescape("".join(parts)).split())


def train(pages, rows=FIT_PAGES, chars=FIT_CHARS):
    """Weights from at most ``rows`` labelled pages with ``chars`` characters in all,
    the same ones on every run."""
    # hashes and lengths first: no task gets more than ``rows`` of these from another
    own = F.xxhash64("page_id", "html")
    labelled = pages.where(F.lower("html").contains("<article"))
    sizes = labelled.select(own.alias("_order"), F.length("html").alias("_chars")).where(F.col("_chars") <= chars)
    first = sizes.groupBy("_order").agg(F.max("_chars").alias("_chars")).orderBy("_order").limit(rows)
    running = Window.partitionBy(F.lit(0)).orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    chosen = first.withColumn("_upto", F.sum("_chars").over(running)).where(F.col("_upto") <= chars)
    chosen = [r["_order"] for r in chosen.select("_order").collect()]
    found = labelled.select("html", own.alias("_order")).where(F.col("_order").isin(chosen))
    return learn(found.groupBy("_order").agg(F.first("html").alias("html")).toArrow()["html"].to_pylist())


def main_text(pages, weights=None):
    """page_id, url, text and n_chars of every page; a null page has no text, repeated
    rows and null ids are rows like others."""
    ship_package(pages.sparkSession)
    weights = train(pages) if weights is None else weights
    source = pages.select("page_id", "url", "html")
    schema = source.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches):
        for part in text_slices(batches, "html"):
            texts = [extract(page, weights) for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], schema.names,
            )

    return source.mapInArrow(run, schema)
