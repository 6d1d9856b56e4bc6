"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of tags and of texts between them. A text scores its number of words times the weight of the element it
stands in, a tag scores its own weight, which is never positive; both are log-odds of content, counted on labelled pages: those that
mark their content by ``<article>`` or ``<main>``. One linear scan finds the best contiguous region; the texts in it are the result,
without those in elements that are never content (menus, forms, scripts and the like) or whose class or id says so: a few whole names of
adverts and reader comments, and names that hold next to nothing of the marked content of the labelled pages.
"""

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clinfeat.llm.shared import map_batches

SAMPLE_PAGES = 2000  # expected number of labelled pages that the weights are counted on
MOST = 4.0  # bound of a weight
LEAST_TAG = -0.05
NEVER = -3.0  # log-odds from which on a class or id is taken for one without content: some twenty words outside for one inside

_RAW = {x: re.compile(rf"</{x}\s*+>", re.I) for x in "script style noscript template textarea iframe svg".split()}
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++))", re.I)
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup tt u var wbr time".split())
_NEVER = set("head title nav header footer aside form button select option menu dialog figure-actions object".split())
#: Whole names (class, id or role) of adverts, reader comments and the like; the labelled pages teach others.
_NEVER_NAMED = set(
    "ad ads advert adverts advertisement advertising comments comment-list cookie-banner cookie-notice breadcrumb breadcrumbs navbar sidebar "
    "sponsored newsletter-signup navigation banner contentinfo complementary search".split()
)
_MARKED = {"article", "main"}
#: An open element of these ends at the next start of one of the set.
_CLOSED_BY = {"p": set("p div ul ol li table section article aside header footer nav form h1 h2 h3 h4 h5 h6 pre blockquote hr main".split()), "li": {"li"}}
_CLOSERS = set().union(*_CLOSED_BY.values())
_KEEPS_NAME = set("div section article main aside header footer nav form ul ol table body td p li".split())


class _Scanner:
    """Tags of a page, in time linear in its length: what a search for an end has found is kept for the next one."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.ends: dict[int, int] = {}  # from a ``>`` or quote outside quotes: where its tag ends, or -1
        self.stop_from = self.stop_at = -1
        self.last = page.rfind(">")
        self.raw_end: dict[str, int] = {}

    def stop(self, at: int) -> int:
        """The next ``>`` or quote."""
        if not self.stop_from <= at <= self.stop_at:
            m = _STOP.search(self.page, at)
            self.stop_from, self.stop_at = at, m.start() if m else self.size
        return self.stop_at

    def tag_end(self, at: int) -> int:
        """The ``>`` that ends the tag whose attributes begin at ``at``, quotes being closed; -1 without one."""
        seen, found = [], -1
        while at <= self.last:
            at = self.stop(at)
            if at in self.ends:
                found = self.ends[at]
                break
            seen.append(at)
            if at >= self.size:
                break
            if self.page[at] == ">":
                found = at
                break
            close = self.page.find(self.page[at], at + 1)
            if close < 0:
                break
            at = close + 1
        self.ends.update(dict.fromkeys(seen, found))
        return found

    def tags(self):
        """Yields (start, end, name, closing, attributes); without a name for comments, declarations and raw elements."""
        page, at = self.page, self.page.find("<")
        while at >= 0:
            end, name, closing, attributes = -1, "", page.startswith("/", at + 1), ""
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = self.size if end < 0 else end + 3
            elif page.startswith(("!", "?"), at + 1):
                end = page.find(">", at) + 1 if at < self.last else -1
            elif m := _NAME.match(page, at + 1 + closing):
                name = m.group().lower()
                if name in _RAW and not closing:
                    close = _RAW[name].search(page, m.end())
                    end, name = close.end() if close else self.size, ""
                else:
                    close = self.tag_end(m.end())
                    end, attributes = (close + 1, page[m.end():close]) if close >= 0 else (-1, "")
            if end > 0:
                yield at, end, name, closing, attributes
            at = page.find("<", end if end > 0 else at + 1)


def names_of(name: str, attributes: str) -> set[str]:
    """The whole names that an element's class, id and role give, in lower case."""
    if not attributes or name in ("body", "html"):
        return set()
    return {x for m in _NAMES.findall(attributes) for cell in m for x in cell.lower().split()}


def parsed(page: str, never_named: frozenset = frozenset()):
    """Yields (kind, key, text, never, marked, names): kind 0 a text, 1 an inline tag, 2 another tag.

    ``key`` of a text is the innermost open element; ``never``: inside an element that holds no content; ``marked``: inside a labelled one;
    ``names``: of the innermost open element that has any. Linear in the page: the work for a tag is bounded by the elements that it closes.
    """
    stack: list[tuple] = []  # name, never, marked, names
    blocks: list[int] = []  # places in the stack of elements that inline tags do not close
    open_, inline = Counter(), [Counter()]  # open elements by name; those above each block

    def state():
        return stack[-1] if stack else ("", False, False, frozenset())

    def cut(depth: int) -> None:
        while len(stack) > depth:
            name = stack.pop()[0]
            open_[name] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
                inline.pop()
            else:
                inline[-1][name] -= 1

    at = 0
    for start, end, name, closing, attributes in _Scanner(page).tags():
        if start > at:
            own, never, marked, names = state()
            yield 0, own, page[at:start], never, marked, names
        at = end
        if not name:
            continue
        kind = 1 if name in _INLINE else 2
        if closing:
            _, never, marked, names = state()
            yield kind, "/" + name, "", never, marked and name not in _MARKED, names
            if name not in _VOID and (inline[-1] if name in _INLINE else open_)[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                cut(depth)
            continue
        if name in _CLOSERS and blocks and name in _CLOSED_BY.get(stack[blocks[-1]][0], ()):
            cut(blocks[-1])
        _, never, marked, names = state()
        own = names_of(name, attributes)
        here = never or name in _NEVER and not (name == "header" and marked) or not own.isdisjoint(_NEVER_NAMED) or not own.isdisjoint(never_named)
        yield kind, name, "", here, marked, names
        if name not in _VOID and not attributes.endswith("/"):
            if name in _KEEPS_NAME:
                blocks.append(len(stack))
                inline.append(Counter())
            else:
                inline[-1][name] += 1
            open_[name] += 1
            stack.append((name, here, marked or name in _MARKED, own or names))
    if at < len(page):
        own, never, marked, names = state()
        yield 0, own, page[at:], never, marked, names


def _counts(batch):
    """(key, inside, outside) of the labelled pages: words by element under its name and by class or id under ``.name``, tags under ``<name``."""
    inside, outside = {}, {}
    for page in batch.column("html").to_pylist():
        found = list(parsed(page or ""))
        if not any(x[4] for x in found):
            continue
        for kind, key, text, never, marked, names in found:
            n = len(text.split()) if kind == 0 else 1
            here = inside if marked and not never else outside
            for key in [key, *("." + x for x in names)] if kind == 0 else ["<" + key]:
                here[key] = here.get(key, 0) + n
    keys = [*{**inside, **outside}]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([inside.get(k, 0) for k in keys], pa.int64()), pa.array([outside.get(k, 0) for k in keys], pa.int64())],
        ["key", "inside", "outside"],
    )


def weights(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log-odds by key, from about ``sample`` of the labelled pages chosen by a hash; empty without labelled pages."""
    pages = pages.where(F.col("html").rlike("(?i)<(?:article|main)(?![a-z0-9:-])"))
    share = min(1.0, sample / max(1, pages.count()))
    chance = F.pmod(F.xxhash64("html", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = pages.where(chance < share).select("html")
    counted = map_batches(chosen, _counts, "key string, inside long, outside long").groupBy("key").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside")
    )
    odds = {}
    for key, inside, outside in counted.collect():  # at most the element names of the sampled pages
        score = max(-MOST, min(MOST, math.log((inside + 1) / (outside + 1))))
        odds[key] = min(LEAST_TAG, score) if key.startswith("<") else score
    return odds


def never_named(odds: dict[str, float]) -> frozenset:
    """Names whose elements hold hardly any content in the labelled pages."""
    return frozenset(key[1:] for key, score in odds.items() if key.startswith(".") and score <= NEVER)


def main_text(page: str, odds: dict[str, float], learned: frozenset | None = None) -> str:
    """The texts of the best region, blocks joined by one space; empty if no region scores above 0."""
    tokens = list(parsed(page, never_named(odds) if learned is None else learned))
    best, best_from, best_to = 0.0, 0, 0
    total, begin = 0.0, 0
    for i, (kind, key, text, never, marked, _) in enumerate(tokens):
        if never and marked:
            continue  # an advert inside the content is taken out and splits nothing
        if kind:
            score = odds.get("<" + key, -1.0)
        else:
            score = len(text.split()) * (-MOST if never else odds.get(key, 1.0))
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, best_from, best_to = total, begin, i + 1
    parts = []
    for kind, _, text, never, *_ in tokens[best_from:best_to]:
        if kind == 2:
            parts.append(" ")
        elif kind == 0 and not never:
            parts.append(html.unescape(text))
    return " ".join("".join(parts).split())


def _extracted(batch, odds: dict[str, float]):
    learned = never_named(odds)
    made = [main_text(page or "", odds, learned) for page in batch.column("_html").to_pylist()]
    keep = [f.name for f in batch.schema if not f.name.startswith("_")]
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in keep] + [pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())],
        keep + ["_main_text", "_n_chars"],
    )


def extract(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """``pages`` (html, any others) with ``_main_text`` and ``_n_chars`` (its code points) added.

    Null and empty html give empty text, as do pages without words outside menus and the like. Character references are decoded, white space
    inside a block becomes one space, blocks are joined in page order by one space. Repeated rows give repeated rows; of regions
    with equal scores the first counts. Columns whose names begin with an underscore are left out. An empty table gives no rows.
    """
    others = [c for c in pages.columns if not c.startswith("_")]
    pages = pages.select(*others)
    odds = weights(pages.select(F.col("html").cast("string").alias("html")), sample)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema)
    return map_batches(
        pages.withColumn("_html", F.col("html").cast("string")), lambda b: _extracted(b, odds), schema + "_main_text string, _n_chars long"
    )
