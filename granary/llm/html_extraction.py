"""Main text of web pages by tag-path ratios.

A page is read once, in time linear in its length, into blocks: runs of text between block-level tags, each with its
path from the root (tag names with class and id). For each path the ratios are: characters of text per block, and
punctuation marks per block. Both are smoothed over the page's blocks in order (Gaussian), fused by their product with
the share of text outside links, and the paths whose fused ratio passes a threshold (the mean less the deviation) select
content blocks; so do paths with no more than half of their text in links, however short, for the threshold rises with
the length of the text around them. Where the page itself names its content (article, main elements with most of the
weight), those elements are the text, whole. Elsewhere it is the content blocks, and those alone, within the lowest
element that holds all of them, and the headings before the first.

Elements that HTML itself keeps apart from content are out (navigation, forms, scripts, asides, footers, roles that say
so), and so are classes and ids that name menus, adverts or comments outright (NAMED, REMARKS). Names that content has
as well (MAYBE: legal, notice, side, ...) only break ties: they put a path out unless its own fused ratio, unsmoothed,
reaches the mean of the others. A form or a name counts for nothing on an element around most of the page's text, unless
it names comments.

A null or empty page gives empty text, and so does one without content. Broken markup is taken as it stands: unclosed
elements end with their parent, stray end tags are skipped, after a quote that is never closed tags end at the next ">".
Rows alike give equal texts; an empty table gives an empty result. Extra columns pass through; a column named like an
output (text, n_chars) is replaced.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.common import extended, tuned

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…。，、！？；：]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; up to the end tag it is skipped (that of xmp is text as it stands).
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style noscript template nav footer aside button select option textarea iframe object embed svg canvas audio video dialog menu map fieldset input".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", "ul", "ol", "menu"), "dt": ("dt", "dl"), "dd": ("dd", "dl"), "tr": ("tr", "table"), "td": ("td", "tr"), "th": ("th", "tr"), "option": ("option", "select")}


def _words(names: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{names})(?:$|[\s_-])", re.I)


#: Names of what is never content.
NAMED = _words(
    r"ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion|s)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|topbar|toolbar|cookies?|gdpr|popup|modal|"
    r"newsletter|subscribe|signup|login|disqus|commentlist|comments?|pagination|pager"
)
#: Names that content may have too.
MAYBE = _words(r"banner|side|foot|header|consent|notices?|overlay|share|sharing|social|related|recommended|widget|replies|reply|respond|copyright|legal|skip|search|form")
#: Names whose elements stay out however much text they hold.
REMARKS = re.compile(r"comment|disqus|repl(?:y|ies)|respond", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


class _Element:
    """hard: out in any case; soft: out unless it is around most of the text; hint, maybe: it or an
    element around it is out unless its path's ratio is high.
    outer: the outermost article or main around it; base: the nearest element that is no inline one."""

    __slots__ = ("tag", "parent", "path", "depth", "index", "inline", "ended", "hard", "soft", "hint", "maybe", "bad", "link", "outer", "heading", "base")

    def __init__(self, tag: str, parent: "_Element | None", attributes: str, paths: dict, index: int):
        self.tag, self.parent, self.index = tag, parent, index
        self.depth = parent.depth + 1 if parent else 0
        self.inline, self.ended = tag in INLINE, False
        own, hard, soft, hint = "", tag in NEVER, tag == "form", False
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                k = m[1].lower()
                if k in ("class", "id"):
                    v = m[2] or m[3] or m[4] or ""
                    own += "." + v
                    if tag not in ("body", "html", "article", "main"):
                        if NAMED.search(v):
                            soft = True
                        elif MAYBE.search(v):
                            hint = True
                        hard = hard or (soft or hint) and bool(REMARKS.search(v))
                elif k == "role":
                    hard = hard or (m[2] or m[3] or m[4] or "").lower() in _ROLE
                elif k == "hidden" or k == "aria-hidden" and (m[2] or m[3] or m[4]) == "true":
                    hard = True
        self.outer = parent.outer if parent is not None and parent.outer is not None else self if tag in ("article", "main") else None
        self.hard = parent is not None and parent.hard or hard or tag == "header" and self.outer is None
        self.soft, self.hint, self.maybe = soft, hint, hint or parent is not None and parent.maybe
        self.bad = self.hard or soft or parent is not None and parent.bad
        self.link = parent is not None and parent.link or tag == "a"
        self.heading = parent is not None and parent.heading or tag in HEADINGS
        self.path = paths.setdefault((parent.path if parent is not None else -1, tag + own), len(paths))
        self.base = parent.base if parent is not None and self.inline and not self.bad else self


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I)


class _Reader:
    """Reads a page into elements (parents before children) and blocks (element, text, characters in links)."""

    def __init__(self, page: str):
        self.paths: dict = {}
        self.root = self.here = self.block = _Element("#root", None, "", self.paths, 0)
        self.elements, self.blocks = [self.root], []
        self.parts: list[str] = []
        self.blank, self.linked = True, 0
        self.open: dict[str, list[_Element]] = {}
        self.solid: list[_Element] = []
        self.read(page)
        self.flush()

    def text(self, s: str, raw: bool = False) -> None:
        if not s:
            return
        blank, here = s.isspace(), self.here
        if here.bad and not self.block.bad and not blank:
            self.flush()
        if self.blank:
            self.block = here.base
        elif self.block.bad and not here.bad:
            self.flush()
            self.block = here
        self.parts.append(entities.unescape(s) if "&" in s and not raw else s)
        self.blank = self.blank and blank
        if here.link:
            self.linked += len(self.parts[-1].strip())

    def flush(self) -> None:
        if self.parts:
            s = _SPACE.sub(" ", "".join(self.parts)).strip()
            if s:
                self.blocks.append((self.block, s, self.linked))
            self.parts.clear()
        self.blank, self.linked = True, 0

    def close_to(self, outer: _Element) -> None:
        while self.here is not outer:
            e = self.here
            if not e.ended:
                self.open[e.tag].pop()
            if not e.inline:
                self.solid.pop()
            self.here = e.parent

    def start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P and self.solid and self.solid[-1].tag == "p":
            self.close_to(self.solid[-1].parent)
        if tag in SIBLINGS:
            same, *stop = SIBLINGS[tag]
            if self.open.get(same) and self.open[same][-1].depth > max((self.open[x][-1].depth for x in stop if self.open.get(x)), default=0):
                self.close_to(self.open[same][-1].parent)
        self.here = _Element(tag, self.here, attributes, self.paths, len(self.elements))
        self.elements.append(self.here)
        self.open.setdefault(tag, []).append(self.here)
        if not self.here.inline:
            self.solid.append(self.here)

    def end(self, tag: str) -> None:
        found = self.open.get(tag)
        if not found:
            return
        e = found[-1]
        if e.inline and self.solid and self.solid[-1].depth > e.depth:
            e.ended = True  # an inline end tag doesn't close blocks
            found.pop()
        else:
            self.close_to(e.parent)

    def read(self, page: str) -> None:
        at, n, loose = 0, len(page), False
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.text(page[at:])
                return
            self.text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
                continue
            if page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                self.text(page[lt + 9 : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
                continue
            if page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
                continue
            m = _NAME.match(page, lt)
            if m is None:
                self.text("<")
                at = lt + 1
                continue
            rest = None if loose else _REST.match(page, m.end())
            end = rest.end() if rest else page.find(">", m.end()) + 1
            if not end:  # no tag ends from here on
                self.text(page[lt:])
                return
            loose = loose or rest is None
            at, tag, attributes = end, m[2].lower(), page[m.end() : end - 1]
            if m[1]:
                if tag not in INLINE:
                    self.flush()
                self.end(tag)
            elif tag in RAW:
                close = _end_of(tag).search(page, at)
                if tag not in ("script", "style", "noscript", "template"):
                    self.flush()
                if tag == "xmp":
                    self.text(page[at : close.start() if close else n], raw=True)
                    self.flush()
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else n
            elif tag == "br":
                if self.parts:
                    self.parts.append(" ")
            else:
                if tag not in INLINE:
                    self.flush()
                if tag not in VOID and not (tag == "svg" and attributes.endswith("/")):
                    self.start(tag, attributes)


def fused_ratios(found: list[tuple[_Element, str, int]], deviation: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block: the smoothed and fused ratio of its path, the same without smoothing, and the share of its path's
    text outside links."""
    index = np.unique(np.array([e.path for e, _, _ in found]), return_inverse=True)[1]
    length = np.array([len(s) for _, s, _ in found], float)
    free = np.maximum(0, 1 - np.array([x for _, _, x in found]) / np.maximum(length, 1))
    marks = np.array([len(_MARKS.findall(s)) for _, s, _ in found], float)
    count = np.bincount(index)
    text_ratio = (np.bincount(index, length) / count)[index]
    mark_ratio = (np.bincount(index, marks) / count)[index]
    clear = (np.bincount(index, free * length) / np.maximum(np.bincount(index, length), 1))[index]
    plain = text_ratio * (1 + mark_ratio) * clear
    if len(found) >= 5:
        kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2 / deviation**2)
        norm = np.convolve(np.ones(len(found)), kernel, "same")
        text_ratio, mark_ratio = (np.convolve(x, kernel, "same") / norm for x in (text_ratio, mark_ratio))
    return text_ratio * (1 + mark_ratio) * clear, plain, clear


def _summed(elements: list[_Element], own: np.ndarray) -> np.ndarray:
    """What each element and all in it have together."""
    out = own.copy()
    for e in reversed(elements):
        if e.parent is not None:
            out[e.parent.index] += out[e.index]
    return out


def _spare_wrappers(elements: list[_Element], found: list[tuple[_Element, str, int]]) -> None:
    """Elements that only a form or a name makes bad are not, if they hold more than half of the page's text."""
    own = np.zeros(len(elements))
    for e, s, _ in found:
        if not e.hard:
            own[e.index] += len(s)
    held = _summed(elements, own)
    spared = {e.index for e in elements if (e.soft or e.hint) and 2 * held[e.index] > held[0]}
    if not spared:
        return
    for e in elements:
        up = e.parent
        e.bad = e.hard or e.soft and e.index not in spared or up is not None and up.bad
        e.maybe = e.hint and e.index not in spared or up is not None and up.maybe


def main_text(page: str | None) -> str:
    if not page:
        return ""
    reader = _Reader(page)
    elements, found = reader.elements, reader.blocks
    if not found:
        return ""
    _spare_wrappers(elements, found)
    ratio, plain, clear = fused_ratios(found)
    sure = np.array([not e.bad and not e.maybe for e, _, _ in found])
    mean = ratio[sure].mean() if sure.any() else 0.0
    own = sure | np.array([not e.bad and e.maybe and p >= mean for (e, _, _), p in zip(found, plain.tolist())])
    good = [x for x, o in zip(found, own.tolist()) if o]
    if not good:
        return ""
    fused, clear = ratio[own], clear[own]
    size = np.array([len(s) for _, s, _ in good], float)
    content = (fused > 0) & (fused >= max(0.0, fused.mean() - fused.std())) | (clear >= 0.5)
    if not content.any():
        content[:] = True
    weight = np.where(content, fused * size, 0)
    if weight.sum() <= 0:
        weight = size
    named = np.array([e.outer is not None for e, _, _ in good])
    if named.any() and weight[named].sum() >= 0.5 * weight.sum():
        # the page names its content: every outermost article or main, whole
        keep = named
    else:
        held = np.zeros(len(elements))
        np.add.at(held, [e.index for (e, _, _), c in zip(good, content.tolist()) if c], 1)
        held = _summed(elements, held)
        # the lowest element that holds all content: children come after their parents
        whole = int(np.flatnonzero(held == held[0])[-1])
        inside = np.zeros(len(elements), bool)
        for e in elements:
            inside[e.index] = e.index == whole or e.parent is not None and inside[e.parent.index]
        keep = content & inside[[e.index for e, _, _ in good]]
    start = int(content.argmax())
    return "\n\n".join(s for k, ((e, s, _), x) in enumerate(zip(good, keep.tolist())) if x or k < start and e.heading)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds text and n_chars (its code points). Each page is read alone, whole."""
    tuned(df.sparkSession)
    names = [c for c in df.columns if c not in ("text", "n_chars")]
    base = df.select(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x) for x in batch.column(names.index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*names, "text", "n_chars"])

    return base.mapInArrow(work, extended(base, "text string, n_chars long"))
