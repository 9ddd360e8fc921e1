"""Main text of web pages by line-block distribution.

Markup is stripped first: scripts, styles and comments, and elements that by name or label are navigation, page headers and
footers, sidebars, notices, adverts, forms or reader comments, with all they hold. What is left becomes lines, one per block
that has text. The text lengths outside links over a sliding window of lines rise at the start of the main text and fall to
nothing after it; the lines between such a surge and the next dive are a run. Lines of ``article`` and ``main`` weigh as much as
a surge more, and their borders are dives. The runs inside such elements are the main text, with the others too where these
hold more than twice as much.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

WINDOW = 3
SURGE = 80
BESIDE = 2  # how many times the text of articles other runs must hold to count beside them

# Fixed names: elements whose content is no markup, and those that are left out besides.
_RAW = frozenset("script style textarea iframe title xmp".split())
_FOREIGN = frozenset("noscript template svg math object canvas select".split())
_OUTSIDE = frozenset("nav footer aside form button menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog toolbar form".split())
# Fixed words of labels of what is not main text; a label is taken apart at hyphens, underscores and inner capitals.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer"
    " cookie cookies consent notice popup modal newsletter subscribe share social related comment comments replies disqus search login toolbar contentinfo complementary".split()
)
# Fixed words: with one of these behind it a mark still tells what the element is; with one of those before it, it does not.
_HOLDERS = frozenset(
    "list area section box wrapper wrap container block widget bar panel links link buttons button icons form slot unit inner item items body content text signup posts articles"
    " stories news thread reply replies toggle overlay top bottom left right main primary secondary mobile desktop".split()
)
_DENIALS = frozenset("no not non without has have with is hide hidden show js".split())
_TITLED = frozenset("article post entry story content section page-title title chapter recipe".split())
_ROOT = frozenset(("article", "main"))
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu"
    " nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Fixed rules: a start of one of these ends an open one of its family, unless it is inside one of the elements behind the colon.
_IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_IMPLIED = {name: (frozenset(family.split()), frozenset(within.split())) for name, (family, within) in _IMPLIED.items()}

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_LABEL = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_ATTRIBUTE_END = re.compile(r"""[>"']""")


def tags(page: str):
    """(text before, name in lower case, "/" for an end tag, attributes) of each tag, forward only; the text behind the last one has no name.

    Comments and what scripts and the like hold is passed over. Where quotes leave a tag open to the end of the page, tags end
    at the next angle bracket from there on.
    """
    at = begin = 0
    quoted = True
    size = len(page)
    unclosed: set[str] = set()  # names without an end tag from some place on
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            yield page[begin:i], "", "", ""
            end = page.find("-->", i + 4)
            begin = at = size if end < 0 else end + 3
            continue
        found = _NAME.match(page, i + 1)
        if not found and page[i + 1 : i + 2] not in ("!", "?", "/"):
            at = i + 1
            continue
        end = page.find(">", i)
        if end < 0:  # no tag ends any more
            break
        if found and quoted and page[i + 1] != "/":
            k = found.end()
            while m := _ATTRIBUTE_END.search(page, k):
                if m[0] == ">":
                    end = m.start()
                    break
                k = page.find(m[0], m.end()) + 1
                if not k:
                    break
            else:
                k = 0
            quoted = bool(k)
        yield page[begin:i], found[1].lower() if found else "", "/" if found and page[i + 1] == "/" else "", page[found.end() : end] if found else ""
        begin = at = end + 1
        name = found[1].lower() if found and page[i + 1] != "/" else ""
        if name in _RAW or name in _FOREIGN and page[end - 1] != "/":
            close = None if name in unclosed else re.compile(rf"</{name}\b", re.I).search(page, at)
            if close:
                over = page.find(">", close.end())
                begin = at = size if over < 0 else over + 1
            elif name in _RAW:
                begin = at = size
            else:
                unclosed.add(name)
    yield page[begin:], "", "", ""


def _words(label: str) -> list[str]:
    return [w for w in re.split(r"[-_\s]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", label).lower()) if w]


def marked(kind: str, label: str, in_root: bool) -> bool:
    """Whether a class, id, role or aria-label tells that the element is not main text."""
    if kind == "role":
        return label.strip().lower() in _ROLES
    for token in [label] if kind == "aria-label" else label.split():
        words = _words(token)
        if not words or words[0] in _DENIALS:
            continue
        if words[-1] in _MARKS and (kind != "aria-label" or len(words) == 1):
            if words[-1] == "header" and (in_root or len(words) > 1 and words[-2] in _TITLED):
                continue
            return True
        if kind != "aria-label" and words[0] in _MARKS and all(w in _HOLDERS or w.isdigit() for w in words[1:]):
            return True
    return False


def _outside(name: str, attrs: str, in_root: bool) -> bool:
    if name in _OUTSIDE or name == "header" and not in_root:
        return True
    if name in ("html", "body") or name in _ROOT and not attrs:
        return False
    return any(marked(m[1].lower(), m[2] or m[3] or m[4] or "", in_root) for m in _LABEL.finditer(attrs))


def _extents(found: list[tuple[str, str, str, str]]) -> list[int]:
    """For each start tag the position of the tag that ends its element; negative (-1 - position) if it is not its own end tag."""
    ends, stack, open_names = [0] * len(found), [], {}

    def pop(at: int, own: bool) -> None:
        i = stack.pop()
        open_names[found[i][1]] -= 1
        ends[i] = at if own else -1 - at

    for at, (_, name, close, _) in enumerate(found):
        if not name or name in _VOID:
            continue
        if close:
            if open_names.get(name):
                while found[stack[-1]][1] != name:
                    pop(at, False)
                pop(at, True)
            continue
        if name in _BLOCKS and open_names.get("p") and found[stack[-1]][1] == "p":
            pop(at, True)
        if name in _IMPLIED:
            family, within = _IMPLIED[name]
            if any(open_names.get(x) for x in family):
                k = len(stack) - 1
                while k >= 0 and found[stack[k]][1] not in family and found[stack[k]][1] not in within and len(stack) - k < 8:
                    k -= 1
                if k >= 0 and found[stack[k]][1] in family:
                    while len(stack) > k:
                        pop(at, True)
        stack.append(at)
        open_names[name] = open_names.get(name, 0) + 1
    while stack:
        pop(len(found), False)
    return ends


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters outside links, number of the article or main element or 0) of each block with text."""
    found = list(tags(page))
    ends = _extents(found)
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = in_link = root = roots = 0
    root_end = skip_end = -1
    open_skip = False  # an element that is left out and has no end of its own: an article ends it

    def end() -> None:
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((text, max(0, len(text) - linked), root))
        parts, linked = [], 0

    for at, (text, name, close, attrs) in enumerate(found):
        if at > skip_end:
            parts.append(text)
            linked += len(text) if in_link else 0
        if at == skip_end or not name:
            continue
        if at < skip_end:
            if not (open_skip and name in _ROOT and not close):
                continue
            skip_end = at - 1
        if name in _BLOCKS:
            end()
        if root and at >= root_end:
            root = 0
        if name == "a":
            in_link = max(0, in_link + (-1 if close else 1))
        if close or name in _VOID:
            continue
        own = ends[at] >= 0
        last = ends[at] if own else -1 - ends[at]
        if _outside(name, attrs, bool(root)):
            end()
            skip_end, open_skip = last - (0 if own and found[last][2] else 1) if last < len(found) else len(found), not own
        elif name in _ROOT and not root:
            end()
            roots += 1
            root, root_end = roots, last
    end()
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text; empty for null and for pages without one. A page in which no window holds a surge is all main text outside links."""
    found = lines(page or "")
    runs: list[tuple[int, int, list[str]]] = []  # element, characters, lines
    for root, first, last in _stretches([r for _, _, r in found]):
        part = found[first:last]
        sizes = [n + surge if root else n for _, n, _ in part]
        keep, total = False, sum(sizes[:window])
        for i, (text, n, _) in enumerate(part):
            if not keep and total >= surge and sizes[i]:
                keep = True
                runs.append((root, 0, []))
            elif keep and not total:
                keep = False
            if keep:
                element, chars, kept = runs[-1]
                kept.append(text)
                runs[-1] = (element, chars + n, kept)
            total += (sizes[i + window] if i + window < len(sizes) else 0) - sizes[i]
    inside, beside = (sum(n for r, n, _ in runs if bool(r) == own) for own in (True, False))
    if any(r for r, _, _ in runs) and beside <= BESIDE * inside:
        runs = [x for x in runs if x[0]]
    if not runs:
        return " ".join(text for text, n, _ in found if n)
    return " ".join(text for _, _, kept in runs for text in kept)


def _stretches(roots: list[int]) -> list[tuple[int, int, int]]:
    """(element, first line, behind the last line) of neighbouring lines of one element."""
    cuts = [0, *(i for i in range(1, len(roots)) if roots[i] != roots[i - 1]), len(roots)]
    return [(roots[a], a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def extracted(column: str, window: int = WINDOW, surge: int = SURGE) -> Column:
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: main_text(page, window, surge))

    return of(F.coalesce(F.col(column), F.lit("")))


def extract(df: DataFrame, *, html: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``df`` without ``html`` and with ``text`` (the main text of the whole page, empty if none) and ``n_chars`` (code points).

    Null pages and pages without text give an empty text, a page without markup its own text. White space inside a block
    becomes one space and blocks are joined by one. Repeated rows are extracted each, an empty table gives an empty one, and the
    time is in proportion to the page however broken its markup is. Columns named text or n_chars are replaced.
    """
    own = unused(df, "__text")
    found = df.withColumn(own, extracted(html, window, surge)).drop(html, "text", "n_chars")
    return found.withColumnRenamed(own, "text").withColumn("n_chars", F.length("text").cast("long"))
