"""Main text of web pages by the distribution of text over line blocks.

1. Markup is stripped: a block-level tag ends a line, inline tags vanish, scripts, styles and comments are cut
   out.  A line in a navigation, header, footer, aside, form or the like, or in an element whose class, id or
   role names such a part, or that is hidden, weighs nothing and is never text.
2. A line's weight is the length of its text outside links.  Weights are summed over windows of ``window``
   lines; a surge is where the sum of a window rises above the threshold, a dive where it is back at or below.
3. The lines between a surge and its dive are the text.  The threshold is ``share`` of the page's heaviest window, at
   most ``most`` characters.
4. An ``article`` or ``main`` element is a hint.  Its lines and the others are windowed apart.  A line inside that is
   text for the greater part weighs ``most`` / ``window`` more, so that short paragraphs in a row make a surge; a stretch
   outside must rise above ``share`` of the heaviest window and above ``most``.  Lines of links alone stay inside the
   element where fewer than ``window`` of them follow each other.  Where a stretch outside is heavier than all that
   the elements hold, and than ``most``, the elements are no hint and the page is judged by step 3 alone.
5. Outside such elements, lines of at most ``NOTE_CHARS`` characters that begin as a copyright note weigh nothing.

Defined results: null or empty html gives the empty text, as does a page without text lines.  Unclosed tags,
quotes and comments are read leniently in one pass, in time proportional to the page.  Rows are independent;
other columns pass through.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busguard.llm.common import col, text_or_empty

WINDOW = 3
SHARE = 0.2
MOST = 80.0
NOTE_CHARS = 120

# Element names of HTML by their part in a page, and words that name such parts.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "math", "object"}
LEFT_OUT = RAW | {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "fieldset"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
          "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
          "summary", "table", "tbody", "tfoot", "thead", "title", "tr", "ul"}
SPACED = {"br", "td", "th", "img", "input", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
TEXT_ROOTS = {"article", "main"}
PART_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
              "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr",
              "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
              "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "search", "share", "sharing",
              "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
PART_NAMES = {"header", "site-header", "page-header", "top", "bottom", "side", "reply", "legal"}
PART_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation",
              "search"}

RAW_ENDS = {name: re.compile(f"</{name}\\s*>", re.IGNORECASE) for name in RAW}
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/>]|$))""",
                   re.IGNORECASE)
NOTE = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.IGNORECASE)


def is_part(attributes: str) -> bool:
    """Whether an element's attributes name a part of the page that is not its text."""
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if not PART_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value)) or not PART_NAMES.isdisjoint(value.split()):
                return True
        elif name == "role":
            if value in PART_ROLES:
                return True
        elif name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif name == "hidden" or value == "true":
            return True
    return False


def tag_end(page: str, start: int) -> int:
    """Place of the > that ends the tag at ``start``; one inside a double-quoted value does not count."""
    end = page.find(">", start)
    if end >= 0 and page.count('"', start, end) % 2:
        quote = page.find('"', end)
        later = page.find(">", quote) if quote >= 0 else -1
        if later >= 0 and "<" not in page[end:quote]:
            return later
    return end


def page_lines(page: str) -> tuple[list[tuple[str, float, bool]], bool]:
    """(text, weight, inside a text root) of every line of the page, and whether it has a text root."""
    lines: list[tuple[str, float, bool]] = []
    buffer: list[str] = []
    linked = 0  # characters of the line inside links
    in_link = False
    roots = 0
    has_root = False
    skipping = ""  # name of the element that is left out, its depth by that name
    depth = 0
    unclosed: set[str] = set()  # raw elements that end nowhere further on

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                lines.append((text, max(0.0, len(text) - linked), roots > 0))
            buffer.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not skipping:
            buffer.append(page[at:lt])
            if in_link:
                linked += lt - at
        if lt == size:
            break
        m = TAG.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else size
            elif page.startswith(("<!", "<?", "</"), lt):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:  # a bare < is text
                if not skipping:
                    buffer.append("<")
                at = lt + 1
            continue
        end = tag_end(page, m.end())
        if end < 0:
            break
        closing, name = bool(m[1]), m[2].lower()
        attributes = page[m.end():end]
        at = end + 1
        if skipping:
            # the first article ends what was never closed before it; later ones may be a comment's
            opens_text = not closing and not has_root and name in TEXT_ROOTS and not is_part(attributes)
            ends_short = skipping in ("p", "li", "dt", "dd") and name in BLOCKS and (not closing or name != skipping)
            if skipping == "head" and name == "body" or opens_text or ends_short:
                skipping, depth = "", 0  # never closed
            else:
                if name == skipping and not attributes.endswith("/"):
                    depth += -1 if closing else 1
                    if not depth:
                        skipping = ""
                continue
        if name in BLOCKS:
            flush()
        elif name in SPACED:
            buffer.append(" ")
        if closing:
            if name == "a":
                in_link = False
            elif name in TEXT_ROOTS and roots:
                roots -= 1
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in LEFT_OUT or attributes and name not in ("html", "body") and is_part(attributes):
            if name not in RAW_ENDS:
                skipping, depth = name, 1
            elif name not in unclosed:
                close = RAW_ENDS[name].search(page, at)
                if close:
                    at = close.end()
                elif name in ("script", "style"):
                    break
                else:
                    unclosed.add(name)
        elif name == "a":
            in_link = True
        elif name in TEXT_ROOTS:
            roots += 1
            has_root = True
    flush()
    return lines, has_root


def text_stretches(weights: list[float], threshold: float, window: int) -> list[tuple[int, int]]:
    """Half-open stretches of lines from a surge to its dive: covered by windows heavier than the threshold."""
    out: list[tuple[int, int]] = []
    total = 0.0
    for i in range(len(weights) + window - 1):  # the window of lines i - window + 1 .. i
        total = sum(weights[max(0, i - window + 1):i + 1])
        if total > threshold:
            first, last = max(0, i - window + 1), min(len(weights), i + 1)
            if out and first <= out[-1][1]:
                out[-1] = (out[-1][0], last)
            else:
                out.append((first, last))
    return out


def lone(weights: list[float], window: int) -> list[bool]:
    """For every line whether it is one of fewer than ``window`` lines in a row without weight."""
    out = [False] * len(weights)
    start = 0
    for i in range(len(weights) + 1):
        if i == len(weights) or weights[i] > 0:
            out[start:i] = [i - start < window] * (i - start)
            start = i + 1
    return out


def main_text(page: str, window: int = WINDOW, share: float = SHARE, most: float = MOST) -> str:
    """The main text of one page, its lines joined by a line feed."""
    lines, has_root = page_lines(page)
    plain = [0.0 if not inside and len(t) <= NOTE_CHARS and NOTE.match(t) else w for t, w, inside in lines]
    sums = lambda weights: [sum(weights[i:i + window]) for i in range(len(weights))]
    if has_root:
        beside = [0.0 if inside else w for (_, _, inside), w in zip(lines, plain)]
        held = sum(plain) - sum(beside)
        outside = text_stretches(beside, max(most, share * max(sums(beside), default=0.0)), window)
        if any(sum(beside[a:b]) > held for a, b in outside):
            has_root = False
    if not has_root:
        threshold = min(most, share * max(sums(plain), default=0.0))
        at = [i for a, b in text_stretches(plain, threshold, window) for i in range(a, b) if plain[i] > 0]
        return "\n".join(lines[i][0] for i in at)
    order = [i for i, line in enumerate(lines) if line[2]]
    within = [plain[i] + (most / window if 2 * plain[i] > len(lines[i][0]) else 0.0) for i in order]
    heaviest = max(sums(within) + sums(beside), default=0.0)
    few = lone(within, window)
    at = [order[i] for a, b in text_stretches(within, min(most, share * heaviest), window) for i in range(a, b)
          if within[i] > 0 or few[i]]
    at += [i for a, b in text_stretches(beside, max(most, share * heaviest), window) for i in range(a, b) if beside[i] > 0]
    return "\n".join(lines[i][0] for i in sorted(at))


def extract_text(pages: DataFrame, html: str = "html", text_as: str = "text", window: int = WINDOW,
                 share: float = SHARE, most: float = MOST) -> DataFrame:
    """``pages`` with the main text of each."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda page: main_text(page, window, share, most))

    return pages.withColumn(text_as, run(text_or_empty(col(pages, html))))
