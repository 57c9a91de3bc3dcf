"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its path of block-level tags from the root. For every
path the text length and the punctuation are summed and divided by its number of blocks. Both ratios are
smoothed along the page, fused, and held against a threshold; the paths above it hold the article.
Paths through navigation, forms and the like are no candidates.
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from expirylens.llm.common import extended

# A path is content if its fused ratio is at least this part of the best path's.
THRESHOLD = 0.12
SMOOTHING = np.array([0.05, 0.25, 0.4, 0.25, 0.05])

# HTML's block-level elements, empty elements, and elements whose content isn't markup or isn't text.
BLOCKS = frozenset("""html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption
blockquote pre figure figcaption address details summary nav header footer aside form fieldset menu dialog hr center""".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe textarea select title audio video head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements, roles and words of class names and ids that stand for what is not the article.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button header".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb
breadcrumbs footer header masthead sidebar aside comment comments reply replies respond discussion cookie cookies consent gdpr banner notice
notices popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations widget widgets toolbar
pagination pager login signin signup search disclaimer copyright legal""".split())
# Of these, elements and words that may also hold or wrap the article: they count only where little of the page's mass lies in them.
WEAK_TAGS = frozenset("form header".split())
WEAK_WORDS = frozenset("""sidebar header masthead banner nav navbar menu toolbar widget widgets search related recommended notice notices legal
disclaimer discussion overlay modal social""".split())
# Words that turn a class name around (has-sidebar), and those before which "related" speaks of the matter.
TURNING = frozenset("has have with without no not hide hides".split())
MATTER = frozenset("work works literature research studies".split())
# An element with more than this part of the page's mass is no aside.
MOST_MASS = 0.5
# Starting one of these ends an open one of those.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPES = frozenset("ul ol dl table div article section main body blockquote nav header footer aside form".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_ROLE = re.compile(r"""\brole\s*=\s*["']?([\w-]+)""", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
_WORDS = re.compile(r"[A-Za-z]+")


def _hidden(attributes: str) -> bool:
    """Whether there is an attribute hidden, a style display:none or aria-hidden=true."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip()
        if (name == "hidden" and not value.lower().startswith(("false", "until")) or name == "aria-hidden" and value.lower() == "true"
                or name == "style" and _NOT_SHOWN.search(value)):
            return True
    return False


def _aside_words(names: str) -> set[str]:
    """The words of class names and ids that stand for what is not the article."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]
        if TURNING.isdisjoint(words):
            found |= {w for w, after in zip(words, [*words[1:], ""], strict=True) if w in ASIDE_WORDS and not (w == "related" and after in MATTER)}
    return found


NONE, WEAK, SURE = range(3)


def _label(name: str, attributes: str, inside: bool) -> tuple[str, int]:
    """The element's step in a path, and how surely it stands beside the article. inside: it is part of one."""
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
    step = f"{name}.{'.'.join(names.split())}" if names else name
    if name in ("html", "body", "main", "article"):
        return step, NONE
    if name in ASIDE_TAGS and not (name == "header" and inside):
        return step, WEAK if name in WEAK_TAGS else SURE
    if attributes:
        if (role := _ROLE.search(attributes)) and role[1].lower() in ASIDE_ROLES or _hidden(attributes):
            return step, SURE
        if names and (words := _aside_words(names) - ({"header", "banner"} if inside and name in (HEADINGS | {"header"}) else set())):
            return step, WEAK if words <= WEAK_WORDS else SURE
    return step, NONE


Block = tuple[str, str, tuple[int, ...] | None, int]


def blocks(page: str) -> list[Block]:
    """(path, text, asides, characters in links) of every block of text, in page order.

    asides: the numbers of the elements around it that may stand beside the article; None if one surely does.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, tuple[int, ...] | None]] = []  # name, path, asides
    doubtful = 0
    text: list[str] = []
    links = in_link = 0
    silent, at = "", 0

    def flush() -> None:
        nonlocal links
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append((stack[-1][1] if stack else "", line, stack[-1][2] if stack else (), links))
            text.clear()
        links = 0

    def take(to: int) -> None:
        nonlocal links
        if to > at and not silent:
            part = page[at:to]
            if "&" in part:
                part = html.unescape(part)
            text.append(part)
            if in_link:
                links += len(part)

    def pop(to: int) -> None:
        flush()
        del stack[to:]

    for m in _MARKUP.finditer(page):
        name = (m[2] or "").lower()
        if silent:
            if m[1] and name == silent:
                silent, at = "", m.end()
            continue
        take(m.start())
        at = m.end()
        if not name:
            continue
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in BLOCKS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop(k)
                        break
            continue
        if name in SILENT and not m[3].endswith("/"):
            if name != "head":
                silent = name
            continue
        if name == "a":
            in_link = 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS or name == "button":
            if stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _ENDS.get(name, ()):
                    pop(k)
                    break
                if stack[k][0] in _SCOPES:
                    break
            flush()
            if name in EMPTY:
                continue
            above = stack[-1] if stack else ("", "", ())
            step, mark = _label(name, m[3], any(s[0] in ("article", "main") for s in stack))
            asides = above[2]
            if mark == SURE:
                asides = None
            elif mark == WEAK and asides is not None:
                asides = (*asides, doubtful)
                doubtful += 1
            stack.append((name, f"{above[1]}/{step}", asides))
            if name == "button":
                in_link = 0
    if not silent:
        rest = page[at:]
        take(len(page) if not re.search(r"<[a-zA-Z/!][^>]*\Z", rest) else at + re.search(r"<[a-zA-Z/!][^>]*\Z", rest).start())
        flush()
    return out


def ratios(found: list[Block]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Numbers of the paths, each block's path, and each path's fused ratio of text and punctuation to blocks."""
    paths = {p: i for i, p in enumerate(dict.fromkeys(b[0] for b in found))}
    of = np.array([paths[b[0]] for b in found], np.int64)
    number = np.bincount(of)
    length = np.bincount(of, [len(b[1]) - min(b[3], len(b[1])) for b in found]) / number
    marks = (np.bincount(of, [len(_PUNCTUATION.findall(b[1])) for b in found]) + 1) / number
    smooth = [np.bincount(of, np.convolve(np.pad(x[of], 2, "edge"), SMOOTHING, "valid")) / number for x in (length, marks)]
    return paths, of, np.sqrt(length * smooth[0]) * np.sqrt(marks * smooth[1])


def beside(found: list[Block]) -> set[int]:
    """The doubtful elements that do stand beside the article: those without most of the page's mass, which is each block's ratio."""
    _, of, ratio = ratios(found)
    mass: dict[int, float] = {}
    for block, path in zip(found, of.tolist(), strict=True):
        for aside in block[2]:
            mass[aside] = mass.get(aside, 0.0) + float(ratio[path])
    total = float(ratio[of].sum())
    return {aside for aside, own in mass.items() if own <= MOST_MASS * total}


def content(found: list[Block]) -> tuple[list[str], list[str]]:
    """The texts of the content blocks in page order, and the content paths."""
    kept = [b for b in found if b[2] is not None]
    if any(b[2] for b in kept):
        asides = beside(kept)
        kept = [b for b in kept if asides.isdisjoint(b[2])]
    if not kept:
        return [], []
    paths, of, ratio = ratios(kept)
    chosen = {p for p, i in paths.items() if ratio[i] >= THRESHOLD * ratio.max() and ratio[i] > 0}
    if not chosen:
        return [], []

    def root(path: str) -> str:
        """The path down to the article or main part that holds it, else to its parent."""
        steps = path.split("/")
        for k, s in enumerate(steps):
            if s.split(".")[0] in ("article", "main"):
                return "/".join(steps[:k + 1])
        return ""

    # the parts of an article that holds content are content: lists, quotations, short lines
    whole = {r for p in chosen if (r := root(p))}
    parents = {p.rpartition("/")[0] for p in chosen}
    # without such a part, the nearest element above all chosen paths stands for it
    above = [] if whole else os.path.commonprefix([p.split("/")[:-1] for p in chosen])
    for p in paths:
        steps = p.split("/")
        if root(p) in whole or not whole and steps[:len(above)] == above or steps[-1].split(".")[0] in HEADINGS and p.rpartition("/")[0] in parents:
            chosen.add(p)
    return [b[1] for b in kept if b[0] in chosen], [p for p in paths if p in chosen]


def main_text(page: str | None) -> tuple[str, list[str]]:
    texts, paths = content(blocks(page)) if page else ([], [])
    return " ".join(texts), paths


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", paths_col: str = "content_paths") -> DataFrame:
    """All rows and columns of ``pages`` but the HTML, with the main text and the content paths.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by one blank in
    page order. Null and empty pages, and pages without content, have an empty text. Broken pages are read as
    far as they go: unclosed elements end with their parents, a cut-off tag is dropped. Repeated pages get equal
    results; columns named like the two new ones are replaced. Each page is read whole and by itself; nothing
    is shuffled.
    """
    others = [c for c in pages.columns if c not in (html_col, text_col, paths_col)]
    rows = pages.select(*others, html_col)
    schema = extended(rows.drop(html_col).schema, f"`{text_col}` string, `{paths_col}` array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p.as_py()) for p in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.list_(pa.string()))],
                                             [*others, text_col, paths_col])

    return rows.mapInArrow(run, schema)
