"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities.

A page is cut into tags by the rules of HTML (a quote opens a value only behind an equals sign; comments, scripts and styles run to their own ends) and read once,
in time proportional to its length. Text between block-level tags is a block with its words, the share of them inside links, and the same figures of its
neighbours; what the tags, roles and whole class names around it say is told as well. A decision tree, trained on a small labelled table of blocks (made
here, from hand-written page plans, of which every second one has containers without meaning), keeps or drops each block.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecolumns.llm.common import batch, small_batches

#: Fixed values of HTML: tags that do not end a block, tags without content, tags whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video map title select datalist textarea button option".split())
#: Of these, those whose content is code to the end of the page if no end tag follows (as browsers have it), and those that may stand in themselves.
CODE = frozenset(("script", "style"))
NESTED = frozenset("template object svg math".split())
#: Tags that may stand in the head: another start tag ends it.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template".split())
#: Containers by tag, by ARIA role and by words in class or id.
TAG_KIND = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "dialog": "notice", "fieldset": "form", "article": "article", "main": "article"}
ROLE_KIND = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice", "main": "article", "article": "article"}
CUES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs skip",
    "header": "header masthead topbar banner",
    "footer": "footer copyright colophon legal bottombar",
    "side": "sidebar aside widget related recommended trending popular rail promoted share sharing social tags",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo adsense adslot adbox adbanner adunit adcontainer adwrapper banner-ad",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe paywall disclaimer toast",
    "form": "form login signup signin search searchbox register contact-form",
    "comment": "comment comments discussion disqus respond reply replies commentlist",
}
_CUE = {w: k for k, ws in CUES.items() for w in ws.split()}
KINDS = ("menu", "header", "footer", "side", "ad", "notice", "form", "comment", "article")
#: Parts of a class name before a cue that turn its meaning round ("no-sidebar" on the body, "has-footer").
NOT_CUES = frozenset("no not has have with without is in hide".split())
#: First parts of names of an article's own header.
OWN_HEADER = frozenset("entry post article story content".split())
#: A container that only its class, its id or a form tag gives a kind, and that holds more than this share of a page's words outside links, LARGE words at least, is none of that
#: kind: it is wrapped round the article. Comments may outweigh an article.
WRAPPED, LARGE = 2 / 3, 50
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", *KINDS, "around", "apart", "heading", "item", "place", "stop")
_NAME, _GAP = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[\s/]*")
_ATTRIBUTE, _UNQUOTED = re.compile(r"(=?[^\s/>=]*)(\s*=\s*)?"), re.compile(r"[^\s>]*")
_CODE_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in CODE}
_PARTS = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")
#: Attributes that say something about an element.
TELLING = frozenset(("role", "class", "id", "hidden", "aria-hidden", "style"))


class Tag(NamedTuple):
    start: int
    end: int
    closing: bool
    name: str
    empty: bool
    attributes: dict[str, str]


def tags(page: str) -> list[Tag]:
    """The tags of a page in order; comments, declarations and the content of scripts and styles count as tags without a name. A tag that the page's end cuts off
    takes the rest with it; a quote that is never closed ends with its tag."""
    out, at, n = [], 0, len(page)
    unclosed = {'"': False, "'": False}

    def upto(what: str, begin: int) -> int:
        k = page.find(what, begin)
        return n if k < 0 else k + len(what)

    while (at := page.find("<", at)) >= 0:
        start, c = at, page[at + 1 : at + 2]
        closing = c == "/"
        name = _NAME.match(page, at + 1 + closing)
        if not name:
            if page.startswith("<!--", at):
                at = at + 5 if page[at + 4 : at + 5] == ">" else at + 6 if page[at + 4 : at + 6] == "->" else upto("-->", at + 4)
            elif c in ("!", "?") or (closing and at + 2 < n):
                at = upto(">", at + 2)
            else:
                at += 1
                continue
            out.append(Tag(start, at, False, "", True, {}))
            continue
        at, attributes, empty = name.end(), {}, False
        while True:
            gap = _GAP.match(page, at)
            at = gap.end()
            if at >= n:
                break
            if page[at] == ">":
                empty = page[at - 1] == "/" and gap.end() > gap.start()
                at += 1
                break
            m = _ATTRIBUTE.match(page, at)
            at, key, value = m.end(), m[1].lower(), ""
            if m[2] and at < n:
                q = page[at]
                if q in unclosed:
                    end = -1 if unclosed[q] else page.find(q, at + 1)
                    if end < 0:
                        unclosed[q] = True
                        end = page.find(">", at)
                        end = n if end < 0 else end
                        value, at = page[at + 1 : end], end
                    else:
                        value, at = page[at + 1 : end], end + 1
                else:
                    m = _UNQUOTED.match(page, at)
                    value, at = m[0], m.end()
            if key in TELLING:
                attributes.setdefault(key, value)
        tag = name[0].lower()
        if at >= n and page[n - 1 :] != ">":
            out.append(Tag(start, n, False, "", True, {}))
            break
        out.append(Tag(start, at, closing, tag, empty, attributes))
        if tag in CODE and not closing:
            m = _CODE_END[tag].search(page, at)
            end = n if not m else upto(">", m.end())
            out.append(Tag(at, end, False, "", True, {}))
            at = end
    return out


def _named_kind(names: str) -> str | None:
    """What a class or id says of a container: by the whole word, or by a part of it that no part before turns round."""
    for w in names.split():
        if kind := _CUE.get(w.lower()):
            return kind
        parts = [p.lower() for p in _PARTS.split(w) if p]
        for k, p in enumerate(parts):
            if p in NOT_CUES:
                break
            if (kind := _CUE.get(p)) and not (kind == "header" and parts[0] in OWN_HEADER):
                return kind
    return None


def _kind(tag: str, attributes: dict[str, str]) -> tuple[str | None, bool]:
    """(what a container's own tag or role says it is, and only where they say nothing, its class and id; 'hidden' if it is not shown, whether that may be wrong)."""
    found = TAG_KIND.get(tag)
    if not attributes:
        return found, tag == "form"
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in "".join(attributes.get("style", "").lower().split()):
        return "hidden", False
    if role := attributes.get("role", "").lower().split():
        if role[0] in ROLE_KIND:
            return ROLE_KIND[role[0]], False
    if found is None and tag not in ("html", "body"):
        return _named_kind(f"{attributes.get('class', '')} {attributes.get('id', '')}"), True
    return found, tag == "form"


def _silent_ends(found: list[Tag]) -> dict[int, int]:
    """For elements whose content is no text and that have an end tag of their own: the place of that tag."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for k, t in enumerate(found):
        if t.name in SILENT and t.name not in CODE:
            held = open_.setdefault(t.name, [])
            if t.closing:
                if held:
                    out[held.pop()] = k
            elif not t.empty:
                if t.name not in NESTED:
                    held.clear()
                held.append(k)
    return out


#: Elements that a block ends where it begins, the blocks that do so, and those that end another of their kind.
CUT_SHORT = frozenset("p b i em strong a span u font small".split())
CUTTING = frozenset("p div ul ol table section article footer header nav aside form h1 h2 h3 h4 h5 h6 blockquote pre".split())
SELF_ENDING = frozenset("li dd dt tr td th option".split())


def blocks(page: str) -> list[dict]:
    """The text blocks of a page in order: text, words, words in links, kinds of the containers around, tag. Containers that wrap most of the page are read without their
    doubtful kinds."""
    found = tags(page)
    out, wraps = _read(page, found, frozenset())
    return _read(page, found, wraps)[0] if wraps else out


def _read(page: str, found: list[Tag], wraps: frozenset[int]) -> tuple[list[dict], frozenset[int]]:
    """The blocks, and the places (among all elements) of containers that wrap most of the page's words; those in `wraps` have no kind."""
    out: list[dict] = []
    stack: list[tuple[str, str | None]] = []
    sorts: list[str] = []  # of the stack, the kinds
    doubtful: list[tuple[int, int, float]] = []  # of the stack: depth, place and words before of containers whose kind may be wrong
    inside: list[tuple[int, float]] = []  # of those: place and words in it
    elements, said = -1, 0.0
    outer: list[str] = []  # of the stack, the tags that are not inline
    depth: Counter = Counter()  # open elements by tag, and by ("kind", kind)
    first_silent = -1
    text: list[str] = []
    linked = 0

    def push(tag: str, kind: str | None, doubt: bool = False) -> None:
        nonlocal first_silent, elements
        elements += 1
        if elements in wraps:
            kind = None
        elif doubt and kind in KINDS and kind not in ("article", "comment"):
            doubtful.append((len(stack), elements, said))
        if kind in KINDS:
            sorts.append(kind)
        if kind == "silent" and first_silent < 0:
            first_silent = len(stack)
        stack.append((tag, kind))
        depth[tag] += 1
        depth["kind", kind] += 1
        if tag not in INLINE:
            outer.append(tag)

    def pop() -> str:
        nonlocal first_silent
        tag, kind = stack.pop()
        depth[tag] -= 1
        depth["kind", kind] -= 1
        if tag not in INLINE:
            outer.pop()
        if kind in KINDS:
            sorts.pop()
        if doubtful and doubtful[-1][0] == len(stack):
            _, place, before = doubtful.pop()
            inside.append((place, said - before))
        if len(stack) == first_silent:
            first_silent = -1
        return tag

    def flush() -> None:
        nonlocal text, linked, said
        whole = " ".join(html.unescape("".join(text)).split()) if text else ""
        if whole and not depth["kind", "hidden"]:
            n = len(whole.split(" "))
            kinds = {k for k in KINDS if depth["kind", k]}
            if sorts and sorts[-1] != "article":
                kinds.discard("article")  # a menu within an article is a menu
            out.append({"text": whole, "words": n, "links": min(1.0, linked / n), "kinds": kinds, "tag": outer[-1] if outer else ""})
            said += max(0, n - linked)
        text, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and first_silent < 0:
            text.append(piece)
            if depth["a"]:
                linked += len(html.unescape(piece).split())

    ends, at, k = _silent_ends(found), 0, -1
    while (k := k + 1) < len(found):
        t = found[k]
        add(page[at : t.start])
        at, tag = t.end, t.name
        if not tag:
            continue
        if not t.closing and stack and stack[-1][0] == "head" and tag not in HEAD:
            pop()
        if t.closing:
            if tag not in INLINE:
                flush()
            if depth[tag]:
                while pop() != tag:
                    pass
        elif tag in SILENT:
            if tag not in INLINE and tag not in ("svg", "math"):
                flush()
            if t.empty or tag in CODE:
                continue
            # with an end tag the content runs to it; without one the element ends with its parent or where a block begins
            if k in ends:
                k = ends[k]
                at = found[k].end
            else:
                push(tag, "silent")
        elif tag in VOID:
            if tag in ("br", "hr"):
                flush()
        else:
            if tag not in INLINE:
                flush()
                while first_silent >= 0:
                    pop()
                if stack and stack[-1][0] == "head":
                    pop()
                if tag in CUTTING:
                    while stack and stack[-1][0] in CUT_SHORT:
                        pop()
                if tag in SELF_ENDING and stack and stack[-1][0] == tag:
                    pop()
            if not t.empty:
                # a header within an article heads the article
                kind, doubt = (None, False) if tag == "head" else _kind(tag, t.attributes)
                push(tag, None if kind == "header" and depth["kind", "article"] else kind, doubt)
    add(page[at:])
    flush()
    inside += [(place, said - before) for _, place, before in doubtful]
    return out, frozenset(place for place, words in inside if words >= LARGE and words > WRAPPED * said)


def features(found: list[dict]) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    x = np.zeros((len(found), len(FEATURES)))
    with_article = any("article" in b["kinds"] for b in found)
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        x[i, :6] = b["words"], b["links"], before["words"] if before else 0, before["links"] if before else 1, after["words"] if after else 0, after["links"] if after else 1
        for k, kind in enumerate(KINDS):
            x[i, 6 + k] = kind in b["kinds"]
        x[i, 6 + len(KINDS)] = len(b["kinds"] - {"article"})
        x[i, -5:] = with_article and "article" not in b["kinds"], b["tag"][:1] == "h" and b["tag"][1:].isdigit(), b["tag"] in ("li", "dt", "dd", "td", "th"), i / len(found), b["text"][-1] in ".!?…:;\"'”»)"
    return x


def labelled_pages(seed: int, pages: int) -> Iterator[tuple[str, list[int]]]:
    """Pages by hand-written plans, with a mark (1: article) for each of their blocks; words by a fixed rule.

    Every second page has containers whose tags and class names say nothing; what only such names could tell (comments, sidebars of sentences) is left out there.
    """
    rng = np.random.default_rng(seed)
    draw = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi".split()

    def words(n: int, end: str = ".") -> str:
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(n)) + end

    size = lambda *n: int(rng.integers(*n))
    links = lambda n: "".join(f'<li><a href="/{k}">{words(size(1, 3), "")}</a></li>' for k in range(n))
    for page in range(pages):
        plain = page % 2 == 1
        name = lambda: f' class="{words(1, "")}{size(0, 99)}"' if draw.random() < 0.7 else ""
        wrap = [f"<div{name()}>{{}}</div>", "<table><tr><td>{}</td></tr></table>", "<section>{}</section>"][page // 2 % 3] if plain else ["<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', '<div id="content">{}</div>', "<article class='post social'>{}</article>", '<div role="main">{}</div>'][page // 2 % 6]
        marked = wrap.startswith(("<article", "<main")) or "role" in wrap
        body = [(1, f"<h1>{words(size(1, 9), '')}</h1>" if page % 5 else f"<p>{words(size(1, 90), str(rng.choice(['', '.'])))}</p>")]
        for _ in range(size(0, 9)):
            n = int(rng.choice([1, 2, 4, 8, 15, 30, 60, 120]))
            kinds = [f"<p>{words(n)}</p>", f"<p>{words(n)} <a href='/x'>{words(2, '')}</a> {words(4)}</p>", f"<h2>{words(min(n, 6), '')}</h2>", f"<ul><li>{words(min(n, 20))}</li></ul>", f"<blockquote>{words(n)}</blockquote>", f"<p>{words(n, '')}</p>", f"<p><b>{words(n)}</b></p>", f"<p>{words(n)}</p>", f"<p>{words(n, '')}</p>"]
            # lists of links are the article's own only where something says that they stand in it
            kinds += [f"<ul><li><a href='/s'>{words(max(n, 4))}</a></li><li><a href='/t'>{words(6)}</a></li></ul>"] * marked
            body.append((1, kinds[size(0, len(kinds))]))
            if not plain and rng.random() < 0.15:
                body.append((0, f'<div class="{rng.choice(["ad", "advert", "sponsored", "newsletter", "related"])}">{words(size(2, 30))}</div>'))
        if plain:
            plan = [
                (0, f"<div{name()}><ul>{links(size(3, 8))}</ul></div>"),
                (0, f"<div{name()}><a href='/'>{words(size(1, 3), '')}</a></div>"),
                "BODY",
                (0, f"<div{name()}><a href='/y'>{words(3, '')}</a> <a href='/z'>{words(2, '')}</a> | <a href='/w'>{words(1, '')}</a></div>"),
                (0, f"<ul{name()}>{links(size(2, 6))}</ul>"),
            ]
        else:
            plan = [
                (0, f"<{rng.choice(['nav', 'header', 'div'])}><ul>{links(size(3, 8))}</ul></div></nav></header>"),
                (0, f'<div class="{rng.choice(["ad", "ads", "cookie-notice", "banner", "breadcrumb"])}">{words(size(3, 40))}</div>'),
                (0, f"<header>{words(size(1, 12))}</header>"),
                *[(0, f"<div>{words(size(2, 30))}</div>")] * marked,
                "BODY",
                (0, f'<div id="comments"><p>{words(size(5, 80))}</p><p>{words(size(5, 80))}</p></div>'),
                (0, f"<aside><h3>{words(2, '')}</h3><p>{words(size(4, 60))}</p></aside>"),
                (0, f"<form>{words(size(1, 20))}<input></form>"),
                (0, f"<div><a href='/y'>{words(3, '')}</a> <a href='/z'>{words(2, '')}</a></div>"),
                (0, f"<footer>&copy; {words(size(2, 30))}</footer>"),
            ]
        drop = rng.random(len(plan)) < (0.0, 0.35, 0.7, 1.0)[page // 6 % 4]
        marks, source = [], ""
        for k, part in enumerate(plan):
            if part == "BODY" and page % 9 == 4:
                continue
            if part == "BODY":
                source += wrap.format("".join(h for _, h in body))
                marks += [m for m, h in body for _ in blocks(h)]
            elif not drop[k]:
                source += part[1]
                marks += [part[0]] * len(blocks(part[1]))
        yield f"<html><body>{source}</body></html>", marks


@cache
def labelled_blocks(seed: int = 17, pages: int = 360) -> tuple[np.ndarray, np.ndarray]:
    """The small labelled table: features and marks of the blocks of labelled_pages()."""
    x, y = [], []
    for page, marks in labelled_pages(seed, pages):
        found = blocks(page)
        if found and len(found) == len(marks):
            x.append(features(found))
            y += marks
    return np.concatenate(x), np.array(y)


def _grow(x: np.ndarray, y: np.ndarray, depth: int):
    """A tree as nested tuples (feature, threshold, low, high), or 0 or 1."""
    if depth == 0 or len(y) < 6 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = (1e-7, None, None)
    share = y.mean()
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in ((v[1:] + v[:-1]) / 2)[:: max(1, len(v) // 10)]:
            left = x[:, f] <= t
            n = int(left.sum())
            if 2 <= n <= len(y) - 2:
                p, q = y[left].mean(), y[~left].mean()
                gain = share * (1 - share) - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
                if gain > best[0]:
                    best = gain, f, float(t)
    if best[1] is None:
        return int(2 * y.sum() >= len(y))
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[left], y[left], depth - 1), _grow(x[~left], y[~left], depth - 1)


@cache
def tree():
    return _grow(*labelled_blocks(), 14)


def keeps(model, x: np.ndarray) -> np.ndarray:
    """The tree's decision for each row."""
    out = np.zeros(len(x), bool)

    def go(node, at: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[at] = bool(node)
        elif len(at):
            left = x[at, node[0]] <= node[1]
            go(node[2], at[left])
            go(node[3], at[~left])

    go(model, np.arange(len(x)))
    return out


def main_text(pages: list[str], model=None) -> list[tuple[str, int, int]]:
    """(text, blocks, blocks kept) of each page."""
    model = tree() if model is None else model
    found = [blocks(p) for p in pages]
    x = [features(b) for b in found if b]
    keep = iter(keeps(model, np.concatenate(x)).tolist() if x else [])
    out = []
    for b in found:
        chosen = [k for k in b if next(keep)]
        out.append((" ".join(k["text"] for k in chosen), len(b), len(chosen)))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, others ignored) to page_id, url, text, n_chars, n_blocks, n_kept.

    Null and empty pages have an empty text. Whole pages are read in time proportional to their length, also broken ones: open tags end with the page, elements
    whose content is no text with their parent or at the next block, an unclosed quote with its tag. Repeated rows and rows without an id come out one by
    one. An empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    model = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = main_text([h or "" for h in b.column(2).to_pylist()], model)
            yield batch(["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"], b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), np.array([len(g[0]) for g in got], np.int64), np.array([g[1] for g in got], np.int64), np.array([g[2] for g in got], np.int64))

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
