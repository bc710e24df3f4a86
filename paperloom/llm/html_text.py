"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. In the first pass a block is decided by where it stands (menus, footers,
forms, adverts, comments and the like are out), by its link density, and by its length with its density of stop words:
running text is in, lists of links and long text without stop words are out. Inside an element that holds the article,
text without stop words is out only if a part of it is links, as articles have tables and code. Short blocks stay
ambiguous. In the second pass each ambiguous block takes the label of the nearest block of its own container that was
decided by what it says, so that the head of a list of links goes with its list; of two as near, one that is in counts.
Outside a container it is the nearest decided block at all. Every page is read whole, in time linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a block that can be decided by stop words, and of one for which fewer suffice.
SHORT, LONG = 60, 120
MANY_STOPS, SOME_STOPS, FEW_STOPS = 0.2, 0.12, 0.02
#: Share of a block in links that puts it out, and that does so inside an article if it has no stop words.
MOST_LINKS, SOME_LINKS = 0.5, 0.2

#: Stop words of English, French, German and Spanish (fixed values).
STOPS = frozenset("""
the of and to a in is it that this was for on are with as be by at from or an have not but they which he she you we
le la les de des du et un une en que qui est dans pour pas sur au avec par plus ce il elle ne se sont
der die das und ist den dem von zu mit sich auf nicht ein eine einer für im auch es an als bei nach wie aus wird
el los las y del por con su para como al lo más se una no sus ha son
""".split())
#: Elements whose content is no text of the page (fixed values).
DROPPED = frozenset("head title noscript template iframe object embed svg math canvas audio video textarea select button datalist map".split())
#: Elements that are never part of an article (fixed values).
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
#: Words in class, id or role that mark what is not the article (fixed values).
OUT_WORDS = frozenset("""
ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar
navigation breadcrumb breadcrumbs footer reply replies respond discussion disqus cookie cookies consent notice
notices newsletter subscribe signup login share sharing social related recommended popup modal overlay toolbar
pagination pager widget widgets hidden copyright legal gdpr alert skip topbar contentinfo complementary search
dialog masthead form
""".split())
IN_WORDS = frozenset("article content main post entry story".split())
VOID = frozenset("area base br col hr img input link meta param source track wbr".split())
#: Elements that part blocks but are often left open: they mark the block that they begin.
LEAVES = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
BLOCKS = LEAVES | OUTSIDE | frozenset("html body div article main section header ul ol dl table thead tbody tfoot caption blockquote pre figure figcaption address fieldset legend details summary center hr".split())

# A quoted value ends at its quote, however long. One never closed is the last of its page, so at most one scan is in vain.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+)*+)(?:>|\Z)""", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "xmp", "noembed", "noframes")}
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def mark(name: str, attributes: str, inside: bool) -> int:
    """-1 for an element that is not of the article, 1 for one that holds it, 0 for others; ``inside``: in such a one."""
    if name in OUTSIDE or name == "header" and not inside:
        return -1
    found = 1 if name in ("article", "main") else 0
    if "=" in attributes or "hidden" in attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return -1
            if key in ("class", "id", "role") and name not in ("html", "body"):
                words = {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", value))}
                if words & OUT_WORDS or any(w.startswith("comment") for w in words) or "header" in words and not inside and found == 0:
                    return -1
                if words & IN_WORDS:
                    found = 1
    return found


class Block:
    """``out``: its place decides; ``home``: number of the article that it is in, 0 outside one; ``linked``: characters in links."""

    __slots__ = ("home", "label", "out", "text")

    def __init__(self, text: str, linked: int, out: bool, home: int):
        self.text, self.out, self.home = text, out, home
        self.label = -1 if out else decided(text, linked, home)


def decided(text: str, linked: int, home: int) -> int:
    """First pass: 1 in, -1 out, 0 ambiguous."""
    if linked > MOST_LINKS * len(text):
        return -1
    if len(text) < SHORT:
        return 0
    words = [w.lower() for w in text.replace(",", " ").replace(".", " ").split()]
    density = sum(w in STOPS for w in words) / max(len(words), 1)
    if density >= (SOME_STOPS if len(text) >= LONG else MANY_STOPS):
        return 1
    return -1 if density < FEW_STOPS and (linked > SOME_LINKS * len(text) if home else len(text) >= LONG) else 0


def blocks(html: str) -> list[Block]:
    """The blocks of a page, in order, after the first pass."""
    found: list[Block] = []
    parts: list[str] = []
    #: open elements: name, mark, article number before, dropped
    stack: list[tuple[str, int, int, bool]] = []
    state = {"out": 0, "dropped": 0, "home": 0, "homes": 0, "link": 0, "linked": 0, "leaf": 0}

    def say(raw: str) -> None:
        if state["dropped"] or not raw:
            return
        parts.append(raw)
        if state["link"]:
            state["linked"] += len(" ".join(unescape(raw).split()))

    def close_block() -> None:
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append(Block(text, state["linked"], state["out"] > 0 or state["leaf"] < 0, state["home"]))
        parts.clear()
        state["linked"] = 0

    def pop() -> None:
        _, m, home, dropped = stack.pop()
        state["out"] -= m < 0
        state["dropped"] -= dropped
        state["home"] = home

    at, open_names = 0, {}
    for m in iter(lambda: _TAG.search(html, at), None):
        say(html[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if name in BLOCKS or name in DROPPED:
            close_block()
            state["leaf"] = 0
        elif name == "br" or name == "img":
            say(" ")
        if name in VOID:
            continue
        if m.group(1):
            if name == "a":
                state["link"] = 0
            elif open_names.get(name, 0):
                while True:
                    last = stack[-1][0]
                    pop()
                    open_names[last] -= 1
                    if last == name:
                        break
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(html, at)
            at = end.start() if end else len(html)
            continue
        if name == "a":
            state["link"] = 1
            continue
        kind = mark(name, m.group(3), state["home"] > 0)
        if name in LEAVES:
            state["leaf"] = kind
            continue
        if name == "body":  # an open head ends here
            while stack:
                open_names[stack[-1][0]] -= 1
                pop()
        dropped = name in DROPPED and not m.group(3).endswith("/")
        if kind == 0 and not dropped and name not in BLOCKS and name != "span":
            continue
        stack.append((name, kind, state["home"], dropped))
        open_names[name] = open_names.get(name, 0) + 1
        state["out"] += kind < 0
        state["dropped"] += dropped
        if kind > 0 and not state["home"]:
            state["homes"] += 1
            state["home"] = state["homes"]
    say(html[at:] if not html.startswith("<", at) or not re.match(r"<[/!A-Za-z]", html[at : at + 2]) else "")
    close_block()
    return found


def main_blocks(found: list[Block]) -> list[str]:
    """Second pass: the texts that are in, after ambiguous blocks have taken the label of their nearest decided neighbour."""
    n = len(found)
    # nearest decided block on either side: of the same container, and at all
    best: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for order in (range(n), range(n - 1, -1, -1)):
        last, by_home = None, {}
        for i in order:
            b = found[i]
            if b.label:
                last = i
                if not b.out:
                    by_home[b.home] = i
            elif b.home:
                if b.home in by_home:
                    best[i].append((abs(i - by_home[b.home]), -found[by_home[b.home]].label))
            elif last is not None:
                best[i].append((abs(i - last), -found[last].label))
    out = []
    for b, near in zip(found, best, strict=True):
        # of a container in which nothing is decided, short text is the article
        label = b.label or (-min(near)[1] if near else (1 if b.home or n == 1 else -1))
        if label > 0:
            out.append(b.text)
    return out


def main_text(html: str | None) -> str:
    return " ".join(main_blocks(blocks(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages`` (page_id, url, html).

    A null or empty html, and one without text, gives an empty text. Broken markup is read as far as it goes, and a page
    whole, however long. Repeated rows get equal results; null ids and urls stay null. Other columns are not used, also
    if they are named like the result's. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
