"""HTML extraction by template deduction from the pages of a host.

Block tags under their path and whole texts of blocks are tokens, counted on
every page of a host. Tokens with equal occurrence vectors are an equivalence
class. Vectors are never gathered: each is a sum of hashes of (page, count), so
tasks add up their share and a host may have any number of pages. A class that
nearly every page has once is of the root; one that pages repeat is nested in it.
A second pass validates them: a token of the root needs the same token of the
root before it on nearly every page, a nested one the same slot of the root.
What lies between tokens of the template are slots, and the pass adds up what
they hold over the host: text in links, text that all pages share and text that
varies. The article is the deepest element of the root with most of the text that
varies and its heading; where the root has elements that HTML calls article or
main, the one of these with most of it. A slot mostly of links is a menu, and a
text that nearly all pages have is the template's: both are left out, but for pages
that they make up at least half of, which are copies and show no template.
Regions that HTML calls no content are left out, and those named as such in a class,
id or role, unless the article is in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import mix64, passengers, pieces
from lotwise.sources.workspace import materialize

#: Hosts with fewer pages share one template with all such hosts: a page alone is all template.
LEAST_PAGES = 4
#: Least share of a host's pages with markup that have a token of the template.
SUPPORT = 0.9
#: Share of the text that varies that the article has at least, where no tag says which element it is.
MOST = 0.8
#: Least share of a slot's text in links that makes it a menu, and of all text that is not named as
#: chrome; below that, names are not believed when the article is chosen.
LINKED = 0.5
BELIEVED = 0.2
PIECE = 4 << 20
EVERYWHERE = ""

#: Elements without content, elements whose content is no text, and
#: elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements and words of class or id attributes that mark a region as no part of the article.
CHROME = frozenset("nav header footer aside form menu dialog button select option head script style noscript template iframe".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar side aside widget related notice notices cookie cookies consent popup modal overlay "
    "newsletter subscribe subscription signup login form search share sharing social comment comments reply replies "
    "respond discussion disqus".split()
)
#: Those of the words that say so only as a whole name: a section-header is none of a page.
WHOLE = frozenset("header side search".split())
MAIN = frozenset(["article", "main"])
#: Elements that no name makes chrome, and those that only a whole name does.
TRUSTED = frozenset("html body main".split())

#: Implied end tags of HTML. Elements that inline markup does not reach across, and
#: those that hide what is open around them from an end tag.
SOLID = BLOCKS | {"button", "object"}
SCOPE = frozenset("html table td th caption object".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_TABLE = frozenset(["html", "table"])
_PARAGRAPH = (frozenset("p".split()), SCOPE | {"button"})
_LISTED = BLOCKS - {"address", "div", "p"}
#: End tag: the open elements one of which it ends, and those where the search stops.
ENDS = {"p": _PARAGRAPH, "li": (frozenset(["li"]), SCOPE | {"ol", "ul"})}
ENDS |= {tag: (HEADS, SCOPE) for tag in HEADS}
ENDS |= {tag: (frozenset([tag]), _TABLE) for tag in "table thead tbody tfoot caption tr td th".split()}
ENDS |= {tag: (frozenset([tag]), frozenset()) for tag in ("body", "html")}
#: Start tag: the same for what it ends, one after the other.
IMPLIED = {
    tag: [_PARAGRAPH]
    for tag in BLOCKS - set("body html head option select caption legend thead tbody tfoot tr td th".split())
}
IMPLIED["li"] = [(frozenset(["li"]), _LISTED), _PARAGRAPH]
IMPLIED |= {tag: [(frozenset(["dd", "dt"]), _LISTED), _PARAGRAPH] for tag in ("dd", "dt")}
IMPLIED |= {tag: [_PARAGRAPH, (HEADS, SOLID)] for tag in HEADS}
IMPLIED["option"] = [(frozenset(["option"]), SOLID)]
IMPLIED |= {tag: [(frozenset(["td", "th", "caption"]), _TABLE | {"tr"})] for tag in ("td", "th")}
IMPLIED["tr"] = [(frozenset(["tr", "caption"]), _TABLE)]
IMPLIED |= {tag: [(frozenset("thead tbody tfoot caption".split()), _TABLE), (frozenset(["tr"]), _TABLE)] for tag in "thead tbody tfoot".split()}

_MARK = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_WORDS = re.compile(r"[^a-z]+")
#: Kinds of chrome: by a name that the page's author gave, by the tag.
NAMED, TAGGED = 1, 2


class Token:
    """A piece of markup: what tokens are the same is told by ``name``, which has the path to it."""

    __slots__ = ("name", "tag", "closing", "chrome", "main")

    def __init__(self, name: str, tag: str, closing: bool, chrome: int, main: bool):
        self.name, self.tag, self.closing, self.chrome, self.main = name, tag, closing, chrome, main


def _chrome(tag: str, names: list[str]) -> int:
    """Whether an element is chrome: 0, ``NAMED`` or ``TAGGED``."""
    if tag in CHROME:
        return TAGGED
    if not names or tag in TRUSTED:
        return 0
    if any(n in CHROME_WORDS for n in names):
        return NAMED
    if tag in HEADS or tag in MAIN:
        return 0
    return NAMED if any(w in CHROME_WORDS and w not in WHOLE for n in names for w in _WORDS.split(n)) else 0


def parse(html: str) -> list[Token | str]:
    """Tokens and texts of a page, in order.

    The path of a tag is the open elements that are no paragraph or inline
    element, since authors leave those open. Contents of scripts, styles and the
    like are dropped; a tag or comment that is cut off ends the page.
    """
    out: list[Token | str] = []
    path: list[str] = []
    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            out.append(html[at:])
            break
        if start > at:
            out.append(html[at:start])
        mark = _MARK.match(html, start)
        if not mark:
            nxt = html[start + 1 : start + 2]
            if (nxt.isalpha() or nxt in ("/", "!")) and nxt:
                break
            out.append("<")
            at = start + 1
            continue
        at = mark.end()
        closing, tag, attributes = mark.groups()
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in path:
                while path.pop() != tag:
                    pass
            out.append(Token("/".join([*path, "", tag]), tag, True, 0, False))
            continue
        names = [n for found in _NAMES.findall(attributes) for n in "".join(found).lower().split()] if attributes else []
        words = {w for n in names for w in _WORDS.split(n) if w}
        label = tag + "".join(sorted(f".{w}" for w in words))
        out.append(Token("/".join([*path, label]), tag, False, _chrome(tag, names), tag in MAIN))
        if tag in _RAW_END and not attributes.rstrip().endswith("/"):
            end = _RAW_END[tag].search(html, at)
            if not end:
                break
            at = end.end()
            out.append(Token("/".join([*path, "", tag]), tag, True, 0, False))
        elif tag not in VOID and tag in BLOCKS and tag not in ("p", "li", "option", "dd", "dt", "tr", "td", "th"):
            path.append(tag)
    return out



def folded(pieces_of_text: list[str]) -> str:
    """A block's text: references decoded, runs of white space as one space, trimmed."""
    return " ".join(unescape("".join(pieces_of_text)).split())


def digest(value: str) -> int:
    """A signed 64-bit hash of a block's text."""
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "replace")) - (1 << 63)


def occurrences(tokens: list[Token | str]) -> dict[str, int]:
    """How often a page has each block tag, by name, and each whole text of a block, by ``#`` and its digest."""
    counts: dict[str, int] = {}
    text: list[str] = []

    def block() -> None:
        value = folded(text)
        if value:
            name = f"#{digest(value)}"
            counts[name] = counts.get(name, 0) + 1
        text.clear()

    for token in tokens:
        if isinstance(token, str):
            text.append(token)
        elif token.tag in SOLID or token.chrome:
            block()
            if token.tag in SOLID:
                counts[token.name] = counts.get(token.name, 0) + 1
        elif token.tag == "br":
            text.append(" ")
    block()
    return counts


def vectors(pages: DataFrame) -> DataFrame:
    """Rows (host, token, pages, vector, once): each token's occurrence vector as a sum of hashes.

    The empty token stands for any, so its pages are those with markup.

    ``pages`` has (host, page, html), with ``page`` a number of the row. Tasks add up what
    they hold before anything is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            sums: dict[tuple[str, str], list[int]] = {}
            hosts, numbers = batch.column("host").to_pylist(), batch.column("page").to_pylist()
            for host, number, value in zip(hosts, numbers, batch.column("html").to_pylist()):
                counts = occurrences(parse(value or ""))
                if any(not name.startswith("#") for name in counts):
                    counts[""] = 1
                seeds = np.array(list(counts.values()), np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number % (1 << 64))
                for (name, count), h in zip(counts.items(), mix64(seeds).tolist()):
                    kept = sums.setdefault((host, name), [0, 0, 0])
                    kept[0] += 1
                    kept[1] += h >> 16  # sums of 48-bit hashes stay within 64 bits for 65,000 pages, and wrap alike after
                    kept[2] += count == 1
            wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()),
                    pa.array([v[0] for v in sums.values()], pa.int64()),
                    pa.array([wrap(v[1]) for v in sums.values()], pa.int64()),
                    pa.array([v[2] for v in sums.values()], pa.int64()),
                ],
                names=["host", "token", "pages", "vector", "once"],
            )

    found = pages.mapInArrow(work, "host string, token string, pages long, vector long, once long")
    added = F.sum(F.col("vector").cast("decimal(38,0)")) % F.lit(1 << 62).cast("decimal(38,0)")
    return found.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), added.cast("long").alias("vector"), F.sum("once").alias("once")
    )


def classes(found: DataFrame) -> DataFrame:
    """Rows (host, total, root, nested, texts): the classes of the tokens that enough pages of a host have.

    A class is the tags with one occurrence vector. ``root`` has the tags of those that pages have
    once, ``nested`` those of classes that pages repeat; a lone tag without a partner
    that occurs alike is no class of the latter kind. ``texts`` are digests of blocks.
    Pages without markup do not count. A page that is cut off lacks the tokens
    behind the cut: they are a class of their own, with one page less. No page has
    more tokens than its length, so neither has a row, by more than a ninth.
    """
    # Written, so that its size is known when the join is planned: tokens of a large host stay where they are.
    totals = materialize(found.where(F.col("token") == "").select("host", F.col("pages").alias("total")), "totals")
    kept = found.where(F.col("token") != "").join(totals, "host").where(F.col("pages") >= F.col("total") * SUPPORT)
    kept = kept.withColumn("text", F.col("token").startswith("#"))
    one = kept.groupBy("host", "total", "text", "vector", (F.col("once") == F.col("pages")).alias("single")).agg(
        F.collect_list("token").alias("tokens")
    )

    def members(condition: Column) -> Column:
        return F.array_sort(F.flatten(F.collect_list(F.when(condition, F.col("tokens")))))

    tags = ~F.col("text")
    return one.groupBy("host", "total").agg(
        members(tags & F.col("single")).alias("root"),
        members(tags & ~F.col("single") & (F.size("tokens") > 1)).alias("nested"),
        members(F.col("text")).alias("texts"),
    )


@dataclass(frozen=True)
class Template:
    """What was deduced of a host: names of tags, the article's start tag, slots that are menus, digests of texts."""

    root: frozenset[str] = frozenset()
    nested: frozenset[str] = frozenset()
    article: str = ""
    menus: frozenset[str] = frozenset()
    texts: frozenset[str] = frozenset()


@dataclass
class Block:
    """A block's text with the slot it is in, by the tag that opens the slot, and the open elements of the root."""

    value: str
    slot: str
    inside: tuple[str, ...]
    main: bool
    named: bool
    heading: bool
    linked: int


def regions(tokens: list[Token | str], template: Template, mains: frozenset[str] = frozenset()) -> list[Block]:
    """Blocks of a page outside of what HTML calls no content.

    ``main`` says whether one is in the template's article, or in an element of ``mains``;
    ``named`` whether it is in something whose name says chrome, which what
    holds the article is not. Elements are nested as HTML does it: a start tag ends the open ones it implies
    the end of, an end tag ends all that is open within its element, and one whose
    element is not open ends nothing. What a slot between tokens of the root leaves
    open ends with the slot. Inline markup ends no block, and a line break is
    white space.
    """
    out: list[Block] = []
    stack: list[list] = []  # tag, chrome, main, name if of the root
    text: list[str] = []
    slot, linked, in_link, state = "", 0, False, 0
    def block() -> None:
        nonlocal linked
        value = folded(text)
        if value and state < TAGGED:
            out.append(Block(
                value, slot, tuple(e[3] for e in stack if e[3]), any(e[2] for e in stack), state == NAMED,
                any(e[0] == "h1" for e in stack), min(linked, len(value)),
            ))
        text.clear()
        linked = 0

    def place(tags: frozenset[str], walls: frozenset[str]) -> int:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in tags:
                return at
            if stack[at][0] in walls:
                break
        return -1

    for token in tokens:
        if isinstance(token, str):
            if state < TAGGED:
                text.append(token)
                if in_link:
                    linked += len(token)
            continue
        tag = token.tag
        if tag == "a":
            in_link = not token.closing
        solid = tag in SOLID
        if solid or token.chrome:
            block()
        elif tag == "br":
            text.append(" ")
            continue
        elif not any(e[0] == tag for e in stack):
            continue
        if solid:
            in_link = False
            if token.name in template.root or token.name in template.nested:
                slot = token.name
        if tag in VOID and tag != "hr" or tag in RAW:
            continue
        kept = solid and token.name in template.root
        if token.closing:
            at = place(*ENDS.get(tag, (frozenset([tag]), SCOPE if solid else SOLID)))
            if at >= 0:
                if not solid and stack[at][1]:
                    block()
                del stack[at:]
            elif tag in FORMATTING:
                # Ends before the blocks opened in it do.
                at = place(frozenset([tag]), frozenset())
                if at >= 0:
                    if stack[at][1]:
                        block()
                    del stack[at]
        else:
            for ended in IMPLIED.get(tag, ()):
                at = place(*ended)
                if at >= 0:
                    del stack[at:]
            while kept and stack and not stack[-1][3]:
                stack.pop()
            if tag not in VOID:
                article = token.name == template.article
                if article:
                    for held in stack:  # what holds the article is no chrome
                        held[1] = 0
                stack.append([tag, 0 if article else token.chrome, article or token.name in mains, token.name if kept else ""])
        state = max((e[1] for e in stack), default=0)
    block()
    return out


def shared(block: Block, template: Template) -> bool:
    """Whether nearly all pages of the host have the block's text."""
    return bool(template.texts) and f"#{digest(block.value)}" in template.texts


def known(row: dict) -> Template:
    """The template of a row of ``classes`` or ``templates``."""
    sets = {n: frozenset(row.get(n) or ()) for n in ("root", "nested", "menus", "texts")}
    return Template(article=row.get("article") or "", **sets)


class Templates:
    """Templates of the rows of a batch, each made once; forgotten with the batch."""

    def __init__(self, batch: pa.RecordBatch, column: str = "template"):
        self.values, self.hosts, self.made = batch.column(column), batch.column("_host"), {}

    def __getitem__(self, i: int) -> Template:
        host = self.hosts[i].as_py()
        if host not in self.made:
            self.made[host] = known(self.values[i].as_py() or {})
        return self.made[host]


#: Facts of the second pass: a tag and what comes before it, what a slot holds, what an element holds.
ORDER, SLOT, ELEMENT = 0, 1, 2


def facts(pages: DataFrame) -> DataFrame:
    """Rows (host, kind, name, other, pages, chars, linked, clean, heading), added up over the pages of a host.

    ``pages`` has (_host, html, template). For ``ORDER`` the other is the tag of the
    root that comes before; only tags of the template have rows, so a host has few. ``chars``
    is text that varies, ``clean`` that outside of what is named as chrome.
    """
    schema = "host string, kind int, name string, other string, pages long, chars long, linked long, clean long, heading long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            sums: dict[tuple[str, int, str, str], list[int]] = {}
            made = Templates(batch)

            def add(key: tuple[str, int, str, str], *values: int) -> None:
                kept = sums.setdefault(key, [0] * 5)
                for i, value in enumerate(values):
                    kept[i] += value

            for i, host in enumerate(batch.column("_host").to_pylist()):
                template = made[i]
                tokens = parse(batch.column("html")[i].as_py() or "")
                before, seen = "", set()
                for token in tokens:
                    if isinstance(token, str) or token.name not in template.root and token.name not in template.nested:
                        continue
                    if (token.name, before) not in seen:
                        seen.add((token.name, before))
                        add((host, ORDER, token.name, before), 1)
                    if token.name in template.root:
                        before = token.name
                for found in regions(tokens, template):
                    n = len(found.value)
                    add((host, SLOT, found.slot, ""), 1, n, found.linked)
                    if shared(found, template):
                        continue
                    clean = 0 if found.named else n
                    for name in {"", *found.inside}:
                        add((host, ELEMENT, name, ""), 1, n, found.linked, clean, n if found.heading else 0)
            names = ["host", "kind", "name", "other", "pages", "chars", "linked", "clean", "heading"]
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5]
            columns = [[*k, *v] for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in columns], t) for j, t in enumerate(types)], names=names)

    measures = ("pages", "chars", "linked", "clean", "heading")
    return pages.mapInArrow(work, schema).groupBy("host", "kind", "name", "other").agg(*[F.sum(m).alias(m) for m in measures])


def deduce(row: dict, found: list[dict]) -> dict:
    """The valid part of a host's template, its article and its menus, from the facts of the host."""
    root, nested, total = set(row["root"] or ()), set(row["nested"] or ()), row["total"]
    best: dict[str, int] = {}
    for f in found:
        if f["kind"] == ORDER:
            best[f["name"]] = max(best.get(f["name"], 0), f["pages"])
    # A page may lack a token, and another one before it: both may happen to a tenth.
    least = total * (2 * SUPPORT - 1)
    valid = {name for name, pages in best.items() if pages >= least}
    root, nested = root & valid, nested & valid
    slots = {f["name"]: f for f in found if f["kind"] == SLOT}
    menus = [n for n, f in slots.items() if n in nested | root and f["linked"] > f["chars"] * LINKED]
    elements = {f["name"]: f for f in found if f["kind"] == ELEMENT and (not f["name"] or f["name"] in root)}
    everything = elements.get("")
    article = ""
    if everything:
        by = "clean" if everything["clean"] >= everything["chars"] * BELIEVED else "chars"
        tagged = [n for n in elements if n and n.rsplit("/", 1)[-1].split(".", 1)[0] in MAIN and elements[n][by]]
        inner = [n for n in tagged if n.rsplit("/", 1)[-1].startswith("article")] or tagged
        if inner:
            article = max(inner, key=lambda n: (elements[n][by], n))
        else:
            enough = [
                n for n, f in elements.items()
                if n and f[by] >= everything[by] * MOST and f["heading"] >= everything["heading"] * MOST
            ]
            article = max(enough, key=lambda n: (n.count("/"), n), default="")
    return {**row, "root": sorted(root), "nested": sorted(nested), "menus": sorted(menus), "article": article}


TEMPLATE = "root array<string>, nested array<string>, menus array<string>, texts array<string>, article string"


def templates(found: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (host, template), from ``classes`` and ``facts``; a host has as many facts as its template has tags, or few more."""
    listed = held.groupBy("host").agg(F.collect_list(F.struct(*[c for c in held.columns if c != "host"])).alias("facts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [deduce(r, r["facts"] or []) for r in batch.to_pylist()]
            names = ("root", "nested", "menus", "texts")
            columns = [pa.array([r["host"] for r in rows], pa.string())]
            columns += [pa.array([r[n] or [] for r in rows], pa.list_(pa.string())) for n in names]
            columns.append(pa.array([r["article"] for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["host", *names, "article"])

    made = found.join(listed, "host", "left").mapInArrow(work, f"host string, {TEMPLATE}")
    return made.select("host", F.struct("root", "nested", "menus", "texts", "article").alias("template"))


def main_text(html: str | None, template: Template) -> str:
    """Blocks of the article, joined by two newlines.

    Where the page has the template's article, its slots outside chrome, without menus
    and texts of the template; else articles that only this page has; else all
    slots outside chrome, or if there are none the articles in what is named as chrome. Menus and texts stay where they are half of it or more: such
    a page is a copy of others.
    """
    tokens = parse(html or "")
    found = regions(tokens, template)
    if not any(b.main for b in found):
        own = frozenset(t.name for t in tokens if not isinstance(t, str) and t.main and not t.closing and not t.chrome)
        if own:
            found = regions(tokens, template, own)
    inside = [b for b in found if b.main and not b.named] or [b for b in found if not b.named] or [b for b in found if b.main]
    slots = [b for b in inside if b.slot not in template.menus and not shared(b, template)]
    if 2 * sum(len(b.value) for b in slots) > sum(len(b.value) for b in inside):
        inside = slots
    return "\n\n".join(b.value for b in inside)


@passengers()
def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Every row of ``pages`` without the html but with ``text`` and ``n_chars``.

    Null html counts as empty and gives an empty text; a null URL puts the page
    among those of small hosts. Repeated rows are pages like any other. A column
    ``text`` or ``n_chars`` of the input is replaced; any other may have any name.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(EVERYWHERE)))
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    counted = materialize(pages.select(host.alias("_own")).groupBy("_own").agg(F.count(F.lit(1)).alias("total")), "hosts")
    # Hosts are few against pages; Spark broadcasts them below its threshold.
    large = counted.where(F.col("total") >= LEAST_PAGES).select("_own")
    rows = pages.withColumn("_own", host).join(large.withColumn("_large", F.lit(True)), "_own", "left")
    rows = rows.withColumn("_host", F.when(F.col("_large"), F.col("_own")).otherwise(EVERYWHERE))
    numbered = rows.select(
        F.col("_host").alias("host"), F.xxhash64(url, html).alias("page"), F.col(html).alias("html")
    )
    # Written, as they are read more than once.
    found = materialize(classes(materialize(vectors(numbered), "tokens")), "classes")
    first = found.select(F.col("host").alias("_of"), F.struct("root", "nested", "texts").alias("template"))
    held = facts(rows.join(first, F.col("_host") == F.col("_of"), "left").select("_host", F.col(html).alias("html"), "template"))
    last = materialize(templates(found, held), "templates")
    joined = rows.join(last, F.col("_host") == F.col("host"), "left").select(
        F.col(html).alias("_html"), "_host", F.col("template").alias("template"), *[F.col(f"`{c}`") for c in others]
    )
    fields = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in others), "text string", "n_chars long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            made = Templates(batch)
            texts = [main_text(value.as_py(), made[i]) for i, value in enumerate(batch.column("_html"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*others, "text", "n_chars"],
            )

    return joined.mapInArrow(work, schema)
