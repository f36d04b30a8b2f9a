"""Main text of web pages by deducing the template of each host.

A page is a sequence of tokens: tags under the path of containers they stand in
(with class, id and role), and whole text nodes under their path. Tokens of a
host that occur equally often in every one of its pages, page by page, have the
same occurrence vector and form an equivalence class. A class is valid if it is
supported by enough pages, has two tokens or more, and its tokens come in the
same order in every page, as often as they come. Valid classes nest by their position into the host's
template: a class with text lies in one place between two tokens of another, always, or never. Of two
that do not, the one of more pages stays, then the one of more tokens, then that of the
least token; classes of tags alone hold no constants and bar none. What lies between
template tokens are the slots; text nodes of the
template itself are constants. The slots of the article, or of the whole page
where none is marked, are extracted without those in menus, page headers,
footers, sidebars, notices, adverts, forms and comments.

Occurrence vectors are never built: a token's vector is the XOR of one hash per
page and count, so classes come from two aggregations that combine in the map
stage, however many pages a host has. Templates go to the pages by a broadcast
while they are few (their number is checked) and by a join on the host beyond.

Defined cases: a null or empty page has an empty text; a null url is a host of
its own; pages of a host with the same tokens, under one url or several, are
extracted each and support a class like one page;
hosts with fewer than ``support`` different pages have no template and only the tags decide;
paragraphs and headings of an article are never constants; unclosed and stray
tags are allowed; further columns are dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.session import materialize

ATTRIBUTES = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
#: Elements whose content is no text of the page.
RAW = "script|style|noscript|iframe|textarea|template|svg|math|select|object|button"
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<raw>{RAW})\b{ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"""
    rf"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>{ATTRIBUTES})>|(?P<text>[^<]+|<)""", re.I | re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Elements that make up a path.
CONTAINERS = set("html head body nav header footer aside section article main div ul ol dl table form title "
                 "figure details dialog menu".split())
#: Elements that end a block of text.
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd tr blockquote pre hr address fieldset figcaption summary "
                          "caption legend thead tbody tfoot".split())
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td".split())
#: Elements, and words of class, id or role, that hold no main text.
ASIDE = set("nav footer aside form title menu dialog head".split())
WORDS = set("ad ads advert advertisement adverts banner sponsor sponsored promo promotion menu nav navbar navigation "
            "breadcrumb breadcrumbs sidebar aside footer cookie cookies consent notice notices popup modal newsletter "
            "subscribe subscription share sharing social comment comments reply replies disqus related recommended "
            "widget login signup search copyright toolbar masthead topbar overlay alert contentinfo complementary "
            "dialog".split())
#: Those that only count outside an article, where a header may hold its title.
OUTER = {"header"}


class Element:
    """An open container."""

    __slots__ = ("name", "key", "aside", "outer", "article", "closed")

    def __init__(self, name: str, attrs: str):
        marks = " ".join(f"{k.lower()}={a or b or c}" for k, a, b, c in NAMED.findall(attrs)) if attrs else ""
        words = set(re.split(r"[^a-z0-9]+", marks.lower())) - {"class", "id", "role"} if marks else set()
        self.name, self.key, self.closed = name, f"{name} {marks}", False
        self.article = name in ("article", "main") or "role=main" in marks.lower()
        self.aside = name in ASIDE or bool(words & WORDS)
        self.outer = name in OUTER or bool(words & OUTER)


def scan(page: str) -> tuple[list[tuple], bool]:
    """Tokens of a page as ``(key, kind, text, path, textual)``, and whether it marks an article."""
    stack: list[Element] = []
    found, path, textual, article = [], "", False, False
    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            if not text.isspace():
                found.append((f"{path}|{text.strip()}", "text", text, tuple(stack), textual))
            elif found and found[-1][1] == "text":
                found.append(("", "space", text, tuple(stack), textual))
            continue
        if (name := m["name"]) is None:
            continue
        name = name.lower()
        if m["end"]:
            key = f"{path}</{name}"
            if name in CONTAINERS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        stack[k].closed = True
                        del stack[k:]
                        break
                path = "/".join(e.key for e in stack)
            textual = False if name in TEXTUAL else textual
        else:
            key = f"{path}<{name}"
            if name in CONTAINERS:
                element = Element(name, m["attrs"])
                key = f"{path}<{element.key}"
                article |= element.article
                if not m["attrs"].endswith("/"):
                    stack.append(element)
                    path = f"{path}/{element.key}" if path else element.key
            textual = name in TEXTUAL if name in BLOCKS else textual
        found.append((key, "block" if name in BLOCKS else "space" if name in ("br", "td", "th") else "tag", "",
                      tuple(stack), textual))
    return found, article


def inside(stack: tuple[Element, ...], article: bool) -> bool:
    """Whether a text under these containers belongs to the main text."""
    first = next((k for k, e in enumerate(stack) if e.article), None)
    if first is None:
        return not article and not any(e.aside or e.outer for e in stack)
    if any(e.aside and e.closed for e in stack[:first]):  # an unclosed menu does not swallow the article
        return False
    return not any(e.aside for e in stack[first:])


def main_text(page: str, template: frozenset[int]) -> str:
    """The slots of a page's main text, one line per block."""
    tokens, article = scan(page)
    blocks, parts = [], []
    for key, kind, text, stack, textual in tokens:
        if kind == "block":
            blocks.append("".join(parts))
            parts = []
        elif kind == "text":
            constant = not (textual and article) and token_hash(key) in template
            if not constant and inside(stack, article):
                parts.append(entities.unescape(text))
        elif kind == "space":
            parts.append(" ")
    blocks.append("".join(parts))
    lines = (" ".join(b.split()) for b in blocks)
    return "\n".join(b for b in lines if b)


def token_hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)


def occurrences(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Per page its tokens, in the order of their first, and where each occurs."""
    for part in pages:
        rows = []
        for page in part:
            places: dict[int, list[int]] = {}
            texts = set()
            for k, (key, kind, *_) in enumerate(t for t in scan(page)[0] if t[0]):
                places.setdefault(h := token_hash(key), []).append(k)
                if kind == "text":
                    texts.add(h)
            rows.append([{"token": k, "text": k in texts, "at": at} for k, at in places.items()])
        yield pd.DataFrame({"tokens": rows})


def relations(classes: list[tuple[int, int, list[int]]]) -> dict[tuple[int, int, int], int]:
    """How often classes lie inside another in a page: ``(inner, outer, slot)``, with slot -1 where they cross.

    ``classes`` has name, size and the places of all tokens of each; slot k of a class follows its k-th token.
    """
    found: dict[tuple[int, int, int], int] = {}
    opened: list[list[int]] = []
    for _, name, k, size in sorted((at, name, i % size, size) for name, size, spots in classes
                                   for i, at in enumerate(spots)):
        if not k:
            for outer, slot in opened:
                found[name, outer, slot] = found.get((name, outer, slot), 0) + 1
            opened.append([name, 1])
            continue
        mine = max(i for i, (other, _) in enumerate(opened) if other == name)
        for other, _ in opened[mine + 1:]:
            found[other, name, -1] = found.get((other, name, -1), 0) + 1
        if k == size - 1:
            del opened[mine]
        else:
            opened[mine][1] = k + 1
    return found


def not_nested(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """``host, name`` of classes that do not nest with one that stays.

    ``placed`` has ``host, row, name, size, spots`` by page, ``classes`` has ``host, name, pages, size, least``.
    """
    @F.pandas_udf("array<struct<inner bigint, outer bigint, slot int, n int>>")
    def inside(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: [{"inner": i, "outer": o, "slot": s, "n": n} for (i, o, s), n in relations(
            [(c["name"], c["size"], c["spots"]) for c in page]).items()])

    by_page = placed.groupBy("host", "row").agg(F.collect_list(F.struct("name", "size", "spots")).alias("c"))
    met = by_page.where(F.size("c") > 1).select("host", F.explode(inside("c")).alias("r")).groupBy(
        "host", "r.inner", "r.outer").agg(F.min("r.slot").alias("low"), F.max("r.slot").alias("high"),
                                          F.sum(F.when(F.col("r.slot") > 0, F.col("r.n"))).alias("n"))
    often = placed.groupBy("host", F.col("name").alias("inner")).agg(
        F.sum((F.size("spots") / F.col("size")).cast("bigint")).alias("times"))
    bad = met.join(often, ["host", "inner"]).where("low < 0 or low < high or n < times").select("host", "inner", "outer")
    rank = F.struct((-F.col("pages")).alias("pages"), (-F.col("size")).alias("size"), "least", "name")
    ranked = classes.select("host", "name", rank.alias("rank"))
    both = (bad.join(ranked.select("host", F.col("name").alias("inner"), F.col("rank").alias("a")), ["host", "inner"])
            .join(ranked.select("host", F.col("name").alias("outer"), F.col("rank").alias("b")), ["host", "outer"]))
    open_ = materialize(both.select("host", F.least("a", "b").getField("name").alias("strong"),
                                    F.greatest("a", "b").getField("name").alias("weak")).distinct())
    gone = open_.select("host", F.col("weak").alias("name")).limit(0)
    # The strongest of each group of classes stay, those they bar go; as many rounds as the longest chain.
    while not open_.isEmpty():
        barred = open_.select("host", F.col("weak").alias("strong")).distinct()
        kept = open_.join(barred, ["host", "strong"], "left_anti")
        lost = materialize(kept.select("host", F.col("weak").alias("name")).distinct())
        gone = gone.unionAll(lost)
        for side in ("strong", "weak"):
            open_ = open_.join(lost.withColumnRenamed("name", side), ["host", side], "left_anti")
        open_ = materialize(open_.select("host", "strong", "weak"))
    return gone


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)),
                      F.lit(""))


def templates(pages: DataFrame, url: str = "url", page: str = "html", support: int = 5,
              most_broadcast: int = 1_000_000) -> DataFrame:
    """``host, template``: hashes of the tokens of all valid classes."""
    @F.pandas_udf("tokens array<struct<token bigint, text boolean, at array<int>>>")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from occurrences(parts)

    body = F.coalesce(F.col(page), F.lit(""))
    # One row per page: rows of tokens would repeat the host and take twice the room.
    kinds = F.transform("t.tokens", lambda x: F.struct(x["token"], F.size(x["at"])))
    named = pages.select(host_of(F.col(url)).alias("host"), F.monotonically_increasing_id().alias("id"),
                         tokens(body).alias("t"))
    seen = materialize(named.select("host", "id", F.xxhash64(kinds).alias("row"), "t.tokens"))
    # Copies of a page say nothing about its template: one of each is looked at.
    each = seen.select("host", "id", "row")
    again = materialize(each.join(each.groupBy("host", "row").agg(F.min("id").alias("id")).select("id"), "id",
                                  "left_anti").select("id"))
    copies = again.count()
    if copies:
        seen = seen.join(F.broadcast(again) if copies <= most_broadcast else again, "id", "left_anti")
    seen = seen.select("host", "row", F.explode("tokens").alias("t")).select(
        "host", "row", "t.token", "t.text", F.size("t.at").alias("n"), "t.at")
    vector = F.bit_xor(F.xxhash64("row", "n")).alias("vector")
    vectors = seen.groupBy("host", "token").agg(
        vector, F.count("*").alias("pages"), F.max("text").alias("text")).where(F.col("pages") >= support)
    classes = vectors.groupBy("host", "vector", "pages").agg(F.count("*").alias("size")).where("size > 1")
    member = vectors.join(classes, ["host", "vector", "pages"]).select(
        "host", "token", F.xxhash64("vector", "pages").alias("name"), "pages", "size", "text")
    member = materialize(member)
    # The order of a class's tokens in each page, as one hash; valid if it is the same everywhere, time after time.
    spots = F.array_sort(F.flatten(F.transform(F.collect_set(F.struct("at", "token")), lambda x: F.transform(
        x["at"], lambda at: F.struct(at.alias("at"), x["token"].alias("token"))))))
    placed = seen.select("host", "row", "token", "at").join(
        member.drop("pages", "text"), ["host", "token"]).groupBy("host", "name", "size", "row").agg(spots.alias("s"))
    order = F.transform("s", lambda x: x["token"])
    once = F.slice(order, 1, F.col("size").cast("int"))
    repeated = F.flatten(F.array_repeat(once, (F.size("s") / F.col("size")).cast("int")))
    placed = materialize(placed.select("host", "name", F.col("size").cast("int").alias("size"), "row",
                                       F.transform("s", lambda x: x["at"]).alias("spots"),
                                       F.when(repeated == order, F.xxhash64(once)).alias("o")))
    valid = placed.groupBy("host", "name").agg(F.min("o").alias("low"), F.max("o").alias("high"), F.count_if(
        F.col("o").isNull()).alias("mixed")).where("low = high and mixed = 0").select("host", "name")
    valid = materialize(valid)
    named = member.join(valid, ["host", "name"])
    least = materialize(named.groupBy("host", "name", "pages", "size").agg(
        F.min("token").alias("least"), F.max("text").alias("text")).where("text").drop("text"))
    gone = not_nested(placed.join(least, ["host", "name"], "left_semi").drop("o"), least)
    return named.join(gone, ["host", "name"], "left_anti").groupBy("host").agg(F.collect_set("token").alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html", support: int = 5,
            most_broadcast: int = 1_000_000) -> DataFrame:
    """``id, url, text, n_chars`` of every page; ``text`` is empty where there is none."""
    found = materialize(templates(pages, url, page, support, most_broadcast))
    size = found.agg(F.coalesce(F.sum(F.size("template") + 8), F.lit(0)).alias("n")).first()["n"]
    found = found.select(F.col("host").alias("_host"), "template")

    @F.pandas_udf("string")
    def text(bodies: pd.Series, known: pd.Series) -> pd.Series:
        sets: dict[bytes, frozenset[int]] = {}
        out = []
        for body, tokens in zip(bodies, known):
            key = b"" if tokens is None else tokens.tobytes()
            if key not in sets:
                sets[key] = frozenset(() if tokens is None else tokens.tolist())
            out.append(main_text(body, sets[key]))
        return pd.Series(out, dtype="object")

    rows = pages.select(F.col(id_col), F.col(url), F.coalesce(F.col(page), F.lit("")).alias("_page"),
                        host_of(F.col(url)).alias("_host"))
    joined = rows.join(F.broadcast(found) if size <= most_broadcast else found, "_host", "left")
    done = joined.select(id_col, url, text("_page", "template").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("bigint"))
