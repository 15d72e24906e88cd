"""Main text of pages by deducing each host's template.

A page is a sequence of block tags and of the blocks of text between them.  Both
are its tokens, each told apart by the container path it stands in.  Tokens of
one host that occur equally often on every page (equal occurrence vectors) form
an equivalence class.  The class of the tokens that every page has once is the
host's page class; its tokens, or its tags alone, in the one order that they keep,
cut each page into slots.  Another class that is frequent is nested where each of its tokens
first stands in the same slot on all pages; tokens of one class in different
slots are classes of their own.  A class is valid if its tokens keep one order on
all pages; of one that doesn't, the tags and the texts are judged apart.  The texts
of valid classes are the host's template text, which is left out outside article
and main regions (a heading that half of a host's articles have is still the
article's).  Which slots are main text follows from fixed names: no container
around it is a menu, header, footer, sidebar, notice, advert, form, script,
style or comment section, and, where the page has an article or main region,
it lies in there; then only the containers inside the region count.

Scale: occurrence vectors are compared by a commutative fingerprint that
combines before the shuffle, so a host's pages are never gathered; a template
is one row a host.  A page is parsed twice and its html moves at most once;
a text token is 8 bytes however long its text.

Edge cases: null html is empty; a null or odd url is a host of its own name
(''); a page without article or main region keeps all slots that aren't
excluded, whatever its host's other pages have, and one that is a form
throughout keeps the form's text; an article or main region in a sidebar and
the like counts where the page has no other; unclosed and stray tags are
tolerated; copies of a page count as one page, and come back as often as they
are; a host of fewer than three different pages has no template; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrylens.llm.common import table, written

FREQUENT = 0.5  # share of a host's pages that must hold a class
LEAST_PAGES = 3  # different pages that must hold a class: fewer tell wording from template only by chance

# fixed values: names of the HTML standard
_SILENT = frozenset("script style noscript template head title iframe svg object select textarea button canvas audio video".split())
_ASIDE = frozenset("nav header footer aside form menu dialog".split())
_MAIN = frozenset(("article", "main"))
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = (_BLOCKS | _SILENT) - frozenset("p li dd dt option td th tr hr".split())
_IN_HEAD = frozenset("base basefont bgsound link meta".split())  # besides raw elements
_RAW = "script|style|textarea|title|noscript|iframe|svg|template"
_BAD_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|side|menu|nav(?:bar|igation)?|breadcrumbs?|footer|masthead|share|social|related|comments?|replies|disqus|widget)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(
    # what isn't closed goes to the page's end, so nothing is searched to the end twice
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?P<rawattrs>[^>]*+)(?:\Z|>.*?(?:</(?P=raw)\s*>|\Z))|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)",
    re.S | re.I)
# words that say nothing about a container: a name of these and of the words above is a bad one as a whole
_FURNITURE = frozenset("area articles bar block body bottom box button buttons container content form group head header icons inner item items left line link links list outer panel posts right row section signup stories text title top wrap wrapper".split())
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def events(page: str | None) -> Iterator[tuple[str, str]]:
    """A page as ("text", text), ("space", "") for inline breaks, ("start", name
    with its classes) and ("end", name); comments and raw elements are skipped."""
    page, last = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            yield "text", page[last : m.start()]
        last = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            yield "space", ""
        elif m["end"]:
            yield "end", name
        else:
            names = "" if "=" not in m["attrs"] else " ".join(sorted(" ".join(a or b or c for a, b, c in _NAMED.findall(m["attrs"])).split()))
            yield "start", f"{name} {names}".strip()
    if last < len(page):
        yield "text", page[last:]


def walk(page: str | None) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """Events with the path of open containers; a tag's token is its path and name."""
    path: list[str] = []
    for kind, value in events(page):
        name = value.split(" ", 1)[0]
        if path and path[-1].split(" ", 1)[0] == "head" and (kind == "start" and name not in _IN_HEAD or kind == "text" and value.strip()):
            path.pop()  # its end tag is optional
        if kind == "start" and name in _CONTAINERS and name not in _VOID:
            yield kind, value, tuple(path)
            path.append(value)
            continue
        if kind == "end" and name in _CONTAINERS:
            k = next((k for k in range(len(path) - 1, -1, -1) if path[k].split(" ", 1)[0] == name), None)
            if k is None:
                continue  # a stray end tag
            del path[k:]
        yield kind, value, tuple(path)


def pieces(page: str | None) -> Iterator[tuple[tuple[str, ...], str, bool]]:
    """The block texts and start tags of a page in order, each with the path of
    its containers and whether it is a tag."""
    block: list[str] = []
    here: tuple[str, ...] = ()
    silent: dict[tuple[str, ...], bool] = {}
    for kind, value, path in walk(page):
        if kind == "text":
            if path not in silent:
                silent[path] = any(c.split(" ", 1)[0] in _SILENT for c in path)
            if not silent[path]:
                block.append(value)
            continue
        name = value.split(" ", 1)[0]
        if kind == "space":
            block.append(" ")
        elif name in _BLOCKS:
            if text := " ".join(entities.unescape("".join(block)).split()):
                yield here, text, False
            block.clear()
            if kind == "start":
                yield path, value, True
            here = (*path, value) if kind == "start" and name in _CONTAINERS else path
    if text := " ".join(entities.unescape("".join(block)).split()):
        yield here, text, False


def blocks(page: str | None) -> Iterator[tuple[tuple[str, ...], str]]:
    """The block texts of a page, each with the path of its containers."""
    return ((path, text) for path, text, tag in pieces(page) if not tag)


def token_of(path: tuple[str, ...], text: str, tag: bool = False) -> int:
    """A token is odd if it is a tag's, even if it is a text's."""
    digest = hashlib.blake2b("/".join((*path, "#" + text)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True) & ~1 | tag


_TOKENS = "host string, page bigint, token bigint, n bigint, place bigint"
_PAGE = 0  # the token that every page has once


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each page: how often and where first."""
    for b in batches:
        cols: list[list] = [[] for _ in range(5)]
        for url, page, text in zip(*(b.column(c).to_pylist() for c in ("url", "page", "html"))):
            seen: dict[int, list[int]] = {_PAGE: [1, -1]}
            known: dict[tuple, int] = {}  # tags repeat
            for i, (path, words, tag) in enumerate(pieces(text)):
                if not tag:
                    token = token_of(path, words)
                elif (token := known.get((path, words))) is None:
                    token = known[path, words] = token_of(path, words, True)
                seen.setdefault(token, [0, i])[0] += 1
            host = host_of(url)
            for token, (n, place) in seen.items():
                for col, v in zip(cols, (host, page, token, n, place)):
                    col.append(v)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["host", "page", "token", "n", "place"])


_CLASS = ["host", "support", "total", "vector"]  # a class: equal support, total and fingerprint of the occurrence vector
_KINDS = {"whole": None, "tags": 1, "texts": 0}  # the lowest bit of their tokens


def _ordered(placed: DataFrame, by: list[str]) -> DataFrame:
    """Classes ``by`` with the kinds of their tokens that keep one order of
    first places on all of the class's pages."""
    pages = placed.groupBy(*by, "page").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("s"))
    pages = pages.select(*by, *[F.xxhash64(F.transform(F.filter("s", lambda x: F.lit(bit is None) | (x["token"].bitwiseAND(F.lit(1)) == F.lit(bit or 0))), lambda x: x["token"])).alias(k) for k, bit in _KINDS.items()])
    # a token that a page lacks makes a different sequence there; a page that lacks all of them is missing
    same = pages.groupBy(*by).agg(F.count("*").alias("n"), *[(F.min(k) == F.max(k)).alias(k) for k in _KINDS])
    return same.filter("n = support").drop("n")


_KEPT = "whole or (token & 1 = 1 and tags) or (token & 1 = 0 and texts)"  # of a class in no one order, the tags and the texts are judged apart

_CUTS = "whole or (token & 1 = 1 and tags) or (token & 1 = 0 and texts and not tags)"  # what cuts into slots has one order as a whole


def templates(pages: DataFrame) -> DataFrame:
    """pages (page, url, html) -> (host, template): the text tokens of a host's
    valid classes; pages with one ``page`` number are copies and count once."""
    tokens = written(pages.mapInArrow(_tokens, _TOKENS).distinct(), "tokens")
    vectors = tokens.groupBy("host", "token").agg(F.count("*").alias("support"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"))
    vectors = written(vectors.filter(f"support >= {LEAST_PAGES}"), "vectors")
    # the page class is that of the token which every page has once
    most = vectors.filter(f"token = {_PAGE}").select("host", F.col("support").alias("pages"), F.col("vector").alias("once"))
    vectors = vectors.filter(f"token <> {_PAGE}").join(most, "host").filter(f"support >= {FREQUENT} * pages")
    vectors = vectors.select(*_CLASS, "token", F.expr("support = pages and total = pages and vector = once").alias("root"))
    placed = written(tokens.drop("n").join(vectors, ["host", "token"]), "placed")
    # the page class's tokens cut each page into slots
    roots = written(vectors.filter("root").join(_ordered(placed.filter("root"), _CLASS), _CLASS).filter(_CUTS).select("host", "token"), "roots")
    root = placed.join(roots, ["host", "token"]).select("host", "page", "place")
    cuts = root.groupBy("host", "page").agg(F.collect_list("place").alias("cuts"))
    inner = placed.join(roots, ["host", "token"], "left_anti").join(cuts, ["host", "page"], "left")
    inner = inner.withColumn("slot", F.expr("coalesce(size(filter(cuts, c -> c < place)), 0)")).drop("cuts", "root")
    # nested: a token keeps to one slot on all pages
    nested = inner.groupBy(*_CLASS, "token").agg(F.min("slot").alias("slot"), F.max("slot").alias("last")).filter("slot = last").drop("last")
    by = [*_CLASS, "slot"]
    inner = inner.drop("slot").join(nested, [*_CLASS, "token"])
    valid = nested.join(_ordered(inner, by), by).filter(_KEPT).select("host", "token")
    found = valid.union(roots).filter("token & 1 = 0")
    return written(found.groupBy("host").agg(F.collect_list("token").alias("template")), "templates")


def excluded(container: str) -> bool:
    name, _, names = container.partition(" ")
    if name in ("html", "body"):
        return False  # their classes tell of the whole page
    return name in _SILENT or name in _ASIDE or bool(names and _BAD_NAME.search(names))


def excluded_inside(container: str) -> bool:
    """The same for containers inside an article or main region, where only a
    whole class name tells: ``share`` or ``share-buttons``, not ``share-prices``."""
    name, _, names = container.partition(" ")
    return name in _SILENT or name in _ASIDE or any(map(_bad_as_a_whole, names.split()))


def _bad_as_a_whole(name: str) -> bool:
    words = [w for w in re.split(r"[-_]+", name.lower()) if w]
    bad = [(m := _BAD_NAME.match(w)) is not None and m.end() == len(w) for w in words]
    return any(bad) and all(b or w in _FURNITURE for b, w in zip(bad, words))


def set_apart(container: str) -> bool:
    """Whether a container around an article or main region, or the region's own
    classes, tell that it isn't the page's main one: an element for that, or a
    whole class name (``sidebar``, unlike ``has-sidebar``)."""
    name, _, names = container.partition(" ")
    if name in ("html", "body"):
        return False
    return name in _SILENT or name in _ASIDE and name != "form" or any((m := _BAD_NAME.match(x)) is not None and m.end() == len(x) for x in names.split())


def rank_of(path: tuple[str, ...]) -> int | None:
    """How likely a slot is main text, best first: in an article or main region (0),
    in one that is set apart (1), elsewhere (2), in a form only (3); None: excluded.
    In a region only the containers inside it can exclude."""
    inside = next((k for k, c in enumerate(path) if c.split(" ", 1)[0] in _MAIN), None)
    if inside is not None:
        # an article's own header belongs to it
        if any(excluded_inside(c) and c.split(" ", 1)[0] != "header" for c in path[inside + 1 :]):
            return None
        return 1 if any(map(set_apart, path[: inside + 1])) else 0
    bad = [c for c in path if excluded(c)]
    return 2 if not bad else 3 if all(c.split(" ", 1)[0] == "form" and not _BAD_NAME.search(c.partition(" ")[2]) for c in bad) else None


def main_text(page: str | None, template: frozenset[int]) -> str:
    """The blocks of the best slots that the page has, without the template's
    text, joined by an empty line."""
    found: dict[int, list[str]] = {}  # blocks by rank
    judged: dict[tuple[str, ...], int | None] = {}
    for path, text in blocks(page):
        if path not in judged:
            judged[path] = rank_of(path)
        # the template's text is left out between regions; what stands in an article belongs to it, however often it is said
        if judged[path] is not None and (judged[path] < 2 or not (template and token_of(path, text) in template)):
            found.setdefault(judged[path], []).append(text)
    return "\n\n".join(found[min(found)]) if found else ""


_TEXTS = "page_id bigint, url string, text string, n_chars bigint"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[int, ...], frozenset[int]] = {}
    for b in batches:
        texts = []
        for page, template in zip(b.column("html").to_pylist(), b.column("template").to_pylist()):
            key = tuple(template or ())
            if key not in known:
                known.clear()
                known[key] = frozenset(key)
            texts.append(main_text(page, known[key]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", "html")
    numbered = pages.select(F.xxhash64("html").alias("page"), "url", "html")
    found = templates(numbered)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    rows = pages.withColumn("host", host).join(found, "host", "left").select("page_id", "url", "html", "template")
    return rows.mapInArrow(_extract, _TEXTS)


def op9_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
