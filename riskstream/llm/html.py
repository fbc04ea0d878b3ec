"""Main text of web pages by template deduction.

Pages of one host come from a few templates.  A page is a sequence of tokens: where
containers open (by their path of tags and classes), and text blocks with their
path.  For each host and token, all pages are summed up into a fingerprint of the
occurrence vector, the counts of the token in every page; tokens whose vectors agree
form an equivalence class.  A class is valid if

* it is frequent: it occurs in `SUPPORT` of the host's pages, and in `LEAST` of them
  (pages that agree in all text that is not left out, below, count as one, so copies
  of a page make no template);
* it has markup: text that occurs in just the pages that hold certain containers is
  theirs, while text that some pages happen to share is content;
* it is ordered: in each page its tokens stand in one order, as often as the class
  occurs, and in the same order in all pages;
* it nests: all its occurrences lie in one and the same slot, the room between two
  neighbouring tokens, of the class that occurs once in every page.

The class of all pages with the valid classes nested in its slots is the template.
Text in a template is none of a page's own.  What is left stands in slots, each
known by the innermost container of the template around it; of these, the article is
the smallest container of the template that holds `SHARE` of all text of the host's slots, links aside.  Where
that lies in what a page marks as its article (article or main), the mark says how far it goes.  Hosts of too few pages
have no template; there the mark alone counts, or the smallest container around all text.

Containers of one path may play several roles.  They are told apart by class, and div and section also by what they hold
themselves: paragraphs, lists, bare text, or only other containers.

The fingerprints are sums, so they combine before a shuffle and a host may hold any
share of the pages; order, nesting and the text in slots are summed up per batch and then
per host in the same way.

Containers that by tag, role, class or id are menus, headers, footers, sidebars,
notices, adverts, forms or reader comments are left out, and so are scripts, styles
and markup.  A name counts if it says that and nothing else: "share-bar" does, "related-work"
and "has-sidebar" do not; inside an article only names of adverts, menus, sharing,
sign-up and comments count.  Character references are decoded, white space inside a block becomes one
space, blocks are joined by an empty line.

Templates go to the executors at once if they take up to `SENT_BYTES`; beyond that they
meet the pages by a join on the host and a salt, so that a host's pages spread.

Defined cases: null or empty html has empty text; a null or unreadable url shares the
host ''; repeated rows each give a row, also of one page_id; a page of any length is parsed whole,
in time in proportion to it; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import pieces, written

SUPPORT = 0.3
LEAST = 5
SHARE = 0.6
SENT_BYTES = 4 << 20
SALTS = 64

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|object|select)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<]*\Z""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_NAME = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6".split())
_ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_OUT_TAGS = frozenset("head nav footer aside form button dialog menu label input audio video canvas".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Names of what is no article wherever it stands, of what is none outside of an article, and words that say nothing beside these.
_NEVER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar comment comments disqus reply replies respond cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social pagination pager".split()
)
_OUTSIDE = frozenset("promo promotion banner aside footer header notice notices related recommended recommendations widget widgets toolbar masthead copyright disclaimer skip link links".split())
_PLAIN = frozenset("area bar block box bottom button buttons container content desktop global group inner item items left list main mobile outer page panel primary right row secondary section site slot top unit wrap wrapper".split())
_LISTS = frozenset("ul ol dl menu".split())
_KEEPERS = frozenset(("html", "body", "main"))


def _left_out(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _OUT_TAGS or (tag == "header" and not inside):
        return True
    if not attributes or tag in _KEEPERS:
        return False
    for key, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if hidden or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if key == "role" and value in _OUT_ROLES:
            return True
        if key in ("class", "id"):
            for name in value.split():
                names = set(_NAME.findall(name)) - _PLAIN
                if names and names <= ({"comment", "comments", "reply"} if tag == "article" else _NEVER if inside else _NEVER | _OUTSIDE):
                    return True
    return False


def _label(tag: str, attributes: str) -> str:
    for key, a, b, c, _ in _ATTRIBUTE.findall(attributes) if attributes else ():
        if key.lower() == "class":
            return f"{tag}.{(a or b or c).lower()}"
    return tag


Token = tuple[str, str | None, bool, bool, int]


def parse(html: str) -> list[Token]:
    """Containers that open (path, None) and text blocks (path, text), each with: left out, inside article or main, characters in links; in page order."""
    found: list[tuple[int, str | None, bool, bool, int]] = []
    # of each container: the one around it, its label, and what it holds at best itself
    around, labels, holds = [0], [""], [0]
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # tag, left out, inside, container
    part: list[str] = []
    links, link = 0, 0
    skip: list | None = None  # an inline element that is left out: its tag, how often open, and how deep it stands

    def close() -> None:
        nonlocal links
        if part:
            text = " ".join(unescape("".join(part)).split())
            if text:
                tag, out, inside, node = stack[-1]
                if tag not in _PARAGRAPH:
                    holds[node] = max(holds[node], 1)
                found.append((node, text, out, inside, links))
            part.clear()
        links = 0

    def pop(tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                close()
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    done = 0
    for m in _TOKEN.finditer(html):
        if skip and len(stack) < skip[2]:
            skip = None
        if m.start() > done and not skip:
            part.append(html[done : m.start()])
            links += (m.start() - done) * (link > 0)
        done = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag, attributes = tag.lower(), m[4]
        if m[2]:
            if tag == "a":
                link = max(0, link - 1)
            if tag in _BLOCK:
                close()
                pop((tag,), ("article", "main", "body", "td", "th", "li", "nav", "aside", "footer", "header", "section", "form") if tag in _PARAGRAPH else ())
            elif skip and tag == skip[0]:
                skip[1] -= 1
                skip = skip if skip[1] else None
            continue
        if tag == "br":
            part.append("\n")
        if tag in _VOID:
            if tag == "hr":
                close()
            continue
        if tag in _BLOCK:
            close()
            pop(tuple(_PARAGRAPH), ("li", "td", "th", "blockquote", "article", "section", "div", "main", "body", "nav", "aside", "footer", "header", "form", "dd", "figure"))
            if tag in _ITEMS:
                pop((tag,) if tag in ("li", "tr") else ("dt", "dd") if tag in ("dt", "dd") else ("td", "th"), _ITEMS[tag])
            _, out, inside, node = stack[-1]
            holds[node] = max(holds[node], 3 if tag in _PARAGRAPH or tag in ("blockquote", "pre") else 2 if tag in _LISTS else 0)
            inside = inside or tag in ("article", "main") or 'role="main"' in attributes
            out = out or bool(skip) or _left_out(tag, attributes, inside and tag not in ("article", "main"))
            if tag not in _PARAGRAPH:
                around.append(node)
                labels.append(_label(tag, attributes))
                holds.append(0)
                node = len(around) - 1
                found.append((node, None, out, inside, 0))
            stack.append((tag, out, inside, node))
        else:
            if tag == "a":
                link += 1
            if skip:
                skip[1] += tag == skip[0]
            elif _left_out(tag, attributes, stack[-1][2]):
                skip = [tag, 1, len(stack)]
    if done < len(html) and not (skip and len(stack) >= skip[2]):
        part.append(html[done:])
    close()
    paths = [""]
    for node in range(1, len(around)):
        # containers that may be anything are told apart by what they hold: paragraphs, lists, bare text or more containers
        kind = f"~{holds[node]}" if labels[node].partition(".")[0] in ("div", "section") else ""
        paths.append(f"{paths[around[node]]}/{labels[node]}{kind}")
    return [(paths[node], *rest) for node, *rest in found]


@dataclass(frozen=True)
class Template:
    """tokens: of all valid classes; article: path of the container that holds the host's articles, or None."""

    tokens: frozenset[int] = frozenset()
    article: str | None = None


def main_text(html: str | None, template: Template = Template()) -> str:
    """The blocks of a page's slots that are its article."""
    if not html:
        return ""
    free = [t for t in parse(html) if t[1] is not None and not t[2] and token(t[0], t[1]) not in template.tokens]
    marked = [t for t in free if t[3]]
    own = [t for t in free if _within(t[0], template.article)] if template.article else []
    if not own or any(t[3] for t in own):
        # the page's own mark, where the template has no say or agrees
        own = marked
    if not own:
        # the smallest container around all free text; blocks of links alone do not widen it
        paths = [t[0].split("/") for t in free if len(t[1]) > t[4]] or [t[0].split("/") for t in free]
        best = "/".join(commonprefix(paths))
        own = [t for t in free if _within(t[0], best)]
    return "\n\n".join(t[1] for t in own)


def _within(path: str, container: str) -> bool:
    return path == container or path.startswith(f"{container}/")


def token(path: str, text: str | None = None) -> int:
    """63 bits; the last tells containers (0) from text (1)."""
    return xxhash.xxh3_64_intdigest(path) >> 2 << 1 if text is None else xxhash.xxh3_64_intdigest(f"{path}\n{text}") >> 1 | 1


_PAGE = token("")  # stands for the page itself


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def candidates(pages: DataFrame, support: float = SUPPORT, least: int = LEAST) -> DataFrame:
    """host, classes array<array<long>>: the frequent equivalence classes with markup of each host; the first is that of the page itself."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            cells: list[list] = [[], [], [], [], []]
            for h, html in zip(*(batch.column(i).to_pylist() for i in range(2))):
                found = parse(html or "")
                # pages of the same text are one, so that copies of a page make no template
                page = xxhash.xxh3_64_intdigest("\n".join(t[1] for t in found if t[1] is not None and not t[2])) >> 1
                count = Counter(token(t[0], t[1]) for t in found)
                count[_PAGE] = 1
                for t, n in count.items():
                    vector = xxhash.xxh3_64_intdigest(f"{page}:{n}")
                    for cell, value in zip(cells, (h, t, page, vector >> 33, vector & 0x7FFFFFFF)):
                        cell.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.string()), *(pa.array(c, pa.int64()) for c in cells[1:])], ["host", "token", "page", "one", "two"])

    seen = pages.select("host", "html").mapInArrow(rows, "host string, token long, page long, one long, two long")
    seen = seen.groupBy("host", "token", "page").agg(F.max(F.struct("one", "two")).alias("v")).select("host", "token", "v.one", "v.two")
    vectors = seen.groupBy("host", "token").agg(F.sum("one").alias("one"), F.sum("two").alias("two"), F.count("*").alias("n"))
    vectors = written(vectors.where(F.col("n") >= least), "vectors")
    total = vectors.where(F.col("token") == _PAGE).select("host", F.col("n").alias("pages"))
    frequent = vectors.join(total, "host").where(F.col("n") >= F.col("pages") * support)
    # one row a host of at most (tokens of a page) / support entries, since each takes up that share of the host's pages
    classes = frequent.groupBy("host", "one", "two", "n").agg(F.sort_array(F.collect_list("token")).alias("tokens")).where("exists(tokens, t -> t % 2 = 0)")
    first = ~F.array_contains("tokens", _PAGE)
    return classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(first.alias("other"), "tokens"))).alias("classes")).select("host", F.expr("transform(classes, c -> c.tokens)").alias("classes"))


class _Check:
    """What pages say about the classes of their hosts: order, nesting, and text by the innermost container of a class around it."""

    def __init__(self) -> None:
        self.classes: dict[tuple[str, int], set[tuple[bool, int, int]]] = {}
        self.texts: Counter[tuple[str, str, bool]] = Counter()

    def add(self, host: str, classes: list[list[int]], found: list[Token]) -> None:
        of = {t: k for k, c in enumerate(classes) for t in c}
        own: dict[int, list[int]] = {}  # each class's tokens in page order
        slots: dict[int, set[int]] = {}  # of the first class, that hold the others
        slot, known = _PAGE, {}
        for path, text, out, inside, links in found:
            t = token(path, text)
            k = of.get(t)
            if k is not None:
                own.setdefault(k, []).append(t)
                if k:
                    slots.setdefault(k, set()).add(slot)
                else:
                    slot = t
                if text is None:
                    known[path] = True
            elif text is not None and not out:
                while path and path not in known:
                    path = path.rpartition("/")[0]
                self.texts[host, path, inside] += len(text) - links
        for k, row in own.items():
            once = list(dict.fromkeys(row))
            good = row == once * (len(row) // len(once)) and (k > 0 or len(row) == len(once)) and len(slots.get(k, ())) <= 1
            say = self.classes.setdefault((host, k), set())
            if len(say) < 2:  # two that differ make a class invalid; no more need be said
                say.add((good, xxhash.xxh3_64_intdigest(str(once)) >> 1, min(slots.get(k, (0,)))))

    def batch(self) -> pa.RecordBatch:
        rows = [(h, k, None, *s, 0) for (h, k), says in self.classes.items() for s in says]
        rows += [(h, None, path, inside, 0, 0, n) for (h, path, inside), n in self.texts.items()]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["host", "class", "path", "flag", "order", "slot", "chars"])


def _article(texts: dict[str, int], share: float) -> str | None:
    """The smallest container that holds this share of the text, by the text of each container itself."""
    total = sum(texts.values())
    within: Counter[str] = Counter()
    for path, n in texts.items():
        while path:
            within[path] += n
            path = path.rpartition("/")[0]
    return max((p for p, n in within.items() if n >= share * total), key=lambda p: (p.count("/"), p), default=None) if total else None


def templates(pages: DataFrame, support: float = SUPPORT, least: int = LEAST, share: float = SHARE, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """host, tokens array<long> of valid classes, texts array<struct<path, chars>>, of pages(host, html)."""
    classes = written(candidates(pages, support, least), "classes")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            check = _Check()
            for h, html, known in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if known:
                    check.add(h, known, parse(html or ""))
            yield check.batch()

    with_classes = _met(pages.select("host", "html"), classes, "classes", sent_bytes)
    said = with_classes.mapInArrow(rows, "host string, class int, path string, flag boolean, order long, slot long, chars long")
    said = written(said.groupBy("host", "class", "path", "flag", "order", "slot").agg(F.sum("chars").alias("chars")), "checked")
    valid = said.where("class is not null").groupBy("host", "class").agg((F.min("flag") & (F.min("order") == F.max("order")) & (F.min("slot") == F.max("slot"))).alias("valid")).where("valid")
    # a host whose own class has no order has no template
    valid = valid.groupBy("host").agg(F.collect_list("class").alias("valid")).where("array_contains(valid, 0)")
    tokens = classes.join(valid, "host").select("host", F.expr("flatten(transform(valid, k -> classes[k]))").alias("tokens"))
    texts = said.where("path is not null and chars > 0").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    texts = texts.groupBy("host").agg(F.collect_list(F.struct("path", "chars")).alias("texts"))
    return tokens.join(texts, "host", "left")


def _met(own: DataFrame, table: DataFrame, column: str, sent_bytes: int) -> DataFrame:
    """own with a column of table(host, column) beside it: looked up in a table sent along if that is small, else joined on host and a salt."""
    size = table.select(F.sum(F.octet_length("host") + F.octet_length(F.to_json(F.struct(column))))).first()[0] or 0
    if size <= sent_bytes:
        return own.join(F.broadcast(table.select("host", column)), "host", "left").select(*own.columns, column)
    salt = F.pmod(F.xxhash64("html"), F.lit(SALTS))
    salted = table.select("host", column, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    return own.withColumn("_salt", F.coalesce(salt, F.lit(0))).join(salted, ["host", "_salt"], "left").select(*own.columns, column)


def extract(pages: DataFrame, support: float = SUPPORT, least: int = LEAST, share: float = SHARE, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every page of pages(page_id, url, html)."""
    own = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    found = templates(own, support, least, share, sent_bytes)
    found = written(found.select("host", F.struct("tokens", "texts").alias("template")), "templates")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in pieces(batches, "html"):
            texts = []
            hosts = batch.column(3).to_pylist()
            for i, (html, h) in enumerate(zip(batch.column(2).to_pylist(), hosts)):
                if h not in known:
                    if len(known) > 256:
                        known.clear()
                    t = batch.column(4)[i].as_py()
                    known[h] = Template(frozenset(t["tokens"]), _article({x["path"]: x["chars"] for x in t["texts"] or ()}, share)) if t else Template()
                texts.append(main_text(html, known[h]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return _met(own, found, "template", sent_bytes).mapInArrow(rows, "page_id long, url string, text string, n_chars long")
