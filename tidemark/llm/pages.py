"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its containers (path of tags with class and id) and its text blocks in
them. Over all pages of a host, tokens with the same occurrence vector (how often in which
page; compared by sums of hashes, made before any shuffle) form an equivalence class. A class is
valid if it has at least two tokens and occurs in at least half of the host's pages, and in
`SUPPORT` pages. Valid classes nest by path into the host's template. A text block that is in the
class of its own container (it is there once whenever the container is) is template too, at any
number of pages. What varies in a container of the template is a slot. A page's article is the
slot with most varying text of those it has (one that is not mostly links, if there is), up to an
enclosing article or main element. Slots beside it, in the same parent and class and not mostly
links, belong to it if they hold at least a fifth as much, or stand between a heading beside it
and the article (title, lead). All text blocks in them but the template's are extracted, in page
order.

Parts that say what they are (nav, aside, form, class names such as `ad` or `comments`) hold no
slot, unless all that varies on the host is in such parts.

A host of fewer than `SUPPORT` pages has no template: its pages, and pages without a slot, give the
text of their article or main element, or else all that is in no such part.

A page is parsed once; its blocks are written to the shared folder, and the rest is DataFrame
functions. Null html is empty; pages without text give an empty text. A null url is a host of its
own. Repeated rows are pages like others. Input columns other than page_id, url and html are
ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import lookup, materialise, small

SUPPORT = 3
PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "title", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "pre", "blockquote", "figcaption", "caption", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "figure"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Opening one of these closes an open element of the named kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ASIDE = {"nav", "footer", "aside", "form", "head", "dialog", "menu"}
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|comments?|commentlist|disqus|respond|replies|reply|sidebar|menu|navbar|nav|navigation|breadcrumbs?|footer|masthead|header|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|overlay|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
SPACES = re.compile(r"\s+")


def parse(page: str | None) -> tuple[list[tuple[str, str, str | None, int, bool]], dict[str, int]]:
    """Text blocks in page order, each (container path, text, path of the outermost part around it that is no article or None, characters in links, whether it is a heading), and how often each container path opens."""
    page = page or ""
    stack: list[tuple[str, str, str | None]] = []  # tag, path, outermost aside
    out: list[tuple[str, str, str | None, int, bool]] = []
    opened: dict[str, int] = {}
    text: list[str] = []
    where: tuple[str, str | None, bool] = ("", None, False)
    skip_to = linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            t = SPACES.sub(" ", entities.unescape("".join(text))).strip()
            if t:
                out.append((where[0], t, where[1], min(linked, len(t)), where[2]))
            text.clear()
            linked = 0

    for m in PIECE.finditer(page):
        if m.start() < skip_to:
            continue
        tag = m[1]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                if not text and stack:
                    where = (stack[-1][1], stack[-1][2], any(x[0] in HEADINGS for x in stack))
                text.append(m[0])
                if any(x[0] == "a" for x in stack):
                    linked += len(m[0])
            continue
        tag, close = tag.lower(), m[0][1] == "/"
        if tag not in INLINE:
            flush()
        if tag in RAW and not close:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, m.end())
            skip_to = end.end() if end else len(page) if tag in ("script", "style") else m.end()
            continue
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag not in INLINE:
                flush()
            continue
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE:
                        flush()
                    del stack[i:]
                    break
            continue
        closes = CLOSES.get(tag, set()) | (set() if tag in INLINE else {"p"})
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in closes:
                del stack[i:]
                break
            if stack[i][0] not in INLINE:
                break
        path, aside = (stack[-1][1], stack[-1][2]) if stack else ("", None)
        names = {a.lower(): (v or "").strip("\"'") for a, v in ATTRIBUTE.findall(m[2])} if m[2].strip() else {}
        inside = any(x[0] in ("article", "main") for x in stack)
        named = tag not in ("html", "body", "article", "main") and bool(NAMED.search(names.get("class", "")) or NAMED.search(names.get("id", "")))
        if inside and tag == "header" or inside and tag in LEAF and re.fullmatch(r"h\d", tag):
            named = False
        begins = aside is None and (tag in ASIDE or tag == "header" and not inside or named or names.get("role", "").lower() in ROLES or "hidden" in names or names.get("aria-hidden", "").lower() == "true")
        if tag not in INLINE and tag not in LEAF or begins:
            path += f"/{tag}" + "".join(f".{c}" for c in sorted(names.get("class", "").split())) + (f"#{names['id']}" if names.get("id") else "")
            opened[path] = opened.get(path, 0) + 1
        stack.append((tag, path, path if begins else aside))
        if len(stack) > 500:  # unclosed inline elements do not nest without end
            stack = [x for x in stack if x[0] not in INLINE]
    flush()
    return out, opened


def blocks(page: str | None) -> tuple[list[tuple[str, str, bool]], dict[str, int]]:
    """Text blocks in page order, each (container path, text, whether it lies in a part that is no article), and how often each container path opens."""
    found, opened = parse(page)
    return [(p, t, aside is not None) for p, t, aside, *_ in found], opened


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


#: The outermost article or main element of a path.
MAIN = r"^.*?/(?:article|main)(?=[./#]|$)[^/]*"
BLOCK = "struct<path: string, text: string, code: long, aside: string, linked: int, heading: boolean, first: boolean>"
PARSED = f"page_id long, url string, host string, key long, blocks array<{BLOCK}>, opened array<struct<path: string, n: int>>"


def _code(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


def _parsed(batches):
    """Rows of PARSED: a block is `first` where its path and text come up first in the page; key is the page's part in occurrence vectors."""
    kinds = {"path": pa.string(), "text": pa.string(), "code": pa.int64(), "aside": pa.string(), "linked": pa.int32(), "heading": pa.bool_(), "first": pa.bool_()}
    for batch in batches:
        rows: list[tuple] = []
        ends, opens, opened_ends = [0], [], [0]
        for html in batch.column("html").to_pylist():
            found, opened = parse(html)
            seen: set[int] = set()
            for path, text, aside, linked, heading in found:
                code = _code(path, text)
                rows.append((path, text, code, aside, linked, heading, code not in seen))
                seen.add(code)
            ends.append(len(rows))
            opens += opened.items()
            opened_ends.append(len(opens))
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
        of_opened = pa.StructArray.from_arrays([pa.array([p for p, _ in opens], pa.string()), pa.array([n for _, n in opens], pa.int32())], names=["path", "n"])
        lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), values) for e, values in ((ends, pa.StructArray.from_arrays(columns, names=list(kinds))), (opened_ends, of_opened))]
        hosts = pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), hosts, batch.column("key"), *lists], names=["page_id", "url", "host", "key", "blocks", "opened"])


def parsed(pages: DataFrame) -> DataFrame:
    """PARSED of each row of pages (page_id, url, html), written to the shared folder."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # Equal rows have equal tokens, so they may have an equal key; no other rows do.
    return materialise(pages.withColumn("key", F.xxhash64("page_id", "url", "html")).mapInArrow(_parsed, PARSED), "page-blocks")


def templates(pages: DataFrame) -> DataFrame:
    """host, n (pages), gone (codes of template texts that lie in slots) and slots of each host with a template, from pages (PARSED).

    A slot is (prose: in no part that is no article and not mostly links, plain: the former, varies: characters, path, top: the
    path to extract, parent, hi and lo: the vector of its container, aside, at: mean place of its blocks, headed: whether it has a
    heading), the best first.
    """
    texts = pages.select("host", "key", F.posexplode("blocks").alias("at", "b")).select("host", "key", "at", "b.heading", "b.path", "b.code", F.col("b.aside").isNotNull().alias("aside"), F.lit(1).alias("n"), F.col("b.first").cast("int").alias("first"), F.length("b.text").alias("chars"), "b.linked")
    opened = pages.select("host", "key", F.explode("opened").alias("o")).select("host", "key", F.lit(0).alias("at"), F.lit(False).alias("heading"), "o.path", F.lit(0).cast("long").alias("code"), F.lit(False).alias("aside"), "o.n", F.lit(1).alias("first"), F.lit(0).alias("chars"), F.lit(0).alias("linked"))
    # Two sums of 34 bits of hash: neither can overflow, and vectors do not cancel where rows repeat.
    half = lambda shift: F.shiftrightunsigned(F.shiftleft(F.col("key"), shift), 30)
    sums = [F.sum("first").alias("pages"), F.sum(F.col("n") * half(0)).alias("hi"), F.sum(F.col("n") * half(30)).alias("lo"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum(F.col("at").cast("long")).alias("at"), F.sum("n").alias("times"), F.max("heading").alias("heading")]
    tokens = materialise(texts.unionByName(opened).groupBy("host", "path", "code", "aside").agg(*sums), "page-tokens")
    hosts = pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    frequent = tokens.join(small(materialise(hosts, "hosts")), "host").where((F.col("pages") >= SUPPORT) & (F.col("pages") * 2 >= F.col("n")))
    # Valid classes: at least two tokens with one occurrence vector.
    valid = frequent.groupBy("host", "hi", "lo").agg(F.count("*").alias("tokens")).where("tokens > 1").select("host", "hi", "lo")
    furniture = materialise(frequent.join(valid, ["host", "hi", "lo"], "left_semi"), "furniture")
    skeleton = furniture.where("code = 0").select("host", "n", "path", "hi", "lo")
    fixed = furniture.where("code <> 0").join(skeleton.drop("n"), ["host", "path", "hi", "lo"], "left_semi").select("host", "path", "code", "chars", "aside")
    still = fixed.groupBy("host", "path", "aside").agg(F.sum("chars").alias("still"))
    slots = tokens.where("code <> 0").groupBy("host", "path", "aside").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), (F.sum("at") / F.sum("times")).alias("at"), F.max("heading").alias("headed")).join(still, ["host", "path", "aside"], "left")
    slots = slots.withColumn("varies", F.col("chars") - F.coalesce("still", F.lit(0))).where("varies > 0").join(skeleton, ["host", "path"])
    top = F.coalesce(F.nullif(F.regexp_extract("path", MAIN, 0), F.lit("")), "path")
    prose = F.col("linked") * 2 < F.col("chars")
    slot = F.struct((~F.col("aside") & prose).alias("prose"), (~F.col("aside")).alias("plain"), "varies", "path", top.alias("top"), F.regexp_replace("path", "/[^/]*$", "").alias("parent"), "hi", "lo", "aside", "at", "headed")
    # As many slots as a page has frequent paths, and as many template texts as it has frequent blocks.
    found = slots.groupBy("host").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(slot), asc=False).alias("slots"))
    return found.join(fixed.groupBy("host").agg(F.collect_set("code").alias("gone")), "host", "left")


def _under(path: Column, top: Column) -> Column:
    return (path == top) | F.startswith(path, F.concat(top, F.lit("/")))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row of pages (page_id, url, html)."""
    return extract_parsed(parsed(pages))


def extract_parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row of pages (PARSED)."""
    found = materialise(templates(pages), "templates")
    hosted = lookup(pages.drop("key", "opened"), found, "host", pages.count())
    rest = pages.join(small(found.select("host")), "host", "left_anti").select(*[c for c in hosted.columns if c not in ("slots", "gone")], F.lit(None).cast(found.schema["slots"].dataType).alias("slots"), F.lit(None).cast("array<long>").alias("gone"))
    pages = hosted.unionByName(rest)
    # A block in a part that is no article counts only for a slot inside that very part.
    holds = lambda s, b: _under(b.path, s.top) & (b.aside.isNull() | _under(s.top, b.aside))
    main = F.get(F.filter("slots", lambda s: F.exists("blocks", lambda b: holds(s, b))), F.lit(0))
    pages = pages.withColumn("main", main)
    beside = lambda s: s.prose & (s.parent == F.col("main").parent) & (s.hi == F.col("main").hi) & (s.lo == F.col("main").lo)
    heading = F.array_min(F.transform(F.filter("slots", lambda s: beside(s) & s.headed & (s.at < F.col("main").at)), lambda s: s.at))
    pages = pages.withColumn("from", heading)
    between = lambda s: F.coalesce((s.at >= F.col("from")) & (s.at < F.col("main").at), F.lit(False))
    own = F.filter("slots", lambda s: (s.path == F.col("main").path) | beside(s) & ((s.varies * 5 >= F.col("main").varies) | between(s)))
    pages = pages.withColumn("own", F.when(F.col("main").isNotNull(), own))
    of_template = F.filter("blocks", lambda b: F.exists("own", lambda s: holds(s, b)) & ~F.coalesce(F.array_contains("gone", b.code), F.lit(False)))
    plain = F.filter("blocks", lambda b: b.aside.isNull())
    inside = F.filter("blocks", lambda b: b.aside.isNull() & b.path.rlike(MAIN))
    kept = F.when(F.col("main").isNotNull(), of_template).when(F.size(inside) > 0, inside).otherwise(plain)
    return pages.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b.text), "\n").alias("text"))
