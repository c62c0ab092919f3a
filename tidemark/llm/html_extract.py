"""Main text of web pages by removal of site templates: what recurs on a host goes, tags and marks decide where that is open.

Every element that holds text has a slot, its path of tags and classes from the top of the page, and a hash of its
subtree. Spark counts per host how many different surroundings each subtree is met in, and so for each slot what part
of its different contents recur. A slot whose contents recur is the site's: menus, footers and boxes go with it, also
where this page's own content of it is met once. A slot whose contents never recur is the page's own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_batches

EXTRACTED = "page_id long, url string, text string, n_chars long, n_template long, n_marked long"
HASHES = "host string, slot long, hash long, around long"
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*+> | </?([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)> | </?([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S | re.X,
)
_DIGITS = re.compile(r"[0-9]+")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))|([^\s"'<>/=]+)""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search option optgroup".split()
)
#: Elements that hold no article text on any site: code, controls, embedded things, forms, sidebars.
_DROPPED = frozenset("script style noscript template aside form button select textarea option datalist dialog iframe object embed svg canvas audio video head title input label fieldset map math applet xmp noembed noframes".split())
_DROPPED_ROLES = frozenset("complementary search form dialog alertdialog alert".split())
#: Words in class or id that mark what belongs to a page, and so need not recur, but is no article text.
_DROPPED_MARKS = frozenset("sidebar sidebars comment comments reply replies disqus respond social share sharing related recommended recommendations newsletter subscribe signup popup modal overlay".split())
#: What belongs to the site as a rule. Whether it does is counted; these decide where too few pages were counted.
_SITE = frozenset("nav footer menu search".split())
_SITE_ROLES = frozenset("navigation banner contentinfo menu menubar toolbar".split())
_SITE_MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices widget widgets pagination pager banner".split())
#: Blocks of text alone: they have a slot of their own only if they have a class or id.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption figcaption summary legend blockquote pre hr address center hgroup".split())
_ROOTS = frozenset(["article", "main"])
#: An open element that a start tag of the key's kind ends, if no element of the last set is between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "marks", "children", "dropped", "site", "root")

    def __init__(self, tag: str, marks: str = "", dropped: bool = False, site: bool = False, root: bool = False):
        self.tag, self.marks, self.children, self.dropped, self.site, self.root = tag, marks, [], dropped, site, root


def _node(tag: str, raw: str) -> Node:
    if not raw or raw.isspace():
        return Node(tag, "", tag in _DROPPED, tag in _SITE, tag in _ROOTS)
    attributes = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(raw):
        attributes.setdefault((name or bare).lower(), a or b or c)
    marks = " ".join(sorted({*_DIGITS.sub("0", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()).split()}))
    role = attributes.get("role", "").lower()
    hidden = "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    said = frozenset(re.split(r"[^a-z]+", marks))
    dropped = tag in _DROPPED or role in _DROPPED_ROLES or hidden or not _DROPPED_MARKS.isdisjoint(said)
    site = tag in _SITE or role in _SITE_ROLES or not _SITE_MARKS.isdisjoint(said)
    return Node(tag, marks, dropped, site, (tag in _ROOTS or role in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower()))


def parse(page: str) -> Node:
    """A tree of elements and raw strings; forgiving, as browsers are, about tags that are not closed or not open."""
    top = Node("html")
    stack, at, n = [top], 0, len(page)
    for_token = _TOKEN.search
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            break
        m = for_token(page, begin)
        if not m:
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[1] or m[3] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[0][1] == "/":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
            if tag in _ENDS:
                ended, within = _ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ended:
                        del stack[k:]
                        break
                    if stack[k].tag in within:
                        break
        node = _node(tag, m[2] or m[4] or "")
        stack[-1].children.append(node)
        if tag in _VOID or (m[0].endswith("/>") and tag not in _BLOCK and tag not in _RAW):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    if at < n:
        stack[-1].children.append(page[at:])
    return top


def _walk(node: Node) -> Iterator[tuple[Node, bool]]:
    """Nodes from the top down, and once more when all below have been seen; without recursion, as pages may nest deep."""
    stack = [(node, False)]
    while stack:
        x, done = stack.pop()
        yield x, done
        if not done:
            stack.append((x, True))
            stack.extend((c, False) for c in reversed(x.children) if isinstance(c, Node))


def _roots(top: Node) -> set[int]:
    """Outermost article or main elements that are not marked as something else, such as reader comments."""
    found, inside, off = set(), 0, 0
    for x, done in _walk(top):
        step = -1 if done else 1
        if (x.dropped or x.site) and x.tag not in ("html", "body"):
            off += step
        if x.root and not off:
            if not done and not inside:
                found.add(id(x))
            inside += step
    return found


def _around(top: Node, roots: set[int]) -> set[int]:
    """Elements that hold a root: never dropped for their class or their hash."""
    out, counts = set(), []
    for x, done in _walk(top):
        if not done:
            counts.append(id(x) in roots)
        elif counts.pop():
            out.add(id(x))
            if counts:
                counts[-1] = True
    return out


def _signed(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _even(text: str, short: int = 80) -> str:
    """Numbers in a short text, such as that of a link to a page, count as the same; in a longer one they may be all it says."""
    return _DIGITS.sub("0", text) if len(text) <= short else text


def subtrees(top: Node, host: str = "") -> dict[int, tuple[int, int, int]]:
    """Of each element with a slot and any text, by id: slot, hash of the subtree, and hash of the subtree around it.

    A hash is of tags, classes and texts. What differs from page to page is evened out: white space, numbers in short
    texts, the host's own name, and all attributes but class and id, so link targets too.
    """
    out: dict[int, tuple[int, int, int]] = {}
    parts: list[list[str]] = [[]]
    paths, inner = [""], [[]]
    for x, done in _walk(top):
        if not done:
            paths.append(f"{paths[-1]}>{x.tag} {x.marks}")
            parts.append([])
            inner.append([])
            continue
        path, own, below = paths.pop(), parts.pop(), inner.pop()
        texts = iter(own)
        said = [next(texts) if isinstance(c, Node) else _even(" ".join(c.split())) for c in x.children]
        text = "|".join(said)
        if host and host in text:
            text = text.replace(host, "@")
        empty = not any(said)
        value = 0 if empty else _signed(f"<{x.tag} {x.marks}>{text}")
        for key, slot, own_hash in below:
            out[key] = slot, own_hash, value
        parts[-1].append("" if empty else str(value))
        if not empty and x.tag in _BLOCK and x.tag not in ("html", "body", "head") and (x.marks or x.tag not in _TEXT):
            inner[-1].append((id(x), _signed(path), value))
    return out


def text_of(top: Node, host: str = "", slots: dict[int, bool] | None = None, hashes: frozenset[int] = frozenset()) -> tuple[str, int, int]:
    """The blocks of text that are left, in page order, joined by two line feeds; elements gone by counts, and by tags.

    slots: those that were counted, True for the site's, False for the page's own. hashes: subtrees that recur.
    """
    slots = slots or {}
    roots = _roots(top)
    around = _around(top, roots)
    counted = subtrees(top, host) if slots or hashes else {}
    blocks: list[str] = []
    line: list[str] = []
    gone = [0, 0]

    def end() -> None:
        if line:
            if text := " ".join(html.unescape("".join(line)).split()):
                blocks.append(text)
            line.clear()

    # (node, whether it is in the article); a string is text, None the end of a block
    stack: list[tuple[Node | str | None, bool]] = [(top, not roots)]
    while stack:
        x, kept = stack.pop()
        if x is None:
            end()
            continue
        if isinstance(x, str):
            if kept:
                line.append(x)
            continue
        if x.tag == "br":
            line.append(" ")
            continue
        if id(x) not in around:
            slot, own, _ = counted.get(id(x), (None, None, None))
            verdict = slots.get(slot)
            if verdict or own in hashes:
                gone[0] += 1
                continue
            if x.dropped:
                gone[1] += 1
                continue
            if verdict is False:
                kept = True  # the page's own by count, whatever its tag and wherever it stands
            elif x.site or (x.tag == "header" and (not kept or not roots)):
                gone[1] += 1
                continue
        kept = kept or id(x) in roots
        if x.tag in _BLOCK:
            end()
            stack.append((None, kept))
        stack.extend((c, kept) for c in reversed(x.children))
    end()
    return "\n\n".join(blocks), *gone


def templates(counts: DataFrame, pages: DataFrame, *, template: float, own: float, sure: int, pooled: int, least: int, most: float) -> DataFrame:
    """Rows (host, slots, hashes): the verdicts on a host's slots, and its recurring subtrees.

    counts: host, slot, hash and n, the different surroundings that the subtree is met in; pages: host and n_pages.
    """
    by_slot = counts.groupBy("host", "slot").agg(F.count("*").alias("contents"), F.count_if(F.col("n") > 1).alias("recurring"), F.sum("n").alias("met"))
    alike = by_slot.join(pages, "host").where(F.col("n_pages") >= pooled).groupBy("slot").agg((F.sum("recurring") / F.sum("contents")).alias("share"), F.sum("met").alias("met"))
    anywhere = alike.where((F.col("met") >= sure) & (F.col("share") >= template)).select("slot", F.lit(True).alias("pooled"))
    share = F.col("recurring") / F.col("contents")
    here = F.when(F.col("met") >= sure, F.when(share >= template, True).when((share <= own) & (F.col("met") >= 2 * sure), False))
    verdicts = by_slot.withColumn("here", here).join(anywhere, "slot", "left").select("host", "slot", F.coalesce("here", F.when(F.col("met") < sure, F.col("pooled"))).alias("site")).where("site is not null")
    slots = verdicts.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "site"))).alias("slots"))
    often = counts.where(F.col("n") >= least).join(pages, "host").where(F.col("n") >= most * F.col("n_pages")).groupBy("host").agg(F.collect_set("hash").alias("hashes"))
    return slots.join(often, "host", "full")


def extract(pages: DataFrame, *, template: float = 0.3, own: float = 0.06, sure: int = 100, pooled: int = 30, least: int = 10, most: float = 0.5, max_sent: int = 200_000) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text, n_chars, n_template, n_marked (elements gone by counts, by tags).

    A slot is the site's where a share of `template` or more of its different contents on the host are met in more than
    one surrounding; it is the page's own where at most `own` of them are. Both need it met on `sure` pages of the host,
    the second on twice as many. Where it is met less, the slot's share over all hosts of `pooled` pages or more stands
    in for the first. In a slot of either kind, a subtree met in `least` surroundings and on `most` of the host's pages
    goes. Copies of an article are one content of its slot, so they count once however many there are, and article and
    main elements never go.

    Elements of the site go; those of the page stay, whatever their tags. Code, controls, forms, sidebars, reader
    comments and other things marked as a page's own but no article go on any host. Where counts leave a slot open, as
    on hosts of few pages, tags and marks decide: menus, headers, footers, adverts and notices go, and so does all
    outside of article and main elements if there are any. White space in a block becomes one space and character
    references are decoded.

    A null or empty html gives an empty text; a null url is a host of its own; an empty table gives no rows; rows with
    one page_id are each extracted; other columns are left out. A host with most of the pages is only counted, never
    gathered: its counts are spread by slot and hash.
    """
    pages = text_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw in slices(batches, "html"):
            rows = [(h, None, None, None) for h in piece.column("host").to_pylist()]  # one for the page
            for h, x in zip(piece.column("host").to_pylist(), raw, strict=True):
                rows.extend((h, *own) for own in set(subtrees(parse(x.decode("utf-8", "replace")), h).values()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))], ["host", "slot", "hash", "around"])

    seen = pages.select(host.alias("host"), "html").mapInArrow(hashes, HASHES).groupBy("host", "slot", "hash", "around").agg(F.count("*").alias("n"))
    seen = stored(seen, "subtrees")
    counts = seen.where("slot is not null").groupBy("host", "slot", "hash").agg(F.count("*").alias("n"))
    found = stored(templates(counts, seen.where("slot is null").select("host", F.col("n").alias("n_pages")), template=template, own=own, sure=sure, pooled=pooled, least=least, most=most), "template")
    size = found.agg(F.sum(F.coalesce(F.size("slots"), F.lit(0)) + F.coalesce(F.size("hashes"), F.lit(0)))).first()[0] or 0
    with_host = pages.withColumn("host", host)
    joined = with_host.join(F.broadcast(found) if size <= max_sent else found, "host", "left").select("page_id", "url", "html", "host", "slots", "hashes")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw in slices(batches, "html"):
            known = [piece.column(c).to_pylist() for c in ("host", "slots", "hashes")]
            out = [text_of(parse(x.decode("utf-8", "replace")), h, dict(s or ()), frozenset(t or ())) for x, h, s, t in zip(raw, *known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id"), piece.column("url"), pa.array([x[0] for x in out], pa.string()), pa.array([len(x[0]) for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2))],
                ["page_id", "url", "text", "n_chars", "n_template", "n_marked"],
            )

    return joined.mapInArrow(texts, EXTRACTED)
