"""Main text of web pages: a style tree per site says which branches carry no information.

The pages of a host are merged by style: nodes with the same chain of elements and classes are one node of the
site's tree. A node that carries text is worth as much as its texts are spread thin over the site; an inner node adds
how much the make-up of its children varies. Few pages say little, so what they say is weighed against what the same
style is worth on other hosts. Branches of low worth are left out of every page, boxes inside an article too.

Elements that HTML has for frames (nav, footer, aside ...) and hidden branches are out. Class words are a prior, not a
verdict: a branch that a class word calls a frame stays if the page has its prose there and nowhere else.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.base import prepare
from fieldlens.session import materialized

#: Branches worth less are dropped, inside an article boxes worth less than the second; how much an inner node's own
#: variety counts; how many pages of evidence the worth of a style on all hosts stands for.
IMPORTANCE, INSIDE, DAMPING, PRIOR = 0.2, 0.1, 0.9, 2.0
TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Fixed values of HTML: elements that stand in a line, that have no content, whose content is not markup.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr input "
    "math semantics mrow mi mn mo ms mspace mtext mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover "
    "munderover mmultiscripts mprescripts none mtable mtr mtd maction mglyph".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes annotation annotation-xml".split())
#: Of these an end tag may be missing for good, the rest of the page is theirs; of the others only the tag itself goes then.
TO_THE_END = frozenset(("script", "style"))
#: Elements of RAW that may close themselves.
FOREIGN = frozenset(("svg", "annotation", "annotation-xml"))
#: Elements and class words of branches that are not main text.
ROLES = frozenset("nav footer aside form button select dialog menu head".split())
WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "complementary discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices popup promo related "
    "replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
MAIN = frozenset(("article", "main"))
#: A class word names the branch as a whole or as the leading part, as in sidebar-left, but not with a state after it, as
#: in comments-open. At the end it does after a place of the page, as in site-nav, and not as in has-sidebar.
STATES = frozenset("active closed disabled enabled free hidden layout less off on open visible".split())
PLACES = frozenset("bottom entry footer global google header left main mobile page post primary right secondary site sub top".split())
#: What may follow a leading class word: parts of a page, as in ad-slot. Any other word has a meaning of its own, as in
#: share-price.
PIECES = frozenset(
    "area bar block body bottom box button buttons col column container content count form heading icon icons id inner item items left link "
    "links list message outer panel post posts right row section slot text title top unit wrap wrapper".split()
)
#: A token with such a last part names the article itself, whatever else the class says.
TEXTS = frozenset("article body content entry story text".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Without a class these are parts of a running text and not boxes; parts of tables never are.
PLAIN = frozenset("p ul ol li dl dt dd pre blockquote figure figcaption hgroup details summary address center article main".split())
TABLES = frozenset("table thead tbody tfoot tr td th caption colgroup".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)|style\s*=\s*[\"']?[^\"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: A block of so many words, or characters where words are not parted by blanks, is prose.
PROSE_WORDS, PROSE_CHARS = 8, 60
#: Pages with the same longest block of so many characters are copies.
TELLING = 200


def names_frame(named: str) -> bool:
    found = False
    for token in named.lower().split():
        parts = [x for x in re.split(r"[^a-z]+", token) if x]
        if not parts:
            continue
        if len(parts) > 1 and parts[-1] in TEXTS and parts[0] not in WORDS:
            return False
        if parts[0] in WORDS and not STATES.intersection(parts[1:]):
            found |= all(x in WORDS or x in PIECES or x in PLACES for x in parts[1:])
        found |= len(parts) == 2 and parts[1] in WORDS and parts[0] in PLACES
    return found


def raw_ends(page: str, name: str) -> dict[int, int]:
    """For every start tag of the element that has an end tag: where the one begins and where the other ends."""
    out: dict[int, int] = {}
    begun: list[int] = []
    nests = name in FOREIGN or name not in RAW
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>]|$)[^>]*>?", re.I).finditer(page):
        if not m[1]:
            if not nests or not m[0].endswith("/>"):
                begun.append(m.start())
        elif begun:
            if nests:
                out[begun.pop()] = m.end()
            else:  # the first end tag ends all that began before
                out.update(dict.fromkeys(begun, m.end()))
                begun.clear()
    return out


MAIN_TEXT, WRAPPED, FRAMED = 1, 2, 3


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))


class Block(NamedTuple):
    """A block of text: its style nodes from the root down, where they are boxes inside an article or main, whether it
    is a heading, its place, its innermost article with what holds that, and the branch that a class word calls a frame."""

    nodes: list[int]
    boxes: list[int]
    heading: str
    place: int
    articles: tuple[int, ...]
    frame: int
    text: str


def parse(page: str) -> Iterator[Block]:
    """Every block with text, in page order.

    The place is MAIN_TEXT inside article or main, WRAPPED inside one that a class word or a form would drop, FRAMED in
    another such branch, else 0. A block's text is what stands between two boundaries of block elements. Branches that
    are out by their element or hidden, and what a class word drops inside a wrapped article, are not reported. A missing end
    tag ends with its parent; a paragraph also ends where the next block begins.
    """
    # element, out by element, out by class or as a form, article or main, the same inside one that is out by class
    stack: list[tuple[str, int, int, int, int]] = []
    nodes = [xxhash.xxh64_intdigest("root") >> 1]
    boxes: list[int] = [0]
    articles: list[int] = []
    frames: list[int] = []
    met = 0
    out_depth = named_depth = main_depth = wrapped_depth = 0
    text: list[str] = []
    at, n = 0, len(page)

    def flush():
        words = html.unescape("".join(text)).split()
        text.clear()
        if words and not out_depth:
            place = (WRAPPED if wrapped_depth else FRAMED) if named_depth else MAIN_TEXT if main_depth else 0
            inside = [node for node, box in zip(nodes, boxes, strict=True) if box] if main_depth else []
            top = stack[-1][0] if stack and stack[-1][0] in HEADINGS else ""
            return Block(nodes.copy(), inside, top, place, tuple(articles), frames[0] if frames else 0, " ".join(words))
        return None

    def pop():
        nonlocal out_depth, named_depth, main_depth, wrapped_depth
        name, out, by_name, is_main, wrapped = stack.pop()
        nodes.pop()
        boxes.pop()
        open_tags[name] -= 1
        out_depth -= out
        named_depth -= by_name
        main_depth -= is_main
        wrapped_depth -= wrapped
        if by_name:
            frames.pop()
        if name == "article":
            articles.pop()

    open_tags: dict[str, int] = {}
    ends: dict[str, dict[int, int]] = {}
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not closing:
            if name in FOREIGN and page.endswith("/>", 0, at):
                continue
            if name not in ends:
                ends[name] = raw_ends(page, name)
            at = max(at, ends[name].get(m.start(), n if name in TO_THE_END else at))
            continue
        if name == "br":
            text.append("\n")
            continue
        hidden = bool(attrs) and not closing and name not in ("html", "body") and HIDDEN.search(attrs) is not None
        if name in INLINE or name in RAW:
            if hidden and name not in VOID and name not in RAW:
                if name not in ends:
                    ends[name] = raw_ends(page, name)
                at = max(at, ends[name].get(m.start(), at))
            continue
        block = flush()
        if block:
            yield block
        if closing:
            if open_tags.get(name, 0):
                while stack:
                    top = stack[-1][0]
                    pop()
                    if top == name:
                        break
            continue
        if name in VOID:
            continue
        while stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack and name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == name:
            pop()
        named = " ".join(a or b or c for a, b, c in NAMED.findall(attrs)) if attrs else ""
        # a wrapper with a frame's name may hold the article; inside that article it goes whole
        by_name = name == "form" or bool(named) and name not in ("html", "body") and names_frame(named)
        is_main = name in MAIN
        out = hidden or name in ROLES and name != "form" or name == "header" and not main_depth
        out = out or by_name and wrapped_depth > 0 and not is_main
        by_name = by_name and not out and not is_main
        style = f"{name} {re.sub(r'[0-9]+', '0', named.lower())}" if named else name
        wrapped = is_main and named_depth > 0
        stack.append((name, out, by_name, is_main, wrapped))
        nodes.append(xxhash.xxh64_intdigest(style, seed=nodes[-1]) >> 1)
        boxes.append(int(main_depth > 0 and name not in HEADINGS and name not in TABLES and (bool(named) or name not in PLAIN)))
        met += 1
        if by_name:
            frames.append(met)
        if name == "article":
            articles.append(met)
        open_tags[name] = open_tags.get(name, 0) + 1
        out_depth += out
        named_depth += by_name
        main_depth += is_main
        wrapped_depth += wrapped
    block = flush()
    if block:
        yield block


def is_prose(text: str) -> bool:
    return len(text) >= PROSE_CHARS or text.count(" ") + 1 >= PROSE_WORDS


def leading(blocks: list[Block]) -> list[Block]:
    """The blocks of the article a page is about, with what holds it and its equals.

    That is the article with a main heading, then with the most text of its own; articles in it are comments, others
    teasers, unless they have the same style, heading and half its text. A main element that says more outside its
    articles than each of them, which have no main heading, is about none of them.
    """
    own: dict[tuple[int, ...], list] = {}
    outside = 0
    for b in blocks:
        if b.articles:
            held = own.setdefault(b.articles, [False, 0, b.nodes])
            held[0] |= b.heading == "h1"
            held[1] += len(b.text)
            if len(b.nodes) < len(held[2]):
                held[2] = b.nodes
        else:
            outside += len(b.text)
    if len(own) < 2 and not (own and outside):
        return blocks
    lead, (headed, size, style) = max(own.items(), key=lambda kv: (kv[1][0], kv[1][1]))
    if outside > size and not headed:
        return [b for b in blocks if not b.articles]
    alike = {
        path for path, (h, n, nodes) in own.items()
        if len(path) == len(lead) and path[:-1] == lead[:-1] and h == headed and 2 * n >= size and nodes[:-1] == style[:-1]
    }
    return [b for b in blocks if b.articles in alike or b.articles == lead[: len(b.articles)]]


def main_blocks(blocks: list[Block], drop: set[int], inside: set[int]) -> list[Block]:
    """The blocks of a page's main text, given the branches of low worth outside articles and inside."""
    for place in (MAIN_TEXT, WRAPPED):
        found = [b for b in blocks if b.place == place]
        if found:
            found = leading(found)
            return [b for b in found if b.heading or inside.isdisjoint(b.boxes)] if inside else found
    rest = [b for b in blocks if drop.isdisjoint(b.nodes)] if drop else blocks
    free = [b for b in rest if b.place != FRAMED]
    if any(is_prose(b.text) for b in free):
        return free
    # the prose is in a branch that a class word calls a frame
    prose: dict[int, int] = {}
    for b in rest:
        if b.place == FRAMED and is_prose(b.text):
            prose[b.frame] = prose.get(b.frame, 0) + len(b.text)
    kept = max(prose, key=lambda f: (prose[f], -f)) if prose else 0
    return [b for b in rest if b.place != FRAMED or b.frame == kept]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its style nodes with their parents, and the hashes of the texts that stand at each.

    ``page`` becomes the hash of the longest block of its main text, or of all its blocks if the longest is short. Copies
    of an article under other addresses, in frames of other texts, in print views or with another date share it. Blocks
    that a class word calls a frame take no part where the page has other text.
    """
    names = ["host", "page", "node", "parent", "feature"]
    for b in batches:
        rows = []
        for host, source in zip(*(b.column(c).to_pylist() for c in ("host", "html")), strict=True):
            there: set[int] = set()
            texts: set[tuple[int, int, int]] = set()
            blocks = list(parse(source or ""))
            begun = len(rows)
            for block in blocks:
                nodes = block.nodes
                for i in range(len(nodes) - 1, -1, -1):
                    if nodes[i] in there:
                        break
                    there.add(nodes[i])
                    rows.append((host, nodes[i], nodes[i - 1] if i else 0, None))
                texts.add((nodes[-1], nodes[-2] if len(nodes) > 1 else 0, xxhash.xxh64_intdigest(block.text) >> 1))
            said = [x.text for x in main_blocks(blocks, set(), set())]
            longest = max(said, key=len, default="")
            page = xxhash.xxh64_intdigest(longest if len(longest) >= TELLING else "\n".join(said)) >> 1
            rows += [(host, *t) for t in texts]
            rows[begun:] = [(host, page, *row) for host, *row in rows[begun:]]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)


def site_trees(pages: DataFrame) -> DataFrame:
    """host, node, value: the branches of each host's style tree that are worth less than IMPORTANCE.

    The entropy of a text over the m different pages of a node, to the base m, is log k / log m if it stands once on k
    of them; the node's content is worth one minus the mean of its texts. Of a node on m pages this is known by m - 1
    comparisons; PRIOR more count what nodes of the same style are worth on all hosts, by their comparisons, and there
    again PRIOR count as one. So no host is too small to be judged, and one page alone is judged by other hosts. Pages that
    say the same count once in k and m.
    """
    found = pages.mapInArrow(_nodes, "host string, page long, node long, parent long, feature long")
    found = materialized(found.distinct(), "page-nodes")
    per_node = found.filter("feature is null").groupBy("host", "node", "parent").agg(F.count("*").alias("m"))
    per_text = found.filter("feature is not null").groupBy("host", "node", "feature").agg(F.count("*").alias("k"))
    content = (
        per_text.join(per_node.select("host", "node", "m"), ["host", "node"]).groupBy("host", "node")
        .agg(F.greatest(F.lit(0.0), 1 - F.avg(F.when(F.col("m") > 1, F.log("k") / F.log("m")).otherwise(0.0))).alias("_c"),
             (F.max("m") - 1).alias("_w"))
    )
    style = content.groupBy("node").agg(((F.sum(F.col("_c") * F.col("_w")) + PRIOR) / (F.sum("_w") + PRIOR)).alias("_s"))
    content = content.join(style, "node").select(
        "host", "node", ((F.col("_c") * F.col("_w") + PRIOR * F.col("_s")) / (F.col("_w") + PRIOR)).alias("content")
    )
    worth = per_node.join(content, ["host", "node"], "left")

    def judge(g: pd.DataFrame) -> pd.DataFrame:
        """Bottom-up over the nodes of one host: one row per distinct style, whatever the number of pages."""
        rows = {r.node: r for r in g.itertuples()}
        children: dict[int, list[int]] = {}
        for r in g.itertuples():
            children.setdefault(r.parent, []).append(r.node)
        value: dict[int, float] = {}
        low: set[int] = set()
        todo = [(n, False) for n in rows]
        while todo:
            node, ready = todo.pop()
            if node in value:
                continue
            below = [c for c in children.get(node, ()) if c != node]
            if not ready and any(c not in value for c in below):
                todo.append((node, True))
                todo.extend((c, False) for c in below)
                continue
            r = rows[node]
            own = 0.0 if r.content is None or math.isnan(r.content) else max(0.0, r.content)
            if below:
                # variety of presentation: how evenly the pages are split over having each child or not
                m = max(2, r.m, *(rows[c].m for c in below))
                shares = [rows[c].m / m for c in below]
                variety = min(1.0, sum(-p * math.log(p, m) for p in shares if 0 < p < 1))
                keep = DAMPING ** len(below)
                inner = sum(value.get(c, 1.0) * s for c, s in zip(below, shares, strict=True)) / sum(shares)
                own = max(own, (1 - keep) * variety + keep * inner)
            value[node] = own
            # a branch goes only as a whole: nothing below it may be worth keeping
            if own < IMPORTANCE and low.issuperset(below):
                low.add(node)
        hosts = pd.Series([str(g["host"].iloc[0])] * len(low), dtype=object)
        gone = sorted(low)
        return pd.DataFrame({"host": hosts, "node": pd.Series(gone, dtype="int64"), "value": pd.Series([value[x] for x in gone], dtype="float64")})

    return worth.groupBy("host").applyInPandas(judge, "host string, node long, value double")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null and empty html give an empty text. If a page has an article or main element, the blocks inside are the text:
    of several articles the one with a main heading, then the most text, and its equals (``leading``). Headings, plain
    paragraphs, lists and tables in it stay however often they stand on the host; boxes in it (divisions, sections and
    what has a class) go if they are worth less than INSIDE or a class word calls them frames. Without such an element
    the blocks that the style tree leaves are the text. An article inside a wrapper whose
    name would drop it counts as text of a page that has no other article. Pages without a host share one tree. Rows repeated under one page_id are answered
    each; null ids and urls are passed on; other columns are ignored; an empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    base = pages.select("page_id", "url", "html", host_of().alias("host"))
    low = materialized(site_trees(base.select("host", "html")).groupBy("host").agg(F.collect_list(F.struct("node", "value")).alias("low")), "site-trees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, gone in zip(b.column("html").to_pylist(), b.column("low").to_pylist(), strict=True):
                drop = {x["node"] for x in gone or ()}
                inside = {x["node"] for x in gone or () if x["value"] < INSIDE}
                texts.append("\n".join(x.text for x in main_blocks(list(parse(source or "")), drop, inside)))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    low = low.withColumnRenamed("host", "_host")
    return (
        base.join(low, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "low")
        .withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
    )
