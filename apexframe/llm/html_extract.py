"""Main text of web pages by consensus of each host's pages.

Pass 1 parses every page and scores its containers by their plain text, which is that outside links and
boilerplate: the best is an article or main that covers most of it, else the innermost
container that has all of it. The generalised path of the container found (tags and classes, numbers
removed; a chain of hashes) is the page's vote. Each element whose name sounds like boilerplate gets a vote too: for the
article's wrapper if it has most of the page's plain text, else against it. Spark sums the votes by host and path, combining them in
each task before the shuffle, and picks each host's winner and the elements its pages agree on. Pass 2 parses the pages again
and extracts the containers with the winning path; a page that has none of them, or clearly less text in them than
in its own best container, uses that. A host's winners are broadcast if there are few hosts, else joined in parts for large hosts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.common import lookup, spread, stored

# HTML elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("aside button canvas dialog footer head header iframe menu nav noscript object select svg template".split()) | RAW
CONTAINERS = frozenset("article body div main section td".split())
SEMANTIC = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P_SCOPE = "button caption object table td template th".split()
LISTS = "dl ol select table ul".split()
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of class and id names, and roles, that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead "
    "menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

#: An article or main is the page's own best if it covers that part of the page's plain text.
COVERS = 0.6
#: The host's path must cover that part of the plain text in the page's own best.
KEEPS = 0.9
SEMANTIC_BONUS = 1.5

#: A marked element with that part of the page's plain text may be the article's wrapper, unless the host's pages agree otherwise.
WRAPS = 0.75
#: The mark of a form, and the part of its text that must stand in paragraphs if it wraps the article.
FORM = 3
PROSE = 0.5
#: Pages of a host that must have a marked element for them to agree on it.
VOTERS = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*))>?|<[!?][^>]*>?", re.S)
#: One attribute, whole: its name, and its value in whatever quotes.
_ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|[\"'=/]")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


@lru_cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>?", re.I)


class Node:
    """A container or a marked element: its generalised path as a hash chain, its span of parts, and its plain characters."""

    __slots__ = ("article", "dropped", "end", "first", "inside", "mark", "own", "parent", "path", "plain", "prose", "tag", "wraps")

    def __init__(self, parent: int, path: int, tag: str, mark: int, first: int):
        self.parent, self.path, self.tag, self.mark, self.first, self.end = parent, path, tag, mark, first, first
        self.own = 0  # plain characters in the node itself
        self.prose = 0  # of those, in paragraphs; summed over the subtree by and by
        self.inside = 0  # in all of its subtree
        self.plain = 0  # in its subtree without what is dropped
        self.article = False  # an article or main stands in it
        self.wraps = self.dropped = False


@lru_cache(maxsize=20_000)
def _names(attributes: str) -> tuple[str, int]:
    """Generalised classes of a start tag, and its mark: 0 none, 1 a word in a name, 2 a whole name or a role."""
    found: dict[str, str] = {}
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), a or b or c)  # of attributes of one name the first counts
    named = f"{found.get('class', '')} {found.get('id', '')}"
    plain = re.sub(r"\d+", "", named).lower().split()
    classes = ".".join(sorted({re.sub(r"\d+", "", c) for c in found.get("class", "").split()} - {""}))
    if found.get("role", "").lower() in ROLES or not MARKS.isdisjoint(plain):
        return classes, 2
    return classes, int(not MARKS.isdisjoint(w.lower() for w in _WORDS.findall(named)))


class Page:
    """One parsed page: its text in order, each part with the node it stands in.

    ``consensus`` maps paths of marked elements to what the host's pages say of them: True for the article's wrapper, False for
    boilerplate. Parsing takes one pass and a stack with the places of each open tag, so depth costs nothing but the stack.
    """

    def __init__(self, source: str, consensus: dict[int, bool] | None = None):
        self.parts: list[str] = []
        self.owner: list[int] = []
        self.nodes = [Node(-1, 0, "", 0, 0)]
        self._parse(source)
        self._judge(consensus or {})

    def _parse(self, source: str) -> None:
        parts, owner, nodes = self.parts, self.owner, self.nodes
        stack: list[tuple[str, int, bool, bool]] = []  # tag, the node outside, and whether it was dropped or in a link there
        places: dict[str, list[int]] = {}  # of each open tag, its places in the stack
        node, dropped, linked, at, n = 0, False, False, 0, len(source)

        def gap() -> None:
            if not dropped:
                parts.append(" ")
                owner.append(node)

        def text(piece: str) -> None:
            if piece and not dropped:
                parts.append(entities.unescape(piece) if "&" in piece else piece)
                owner.append(node)
                if not linked:
                    size = len(piece.strip())
                    nodes[node].own += size
                    nodes[node].prose += size if places.get("p") else 0

        def close(depth: int) -> None:
            nonlocal node, dropped, linked
            while len(stack) > depth:
                tag, outside, was_dropped, was_linked = stack.pop()
                places[tag].pop()
                if outside != node:
                    nodes[node].end = len(parts)
                node, dropped, linked = outside, was_dropped, was_linked
                if tag not in INLINE:
                    gap()

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=-1)

        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                text(source[at:])
                break
            text(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if (depth := last((tag,))) >= 0:
                    close(depth)
                elif tag not in INLINE:
                    gap()
                continue
            if tag in VOID:
                if tag not in INLINE and tag != "img":
                    gap()
                continue
            if tag in CLOSES_P and (depth := last(("p",))) > last(P_SCOPE):
                close(depth)
            if tag in SIBLINGS and (depth := last(SIBLINGS[tag])) > last(LISTS):
                close(min(places[t][-1] for t in SIBLINGS[tag] if places.get(t) and places[t][-1] > last(LISTS)))
            if tag in RAW:
                end = _raw_end(tag).search(source, at)
                at = end.end() if end else n
                continue
            if tag not in INLINE:
                gap()
            stack.append((tag, node, dropped, linked))
            places.setdefault(tag, []).append(len(stack) - 1)
            dropped, linked = dropped or tag in DROPPED, linked or tag == "a"
            if dropped:
                continue
            classes, mark = _names(m[3]) if m[3] else ("", 0)
            # A heading's anchor says what its section is about; a form is kept only where it wraps the article.
            mark = 0 if tag in ("html", "body", *SEMANTIC, *HEADINGS) else FORM if tag == "form" else mark
            if mark or tag in CONTAINERS:
                path = xxhash.xxh3_64_intdigest(f"{nodes[node].path}>{tag}.{classes}") >> 1
                nodes.append(Node(node, path, tag, mark, len(parts)))
                node = len(nodes) - 1
        close(0)
        nodes[0].end = len(parts)

    def _judge(self, consensus: dict[int, bool]) -> None:
        """Which marked elements are dropped, and what each node has without them; one pass up and one down."""
        nodes = self.nodes
        for v in nodes:
            v.inside = v.own
        for v in reversed(nodes[1:]):
            up = nodes[v.parent]
            up.inside += v.inside
            up.prose += v.prose
            up.article |= v.article or v.tag in SEMANTIC
        total = nodes[0].inside
        # By node: the marked element it stands in (-1: none), articles above it, and articles under no other mark than those around it.
        under, above = [-1] * len(nodes), [0] * len(nodes)
        articles = [0] * (len(nodes) + 1)
        for i, v in enumerate(nodes[1:], 1):
            up = v.parent
            under[i] = up if nodes[up].mark else under[up]
            above[i] = above[up] + (nodes[up].tag in SEMANTIC and nodes[up].inside > 0)
            if v.tag in SEMANTIC and v.inside:
                articles[under[i]] += 1
        beside = [0] * len(nodes)
        for i, v in enumerate(nodes[1:], 1):
            up = nodes[v.parent]
            v.dropped = up.dropped
            if not v.mark:
                continue
            outer = under[i]
            beside[i] = articles[outer] + (beside[outer] if outer >= 0 else 0)
            # No wrapper stands beside an article with text; a name that as a whole is a mark needs an article inside.
            may = not v.dropped and beside[i] == above[i] and self._may_wrap(v)
            v.wraps = may and consensus.get(v.path, v.inside > 0 and v.inside >= WRAPS * total)
            v.dropped |= not v.wraps
        for v in nodes:
            v.plain = 0 if v.dropped else v.own
        for v in reversed(nodes[1:]):
            nodes[v.parent].plain += v.plain

    @staticmethod
    def _may_wrap(v: Node) -> bool:
        return v.mark == 1 or v.article or (v.mark == FORM and v.prose >= PROSE * v.inside > 0)

    def marks(self) -> Iterator[tuple[int, int]]:
        """(path, vote) of the marked elements that could wrap an article: positive if it has most of the page's plain text."""
        total = self.nodes[0].inside
        for v in self.nodes[1:]:
            if v.mark and total and not self.nodes[v.parent].dropped and self._may_wrap(v):
                yield v.path, round(2000 * v.inside / total) - 1000

    def best(self) -> tuple[int, float]:
        """The container that the page votes for, and the part of the page's text that it covers."""
        nodes = self.nodes
        total = nodes[0].plain
        if not total:
            return 0, 0.0
        # Outermost articles whose containers all cover the page's text: what stands outside them isn't the article.
        open_to, articles = [True], []
        for i, v in enumerate(nodes[1:], 1):
            covers = open_to[v.parent] and not v.dropped and v.plain * (SEMANTIC_BONUS if v.tag in SEMANTIC else 1.0) >= COVERS * total
            if covers and v.tag in SEMANTIC:
                articles.append(i)
            open_to.append(covers and v.tag not in SEMANTIC)
        if articles:
            at = max(articles, key=lambda i: (nodes[i].plain, -i))
            return at, nodes[at].plain / total
        # Else down to the innermost container that still has all plain text.
        at = 0
        for i, v in enumerate(nodes[1:], 1):
            if v.parent == at and v.plain == total:
                at = i
        return at, 1.0

    def _span(self, v: Node) -> str:
        return " ".join("".join(self.parts[k] for k in range(v.first, v.end) if not self.nodes[self.owner[k]].dropped).split())

    def text(self, path: int | None) -> str:
        """Text of the containers with that path, else of the page's own best."""
        own = self.nodes[self.best()[0]]
        spans, end = [], -1
        for v in self.nodes:
            if v.path == path and not v.dropped and v.first >= end:
                spans.append(v)
                end = v.end
        if sum(v.plain for v in spans) < KEEPS * own.plain:
            spans = [own]
        found = " ".join(filter(None, map(self._span, spans)))
        return found or self._span(own)


def host_votes(rows: DataFrame) -> DataFrame:
    """(host, kind, path, weight, pages): the votes of all pages of (host, html) rows, summed; kind 0 is for containers, 1 for marked elements."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, kinds, paths, weights = [], [], [], []
            for h, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                page = Page(source.as_py())
                best, covers = page.best()
                found = [(0, page.nodes[best].path, round(covers * 1000))] if covers > 0 else [(0, None, 0)]
                for kind, path, weight in [*found, *((1, *x) for x in page.marks())]:
                    hosts.append(h)
                    kinds.append(kind)
                    paths.append(path)
                    weights.append(weight)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.int32()), pa.array(paths, pa.int64()), pa.array(weights, pa.int64())], names=["host", "kind", "path", "weight"])

    voted = rows.select("host", "html").mapInArrow(vote, "host string, kind int, path long, weight long")
    return voted.groupBy("host", "kind", "path").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("pages"))


def host_winners(votes: DataFrame, voters: int = VOTERS) -> DataFrame:
    """(host, n, winner, wrappers, boilerplate): each host's pages, its container path, and the paths of marked elements that its pages agree on.

    A host has few templates, so its lists are short; a path counts as agreed on from ``voters`` pages on.
    """
    place = F.struct(F.when(F.col("path").isNotNull(), F.col("weight")).alias("w"), (-F.col("path")).alias("p"))
    agreed = (F.col("kind") == 1) & (F.col("pages") >= voters)
    return votes.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("pages"))).alias("n"),
        F.max_by("path", F.when((F.col("kind") == 0) & F.col("path").isNotNull(), place)).alias("winner"),
        F.collect_list(F.when(agreed & (F.col("weight") > 0), F.col("path"))).alias("wrappers"),
        F.collect_list(F.when(agreed & (F.col("weight") <= 0), F.col("path"))).alias("boilerplate"),
    )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", voters: int = VOTERS) -> DataFrame:
    """Main text of each page: id, url, text, n_chars (code points).

    Edge cases: null html and pages without text give the empty text; a null url, or one
    without a host, votes with all others of that kind; null or repeated ids are rows
    like any other; tags nested to any depth and pages of any length are read whole; an empty table gives an empty result;
    other columns are ignored.
    """
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), _HOST, 1)
    rows = spread(pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host")))
    winners = stored(host_winners(host_votes(rows), voters), "host-winners")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, winner, wrappers, others in zip(batch.column("html"), *(batch.column(c).to_pylist() for c in ("winner", "wrappers", "boilerplate")), strict=True):
                consensus = dict.fromkeys(wrappers or (), True) | dict.fromkeys(others or (), False)
                texts.append(Page(source.as_py(), consensus).text(winner))
            out = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "url", "text", "n_chars"])

    joined = lookup(rows, winners, "host", "n", ["id", "url"]).select("id", "url", "html", "winner", "wrappers", "boilerplate")
    found = joined.mapInArrow(extract, "id long, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
