"""Main text of web pages (method: consensus host paths).

Each page's containers are scored by the prose in them and in what they contain. A
container is named by its path of tags and classes without digits. A page votes for the
deepest path that holds nearly all of its prose, raised to an element that has text of
its own beside it; the votes of a host are summed in Spark, pre-aggregated per
partition, so a host with a third of all pages is no larger group than others. A host
has a winning path for each of its templates. Every page is then read again with the
winning path that holds most of its prose, or with its own best container where that
is little of it, unless the host's pages show that container to stand beside the text.

Defined cases: null or empty html gives the empty text; a page without url votes for
the host ``""``; markup that is never closed ends with the page; repeated pages vote
as often as they stand there; of equal votes the first path by name wins; other
columns are never looked at.
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.words import chunks
from spanloom.session import broadcast_if_small, cut_lineage

#: Pages of one host that are read together.
PART = 256
#: Share of a page's prose that its container holds at least, and below which a winning path is not the page's.
NEARLY, LITTLE = 0.9, 0.5
#: Share of a host's pages that vote for a path of a template, or that have a path known to stand beside the text.
TEMPLATE, COMMON = 0.05, 0.1

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
#: Elements whose content is no text of the article, and that only their own end tag ends.
CLOSED = frozenset("svg math select button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
ASIDE = frozenset("nav header footer aside form menu head dialog".split())
#: Names (a class, id or role as a whole) that mark what is not the article: such a word,
#: alone or among words that only say where or in what it stands.
_MARK = (
    r"(?:ads?|advert[a-z]*|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|footer|menu|modal|nav[a-z]*|newsletter|"
    r"notices?|pager|pagination|popup|promo[a-z]*|recommend[a-z]*|related|replies|respond|share|sharing|sidebar|social|"
    r"sponsor[a-z]*|subscribe|toolbar|widget)"
)
_BESIDE = (
    r"(?:site|page|main|post|posts|entry|article|articles|global|primary|secondary|top|bottom|left|right|box|bar|list|area|"
    r"section|block|wrapper|container|inner|links?|items?|form|buttons?|unit|slot|text|title|[0-9]+)"
)
MARKED = re.compile(rf"(?:{_BESIDE}[-_]+)*{_MARK}[0-9]*(?:[-_]+(?:{_MARK}|{_BESIDE}))*")
#: Elements that no name marks.
NEVER_MARKED = frozenset("html body main article".split())
# an open element of the key ends where one of these begins
_P_ENDS = BLOCK - {"html", "body"}
_P_STOPS = BLOCK | CLOSED
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_STOPS = {k: v | CLOSED for k, v in {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}.items()}

# a quote opens a value only behind an equals sign
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_END_TAG = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")


_PROSE = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "dd", "dt", "td", "th", "tr", "ul", "ol", "dl", "table", "tbody"))

#: Names of a path that are written out; those above are a digest. A longer name is cut to a digest too.
NAMES, LONGEST = 32, 200


class Mark:
    """An element marked as no part of the article, and the next one around it."""

    __slots__ = ("by_name", "up", "number")

    def __init__(self, by_name: bool, up: Mark | None, number: int):
        self.by_name, self.up, self.number = by_name, up, number


class Element:
    """An open element: its tag, the number of its path, the innermost mark, and whether a first heading or main is around."""

    __slots__ = ("tag", "path", "mark", "head")

    def __init__(self, tag: str, path: int, mark: Mark | None, head: bool):
        self.tag, self.path, self.mark, self.head = tag, path, mark, head


class Block:
    """A run of text between block boundaries, with the path and the innermost mark around it."""

    __slots__ = ("text", "linked", "path", "mark", "head", "outside")

    def __init__(self, text: str, linked: int, inside: Element):
        self.text, self.linked = text, linked
        self.path, self.mark, self.head, self.outside = inside.path, inside.mark, inside.head, inside.mark is not None

    @property
    def prose(self) -> int:
        """Characters of unlinked prose."""
        return max(0, len(self.text) - 2 * self.linked)


class Page:
    """The blocks of a page and its paths, numbered so that a path comes behind the one around it."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.marks: list[Mark] = []
        self.tags, self.above, self.depth, self.names = [""], [0], [0], [""]
        #: the path itself, or the nearest around it that groups blocks rather than being one
        self.home = [0]
        self._known: dict[tuple[int, str], int] = {}
        self._strings: list[str] | None = None

    def path(self, above: int, tag: str, name: str) -> int:
        found = self._known.setdefault((above, name), len(self.tags))
        if found == len(self.tags):
            self.tags.append(tag), self.above.append(above), self.names.append(name)
            self.depth.append(self.depth[above] + 1)
            self.home.append(self.home[above] if tag in _PROSE else found)
        return found

    @property
    def strings(self) -> list[str]:
        """The paths as text of bounded length."""
        if self._strings is None:
            out = [""]
            for k in range(1, len(self.tags)):
                around, name = out[self.above[k]], self.names[k]
                if len(name) > LONGEST:
                    name = name[:LONGEST] + "#" + blake2b(name.encode("utf-8", "replace"), digest_size=8).hexdigest()
                if self.depth[k] % NAMES == 0:
                    around = "#" + blake2b(around.encode("utf-8", "replace"), digest_size=8).hexdigest()
                out.append(f"{around}>{name}")
            self._strings = out
        return self._strings

    def unmark(self) -> None:
        """Take back the marks of elements that hold most of the page's prose: wrappers of the page.

        That is nine tenths of it, or half if a first heading or ``main`` is inside. An
        element marked by its tag keeps its mark, but for a form around the page.
        """
        if not self.marks:
            return
        by_name = [False] * len(self.marks)
        for m in self.marks:  # a mark comes behind the one around it
            by_name[m.number] = m.by_name and (m.up is None or by_name[m.up.number])
        counted = [b for b in self.blocks if b.mark is None or by_name[b.mark.number]]
        total = sum(b.prose for b in counted)
        holds, heads = [0] * len(self.marks), [False] * len(self.marks)
        for b in counted:
            if b.mark is not None:
                holds[b.mark.number] += b.prose
                heads[b.mark.number] |= b.head
        for m in reversed(self.marks):
            if m.up is not None:
                holds[m.up.number] += holds[m.number]
                heads[m.up.number] |= heads[m.number]
        free = [False] * len(self.marks)
        any_block = {b.mark.number for b in counted if b.mark is not None}
        for m in reversed(self.marks):
            if m.number in any_block and m.up is not None:
                any_block.add(m.up.number)
        for m in self.marks:
            prose = holds[m.number]
            wraps = m.number in any_block and (10 * prose >= 9 * total or (2 * prose > total and heads[m.number]))
            free[m.number] = wraps and (m.up is None or free[m.up.number])
        for b in counted:
            b.outside = b.mark is not None and not free[b.mark.number]

    def shares(self) -> list[float]:
        """Share of the page's unlinked prose below each path."""
        prose = [0] * len(self.tags)
        for b in self.blocks:
            if not b.outside:
                prose[b.path] += b.prose
        for k in range(len(prose) - 1, 0, -1):
            prose[self.above[k]] += prose[k]
        return [p / prose[0] for p in prose] if prose[0] else [0.0] * len(prose)

    def below(self, path: int) -> list[str]:
        """Texts of the blocks of the article below a path."""
        inside = [False] * len(self.tags)
        for k in range(len(inside)):
            inside[k] = k == path or (k > 0 and inside[self.above[k]])
        return [b.text for b in self.blocks if not b.outside and inside[b.path]]


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """Tag with generalised classes, and whether its names mark it as no part of the article."""
    found: dict[str, str] = {}
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    classes = sorted({_DIGITS.sub("", c).strip("-_") for c in found.get("class", "").lower().split()} - {""})
    name = ".".join([tag, *classes]).replace(">", "")
    if tag in NEVER_MARKED:
        return name, False
    names = " ".join((found.get("class", ""), found.get("id", ""), found.get("role", ""))).lower().split()
    return name, any(MARKED.fullmatch(n) for n in names)


def blocks(page: str) -> Page:
    """All text blocks of a page in page order, in time that follows its length.

    Scripts and the like are passed over to their end tag, icons, lists of choices and
    buttons are kept apart from the article up to theirs; where such an element never
    closes, only its tag is passed over.
    """
    out = Page()
    stack = [Element("", 0, None, False)]
    open_ = {"": 1}
    parts: list[str] = []
    linked = links = at = 0
    last_end: dict[str, int] | None = None

    def closes(tag: str) -> bool:
        nonlocal last_end
        if last_end is None:
            last_end = {m[1].lower(): m.start() for m in _END_TAG.finditer(page)}
        return last_end.get(tag, -1) >= at

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.blocks.append(Block(text, linked, stack[-1]))
            parts, linked = [], 0

    def drop(index: int) -> None:
        nonlocal links
        for e in stack[index:]:
            open_[e.tag] -= 1
            links -= e.tag == "a"
        del stack[index:]

    def end(index: int) -> None:
        close()
        drop(index)

    def innermost(tags, stops) -> int:
        """The innermost open element of these tags with none of the stops inside, or 0."""
        if any(open_.get(t) for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    return k
                if stack[k].tag in stops:
                    break
        return 0

    size = len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if m is None or m.start() > at:
            text = page[at : m.start() if m else size]
            parts.append(text)
            if links:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                if k := innermost((tag,), ()):
                    end(k)
                else:
                    close()
            elif k := innermost((tag,), () if tag in CLOSED else BLOCK):
                if tag in CLOSED:
                    end(k)
                else:
                    drop(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        empty = m[3].endswith("/") and not re.search(r"=\s*[^\s\"'>]*/$", m[3])
        if tag in RAW:
            if empty and tag not in ("script", "style") or not closes(tag):
                continue
            # its content is no markup and no text of the article
            at = _RAW_END[tag].search(page, at).end()
            if tag == "textarea":
                parts.append(" ")
            continue
        if tag in CLOSED:
            if empty and tag in ("svg", "math") or not closes(tag):
                parts.append(" ")
                continue
            if tag == "button" and (k := innermost(("button",), ())):
                end(k)
        if tag in BLOCK:
            # what is no drawing ends it
            if k := innermost(("svg", "math"), ("foreignobject",)):
                end(k)
            close()
            if tag in _P_ENDS and (k := innermost(("p",), _P_STOPS)):
                end(k)
            if tag in _SAME and (k := innermost(_SAME[tag], _STOPS[tag])):
                end(k)
        above = stack[-1]
        name, marked = _named(tag, m[3])
        path = out.path(above.path, tag, name) if tag in BLOCK else above.path
        e = Element(tag, path, above.mark, above.head or tag in ("h1", "main"))
        if marked or tag in ASIDE or tag in CLOSED:
            if tag in CLOSED:
                # the text before it is not its own
                parts.append(" ")
                close()
            e.mark = Mark(tag not in CLOSED and (tag not in ASIDE or tag == "form"), above.mark, len(out.marks))
            out.marks.append(e.mark)
        links += tag == "a"
        open_[tag] = open_.get(tag, 0) + 1
        stack.append(e)
    close()
    out.unmark()
    return out


def page_votes(found: Page) -> dict[int, float]:
    """Share of the page's unlinked prose below each container path that has some."""
    return {k: s for k, s in enumerate(found.shares()) if s and found.tags[k] not in _PROSE}


def best(found: Page, votes: dict[int, float]) -> int | None:
    """The deepest path with nearly all prose, raised to an article or an element with text of its own around it."""
    near = [p for p, share in votes.items() if share >= NEARLY]
    if not near:
        return None
    path = min(near, key=lambda p: (-found.depth[p], -votes[p], found.strings[p]))
    own = {found.home[b.path] for b in found.blocks if not b.outside and b.prose}
    up = path
    while up := found.above[up]:
        if found.tags[up] in ("body", "html"):
            break
        if up in own or found.tags[up] == "article":
            path = up
    return path


def page_text(found: Page, winners: list[str] | str | None, beside: list[str] | None = None) -> str:
    """The blocks below the winning path with most of the page's prose, or below the page's own best container.

    A winning path with little of it still counts where the own best container is a path of ``beside``.
    """
    votes = page_votes(found)
    own = best(found, votes)
    wanted = set([winners] if isinstance(winners, str) else winners or [])
    known = [p for p in votes if found.strings[p] in wanted] if wanted else []
    if known:
        first = min(known, key=lambda p: (-votes[p], -found.depth[p], found.strings[p]))
        if own is None or votes[first] >= LITTLE or found.strings[own] in (beside or ()):
            return "\n\n".join(found.below(first))
    if own is not None:
        return "\n\n".join(found.below(own))
    return "\n\n".join(b.text for b in found.blocks if not b.outside)


def host(url: Column) -> Column:
    """The host of a url in lower case, empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _pages(batches, limit: int = 4 << 20):
    """(batch slice, its html with null as empty)"""
    for batch in batches:
        column = batch.column("html").fill_null("")
        for start, stop in chunks(column, limit):
            yield batch.slice(start, stop - start), column.slice(start, stop - start).to_pylist()


def host_paths(pages: DataFrame, url: str = "url", markup: str = "html") -> DataFrame:
    """``host``, ``path`` with the most votes of its pages, ``paths`` of all templates, and ``beside``.

    ``beside`` are paths on many of the host's pages that hold less than half of the prose there.
    """
    rows = pages.select(host(F.col(f"`{url}`")).alias("host"), F.col(f"`{markup}`").alias("html"))

    def run(batches):
        for batch, texts in _pages(batches):
            seen: dict[tuple[str, str], list] = {}
            for name, page in zip(batch.column("host").to_pylist(), texts):
                found = blocks(page)
                votes = page_votes(found)
                own = best(found, votes)
                for path, share in votes.items():
                    row = seen.setdefault((name, found.strings[path]), [0, 0, 0])
                    row[0] += path == own
                    row[1] += 1
                    # integers, so that the sum does not depend on its order
                    row[2] += round(share * 1e6)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in seen], pa.string()),
                    pa.array([k[1] for k in seen], pa.string()),
                    *[pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(3)],
                ],
                ["host", "path", "votes", "n", "share"],
            )

    sums = [F.sum(c).alias(c) for c in ("votes", "n", "share")]
    votes = cut_lineage(
        rows.mapInArrow(run, "host string, path string, votes long, n long, share long").groupBy("host", "path").agg(*sums)
    )
    # the first by name among those with most votes
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"), F.min(F.struct(-F.col("votes"), "path")).alias("first"))
    rows = votes.join(total, "host")
    most = F.col("path") == F.col("first.path")
    wins = (F.col("votes") > 0) & (most | (F.col("votes") >= TEMPLATE * F.col("total")))
    aside = ~most & (F.col("n") >= 2) & (F.col("n") >= COMMON * F.col("total")) & (F.col("share") < 0.5e6 * F.col("n"))
    found = rows.select("host", "path", "total", most.alias("most"), (wins & ~aside).alias("wins"), aside.alias("aside"))
    return found.where("wins or aside or most").groupBy("host").agg(
        F.min(F.when(F.col("most") & F.col("wins"), F.col("path"))).alias("path"),
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.when(F.col("wins"), F.col("path")))).alias("paths"),
        F.sort_array(F.collect_list(F.when(F.col("aside"), F.col("path")))).alias("beside"),
    )


def extract(pages: DataFrame, keep: list[str] | None = None, url: str = "url", markup: str = "html") -> DataFrame:
    """``row`` and ``text``, the main text of the page."""
    names = pages.columns if keep is None else keep
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        host(F.col(f"`{url}`")).alias("host"),
        F.col(f"`{markup}`").alias("html"),
        F.xxhash64(F.col(f"`{url}`"), F.length(F.col(f"`{markup}`"))).alias("salt"),
    )
    # A host is read in parts of so many pages, and its paths are copied for each part. Only
    # hosts of several parts have to be known beforehand. Hosts grow with the pages: their
    # paths are never planned as a broadcast.
    paths = cut_lineage(host_paths(pages, url, markup).withColumn("parts", F.ceil(F.col("total") / PART).cast("long")))
    large, _ = broadcast_if_small(paths.where("parts > 1").select("host", "parts"))
    rows = rows.join(large, "host", "left").withColumn("salt", F.pmod("salt", F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    paths = paths.select("host", "paths", "beside", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("parts", F.lit(1)) - 1)).alias("salt"))
    rows = rows.join(paths.hint("merge"), ["host", "salt"], "left").select("row", "html", "paths", "beside")

    def run(batches):
        for batch, texts in _pages(batches):
            known = zip(batch.column("paths").to_pylist(), batch.column("beside").to_pylist())
            out = [page_text(blocks(page), *of_host) for page, of_host in zip(texts, known)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
