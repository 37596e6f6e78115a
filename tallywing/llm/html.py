"""Main text of web pages by a consensus of each host's pages.

A page's containers (body, article, div, …) are scored: text outside links, less link text
and text of menus, notices, forms and the like inside the container. Each container votes for
its path of tags and classes, in which digits are generalised, so that pages made from one
template agree. Votes are summed per host in Spark; each page is then extracted again from
the containers at the best path of its host that it has, or from its own best container if
it has none of them.

Elements whose class, id or role has a word such as sidebar are left out, unless they are main
or article, hold all top headings or most of the page's text outside links: then they wrap the
article. Words for boxes with text of their own, such as comments or cookie, need nine tenths of
the text and no heading counts. A word after has, with or no marks nothing. If nothing else has
text, no such mark counts.

Null html and pages without text give an empty string. A null URL, or one without a host,
belongs to one nameless host. Repeated rows are pages of their own that vote each. Unclosed
and crossed tags are repaired as far as paragraphs, list items and table cells go; a tag that
the page's end cuts off is dropped. Work and memory are linear in a page however deep its tags
nest; a path beyond ``PATH_CHARS`` is stood for by its digest, the same on pages of one template. An empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallywing.llm.urls import host_of
from tallywing.session import materialize

PATHS_KEPT, PATH_CHARS = 5, 1000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.I | re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td
    tfoot th thead tr ul""".split())
_CONTAINER = frozenset("article body center details div figure main section table td".split())
#: Elements whose text never belongs to an article.
_ASIDE = frozenset("""aside button canvas datalist dialog footer form head header input label math menu nav noscript object
    option select svg template audio video""".split())
#: Words of class names, ids and roles that mark such elements.
_ASIDE_WORD = re.compile(r"""^(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|banners
    |nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|pagination|pager|header|masthead|footer|sidebar|sidebars|aside
    |widget|widgets|comment|comments|disqus|respond|reply|replies|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal
    |newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|teaser|teasers
    |toolbar|search|contentinfo|complementary|form|forms)$""", re.X)
#: Those of them that name boxes with much text of their own.
_BOX_WORD = re.compile(r"""^(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|comment|comments|disqus
    |respond|reply|replies|cookie|cookies|consent|gdpr|popup|modal|newsletter|subscribe|subscription|signup|login|related|recommended
    |recommendations|teaser|teasers)$""", re.X)
_DENIES = frozenset(["has", "with", "no"])
WRAPPER_SHARE, BOX_SHARE = 0.5, 0.9
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: An element ends when one of these begins inside it.
_ENDS = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
         "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
         "option": frozenset(["option"])}
#: The elements that one ends, by its tag.
_ENDED_BY = {tag: [name for name, tags in _ENDS.items() if tag in tags] for tag in _BLOCK}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",)}

#: The elements beyond which a new one does not look for one to end.
_BOUNDS = {tag: {*_SCOPE.get(tag, ()), *(() if tag in ("td", "th", "tr") else _CONTAINER)} for tag in _BLOCK}


def _path(parent: str, step: str) -> str:
    """The path of a container below ``parent``; one beyond ``PATH_CHARS`` is stood for by a digest."""
    path = f"{parent.rstrip('/')}/{step}"
    return path if len(path) <= PATH_CHARS else "/#" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


@dataclass
class Page:
    """Blocks of text in order, and containers with the values their scores are made of."""

    paths: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    worth: list[float] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def scores(self) -> list[float]:
        total = list(self.worth)
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += total[k]
        return total

    def best(self) -> int:
        scores = self.scores()
        return max(range(len(scores)), key=lambda k: (scores[k], self.depth[k], -k))

    def text(self, roots: set[int]) -> str:
        inside = [False] * len(self.paths)
        for k in range(len(inside)):
            inside[k] = k in roots or (k > 0 and inside[self.parents[k]])
        return "\n".join(t for k, t in self.blocks if inside[k])


def _names(rest: str) -> tuple[str, bool, str]:
    """The generalised class of a tag, whether it is hidden, and what its words mark it as: box, aside or nothing."""
    kind, hidden, mark = "", False, ""
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
            continue
        for token in value.split():
            before = ""
            for word in map(str.lower, _WORD.findall(token)):
                if before not in _DENIES and _ASIDE_WORD.match(word):
                    mark = "box" if mark == "box" or _BOX_WORD.match(word) else "aside"
                before = word
        if name == "class":
            kind = ".".join(sorted(set(re.sub(r"\d+", "#", value).split())))
    return kind, hidden, mark


def parse(source: str) -> Page:
    """The page; a second and third look if marked elements turn out to wrap the article."""
    page, marks = _parse(source, frozenset())
    if marks:
        text, heads = marks[0].text, marks[0].heads
        spared = frozenset(k for k, m in enumerate(marks) if k and (
            m.text > BOX_SHARE * text if m.kind == "box" else m.text > WRAPPER_SHARE * text or 0 < heads == m.heads))
        if spared:
            page, _ = _parse(source, spared)
        if not page.blocks:
            page, _ = _parse(source, frozenset(range(len(marks))))
    return page


@dataclass
class Mark:
    """A marked element, or the page: text outside links and top headings inside it."""

    kind: str
    parent: int
    text: int = 0
    heads: int = 0


def _parse(source: str, spared: frozenset[int]) -> tuple[Page, list[Mark]]:
    """The page and its marked elements after the page itself, none if there are none; ``spared`` ones count as unmarked."""
    marks = [Mark("", 0)]
    page = Page(["/"], [0], [0], [0.0])
    # Open elements: tag, container, whether aside, whether in a link, marked element (-1: aside whatever the marks).
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
    # Where in the stack the elements of each name are, and where the blocks.
    open_at: dict[str, list[int]] = defaultdict(list)
    blocks_at: list[int] = []
    pending: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                _, container, aside, _, mark = stack[-1]
                if mark >= 0:
                    marks[mark].text += len(text) - min(linked, len(text))
                page.worth[container] += -len(text) if aside else len(text) - 2 * min(linked, len(text))
                if not aside:
                    page.blocks.append((container, text))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pending.append(text)
            if stack[-1][3]:
                linked += len(text)

    def close_to(depth: int) -> None:
        if any(s[0] in _BLOCK or s[2] != stack[depth - 1][2] or s[4] != stack[depth - 1][4] for s in stack[depth:]):
            flush()
        for name, *_ in reversed(stack[depth:]):
            open_at[name].pop()
            if name in _BLOCK:
                blocks_at.pop()
        del stack[depth:]

    def last(names: Iterable[str]) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=0)

    at = 0
    for token in _TOKEN.finditer(source):
        say(source[at:token.start()])
        at = token.end()
        tag = token["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if token["close"]:
            depth = last([tag])
            # The end of an inline element does not reach out of a block.
            if depth and (tag in _BLOCK or not blocks_at or blocks_at[-1] < depth):
                close_to(depth)
            continue
        if tag in _BLOCK:
            flush()
            depth = last(_ENDED_BY[tag])
            if depth and depth >= last(_BOUNDS[tag]):
                close_to(depth)
        elif tag in ("br", "wbr"):
            if tag == "br":
                pending.append(" ")
            continue
        if tag in _VOID:
            continue
        _, container, aside, link, inside = stack[-1]
        kind, hidden, mark = _names(token["rest"]) if token["rest"] else ("", False, "")
        away, within = aside, inside
        if tag in ("body", "html"):
            pass
        elif tag in _ASIDE or hidden:
            away, within = True, -1
        elif mark and inside >= 0 and tag not in ("main", "article"):
            marks.append(Mark(mark, inside))
            within = len(marks) - 1
            away = aside or within not in spared
        if away != aside or within != inside:
            flush()
        if tag == "h1" and within >= 0:
            marks[within].heads += 1
        if tag in _CONTAINER and not away:
            page.paths.append(_path(page.paths[container], tag + (f".{kind}" if kind else "")))
            page.parents.append(container)
            page.depth.append(page.depth[container] + 1)
            page.worth.append(0.0)
            container = len(page.paths) - 1
        if not token["rest"].endswith("/") or tag not in ("svg", "path"):
            open_at[tag].append(len(stack))
            if tag in _BLOCK:
                blocks_at.append(len(stack))
            stack.append((tag, container, away, link or tag == "a", within))
    say(source[at:])
    flush()
    for m in reversed(marks[1:]):
        marks[m.parent].text += m.text
        marks[m.parent].heads += m.heads
    return page, marks if len(marks) > 1 else []


def votes_of(page: Page) -> dict[str, float]:
    """A page's votes: 1 for the best container's path, less for others by their score."""
    scores, best = page.scores(), page.best()
    top = scores[best]
    votes: dict[str, float] = {}
    if top > 0:
        for path, score in zip(page.paths, scores):
            if score > 0:
                votes[path] = max(votes.get(path, 0.0), 0.9 * (score / top) ** 2)
        votes[page.paths[best]] = 1.0
    return votes


def extract(page: Page, winners: list[str]) -> tuple[str, str]:
    """Text and the path it comes from: the first of the host's paths that holds text here."""
    for path in winners:
        text = page.text({k for k, p in enumerate(page.paths) if p == path})
        if text:
            return text, path
    best = page.best()
    return page.text({best}), page.paths[best]


def host_paths(pages: DataFrame, kept: int = PATHS_KEPT) -> DataFrame:
    """host and its ``kept`` most voted paths, best first. Votes are summed per batch, then by Spark."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = defaultdict(float)
            for host, source in zip(batch["host"], batch["html"]):
                for path, vote in votes_of(parse(source or "")).items():
                    sums[host, path] += vote
            yield pd.DataFrame([(h, p, round(v * 1000)) for (h, p), v in sums.items()], columns=["host", "path", "votes"])

    votes = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string")) \
        .mapInPandas(count, "host string, path string, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.length("path")), "path")
    return votes.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= kept) \
        .groupBy("host").agg(F.array_sort(F.collect_list(F.struct("n", "path"))).alias("paths")) \
        .select("host", F.col("paths.path").alias("paths"))


def main_text(pages: DataFrame, kept: int = PATHS_KEPT) -> DataFrame:
    """page_id, url, text, n_chars (code points) and the path used, per row of ``pages``.

    The host's paths are stored when this is called."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(parse(source or ""), [] if paths is None else list(paths))
                     for source, paths in zip(batch["html"], batch["paths"])]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"],
                                "text": [t for t, _ in found], "n_chars": [len(t) for t, _ in found],
                                "path": [p for _, p in found]})

    named = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")) \
        .withColumn("host", host_of(F.col("url")))
    # Stored, the paths have a known size: they are sent to the pages while that is small; beyond,
    # a host with very many pages is split by adaptive execution.
    paths = materialize(host_paths(pages, kept), "host-paths")
    return named.join(paths, "host", "left").mapInPandas(
        rows, "page_id bigint, url string, text string, n_chars bigint, path string")
