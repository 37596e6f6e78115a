"""URL rules that also reach the aliases of a page.

A rule names a host and a path prefix; it fits its host and all subdomains, the longest
fitting rule decides. Pages are aliases of what they redirect to (meta refresh) or call their
canonical address. Connected components over those links carry a block to every alias that
no rule fits; a URL with an allow rule of its own stays allowed whatever its aliases are.

A link's address is decoded and resolved as a browser does: against the page's ``<base>`` if it
has one, with ``.`` and ``..`` steps taken. As nodes, URLs are compared without them, with an
empty path as ``/``; rules see a page's URL as it is written.

Null URLs, and those without ``://``, have an empty host and path, no rule and no alias.
Null html has no links. Repeated rows each get their verdict. Rules are matched once per
distinct host and path. Empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallywing.llm.components import connected_components
from tallywing.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^(.*?://)([^/?#]*)([^?#]*)([^#]*)"
_TAGS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<(?:link|meta|base)\s[^>]*+(?:>|\z)"
#: A name begins where a space, quote or slash ends, so that a long run is read once.
_ATTRIBUTE = re.compile(r"""(?<=[\s"'/])([^\s"'>/=]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)""")
#: References without their semicolon are left: in attributes they are mostly parameters.
_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_MOVED = re.compile(r"""[\d.\s]*+[;,]\s*(?:url\s*=\s*)?["']?([^"']*)""", re.I)
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 3), F.lit(""))


def _steps_taken(path: Column) -> Column:
    """``path`` without ``.`` and ``..`` steps; ``/`` if it is empty."""
    steps = F.split(path, "/")
    # The first step is the empty one before the slash; nothing leads above it.
    taken = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done)
                        .when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
                        .otherwise(F.concat(done, F.array(x))))
    ending = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    return F.when(path == "", "/").when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.array_join(taken, "/"), ending)).otherwise(path)


def node_of(url: Column) -> Column:
    """A URL as a graph node: scheme and host in lower case, plain path, no fragment; null without ``://``."""
    scheme = F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER)
    return F.when(url.rlike(_SPLIT), F.concat(scheme, host_of(url), _steps_taken(path_of(url)), F.regexp_extract(url, _SPLIT, 4)))


def _attributes(tag: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, the first of equal ones, with references decoded."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(tag):
        plain = value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] else value
        found.setdefault(name.lower(), _REFERENCE.sub(lambda m: unescape(m[0]), plain).strip())
    return found


def resolved(target: str, url: str) -> str | None:
    """The address ``target`` in a page at ``url``; none if it is empty or no address."""
    scheme, mark, rest = url.partition("://")
    if not target or not mark:
        return None
    if _ABSOLUTE.match(target):
        return target
    try:  # any scheme with a host is resolved like a web address
        return scheme + urljoin(f"http://{rest}", target)[len("http"):]
    except ValueError:  # brackets in a host that hold no address
        return None


def _links_of(url: str, tags: Iterable[str]) -> Iterator[str]:
    """Targets of a page's canonical links and redirects."""
    base, targets = None, []
    for tag in tags:
        values = _attributes(tag)
        kind = tag[1:5].lower()
        if kind == "base":
            base = base or values.get("href")
        elif kind == "link" and "canonical" in values.get("rel", "").lower().split():
            targets.append(values.get("href", ""))
        elif kind == "meta" and values.get("http-equiv", "").lower() == "refresh":
            moved = _MOVED.match(values.get("content", ""))
            targets.append(moved[1].strip() if moved else "")
    page = (resolved(base, url) if base else None) or url
    return (t for t in (resolved(target, page) for target in targets) if t)


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [(url, target) for url, tags in zip(batch["url"], batch["tags"]) for target in _links_of(url, tags)]
        yield pd.DataFrame(found, columns=["source", "target"], dtype=object)


def alias_links(pages: DataFrame) -> DataFrame:
    """source and target node of every canonical link and redirect in ``pages`` (url, html).

    Only the tags of pages that have some go to Python."""
    tags = F.regexp_extract_all(F.col("html").cast("string"), F.lit(_TAGS), F.lit(0))
    known = F.filter(tags, lambda t: t.rlike(r"(?i)^<(?:link|meta|base)\s") & t.endswith(">"))
    wanted = pages.select(F.col("url").cast("string").alias("url"), known.alias("tags")) \
        .filter(F.col("url").isNotNull() & F.exists("tags", lambda t: t.rlike("(?i)canonical|refresh|&")))
    return wanted.mapInPandas(_links, "source string, target string") \
        .select(node_of(F.col("source")).alias("source"), node_of(F.col("target")).alias("target")) \
        .filter("source is not null and target is not null and source <> target").distinct()


def rule_of(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and its verdict for the distinct ``places`` (host, path) that a rule fits.

    Only as many trailing labels of a host are tried as the longest rule has."""
    known = rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_prefix"), "rule", "verdict")
    labels = known.agg(F.max(F.size(F.split("_suffix", r"\.")))).first()[0] or 0
    parts = F.split("host", r"\.")
    number = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), number), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    tried = places.distinct().filter(F.lit(labels) > 0).withColumn("_suffix", F.explode(suffixes))
    fits = tried.join(known, "_suffix").filter(F.expr("startswith(path, _prefix)"))
    # The longest rule; of equal rules named twice an allow.
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("verdict") == "allow"))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", F.col("b.verdict").alias("ruled"))


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and why (rule, alias or default) for every page.

    ``rules``: host, path, rule, verdict; ``links``: source and target nodes."""
    url = F.col("url").cast("string")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    stored = materialize(links.select("source", "target"), "links")
    places = seen.select("host", "path")
    ruled_pages = seen.join(rule_of(places, rules), ["host", "path"], "left")
    if stored.isEmpty():
        judged = ruled_pages.withColumn("alias", F.lit(False))
    else:
        parts = connected_components(stored, "source", "target")
        members = parts.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node")))
        member_rules = members.join(rule_of(members.select("host", "path"), rules), ["host", "path"])
        blocked = member_rules.filter("ruled = 'block'").select("component").distinct()
        aliases = parts.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("alias"))
        judged = ruled_pages.join(aliases, "node", "left").withColumn("alias", F.coalesce("alias", F.lit(False)))
    alias = F.col("alias")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(alias, "block").otherwise(default)).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(alias, "alias").otherwise("default").alias("why"))
