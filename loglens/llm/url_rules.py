"""URL filters: rules indexed by their rarest literal token.

A URL's tokens fetch the rules indexed under them, and only those rules run their regular expressions. Which of a rule's
tokens is the rarest is counted over all URLs. Two kinds of rules are compiled alike: site rules (host and path prefix,
the longest match decides) and patterns in the common filter-list notation (``||`` a host or subdomain, ``|`` an end, ``^``
a separator, ``*`` anything, ``@@`` an exception). Site rules come first; then an exception allows, then any pattern blocks.

A worker holds the index of at most ``MAX_RULES`` rules. A longer list is cut into several; the best matches of one are written
before the next is sent, and the better one of each row stays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.shared import stored

_TOKEN = re.compile(r"[0-9a-z]+")
_HOST_PATH = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
MAX_RULES = 200_000  # rules of an index; longer lists are judged index by index
KNOWN = 1 << 14  # compiled expressions that a worker keeps at hand

#: Site rules of the standard set: verdict, host, path prefix.
SITE_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Patterns of the standard set.
PATTERNS = [
    "||spam-farm.", "||cheap-pills.", "/casino/", "/adult/", "/xxx^", ".onion^", "/wp-login.php", "/cgi-bin/*.exe|",
    "^phishing^", "@@||example.org/de/",
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host, lower-cased in A-Z, and path; both empty for null or without ``://``."""
    m = _HOST_PATH.search(url) if url else None
    return (m[1].translate(_ASCII_LOWER), m[2]) if m else ("", "")


@dataclass(frozen=True)
class Rule:
    """A compiled rule. ``tokens`` stand whole in every URL that it fits."""

    name: str
    verdict: str
    rank: int  # site rules: length of host and path; patterns: 0, exceptions: 1
    site: bool
    expression: str
    tokens: tuple[str, ...]

    @property
    def order(self) -> tuple[int, str, str]:
        return self.rank, self.name, self.verdict


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and its subdomains whose path starts with ``path``; its expression runs over host + path."""
    host = host.translate(_ASCII_LOWER)
    last_open = path[-1:].isalnum()  # then the last token may go on in the URL
    tokens = _TOKEN.findall(host) + _TOKEN.findall(path.lower())[: -1 if last_open else None]
    return Rule(
        host + path, verdict, len(host + path), True,
        rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(tokens)),
    )


def pattern_rule(pattern: str) -> Rule:
    """A pattern; its expression runs over the lower-cased URL."""
    body, exception = (pattern[2:], True) if pattern.startswith("@@") else (pattern, False)
    body = body.lower()
    start, end = "", ""
    if body.startswith("||"):
        body, start = body[2:], r"\A[^:/?#]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], r"\A"
    if body.endswith("|"):
        body, end = body[:-1], r"\Z"
    parts = {"*": ".*", "^": r"(?:[^0-9a-z_.%-]|\Z)"}
    expression = start + "".join(parts.get(c, re.escape(c)) for c in body) + end
    tokens = []
    for m in _TOKEN.finditer(body):
        # Whole only where the pattern itself ends it on both sides.
        left = body[m.start() - 1] != "*" if m.start() else bool(start)
        right = body[m.end()] != "*" if m.end() < len(body) else bool(end)
        if left and right:
            tokens.append(m[0])
    return Rule(pattern, "allow" if exception else "block", int(exception), False, expression, tuple(dict.fromkeys(tokens)))


def compiled(site_rules: list[tuple[str, str, str]], patterns: list[str]) -> list[Rule]:
    return [site_rule(*r) for r in site_rules] + [pattern_rule(p) for p in patterns]


def url_tokens(url: Column) -> Column:
    """The distinct lower-cased runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit("[0-9a-z]+"), F.lit(0)))


def rarest_tokens(urls: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, list[Rule]]:
    """The index: each rule under that of its tokens that the fewest URLs have; under "" if it has none.

    Counts cover all URLs. Each URL's tokens are looked up among those of the rules, so a URL's cost is that of its tokens;
    only tokens of rules are counted, so there are no more counts than those."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        known = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string"))  # of one index's rules
        tokens = urls.select(F.explode(url_tokens(F.col(url))).alias("token")).join(known, "token", "left_semi")
        counts = {r.token: r.n for r in tokens.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        index.setdefault(rarest, []).append(rule)
    return index


@lru_cache(KNOWN)
def _expression(expression: str) -> re.Pattern:
    return re.compile(expression, re.S)


def best_of(url: str | None, index: dict[str, list[Rule]]) -> tuple[Rule | None, Rule | None]:
    """The site rule and the pattern that decide, of an index."""
    host, path = split_url(url)
    text = (url or "").lower()
    site: Rule | None = None
    pattern: Rule | None = None
    for token in ["", *dict.fromkeys(_TOKEN.findall(text))]:
        for rule in index.get(token, ()):
            best = site if rule.site else pattern
            if (best is None or rule.order > best.order) and _expression(rule.expression).search(host + path if rule.site else text):
                if rule.site:
                    site = rule
                else:
                    pattern = rule
    return site, pattern


_MATCH = "struct<rank:int,name:string,verdict:string>"


def _matches(shared: Broadcast, url: Column) -> Column:
    """The best site rule and pattern of an index, as structs that compare like them."""

    @F.arrow_udf(f"struct<site:{_MATCH},pattern:{_MATCH}>")
    def matches(urls: pa.Array) -> pa.Array:
        kind = pa.struct([("rank", pa.int32()), ("name", pa.string()), ("verdict", pa.string())])
        found = [best_of(u, shared.value) for u in urls.to_pylist()]
        sides = [[r and dict(zip(kind.names, r.order, strict=True)) for r in side] for side in zip(*found, strict=True)] or [[], []]
        return pa.StructArray.from_arrays([pa.array(side, kind) for side in sides], ["site", "pattern"])

    return matches.asNondeterministic()(url)


def judge(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    site_rules: list[tuple[str, str, str]] = SITE_RULES,
    patterns: list[str] = PATTERNS,
    max_rules: int = MAX_RULES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) per row.

    ``rule`` is the longest site rule that fits, of equally long ones the last by code point; ``pattern`` the pattern that fits,
    exceptions before blocks and then the last by code point. The verdict is the site rule's, else the pattern's, else allow. A
    null URL and one without ``://`` have an empty host and path. Repeated rows and null ids pass through; other columns are not
    read. At most ``max_rules`` rules are sent at once.
    """
    rules = compiled(list(site_rules), list(patterns))
    found = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"))
    found = found.select("*", *[F.lit(None).cast(_MATCH).alias(c) for c in ("site", "pattern")])
    context = pages.sparkSession.sparkContext
    for low in range(0, len(rules), max_rules):
        shared = context.broadcast(rarest_tokens(pages, rules[low : low + max_rules], url))
        found = found.withColumn("found", _matches(shared, F.col("url"))).select(
            "page", "url", *[F.greatest(c, f"found.{c}").alias(c) for c in ("site", "pattern")]
        )
        if low + max_rules < len(rules):
            found = stored(found, "url-rules")
            shared.destroy()

    # After the first "://": the host to the next of / ? # or the end, then the path to ? or #.
    parts = [F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", i) for i in (1, 2)]
    host = F.translate(parts[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    verdict = F.coalesce("site.verdict", "pattern.verdict", F.lit("allow"))
    return found.select(
        F.col("page").alias(page_id), host.alias("host"), parts[1].alias("path"), F.col("site.name").alias("rule"),
        verdict.alias("verdict"), F.col("pattern.name").alias("pattern"),
    )
