"""URL filters: a trie over reversed host labels and path segments.

Allow and block entries are `(host, path)` prefixes. A rule fits its host and all its
subdomains where the URL's path starts with the rule's path; of all fitting rules the longest
wins (host and path together, then the longer host; of an allow and a block entry for the same host
and path, block). The trie is as large as the rule list, which `compile_rules` bounds, and is
broadcast. A look-up takes as many steps as the URL has labels, segments and characters, however
many rules there are.

Defined results: a null URL, or one without `://`, has an empty host and path; a URL that no
rule fits gets `default`; repeated rows are judged one by one; an empty table gives an empty
table; other columns of the input are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_rows, table

#: Rules that a broadcast trie may hold; longer lists are refused, not cut.
MAX_RULES = 1_000_000

BASE_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@dataclass
class _Node:
    """Children by label or segment; ends: the rules that close here, by the start of the next segment: (length, rule, verdict); longest: of these starts."""

    children: dict = field(default_factory=dict)
    paths: _Node | None = None
    ends: dict = field(default_factory=dict)
    longest: int = 0


class UrlTrie:
    def __init__(self) -> None:
        self.root = _Node()

    def add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.children.setdefault(label, _Node())
        node.paths = node.paths or _Node()
        node = node.paths
        *whole, last = path.split("/")
        for segment in whole:
            node = node.children.setdefault(segment, _Node())
        if verdict == "block" or last not in node.ends:
            node.ends[last] = (len(host) + len(path), len(host)), host + path, verdict
            node.longest = max(node.longest, len(last))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning (rule, verdict), or None."""
        segments, best = path.split("/"), None
        labels = host.split(".")
        node, at = self.root, len(labels)
        while node is not None:
            below, k = node.paths, 0
            while below is not None:
                if below.ends:
                    # The longest start of the segment that closes a rule.
                    starts = (segments[k][:n] for n in range(min(len(segments[k]), below.longest), -1, -1))
                    found = next((below.ends[x] for x in starts if x in below.ends), None)
                    if found and (best is None or found[0] > best[0]):
                        best = found
                # A segment is whole only if a slash follows it.
                below = below.children.get(segments[k]) if k + 1 < len(segments) else None
                k += 1
            at -= 1
            node = node.children.get(labels[at]) if at >= 0 else None
        return best and (best[1], best[2])


def compile_rules(rules: list[tuple[str, str, str]]) -> UrlTrie:
    """The trie of (verdict, host, path) rules."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a broadcast trie may hold {MAX_RULES}")
    trie = UrlTrie()
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict: {verdict}")
        trie.add(verdict, host.translate(_LOWER), path)
    return trie


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule (null if none fits) and verdict. No shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(compile_rules(rules))

    def make():
        trie = shared.value

        def work(page, address):
            host, path = split_url(address)
            rule, verdict = trie.find(host, path) or (None, default)
            return page, host, path, rule, verdict

        return work

    kind = dict(pages.dtypes)[key]
    return map_rows(pages, [F.col(key), F.col(url)], f"{key} {kind}, host string, path string, rule string, verdict string", make, weigh=1)


def op10_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), BASE_RULES)


OP10_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
