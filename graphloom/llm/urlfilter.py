"""URL filters: all glob rules at once, by a bit-parallel Shift-And automaton.

A rule is a glob over the whole canonical URL: ``*`` is any run of characters
(empty too), ``?`` one character, anything else itself (case ignored). A rule
that begins with ``@@`` allows: a URL is blocked if a blocking rule matches and
no allowing rule does.

Each rule owns one bit per non-star character plus a start bit; the bits of all
rules lie end to end in a few 64-bit words, and one step per character moves
every rule of every URL of a batch: ``D = ((D << 1) & B[c]) | (D & S)``, with
``B`` the positions that accept ``c`` and ``S`` the positions followed by a star.
The work is URL length x words of mask, without a join of URLs with rules.

Defined results
  * null or blank URL -> null canonical URL, no rule, not blocked.
  * ties and repeated rows: every row is answered by itself and kept.
  * an empty table gives an empty table; very long URLs are matched whole.
  * columns other than ``page_id`` and ``url`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default rules: trackers, query traps, listing pages, hosts of doubtful quality.
RULES: tuple[str, ...] = (
    "*://m.*", "*://*.example.net/*/9?", "*?*page=1?*", "*&ref=*", "*?ref=*", "*/login*", "*/signup*", "*/cart*",
    "*/checkout*", "*/wp-admin/*", "*/tag/*", "*/feed", "*.xml", "*.zip", "*.pdf", "*.jpg", "*.png", "*.gif",
    "*utm_*=*", "*sessionid=*", "*phpsessid=*", "*/ads/*", "*://ads.*", "*://*.doubleclick.*", "*/print/*",
    "*casino*", "*poker*", "*://*.xxx/*", "*/search?*", "*?q=*", "*/calendar/*", "*sort=*", "*filter=*",
    "http://*.example.org/*/1??", "http://th*.example.com/fr/*", "*/de/*5?", "*://*:8080/*", "ftp://*",
    "@@*://www.*/en/*", "@@*.example.org/en/*",
)


def canonical(url: Column) -> Column:
    """Trimmed, lower-case (path and query too), without fragment, default port or doubled slashes; a bare host ends in a slash."""
    u = F.lower(F.trim(url.cast("string")))
    u = F.regexp_replace(u, "#.*$", "")
    u = F.regexp_replace(u, "^http://([^/?]*):80(/|\\?|$)", "http://$1$2")
    u = F.regexp_replace(u, "^https://([^/?]*):443(/|\\?|$)", "https://$1$2")
    u = F.regexp_replace(u, "^([a-z]+://[^/?]+)$", "$1/")
    u = F.regexp_replace(u, "^([a-z]+://[^/?]+)\\?", "$1/?")
    # slashes after the scheme's and before the query
    scheme, query = F.regexp_extract(u, "^[a-z]{1,20}://", 0), F.regexp_extract(u, "(?s)\\?.*$", 0)
    head = F.regexp_extract(F.substr(u, F.length(scheme) + 1), "^[^?]*", 0)
    u = F.concat(scheme, F.regexp_replace(head, "/+", "/"), query)
    return F.when(u == "", None).otherwise(u)


class Automaton:
    """The packed masks of a list of globs."""

    def __init__(self, globs: Sequence[str]):
        first, last, accepts, stars, bit = [], [], {}, [], 0
        for glob in globs:
            first.append(bit)
            for ch in glob.lower():
                if ch == "*":
                    stars.append(bit)
                else:
                    bit += 1
                    accepts.setdefault(ch, []).append(bit)
            last.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.first, self.last = np.array(first, np.int64), np.array(last, np.int64)
        any_char = accepts.pop("?", [])
        chars = sorted(accepts)
        #: code point -> row of ``self.accept``; row 0 is every character no rule names.
        self.row_of = {ord(c): k + 1 for k, c in enumerate(chars)}
        self.accept = np.stack([self.mask(any_char), *(self.mask(accepts[c] + any_char) for c in chars)])
        self.star = self.mask(stars)
        self.start = self.mask(self.first)

    def mask(self, bits: Sequence[int]) -> np.ndarray:
        m = np.zeros(self.words, np.uint64)
        for b in bits:
            m[b >> 6] |= np.uint64(1 << (b & 63))
        return m

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean matrix: texts x rules."""
        out = np.zeros((len(texts), len(self.last)), bool)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")  # the texts still being read are always a prefix
        flat = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros(int(max(self.row_of, default=0)) + 2, np.int64)
        for c, r in self.row_of.items():
            table[c] = r
        rows = table[np.minimum(flat, len(table) - 1)]
        sorted_len = lengths[order]
        begin = np.concatenate([[0], np.cumsum(sorted_len)[:-1]]) if len(order) else np.zeros(0, np.int64)
        state = np.tile(self.start, (len(texts), 1))
        live = np.searchsorted(-sorted_len, -np.arange(int(sorted_len[0]) if len(order) else 0), side="left")
        for t, n in enumerate(live):
            d = state[:n]
            shifted = d << np.uint64(1)
            shifted[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (shifted & self.accept[rows[begin[:n] + t]]) | (d & self.star)
        hit = (state[:, self.last >> 6] >> (self.last & 63).astype(np.uint64)) & np.uint64(1)
        out[order] = hit.astype(bool)
        return out


def filter_urls(pages: DataFrame, rules: Sequence[str] = RULES, batch: int = 4096) -> DataFrame:
    """(page_id, canonical_url, rules, blocked) of every row; ``rules`` lists the matching rules' numbers."""
    allow = np.array([r.startswith("@@") for r in rules], bool)
    auto = Automaton([r.removeprefix("@@") for r in rules])
    keys = dict(pages.select("page_id").dtypes)
    slim = pages.select(F.col("page_id"), canonical(F.col("url")).alias("canonical_url"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                known = part["canonical_url"].notna().to_numpy()
                hits = auto.matches(part["canonical_url"].fillna("").tolist()) & known[:, None]
                part["rules"] = [",".join(map(str, np.flatnonzero(h))) for h in hits]
                part["blocked"] = hits[:, ~allow].any(axis=1) & ~hits[:, allow].any(axis=1)
                yield part

    return slim.mapInPandas(run, f"page_id {keys['page_id']}, canonical_url string, rules string, blocked boolean")


def _like(glob: str) -> str:
    g = glob.removeprefix("@@").lower().replace("!", "!!").replace("%", "!%").replace("_", "!_")
    return g.replace("*", "%").replace("?", "_").replace("'", "''")


def sql(rules: Sequence[str] = RULES) -> str:
    """DuckDB: the same canonical form, and one LIKE per rule."""
    values = ", ".join(f"({n}, '{_like(r)}', {str(r.startswith('@@')).lower()})" for n, r in enumerate(rules))
    return f"""
WITH c0 AS (SELECT row_number() OVER () AS rid, page_id, regexp_replace(lower(trim(url)), '#.*$', '') AS u FROM pages),
c1 AS (SELECT rid, page_id, regexp_replace(regexp_replace(u, '^http://([^/?]*):80(/|\\?|$)', 'http://\\1\\2'),
        '^https://([^/?]*):443(/|\\?|$)', 'https://\\1\\2') AS u FROM c0),
c15 AS (SELECT rid, page_id, regexp_replace(regexp_replace(u, '^([a-z]+://[^/?]+)$', '\\1/'),
        '^([a-z]+://[^/?]+)\\?', '\\1/?') AS u FROM c1),
c17 AS (SELECT rid, page_id, u, regexp_extract(u, '^[a-z]{{1,20}}://') AS scheme FROM c15),
c2 AS (SELECT rid, page_id, nullif(scheme || regexp_replace(regexp_extract(substr(u, length(scheme) + 1), '^[^?]*'), '/+', '/', 'g')
        || regexp_extract(u, '\\?.*$'), '') AS u FROM c17),
r(n, pat, allow) AS (VALUES {values}),
h AS (SELECT c2.rid, r.n, r.allow FROM c2 JOIN r ON c2.u LIKE r.pat ESCAPE '!'),
s AS (SELECT rid, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS rules,
             bool_or(NOT allow) AND NOT bool_or(allow) AS blocked FROM h GROUP BY rid)
SELECT page_id, u AS canonical_url, coalesce(rules, '') AS rules, coalesce(blocked, false) AS blocked
FROM c2 LEFT JOIN s USING (rid)
"""
