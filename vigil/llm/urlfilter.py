"""URL filter: rules by host and path, and a weighted vocabulary found by an Aho-Corasick automaton.

The automaton finds all terms in one pass over the URL. A hit counts where no letter or digit touches it on either
side. One strict term rejects; soft terms are counted once each, and several different ones reject. Where a rule fits
(its host or a subdomain, its path a prefix) the longest rule decides instead.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import arrow_map

#: Fixed values of the op5 contract: (verdict, host, path), in the order it states them.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Terms that reject by themselves.
STRICT = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "porno", "sex", "spam", "viagra", "warez",
          "xxx")
#: Terms that reject in company: so many different ones.
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "click", "crack", "dating", "farm", "free", "gambling", "jackpot", "keygen",
        "loan", "pharmacy", "pills", "poker", "promo", "slots", "torrent", "track", "tracker", "win", "winner")
SOFT_HITS = 2


def parts(url: F.Column | str) -> tuple:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``,
    ``#`` or the end. Both empty for null or without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host, path, rules):
    """(rule, verdict) of the longest rule that fits, as a struct; null if none does. Equally long rules: the first."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def automaton(strict, soft):
    import ahocorasick
    a = ahocorasick.Automaton()
    for t in soft:
        a.add_word(t.lower(), (t.lower(), False))
    for t in strict:
        a.add_word(t.lower(), (t.lower(), True))
    a.make_automaton()
    return a


def hits(a, url: str | None) -> tuple[int, int]:
    """Different strict and soft terms in a URL, with nothing alphanumeric beside them."""
    text = (url or "").lower()
    strict, soft = set(), set()
    for end, (term, is_strict) in a.iter(text):
        start = end - len(term) + 1
        if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            (strict if is_strict else soft).add(term)
    return len(strict), len(soft)


def filter_urls(df: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT,
                soft_hits: int = SOFT_HITS) -> DataFrame:
    """Add host, path, rule, strict_hits, soft_hits and verdict to every row; columns of these names are replaced.

    Null and empty URLs have an empty host and path, no rule and no hits, and are allowed. Rows are independent;
    nothing is shuffled. The rules are a short list known before the job; they become one expression.
    """
    def run(b: pa.RecordBatch) -> dict:
        a = automaton(strict, soft)
        got = [hits(a, u) for u in b.column(url_col).to_pylist()]
        return {"strict_hits": [s for s, _ in got], "soft_hits": [s for _, s in got]}

    found = arrow_map(df, run, [T.StructField("strict_hits", T.IntegerType(), False),
                                T.StructField("soft_hits", T.IntegerType(), False)])
    host, path = parts(url_col)
    rule = fitting_rule(host, path, rules)
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_hits), "block").otherwise("allow")
    new = {"host": host, "path": path, "rule": rule["rule"], "verdict": F.coalesce(rule["verdict"], own)}
    return found.select(*[c for c in found.columns if c.lower() not in new], *[c.alias(n) for n, c in new.items()])


def op5_urls(pages: DataFrame) -> DataFrame:
    got = filter_urls(pages.select("page_id", "url"))
    return got.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def _edge(term: str) -> str:
    return f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')::INT"


_URL = "coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '')"
_FITS = "\n".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'"
    for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])))

ORACLE = f"""
WITH r AS (SELECT page_id, lower(coalesce(url, '')) AS u, {_URL} AS rest FROM pages),
p AS (SELECT page_id, u, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
h AS (SELECT *, CASE {_FITS} END AS fit, {' + '.join(map(_edge, STRICT))} AS strict_hits,
             {' + '.join(map(_edge, SOFT))} AS soft_hits FROM p)
SELECT page_id, host, path, CASE WHEN fit IS NOT NULL THEN split_part(fit, '|', 1) END AS rule, strict_hits, soft_hits,
       CASE WHEN fit IS NOT NULL THEN split_part(fit, '|', 2)
            WHEN strict_hits > 0 OR soft_hits >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict
FROM h
"""
