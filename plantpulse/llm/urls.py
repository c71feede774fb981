"""URL filters: longest-prefix host rules, else a weighted vocabulary searched by one Aho-Corasick automaton.

Defined cases: a null url, or one without `://`, has an empty host and path, meets no rule, and the vocabulary is
searched in what there is (nothing for null), so a null url is allowed. Repeated rows are judged alike, each on
its own. Input columns stay; a column that has the name of a result is replaced by it. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class Term:
    """A strict term rejects alone; soft ones add their weight once each, however often they occur."""
    text: str
    strict: bool = False
    weight: int = 1


HOST_RULES = (
    HostRule("allow", "org", "/"), HostRule("block", "example.org", "/es/"), HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"), HostRule("block", "com", "/de/"))
TERMS = tuple(Term(t, True) for t in (
    "spam-farm", "link-farm", "porn", "xxx", "malware", "phishing", "warez", "viagra", "casino", "escort")) + tuple(
    Term(t, weight=w) for t, w in (
        ("adult", 2), ("betting", 2), ("bonus", 1), ("cheap", 1), ("clickbait", 2), ("coupon", 1), ("crack", 2),
        ("dating", 2), ("download", 1), ("free", 1), ("keygen", 2), ("loan", 1), ("lottery", 2), ("pills", 2),
        ("poker", 2), ("promo", 1), ("replica", 1), ("seo", 1), ("spam", 2), ("torrent", 2), ("win", 1)))
SOFT_LIMIT, SOFT_DISTINCT = 3, 2
# The vocabulary travels with the tasks; a larger one is refused rather than shipped.
MOST_TERMS = 1_000_000
_HEAD = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _HEAD, 1), ascii_uppercase, ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _HEAD, 2)


def rule_of(host_column: str, path_column: str, rules=HOST_RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits."""
    h, p = F.col(host_column), F.col(path_column)
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host)):
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def vocabulary_hits(url: Column, terms=TERMS) -> Column:
    """struct(strict, soft, weight): distinct strict and soft terms that stand between non-alphanumerics."""
    if len(terms) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms")
    terms = tuple(terms)

    @F.pandas_udf("strict int, soft int, weight int")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            automaton.add_word(t.text, i)
        automaton.make_automaton()
        alnum = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        lower = str.maketrans(ascii_uppercase, ascii_lowercase)
        for batch in urls:
            rows = []
            for url in batch:
                found = set()
                if url:
                    low = url.translate(lower)
                    for end, i in automaton.iter(low):
                        start = end - len(terms[i].text)
                        if (start < 0 or low[start] not in alnum) and (end + 1 == len(low) or low[end + 1] not in alnum):
                            found.add(i)
                soft = [terms[i].weight for i in found if not terms[i].strict]
                rows.append((len(found) - len(soft), len(soft), sum(soft)))
            yield pd.DataFrame(rows, columns=["strict", "soft", "weight"], dtype="int32")

    return hits(url)


def judge(df: DataFrame, url: str = "url", rules=HOST_RULES, terms=TERMS,
          soft_limit: int = SOFT_LIMIT, soft_distinct: int = SOFT_DISTINCT) -> DataFrame:
    """The input with host, path, rule, strict_hits, soft_hits, soft_weight and verdict.

    Without a rule a url is blocked on one strict term, or on `soft_distinct` different soft terms whose weights
    reach `soft_limit`.
    """
    out = df.withColumns({"__url": F.col(url), "__host": host(F.col(url)), "__path": path(F.col(url))})
    out = out.withColumns({"__rule": rule_of("__host", "__path", rules), "__hits": vocabulary_hits(F.col("__url"), terms)})
    bad = (F.col("__hits.strict") > 0) | (
        (F.col("__hits.soft") >= soft_distinct) & (F.col("__hits.weight") >= soft_limit))
    return out.withColumns({
        "host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule.rule"),
        "strict_hits": F.col("__hits.strict"), "soft_hits": F.col("__hits.soft"), "soft_weight": F.col("__hits.weight"),
        "verdict": F.coalesce(F.col("__rule.verdict"), F.when(bad, "block").otherwise("allow"))}).drop(
        "__url", "__host", "__path", "__rule", "__hits")


def query(spark, folder: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight")


def _oracle() -> str:
    rules = ", ".join(f"('{r.host}{r.path}', '{r.host}', '{r.path}', '{r.verdict}')" for r in HOST_RULES)
    terms = ", ".join(f"('{t.text}', {str(t.strict).upper()}, {t.weight})" for t in TERMS)
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS low,
    translate(regexp_extract(coalesce(url, ''), '{_HEAD}', 1), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
    regexp_extract(coalesce(url, ''), '{_HEAD}', 2) AS path FROM pages),
r(rule, rhost, rpath, verdict) AS (VALUES {rules}),
t(term, strict, weight) AS (VALUES {terms}),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN r
        ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
hit AS (SELECT page_id, count(*) FILTER (strict) AS strict, count(*) FILTER (NOT strict) AS soft,
        coalesce(sum(weight) FILTER (NOT strict), 0) AS weight FROM u JOIN t
        ON regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN coalesce(strict, 0) > 0
    OR (coalesce(soft, 0) >= {SOFT_DISTINCT} AND coalesce(weight, 0) >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(strict, 0)::INT AS strict_hits, coalesce(soft, 0)::INT AS soft_hits, coalesce(weight, 0)::INT AS soft_weight
FROM u LEFT JOIN fit ON u.page_id = fit.page_id LEFT JOIN hit ON u.page_id = hit.page_id
"""


ORACLE = _oracle()
