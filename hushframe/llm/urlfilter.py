"""URL filter: a weighted vocabulary counted by Aho-Corasick, below a table of allow and block rules.

One automaton holds all terms; it reads each lower-cased url once. A hit counts if no letter or digit touches it on either
side. A term has a weight; the weights of the different terms hit are added, and a url whose sum reaches the limit is
rejected. A strict term weighs as much as the limit, so one is enough; a soft term weighs one, so several different ones
are needed. A rule (verdict, host, path) fits its host and all its subdomains where the url's path starts with the rule's;
the longest fitting rule overrides the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sum of weights that rejects a url.
LIMIT = 2
#: Terms by subject and weight (fixed values of this filter); another table may be given.
TERMS = (
    ("adult", 2, "porn porno pornos xxx adult escort escorts camgirls camgirl nudes nude hentai milf erotik erotica sexcam sexshop striptease"),
    ("gambling", 2, "casino casinos kasino gambling bets slots roulette blackjack sportsbook bookmaker gluecksspiel apuestas"),
    ("drugs", 2, "viagra cialis levitra pills kamagra steroids xanax tramadol"),
    ("harm", 2, "malware phishing warez keygen crack cracked torrent torrents botnet ransomware spam spammer linkfarm"),
    ("adult", 1, "sex sexy hot babes dating singles lingerie fetish"),
    ("gambling", 1, "poker bingo betting lottery lotto jackpot odds wager win winner prize prizes"),
    ("money", 1, "loan loans credit payday forex crypto cash earn profit bonus cheap discount deal deals"),
    ("advertising", 1, "ads ad adserver advert banner banners promo promotion sponsor affiliate popup popunder click clicks track tracker tracking pixel utm"),
    ("bulk", 1, "free farm download downloads mirror proxy hack cheats generator followers clickbait"),
)
VOCABULARY = {term: weight for _, weight, terms in TERMS for term in terms.split()}
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
SCHEMA = "host string, path string, rule string, strict_hits long, soft_hits long, weight long, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


def automaton(vocabulary: dict[str, int], limit: int = LIMIT) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        found.add_word(term.lower(), (weight, weight >= limit, term.lower()))
    found.make_automaton()
    return found


def hits(machine: ahocorasick.Automaton, url: str) -> tuple[int, int, int]:
    """Strict hits, different soft terms, and the sum of the weights of all different terms, with boundaries on both sides."""
    low, strict, found = url.translate(_LOWER), 0, {}
    for end, (weight, is_strict, term) in machine.iter(low) if len(machine) else ():
        start = end - len(term) + 1
        if (start and low[start - 1] in _ALNUM) or (end + 1 < len(low) and low[end + 1] in _ALNUM):
            continue
        strict += is_strict
        found[term] = (weight, is_strict)
    return strict, sum(not s for _, s in found.values()), sum(w for w, _ in found.values())


def judge(pages: DataFrame, rules=RULES, vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """`keep` columns with host, path, rule, strict_hits, soft_hits, weight and verdict (allow or block) of each url.

    strict_hits: places of terms that weigh `limit` or more; soft_hits: different lighter terms; weight: of all different terms.

    A null url has an empty host and path, no rule and no hits, and is allowed. Repeated rows are judged alike; urls of any
    length are read whole; an empty table gives no rows. Of two rules with the same host and path the first counts. Other
    columns are ignored, whatever their names.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))
    for host in by_host:
        by_host[host].sort(key=lambda x: -len(x[0]))
    kept = pages.select(*keep, F.col(url).cast("string").alias("_url"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + ", " + SCHEMA

    def rule_of(host: str, path: str) -> tuple[str, str] | None:
        best, suffix = None, host
        while suffix:
            for start, verdict in by_host.get(suffix, ()):
                if path.startswith(start):
                    if best is None or len(suffix) + len(start) > len(best[0]):
                        best = (suffix + start, verdict)
                    break
            suffix = suffix.partition(".")[2]
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocabulary, limit)
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                host, path = split_url(text)
                rule, (hard, mild, weight) = rule_of(host, path), hits(machine, text or "")
                verdict = rule[1] if rule else "block" if weight >= limit else "allow"
                out.append((host, path, rule and rule[0], hard, mild, weight, verdict))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = [*batch.schema.names[:-1], "host", "path", "rule", "strict_hits", "soft_hits", "weight", "verdict"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return kept.mapInArrow(run, schema)


def oracle_sql() -> str:
    """DuckDB SQL of `judge` over pages with the default vocabulary and rules."""
    terms = ", ".join(f"('{t}', {w})" for t, w in VOCABULARY.items())
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    # A hit is a place of the term with neither letter nor digit at either side; hits of one term may share a boundary.
    return f"""
WITH cut AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(url, {letters}) AS low, translate(regexp_extract(rest, '^[^/?#]*'), {letters}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(kind, rhost, rpath) AS (VALUES {rules}),
best AS (SELECT page_id, first(rhost || rpath ORDER BY length(rhost || rpath) DESC) AS rule, first(kind ORDER BY length(rhost || rpath) DESC) AS kind
    FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
terms(term, weight) AS (VALUES {terms}),
places AS (SELECT page_id, term, weight, len(list_filter(range(1, length(low) + 1), lambda i: substr(low, i, length(term)) = term
    AND NOT regexp_matches(substr(low, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '[a-z0-9]') AND NOT regexp_matches(substr(low, i + length(term), 1), '[a-z0-9]'))) AS n
    FROM parts JOIN terms ON contains(low, term)),
counted AS (SELECT page_id, coalesce(sum(n) FILTER (weight >= {LIMIT}), 0)::BIGINT AS strict_hits, (count(*) FILTER (weight < {LIMIT}))::BIGINT AS soft_hits, sum(weight)::BIGINT AS weight
    FROM places WHERE n > 0 GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(strict_hits, 0)::BIGINT AS strict_hits, coalesce(soft_hits, 0)::BIGINT AS soft_hits, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(kind, CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best USING (page_id) LEFT JOIN counted USING (page_id)"""
