"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelyst.llm.batches import with_text_columns

# The default vocabulary. One strict term, or SOFT_LIMIT different soft ones, reject a url.
STRICT = (
    "adult", "bet", "bets", "betting", "casino", "casinos", "escort", "escorts", "gambling", "hentai", "malware",
    "phishing", "pills", "poker", "porn", "porno", "sex", "slots", "spam", "viagra", "warez", "xxx",
)
SOFT = (
    "ads", "affiliate", "bonus", "cheap", "click", "coupon", "crack", "deal", "deals", "farm", "free", "jackpot",
    "keygen", "lottery", "offer", "popup", "promo", "track", "tracker", "win", "winner",
)
SOFT_LIMIT = 2
#: Rules are literals of the plan; a larger list belongs in a table that is joined.
MOST_RULES = 1000

Rule = tuple[str, str, str]  # verdict, host, path

HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Between the first :// and the next / ? # or end, A-Z lower-cased; from there to ? # or end. Else both empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, HOST, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, PATH, 1)


def _rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as (rule, verdict), or null. Rules of equal length: the first by name."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in reversed(ordered):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _finder(strict: tuple[str, ...], soft: tuple[str, ...]):
    """Counts of different strict and soft terms in a url: terms count only between non-letters."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (0, strict)):  # a term in both lists is strict
        for term in terms:
            automaton.add_word(term, (kind, term))
    automaton.make_automaton()
    letters = frozenset(string.ascii_lowercase)
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

    def count(url: str | None) -> tuple[int, int]:
        text = (url or "").translate(lower)
        found = set()
        for end, (kind, term) in automaton.iter(text):
            start = end - len(term)
            if (start < 0 or text[start] not in letters) and (end + 1 >= len(text) or text[end + 1] not in letters):
                found.add((kind, term))
        bad = sum(kind == 0 for kind, _ in found)
        return bad, len(found) - bad

    return count


def judge_urls(
    pages: DataFrame, rules: list[Rule], *, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_strict, n_soft`` for every row of ``pages``.

    A fitting rule decides; else the vocabulary blocks a url with a strict term or ``soft_limit`` different soft
    terms. Null urls, and those without ://, have no host, path or rule; null and empty ones are allowed. Repeated
    rows and null ids give a row each; other columns are not read; no rows give no rows.
    """
    host, path = host_and_path()
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    ruled = split.withColumn("found", _rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"))

    def make():
        count = _finder(strict, soft)

        def run(urls):
            found = [count(u) for u in urls]
            return [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())]

        return run

    keep = ["page_id", "host", "path", "rule", "ruled"]
    counted = with_text_columns(ruled, make, [("n_strict", "long"), ("n_soft", "long")], text="url", keep=keep)
    by_words = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    return counted.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_words).alias("verdict"), "n_strict", "n_soft"
    )
