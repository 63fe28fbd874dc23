"""URL filters: pattern rules found by their rarest literal token.

Each rule is indexed under one token only, the one fewest URLs of the table
have; the tokens of a URL fetch the rules indexed under them, and only those
run their regular expression. The index is a literal array of hash buckets for
at most ``MAX_RULES`` rules inside the expression: a token opens its own bucket
only, however many rules there are. URLs are judged where they are: no shuffle,
and repeated rows or hot hosts make no difference. More rules are a table of
the same index, joined to the tokens of the distinct URLs.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import ascii_lower, free_name

#: Rules in a literal index (about 200 bytes each travel with every task).
MAX_RULES = 20_000
TOKEN = "[^./]+"
_RULE = "rule string, action string, regex string, rank int, own int"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is a host and the start of a path, like
    ``example.net/en/``; it fits the host and all its subdomains. ``*``
    stands for any characters but slashes. A ``fallback`` rule counts only
    where no other rule fits."""

    action: str
    pattern: str
    fallback: bool = False

    def regex(self) -> str:
        """Over ``host/path`` with a dot before the host."""
        host, slash, path = self.pattern.partition("/")
        text = "*" if host == "" else "." + host
        any_of = lambda s: "[^/]*".join(re.sub(r"([^0-9A-Za-z/])", r"\\\1", x) for x in s.split("*"))
        return f"^[^/]*{any_of(text)}" + (any_of(slash + path) if slash else "(?:/|$)")

    def tokens(self) -> list[str]:
        """Literal tokens that every URL it fits must have: host labels and
        whole path segments, without those beside a wildcard."""
        host, slash, path = self.pattern.partition("/")
        whole = [x for x in host.split(".") if x and "*" not in x]
        segments = path.split("/")[:-1]  # the last may go on in the URL
        return whole + [x for s in segments if "*" not in s for x in s.split(".") if x]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z
    lower-cased. Empty for a null or one without ``://``."""
    rest = _rest(url)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.concat_ws("/", host, path), "[./]"), ""))


def _buckets(entries: list[tuple[str, dict]], typed: str) -> tuple[Column, int]:
    """A literal array of hash buckets: each entry under the CRC-32 of its
    token, with some two buckets for each token."""
    size = 1 << max(1, len({t for t, _ in entries})).bit_length()
    table: list[list[dict]] = [[] for _ in range(size)]
    for token, entry in entries:
        table[zlib.crc32(token.encode("utf-8")) % size].append({"token": token, **entry})
    return F.from_json(F.lit(json.dumps(table)), f"array<array<struct<token:string{typed}>>>"), size


def _bucket(table: Column, size: int, token: Column) -> Column:
    """The entries under ``token``, from its bucket alone."""
    entries = F.get(table, (F.crc32(F.encode(token, "UTF-8")) % size).cast("int"))
    return F.filter(entries, lambda e: e["token"] == token)


def token_counts(parts: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many rows of ``parts(host, path)`` have each of the given tokens.
    One pre-aggregated pass; one row per token at most comes back."""
    if not tokens:
        return {}
    table, size = _buckets([(t, {}) for t in tokens], "")
    found = F.filter(_tokens(F.col("host"), F.col("path")), lambda t: F.size(_bucket(table, size, t)) > 0)
    rows = parts.select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def judge_urls(
    pages: DataFrame,
    rules: list[UrlRule],
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """All columns of ``pages`` plus ``host, path, rule, verdict`` (numbered
    where ``pages`` has such a name).

    Of the rules that fit, the longest pattern wins (ties: the first in code
    point order); fallback rules come after all others. ``rule`` is its
    pattern, null if only a fallback or none fits; ``verdict`` its action,
    else ``default``. A null URL, or one without ``://``, has an empty host
    and path and fits none. Repeated rows are judged alike; an empty table or
    an empty list of rules is fine. More than ``MAX_RULES`` rules are joined.
    Rules without a literal token (``*/ok``) run on every URL, by nature.
    """
    host, path, rule, verdict = (free_name(pages, c) for c in ("host", "path", "rule", "verdict"))
    url = F.col(f"`{url_col}`")
    order = sorted(rules, key=lambda r: (r.fallback, -len(r.pattern), r.pattern))
    split = pages.withColumn(host, host_of(url)).withColumn(path, path_of(url))
    h, p = F.col(f"`{host}`"), F.col(f"`{path}`")
    chosen = free_name(split, "chosen")
    if len(rules) > MAX_RULES:
        out = _joined(split, h, p, order, chosen)
    else:
        out = split.withColumn(chosen, _looked_up(pages, url, h, p, order))
    c = F.col(f"`{chosen}`")
    return (
        out.withColumn(rule, F.when(c["own"] == 1, c["rule"]))
        .withColumn(verdict, F.coalesce(c["action"], F.lit(default)))
        .drop(chosen)
    )


def _looked_up(pages: DataFrame, url: Column, h: Column, p: Column, order: list[UrlRule]) -> Column:
    """The first rule in ``order`` that fits, from a literal index."""
    parts = pages.select(host_of(url).alias("host"), path_of(url).alias("path"))
    seen = token_counts(parts, sorted({t for r in order for t in r.tokens()}))
    keyed = [(min(r.tokens(), key=lambda t: (seen.get(t, 0), t), default=""), rank, r) for rank, r in enumerate(order)]
    found = [_first_fit(h, p, [(rank, r) for token, rank, r in keyed if not token])]
    entries = [(token, _entry(rank, r)) for token, rank, r in keyed if token]
    if entries:
        table, size = _buckets(entries, f",{_typed()}")
        fetched = F.flatten(F.transform(_tokens(h, p), lambda t: _bucket(table, size, t)))
        found.append(_least(h, p, fetched))
    return F.array_min(F.array(*found))


def _entry(rank: int, r: UrlRule) -> dict:
    return {"rule": r.pattern, "action": r.action, "regex": r.regex(), "rank": rank, "own": int(not r.fallback)}


def _least(h: Column, p: Column, rules: Column) -> Column:
    """Of an array of rules, the first that fits; null if none does."""
    whole = F.concat(F.lit("."), h, p)
    fits = F.filter(rules, lambda r: (h != "") & F.regexp_like(whole, r["regex"]))
    return F.array_min(F.transform(fits, lambda r: F.struct(r["rank"], r["rule"], r["action"], r["own"])))


def _first_fit(h: Column, p: Column, rules: list[tuple[int, UrlRule]]) -> Column:
    """The first of the rules without a literal token that fits."""
    listed = json.dumps([_entry(rank, r) for rank, r in rules])
    return _least(h, p, F.from_json(F.lit(listed), f"array<struct<{_typed()}>>"))


def _joined(split: DataFrame, h: Column, p: Column, order: list[UrlRule], chosen: str) -> DataFrame:
    """``split`` with the first rule in ``order`` that fits, as ``chosen``: the
    index as a table, joined to the tokens of the distinct hosts and paths."""
    spark = split.sparkSession
    rows = [(r.pattern, r.action, r.regex(), i, int(not r.fallback)) for i, r in enumerate(order)]
    table = spark.createDataFrame(rows, _RULE)
    listed = spark.createDataFrame(
        [(i, t) for i, r in enumerate(order) for t in sorted(set(r.tokens()))], "rank int, token string"
    )
    parts = split.select(h.alias("h"), p.alias("p")).where("h <> ''").distinct()
    tokens = parts.select("h", "p", F.explode(_tokens(F.col("h"), F.col("p"))).alias("token"))
    seen = tokens.groupBy("token").agg(F.count("*").alias("n"))
    rarest = listed.join(seen, "token", "left").groupBy("rank").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")
    )
    fits = tokens.join(rarest.join(table, "rank"), "token").where(
        F.regexp_like(F.concat(F.lit("."), F.col("h"), F.col("p")), F.col("regex"))
    )
    key, rest = free_name(split, "key_host"), free_name(split, "key_path")
    best = fits.groupBy(F.col("h").alias(key), F.col("p").alias(rest)).agg(
        F.min(F.struct("rank", "rule", "action", "own")).alias(chosen)
    )
    met = split.join(best, (h == F.col(key)) & (p == F.col(rest)), "left").drop(key, rest)
    # no token, no join: such rules would all share one key that every URL has
    free = _first_fit(h, p, [(i, r) for i, r in enumerate(order) if not r.tokens()])
    return met.withColumn(chosen, F.array_min(F.array(F.col(f"`{chosen}`"), free)))


def _typed() -> str:
    return _RULE.replace(" string", ":string").replace(" int", ":int")
