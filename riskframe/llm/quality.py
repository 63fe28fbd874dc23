"""Quality rules as weak supervision, in DataFrame expressions only.

Every rule looks at one signal of a text and votes good, bad or abstains. The
documents are counted by vote pattern (at most ``3 ** len(RULES)`` rows,
whatever the table), expectation-maximisation over these counts estimates how
each rule votes on good and on bad documents, and a document is kept if the
posterior probability of good is at least one half. No single rule decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import SPACE_CLASS, words, written

#: Frequent function words of English, German, French, Spanish.
STOP_WORDS = (
    "the be to of and in that is it for on with as was are by this from or an "
    "der die das und zu den von mit sich des auf ist im dem nicht ein eine als auch "
    "le la les de et un une du des que qui dans en pour pas par sur est au avec "
    "el los las y a del se por con una su para es al lo como"
).split()

#: Fixed values of the base checks.
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Bad where ``bad`` holds, else good where ``good`` holds, else abstains
    (also where either is null)."""

    name: str
    good: Column
    bad: Column


def rules() -> list[Rule]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    symbols = F.col("n_symbols") / n
    mean = F.col("word_chars") / n
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    repeat = F.col("n_repeat_words") / n
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    stops = F.col("n_stop_words") / n
    ends = F.col("n_sentence_ends") / n
    some = F.col("n_words") >= 20
    return [
        Rule("symbols", symbols <= 0.05, symbols > 0.2),
        Rule("word_length", mean.between(3.5, 6.4), some & ((mean < 2.5) | (mean > 7.2))),
        Rule("upper_case", upper < 0.15, upper > 0.4),
        Rule("repeated_words", repeat <= 0.1, repeat > 0.4),
        Rule("repeated_lines", lines <= 0.1, lines > 0.4),
        Rule("stop_words", some & (stops >= 0.05), some & (stops < 0.02)),
        Rule("sentences", some & ends.between(0.02, 0.3), some & ((ends < 0.003) | (ends > 0.6))),
        Rule("length", F.col("n_words") >= 50, F.col("n_words") < 3),
    ]


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct) and the text's signals:
    ``n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words,
    n_upper, n_stop_words, n_sentence_ends`` (long; a null text is empty).

    Repeated windows are found within the row: 64-bit hashes of the 5-word
    windows, sorted only where ``array_distinct`` finds a repeat. No row meets
    another one, so hot keys and repeated rows make no difference.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"))
    rows = rows.select("row", "t", words(F.col("t")).alias("w"))
    blank = F.split("t", "\n")
    rows = rows.select(
        "row",
        "t",
        "w",
        F.filter(blank, lambda line: line.rlike(SPACE_CLASS.replace("[", "[^"))).alias("lines"),
        F.when(
            F.size("w") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("w") - WINDOW),
                lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(WINDOW)]),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("h"),
    )
    counted = rows.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.regexp_count("t", F.lit(r"[.!?](?![^\x20\x09-\x0D])")).cast("long").alias("n_sentence_ends"),
        # sorted (hash, position) of the windows, if any hash repeats
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ).alias("s"),
    )
    twice = counted.select(
        "*",
        F.sort_array(
            F.filter(
                F.transform(
                    "s",
                    lambda e, i: F.when(
                        F.coalesce(F.get("s", i - 1)["x"] == e["x"], F.lit(False))
                        | F.coalesce(F.get("s", i + 1)["x"] == e["x"], F.lit(False)),
                        e["i"],
                    ),
                ),
                lambda p: p.isNotNull(),
            )
        ).alias("p"),
    )
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    return twice.select("*", F.coalesce(covered, F.lit(0)).alias("n_repeat_words")).drop("s", "p")


def with_votes(rows: DataFrame) -> DataFrame:
    """Adds ``votes``: one of -1 (bad), 0, 1 (good) for each rule."""
    votes = [
        F.when(r.bad, F.lit(-1)).when(r.good, F.lit(1)).otherwise(F.lit(0)) for r in rules()
    ]
    return rows.withColumn("votes", F.array(*votes))


@dataclass(frozen=True)
class VoteModel:
    """Log prior odds of good, and for each rule the log ratio of the
    probabilities of a bad and of a good vote on good and on bad documents.
    An abstention says nothing."""

    prior: float
    weights: list[tuple[float, float]]

    def log_odds(self, votes: Column) -> Column:
        out = F.lit(self.prior)
        for j, (bad, good) in enumerate(self.weights):
            weight = F.array(F.lit(bad), F.lit(0.0), F.lit(good))
            out = out + F.element_at(weight, F.get(votes, F.lit(j)) + 2)
        return out


def fit_votes(
    patterns: dict[tuple[int, ...], int],
    good_share: float = 0.8,
    strength: float = 0.02,
    rounds: int = 200,
) -> VoteModel:
    """Expectation-maximisation over vote patterns and their counts.

    A rule that votes has an accuracy on good documents and one on bad ones.
    The start, kept as pseudo-counts (``strength`` of all documents), is the
    belief that good documents hardly get bad votes while bad ones often do;
    that fixes which of the two classes is the good one. Without documents
    the belief itself is the model.
    """
    total = sum(patterns.values())
    n_rules = len(next(iter(patterns), ())) or len(rules())
    belief = (0.4, 0.02)  # P(bad vote | a vote) on bad and on good documents
    p = [[belief[c]] * n_rules for c in (0, 1)]
    share = good_share
    extra = max(1.0, strength * total)

    def ratio(j: int, vote: int) -> float:
        if vote == 0:
            return 0.0
        on_bad, on_good = p[0][j], p[1][j]
        return math.log(on_good / on_bad) if vote < 0 else math.log((1 - on_good) / (1 - on_bad))

    for _ in range(rounds):
        mass = [0.0, 0.0]
        voted = [[0.0] * n_rules, [0.0] * n_rules]
        against = [[0.0] * n_rules, [0.0] * n_rules]
        table = [{v: ratio(j, v) for v in (-1, 0, 1)} for j in range(n_rules)]
        prior = math.log(share / (1 - share))
        for votes, n in patterns.items():
            odds = prior + sum(table[j][v] for j, v in enumerate(votes))
            good = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            for c, q in ((1, good * n), (0, (1 - good) * n)):
                mass[c] += q
                for j, v in enumerate(votes):
                    if v:
                        voted[c][j] += q
                        against[c][j] += q * (v < 0)
        before = share
        share = (mass[1] + extra * good_share) / (total + extra)
        for c in (0, 1):
            for j in range(n_rules):
                p[c][j] = (against[c][j] + extra * belief[c]) / (voted[c][j] + extra)
        if total and abs(share - before) < 1e-9:
            break
    return VoteModel(
        math.log(share / (1 - share)), [(ratio(j, -1), ratio(j, 1)) for j in range(n_rules)]
    )


def fit(voted: DataFrame) -> VoteModel:
    """The model of a table with ``votes``; counts cover every row."""
    counts = voted.groupBy("votes").count().collect()  # at most 3 ** rules
    return fit_votes({tuple(r["votes"]): r["count"] for r in counts})


def judged(
    docs: DataFrame, text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of the columns in
    ``carry``, default all), the signals, ``votes``, ``quality`` (posterior
    probability of good), ``base_failed`` (under 10 words, or over 20 % of
    the words in repeated 5-word windows) and ``kept`` (neither base failed
    nor quality under one half).

    Null texts count as empty: they fail the base checks. Repeated rows are
    judged alike. An empty table gives an empty result. Extra columns, also
    with the names above, travel inside ``row``.
    """
    voted = with_votes(signals(docs, text_col))
    if carry is not None:
        voted = voted.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in carry]))
    voted = written(voted, "signals")
    odds = fit(voted).log_odds(F.col("votes"))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        voted.withColumn("quality", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= 0.5))
    )


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    return judged(docs, text_col).where("kept").select("row.*")
