"""Quality rules under weak supervision, in native expressions only.

Each rule votes good (1) or bad (0) on a text or abstains (null). Votes are counted by
pattern over all documents; there are at most 3 ** rules patterns, so the table that
reaches the driver has a fixed bound. Expectation-maximisation over it estimates the shares
of good texts and of several kinds of bad ones and, for each of them and each rule, how often it votes either way or abstains. A text
is kept where its posterior probability of being good is at least one half, rather than
where it passes all rules.

Everything a row needs is computed in the row: three-word windows are hashed, sorted within
the row and compared with their neighbours, so no window is ever shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import WORD_CLASS, words_column

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with the counts that rules and base limits use. A null text counts as empty."""
    own = [*FEATURES, "__lines", "__upper", "__bangs", "__stops", "__kinds"]
    docs = docs.drop(*own)
    t = F.coalesce(F.col(text), F.lit(""))
    spread = docs.withColumns(
        {
            "__w": words_column(F.col(text)),
            "__ls": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS)),
        }
    )
    n = F.size("__w")
    grams = F.when(n >= 3, F.expr("transform(sequence(0, size(__w) - 3), i -> struct(xxhash64(__w[i], __w[i + 1], __w[i + 2]) AS h, i AS i))")).otherwise(F.expr("cast(array() AS array<struct<h: bigint, i: int>>)"))
    sorted_ = spread.withColumns(
        {
            "__s": F.sort_array(grams),
            "n_words": n.cast("long"),
            "word_chars": _without(t, SPACES).cast("long"),
            "n_symbols": (F.length(t) - _without(t, SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__ls") - F.size(F.array_distinct("__ls"))).cast("long"),
            "__lines": F.size("__ls").cast("long"),
            "__upper": (F.length(t) - _without(t, UPPER)).cast("long"),
            "__bangs": (F.length(t) - _without(t, "!?")).cast("long"),
            "__stops": (F.length(t) - _without(t, ".")).cast("long"),
            "__kinds": F.size(F.array_distinct("__w")).cast("long"),
        }
    ).drop("__w", "__ls")
    again = sorted_.withColumn("__r", F.expr("sort_array(transform(filter(__s, (x, k) -> coalesce(get(__s, k - 1).h = x.h, false) or coalesce(get(__s, k + 1).h = x.h, false)), x -> x.i))")).drop("__s")
    covered = F.expr("aggregate(__r, named_struct('at', -3, 'n', 0L), (a, i) -> named_struct('at', i, 'n', a.n + least(3, i - a.at)), a -> a.n)")
    return again.withColumn("n_repeat_words", covered).drop("__r")


def votes() -> dict[str, Column]:
    """The rules: 1 good, 0 bad, null abstains. Each looks at its own side of the text."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def two(value: Column, good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    def below(value: Column, good: float, bad: float) -> Column:
        return two(value, value <= good, value > bad)

    length = F.col("word_chars") / n
    long_ = F.col("n_words") >= 50
    return {
        "v_symbols": below(F.col("n_symbols") / n, 0.05, 0.15),
        "v_repeats": below(F.col("n_repeat_words") / n, 0.12, 0.3),
        "v_lines": two(length, F.col("n_dup_lines") == 0, F.col("n_dup_lines") > 0.25 * F.col("__lines")),
        "v_capitals": below(F.col("__upper") / F.greatest(F.col("word_chars"), F.lit(1)), 0.1, 0.35),
        "v_shouting": below(F.col("__bangs") / n, 0.05, 0.25),
        "v_word_length": two(length, (length >= 3) & (length <= 9), (length < 2) | (length > 14)),
        "v_sentences": two(length, long_ & (F.col("__stops") / n).between(0.005, 0.3), long_ & (F.col("__stops") == 0)),
        "v_variety": F.when(F.col("__kinds") / n < 0.1, 0).when(F.col("__kinds") / n > 0.25, 1),
    }


#: Priors of EM, in documents: (vote bad, don't) of a rule on texts that are bad in its way, and on those bad in another way.
OWN, ANOTHER = (9.0, 1.0), (0.1, 0.9)
#: On good texts a rule votes bad once in 200 times, and this weighs as much as a tenth of all documents: what a rule that fires alone
#: says fits a slip on good texts as well as a kind of bad ones, so the votes can't tell. Where a rule doesn't vote bad, it abstains
#: (weakly) once in five times.
SLIP, WEIGHT, SILENT = 0.005, 0.1, (0.2, 0.8)


class Accuracies:
    """What EM estimates: of good texts (first) and of one kind of bad text per rule, the ``share`` of all, and ``votes``: the
    probabilities that each rule votes bad, votes good or abstains."""

    def __init__(self, rules: int):
        self.share = np.array([0.85] + [0.15 / rules] * rules)
        bad = np.full((rules + 1, rules), SLIP)
        bad[np.arange(rules) + 1, np.arange(rules)] = OWN[0] / sum(OWN)
        silent = SILENT[0] / sum(SILENT)
        self.votes = np.stack([bad, (1 - bad) * (1 - silent), (1 - bad) * silent], axis=2)

    def log_odds(self, kind: int, rule: int, vote: int | None) -> float:
        """Of a kind of bad text (from 0) against a good one, by one rule's vote."""
        at = 2 if vote is None else vote
        return float(np.log(self.votes[kind + 1, rule, at]) - np.log(self.votes[0, rule, at]))

    def quality(self, votes: tuple) -> float:
        """Posterior probability that a text with such votes is good."""
        kinds = range(len(self.share) - 1)
        odds = [self.share[k + 1] / self.share[0] * np.exp(sum(self.log_odds(k, j, v) for j, v in enumerate(votes))) for k in kinds]
        return float(1 / (1 + sum(odds)))


def expect(patterns: list[tuple[tuple, int]], rules: int, rounds: int = 200, settled: float = 1e-9) -> Accuracies:
    """EM over counted vote patterns: a mixture of good texts and of kinds of bad ones, each with its own votes of all rules.

    Rules whose votes go together do so in some kind, so they aren't counted as independent evidence. Nothing is
    clamped: priors in documents (``OWN``, ``ANOTHER``, ``SLIP``, ``SILENT``) stand for votes never seen and keep the classes in their places."""
    now = Accuracies(rules)
    if not patterns:
        return now
    seen = np.array([[2 if v is None else v for v in votes_] for votes_, _ in patterns])
    count = np.array([float(n) for _, n in patterns])
    hot = np.eye(3)[seen]  # patterns x rules x votes
    prior = np.tile(np.array(ANOTHER), (rules + 1, rules, 1))
    prior[np.arange(rules) + 1, np.arange(rules)] = OWN
    prior[0] = np.array([SLIP, 1 - SLIP]) * WEIGHT * count.sum()
    few = np.array([8.5] + [1.5 / rules] * rules)
    before = -np.inf
    for _ in range(rounds):
        fit = np.log(now.share) + np.einsum("pjv,kjv->pk", hot, np.log(now.votes))
        top = fit.max(axis=1, keepdims=True)
        each = np.exp(fit - top)
        total = each.sum(axis=1, keepdims=True)
        weight = each / total * count[:, None]
        now.share = (weight.sum(axis=0) + few) / (count.sum() + few.sum())
        table = np.einsum("pk,pjv->kjv", weight, hot)
        bad = (table[..., 0] + prior[..., 0]) / (table.sum(axis=2) + prior.sum(axis=2))
        # How often a rule that doesn't vote bad abstains is a fact of the texts' form (few lines, few words), alike in all classes:
        # left to each class, classes would gather texts that rules are silent on and not bad ones.
        silent = (table[..., 2].sum(axis=0) + SILENT[0]) / (table[..., 1:].sum(axis=(0, 2)) + sum(SILENT))
        now.votes = np.stack([bad, (1 - bad) * (1 - silent), (1 - bad) * silent], axis=2)
        reached = float((count * (np.log(total) + top)[:, 0]).sum())
        if abs(reached - before) <= settled * count.sum():
            break
        before = reached
    return now


def judge(featured: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``features`` plus ``base_failed``, ``quality`` (posterior probability) and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated
    three-word windows; such texts are not kept whatever the rules say. Repeated rows count
    as often as they occur; with no row at all the result is empty. Columns of these names and those of the rules are
    replaced, and the counts that only rules use go."""
    rules = votes()
    names = list(rules)
    voted = featured.drop(*names, "base_failed", "quality", "kept").withColumns(rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** rules rows
    patterns = [(tuple(r[x] for x in names), r["n"]) for r in counted]
    found = expect(sorted(patterns, key=str), len(names))

    odds = F.lit(0.0)
    for k in range(len(names)):
        logs = F.lit(float(np.log(found.share[k + 1] / found.share[0])))
        for j, x in enumerate(names):
            logs = logs + F.when(F.col(x) == 0, found.log_odds(k, j, 0)).when(F.col(x) == 1, found.log_odds(k, j, 1)).otherwise(found.log_odds(k, j, None))
        odds = odds + F.exp(logs)
    quality = F.lit(1.0) / (F.lit(1.0) + odds)
    judged = voted.withColumns({"base_failed": failed, "quality": quality})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).drop(*names, "__lines", "__upper", "__bangs", "__stops", "__kinds")
