"""Quality rules as weak supervision (operator 9): DataFrame functions only.

Each rule votes good (+1), bad (-1) or abstains (0).  A two-class model with one accuracy per
rule and class explains the votes; expectation-maximisation fits it on the counts of the distinct
vote patterns (at most ``3 ** len(RULES)`` rows whatever the corpus) of all documents that pass the
base rule, for the others are decided; a document is kept when its posterior probability of being
good reaches ``threshold``.

Defined cases: a null or empty text has no words, all counts 0, and fails the base rule; repeated
rows are judged row by row; null ids are kept as they are; an empty table gives an empty result and
the prior parameters; other columns pass through :func:`keep_quality` untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtaint.llm.common import let, own_columns, split_words, stored, window_hashes

WINDOW = 8
#: The characters counted as symbols, and those seldom seen in prose.
SYMBOLS = "[#*$%&|<>]"
ODD = "[0-9\"'()\\[\\]{}/\\\\=+_~^`@#*$%&|<>]"
#: Bits of a packed entry that hold a word position; the other 37 hold a part of the window's hash.
POSITION_BITS = 27
POSITION_MASK = (1 << POSITION_BITS) - 1


def _packed(hashes: Column, position) -> Column:
    high = F.shiftleft(F.shiftright(hashes, POSITION_BITS), POSITION_BITS)
    return high.bitwiseOR(position.cast("bigint"))


def _shared(entries: Column) -> Column:
    """The packed entries whose hash part occurs at least twice."""
    def high(x):
        return F.shiftright(x, POSITION_BITS)

    return let(F.sort_array(entries), lambda s: F.filter(s, lambda x, i: (
        F.coalesce(high(F.get(s, i + 1)) == high(x), F.lit(False))
        | ((i > 0) & F.coalesce(high(F.get(s, F.greatest(i - 1, F.lit(0)))) == high(x), F.lit(False))))))


def _repeated_words(words: Column) -> Column:
    """Number of words inside an 8-word window that the text holds at least twice.

    Windows are compared inside the row: their hashes are packed with their positions, sorted, and
    neighbours compared; a second, independent part of the hash confirms what the first one left.
    Texts whose windows are all different need no sort.
    """
    width, none = F.lit(WINDOW).cast("bigint"), F.lit(0).cast("bigint")

    def count(h: Column) -> Column:
        first = _shared(F.transform(h, lambda x, i: _packed(x, i)))
        again = let(first, lambda c: _shared(F.transform(c, lambda x: let(
            x.bitwiseAND(F.lit(POSITION_MASK)),
            lambda p: _packed(F.xxhash64(F.get(h, p.cast("int")), F.lit(1)), p)))))
        starts = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.lit(POSITION_MASK))))
        covered = let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(width, F.coalesce(F.get(s, i + 1) - p, width))),
            none, lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered)

    windows = window_hashes(F.transform(words, lambda w: F.xxhash64(w)), WINDOW)
    return F.when(F.size(words) > WINDOW, let(windows, count)).otherwise(none)


def _count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(characters)).cast("bigint")


def _of_words(words: Column) -> Column:
    return let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
        _repeated_words(w).alias("n_repeat_words")))


def _of_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.struct(
        F.size(x).cast("bigint").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
            "n_upper", "n_odd", "n_marks"]


def with_features(docs: DataFrame, text: str = "text", into: str = "__quality") -> DataFrame:
    """``docs`` with a struct column of the measures; every other column passes untouched."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn(into, F.struct(
        _of_words(split_words(t)).alias("words"), _of_lines(t).alias("lines"),
        (F.length(t) - _count_of(t, "[\\x20\\x09-\\x0D]")).cast("bigint").alias("word_chars"),
        _count_of(t, SYMBOLS).alias("n_symbols"), _count_of(t, "\\p{Lu}").alias("n_upper"),
        _count_of(t, ODD).alias("n_odd"), _count_of(t, "[!?]").alias("n_marks")))


def _measure(struct: Column):
    inside = {"n_words": "words", "n_distinct": "words", "n_repeat_words": "words",
              "n_lines": "lines", "n_dup_lines": "lines"}
    return lambda c: struct[inside[c]][c] if c in inside else struct[c]


def base_failed(q) -> Column:
    return (q("n_words") < 20) | (100 * q("n_repeat_words") > 30 * q("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _rules(q) -> dict[str, Column]:
    def share(a, b):
        return F.coalesce(q(a) / F.nullif(q(b), F.lit(0)), F.lit(0.0))

    mean = share("word_chars", "n_words")
    return {
        "length": _vote(q("n_words") >= 50, q("n_words") < 20),
        "word_length": _vote(mean.between(3, 10), (mean < 2) | (mean > 15)),
        "symbols": _vote(share("n_symbols", "word_chars") < 0.02, share("n_symbols", "word_chars") > 0.1),
        "lines": _vote(q("n_dup_lines") == 0, (q("n_dup_lines") > 1) & (share("n_dup_lines", "n_lines") > 0.3)),
        "repeats": _vote(share("n_repeat_words", "n_words") < 0.05, share("n_repeat_words", "n_words") > 0.3),
        "capitals": _vote(share("n_upper", "word_chars") < 0.25, share("n_upper", "word_chars") > 0.6),
        "letters": _vote(share("n_odd", "word_chars") < 0.1, share("n_odd", "word_chars") > 0.3),
        "diversity": _vote(share("n_distinct", "n_words") > 0.3, share("n_distinct", "n_words") < 0.1),
        "marks": _vote(share("n_marks", "n_words") < 0.3, share("n_marks", "n_words") > 0.8),
    }


RULES = ["length", "word_length", "symbols", "lines", "repeats", "capitals", "letters", "diversity", "marks"]


@dataclass(frozen=True)
class VoteModel:
    """``prior``: share of good documents; per rule, the accuracy of its votes on good and on bad ones."""

    prior: float
    good: dict[str, float]
    bad: dict[str, float]

    def weights(self, rule: str) -> tuple[float, float]:
        """Log odds that a good and a bad vote of ``rule`` add."""
        return (math.log(self.good[rule] / (1 - self.bad[rule])), math.log((1 - self.good[rule]) / self.bad[rule]))

    def probability(self, votes: tuple[int, ...]) -> float:
        total = math.log(self.prior / (1 - self.prior))
        total += sum(self.weights(r)[v < 0] for r, v in zip(RULES, votes, strict=True) if v)
        return 1 / (1 + math.exp(-total))

    def posterior(self, vote) -> Column:
        """Probability of being good, from the vote columns ``vote(rule)``."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for r in RULES:
            for_good, for_bad = self.weights(r)
            total = total + F.when(vote(r) == 1, for_good).when(vote(r) == -1, for_bad).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


#: Beta priors of the accuracies (their mean is where EM starts) and of the share of good documents.
START = VoteModel(0.8, dict.fromkeys(RULES, 0.995), dict.fromkeys(RULES, 0.25))
PRIOR_WEIGHT = 20.0


def fit(votes: DataFrame, rounds: int = 200, tolerance: float = 1e-6) -> VoteModel:
    """EM on the vote patterns of all rows of ``votes`` (an integer column for each rule).

    The corpus is counted by pattern in Spark; the at most ``3 ** len(RULES)`` counts then fit in
    the driver whatever the input.  Accuracies stay at or above one half for good documents and
    above 0.05 for bad ones, so that a rule's vote never counts for the opposite class.
    """
    patterns = [(tuple(row[r] for r in RULES), row["count"]) for row in votes.groupBy(*RULES).count().collect()]
    model = START
    for _ in range(rounds):
        posterior = [(v, n, model.probability(v)) for v, n in patterns]
        good, bad = {}, {}
        for k, r in enumerate(RULES):
            right = sum(n * p for v, n, p in posterior if v[k] == 1)
            wrong = sum(n * p for v, n, p in posterior if v[k] == -1)
            good[r] = min(0.9999, max(0.5, (right + PRIOR_WEIGHT * START.good[r]) / (right + wrong + PRIOR_WEIGHT)))
            right = sum(n * (1 - p) for v, n, p in posterior if v[k] == -1)
            wrong = sum(n * (1 - p) for v, n, p in posterior if v[k] == 1)
            bad[r] = min(0.95, max(0.05, 1 - good[r], (right + PRIOR_WEIGHT * START.bad[r])
                                   / (right + wrong + PRIOR_WEIGHT)))
        total = sum(n for _, n, _ in posterior)
        share = (sum(n * p for _, n, p in posterior) + PRIOR_WEIGHT * START.prior) / (total + PRIOR_WEIGHT)
        new = VoteModel(min(0.99, max(0.5, share)), good, bad)
        moved = max([abs(new.prior - model.prior), *(abs(new.good[r] - model.good[r]) for r in RULES),
                     *(abs(new.bad[r] - model.bad[r]) for r in RULES)])
        model = new
        if moved < tolerance:
            break
    return model


def votes_of(features: DataFrame, q=F.col) -> DataFrame:
    return features.select(*[v.alias(r) for r, v in _rules(q).items()])


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: ``doc_id``, the measures, the votes, the posterior and ``kept``.

    The measures are written once to the shared store; fitting and judging read them from there.
    """
    d = with_features(docs.select("doc_id", text), text)
    m = _measure(F.col("__quality"))
    f = stored(d.select("doc_id", *[m(c).alias(c) for c in FEATURES]), "quality-measures")
    rules = _rules(F.col)
    model = fit(votes_of(f.where(~base_failed(F.col))))
    p = model.posterior(lambda r: rules[r])
    return f.select("*", base_failed(F.col).alias("base_failed"), p.alias("p_good"),
                    *[rules[r].alias(f"vote_{r}") for r in RULES]) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


@own_columns
def keep_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only.

    The rows are written once with their measures: a filter on a measure would otherwise be pushed
    below its projection and compute it again for every reference."""
    q = _measure(F.col("__quality"))
    d = stored(with_features(docs, text), "measured")
    model = fit(votes_of(d.where(~base_failed(q)), q))
    rules = _rules(q)
    kept = ~base_failed(q) & (model.posterior(lambda r: rules[r]) >= threshold)
    return d.where(kept).drop("__quality")
