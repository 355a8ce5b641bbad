"""Quality rules: a decision list learned from labelled text statistics.

Everything that touches documents is built from DataFrame functions.  One pass
computes the statistics of each whole text.  Sequential covering then learns
rules for the low-quality class: a rule grows one threshold at a time by FOIL
gain on the growing rows, is pruned to the prefix that does best on the rows
held back, and its rows leave before the next rule is learned.  A growth step
is one aggregation into (statistic, bin) cells, so the driver sees a bounded
histogram and never a row.  The list is emitted as one ordered conditional
expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm._shared import SPACE_CHARS, let, materialize, table, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"

#: Statistics that rules may test, as expressions over text_stats()' columns.
RATIOS = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_word_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclaim_a_word": "n_exclaim / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that the text has twice or more.

    Windows are compared by a 64-bit hash.  Most texts have no repeated window
    and stop at a distinct count; only the others sort their windows.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda j, k: F.get(p, j)["h"].eqNullSafe(F.get(p, k)["h"])
            at = F.sequence(F.lit(0), F.size(p) - 1)
            return F.sort_array(
                F.transform(
                    F.filter(at, lambda j: ((j > 0) & same(j, j - 1)) | ((j < F.size(p) - 1) & same(j, j + 1))),
                    lambda j: F.get(p, j)["i"],
                )
            )

        def total(s: Column) -> Column:
            steps = F.transform(s, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(s, j + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(pairs, lambda p: let(starts(p), total))

    def body(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(width)))
        )
        found = let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
        )
        return F.when(F.size(w) < width, F.lit(0)).otherwise(found)

    return let(words, body).cast("long")


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the statistics of each whole text added.

    A null text counts as empty: all statistics are 0.  Columns of docs that
    have a statistic's name are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def without(chars: str) -> Column:
        return F.char_length(t) - F.char_length(F.translate(t, chars, ""))

    lines = F.split(t, "\n")
    stats = let(
        words_of(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            repeated_window_words(w).alias("n_repeat_words"),
        ),
    )
    worded = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    line_stats = let(
        worded,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return docs.withColumns({"_w": stats, "_l": line_stats}).withColumns(
        {
            "n_words": F.col("_w.n_words"),
            "word_chars": F.char_length(F.translate(t, SPACE_CHARS, "")).cast("long"),
            "n_symbols": without(SYMBOLS).cast("long"),
            "n_dup_lines": F.col("_l.n_dup_lines"),
            "n_repeat_words": F.col("_w.n_repeat_words"),
            "n_lines": F.col("_l.n_lines"),
            "n_distinct_words": F.col("_w.n_distinct_words"),
            "n_upper": without(UPPER).cast("long"),
            "n_digits": without(DIGITS).cast("long"),
            "n_exclaim": without("!").cast("long"),
        }
    ).drop("_w", "_l")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(RATIOS[self.feature])
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" ({self.bad} bad, {self.good} good)"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def rule_number(self) -> Column:
        """Number of the first rule that holds, from 1; 0 if none does."""
        if not self.rules:
            return F.lit(0)
        first = F.when(self.rules[0].column(), F.lit(1))
        for n, rule in enumerate(self.rules[1:], 2):
            first = first.when(rule.column(), F.lit(n))
        return first.otherwise(F.lit(0))


def learn(
    labelled: DataFrame,
    label: str = "quality",
    max_labelled: int = 200_000,
    bins: int = 32,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_bad: int = 8,
    min_precision: float = 0.9,
) -> DecisionList:
    """Learn rules for label 0 from text_stats() columns.

    At most about max_labelled rows are used, picked by a hash of their
    statistics; this bound is a parameter of the fit.  Rows with a null label
    are left out.  Without rows of both classes the list is empty.  A rule must
    reach min_precision on the rows that grew it and on those held back.
    """
    names = list(RATIOS)
    rows = labelled.where(F.col(label).isNotNull()).select(
        (F.col(label) == 0).cast("int").alias("bad"),
        F.xxhash64("n_words", "word_chars", "n_symbols", "n_distinct_words", "n_upper").alias("h"),
        *[F.expr(RATIOS[f]).alias(f) for f in names],
    )
    rows = materialize(rows, "labelled")
    total = rows.count()
    if total > max_labelled:
        rows = rows.where(F.pmod("h", F.lit(1_000_003)) < math.ceil(1_000_003 * max_labelled / total))
    shares = [i / bins for i in range(1, bins)]
    quantiles = rows.agg(*[F.percentile_approx(f, shares, 1000).alias(f) for f in names]).first()
    edges = {f: sorted(set(quantiles[f] or [])) for f in names}

    def bin_of(f: str) -> Column:
        out = F.lit(0)
        for e in edges[f]:
            out = out + (F.col(f) >= F.lit(e)).cast("int")
        return out

    binned = materialize(
        rows.select("bad", (F.pmod("h", F.lit(3)) == 0).alias("held"), *[bin_of(f).alias(f) for f in names]).groupBy(
            "bad", "held", *names
        ).agg(F.count(F.lit(1)).alias("n")),
        "binned",
    )

    def cells(keep: Column) -> dict:
        pairs = F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("b")) for k, f in enumerate(names)])
        got = (
            binned.where(keep)
            .select("bad", "held", "n", F.explode(pairs).alias("p"))
            .groupBy("bad", "held", "p.f", "p.b")
            .agg(F.sum("n").alias("n"))
            .collect()
        )
        return {(r["f"], r["b"], r["bad"], r["held"]): r["n"] for r in got}

    def totals(hist: dict, held: bool) -> tuple[int, int]:
        return tuple(sum(n for (f, _, y, h), n in hist.items() if f == 0 and y == bad and h == held) for bad in (1, 0))

    left, rules = F.lit(True), []
    while len(rules) < max_rules:
        keep, grown, trail = left, [], []
        hist = cells(keep)
        while len(grown) < max_conditions:
            p0, n0 = totals(hist, False)
            if not p0 or not n0:
                break
            base, best = math.log2(p0 / (p0 + n0)), (0.0,)
            for k, f in enumerate(names):
                for cut in range(1, len(edges[f]) + 1):
                    for up in (True, False):
                        p, n = (
                            sum(
                                hist.get((k, b, y, False), 0)
                                for b in (range(cut, len(edges[f]) + 1) if up else range(cut))
                            )
                            for y in (1, 0)
                        )
                        if p >= min_bad and n < n0:
                            gain = p * (math.log2(p / (p + n)) - base)
                            if gain > best[0] + 1e-9:
                                best = (gain, k, cut, up)
            if len(best) == 1:
                break
            _, k, cut, up = best
            f = names[k]
            grown.append(Condition(f, up, float(edges[f][cut - 1])))
            keep = keep & (F.col(f) >= cut if up else F.col(f) < cut)
            hist = cells(keep)
            trail.append((keep, totals(hist, False), totals(hist, True)))
        if not grown:
            break
        value = lambda t: (t[2][0] - t[2][1]) / max(1, sum(t[2]))
        length = max(range(len(trail)), key=lambda i: (round(value(trail[i]), 3), -i)) + 1
        kept_if, (p, n), (hp, hn) = trail[length - 1]
        if p < min_precision * (p + n) or hp < min_precision * (hp + hn) or p + hp < min_bad:
            break
        rules.append(Rule(tuple(grown[:length]), p + hp, n + hn))
        left = left & ~kept_if
    return DecisionList(tuple(rules))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialize(text_stats(docs).drop("text"), "text-stats")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rules = learn(stats.join(labels, "doc_id"))
    return stats.withColumn("rule", rules.rule_number()).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("rule") == 0)).alias("kept"),
        "rule",
    )
