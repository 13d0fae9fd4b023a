"""Learned decision lists for text quality: sequential covering over document statistics.

A rule is a conjunction of thresholds that marks bad texts. Rules are grown one condition at a time by information gain,
pruned on rows that growing has not seen, and accepted while they stay precise. Each step is one aggregate over the
labelled statistics that returns a few hundred counts; the learned list is an ordered Spark CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convsignals.llm.statistics import BASE, SHARES, text_statistics
from convsignals.session import stored


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def verdict(rules: list[Rule]) -> Column:
    """True if no rule marks the row: an ordered CASE over the statistics."""
    if not rules:
        return F.lit(True)
    case = F.when(rules[0].column(), F.lit(False))
    for r in rules[1:]:
        case = case.when(r.column(), F.lit(False))
    return case.otherwise(F.lit(True))


def first_rule(rules: list[Rule]) -> Column:
    """Number of the rule that decides, from 1; null if none does."""
    case = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules, 1))):
        case = F.when(r.column(), F.lit(k)).otherwise(case)
    return case


def learn_rules(
    labelled: DataFrame,
    features: list[str] = SHARES,
    bins: int = 32,
    max_rules: int = 12,
    max_conditions: int = 3,
    least_rows: int = 5,
    least_precision: float = 0.75,
) -> list[Rule]:
    """Decision list from rows with ``features``, boolean ``bad`` and boolean ``pruning``.

    All labelled rows count; only counts by (feature, bin) reach the driver, whatever the number of rows. Rows with a
    null label are left out, null features count as 0, and repeated rows count each. No rows, or one class only, give
    an empty list, which keeps everything. Ties go to the earlier feature, then the smaller threshold.
    """
    rows = labelled.filter(F.col("bad").isNotNull()).select(
        F.col("bad").cast("int").alias("bad"), "pruning", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in features]
    )
    rows = stored(rows)
    cuts_row = rows.agg(
        *[F.percentile_approx(f, [(i + 1) / bins for i in range(bins - 1)], 20000).alias(f) for f in features]
    ).first()
    if cuts_row[features[0]] is None:
        return []
    cuts = {f: sorted(set(cuts_row[f])) for f in features}
    # Most features are zero in most rows: bounds inside the rare positive part matter most.
    tail = rows.agg(
        *[
            F.percentile_approx(F.when(F.col(f) > 0, F.col(f)), [(i + 1) / bins for i in range(bins - 1)], 20000).alias(f)
            for f in features
        ]
    ).first()
    cuts = {f: sorted({*cuts[f], *(tail[f] or [])}) for f in features}

    def bin_of(f: str) -> Column:
        """How many cuts lie below the value: a balanced search tree of comparisons."""

        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col(f) > F.lit(cuts[f][mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

        return tree(0, len(cuts[f]))

    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), bin_of(f).alias("b")) for k, f in enumerate(features)]))
    left, rules = ~F.lit(False), []
    while len(rules) < max_rules:
        grown: list[Condition] = []
        within = left & ~F.col("pruning")
        total = None
        while len(grown) < max_conditions:
            counts = (
                rows.filter(within)
                .select("bad", pairs.alias("x"))
                .groupBy("x.f", "x.b")
                .agg(F.sum("bad").alias("p"), F.count("*").alias("n"))
                .collect()
            )
            table = {(r["f"], r["b"]): (r["p"], r["n"]) for r in counts}
            p0, n0 = (sum(v[i] for (f, _), v in table.items() if f == 0) for i in (0, 1))
            total = total or p0
            if not p0 or p0 == n0:
                break
            best = None
            for k, f in enumerate(features):
                p = n = 0
                for b, cut in enumerate(cuts[f]):
                    dp, dn = table.get((k, b), (0, 0))
                    p, n = p + dp, n + dn
                    for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if pp >= least_rows and nn < n0:
                            gain = pp * (math.log2(pp / nn) - math.log2(p0 / n0))
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, Condition(f, above, float(cut)))
            if best is None:
                break
            grown.append(best[1])
            within = within & best[1].column()
        if not grown:
            break
        prefixes = [Rule(tuple(grown[:k]), 0, 0) for k in range(1, len(grown) + 1)]
        held = rows.filter(left & F.col("pruning")).agg(
            *[F.coalesce(F.sum(F.when(r.column(), F.col("bad"))), F.lit(0)).alias(f"p{k}") for k, r in enumerate(prefixes)],
            *[F.count(F.when(r.column(), 1)).alias(f"n{k}") for k, r in enumerate(prefixes)],
        ).first()
        scored = [((2 * held[f"p{k}"] - held[f"n{k}"]) / held[f"n{k}"] if held[f"n{k}"] else -1.0, -k) for k in range(len(prefixes))]
        value, minus_k = max(scored)
        if value < 2 * least_precision - 1:
            break
        rule = prefixes[-minus_k]
        rules.append(Rule(rule.conditions, held[f"p{-minus_k}"], held[f"n{-minus_k}"] - held[f"p{-minus_k}"]))
        left = left & ~rule.column()
    return rules


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts, F.lit(0))


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Base counts, base verdict and the learned verdict of every text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean) and
    rule (int: the rule that rejects, null if none). ``labels`` has doc_id and quality (1 good, 0 bad). Rules grow on the
    ids whose fold of five is 2, 3 or 4 and are pruned on fold 1; fold 0 is never learned from. Nulls: a null text has no
    words and fails the base rule; null ids and null labels are not learned from. Rows that repeat stay repeated. An
    empty table gives an empty result; without usable labels the learned list is empty and only the base rule rejects.
    """
    stats = stored(text_statistics(docs))
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality")
    part = fold(F.col("doc_id"), 5)
    labelled = (
        stats.filter(part > 0)
        .join(marks, "doc_id")
        .select(*SHARES, (F.col("quality") == 0).alias("bad"), (part == 1).alias("pruning"))
    )
    rules = learn_rules(labelled, **options)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select(
        "doc_id",
        *BASE,
        failed.alias("base_failed"),
        (~failed & verdict(rules)).alias("kept"),
        first_rule(rules).alias("rule"),
    )
