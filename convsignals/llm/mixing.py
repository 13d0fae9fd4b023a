"""Mixing sources to target weights by iterative proportional fitting.

Token masses of (source, lang, topic) cells are raked until their margins meet the targets; the ratio of raked to actual mass
is a document's weight, and calibrated probabilities proportional to it pick documents up to a token budget. No stratum is
pooled: up to DRIVER_CELLS cells are raked in arrays, more of them as a Spark table by grouped sums per margin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convsignals.llm.tables import Scratch, released
from convsignals.session import stored

DIMENSIONS = ["source", "lang", "topic"]
#: Cells that the driver may hold; the same fit runs on Spark beyond.
DRIVER_CELLS = 200_000
#: Target share of a stratum is its token share to this power, unless targets are given.
POWER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 12
BUDGET = 0.8
NONE = "~none"

TOPICS = [
    ("table", "\\|[^|\n]*\\|"),
    ("symbols", "###|\\$\\$\\$|%%%|&&&|\\*\\*\\*"),
    ("shout", "[A-Z]{2,}[^A-Za-z]+[A-Z]{2,}[^A-Za-z]+[A-Z]{2,}"),
    ("figures", "[0-9]{4}"),
]


def default_topic(text: Column, n_tokens: Column) -> Column:
    """A coarse register of the whole text, used where no topic column is given."""
    case = F.when(n_tokens == 0, F.lit("empty"))
    for name, pattern in TOPICS:
        case = case.when(text.rlike(pattern), F.lit(name))
    return case.when(n_tokens < 50, "note").when(n_tokens < 400, "article").otherwise("long")


def uniform(id_col: Column, text: Column) -> Column:
    """A number in [0, 1) from the id alone, or from the text of a row without an id."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("text-"), F.md5(text.cast("binary"))))
    h = F.substring(F.md5(F.concat(F.lit("mix-"), name).cast("binary")), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(16**13))


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS) -> np.ndarray:
    """Mass of each cell (``tokens`` and the columns of DIMENSIONS) after fitting the margins in turn; the total is 1.

    Listed targets are shares; strata without one split what the listed leave by their power law.
    """
    tokens = cells["tokens"].to_numpy(float)
    mass = tokens / tokens.sum()
    margins = {}
    for d in DIMENSIONS:
        names, at = np.unique(cells[d].to_numpy(str), return_inverse=True)
        natural = np.bincount(at, tokens, len(names))
        share = np.where(natural > 0, natural, 0.0) ** POWER[d] * (natural > 0)
        given = np.array([targets.get(d, {}).get(n, np.nan) for n in names])
        listed = ~np.isnan(given) & (natural > 0)
        rest = max(0.0, 1 - given[listed].sum())
        loose = share[~listed].sum()
        goal = np.where(listed, np.nan_to_num(given), rest * share / loose if loose else 0.0)
        margins[d] = (at, goal / goal.sum())
    for _ in range(rounds):
        for d in DIMENSIONS:
            at, goal = margins[d]
            have = np.bincount(at, mass, len(goal))
            mass = mass * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[at]
    return mass


def calibrate(tokens: np.ndarray, mass: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * mass / tokens) whose expected tokens are ``budget`` of all; c is found exactly."""
    ratio = mass / tokens
    order = np.argsort(-ratio, kind="stable")
    full = np.concatenate([[0.0], np.cumsum(tokens[order])])
    open_mass = np.concatenate([np.cumsum(mass[order][::-1])[::-1], [0.0]])
    goal = budget * full[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        c = (goal - full[:-1]) / open_mass[:-1]
        fits = c * ratio[order] <= 1
    if not fits.any():
        return np.ones(len(tokens))
    return np.minimum(1.0, c[int(fits.argmax())] * ratio)


def raked_table(cells: DataFrame, targets: dict[str, dict[str, float]], scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (DIMENSIONS, tokens > 0) with their ``mass`` as by ``rake``, without holding them in one place.

    A mass is the tokens times one factor per dimension, and each step replaces the factors of one dimension: a grouped
    sum with map-side combination. Only the table of factors, one row per stratum, is written.
    """
    spark = cells.sparkSession
    goals, factors = {}, {}
    for d in DIMENSIONS:
        listed = spark.createDataFrame([(k, float(v)) for k, v in targets.get(d, {}).items()], f"{d} string, given double")
        share = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(POWER[d])).alias("share"))
        share = scratch.store(share.join(listed, d, "left"))
        given, loose = share.agg(F.sum("given"), F.sum(F.when(F.col("given").isNull(), F.col("share")))).first()
        rest = max(0.0, 1 - (given or 0.0))
        whole = (given or 0.0) + (rest if loose else 0.0)
        goal = F.coalesce("given", F.lit(rest / loose if loose else 0.0) * F.col("share")) / F.lit(whole)
        goals[d] = share.select(d, goal.alias("goal"))

    def massed(dimensions: list[str]) -> DataFrame:
        out, mass = cells, F.col("tokens").cast("double")
        for d in dimensions:
            out, mass = out.join(factors[d], d), mass * F.col(f"{d}_factor")
        return out.withColumn("mass", mass)

    for _ in range(rounds):
        for d in DIMENSIONS:
            have = massed([o for o in factors if o != d]).groupBy(d).agg(F.sum("mass").alias("have"))
            factor = F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0)
            new = scratch.store(have.join(goals[d], d).select(d, factor.alias(f"{d}_factor")))
            if d in factors:
                scratch.drop(factors[d])
            factors[d] = new
    return scratch.store(massed(DIMENSIONS).select(*DIMENSIONS, "tokens", "mass"))


def calibrated_table(cells: DataFrame, budget: float) -> DataFrame:
    """``cells`` (DIMENSIONS, tokens, mass) with weight and probability, as by ``calibrate``.

    The constant c is raised until no more cell reaches probability 1. Each step is one sum over the cells, and the full
    cells only grow in number, so the last step is exact.
    """
    tokens, mass = F.col("tokens").cast("double"), F.col("mass")
    total, c = cells.agg(F.sum(tokens)).first()[0], 0.0
    n_full = None
    while True:
        full = F.lit(c) * mass >= tokens
        count, spent, open_mass = cells.agg(F.count_if(full), F.sum(F.when(full, tokens)), F.sum(F.when(~full, mass))).first()
        if count == n_full:
            probability = F.least(F.lit(1.0), F.lit(c) * mass / tokens)
            break
        if not open_mass:
            probability = F.lit(1.0)
            break
        n_full, c = count, (budget * total - (spent or 0.0)) / open_mass
    return cells.select(*DIMENSIONS, (mass * F.lit(total) / tokens).alias("weight"), probability.alias("probability"))


def _strata(docs: DataFrame, topic: Column | None, *carry: Column) -> DataFrame:
    """doc_id, strata, n_tokens and the uniform number of each row, and ``carry``."""
    n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")
    text = F.coalesce("text", F.lit(""))
    more = [topic.alias("topic")] if topic is not None else []
    d = docs.select("doc_id", "source", "lang", text.alias("text"), n.alias("n_tokens"), *more, *carry)
    if topic is None:
        d = d.withColumn("topic", default_topic(F.col("text"), F.col("n_tokens")))
    strata = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in DIMENSIONS]
    return d.select("doc_id", *strata, "n_tokens", uniform(F.col("doc_id"), F.col("text")).alias("u"), *[c for c in d.columns if c == "row"])


def _probabilities(d: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float, driver_cells: int) -> DataFrame:
    """Weight and probability of each cell with tokens; broadcast if there are at most ``driver_cells``."""
    spark = d.sparkSession
    with Scratch(spark) as scratch:
        table = scratch.store(d.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"))
        n = table.count()
        if n == 0:
            return F.broadcast(spark.createDataFrame([], ", ".join(f"{c} string" for c in DIMENSIONS) + ", weight double, probability double"))
        if n > driver_cells:
            return released(calibrated_table(raked_table(table, targets or {}, scratch), budget))
        cells = table.orderBy(*DIMENSIONS).toPandas()
    mass = rake(cells, targets or {})
    tokens = cells["tokens"].to_numpy(float)
    cells["weight"] = mass * tokens.sum() / tokens
    cells["probability"] = calibrate(tokens, mass, budget)
    return F.broadcast(spark.createDataFrame(cells[[*DIMENSIONS, "weight", "probability"]]))


def _decided(d: DataFrame, table: DataFrame) -> DataFrame:
    d = d.join(table, DIMENSIONS, "left")
    d = d.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "probability": F.coalesce("probability", F.lit(1.0))})
    return d.withColumn("kept", F.col("u") < F.col("probability"))


def mix(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    topic: Column | None = None,
    budget: float = BUDGET,
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """Weight, inclusion probability and choice of every document.

    Returns doc_id, source, lang, topic (the strata), n_tokens (long), weight (raked over actual mass), probability, kept.
    A document is kept if a uniform number made from its id is below its probability; without an id the number is made
    from the text. Null dimensions form a stratum of their own. Documents without words weigh 1, cost nothing and are
    kept. Repeated rows stay; an empty table gives an empty result. ``topic`` may be any expression over the columns of
    ``docs``; other columns are not read. ``driver_cells`` only decides where the fit runs.
    """
    d = stored(_strata(docs, topic))
    out = _decided(d, _probabilities(d, targets, budget, driver_cells))
    return out.select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", "kept")


def drawn(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, budget: float = BUDGET
) -> DataFrame:
    """The rows of ``docs``, all their columns, that ``mix`` keeps; each row is drawn by its own stratum."""
    table = _probabilities(_strata(docs, topic), targets, budget, DRIVER_CELLS)
    return _decided(_strata(docs, topic, F.struct(*docs.columns).alias("row")), table).filter("kept").select("row.*")


def oracle(documents: str = "documents", rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """The same rows in DuckDB: the rounds of the fit are unrolled."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    topic = "CASE WHEN n_tokens = 0 THEN 'empty' " + " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN '{n}'" for n, p in TOPICS)
    topic += " WHEN n_tokens < 50 THEN 'note' WHEN n_tokens < 400 THEN 'article' ELSE 'long' END"
    out = f"""WITH w AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
    coalesce(text, '') AS t, CAST(len([x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> '']) AS BIGINT) AS n_tokens
  FROM {documents}),
d AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, n_tokens,
    md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), 'text-' || md5(t))) AS h FROM w),
c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens,
    sum(n_tokens)::DOUBLE / (SELECT sum(n_tokens) FROM d) AS m FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"""
    for dim in DIMENSIONS:
        out += f""",
g_{dim} AS MATERIALIZED (SELECT {dim}, pow(sum(tokens), {POWER[dim]}) / sum(pow(sum(tokens), {POWER[dim]})) OVER () AS goal FROM c0 GROUP BY {dim})"""
    k = 0
    for _ in range(rounds):
        for dim in DIMENSIONS:
            out += f""",
c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, m * goal / sum(m) OVER (PARTITION BY c.{dim}) AS m
  FROM c{k} c JOIN g_{dim} g ON c.{dim} = g.{dim})"""
            k += 1
    return (
        out
        + f""",
r AS (SELECT *, m / tokens AS ratio, coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_tokens,
    sum(m) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_mass, sum(tokens) OVER () AS total
  FROM c{k} WINDOW o AS (ORDER BY m / tokens DESC, source, lang, topic)),
f AS (SELECT *, ({budget} * total - full_tokens) / open_mass AS c FROM r),
s AS (SELECT arg_max(c, ratio) AS c FROM f WHERE c * ratio <= 1),
p AS (SELECT source, lang, topic, m * total / tokens AS weight, coalesce(least(1, s.c * ratio), 1) AS probability FROM f, s)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(coalesce(weight, 1), 6) AS weight,
  round(coalesce(probability, 1), 6) AS probability,
  CAST('0x' || substr(h, 1, 13) AS BIGINT) / {float(16**13)} < coalesce(probability, 1) AS kept
FROM d LEFT JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""
    )
