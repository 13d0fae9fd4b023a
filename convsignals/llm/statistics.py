"""Statistics of whole texts, as built-in column expressions only.

Words are the runs of ``[^\\x20\\x09-\\x0D]``; a null text has none. Every count covers the whole text.
Windows of five words are compared by a 64-bit hash inside their own document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [
    "words",
    "word_length",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "shout_share",
    "line_words",
]


def _without(text, chars: str):
    """Number of characters of ``text`` that the class ``chars`` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, the counts of BASE (long) and the features of SHARES (double).

    Other columns of ``docs`` are not read, so their names cannot clash; one column, ``carry``, may come along. A null, empty or blank text has zero counts
    and zero features. Repeated rows and null ids stay as they are; an empty table gives an empty table. Nothing is
    shuffled, and a very long text costs n log n of its words at most.
    """
    more = [carry] if carry else []
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    d = d.select(
        "doc_id",
        *more,
        F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "").alias("ws"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("ls"),
        _without(F.col("text"), "[#*$%&|<>]").cast("long").alias("n_symbols"),
        _without(F.col("text"), "[A-Z]{2,}").cast("double").alias("n_shout"),
    )
    d = d.select(
        "doc_id",
        *more,
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_shout",
        F.size("ls").alias("n_lines"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.transform("ws", lambda w: F.xxhash64(w)).alias("h1"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size("h1") - WINDOW), lambda i: F.xxhash64(*[F.get("h1", i + k) for k in range(WINDOW)])
    )
    d = d.withColumn("hs", F.when(F.size("h1") >= WINDOW, windows).otherwise(F.array().cast("array<long>"))).drop("h1")
    d = d.withColumn("some_repeat", F.size(F.array_distinct("hs")) < F.size("hs"))
    # Only texts with a repeated window sort: neighbours in (hash, place) order with one hash are repeats, and the words
    # they cover are the union of [p, p + WINDOW) over the repeated places p.
    keyed = F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    d = d.withColumn("keyed", F.when(F.col("some_repeat"), keyed))
    twice = F.transform(
        "keyed",
        lambda x, i: F.when((x["h"] == F.get("keyed", i - 1)["h"]) | (x["h"] == F.get("keyed", i + 1)["h"]), x["p"]),
    )
    d = d.withColumn("ps", F.sort_array(F.filter(twice, lambda p: p.isNotNull())))
    gaps = F.transform(
        "ps", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("ps", i + 1) - p, F.lit(WINDOW))).cast("long")
    )
    d = d.withColumn(
        "n_repeat_words",
        F.when(F.col("some_repeat"), F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(
            F.lit(0).cast("long")
        ),
    )

    def share(a, b):
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(0.0)

    return d.select(
        "doc_id",
        *more,
        *BASE,
        F.col("n_words").cast("double").alias("words"),
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_shout", "word_chars").alias("shout_share"),
        share("n_words", "n_lines").alias("line_words"),
    )
