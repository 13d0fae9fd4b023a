"""Benchmark decontamination by templates: texts and benchmark items meet after their parameters are replaced.

Numbers, units after numbers and capitalised words inside a sentence become typed placeholders, so a question with other
values has the same template windows. Windows are hash-joined; the slots of matched windows must then map each value of
the item to one value of the text. Beside the templates, a run of verbatim words of any item counts (``verbatim_leaks``).
Built-in functions only, in expressions that another SQL engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convsignals.session import stored

WIDTH = 8
#: Words of a window that must not be placeholders.
LEAST_FIXED = 4
#: Share of an item's windows that a text must hold, in percent.
SHARE = 50
#: Consecutive verbatim words of an item that make a leak (all of a shorter item); letters, in scripts without blanks.
RUN, RUN_LETTERS = 13, 30
#: Benchmark windows up to this number are broadcast (their count is checked); more are joined by shuffle.
BROADCAST_WINDOWS = 500_000

UNITS = "km|kg|cm|mm|ml|mg|lb|lbs|oz|ft|mph|kmh|m|g|l|s|h|min|hours|hour|days|day|weeks|week|months|month|years|year|minutes|minute|seconds|second|miles|mile|meters|metres|meter|metre|feet|inches|inch|pounds|dollars|euros|cents|percent|degrees"
NUMBER = "(^|[^\\p{L}\\p{N}])[+-]?[$€£]?[0-9][0-9.,]*%?"
UNIT = f"<num>( ?)(?:{UNITS})([^\\p{{L}}\\p{{N}}]|$)"
NAME = "([\\p{Ll}\\p{N},;:>] )(\\p{Lu}[\\p{L}']*)"
MORE_NAME = "(<name> )(\\p{Lu}[\\p{L}']*)"
MARKS = "[^\\p{L}\\p{N}<>\\x20\\x09-\\x0D]+"
BLANKS = "[\\x20\\x09-\\x0D]+"
SLOT = "<(num|unit|name)>"
UNSPACED = "([\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}])"


def template(text: Column) -> Column:
    """The text with placeholders, lower case, without punctuation; as many words as ``plain`` has."""
    t = F.regexp_replace(text, NUMBER, "$1<num>")
    t = F.regexp_replace(t, UNIT, "<num>$1<unit>$2")
    # Nothing to replace without a digit or a placeholder.
    t = F.when(text.rlike("[0-9]|<num>"), t).otherwise(text)
    t = F.regexp_replace(t, NAME, "$1<name>")
    t = F.regexp_replace(t, MORE_NAME, "$1<name>")
    return F.regexp_replace(F.lower(t), MARKS, "")


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), MARKS, "")


def spaced(text: Column) -> Column:
    """``plain`` with blanks around letters of scripts that are written without them, all of which lie above U+0E00."""
    return F.when(text.rlike("[\\x{E00}-\\x{10FFFF}]"), F.regexp_replace(plain(text), UNSPACED, " $1 ")).otherwise(plain(text))


def _words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, BLANKS), ""), lambda w: F.xxhash64(w))


def holders(docs: DataFrame, windows: DataFrame, widths: list[int], blocks: DataFrame, runs: list[int]) -> DataFrame:
    """Rows of ``docs`` whose id has a text with some template window or verbatim block of an item.

    The one pass over all texts: each is normalised once for both paths, and only (kind, hash) pairs leave the row. What the
    windows hold, and what lies around the blocks, is worked out for these rows alone.
    """
    marks = windows.select(F.col("width").alias("kind"), "h").union(blocks.select((-F.col("run")).alias("kind"), "h")).distinct()
    marks = stored(marks)
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id").alias("id"), _words(template(text)).alias("t"), _words(spaced(text)).alias("p"))

    def key(kind: int, h: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), h.alias("h"))

    def window(width: int) -> Column:
        places = F.sequence(F.lit(0), F.size("t") - width)
        return F.when(F.size("t") >= width, F.transform(places, lambda i: key(width, F.xxhash64(*[F.get("t", i + k) for k in range(width)]))))

    def block(r: int) -> Column:
        b = (r + 1) // 2
        places = F.sequence(F.lit(0), F.size("p") - b, F.lit(b))
        return F.when(F.size("p") >= r, F.transform(places, lambda i: key(-r, F.xxhash64(F.slice("p", i + 1, b)))))

    none = F.array().cast("array<struct<kind:int,h:bigint>>")
    keys = F.concat(*[F.coalesce(window(w), none) for w in widths], *[F.coalesce(block(r), none) for r in runs])
    found = d.select("id", F.explode(keys).alias("k")).select("id", "k.*")
    found = found.join(F.broadcast(marks) if marks.count() <= BROADCAST_WINDOWS else marks, ["kind", "h"], "left_semi")
    ids = stored(found.select("id").distinct())
    return stored(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"))


def template_windows(texts: DataFrame, id_col: str, widths: list[int]) -> DataFrame:
    """(id, width, pos, h, slots) of the template windows of each text: the hash and the values behind its placeholders.

    Windows with fewer than LEAST_FIXED fixed words (all but none for shorter ones) say too little and are left out.
    """
    d = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.select("id", "text", template(F.col("text")).alias("template"))
    d = d.withColumn("slotted", F.col("template").rlike(SLOT))
    d = d.select(
        "id",
        "slotted",
        F.array_remove(F.split("template", BLANKS), "").alias("t"),
        F.when(F.col("slotted"), F.array_remove(F.split(plain(F.col("text")), BLANKS), "")).alias("o"),
    )
    d = d.withColumn("hs", F.transform("t", lambda w: F.xxhash64(w)))
    d = d.withColumn("v", F.when(F.col("slotted"), F.transform("t", lambda w, i: F.when(w.rlike(SLOT), F.get("o", i)))))

    def windows(width: int) -> Column:
        def one(i: Column) -> Column:
            values = F.filter(F.slice("v", i + 1, width), lambda x: x.isNotNull())
            return F.struct(
                F.lit(width).alias("width"),
                i.alias("pos"),
                F.xxhash64(*[F.get("hs", i + k) for k in range(width)]).alias("h"),
                F.when(F.col("slotted"), values).alias("slots"),
            )

        places = F.sequence(F.lit(0), F.size("hs") - width)
        return F.when(F.size("hs") >= width, F.transform(places, one))

    out = None
    for width in widths:
        rows = d.select("id", F.explode(windows(width)).alias("w")).select("id", "w.*")
        rows = rows.filter(F.coalesce(F.size("slots"), F.lit(0)) <= max(0, width - LEAST_FIXED))
        out = rows if out is None else out.union(rows)
    return out


def _run_words(rows: DataFrame, id_col: str) -> DataFrame:
    t = spaced(F.coalesce("text", F.lit("")))
    return rows.select(F.col(id_col).alias("id"), F.col("text").rlike(UNSPACED).alias("letters"), _words(t).alias("hs"))


def _run_blocks(r: int, every: bool) -> Column:
    b = (r + 1) // 2
    around = F.array_repeat(F.lit(None).cast("long"), r - b)
    padded = F.concat(around, F.col("hs"), around)

    def one(i: Column) -> Column:
        return F.struct(
            F.lit(r).alias("run"), i.alias("pos"), F.xxhash64(F.slice("hs", i + 1, b)).alias("h"), F.slice(padded, i + 1, 2 * r - b).alias("near")
        )

    places = F.sequence(F.lit(0), F.size("hs") - b, F.lit(1 if every else b))
    return F.when(F.size("hs") >= r, F.transform(places, one)).otherwise(F.array())


def run_items(benchmark: DataFrame) -> tuple[list[int], DataFrame]:
    """Lengths of the runs that are asked for, and the blocks of the items at all places (stored)."""
    items = _run_words(benchmark.filter("item_id is not null"), "item_id").filter(F.size("hs") > 0).distinct()
    most = F.when(F.col("letters"), F.lit(RUN_LETTERS)).otherwise(F.lit(RUN))
    items = items.select("id", "hs", F.least(F.size("hs"), most).alias("run"), F.xxhash64("hs").alias("version"))
    runs = sorted(r["run"] for r in items.select("run").distinct().collect()) or [RUN]
    sides = [
        items.filter(F.col("run") == r).select("id", "version", (F.size("hs") - r + 1).alias("n_windows"), F.explode(_run_blocks(r, True)).alias("w"))
        for r in runs
    ]
    side = sides[0]
    for more in sides[1:]:
        side = side.union(more)
    return runs, stored(
        side.select(F.col("id").alias("item_id"), "version", "n_windows", F.col("w.run").alias("run"), F.col("w.pos").alias("item_pos"),
                    F.col("w.h").alias("h"), F.col("w.near").alias("item_near"))
    )


def verbatim_leaks(docs: DataFrame, benchmark: DataFrame, items: tuple[list[int], DataFrame] | None = None) -> DataFrame:
    """Texts that hold RUN consecutive words of an item, or all words of a shorter one, case and punctuation aside.

    The columns of ``leaks``; windows are runs. Letters of scripts without blanks are words; an item with such letters
    needs RUN_LETTERS of them. Each run of r words of a text holds a block of (r + 1) // 2 words that starts at a
    multiple of that width: only these blocks of the text meet the blocks of the items at all places, with the words
    around them to tell how far the run goes.
    """

    runs, side = items or run_items(benchmark)
    found = _run_words(docs, "doc_id").select("id", F.explode(F.concat(*[_run_blocks(r, False) for r in runs])).alias("w")).select("id", "w.*")
    found = found.join(F.broadcast(side) if side.count() <= BROADCAST_WINDOWS else side, ["run", "h"])
    width = F.expr("int((run + 1) div 2)")
    same = F.zip_with("near", "item_near", lambda x, y: F.coalesce(x == y, F.lit(False)))

    def length(flags: Column) -> Column:
        """Flags that hold up to the last one without a break."""
        return F.aggregate(flags, F.lit(0), lambda n, x: F.when(x, n + 1).otherwise(F.lit(0)))

    beside = F.col("run") - width
    found = found.withColumn("same", same)
    found = found.withColumn("first", F.col("item_pos") - length(F.slice("same", F.lit(1), beside)))
    found = found.withColumn("last", F.col("item_pos") + width + length(F.reverse(F.slice("same", beside + width + 1, beside))) - F.col("run"))
    found = found.filter("last >= first").filter(F.forall(F.slice("same", beside + 1, width), lambda x: x))
    found = found.select(F.col("id").alias("doc_id"), "item_id", "version", "n_windows", F.explode(F.sequence("first", "last")).alias("start"))
    found = found.groupBy("doc_id", "item_id", "version", "n_windows").agg(F.countDistinct("start").alias("n_matched"))
    best = F.max_by(F.struct("n_matched", "n_windows"), F.struct("n_matched", "version"))
    found = found.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return found.select(
        "doc_id", "item_id", F.col("b.n_matched").cast("long").alias("n_matched"), F.col("b.n_windows").cast("long").alias("n_windows"),
        F.lit(0).cast("long").alias("n_changed"), F.lit(True).alias("verbatim"),
    )


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """Texts that hold a benchmark item: the rows of ``template_leaks``, and those of ``verbatim_leaks`` for other pairs."""
    widths, windows = template_items(benchmark, width)
    runs, blocks = run_items(benchmark)
    some = holders(docs.select("doc_id", "text"), windows, widths, blocks, runs)
    both = template_leaks(some, benchmark, width, share, (widths, windows)).withColumn("path", F.lit(0))
    both = both.union(verbatim_leaks(some, benchmark, (runs, blocks)).withColumn("path", F.lit(1)))
    values = ["n_matched", "n_windows", "n_changed", "verbatim"]
    first = both.groupBy("doc_id", "item_id").agg(F.min_by(F.struct(*values), "path").alias("row"))
    return first.select("doc_id", "item_id", *[f"row.{c}" for c in values])


def template_items(benchmark: DataFrame, width: int = WIDTH) -> tuple[list[int], DataFrame]:
    """Widths of the windows that are asked for, and the windows of the items (stored)."""
    lengths = benchmark.select(F.size(F.array_remove(F.split(template(F.coalesce("text", F.lit(""))), BLANKS), "")).alias("n"))
    short = sorted(r["n"] for r in lengths.filter((F.col("n") >= LEAST_FIXED) & (F.col("n") < width)).distinct().collect())
    items = template_windows(benchmark, "item_id", [*short, width])
    if short:
        items = items.join(
            template_windows(benchmark, "item_id", [width]).select("id").distinct().withColumn("long", F.lit(True)), "id", "left"
        ).filter((F.col("width") == width) | (F.col("long").isNull() & (F.col("pos") == 0)))
        full = benchmark.select(F.col("item_id").alias("id"), F.size(F.array_remove(F.split(template(F.coalesce("text", F.lit(""))), BLANKS), "")).alias("n")).distinct()
        items = items.join(full, "id").filter((F.col("width") == width) | (F.col("width") == F.col("n"))).drop("n", "long")
    return [*short, width], stored(
        items.select(F.col("id").alias("item_id"), "width", F.col("pos").alias("item_pos"), "h", F.col("slots").alias("item_slots")).distinct()
    )


def template_leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE, items: tuple[list[int], DataFrame] | None = None
) -> DataFrame:
    """Texts that hold a benchmark item, verbatim or with other parameters.

    One row per (doc_id, item_id): n_matched and n_windows (long; windows of the item found, and all), n_changed (long: item
    values that the text replaces) and verbatim (n_changed is 0). A pair counts if at least ``share`` percent of the windows
    match in places whose slots are consistent: within one alignment each value of the item stands for one value of the
    text. Items of LEAST_FIXED to ``width`` - 1 words are one window of their own length; items with fewer words, null or
    empty items and windows of placeholders match nothing. Null and empty texts match nothing. Repeated rows and equal ids
    are reported once; a null doc_id is reported as null. Empty tables give an empty result. Only doc_id, text and
    item_id are read.
    """
    widths, items = items or template_items(benchmark, width)
    totals = items.groupBy("item_id").agg(F.countDistinct("width", "item_pos").alias("n_windows"))
    found = template_windows(docs, "doc_id", widths)
    side = F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items
    found = found.join(side, ["width", "h"]).withColumn("at", F.col("pos") - F.col("item_pos"))
    pairs = F.transform(
        F.arrays_zip("item_slots", "slots"), lambda x: F.struct(x["item_slots"].alias("a"), x["slots"].alias("b"))
    )
    places = (
        found.withColumn("pairs", F.coalesce(pairs, F.array().cast("array<struct<a:string,b:string>>")))
        .groupBy(F.col("id").alias("doc_id"), "item_id", "at")
        .agg(F.collect_set("item_pos").alias("hits"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    )
    places = places.filter(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))))
    return (
        places.groupBy("doc_id", "item_id")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_matched"),
            F.max(F.size(F.filter("pairs", lambda p: p["a"] != p["b"]))).cast("long").alias("n_changed"),
        )
        .join(totals, "item_id")
        .filter(100 * F.col("n_matched") >= share * F.col("n_windows"))
        .select("doc_id", "item_id", "n_matched", "n_windows", "n_changed", (F.col("n_changed") == 0).alias("verbatim"))
    )


def _sql(text: str) -> str:
    """DuckDB's form of ``template``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"regexp_replace({text}, {q(NUMBER)}, {q(chr(92) + '1<num>')}, 'g')"
    t = f"regexp_replace({t}, {q(UNIT)}, {q('<num>' + chr(92) + '1<unit>' + chr(92) + '2')}, 'g')"
    for p in (NAME, MORE_NAME):
        t = f"regexp_replace({t}, {q(p)}, {q(chr(92) + '1<name>')}, 'g')"
    return f"regexp_replace(lower({t}), {q(MARKS)}, '', 'g')"


def oracle(width: int = WIDTH, share: int = SHARE) -> str:
    """The rows of ``template_leaks`` in DuckDB, for benchmarks whose items have at least ``width`` words."""
    blank, marks = f"'{BLANKS}'", "'" + MARKS + "'"

    def side(name: str, id_col: str) -> str:
        return f"""
{name}_t AS (SELECT {id_col} AS id,
    [x for x in regexp_split_to_array({_sql("coalesce(text, '')")}, {blank}) if x <> ''] AS t,
    [x for x in regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), {marks}, '', 'g'), {blank}) if x <> ''] AS o
  FROM {'documents' if name == 'd' else 'benchmark'}),
{name}_p AS (SELECT *, unnest(range(len(t) - {width - 1})) AS pos FROM {name}_t WHERE len(t) >= {width}),
{name}_s AS (SELECT id, pos, t[pos + 1 : pos + {width}] AS t, o[pos + 1 : pos + {width}] AS o FROM {name}_p),
{name}_w AS (SELECT id, pos, array_to_string(t, ' ') AS h,
    [o[k] for k in range(1, {width + 1}) if regexp_matches(t[k], '{SLOT}')] AS slots FROM {name}_s),
{name} AS (SELECT * FROM {name}_w WHERE len(slots) <= {width - LEAST_FIXED})"""

    return f"""WITH {side('d', 'doc_id')}, {side('b', 'item_id')},
totals AS (SELECT id, count(DISTINCT pos) AS n_windows FROM b GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, d.pos - b.pos AS place, b.pos AS item_pos, b.slots AS a, d.slots AS v
  FROM d JOIN b ON d.h = b.h),
pairs AS (SELECT DISTINCT doc_id, item_id, place, unnest(a) AS a, unnest(v) AS v FROM m),
wrong AS (SELECT doc_id, item_id, place FROM pairs GROUP BY ALL HAVING count(*) > count(DISTINCT a)),
changed AS (SELECT doc_id, item_id, max(n) AS n_changed FROM
  (SELECT doc_id, item_id, place, count(*) FILTER (WHERE a <> v) AS n FROM pairs
   WHERE (doc_id, item_id, place) NOT IN (SELECT (doc_id, item_id, place) FROM wrong) GROUP BY ALL) GROUP BY ALL),
good AS (SELECT doc_id, item_id, count(DISTINCT item_pos) AS n_matched FROM m
  WHERE (doc_id, item_id, place) NOT IN (SELECT (doc_id, item_id, place) FROM wrong) GROUP BY ALL)
SELECT good.doc_id, good.item_id, n_matched, n_windows, CAST(coalesce(n_changed, 0) AS BIGINT) AS n_changed,
  coalesce(n_changed, 0) = 0 AS verbatim
FROM good JOIN totals ON good.item_id = totals.id
  LEFT JOIN changed ON changed.doc_id = good.doc_id AND changed.item_id = good.item_id
WHERE 100 * n_matched >= {share} * n_windows"""
