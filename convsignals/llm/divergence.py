"""How far the word use of sources lies apart, from count-level bitmaps.

Terms that a language keeps are numbered; for each (group, count) a bitset holds the numbers of the terms that the group
uses just so often. A term's share depends on its count alone, so the summed divergence of two groups needs no more than the
number of terms in each joint cell (count here, count there): the AND of two bitsets, counted. Terms that a group lacks are the
complement, whose cells follow from the others by subtraction. Bitsets are cut into words of 64 terms and only words that
hold a bit are stored; terms of like frequency share a word, so that few counts occur in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convsignals.llm.tables import released
from convsignals.llm.tokens import byte_table, edges, fold, hash_filter, hash_order, passes, strings, text_partitions, token_chunks

#: A term is kept if so many documents of its language hold it.
LEAST_DOCUMENTS = 10
#: Terms listed per group.
LISTED = 10
SCALE = 1_000_000_000
#: Terms numbered together, sources compared together.
NUMBERED, SOURCES = 4096, 32
_TERMS = byte_table(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))


def _coded(docs: DataFrame) -> DataFrame:
    """(text, lang, grp): a null language or source is ''; both are hashed for the way through Python."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    return docs.select("text", F.xxhash64(lang).alias("lang"), F.xxhash64(lang, source).alias("grp"))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, grp, n, docs) of each chunk of texts; the hash of a term depends on its language."""
    for b in batches:
        b = b.take(pa.array(np.argsort(b.column(2).to_numpy(), kind="stable")))
        langs, groups = b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
        for lo, hi, words, _ in token_chunks(b.column(0), _TERMS):
            owner = words.owner
            h = fold(words.hashes, langs[lo:hi][owner])
            # Texts lie by group, so the occurrences of a term lie by group and text.
            order = hash_order(h)
            h, owner = h[order], owner[order]
            group = groups[lo:hi][owner]
            cell = np.flatnonzero(edges(h, group))
            new_text = edges(h, owner)
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.array(h[cell].view(np.int64)),
                    "grp": pa.array(group[cell]),
                    "n": pa.array(np.diff(np.append(cell, len(h)))),
                    "docs": pa.array(np.add.reduceat(new_text, cell, dtype=np.int64) if len(cell) else np.zeros(0, np.int64)),
                }
            )


def _keep_terms(least: int):
    """Sums of the cells of a partition that holds all cells of its terms; only terms of enough documents stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if not parts:
            return
        term, group, n, docs = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((group, term))
        term, group, n, docs = (a[order] for a in (term, group, n, docs))
        first = np.flatnonzero(edges(term))
        size = np.diff(np.append(first, len(term)))
        if not len(first):
            return
        stay = np.repeat(np.add.reduceat(docs, first) >= least, size)
        total = np.repeat(np.add.reduceat(n, first), size)[stay]
        term, group, n = term[stay], group[stay], n[stay]
        cell = np.flatnonzero(edges(term, group))
        n = np.add.reduceat(n, cell) if len(cell) else n
        yield pa.RecordBatch.from_pydict({"term": pa.array(term[cell]), "grp": pa.array(group[cell]), "n": pa.array(n), "total": pa.array(total[cell])})

    return run


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(term, grp, n, total): occurrences of kept terms in each group that has them, and in the language."""
    cells = _coded(docs).mapInArrow(_count_terms, "term long, grp long, n long, docs long")
    return cells.repartition(text_partitions(docs), "term").mapInArrow(_keep_terms(least), "term long, grp long, n long, total long")


def numbered(terms: DataFrame) -> DataFrame:
    """(term, chunk, word, bit): a place for each kept term (term, lang, total); terms of like frequency are neighbours.

    Numbers are dealt inside (language, power of two, part), where parts hold about NUMBERED terms, so no task numbers a language.
    """
    terms = terms.withColumn("level", F.floor(F.log2("total")).cast("int"))
    parts = terms.groupBy("lang", "level").agg(F.ceil(F.count("*") / NUMBERED).alias("parts"))
    dealt = terms.join(parts, ["lang", "level"]).withColumn("part", F.pmod(F.xxhash64("term"), "parts"))
    inside = Window.partitionBy("lang", "level", "part").orderBy("total", "term")
    dealt = dealt.withColumn("rn", F.row_number().over(inside) - 1)
    chunk = F.concat_ws(":", "level", "part")
    return dealt.select("term", chunk.alias("chunk"), F.expr("cast(rn div 64 as long)").alias("word"), F.expr("cast(rn % 64 as int)").alias("bit"))


def count_bitmaps(kept: DataFrame, terms: DataFrame) -> DataFrame:
    """(grp, n, chunk, word, bits): the terms of each word that the group uses just n times."""
    placed = kept.join(numbered(terms), "term")
    return placed.groupBy("grp", "n", "chunk", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def _share(count: str, total: str) -> F.Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * v)) in whole numbers."""
    top = f"cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))"
    return F.expr(f"case when v > 0 then 1 + ({top}) div cast({total} + 2 * v as decimal(20,0)) else 1 end")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(grp, lang, source, g, total, lang_total, v, p0): every group with its number inside the language."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*named).distinct().withColumn("grp", F.xxhash64("lang", "source"))
    mass = kept.groupBy("grp").agg(F.sum("n").alias("total"))
    # A term is counted once, with the least of its groups.
    once = kept.groupBy("term").agg(F.min("grp").alias("grp"), F.first("total").alias("total"))
    langs = once.groupBy("grp").agg(F.sum("total").alias("lang_total"), F.count("*").alias("v"))
    own = groups.join(mass, "grp", "left").join(langs, "grp", "left").fillna(0, ["total", "lang_total", "v"])
    whole = Window.partitionBy("lang")
    # A language's sources are few beside its pairs of sources, which are the result.
    out = own.withColumns({c: F.sum(c).over(whole) for c in ("lang_total", "v")})
    out = out.withColumn("g", (F.row_number().over(whole.orderBy("source")) - 1).cast("long"))
    return out.withColumn("p0", _share("0", "total"))


def _parted(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_task(size: int):
    """Divergence sums of the pairs of two blocks of ``size`` groups over the words of one chunk (or, chunk null, over count levels)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, left, right, chunk = (k.as_py() for k in key)
        g, p, p0, bits, word, v = (table.column(c).to_numpy() for c in ("g", "p", "p0", "bits", "word", "v"))
        block = g // size
        acc = np.zeros((size, size), np.int64)
        if chunk is None:
            zero = np.zeros((2, size), np.int64)
            for side, mine in ((0, left), (1, right)):
                zero[side, g[block == mine] % size] = p0[block == mine]
            base = _parted(zero[0][:, None], np.maximum(zero[1], 1)[None, :]) * int(v[0])
            acc += base
            # word holds the number of terms at this count; what both have is set right by the joint cells.
            for k in np.flatnonzero(block == left):
                row = _parted(p[k], np.maximum(zero[1], 1)) - _parted(p0[k], np.maximum(zero[1], 1))
                acc[g[k] % size] += word[k] * row
            for k in np.flatnonzero(block == right):
                col = _parted(np.maximum(zero[0], 1), p[k]) - _parted(np.maximum(zero[0], 1), p0[k])
                acc[:, g[k] % size] += word[k] * col
            live = (zero[0] > 0)[:, None] & (zero[1] > 0)[None, :]
            x, y = np.nonzero(live)
        else:
            order = np.argsort(word, kind="stable")
            g, p, p0, bits, word, block = (a[order] for a in (g, p, p0, bits.view(np.uint64), word, block))
            edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
            for a, z in zip(edge, edge[1:]):
                i = a + np.flatnonzero(block[a:z] == left)
                j = a + np.flatnonzero(block[a:z] == right)
                joint = np.bitwise_count(bits[i][:, None] & bits[j][None, :])
                at, to = np.nonzero(joint)
                n, k, m = joint[at, to].astype(np.int64), i[at], j[to]
                value = _parted(p[k], p[m]) - _parted(p[k], p0[m]) - _parted(p0[k], p[m]) + _parted(p0[k], p0[m])
                np.add.at(acc, (g[k] % size, g[m] % size), n * value)
            x, y = np.nonzero(acc)
        one, two = left * size + x, right * size + y
        use = one < two
        return pa.table({"lang": pa.array([lang] * int(use.sum()), pa.string()), "g": one[use], "h": two[use], "value": acc[x, y][use]})

    return run


def pair_divergence(bitmaps: DataFrame, groups: DataFrame, sources: int = SOURCES) -> DataFrame:
    """(lang, g, h, value) for every pair g < h of groups of a language."""
    shared = groups.select("grp", "lang", "g", "total", "v", "p0")
    cells = bitmaps.join(shared, "grp").withColumn("p", _share("n", "total"))
    levels = cells.groupBy("lang", "g", "p", "p0", "v").agg(F.sum(F.bit_count("bits")).cast("long").alias("word"))
    lone = groups.select("lang", "g", F.col("p0").alias("p"), "p0", "v", F.lit(0).cast("long").alias("word"))
    none = [F.lit(0).cast("long").alias("bits"), F.lit(None).cast("string").alias("chunk")]
    columns = ["lang", "g", "p", "p0", "v", "word", "bits", "chunk"]
    rows = cells.select(*columns).union(levels.union(lone).select("*", *none))
    blocks = groups.groupBy("lang").agg(F.expr(f"max(g) div {sources}").alias("last"))
    rows = rows.join(blocks, "lang").withColumn("mine", F.expr(f"g div {sources}"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    rows = rows.withColumns({"left": F.least("mine", "with"), "right": F.greatest("mine", "with")})
    rows = rows.select("lang", "left", "right", "chunk", "g", "p", "p0", "bits", "word", "v")
    sums = rows.groupBy("lang", "left", "right", "chunk").applyInArrow(_pair_task(sources), "lang string, g long, h long, value long")
    return sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, listed: int = LISTED, sources: int = SOURCES) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that mark each source against its language.

    Returns lang, source, part, item, value (long), rank (int). Part ``pair``: item is each other source of the language,
    value the sum of f over all kept terms; all ranks. Part ``term``: item is a kept term that the group uses more than its
    language, value its f; the first ``listed``. Terms are runs of ASCII letters (A-Z folded) and characters beyond ASCII,
    kept if at least ``least`` documents of the language hold them; p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)),
    f = floor((p - q)^2 / (p + q)). Null texts, languages and sources count as ''. A group without terms takes part with
    counts of zero; a language without kept terms has values of 0; a language with one source has no pairs. Repeated rows
    are documents of their own. An empty table gives an empty result; other columns are not read. All arithmetic is exact;
    terms are told apart by a 64-bit hash.
    """
    docs = docs.select("text", "lang", "source")
    kept = released(kept_terms(docs, least))
    groups = released(group_table(docs, kept))
    owner = groups.select("grp", "lang")
    terms = kept.groupBy("term").agg(F.min("grp").alias("grp"), F.first("total").alias("total")).join(owner, "grp").select("term", "lang", "total")
    pairs = released(pair_divergence(released(count_bitmaps(kept, terms)), groups, sources))
    both = pairs.union(pairs.select("lang", F.col("h"), F.col("g"), "value"))
    name = groups.select("lang", "g", "source")
    other = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    pair = both.join(name, ["lang", "g"]).join(other, ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = [F.desc("value"), F.asc("item")]
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return pair.union(marking_terms(docs, kept, groups, listed))


def marking_terms(docs: DataFrame, kept: DataFrame, groups: DataFrame, listed: int = LISTED) -> DataFrame:
    """The ``listed`` terms of each group that add most to its divergence from the language, among those it uses more."""
    told = kept.join(groups.select("grp", "lang", "source", F.col("total").alias("mass"), "lang_total", "v"), "grp")
    told = told.withColumns({"p": _share("n", "mass"), "q": _share("total", "lang_total")}).filter("p > q")
    told = told.select("lang", "source", "term", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    # All terms that tie with the last place stay until their strings are known.
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    told = released(told.withColumn("place", F.rank().over(best)).filter(F.col("place") <= listed).drop("place"))
    wanted = docs.sparkSession.sparkContext.broadcast(hash_filter(told.select("term").distinct(), "term"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1).to_numpy().view(np.uint64)
            for lo, hi, words, _ in token_chunks(b.column(0), _TERMS):
                h = fold(words.hashes, langs[lo:hi][words.owner])
                at = np.flatnonzero(passes(wanted.value, h))
                h, first = np.unique(h[at], return_index=True)
                yield pa.RecordBatch.from_pydict({"term": pa.array(h.view(np.int64)), "item": strings(words, at[first]).cast(pa.string())})

    spelled = _coded(docs).mapInArrow(spell, "term long, item string").join(told.select("term").distinct(), "term", "left_semi")
    spelled = spelled.groupBy("term").agg(F.min("item").alias("item"))
    term = told.join(spelled, "term").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return term.withColumn("rank", place).filter(F.col("rank") <= listed)


def oracle(least: int = LEAST_DOCUMENTS, listed: int = LISTED) -> str:
    share = f"1 + ({SCALE}::HUGEINT * ({{n}} + 2)) // ({{total}} + 2 * v)"
    apart = "((p - q) * (p - q)) // (p + q)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
held AS (
  SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {least}
), langs AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS lang_total FROM held GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN held USING (lang, term) GROUP BY lang, source, term),
mass AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counts GROUP BY lang, source),
groups AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(lang_total, 0) AS lang_total, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN mass USING (lang, source) LEFT JOIN langs USING (lang)
), shares AS (
  SELECT g.lang, g.source, h.term, coalesce(c.n, 0) AS n, {share.format(n="coalesce(c.n, 0)", total="g.total")} AS p,
         {share.format(n="h.total", total="g.lang_total")} AS q
  FROM groups g JOIN held h USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = h.term
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), marked AS (SELECT lang, source, 'term' AS part, term AS item, {apart} AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM marked)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {listed}
"""
