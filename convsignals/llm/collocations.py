"""Collocations: phrases whose words occur together more often than apart, mined level by level.

A phrase of k words can be frequent only if both of its parts of k - 1 words are (Apriori), so each level scans the texts with
a filter of the level before and counts what passes: the filter loses no occurrence of a frequent phrase. A level of at
most TRIE candidates is put in a double-array trie, which is broadcast. A task moves the states of all its text positions through
the trie at once, one symbol after another, and bincounts the states that accept; counts are summed over the texts. A larger
level takes the counts of its scan, so the passes over the texts do not grow with the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convsignals.llm.hashing import Words
from convsignals.llm.tables import released
from convsignals.llm.tokens import byte_table, edges, fold, hash_filter, hash_order, passes, strings, text_partitions, token_chunks

#: Occurrences of a candidate, and of what it is made of.
LEAST = 10
#: Words of the longest phrase.
LONGEST = 3
#: A candidate goes if a longer one holds so many percent of its occurrences.
ABSORBED = 50
#: Phrases returned for a language.
TOP = 2000
#: Phrases in one trie, which is the most that is broadcast at a time; where there are more, their scan counts them.
TRIE = 500_000
#: Symbols that spell a word after the first.
DIGITS = 3
#: Phrases that a task gathers before it hands on their evidence.
GATHERED = 4_000_000
_BREAKS = [ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]
_WORDS = byte_table([0x20, 0x09, *_BREAKS])
_IS_BREAK = np.isin(np.arange(256), _BREAKS)


def _coded(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select("text", F.xxhash64(lang).alias("code"), lang.alias("lang"))


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Words, pa.RecordBatch, int, int]]:
    """(ids, goes on, words, batch, from, to): the language-bound hash of each word, and whether the next word is in its piece."""
    for b in batches:
        codes = b.column(1).to_numpy().view(np.uint64)
        for lo, hi, words, raw in token_chunks(b.column(0), _WORDS):
            owner = words.owner
            ids = fold(words.hashes, codes[lo:hi][owner])
            broken = np.concatenate([[0], np.cumsum(_IS_BREAK[raw])])
            goes = np.zeros(len(ids), bool)
            goes[:-1] = (owner[1:] == owner[:-1]) & (broken[words.starts[1:]] == broken[words.ends[:-1]])
            yield ids, goes, words, b, lo, hi


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, id, word, n): words with ``least`` occurrences in their language, and one row with a null id for all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, words, b, lo, hi in _positions(batches):
            order = hash_order(ids)
            first = np.flatnonzero(edges(ids[order]))
            at = order[first]
            lang = b.column(2).take(pa.array(lo + words.owner[at]))
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": lang,
                    "id": pa.array(ids[at].view(np.int64)),
                    "word": strings(words, at).cast(pa.string()),
                    "n": pa.array(np.diff(np.append(first, len(ids)))),
                }
            )

    found = _coded(docs).mapInArrow(run, "lang string, id long, word string, n long")
    sums = released(found.groupBy("lang", "id", "word").agg(F.sum("n").alias("n")))
    whole = sums.groupBy("lang").agg(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("word"), F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= least).unionByName(whole)


def _key(ids: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases given by their words."""
    h = ids[0]
    for x in ids[1:]:
        h = fold(h, x)
    return h


def frequent_phrases(docs: DataFrame, k: int, shorter: DataFrame, least: int = LEAST) -> DataFrame:
    """(w1 .. wk, a): phrases of ``k`` words with ``least`` occurrences and their number, given the frequent ones of k - 1 words.

    Both parts of k - 1 words pass a filter of fixed size first.
    """
    w = [f"w{i + 1}" for i in range(k)]
    parts = [f"w{i + 1}" for i in range(k - 1)]
    keys = _arrow_keys(shorter.select(*parts))
    shared = docs.sparkSession.sparkContext.broadcast(hash_filter(keys, "key"))

    def evidence(held):
        ids = [np.concatenate(c) for c in zip(*held)]
        order = hash_order(_key(ids))
        ids = [x[order] for x in ids]
        first = np.flatnonzero(edges(*ids))
        n = np.diff(np.append(first, len(order)))
        columns = {c: pa.array(x[first].view(np.int64)) for c, x in zip(w, ids)}
        return pa.RecordBatch.from_pydict(columns | {"seen": pa.array(n.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for ids, goes, *_ in _positions(batches):
            m = max(len(ids) - k + 1, 0)
            ok = np.ones(m, bool)
            for i in range(k - 1):
                ok &= goes[i : i + m]
            known = passes(shared.value, _key([ids[i : len(ids) - k + 2 + i] for i in range(k - 1)])) if m else ok
            ok &= known[:m] & known[1 : m + 1]
            at = np.flatnonzero(ok)
            held.append([ids[at + i] for i in range(k)])
            size += len(at)
            if size >= GATHERED:
                yield evidence(held)
                held, size = [], 0
        if size:
            yield evidence(held)

    schema = ", ".join(f"{c} long" for c in w)
    found = _coded(docs).mapInArrow(run, f"{schema}, seen int")
    dealt = found.repartition(text_partitions(docs), *w)

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if not rows:
            return
        *ids, n = (np.concatenate(c) for c in zip(*rows))
        order = hash_order(_key([x.view(np.uint64) for x in ids]))
        ids, n = [x[order] for x in ids], n[order].astype(np.int64)
        first = np.flatnonzero(edges(*ids))
        sums = np.add.reduceat(n, first) if len(first) else first
        stay = first[sums >= least]
        yield pa.RecordBatch.from_pydict({c: pa.array(x[stay]) for c, x in zip(w, ids)} | {"a": pa.array(sums[sums >= least])})

    out = released(dealt.mapInArrow(enough, f"{schema}, a long"))
    shared.unpersist()
    return out


def _arrow_keys(phrases: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array(_key([c.to_numpy().view(np.uint64) for c in b.columns]).view(np.int64))})

    return phrases.mapInArrow(run, "key long")


class Trie:
    """A double array over phrases of equal length: the slot of a child is the base of its parent plus the symbol.

    The first word of a phrase is its number among ``words`` and at once its slot; each further word is spelled in DIGITS
    symbols, of as few values as can tell the words apart. ``check`` names the parent of a slot; the base of a slot at the
    end of a phrase is the phrase's number.
    """

    def __init__(self, words: np.ndarray, base: np.ndarray, check: np.ndarray):
        self.words, self.base, self.check = words, base, check
        self.radix = next(r for r in range(2, 1 << 20) if r**DIGITS >= len(words))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where the trie has none."""
        if not len(self.words):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        return np.where(self.words[at] == ids, at, -1)

    def symbols(self, codes: np.ndarray, digit: int) -> np.ndarray:
        return codes // self.radix ** (DIGITS - 1 - digit) % self.radix

    def count(self, ids: np.ndarray, goes: np.ndarray, k: int, n: int) -> np.ndarray:
        """Occurrences of each of the ``n`` phrases of ``k`` words among consecutive words."""
        codes = self.codes(ids)
        at = np.flatnonzero(codes >= 0)
        state = codes[at]
        for step in range(1, k):
            on = goes[at + step - 1]
            at, state = at[on], state[on]
            on = codes[at + step] >= 0
            at, state = at[on], state[on]
            for digit in range(DIGITS):
                to = self.base[state] + self.symbols(codes[at + step], digit)
                on = self.check[to] == state
                at, state = at[on], to[on]
        return np.bincount(self.base[state], minlength=n)

    @staticmethod
    def build(phrases: list[np.ndarray]) -> Trie:
        """A trie over distinct phrases sorted by their words; number i is the i-th of them."""
        words = np.unique(np.concatenate(phrases))
        codes = [np.searchsorted(words, p) for p in phrases]
        trie = Trie(words, np.zeros(0, np.int32), np.zeros(0, np.int32))
        symbols = [codes[0]] + [trie.symbols(c, d) for c in codes[1:] for d in range(DIGITS)]
        # Nodes are the distinct prefixes; ``node[d]`` numbers those of d + 1 symbols in order.
        new = np.zeros(len(codes[0]), bool)
        new[:1] = True
        first, node = [], []
        for s in symbols:
            new[1:] |= s[1:] != s[:-1]
            first.append(np.flatnonzero(new))
            node.append(np.cumsum(new) - 1)
        sizes = np.array([len(f) for f in first])
        offset = np.concatenate([[0], np.cumsum(sizes)])
        parent = np.concatenate([offset[d] + node[d][first[d + 1]] for d in range(len(symbols) - 1)])
        symbol = np.concatenate([symbols[d + 1][first[d + 1]] for d in range(len(symbols) - 1)])
        start = np.searchsorted(parent, np.arange(offset[-2] + 1))
        base_of = _place(start, symbol, len(words), trie.radix)
        slot = np.empty(offset[-1], np.int64)
        slot[: sizes[0]] = symbols[0][first[0]]
        slot[sizes[0] :] = base_of[parent] + symbol
        size = int(max(slot.max(), base_of.max())) + trie.radix + 1
        trie.base, trie.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        trie.base[slot[: offset[-2]]] = base_of
        trie.base[slot[offset[-2] :]] = np.arange(sizes[-1])
        trie.check[slot[sizes[0] :]] = slot[parent]
        return trie


def _place(start: np.ndarray, symbol: np.ndarray, reserved: int, radix: int) -> np.ndarray:
    """Bases for nodes whose children have the symbols symbol[start[i]:start[i + 1]], so that no two share a slot.

    Slots below ``reserved`` are taken. Nodes with many children get stretches of their own; the others are thrown at random
    bases, round by round, those with most children first. When few of them land the array grows by an eighth; a
    node with one child takes any free slot.
    """
    size = np.diff(start)
    base = np.zeros(len(size), np.int64)
    many = max(radix // 3, 2)
    dense = np.flatnonzero(size > many)
    base[dense] = reserved + radix * np.arange(len(dense))
    limit = reserved + radix * (len(dense) + 1) + int(size[(size > 1) & (size <= many)].sum() * 5 // 4)
    used = np.zeros(limit + radix, bool)
    used[:reserved] = True
    used[np.repeat(base[dense], size[dense]) + symbol[_runs(start[dense], size[dense])]] = True
    rng = np.random.default_rng(7)
    for k in range(many, 1, -1):
        left = np.flatnonzero(size == k)
        while len(left):
            b = rng.integers(reserved, limit, len(left))
            to = b[:, None] + symbol[start[left][:, None] + np.arange(k)]
            taken = used[to]
            flat = to.ravel()
            order = np.argsort(flat, kind="stable")
            again = np.zeros(len(flat), bool)
            again[order[1:]] = flat[order[1:]] == flat[order[:-1]]
            bad = (taken | again.reshape(taken.shape)).any(1)
            base[left[~bad]] = b[~bad]
            used[to[~bad].ravel()] = True
            if bad.mean() > 0.9:
                limit += limit // 8
                used = np.concatenate([used, np.zeros(limit + radix - len(used), bool)])
            left = left[bad]
    single = np.flatnonzero(size == 1)
    free = np.flatnonzero(~used)
    free = free[free >= reserved + radix]
    if len(free) < len(single):
        free = np.concatenate([free, len(used) + np.arange(len(single) - len(free))])
    base[single] = free[: len(single)] - symbol[start[single]]
    return base


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start[i] .. start[i] + size[i] - 1 of all runs, one after another."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def phrase_counts(docs: DataFrame, phrases: DataFrame, k: int) -> DataFrame:
    """(w1 .. wk, a): occurrences of each of the distinct ``phrases``, a stored table of few; their trie is broadcast."""
    spark = docs.sparkSession
    w = _w(1, k)
    order = Window.partitionBy("all").orderBy(*w)
    placed = released(phrases.withColumn("all", F.lit(0)).withColumn("number", F.row_number().over(order) - 1))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        t = Trie.build([table.column(c).to_numpy() for c in w])
        return pa.table({"n": [table.num_rows], "words": [t.words.tobytes()], "base": [t.base.tobytes()], "check": [t.check.tobytes()]})

    row = placed.groupBy("all").applyInArrow(build, "n long, words binary, base binary, check binary").first()
    if row is None:
        return phrases.select(*w, F.lit(0).cast("long").alias("a"))
    trie = Trie(np.frombuffer(row["words"], np.int64), np.frombuffer(row["base"], np.int32), np.frombuffer(row["check"], np.int32))
    shared, n = spark.sparkContext.broadcast(trie), row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for ids, goes, *_ in _positions(batches):
            total += shared.value.count(ids.view(np.int64), goes, k, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"number": pa.array(at), "a": pa.array(total[at])})

    counted = _coded(docs).mapInArrow(run, "number long, a long").groupBy("number").agg(F.sum("a").alias("a"))
    out = released(placed.join(counted, "number").select(*w, "a"))
    shared.unpersist()
    return out


def _w(first: int, last: int) -> list[str]:
    return [f"w{i}" for i in range(first, last + 1)]


def _absorbed(counts: dict[int, DataFrame], k: int, longest: int) -> DataFrame:
    """(w1 .. wk, longer): the most occurrences of a longer candidate around each phrase of ``k`` words that has one."""
    around = None
    for m in range(k + 1, longest + 1):
        for o in range(m - k + 1):
            part = counts[m].select(*[F.col(f"w{o + i}").alias(f"w{i}") for i in range(1, k + 1)], F.col("a").alias("longer"))
            around = part if around is None else around.union(part)
    return around.groupBy(*_w(1, k)).agg(F.max("longer").alias("longer"))


def _scored(counts: dict[int, DataFrame], k: int) -> DataFrame:
    """Phrases of ``k`` words with their lowest cut: l, r, score."""
    out = counts[k]
    for c in range(1, k):
        left = counts[c].select(*_w(1, c), F.col("a").alias(f"l{c}"))
        right = counts[k - c].select(*[F.col(f"w{i}").alias(f"w{c + i}") for i in range(1, k - c + 1)], F.col("a").alias(f"r{c}"))
        out = out.join(left, _w(1, c)).join(right, _w(c + 1, k))
    cuts = []
    for c in range(1, k):
        score = F.expr(f"(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l{c} as decimal(18,0)) * cast(r{c} as decimal(18,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")))
    best = F.array_min(F.array(*cuts))
    return out.withColumn("best", best).select(*_w(1, k), "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, absorbed: int = ABSORBED, top: int = TOP, trie: int = TRIE) -> DataFrame:
    """The strongest phrases of 2 to ``longest`` words of each language.

    Returns lang, rank (from 1), phrase (joined by a space), a, l, r, n, score, numbers long. Letters A-Z are folded; texts are
    split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. a counts the phrase, n all words of the language,
    l and r both parts at the cut where score = floor(1000000 * a * a / (l * r)) is lowest, the first of those that tie.
    Candidates have ``least`` occurrences; one goes if a longer candidate around it has ``absorbed`` percent of its
    occurrences. The first ``top`` by score, then a, both descending, then phrase. A null language counts as ``und``, a null
    text as empty; repeated rows count again; an empty table gives an empty result; other columns are not read. Arithmetic
    is exact; words and phrases are told apart by 64-bit hashes.
    """
    docs = docs.select("text", "lang")
    words = released(word_counts(docs, least))
    known = words.filter("id is not null")
    counts = {1: known.select(F.col("id").alias("w1"), F.col("n").alias("a"))}
    shorter = counts[1].select("w1")
    for k in range(2, longest + 1):
        found = frequent_phrases(docs, k, shorter, least)
        shorter = found.select(*_w(1, k))
        counts[k] = found if found.count() > trie else phrase_counts(docs, shorter, k)
    langs = known.select(F.col("id").alias("w1"), "lang")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    spelled = known.select("id", "word")
    rows = None
    for k in range(2, longest + 1):
        # Each step is a table of its own: one plan of all joins would weigh on the driver.
        found = released(_scored(counts, k))
        if k < longest:
            found = found.join(_absorbed(counts, k, longest), _w(1, k), "left").filter(f"longer is null or 100 * longer < {absorbed} * a")
        found = found.join(langs, "w1")
        # Phrases that tie with the last place stay until they are spelled.
        found = released(found.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top))
        for i in range(1, k + 1):
            found = found.join(spelled.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}")), f"w{i}")
        phrase = F.concat_ws(" ", *[f"word{i}" for i in range(1, k + 1)]).alias("phrase")
        found = released(found.select("lang", phrase, "a", "l", "r", "score"))
        rows = found if rows is None else rows.union(found)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    whole = words.filter("id is null").select("lang", "n")
    return rows.join(whole, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP) -> str:
    return rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words
  FROM (SELECT lang, regexp_extract_all(part, '[^ 	]+') AS words
        FROM (SELECT coalesce(lang, 'und') AS lang,
                     unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?
-
]')) AS part
              FROM documents))
), w AS (SELECT piece, lang, generate_subscripts(words, 1) AS pos, unnest(words) AS w1 FROM pieces),
runs AS (
  SELECT lang, w1, lead(w1) OVER next AS w2, lead(w1, 2) OVER next AS w3 FROM w WINDOW next AS (PARTITION BY piece ORDER BY pos)
), f1 AS (SELECT lang, w1, count(*) AS a FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.a, 1 AS k, x.a AS l, y.a AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  WHERE NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.a >= {absorbed} * f2.a)
    AND NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.a >= {absorbed} * f2.a)
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 1, x.a, y.a
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 2, x.a, y.a
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
), scored AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1
)
SELECT lang, rank, phrase, a, l, r, (SELECT sum(a)::BIGINT FROM f1 WHERE f1.lang = ranked.lang) AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {top}
"""
