"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). Words belong to one of CLASSES classes by their ending; which endings
share a class is learned from what precedes them. The first factor is a softmax over hashed n-gram and skip features of the
two words before, trained by local stochastic gradients in the tasks whose weights are averaged after every round. The
second is the maximum-entropy model with word features alone, whose solution is the smoothed share of the word in its
class. Counts and gradients cover every training text. Very frequent words are looked up in a bounded table that every
task holds, all others meet their counts by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convsignals.llm.hashing import Words, mix, text_chunks
from convsignals.llm.tables import released

CLASSES = 32
ENDINGS = 1024
BEFORE = 64
ROWS = 1 << 14
ROUNDS = 4
BATCH = 8192
RATE = 0.3
#: Words whose counts every task holds; the others are joined by shuffle.
FREQUENT = 200_000
_END = np.uint64(0x1D8AF5A3C0B7E621)
_START = np.uint64(0x7B54A41DC25A59B5)
FOLDS, HELD = 7, 2


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text leaves HELD modulo FOLDS; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


@dataclass
class Tokens:
    """Tokens of consecutive texts, each text closed by an end token."""

    hashes: np.ndarray
    endings: np.ndarray
    first: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def back(self, values: np.ndarray, steps: int, start) -> np.ndarray:
        """The value ``steps`` tokens earlier in the same text, or ``start``."""
        out = np.full(len(values), start, values.dtype)
        out[steps:] = values[:-steps]
        place = np.arange(len(values)) - self.first[:-1][self.owner]
        out[place < steps] = start
        return out


def tokens_of(words: Words) -> Tokens:
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    hashes = np.empty(first[-1], np.uint64)
    endings = np.zeros(first[-1], np.int64)
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    hashes[last] = _END
    hashes[~last] = words.hashes
    tail = np.zeros(len(words.starts), np.uint64)
    for k in (1, 2, 3):
        at = words.ends - k
        tail = tail * np.uint64(257) + np.where(at >= words.starts, words.data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    endings[~last] = 1 + (mix(tail) % np.uint64(ENDINGS - 1)).astype(np.int64)
    return Tokens(hashes, endings, first)


def _features(t: Tokens) -> np.ndarray:
    """Rows of the weight table for each token: two words, the pair, and two endings before it."""
    one, two = t.back(t.hashes, 1, _START), t.back(t.hashes, 2, _START)
    e1, e2 = t.back(t.endings, 1, ENDINGS).astype(np.uint64), t.back(t.endings, 2, ENDINGS).astype(np.uint64)
    salted = [one, two + np.uint64(0x9E37), mix(one + np.uint64(3) * two), e1 + np.uint64(0xA5A5_0000), e2 + np.uint64(0x5A5A_0000)]
    return np.stack([(mix(x) % np.uint64(ROWS)).astype(np.int32) for x in salted])


@dataclass
class Model:
    """Class of each ending, class logit weights (ROWS + 1 rows, the last is the bias), and log10 of N_k + V_k + 1."""

    classes: np.ndarray
    weights: np.ndarray
    log_mass: np.ndarray

    def logits(self, features: np.ndarray) -> np.ndarray:
        out = self.weights[features[0]] + self.weights[ROWS]
        for f in features[1:]:
            out += self.weights[f]
        return out

    def log_classes(self, t: Tokens) -> np.ndarray:
        """log10 P(class of token | history) of every token."""
        f, k = _features(t), self.classes[t.endings]
        out = np.empty(len(k))
        for a in range(0, len(k), BATCH):
            z = self.logits(f[:, a : a + BATCH])
            z -= z.max(1, keepdims=True)
            own = z[np.arange(len(z)), k[a : a + BATCH]]
            np.exp(z, out=z)
            out[a : a + BATCH] = own - np.log(z.sum(1))
        return out / np.log(10)

    def learn(self, t: Tokens, scale: np.ndarray) -> None:
        """Gradient steps of adaptive size, a batch of tokens at a time."""
        f, k = _features(t), self.classes[t.endings]
        for a in range(0, len(k), BATCH):
            part = f[:, a : a + BATCH]
            g = self.logits(part)
            g -= g.max(1, keepdims=True)
            np.exp(g, out=g)
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(g)), k[a : a + BATCH]] -= 1
            rows = [(np.array([ROWS]), g.sum(0, keepdims=True))]
            for column in part:
                order = np.argsort(column, kind="stable")
                ordered = column[order]
                begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                rows.append((ordered[begin], np.add.reduceat(g[order], begin, axis=0)))
            for at, total in rows:
                scale[at] += (total * total).sum(1) / CLASSES
                self.weights[at] -= (RATE / np.sqrt(scale[at] + 1))[:, None] * total


def cluster_endings(counts: np.ndarray, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """Class of each ending from its counts by what precedes it: k-means of smoothed log shares, started by frequency."""
    total = counts.sum(1)
    share = np.log((counts + 0.5) / (total[:, None] + 0.5 * counts.shape[1]))
    share -= np.log((counts.sum(0) + 0.5) / (total.sum() + 0.5 * counts.shape[1]))
    order = np.argsort(-total, kind="stable")
    centre = share[order[:classes]].copy()
    near = np.zeros(len(counts), np.int64)
    for _ in range(rounds):
        near = ((share[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for c in range(classes):
            mine = near == c
            if total[mine].sum() > 0:
                centre[c] = np.average(share[mine], axis=0, weights=total[mine])
    return near


def _gather(docs: DataFrame) -> DataFrame:
    """(kind, key, n): counts of words (kind 0, with their ending) and of (ending, word before by hash) (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, endings, cells = [], [], np.zeros(ENDINGS * BEFORE, np.int64)
            for _, _, words in text_chunks(b.column(0), True):
                t = tokens_of(words)
                before = (mix(t.back(t.hashes, 1, _START)) % np.uint64(BEFORE)).astype(np.int64)
                cells += np.bincount(t.endings * BEFORE + before, minlength=len(cells))
                u, at, c = np.unique(t.hashes, return_index=True, return_counts=True)
                hashes.append((u, c))
                endings.append(t.endings[at])
            if not hashes:
                continue
            h, c = (np.concatenate(x) for x in zip(*hashes))
            u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inverse, c).astype(np.int64)
            ending = np.concatenate(endings)[at]
            some = np.flatnonzero(cells)
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array(np.concatenate([np.zeros(len(u)), np.ones(len(some))]).astype(np.int32)),
                    "key": pa.array(np.concatenate([u.view(np.int64), some])),
                    "ending": pa.array(np.concatenate([ending, np.zeros(len(some), np.int64)]).astype(np.int32)),
                    "n": pa.array(np.concatenate([n, cells[some]])),
                }
            )

    rows = docs.select("text").mapInArrow(run, "kind int, key long, ending int, n long")
    return rows.groupBy("kind", "key").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def _round(docs: DataFrame, model: Model) -> np.ndarray:
    """Weights after one round: each task learns from its texts, starting from ``model``; token-weighted mean of tasks."""
    step = 256  # rows of the table that travel together
    slices = -(-(ROWS + 1) // step)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(model.classes, model.weights.copy(), model.log_mass)
        scale = np.zeros(ROWS + 1, np.float32)
        seen = 0
        for b in batches:
            for _, _, words in text_chunks(b.column(0), True):
                t = tokens_of(words)
                mine.learn(t, scale)
                seen += len(t.hashes)
        if seen:
            body = [(mine.weights[k * step : (k + 1) * step] * np.float32(seen)).tobytes() for k in range(slices)]
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array(range(slices), pa.int32()), "seen": pa.array([seen] * slices, pa.int64()), "body": pa.array(body, pa.binary())}
            )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for k, n, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                part = np.frombuffer(body, np.float32).astype(np.float64)
                have = sums.get(k)
                sums[k] = (n, part) if have is None else (have[0] + n, have[1] + part)
        if sums:
            yield pa.RecordBatch.from_pydict(
                {
                    "slice": pa.array(list(sums), pa.int32()),
                    "seen": pa.array([v[0] for v in sums.values()], pa.int64()),
                    "body": pa.array([(v[1] / v[0]).astype(np.float32).tobytes() for v in sums.values()], pa.binary()),
                }
            )

    kinds = "slice int, seen long, body binary"
    parts = min(slices, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = released(docs.select("text").mapInArrow(learn, kinds).repartition(parts, "slice").mapInArrow(total, kinds)).collect()
    if not rows:
        return model.weights
    flat = np.concatenate([np.frombuffer(r["body"], np.float32) for r in sorted(rows, key=lambda r: r["slice"])])
    return flat.reshape(ROWS + 1, CLASSES).copy()


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """(hash, n) of at most ``most`` words: all whose count reaches the least step of a fine scale that leaves so few."""
    step = F.floor(16 * F.log2("n"))
    sizes = {r["step"]: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}
    least, room = max(sizes, default=0) + 1, most
    for k in sorted(sizes, reverse=True):
        room -= sizes[k]
        if room < 0:
            break
        least = k
    return counts.filter(step >= least).select("hash", "n")


def score_texts(docs: DataFrame, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """log10 probability of every whole text under a unigram base and under the maximum-entropy model.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score, score (double). Letters A-Z are folded; words
    are runs of ``[^\\x20\\x09-\\x0D]``, then one end token, so that a null or empty text has one token. Texts learn the
    model if crc32 of their id is not 2 modulo 7; null ids are held out. Every round trains on its share of the training
    texts, all rounds together on all. Unknown words share the mass of one unseen word. Rows that repeat stay; an empty
    table gives an empty result, and without training texts every count is 0. Only doc_id and text are read.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark, train = d.sparkSession, d.filter(~held_out(F.col("doc_id")))
    gathered = released(_gather(train))
    counts = gathered.filter("kind = 0").select(F.col("key").alias("hash"), "ending", "n")
    cells = np.zeros((ENDINGS, BEFORE))
    for r in gathered.filter("kind = 1").collect():
        cells[divmod(r["key"], BEFORE)] = r["n"]
    classes = cluster_endings(cells)
    mass = np.zeros(CLASSES)
    words = tokens = 0
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[classes[r["ending"]]] += r["n"] + r["v"]
        words, tokens = words + r["v"], tokens + r["n"]
    weights = np.zeros((ROWS + 1, CLASSES), np.float32)
    shares = np.bincount(classes, cells.sum(1), CLASSES) + 0.5
    weights[ROWS] = np.log(shares / shares.sum())
    model = Model(classes, weights, np.log10(mass + 1))
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    for r in range(rounds):
        model.weights = _round(train.filter(turn == r), model)
    top = _most_frequent(counts, frequent).toPandas().sort_values("hash")
    shared = spark.sparkContext.broadcast((model, top["hash"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with what is known here, and rows (hash, number of uses) of its other words."""
        m, known, known_n = shared.value
        for b in batches:
            ids, keys = b.column(0), b.column(1).to_numpy()
            for lo, hi, chunk in text_chunks(b.column(2), True):
                t = tokens_of(chunk)
                own, n = t.owner, hi - lo
                logs = m.log_classes(t) - m.log_mass[m.classes[t.endings]]
                h = t.hashes.view(np.int64)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                c = np.where(hit, known_n[at] if len(known) else 0, 0)
                rest = np.flatnonzero(~hit)
                order = rest[np.lexsort((h[rest], own[rest]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
                begin = np.flatnonzero(new)
                uses = np.diff(np.append(begin, len(order)))
                asks = order[begin]
                k = len(asks)
                yield pa.RecordBatch.from_pydict(
                    {
                        "hash": pa.array(np.concatenate([np.zeros(n, np.int64), h[asks]])),
                        "row": pa.array(np.concatenate([keys[lo:hi], keys[lo:hi][own[asks]]])),
                        "doc_id": pa.concat_arrays([ids[lo:hi], pa.nulls(k, pa.int64())]),
                        "tokens": pa.array(np.concatenate([np.bincount(own, minlength=n), np.zeros(k)]).astype(np.int64)),
                        "uses": pa.array(np.concatenate([np.bincount(own, hit, n), uses]).astype(np.int64)),
                        "model": pa.array(np.concatenate([np.bincount(own, logs, n), np.zeros(k)])),
                        "word": pa.array(np.concatenate([np.bincount(own, np.log10(c + 1.0), n), np.zeros(k)])),
                        "kind": pa.array(np.concatenate([np.zeros(n), np.ones(k)]).astype(np.int32)),
                    }
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts as they are; words asked for become the sums of their texts in this partition."""
        table, asks = [], []
        for b in batches:
            kind = b.column(7).to_numpy()
            if (kind == 0).any():
                texts = b.filter(pa.array(kind == 0))
                yield pa.RecordBatch.from_pydict({c: texts.column(c) for c in ("row", "doc_id", "tokens", "uses", "model", "word")})
            h, row, uses = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
            table.append((h[kind == 2], uses[kind == 2]))
            asks.append((h[kind == 1], row[kind == 1], uses[kind == 1]))
        if not asks:
            return
        known, n = (np.concatenate(x) for x in zip(*table))
        h, row, uses = (np.concatenate(x) for x in zip(*asks))
        order = np.argsort(known)
        known, n = known[order], n[order]
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        hit = known[at] == h if len(known) else np.zeros(len(h), bool)
        h, row, uses, c = h[hit], row[hit], uses[hit], n[at[hit]] if len(known) else uses[hit]
        rows, inverse = np.unique(row, return_inverse=True)
        k = len(rows)
        if not k:
            return
        yield pa.RecordBatch.from_pydict(
            {
                "row": pa.array(rows),
                "doc_id": pa.nulls(k, pa.int64()),
                "tokens": pa.array(np.zeros(k, np.int64)),
                "uses": pa.array(np.bincount(inverse, uses, k).astype(np.int64)),
                "model": pa.array(np.zeros(k)),
                "word": pa.array(np.bincount(inverse, uses * np.log10(c + 1.0), k)),
            }
        )

    kinds = "row long, doc_id long, tokens long, uses long, model double, word double"
    rows = d.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(score, f"hash long, {kinds}, kind int")
    null = F.lit(None).cast("long")
    table = counts.select(
        "hash", F.lit(0).cast("long").alias("row"), null.alias("doc_id"), null.alias("tokens"), F.col("n").alias("uses"),
        F.lit(None).cast("double").alias("model"), F.lit(None).cast("double").alias("word"), F.lit(2).alias("kind"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.union(table).repartition(parts, F.when(F.col("kind") == 0, F.col("row")).otherwise(F.col("hash")))
    told = dealt.mapInArrow(answer, kinds)
    # Rows alike in id and text have one key: their sums are shared out again.
    copies = F.count(F.when(F.col("tokens") > 0, 1))
    found = told.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("tokens").alias("n_tokens"),
        copies.alias("copies"),
        (F.sum("uses") / copies).cast("long").alias("n_known"),
        (F.sum("word") / copies).alias("word"),
        (F.sum("model") / copies).alias("model"),
    )
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("word") - F.col("n_tokens") * F.lit(float(np.log10(tokens + words + 1)))).alias("base_score"),
        (F.col("word") + F.col("model")).alias("score"),
    )
