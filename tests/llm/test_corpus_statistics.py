import collections
import itertools
import random
import re

import numpy as np
import pytest

from convsignals.llm import collocations, divergence, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n long, score double, rank int, term string"


def frame(spark, rows):
    """Documents (id, text, lang, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 0.5, 2, "x") for r in rows], SCHEMA)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ------------------------------------------------------------------ divergence
def brute_divergence(rows, least, listed):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(text))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        v = len(kept)
        counts = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), collections.Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, c in counts.items():
            pairs = [(sum(f(p(c, t), p(d, t)) for t in kept), o) for o, d in counts.items() if o != s]
            terms = [(f(p(c, t), p(whole, t)), t) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, listed)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(order)]
    return sorted(out)


def divergence_rows(seed=5, n=240):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'xyz'[i % 3]}é" for i in range(60)] + ["The", "of", "ÜBER"]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr", None])
        source = f"s{rng.randrange(5)}" if lang != "fr" else rng.choice(["one", None])
        k = rng.randrange(40)
        text = " ".join(rng.choice(words[: 20 + 7 * rng.randrange(6)]) + rng.choice([" ", "1", "-", "\t"]) for _ in range(k))
        rows.append((i, text, lang, source))
    rows += [(900, None, "en", "empty"), (901, "", "xx", "alone"), (902, "a b c", "xx", None), (903, "of " * 70_000, "en", "s1"), (3, "The of", "en", "s1")]
    return rows + [rows[0], rows[0], (None, "of the of", "en", "s2")]


def test_divergence_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "NUMBERED", 16)
    rows = divergence_rows()
    got = sorted(map(tuple, divergence.source_divergence(frame(spark, rows), 4, 6, sources=3).collect()))
    assert got == brute_divergence(rows, 4, 6) and len(got) > 60
    # All terms are rare: pairs of value 0 remain.
    few = rows[:12]
    got = sorted(map(tuple, divergence.source_divergence(frame(spark, few), 100).collect()))
    assert got == brute_divergence(few, 100, 10) and {r[4] for r in got} == {0}


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(frame(spark, [])).collect() == []


# ---------------------------------------------------------------- collocations
def brute_collocations(rows, least, absorbed, top):
    out = []
    for lang in {r[2] or "und" for r in rows}:
        pieces = [re.findall(r"[^\x20\x09]+", p) for _, text, other, _ in rows if (other or "und") == lang for p in re.split(r"[.,;:!?\x0A-\x0D]", fold(text))]
        f = collections.Counter(tuple(w[i : i + k]) for w in pieces for k in (1, 2, 3) for i in range(len(w) - k + 1))
        n = sum(len(w) for w in pieces)
        found = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            longer = [m for q, m in f.items() if len(q) > len(phrase) and m >= least and any(q[i : i + len(phrase)] == phrase for i in range(len(q)))]
            if any(100 * m >= absorbed * a for m in longer):
                continue
            score, k = min((10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def collocation_rows(seed=2, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["New", "YORK", "city", "été", "a-b", "#"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(25)):
            parts.append(rng.choice(["new york city", "of the", rng.choice(words), rng.choice(words)]))
            parts.append(rng.choice([" ", " ", "\t", "  ", ". ", "\n", "!?"]))
        rows.append((i, "".join(parts), rng.choice(["en", "de", None, "und"]), "s"))
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, " \t.", "zz", "s"), (503, "of the " * 20_000, "de", "s"), (None, "new york city " * 12, "en", None)]
    return rows + rows[:3]


@pytest.mark.parametrize("trie", [collocations.TRIE, 7])
def test_collocations_match_brute_force(spark, trie):
    rows = collocation_rows()
    got = collocations.collocations(frame(spark, rows), least=5, top=40, trie=trie).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 5, 50, 40) and len(got) > 30


def test_passes_over_the_texts_do_not_grow_with_the_phrases(spark, monkeypatch):
    """Levels beyond one trie took a pass per trie; now their scan counts them."""
    rows, scans = [(k, "one two three four five six seven. " * 6, "en", "s") for k in range(3)], []
    coded = collocations._coded
    monkeypatch.setattr(collocations, "_coded", lambda docs: scans.append(1) or coded(docs))
    got = collocations.collocations(frame(spark, rows), least=5, top=40, trie=2).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 5, 50, 40)
    assert len(scans) == 3


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, "one two. three", "en", "s")])).collect() == []


def test_trie_counts_like_a_dictionary():
    rng = np.random.default_rng(4)
    for vocabulary, k, size in ((5, 2, 12), (300, 3, 4000), (40_000, 2, 20_000)):
        ids = np.sort(rng.choice(2**62, vocabulary, replace=False)) - 2**61
        text = ids[(rng.pareto(1.0, 30_000) * 3).astype(np.int64) % vocabulary]
        grams = np.unique(np.stack([text[i : len(text) - k + 1 + i] for i in range(k)], 1), axis=0)
        phrases = grams[np.sort(rng.choice(len(grams), min(size, len(grams)), replace=False))]
        trie = collocations.Trie.build([phrases[:, i] for i in range(k)])
        goes = rng.random(len(text)) < 0.9
        goes[-1] = False
        got = trie.count(text, goes, k, len(phrases))
        want = collections.Counter(tuple(text[i : i + k]) for i in range(len(text) - k + 1) if goes[i : i + k - 1].all())
        assert [want[tuple(p)] for p in phrases] == got.tolist()


# --------------------------------------------------------------------- minhash
def brute_components(rows, width, percent):
    sets = {}
    for i, text, *_ in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), root(i), root(i) == i) for i, many in sets.items() for s in many)


def near_copies(seed=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size, copies in ((7, 6), (30, 5), (90, 20), (300, 30), (150, 8)):
        for _ in range(3):
            text = [rng.choice(words) for _ in range(size)]
            for _ in range(copies):
                # Copies drift, so that some link only through others.
                for _ in range(rng.randrange(3)):
                    text[rng.randrange(size)] = rng.choice(words)
                rows.append((n := n + 1, " ".join(text), "en", "s"))
    rows += [(n + 1, None, "en", "s"), (n + 2, "", "en", "s"), (n + 3, "One two", "en", "s"), (n + 4, "one TWO", "en", "s"), (n + 5, "two one", "en", "s")]
    rows += [(n + 6, "x y z " * 30_000, "en", "s"), (n + 7, "X y z " * 30_000, "en", "s"), rows[0], rows[40]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, percent", [(4000, 85), (5, 85), (4000, 80)])
def test_minhash_components_match_brute_force(spark, monkeypatch, block, percent):
    monkeypatch.setattr(minhash, "LIST_BLOCK", block)
    rows = near_copies()
    got = minhash.near_duplicates(frame(spark, rows).repartition(5), 3, percent).collect()
    want = brute_components(rows, 3, percent)
    assert collections.Counter(map(tuple, got)) == want
    assert sum(not kept for *_, kept in want) > 80


def test_minhash_of_nothing_and_nameless_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    got = minhash.near_duplicates(frame(spark, [(None, "a b c d", "en", "s"), (None, "a b c d", "en", "s"), (2, "a b c d", "en", "s")]))
    assert sorted(map(tuple, got.collect()), key=str) == [(2, 2, 2, True), (None, 2, None, True), (None, 2, None, True)]


def test_match_threshold_bounds_the_misses():
    rng = np.random.default_rng(1)
    for coordinates, percent in ((48, 85), (64, 80)):
        least = minhash.match_threshold(coordinates, percent, 1e-4)
        misses = (rng.binomial(coordinates, percent / 100, 2_000_000) < least).mean()
        assert misses <= 2e-4 and (rng.binomial(coordinates, percent / 100, 2_000_000) < least + 1).mean() > 1e-4


def test_a_list_gives_fewer_pairs_than_documents():
    # Ten equal signatures, and thirty that match each of them but not one another.
    rng = np.random.default_rng(5)
    sig = rng.integers(10, 2**32, (40, 48), dtype=np.uint32)
    sig[1:11] = 7
    for k in (0, *range(11, 40)):
        sig[k, rng.permutation(48)[:23]] = 7
    pairs = [(int(m), p) for members, p in minhash._retained(sig, 23) for m in members]
    assert len(pairs) == 39 and all((sig[a] == sig[b]).sum() >= 23 for a, b in pairs)
