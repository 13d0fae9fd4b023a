import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from convsignals.llm import language_model, personal_data, quality_rules, quality_trees, statistics, substring_dedup

SCHEMA = "doc_id long, text string, source string, words long, kept boolean, hash long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def frame(spark, texts, schema=SCHEMA):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "s", 1, True, 2) for i, t in texts], schema)


EDGE = [
    (1, "a b c d e x a b c d e"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "#$% line one\nline one\n\nline one\nLINE"),
    (6, "z " * 3000),
    (7, "é à ü " * 4 + "end"),
    (7, "é à ü " * 4 + "end"),
    (None, "no id but some words here to count twice no id but some words here"),
]


def brute_statistics(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    got = statistics.text_statistics(frame(spark, EDGE)).select("doc_id", *statistics.BASE).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((i, *brute_statistics(t)) for i, t in EDGE)
    assert statistics.text_statistics(frame(spark, [])).count() == 0


def labelled(spark, n=300):
    texts = []
    for i in range(n):
        good = i % 4 != 0
        body = " ".join(f"word{(i * 7 + k) % 97}{'' if good else '###'}" for k in range(20 + i % 13))
        texts.append((i, body))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(n)] + [(None, 1), (5, None)], "doc_id long, quality int")
    return frame(spark, texts), labels


def test_quality_rules(spark):
    docs, labels = labelled(spark)
    rows = quality_rules.quality_rules(docs, labels).collect()
    assert len(rows) == 300
    assert all(r.kept == (r.doc_id % 4 != 0) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    plan = quality_rules.quality_rules(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    empty = quality_rules.quality_rules(frame(spark, EDGE), labels.limit(0)).collect()
    assert len(empty) == len(EDGE)
    for r in empty:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)


def test_quality_trees(spark):
    docs, labels = labelled(spark)
    rows = quality_trees.quality_scores(docs, labels).collect()
    assert all(r.predicted == int(r.doc_id % 4 != 0) for r in rows if r.held_out) and all(0 <= r.score <= 1 for r in rows)
    assert quality_trees.accepted(docs, labels).columns == docs.columns
    bare = quality_trees.quality_scores(frame(spark, EDGE), labels.limit(0)).collect()
    assert len(bare) == len(EDGE) and {r.score for r in bare} == {0.5}
    assert quality_trees.quality_scores(frame(spark, []), labels).count() == 0


def test_forest_walk_matches_single_rows():
    rng = np.random.default_rng(1)
    x = rng.random((400, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    forest = quality_trees.fit_forest(x, y)
    raw = []
    for row in x[:50]:
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - len(f)]
        raw.append(1 / (1 + math.exp(-total)))
    assert np.allclose(forest.scores(x[:50]), raw)
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.95


def brute_pii(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            odd = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == "card" and 14 <= len(d) <= 19 and odd % 10 == 0)
                or (kind == "phone" and 10 <= len(d) <= 15)
            ):
                out.append((m.start(), personal_data.KINDS.index(kind), kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


PII = [
    "mail a.b@c.d_e@f.g.h and @x.y and z@ and q@w",
    "ip 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 9.9.9",
    "card 4539 1488 0343 6467 and 4539148803436467-1 and 4111-1111-1111-1111",
    "call +1 (555) 123-4567 or +1 555 or +12345678901234567",
    "é +44 20 7946 0958, éa@b.co.uk.",
]


def test_personal_data(spark):
    cases = [(i, t) for i, t in enumerate(PII)] + EDGE
    rows = personal_data.personal_data(frame(spark, cases)).collect()
    want = collections.Counter((i, hashlib.sha256(",".join(brute_pii(t or "")).encode()).hexdigest()) for i, t in cases)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in rows) == want
    for r in rows:
        text = dict(cases).get(r.doc_id) or ""
        assert set(brute_pii(text)) <= set(filter(None, r.spans.split(",")))
    assert personal_data.personal_data(frame(spark, [])).count() == 0


def test_segment_model_goes_beyond_the_patterns():
    snippets = [f"please call +1 (55{k}) 5{k}5-12{k}4 today or write me{k}@mail{k}.example.com now" for k in range(10) for _ in range(4)]
    snippets += [f"token = 3f{k}ab91c77d2e0{k} version 2.{k}. of 19{k}9 items" for k in range(10) for _ in range(2)]
    model = personal_data.fit(snippets, epochs=20)
    text = "call (415) 555-2671 or bob at mail dot example dot com, version 2.0."
    base, found = personal_data.all_spans(text, model)
    assert base == [] and [(k, text[a:b]) for a, k, b in found] == [
        ("phone", "(415) 555-2671"),
        ("email", "bob at mail dot example dot com"),
    ]


def brute_dedup(rows, width=13):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("width", [5, 13, 30])
def test_substring_dedup(spark, width):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"start{i} {passage} end{i} " + " ".join(f"w{i}x{k}" for k in range(10))) for i in range(40)]
    rows += [(100, passage), (101, " ".join(passage.split()[3:35])), (102, passage + " " + passage), (102, passage), *EDGE]
    got = substring_dedup.remove_repeats(frame(spark, rows), width)
    assert collections.Counter(map(tuple, got.collect())) == brute_dedup(rows, width)
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("frequent", [3, 1000])
def test_language_model(spark, frequent):
    rows = [(i, " ".join(("the cat sat" if i % 2 else "le chat dort").split() * (1 + i % 5)) + f" x{i % 9}") for i in range(60)] + EDGE
    got = language_model.score_texts(frame(spark, rows), frequent=frequent).collect()

    def tokens(t):
        return [w.encode().lower() for w in words(t)] + [None]

    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str(i), held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6))
        for i, t in rows
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    some = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 10]
    assert sum(r.score for r in some) > sum(r.base_score for r in some)
    assert language_model.score_texts(frame(spark, [])).count() == 0


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    model = language_model.Model(
        rng.integers(0, language_model.CLASSES, language_model.ENDINGS),
        rng.normal(size=(language_model.ROWS + 1, language_model.CLASSES)).astype(np.float32),
        np.zeros(language_model.CLASSES),
    )
    z = model.logits(rng.integers(0, language_model.ROWS, (5, 20)).astype(np.int32))
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose((p / p.sum(1, keepdims=True)).sum(1), 1)
