import collections
import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from convsignals.llm import components, decontaminate, hashing, jaccard_join, mixing, sharding, tables, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return [w.encode().lower() for w in WORD.findall(text or "")]


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = fold(t)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for a in names:
        for b in names:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed=3):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    shared = " ".join(f"s{k}" for k in range(30))
    for family in range(12):
        base = [f"f{family}w{int(x)}" for x in rng.integers(0, 400, int(rng.integers(8, 160)))]
        for _ in range(int(rng.integers(1, 40))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = f"x{int(rng.integers(1000))}"
            rows.append((at, " ".join(w) + (" " + shared if family % 3 == 0 else "")))
            at += 1
    return [*rows, (9000, None), (9001, ""), (9002, "One two"), (9003, "one TWO"), (9004, "one two three"), (9005, " \n ")]


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 2000), (4, 85, 3), (5, 80, 10), (2, 60, 7)])
def test_jaccard_join(spark, width, percent, block):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, rep long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs, width, percent, block).collect()}
    assert got == brute_components(rows, width, percent)


def test_jaccard_join_edges(spark):
    kinds = "doc_id long, text string"
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (7, "A b c d e"), (None, "a b c d e")], kinds)
    got = collections.Counter(map(tuple, jaccard_join.jaccard_join(docs).collect()))
    assert got == collections.Counter({(5, 2, 5): 2, (7, 2, 5): 1, (None, 2, None): 1})
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


def test_long_sets_use_finer_bounds(spark):
    rng = np.random.default_rng(5)
    base = [f"w{int(x)}" for x in rng.integers(0, 3000, 3000)]
    rows = []
    for i in range(6):
        w = list(base) if i < 3 else [f"v{int(x)}" for x in rng.integers(0, 3000, 3000)]
        w[i * 50] = "changed"
        rows.append((i, " ".join(w)))
    rows.append((6, " ".join(base[:1480])))
    rows.append((7, " ".join(base[:1520])))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 85)


def test_holder_groups_keep_every_possible_link():
    def brute(vec, n, percent):
        root = np.arange(len(n))
        for a in range(len(n)):
            for b in np.flatnonzero(jaccard_join._may_link([vec], n, a, percent)):
                root[root == max(root[a], root[b])] = min(root[a], root[b])
        return root

    line = np.zeros((7, jaccard_join.PARTS), np.int32)
    line[:, 0], line[:, 1] = 1000, [0, 100, 200, 500, 400, 300, 600]
    n = np.full(7, 1500)
    # 0 to 2 gather first, then 3 gathers more; only 2 and 5, both passed over, bridge the two.
    for vec, percent in ((line, 87), (line[:, ::-1], 87)):
        assert jaccard_join._gathered([vec], n, percent).tolist() == brute(vec, n, percent).tolist()
    rng = np.random.default_rng(11)
    for _ in range(300):
        vec = np.zeros((24, jaccard_join.PARTS), np.int32)
        vec[:, :2] = rng.integers(0, 60, (24, 2))
        n = np.full(24, 60)
        assert jaccard_join._gathered([vec], n, 85).tolist() == brute(vec, n, 85).tolist()


def test_drifting_copies_meet_across_chunks(spark):
    # Twenty edited copies of edited copies in each partition: only the ends of neighbouring partitions are linked.
    shared = [f"shared-by-every-copy-{k}" for k in range(10)]
    rows = [(i, " ".join(shared + [f"w{2 * i + k}" for k in range(40)])) for i in range(80)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs, 1, 85).collect()}
    assert got == brute_components(rows, 1, 85) and {c for _, c in got.values()} == {0}


def test_components(spark):
    edges = [(1, 2), (3, 2), (10, 11), (11, 12), (12, 13), (13, 10), (5, 5), (None, 4), (20, 13)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 20: 10}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["One two  one", None, "", "\tone\x0bTwo ", "x" * 50, "ü one", "one"]
    seen = {}
    for lo, hi, w in hashing.text_chunks(pa.array(texts), True):
        for k in range(lo, hi):
            own = w.hashes[w.first[k - lo] : w.first[k - lo + 1]].tolist()
            want = fold(texts[k])
            assert len(own) == len(want)
            for h, x in zip(own, want):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def jump_one(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 5)
    keys = np.arange(500, dtype=np.int64) * 7919
    assert sharding.jump(keys, 40).tolist() == [jump_one(int(k), 40) for k in keys]
    rows = [(i, "text" * (i % 5), 1) for i in range(700)] + [(3, "text", 1), (None, None, 1), (701, "é", 1)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, slot long"), 8).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(8))
    assert next(r.size for r in out if r.doc_id == 701) == 18
    assert len({r.shard for r in out if r.doc_id == 3}) == 1
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PAGES = "page_id long, url string, html string, payload string"


def test_warc(spark, tmp_path):
    big = "<p>\r\n\r\nWARC/1.1 é</p>" * 80
    rows = [(i, f"http://x/{i}", big if i % 3 == 0 else f"{i}" * (i * 40), "z") for i in range(60)]
    rows += [(100, None, None, "z"), (101, "a\r\nb", "short", "z"), (102, "u", "short", "z"), (None, "u", big, "z"), (57, "again", big, "z")]
    out = warc.archive(spark.createDataFrame(rows, PAGES), str(tmp_path / "a")).collect()
    body = lambda t: (t or "").encode()
    top = max(i for i, _, t, _ in rows if t == big and i is not None)
    want = []
    for i, _, t, _ in rows:
        revisit = t == big and i != top
        want.append((i, len(body(t)), hashlib.sha1(body(t)).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert collections.Counter(map(tuple, out)) == collections.Counter(want)
    full = warc.read_warc(spark, str(tmp_path / "a")).filter("record_type = 'response'").collect()
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in full)
    assert "a%0D%0Ab" in {r.url for r in full}
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


def test_rake_meets_margins():
    import pandas as pd

    cells = pd.DataFrame(
        [(s, la, t, 10.0 + 7 * k) for k, (s, la, t) in enumerate((s, la, t) for s in "abc" for la in "xy" for t in "pq")],
        columns=["source", "lang", "topic", "tokens"],
    )
    targets = {"source": {"a": 0.6, "b": 0.3, "c": 0.1}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.2, "q": 0.8}}
    mass = mixing.rake(cells, targets, 60)
    for d, goal in targets.items():
        for name, share in goal.items():
            assert mass[cells[d] == name].sum() == pytest.approx(share, abs=1e-9)
    tokens = cells["tokens"].to_numpy()
    p = mixing.calibrate(tokens, mass, 0.7)
    assert (p * tokens).sum() == pytest.approx(0.7 * tokens.sum()) and p.max() <= 1


def test_mixing(spark):
    rows = [(i, "word " * (i % 60), ["a", "b", None][i % 3], "en", 1.0) for i in range(300)] + [(None, None, None, None, 1.0), (7, "dup", "a", "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight double")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and all(0 <= r.probability <= 1 for r in out) and all(r.kept for r in out if r.n_tokens == 0)
    total = sum(r.n_tokens for r in out)
    assert abs(sum(r.n_tokens * r.probability for r in out) - mixing.BUDGET * total) < 1e-6 * total
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_keeps_all_strata(spark):
    rows = [(i, "word " * (1 + i % 17), f"s{i % 600}", ["en", "de", None][i // 600 % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"s599": 0.2, "s3": 0.1}}
    few = {r.doc_id: r for r in mixing.mix(docs, targets).collect()}
    many = {r.doc_id: r for r in mixing.mix(docs, targets, driver_cells=0).collect()}
    assert len({r.source for r in few.values()}) == 600
    for i, r in few.items():
        assert many[i].weight == pytest.approx(r.weight) and many[i].probability == pytest.approx(r.probability)
    total = sum(r.n_tokens for r in many.values())
    raked = sum(r.n_tokens * r.weight for r in many.values() if r.source == "s599")
    assert raked == pytest.approx(0.2 * total, rel=0.01)
    full = mixing.mix(docs, budget=1.0, driver_cells=0).collect()
    assert all(r.probability == 1 for r in full)
    assert mixing.mix(docs.limit(0), driver_cells=0).count() == 0


def test_scratch_deletes_its_tables(spark):
    with tables.Scratch(spark) as scratch:
        one, two = scratch.store(spark.range(3)), scratch.store(spark.range(4))
        places = [p.removeprefix("file:") for _, p in scratch.tables]
        scratch.drop(one)
        assert [os.path.exists(p) for p in places] == [False, True] and two.count() == 4
    assert not any(map(os.path.exists, places))


def test_pipeline_stages_decide_by_row(spark, sf, tmp_path):
    item = "If John has 5 apples and Mary gives him 7 more apples, how many apples does John have in total now?"
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = [f"w{k}" for k in range(60)]
    near, other = " ".join(words), " ".join(words[:-1] + ["end"])
    rows = [
        (None, f"see: {item}", "en", "a"),
        (None, "clean words of a row without an id", "en", "a"),
        (7, f"again: {item}", "en", "b"),
        (7, "another clean row under the same id as a leak", "en", "b"),
        (8, near, "en", "b"),
        (9, other, "en", "b"),
        (9, "a third text under the id of a near copy", "de", "b"),
        (None, near, "de", "c"),
        (10, "", "en", "c"),
        (10, "", "en", "c"),
        (11, "twice the same row and text", "en", "c"),
        (11, "twice the same row and text", "en", "c"),
        (12, "long " * 30000, "en", "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns(
        {"row": F.lit("x"), "kept": F.lit(1), "component_id": F.lit(2)}
    )
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    all_rows = texts(docs)
    out = stages["jaccard_representatives"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert texts(out) == all_rows - collections.Counter({(9, other): 1, (None, near): 1, (11, "twice the same row and text"): 1, (None, f"see: {item}"): 1})
    out = stages["template_decontamination"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and texts(out) == all_rows - collections.Counter({(None, f"see: {item}"): 1, (7, f"again: {item}"): 1})
    out = stages["target_mixing"](spark, docs, str(tmp_path))
    kept = [r.kept for r in mixing.mix(docs).collect()]
    assert out.columns == docs.columns and out.count() == sum(kept)
    for name in ("jaccard_representatives", "template_decontamination", "target_mixing"):
        assert stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_decontamination(spark):
    item = "If John has 5 apples and Mary gives him 7 more apples, how many apples does John have in total now?"
    bench = spark.createDataFrame([(0, item), (1, "the capital city of France"), (2, None), (3, "two words")], "item_id long, text string")
    docs = [
        (1, f"Intro words here. {item} End."),
        (2, item.replace("5", "12").replace("7", "30").replace("John", "Peter").replace("Mary", "Anna")),
        (3, item.replace("5", "12").replace("John have", "Susan have")),
        (4, "plain words that match none of the items, however long the text may be in the end"),
        (5, None),
        (6, ""),
        (7, "it is the capital city of Spain today"),
        (None, item),
    ]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, id long, h string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.leaks(frame, bench).collect()}
    assert got == {(1, 0): True, (2, 0): False, (7, 1): False, (None, 0): True}
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0
    plan = decontaminate.leaks(frame, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_verbatim_runs_leak(spark):
    table = "add 3 7 12 km and 5 9 14 kg to get 21 88 31 m"
    twice = "a farmer sells 40 eggs on monday and then on friday of that same week the farmer sells 40 eggs again"
    long = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(59))
    bench = [(0, table), (1, "Ohm's law"), (2, "北京是中国的首都"), (3, twice), (4, long), (5, None), (None, "other words here")]
    docs = [
        (10, f"Intro. {table.upper()}, end"),
        (11, "we use ohms law, here"),
        (12, "大家知道北京是中国的首都。"),
        (13, twice.replace("40 eggs again", "50 eggs again")),
        (14, "x y " + " ".join(long.split()[20:40]) + " z"),
        (15, " ".join(long.split()[20:33])),
        (16, " ".join(long.split()[20:32]) + " and " + " ".join(long.split()[33:45])),
        (17, table.replace("7", "8").replace("14", "15")),
        (None, "ohms law"),
        (18, None),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows) for r in decontaminate.verbatim_leaks(docs, bench).collect()}
    one = (1, 1)
    assert got == {(10, 0): (4, 4), (11, 1): one, (12, 2): one, (13, 3): (6, 9), (14, 4): (8, 47), (15, 4): (1, 47), (None, 1): one}
    pairs = [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()]
    assert set(got) <= set(pairs) and len(set(pairs)) == len(pairs)
    assert decontaminate.verbatim_leaks(docs, bench.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == before.columns
        docs = docs.persist()
        kept[name] = docs
    first, second = kept["quality_classifier"], kept["jaccard_representatives"]
    rows = [(r.doc_id, r.text) for r in first.collect()]
    want = {i for i, (_, c) in brute_components(rows, 5, 80).items() if c == i}
    assert {r.doc_id for r in second.collect()} == want
    bench = [fold(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = lambda t: re.sub(rb"[^a-z ]", b"", b" ".join(fold(t)))
    dropped = {r.doc_id for r in second.collect()} - {r.doc_id for r in kept["template_decontamination"].collect()}
    holds = {i for i, t in rows if i in want and any(re.sub(rb"[^a-z ]", b"", b" ".join(b)) in clean(t) for b in bench)}
    assert holds == dropped
    third, fourth = kept["template_decontamination"], kept["target_mixing"]
    drawn = {r.doc_id for r in mixing.mix(third).filter("kept").collect()}
    assert {r.doc_id for r in fourth.collect()} == drawn
    assert {r.doc_id for r in kept["jump_shards"].collect()} == drawn
    for df in kept.values():
        df.unpersist()


def test_sql_counterparts(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix(docs).withColumns({c: F.round(c, 6) for c in ("weight", "probability")})
    rel = db.sql(mixing.oracle())
    assert sorted(map(tuple, out.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_edges_of_a_group_shrink_to_stars(spark):
    # All pairs of two groups: the rounds start from one edge a node.
    pairs = [(a, b) for n in (0, 100) for a in range(n, n + 40) for b in range(n, a)]
    u, v = components._stars(*np.array(pairs).T)
    assert sorted(zip(u.tolist(), v.tolist())) == [(k, n) for n in (0, 100) for k in range(n + 1, n + 40)]
    rng = np.random.default_rng(1)
    edges = rng.permutation(400).reshape(-1, 2).tolist() + [(k, k + 1) for k in range(0, 300, 7)]
    u, v = components._stars(*np.array(edges).T)
    root = dict(zip(u.tolist(), v.tolist()))
    assert all(root.get(a, a) == root.get(b, b) for a, b in edges) and all(x > y for x, y in root.items())


def test_blocks_meet_two_at_a_time(spark, monkeypatch):
    # One region of 300 documents without links: no key may gather more than two blocks of about 20.
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("region"), F.lit(15).cast("long").alias("blocks"))
    body = docs.withColumn("body", F.expr("unhex(lpad(hex(doc_id), 16, '0'))"))
    seen, joined = [], jaccard_join._joined

    def watched(rows, percent, visiting):
        seen.append(rows.groupBy("key").count().agg(F.max("count")).first()[0])
        return joined(rows, percent, visiting)

    monkeypatch.setattr(jaccard_join, "_joined", watched)
    none = spark.createDataFrame([], "a long, b long")
    assert jaccard_join._across(body, none, 85).count() == 0
    assert len(seen) == 2 and max(seen) < 90


@pytest.mark.parametrize("visitors", [40, 200])
def test_visitors_meet_all_other_blocks(spark, visitors):
    docs = spark.range(200).selectExpr("id AS doc_id", "1L AS region", "5L AS blocks", f"id < {visitors} AS visitor", "200L AS docs", f"{visitors}L AS visitors", "X'00' AS body")
    home = dict(map(tuple, docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(5))).collect()))
    keys = collections.defaultdict(list)
    for r in jaccard_join._visits(docs).collect():
        keys[r.key].append(r)
    met = {frozenset((x.doc_id, y.doc_id)) for rows in keys.values() for x in rows if x.visitor for y in rows if x.side != y.side}
    assert met == {frozenset((a, b)) for a in range(visitors) for b in range(200) if home[a] != home[b]}


def test_long_unlike_sets_with_a_common_passage_share_no_region(spark, monkeypatch):
    rng = np.random.default_rng(8)
    passages = [" ".join(f"a-long-common-word-{g}-{k}" for k in range(8)) for g in range(2)]
    texts = [[f"v{x}" for x in rng.integers(0, 10**6, int(rng.integers(700, 2600)))] for _ in range(50)]
    rows = [(i, " ".join([passages[i % 5 == 0], *w])) for i, w in enumerate(texts)]
    # Near copies on both sides of each level.
    for k, (least, _) in enumerate(jaccard_join.LEVELS[1:]):
        w = [f"u{x}" for x in rng.integers(0, 10**6, least + least // 20)]
        rows += [(100 + 10 * k + j, " ".join(w[: least + j * least // 20])) for j in (-1, 0, 1)]
    labelled, shipped = [], jaccard_join._shipped

    def watched(docs, labels, width):
        labelled.append({r.doc_id for r in labels.collect()})
        return shipped(docs, labels, width)

    monkeypatch.setattr(jaccard_join, "_shipped", watched)
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 5, 80)
    assert labelled[0] == {i for i, _ in rows if i >= 99}
