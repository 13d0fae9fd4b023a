import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from convsignals import schema as S
from convsignals.functions import fuzzy as fz
from convsignals.operators import blocks as bk
from convsignals.operators import decode as dc
from convsignals.operators import duplicates as dp
from convsignals.operators import profile as pf
from convsignals.operators import quality as ql
from convsignals.operators import similarity as sm
from convsignals.operators import standardize as st
from convsignals.operators import tfidf as tf
from convsignals.operators import validate as vl
from convsignals.operators.percentiles import exact_percentiles


# --------------------------------------------------------------------- blocks
def test_rank_over_blocks_equals_a_plain_rank(spark):
    rows = spark.createDataFrame([(k, v) for k in "ab" for v in range(50 if k == "a" else 3)], "k string, v int")
    ranked = bk.with_rank(rows, ["k"], ["v"], F.floor(F.col("v") / 7))
    assert all(r["rank"] == r["v"] + 1 for r in ranked.collect())
    assert {r["k"]: r["rows_total"] for r in ranked.collect()} == {"a": 50, "b": 3}


def test_lookup_join_splits_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(bk, "HEAVY_KEYS", 1)
    rows = spark.createDataFrame([("hot", i) for i in range(30)] + [("cold", 90), ("none", 91)], "k string, id int")
    lookup = spark.createDataFrame([("hot", 30, "H"), ("cold", 1, "C"), ("unused", 5, "U")], "k string, n int, v string")
    for how, expected in (("left", 32), ("inner", 31), ("semi", 31)):
        got = bk.lookup_join(rows, lookup, "k", "n", how, row_id="id").collect()
        assert len(got) == expected and len({r["id"] for r in got}) == expected
    values = {r["id"]: r["v"] for r in bk.lookup_join(rows, lookup, "k", "n").collect()}
    assert values[3] == "H" and values[90] == "C" and values[91] is None


# ---------------------------------------------------------------- percentiles
@pytest.mark.parametrize("n", [1, 2, 5, 150, 5000])
def test_percentiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2)
    rows = spark.createDataFrame([("x", float(v)) for v in values], "g string, v double")
    points = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["fraction"]: r["percentile"] for r in exact_percentiles(rows, "g", "v", points).collect()}
    assert [got[p] for p in points] == pytest.approx([float(np.percentile(values, p * 100)) for p in points])
    ordered = sorted(values)
    got = {r["fraction"]: r["percentile"] for r in exact_percentiles(rows, "g", "v", [0.5, 0.99], "nearest").collect()}
    assert got == {p: ordered[min(int(n * round(p * 100) / 100), n - 1)] for p in (0.5, 0.99)}


def test_population_scaler(spark):
    rows = spark.createDataFrame([(1.0, 5.0, "train"), (3.0, 5.0, "train"), (100.0, 6.0, "test")], "x double, k double, split string")
    got = [(r["x"], r["k"]) for r in st.standardized(rows, ["x", "k"]).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0), (98.0, 1.0)]


# ----------------------------------------------------------------- validation
def conversation(**changes):
    def message(i, role, delay, minute):
        text = f"שלום וברכה {i}"
        return {
            "message_index": i,
            "role": role,
            "text": text,
            "response_delay_minutes": delay,
            "interest_label": "interested" if role == "customer" else "not_applicable",
            "interest_score": 0.7 if role == "customer" else None,
            "behavioral_features": {
                "message_length_chars": len(text),
                "question_count": 0,
                "emoji_count": 0,
                **{f: False for f in S.FLAG_NAMES},
            },
            "timestamp": f"2025-01-01T10:0{minute}",
        }

    base = {
        "conversation_id": "he_sales_000001",
        "source_dataset": "s",
        "language": "he",
        "locale": "he-IL",
        "synthetic": True,
        "domain": "furniture",
        "domain_he": "ריהוט",
        "product_or_service": "ספה",
        "customer_persona": "p",
        "business_style": "b",
        "interest_trajectory": "high_to_conversion",
        "initial_interest_score": 0.8,
        "final_interest_score": 0.9,
        "final_outcome": "converted",
        "messages": [message(0, "customer", 5, 0), message(1, "business", 3, 3), message(2, "customer", 2, 5)],
        "metadata": {"channel": "whatsapp", "contains_personal_data": False, "quality_status": "ok", "generator_seed": 1},
    }
    for path, value in changes.items():
        node, parts = base, path.split("__")
        for part in parts[:-1]:
            node = node[int(part) if part.isdigit() else part]
        node[parts[-1]] = value
    return base


BROKEN = {
    "id_format": {"conversation_id": "x_1"},
    "language": {"language": "en"},
    "locale": {"locale": "en-US"},
    "synthetic": {"synthetic": False},
    "trajectory": {"interest_trajectory": "odd"},
    "outcome": {"final_outcome": "odd", "interest_trajectory": "odd2"},
    "trajectory_outcome": {"final_outcome": "ghosted"},
    "empty_messages": {"messages": []},
    "first_role": {"messages__0__role": "business", "messages__0__interest_label": "not_applicable", "messages__0__interest_score": None},
    "message_index": {"messages__1__message_index": 7},
    "role": {"messages__1__role": "bot"},
    "empty_text": {"messages__1__text": "  "},
    "no_script_letter": {"messages__1__text": "hello there"},
    "gender_slash": {"messages__1__text": "מעוניין/ת בזה"},
    "interest_label": {"messages__0__interest_label": "odd"},
    "business_label": {"messages__1__interest_label": "interested"},
    "business_score": {"messages__1__interest_score": 0.4},
    "customer_label": {"messages__0__interest_label": "not_applicable"},
    "timestamp_format": {"messages__2__timestamp": "2025-01-01 10:05"},
    "delay": {"messages__0__response_delay_minutes": -1},
    "delay_mismatch": {"messages__2__response_delay_minutes": 4},
    "message_length": {"messages__0__behavioral_features__message_length_chars": 999},
    "signal_missing": {"messages__0__behavioral_features__emoji_count": None},
    "channel": {"metadata__channel": "sms"},
    "metadata_missing": {"metadata__quality_status": None},
    "missing_field": {"domain": None},
}


def corpus(spark, *rows):
    return spark.createDataFrame(rows, S.CONVERSATION_SCHEMA)


def test_valid_conversation_has_no_violation(spark):
    assert vl.violations(corpus(spark, conversation())).count() == 0


def test_each_rule_reports_its_own_fault(spark):
    rows = []
    for i, (rule, changes) in enumerate(BROKEN.items()):
        row = conversation(**{"conversation_id": f"he_sales_{i:06d}", **changes})
        rows.append(row)
    df = corpus(spark, *rows)
    found = {}
    for r in vl.violations(df).collect():
        found.setdefault(r["conversation_id"], set()).add(r["rule"])
    for i, (rule, changes) in enumerate(BROKEN.items()):
        cid = changes.get("conversation_id", f"he_sales_{i:06d}")
        assert rule in found[cid], (rule, found.get(cid))
        extra = found[cid] - {rule}
        # A changed text also changes its stored length; an unknown value may break a second rule.
        allowed = {"message_length", "trajectory", "no_business", "no_customer", "interest_label"}
        assert extra <= allowed, (rule, extra)


def test_duplicate_ids_and_summary(spark):
    df = corpus(spark, conversation(), conversation(), conversation(conversation_id="he_sales_000002"))
    broken = vl.violations(df)
    assert [(r["rule"], r["detail"]) for r in broken.collect()] == [("duplicate_id", "2")]
    summary = vl.validation_summary(df.select("conversation_id").distinct(), broken).first()
    assert tuple(summary) == (2, 1, 1)
    assert vl.first_violations(broken, 1).count() == 1


def test_canonical_order(spark):
    shuffled = corpus(spark, conversation()).select(*reversed(S.CONVERSATION_SCHEMA.fieldNames()))
    assert S.in_canonical_order(shuffled).columns == S.CONVERSATION_SCHEMA.fieldNames()


# -------------------------------------------------------------------- quality
def test_misplaced_phrases_report_the_first_one(spark):
    rows = spark.createDataFrame(
        [(1, "law", "יש לכם צוות קבוע ואחריות על העבודה"), (2, "plumbing", "צוות קבוע"), (3, "law", "שלום"), (4, None, "הגעת טכנאי")],
        "id int, domain string, text string",
    )
    got = {r["id"]: r["phrase"] for r in ql.misplaced_phrases(rows).collect()}
    assert got == {1: "צוות קבוע", 4: "הגעת טכנאי"}
    hits = ql.phrase_hits(rows, ["צוות קבוע", "אחריות על העבודה"]).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in hits} == {1: 2, 2: 1}


def test_ids(spark):
    existing = spark.createDataFrame([("he_sales_000300",), ("bad",)], "conversation_id string")
    assert ql.max_id(existing).first()["max_id"] == 300
    assert ql.max_id(existing.limit(0)).first()["max_id"] == 0
    batch = spark.createDataFrame([(f"r{i}",) for i in range(40)], "request string")
    got = sorted(r["conversation_id"] for r in ql.allocate_ids(batch, existing, "request", hash_digits=1).collect())
    assert got == [f"he_sales_{i:06d}" for i in range(301, 341)]
    assert [r["conversation_id"] for r in ql.new_batch(existing.where("conversation_id <> 'bad'"), 300).collect()] == ["he_sales_000300"]


def test_run_cost(spark):
    rows = spark.createDataFrame(
        [("gpt-4o-mini", 1_000_000, 1_000_000), ("gpt-4o-2025", 1_000_000, 0), ("other", 1, 1)],
        "model string, input_tokens long, output_tokens long",
    )
    got = {r["model"]: r["cost_usd"] for r in ql.run_cost(rows).collect()}
    assert got == {"gpt-4o-mini": 0.75, "gpt-4o-2025": 2.5, "other": None}


def test_signatures_and_coverage(spark):
    messages = spark.createDataFrame([("a", i, "customer" if i % 2 == 0 else "business") for i in range(6)], "conversation_id string, pos int, role string")
    attributes = spark.createDataFrame([("a", "furniture", None, "converted"), ("b", "law", "t", "ghosted")], "conversation_id string, domain string, interest_trajectory string, final_outcome string")
    got = {r["conversation_id"]: r["signature"] for r in pf.signatures(messages, attributes).collect()}
    assert got == {"a": "furniture|unknown|converted|4|customer-business", "b": "law|t|ghosted|0|?-?"}
    options = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    counts = spark.createDataFrame([("x", 2), ("y", 3)], "k string, n long")
    assert {r["k"]: r["n"] for r in pf.underrepresented(options, counts, "k").collect()} == {"x": 2, "z": 0}


# --------------------------------------------------------------------- decode
def test_decode_responses(spark):
    good = '{"messages": [{"role": "customer", "text": " a "}, {"role": "business", "text": "b"}], "actual_outcome": "converted"}'
    cases = {
        good: None,
        f"text\n```json\n{good}\n```\nbye": None,
        f"```\n{good}\n```": None,
        f"```json\n{good}": "invalid_json",
        "not json": "invalid_json",
        "": "invalid_json",
        "[1]": "missing_messages",
        '{"x": 1}': "missing_messages",
        '{"messages": []}': "messages_not_list",
        '{"messages": "a"}': "messages_not_list",
        '{"messages": [1, 2]}': "message_not_object",
        '{"messages": [{"role": "bot", "text": "a"}, {"role": "business", "text": "b"}]}': "invalid_role",
        '{"messages": [{"role": "customer", "text": 5}, {"role": "business", "text": "b"}]}': "empty_text",
        '{"messages": [{"role": "customer", "text": "  "}, {"role": "business", "text": "b"}]}': "empty_text",
        '{"messages": [{"role": "customer", "text": "a"}]}': "wrong_count",
    }
    rows = spark.createDataFrame([(i, raw, 2) for i, raw in enumerate(cases)], "id int, raw string, expected_count int")
    decoded = dc.decode_responses(rows).cache()
    got = {r["id"]: r["reject_reason"] for r in decoded.collect()}
    assert got == dict(enumerate(cases.values()))
    accepted = dc.accepted_responses(decoded)
    assert accepted.count() == 3 and accepted.first()["messages"][0]["text"] == "a"
    rejected = dc.rejection_records(decoded)
    assert rejected.count() == 12 and max(len(r["raw_excerpt"]) for r in rejected.collect()) <= 500
    assert {r["reject_reason"]: r["n"] for r in dc.rejection_counts(rejected).collect()}["invalid_json"] == 3


# ----------------------------------------------------------------- duplicates
def messages_of(spark, conversations):
    rows = [(c, p, t) for c, texts in conversations.items() for p, t in enumerate(texts)]
    return spark.createDataFrame(rows, "conversation_id long, pos int, text string").withColumn("row_id", F.expr("conversation_id * 1000 + pos"))


def test_exact_lookup_and_short_replies(spark):
    old = dp.message_index(dp.with_norm(messages_of(spark, {1: ["אני מחפש ספה", "כן"], 2: ["אני מחפש ספה."]})))
    new = dp.with_norm(messages_of(spark, {5: ["אני מחפש  ספה", "כן", "משהו אחר"]}))
    got = {r["pos"]: r["owner"] for r in dp.exact_matches(new, old, "row_id").collect()}
    assert got == {0: 1, 2: None}
    assert {r["norm"]: r["n"] for r in old.collect()} == {"אני מחפש ספה": 2}


def test_repeats(spark):
    rows = dp.with_norm(messages_of(spark, {1: ["same text", "x y z", "same text.", "same text"], 2: ["same text"]}))
    assert sorted((r["conversation_id"], r["pos"]) for r in dp.repeats(rows).collect()) == [(1, 2), (1, 3)]


@pytest.mark.parametrize("a, b, low, high", [
    ("יש לכם המלצות מלקוחות מהאזור?", "יש לכם המלצות מלקוחות מהאזור שלי?", 80, 100),
    ("מה הטלפון שלכם?", "שלום, יש לכם ספות?", 0, 70),
    ("b a", "a b", 100, 100),
    ("", "", 100, 100),
])
def test_token_sort_score(a, b, low, high):
    assert low <= fz.token_sort_score(a, b) <= high


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


def test_common_subsequence_against_dynamic_program():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choices("abcש ", k=rng.randint(0, 90)))
        b = "".join(rng.choices("abcש ", k=rng.randint(0, 90)))
        assert fz.common_subsequence(a, b) == plain_lcs(a, b)


def mutated(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        k = rng.randrange(len(chars) + 1)
        if rng.random() < 0.5 and chars:
            chars.pop(min(k, len(chars) - 1))
        else:
            chars.insert(k, rng.choice("abcdefgh "))
    return " ".join("".join(chars).split())


@pytest.mark.parametrize("threshold", [88.0, 75.0])
def test_fuzzy_join_finds_every_pair_of_the_rule(spark, threshold):
    rng = random.Random(7)
    texts = set()
    while len(texts) < 220:
        size = rng.choice([7, 8, 9, 12, 20, 35, 60, 120, 240])
        base = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(max(1, size // 5)))[:size].strip()
        texts.add(base)
        texts.add(mutated(rng, base, rng.randint(1, max(1, len(base) // 6))))
        # A long near copy in a distant length bucket that shares the prefix.
        if len(base) > 100:
            texts.add((base + " " + mutated(rng, base[:22], 1)).strip())
    texts = sorted(t for t in texts if t)
    new, old = texts[::2], texts

    def related(a, b):
        return abs(len(a) // 10 - len(b) // 10) <= 1 or (len(b) >= 8 and a[:8] == b[:8])

    def expected(lefts):
        return {
            (a, b): round(fz.token_sort_score(a, b), 6)
            for a in lefts
            for b in old
            if a != b and len(a) >= 8 and related(a, b) and fz.token_sort_score(a, b) >= threshold
        }

    frames = [spark.createDataFrame([(t, t) for t in x], "key string, norm string") for x in (new, old)]
    got = {(r["a"], r["b"]): round(r["score"], 6) for r in dp.fuzzy_scores(*frames, "key", "key", threshold).collect()}
    assert got == expected(new) and len(got) > 50
    assert any(abs(len(a) // 10 - len(b) // 10) > 1 for a, b in got)
    both = dp.fuzzy_scores(frames[1], frames[1], "key", "key", threshold, same=True)
    assert {(r["a"], r["b"]): round(r["score"], 6) for r in both.collect()} == expected(old)


@pytest.mark.parametrize("same", [True, False])
def test_parts_of_a_fuzzy_cell_lose_no_pair(spark, monkeypatch, same):
    monkeypatch.setattr(dp, "CELL_BYTES", 1500)
    rng = random.Random(5)
    bases = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(14)) for _ in range(12)]
    texts = sorted({mutated(rng, b, k) for b in bases for k in range(4)})
    # Nothing but the last letters tells these apart; all pairs of them share nearly every piece.
    texts += ["a" * 100 + " " + "".join(rng.choices("bcdefgh", k=20)) for _ in range(10)]
    frame = spark.createDataFrame([(t, t) for t in texts], "key string, norm string")
    got = dp.fuzzy_scores(frame, frame, "key", "key", 88.0, same=same).collect()

    def related(a, b):
        return abs(len(a) // 10 - len(b) // 10) <= 1 or a[:8] == b[:8]

    expected = {(a, b) for a in texts for b in texts if a != b and related(a, b) and fz.token_sort_score(a, b) >= 88}
    assert {(r["a"], r["b"]) for r in got} == expected and len(got) == len(expected) > 30


def test_fuzzy_join_moves_texts_not_pairs(spark):
    """A join on pieces of a few letters made a row per shared piece of each pair; now a text goes to three cells at most."""
    texts = ["the same words in every text but the end " * 5 + str(k) for k in range(40)]
    frame = spark.createDataFrame([(t, t) for t in texts], "key string, norm string")
    plan = dp.fuzzy_scores(frame, frame, "key", "key", same=True)._jdf.queryExecution().executedPlan().toString()
    assert "piece" not in plan and plan.count("FlatMapGroupsInPandas") == 1
    dealt = dp._dealt(dp._prepared(frame, "key").withColumn("side", F.lit("s")), True)
    assert dealt.select(F.max(F.size("at"))).first()[0] <= 3


def test_a_subsequence_is_given_up_only_below_the_threshold():
    rng = random.Random(11)
    for _ in range(300):
        a = "".join(rng.choices("abcd ", k=rng.randint(0, 260)))
        b = mutated(rng, a, rng.randint(0, 60)) if rng.random() < 0.7 else "".join(rng.choices("abcd ", k=rng.randint(0, 260)))
        score = fz.indel_ratio(a, b)
        assert fz.ratio_from(a, fz.char_places(a), b, 88.0) in ((score,) if score >= 88 else (score, -1.0))


@pytest.mark.parametrize("few, small", [(0, 0), (0, 30_000), (2500, 30_000)])
def test_a_text_meets_a_block_of_texts_as_it_meets_each(monkeypatch, few, small):
    monkeypatch.setattr(fz, "FEW", few)
    monkeypatch.setattr(fz, "SMALL", small)
    monkeypatch.setattr(fz, "LEAST_STEP", 7)
    monkeypatch.setattr(fz, "BLOCK_BITS", 1000)
    rng = random.Random(13)
    found = 0
    for letters in ("ab", "abcd é漢😀", "etaoin shrdlu"):
        for size in (0, 1, 25, 240):
            base = "".join(rng.choices(letters, k=size))
            texts = [mutated(rng, base, rng.randint(0, 1 + size // 5)) for _ in range(12)] + [base, "", "".join(rng.choices(letters, k=size))]
            block = fz.Block(texts)
            for i in (0, 5, 12, 13):
                ratios, apart = block.ratios(i, np.arange(len(texts)), 88.0), block.apart(i, slice(0, len(texts)))
                for k, text in enumerate(texts):
                    score = fz.indel_ratio(texts[i], text)
                    assert ratios[k] == score if score >= 88 else ratios[k] < 88
                    assert apart[k] <= len(texts[i]) + len(text) - 2 * fz.common_subsequence(texts[i], text)
                    found += score >= 88
    assert found > 100


def test_fuzzy_cells_of_many_texts_are_cut(spark, monkeypatch):
    """The pairs of a cell grow with the square of its texts, so no task may hold a cell of many short ones."""
    monkeypatch.setattr(dp, "CELL_TEXTS", 5)
    texts = [f"text number {k:03d} of one length" for k in range(20)]
    frame = spark.createDataFrame([(t, t) for t in texts], "key string, norm string")
    dealt = dp._dealt(dp._prepared(frame, "key").withColumn("side", F.lit("s")), True)
    most = dealt.select(F.inline("at")).groupBy("cell", "i", "j").count().agg(F.max("count")).first()[0]
    assert most < 20
    got = dp.fuzzy_scores(frame, frame, "key", "key", 88.0, same=True).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) == 20 * 19


def test_low_thresholds_are_refused(spark):
    frame = spark.createDataFrame([("a", "a")], "key string, norm string")
    with pytest.raises(S.DataError):
        dp.fuzzy_candidates(frame, frame, "key", "key", 50.0)


def test_message_issues_in_order(spark):
    accepted = dp.message_index(dp.with_norm(messages_of(spark, {1: ["יש לכם המלצות מלקוחות מהאזור שלי?", "אני מחפש ספה פינתית"]})))
    new = dp.with_norm(messages_of(spark, {9: ["אני מחפש ספה פינתית", "משפט חדש לגמרי", "משפט חדש לגמרי", "יש לכם המלצות מלקוחות מהאזור?", "כן", "כן"]}))
    got = {r["pos"]: (r["issue"], r["match"]) for r in dp.message_issues(new, accepted, "row_id").collect()}
    assert got == {
        0: ("exact_duplicate", "1"),
        2: ("repeated_in_conversation", None),
        3: ("fuzzy_duplicate", "1"),
    }


# ----------------------------------------------------------------- similarity
def brute_cosines(documents, max_features):
    def grams(text):
        out = {}
        for word in text.lower().split():
            padded = f" {word} "
            for n in range(2, min(4, len(padded)) + 1):
                for i in range(len(padded) - n + 1):
                    out[padded[i : i + n]] = out.get(padded[i : i + n], 0) + 1
        return out

    counts = {k: grams(t) for k, t in documents.items()}
    totals, df = {}, {}
    for g in counts.values():
        for t, n in g.items():
            totals[t] = totals.get(t, 0) + n
            df[t] = df.get(t, 0) + 1
    vocab = sorted(totals, key=lambda t: (-totals[t], t))[:max_features]
    idf = {t: np.log((1 + len(documents)) / (1 + df[t])) + 1 for t in vocab}
    vectors = {}
    for k, g in counts.items():
        v = {t: (1 + np.log(n)) * idf[t] for t, n in g.items() if t in idf}
        norm = np.sqrt(sum(x * x for x in v.values()))
        vectors[k] = {t: x / norm for t, x in v.items()}
    return {(a, b): sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items()) for a in vectors for b in vectors if a != b}


@pytest.mark.parametrize("threshold", [82.0, 50.0])
def test_most_similar_against_brute_force(spark, threshold):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(60)]
    documents = {}
    for i in range(40):
        text = rng.choices(words, k=25)
        documents[i] = " ".join(text)
        documents[100 + i] = " ".join(text[: rng.randint(12, 25)] + rng.choices(words, k=3))
    documents[500] = documents[501] = documents[502] = documents[7]
    expected = {}
    for (a, b), s in brute_cosines(documents, 300).items():
        if s * 100 >= threshold:
            rank = (-round(s, 9), b)
            if a not in expected or rank < expected[a][0]:
                expected[a] = (rank, round(s * 100, 4))
    rows = spark.createDataFrame(list(documents.items()), "id long, document string")
    got = {r["id"]: (r["match"], round(r["score"], 4)) for r in sm.most_similar(rows, "id", threshold, 300).collect()}
    assert got == {k: (rank[1], s) for k, (rank, s) in expected.items()}
    assert got[500] == (7, 100.0) and got[7] == (500, 100.0)


@pytest.mark.parametrize("same", [True, False])
def test_blocks_and_matrices_lose_no_similar_pair(spark, monkeypatch, same):
    monkeypatch.setattr(sm, "BLOCK_DOCS", 7)
    monkeypatch.setattr(sm, "CHUNK_DOCS", 3)
    rng = np.random.default_rng(2)
    weights = np.abs(rng.normal(size=(40, 6)))
    weights /= np.linalg.norm(weights, axis=1, keepdims=True)
    rows = [(d, f"t{t}", float(weights[d, t])) for d in range(40) for t in range(6)]
    frame = spark.createDataFrame(rows, "id long, term string, weight double").withColumn("df", F.lit(1))
    left, right = (frame, frame) if same else (frame.where("id < 25"), frame.where("id >= 25"))
    pairs = sm.similar_pairs(left, right, "id", 0.8, same=same)
    # Every term is common here; a join on terms would have listed each pair up to six times.
    assert "SortMergeJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    cosines = weights @ weights.T
    expected = {(a, b) for a in range(40) for b in range(40) if a != b and cosines[a, b] >= 0.8 and (same or (a < 25 <= b))}
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert set(got) == expected and len(got) == len(expected) > 20


@pytest.mark.parametrize("same", [True, False])
def test_counted_documents_meet_in_blocks_without_a_row_per_term(spark, monkeypatch, same):
    """Vectors of 12 bytes a term made from a row per term filled the disk; counts above a byte and a plan without such rows."""
    monkeypatch.setattr(sm, "COUNTED_BLOCK_DOCS", 9)
    monkeypatch.setattr(sm, "CHUNK_DOCS", 4)
    monkeypatch.setattr(sm, "BATCH_DOCS", 3)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdé漢", k=rng.randint(1, 5))) for _ in range(30)]
    documents = {i: " ".join(rng.choices(words, k=12)) for i in range(24)}
    documents |= {100 + i: documents[i] + "  " + rng.choice(words).upper() for i in range(20)} | {200: "ab " * 700, 201: "ab " * 701 + "c", 202: " ", 203: ""}
    rows = spark.createDataFrame(list(documents.items()), "id long, document string")
    unique = rows.withColumn("copies", F.lit(1))
    vocab = sm._Vocabulary(sm._gram_vocabulary(unique, rows, 300))
    left, right = (rows, rows) if same else (rows.where("id < 110"), rows.where("id >= 110"))
    counted = [vocab.counted(x, "id") for x in (left, right)]
    assert "Generate" not in counted[0]._jdf.queryExecution().executedPlan().toString()
    pairs = sm._counted_pairs(vocab, *counted, 0.8, same=same).collect()
    expected = {p: s for p, s in brute_cosines(documents, 300).items() if s >= 0.8 and (same or p[0] < 110 <= p[1])}
    assert {(r["a"], r["b"]): round(r["cosine"], 9) for r in pairs} == {p: round(s, 9) for p, s in expected.items()}
    assert len(pairs) == len(expected) > 8 and (same is False or (200, 201) in expected)


def test_term_counts_move_texts_not_terms(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "red green"), (1, "blue")], "id int, text string")
    counts = tf.term_counts(docs, "id", tf.word_terms(F.col("text"), 1, 1))
    assert {(r["id"], r["term"], r["tf"]) for r in counts.collect()} == {(1, "red", 2), (1, "blue", 2), (2, "red", 1), (2, "green", 1)}
    assert "term" not in re.search(r"hashpartitioning\((.*?)\)", counts._jdf.queryExecution().executedPlan().toString())[1]


def test_tfidf_weights_by_hand(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "red green")], "id int, text string")
    got = {(r["id"], r["term"]): r["weight"] for r in tf.document_weights(docs, "id", tf.word_terms(F.col("text"), 1, 1), max_df=1.0).collect()}
    idf_one = np.log(3 / 2) + 1
    raw = np.array([1 + np.log(2), idf_one])
    assert got[(1, "red")] == pytest.approx(raw[0] / np.linalg.norm(raw))
    assert got[(1, "blue")] == pytest.approx(raw[1] / np.linalg.norm(raw))
    limited = tf.document_weights(docs, "id", tf.word_terms(F.col("text"), 1, 1), max_features=1, max_df=1.0)
    assert {r["term"] for r in limited.collect()} == {"red"}
