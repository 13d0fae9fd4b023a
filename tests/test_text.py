import pytest
from pyspark.sql import functions as F

from convsignals.functions import text as tx


def apply(spark, texts, build):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in rows.select("i", build(F.col("t")).alias("o")).orderBy("i").collect()]


def test_normalized(spark):
    texts = ["  שלום   עולם  ", "שלום.", "הי ,;:!", "5,000 ש״ח", "“a” ‘b’ צ׳ק", "é.", " x y ", "a. "]
    got = apply(spark, texts, tx.normalized)
    # A final mark before trailing space goes as well, since the ends are trimmed first.
    assert got == ["שלום עולם", "שלום", "הי", '5,000 ש"ח', "\"a\" 'b' צ'ק", "é", "x y", "a"]


def test_cleaning_order_and_toggles(spark):
    texts = [
        "Call 050-123-4567 NOW",
        "see https://x.org/1234567890/a b",
        "mail me: A.b+c@d-e.co.il!",
        "מחיר 12.5 ₪ *** טוב",
        None,
    ]
    got = apply(spark, texts, tx.cleaned)
    assert got[0] == "call <phone> now"
    # Phones go first, so a number inside an address becomes a phone mask.
    assert got[1] == "see <url> <phone> a b"
    assert got[2] == "mail me: <email> !"
    assert got[3] == "מחיר 12.5 טוב"
    assert got[4] == ""
    plain = apply(spark, texts[:2], lambda t: tx.cleaned(t, phones=False, urls=False, numbers=True, symbols=False, lowercase=False))
    assert plain[0] == "Call <NUM> - <NUM> - <NUM> NOW"


def test_short_numbers_are_not_phones(spark):
    texts = ["12345", "1 2 3", "a1234567", "1 2 3 4"]
    # Two digits need five characters between them, spaces included.
    assert apply(spark, texts, tx.cleaned) == ["12345", "1 2 3", "a1234567", "<phone>"]


def test_counts(spark):
    assert apply(spark, ["מה זה? למה? מתי?", "x"], tx.question_count) == [3, 0]
    assert apply(spark, ["שלום", "היי 🙂 מה", "👍 תודה 🙏 ok", "😀😀", "a漢"], tx.emoji_count) == [0, 1, 2, 1, 1]
    assert apply(spark, ["a😀😀"], tx.text_length) == [3]


def test_gender_slash(spark):
    texts = ["מעוניין/ת לשמוע", "לפני/אחרי", "א/ב", "x/y"]
    assert apply(spark, texts, tx.has_gender_slash) == [True, False, False, False]
    assert apply(spark, texts, lambda t: tx.has_gender_slash(t, strict=False)) == [True, True, True, False]


def test_word_ngrams(spark):
    got = apply(spark, ["The cat, a dog", "One", ""], lambda t: tx.word_ngrams(tx.word_tokens(t)))
    assert got == [["the", "cat", "dog", "the cat", "cat dog"], ["one"], []]


def test_char_ngrams_match_padded_words(spark):
    def expected(text):
        out = []
        for word in text.lower().split():
            padded = f" {word} "
            for n in range(2, min(4, len(padded)) + 1):
                out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
        return sorted(out)

    texts = ["I am here", "a", "", "שלום עולם"]
    assert [sorted(x) for x in apply(spark, texts, tx.char_ngrams)] == [expected(t) for t in texts]


def test_ids(spark):
    pattern = r"^he_sales_([0-9]{6})$"
    got = apply(spark, ["he_sales_000050", "he_sales_5", "x", ""], lambda t: tx.id_number(t, pattern))
    assert got == [50, None, None, None]
    assert apply(spark, ["300"], lambda t: tx.format_id(t.cast("long"), "he_sales_")) == ["he_sales_000300"]


def test_softmax_and_argmax(spark):
    rows = spark.createDataFrame([([1000.0, 1000.0],), ([0.0, 1.0],)], "x array<double>")
    got = rows.select(tx.softmax(F.col("x")).alias("p"), tx.argmax(F.col("x")).alias("k")).collect()
    assert got[0]["p"] == pytest.approx([0.5, 0.5]) and got[0]["k"] == 0
    assert got[1]["p"] == pytest.approx([0.268941, 0.731059], abs=1e-6) and got[1]["k"] == 1


def test_ratio_and_tag(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.25), (1.0, 4.0, 1.0)], "a double, b double, f double")
    got = rows.select(tx.ratio(F.col("a"), F.col("b")).alias("r"), tx.percent_tag(F.col("f")).alias("t")).collect()
    assert [(r["r"], r["t"]) for r in got] == [(0.0, "025pct"), (0.25, "100pct")]


def test_composition_holds_few_texts_at_once():
    import tracemalloc

    import pyarrow as pa

    texts = [None if k % 50 == 0 else ("e\u0301" if k % 2 else "e") * 2500 for k in range(4000)]
    column = pa.array(texts).slice(3)
    tracemalloc.start()
    got = tx._composed(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.type == column.type and peak < 8_000_000
    assert got.to_pylist() == [t if t is None else t.replace("e\u0301", "\u00e9") for t in texts[3:]]
    assert tx._composed(pa.array([], pa.string())).to_pylist() == [] and tx._composed(pa.array([None, ""])).to_pylist() == [None, ""]
