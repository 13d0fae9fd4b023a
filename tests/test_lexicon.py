import pytest
from pyspark.sql import functions as F

from convsignals.functions import lexicon as lx

CASES = [
    ("contains_price", "עלות ₪1,200", True),
    ("contains_price", 'זה עולה 350 ש"ח', True),
    ("contains_price", "350 ש״ח", True),
    ("contains_price", "מה המחיר שלכם?", True),
    ("contains_price", "ניפגש ב-9:00", False),
    ("contains_price", "הטלפון 050-123-4567", False),
    ("contains_price", "מחיר ביולי", False),
    ("contains_price", "בינואר זה 500 שקל", True),
    ("contains_negotiation", "יש הנחה?", True),
    ("contains_negotiation", "אפשר לפצל את התשלום", True),
    ("contains_negotiation", "כמה עולה השירות?", False),
    ("contains_objection", "זה יקר לי", True),
    ("contains_objection", "אני לא בטוח שזה בשבילי", True),
    ("contains_objection", "אין לנו את הזמן", True),
    ("contains_objection", "מה כלול?", False),
    ("contains_commitment", "בוא נסגור", True),
    ("contains_commitment", "קבענו פגישה ליום שני", True),
    ("contains_commitment", "אני מסכים", True),
    ("contains_commitment", "נראה מה יהיה", False),
    ("contains_delay_signal", "אחזור אליך מחר", True),
    ("contains_delay_signal", "נדבר אחרי החג", True),
    ("contains_delay_signal", "תן לי כמה ימים", True),
    ("contains_delay_signal", "רגע אחד בבקשה", False),
    ("contains_delay_signal", "רק רגע, צריך לבדוק", True),
    ("contains_delay_signal", "שולח עכשיו", False),
]


def test_hebrew_signals(spark):
    rows = spark.createDataFrame([(i, n, t, e) for i, (n, t, e) in enumerate(CASES)], "i int, n string, text string, e boolean")
    got = {r["i"]: r for r in lx.with_message_signals(rows).collect()}
    wrong = [CASES[i] for i, r in got.items() if r[CASES[i][0]] is not CASES[i][2]]
    assert wrong == []


def test_all_signals_of_one_message(spark):
    text = "היי 🙂 כמה עולה השירות? יש הנחה?"
    row = spark.createDataFrame([(text,)], "text string").select(lx.signals(F.col("text")).alias("s")).first()["s"]
    assert row["message_length_chars"] == len(text)
    assert (row["question_count"], row["emoji_count"]) == (2, 1)
    assert row["contains_price"] and row["contains_negotiation"]


@pytest.mark.parametrize("field", ["price", "negotiation", "objection", "commitment", "delay", "moment", "amount", "not_price"])
def test_pack_is_pluggable(spark, field):
    pack = lx.Lexicon(**{f: "$^" for f in lx.Lexicon.__dataclass_fields__} | {field: "zz"})
    row = lx.with_message_signals(spark.createDataFrame([("a zz b",)], "text string"), pack).first()
    hits = {n for n in ("contains_price", "contains_negotiation", "contains_objection", "contains_commitment", "contains_delay_signal") if row[n]}
    expected = {
        "price": {"contains_price"},
        "amount": {"contains_price"},
        "negotiation": {"contains_negotiation"},
        "objection": {"contains_objection"},
        "commitment": {"contains_commitment"},
        "delay": {"contains_delay_signal"},
    }
    assert hits == expected.get(field, set())
