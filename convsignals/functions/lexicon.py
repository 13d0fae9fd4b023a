"""Lexical signals of a message as column expressions over a pluggable pattern pack."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convsignals.functions import text as tx


@dataclass(frozen=True)
class Lexicon:
    """Regular expressions per signal; an empty pattern never matches."""

    price: str
    amount: str
    not_price: str
    negotiation: str
    objection: str
    commitment: str
    delay: str
    moment: str


_FLAGS = "(?iU)"
_EDGE_L, _EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# ------------------------------------------------------------ fixed values
# The Hebrew pack. These patterns must equal the corpus definition for equal flags.
HEBREW = Lexicon(
    price=_FLAGS
    + r"(?:ש[\"״]ח|₪|שקל|שקלים|אלף\s*ש|"
    r"מחיר|עלות|עלה|עולה|תמחור|תשלום|תשלומים|"
    r"מקדמה|מקדמות|תשלום\s*ראשון|"
    r"הנחה|הנחות|הוזלה|"
    r"חבילה|חבילות|"
    r"תקציב|"
    r"כמה\s*(?:זה|עולה|עול|עלה|תעלה|יעלה|עולים))",
    amount="(?U)"
    + r"(?:\d[\d,\.]*\s*(?:ש[\"״]ח|₪|שקל|שקלים|אלף|k|K)|"
    r"(?:₪|ש[\"״]ח)\s*\d[\d,\.]*)",
    not_price="(?U)(?:"
    + _EDGE_L
    + r"(?:0[89]\d{1,}-?\d{3,}|\d{2,4}-\d{3,4}-\d{3,4})"
    + _EDGE_R
    + r"|(?:ינואר|פברואר|מרץ|אפריל|מאי|יוני|יולי|אוגוסט|ספטמבר|אוקטובר|נובמבר|דצמבר))",
    negotiation=_FLAGS
    + r"(?:הנחה|להוריד\s*(?:את\s*)?המחיר|הוזלה|"
    r"הצעת\s*מחיר\s*(?:אחרת|יותר\s*טובה)|"
    r"מתחרה|הצעה\s*(?:יותר\s*)?(?:זולה|טובה)\s*(?:מ|ממקום|ממתחרה)|"
    r"לפצל\s*(?:את\s*)?התשלום|תשלומים\s*(?:נוספים|גמישים)|"
    r"להוריד\s*(?:מ|מה)(?:חבילה|שירות)|"
    r"להסיר\s*(?:מ|מה)(?:חבילה|שירות)|"
    r"בלי\s+(?:ה)?(?:אחריות|התקנה|הובלה|שירות\s*נוסף)|"
    r"קיבלתי\s*(?:הצעה|מחיר)\s*(?:יותר\s*)?(?:טובה|זולה|נמוכה)|"
    r"מציעים\s*לי\s*(?:פחות|יותר\s*זול)|"
    r"ניתן\s*(?:להוריד|לשנות|לצמצם))",
    objection=_FLAGS
    + r"(?:יקר\s*(?:לי|מדי|מאוד)?|"
    r"לא\s+(?:בטוח|בטוחה|בטוחים|מוכן|מוכנה|מוכנים)\s*(?:ש|ל|ב)|"
    r"לא\s+(?:מתאים|מתאימה|מתאים\s*לי)|"
    r"לא\s+(?:בהכרח|כל\s*כך|ממש)\s*צריך|"
    r"מהסס|מהססת|מהססים|"
    r"לא\s+(?:יודע|יודעת|בטוח|בטוחה)\s*אם|"
    r"קצת\s+(?:מפחד|מפחדת|חושש|חוששת|מודאג|מודאגת)|"
    r"לא\s+(?:ממהר|ממהרת|דחוף\s*לי)|"
    r"נשמע\s+(?:הרבה|יקר|מסובך|מורכב|גדול)|"
    r"צריך\s+(?:לחשוב|לבדוק|לשאול)|"
    r"(?:פחות|לא)\s+(?:מתאים|מתאימה)\s+לי|"
    r"אין\s+(?:לי|לנו)\s+(?:את\s+)?(?:התקציב|הכסף|הזמן)|"
    r"(?:פחות|לא\s*)(?:בדחיפות|דחוף\s+לי)|"
    r"מתלבט|מתלבטת|"
    r"עדיין\s+לא\s+(?:החלטתי|החלטנו)|"
    r"יש\s+לי\s+(?:ספקות|חששות|שאלות))",
    commitment=_FLAGS
    + r"(?:(?:נ)?(?:סגור|נסגור|נסגרנו|סגרנו)|"
    r"(?:מ)?(?:אשר|מאשר|מאשרת|מאושר)\s*(?:את\s*ה)?(?:הצעה|עסקה|קנייה|הזמנה)|"
    r"(?:אני\s+)?(?:שו)?(?:לח|שולח|שולחת)\s*(?:לך\s*)?(?:את\s*)?(?:הפרטים|המסמכים|הסכם|התשלום|מקדמה)|"
    r"(?:מ)?(?:זמין|זמינה|מזמין|מזמינה)\s*(?:אותך|עכשיו)|"
    r"(?:נ)?(?:קבע|נקבע|קבענו)\s*(?:פגישה|תור|ביקור|פגישת\s*הכרות|זמן)|"
    r"(?:אני\s+)?(?:מ)?(?:אשלם|שולם|אשלח\s*תשלום)|"
    r"בוא\s+(?:נ)?(?:סגור|נתקדם|נקבע)|"
    r"אני\s+(?:מ)?(?:סכים|סכימה|לוקח|לוקחת)|"
    r"(?:ה)?הזמנה\s*(?:שלי\s*)?(?:מאושרת|נשלחה|נשלח)|"
    r"(?:ה)?(?:תור|פגישה)\s*(?:מ)?(?:אושר|נקבע|עומד))",
    delay=_FLAGS
    + r"(?:(?:אח)?(?:זור|אחזור|נחזור)\s*אליך?\s*(?:מחר|בקרוב|בשבוע|בימים\s*הקרובים)|"
    r"(?:אני\s+)?(?:צריך|צריכה|נצטרך)\s+(?:לבדוק|לשאול|לחשוב|להתייעץ|לדבר)|"
    r"(?:נ)?(?:דבר|נדבר)\s*(?:אחרי|לאחר|עם\s*סיום|אחרי\s+(?:ה)?חג|אחרי\s+(?:ה)?חגים|בשבוע\s+הבא|בחודש\s+הבא)|"
    r"(?:תן|תני)\s*לי\s*(?:כמה\s*)?(?:יום|ימים|שעות|זמן|לחשוב)|"
    r"(?:אני\s+)?(?:ממ)?(?:תן|מחכה|מחכה\s+לתשובה)\s+(?:מ(?:ה)?|ל(?:ה)?)?(?:מנהל|שותף|אישה|בעל|הורים)|"
    r"(?:ה)?חג(?:ים)?\s+(?:מפריע|קצת\s+מפריע|עובר|עובד)|"
    r"אחרי\s+(?:ה)?(?:חופש|חג|קיץ|חגים)|"
    r"(?:ב)?(?:שבוע|חודש|שנה)\s+(?:הבא|הבאה)|"
    r"(?:בהמשך|בהמשך\s+השבוע|מאוחר\s+יותר)|"
    r"(?:תציי)?(?:ן|נ)?\s*(?:לי|לנו)\s*(?:כמה\s*)?(?:ימים?|זמן)|"
    r"לא\s+(?:ממהר|ממהרת)\s+(?:לרגע|כרגע))",
    moment=_FLAGS + r"(?:רגע\s+(?:אחד|אחד\s+בבקשה)|רק\s+רגע|חכה\s+רגע|שניה)",
)
# Short answers that are never treated as duplicates.
SHORT_REPLIES = ["כן", "לא", "תודה", "אוקיי", "אוק", "בסדר", "ממש לא"]
# Service questions that do not fit domains without a home visit or a product.
SERVICE_PHRASES = [
    "ביטוח על העבודה",
    "צוות קבוע",
    "מי בדיוק מגיע",
    "צריך להיות בבית",
    "הגעת טכנאי",
    "עלות נוספת על הובלה",
    "אחריות על העבודה",
]
HOME_DOMAINS = [
    "cleaning",
    "pest_control",
    "air_conditioning",
    "electrical",
    "plumbing",
    "construction",
    "solar",
    "home_renovation",
    "moving",
    "storage",
    "interior_design",
    "car_service",
]
PRODUCT_DOMAINS = ["furniture", "electronics", "kitchens", "pet_store"]

# A pack for Latin-script corpora: function words of English, French, German and Spanish.
LATIN = Lexicon(
    price=r"(?i)(^|[^a-z])(with|avec|mit|con)([^a-z]|$)",
    amount=r"[0-9]+",
    not_price=r"(?i)(^|[^a-z])(was|par|sch|por)([^a-z]|$)",
    negotiation=r"(?i)(^|[^a-z])(that|que|und)([^a-z]|$)",
    objection=r"(?i)(^|[^a-z])(on|un|nicht|no)([^a-z]|$)",
    commitment=r"(?i)(^|[^a-z])(for|pour|der|para)([^a-z]|$)",
    delay=r"(?i)(^|[^a-z])(by|des|die|los)([^a-z]|$)",
    moment=r"(?i)(^|[^a-z])(by the|des le|die der)([^a-z]|$)",
)


def contains_price(text: Column, lex: Lexicon) -> Column:
    amount = text.rlike(lex.amount)
    return amount | (text.rlike(lex.price) & ~text.rlike(lex.not_price))


def contains_delay(text: Column, lex: Lexicon) -> Column:
    return F.regexp_replace(text, lex.moment, "").rlike(lex.delay)


def signal_columns(text: Column, lex: Lexicon = HEBREW) -> dict[str, Column]:
    return {
        "message_length_chars": tx.text_length(text),
        "question_count": tx.question_count(text),
        "emoji_count": tx.emoji_count(text),
        "contains_price": contains_price(text, lex),
        "contains_negotiation": text.rlike(lex.negotiation),
        "contains_objection": text.rlike(lex.objection),
        "contains_commitment": text.rlike(lex.commitment),
        "contains_delay_signal": contains_delay(text, lex),
    }


def signals(text: Column, lex: Lexicon = HEBREW) -> Column:
    """All signals of one message as a struct."""
    return F.struct(*[c.alias(n) for n, c in signal_columns(text, lex).items()])


def with_message_signals(messages: DataFrame, lex: Lexicon = HEBREW, text: str = "text") -> DataFrame:
    """Add the eight signal columns; a narrow projection."""
    return messages.withColumns(signal_columns(F.col(text), lex))
