"""Pieces shared by the registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convsignals.functions.lexicon import LATIN
from convsignals.functions.text import EMOJI_RUN
from convsignals.schema import LABEL_MAPPING
from convsignals.sources import tables as tb

CLASSES = ["interested", "losing_interest"]
QUALITY_MAPPING = {"interested": ["1"], "losing_interest": ["0"]}
OUTCOME_MAPPING = LABEL_MAPPING


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so that summation order does not show; widen integers."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Adding 0 turns a negative zero into zero.
            out[f.name] = F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out[f.name] = F.col(f.name).cast("long")
    return df.withColumns(out)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return tb.turn_messages(tb.text_table(spark, folder, "conversations"))


def timed(spark: SparkSession, folder: str) -> DataFrame:
    return tb.timed_messages(tb.table(spark, folder, "events"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return tb.labelled_text(tb.text_table(spark, folder, "documents"), tb.table(spark, folder, "labels"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return tb.rule_predictions(tb.text_table(spark, folder, "documents"), tb.table(spark, folder, "labels"))


def sql_string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_class(column: str, mapping: dict[str, list[str]] = OUTCOME_MAPPING) -> str:
    arms = " ".join(
        f"WHEN {column} IN ({', '.join(map(sql_string, raws))}) THEN {sql_string(label)}"
        for label, raws in mapping.items()
    )
    return f"CASE {arms} END"


def _arms(pairs: dict[str, str]) -> str:
    return " ".join(f"WHEN {sql_string(k)} THEN {sql_string(v)}" for k, v in pairs.items())


# ------------------------------------------------------------- SQL table stubs
TURNS = """msgs AS (
  SELECT conv_id AS cid, turn AS pos, text, 0 AS delay,
    CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'business' ELSE role END AS role,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations)"""

TIMED = f"""msgs AS (
  SELECT user_id AS cid, event_id, ts, event_type, props AS text,
    row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n,
    CASE event_type {_arms(tb.EVENT_ROLE)} END AS role,
    coalesce(CAST(floor(date_diff('microsecond', lag(ts) OVER w, ts) / 60000000.0) AS BIGINT), 0) AS delay
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

OUTCOMES = f"""outcomes AS (
  SELECT user_id AS cid, CASE event_type {_arms(tb.EVENT_OUTCOME)} END AS final_outcome
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""

PREDICTIONS = """preds AS (
  SELECT m.model, doc_id AS conversation_id, fraction,
    CASE WHEN quality = 1 THEN 'interested' ELSE 'losing_interest' END AS actual_label,
    CASE WHEN size > cut THEN 'interested' ELSE 'losing_interest' END AS predicted_label,
    size / (size + cut) AS probability_interested,
    1 - size / (size + cut) AS probability_losing_interest,
    CASE WHEN (quality = 1) = (size > cut) THEN 1 ELSE 0 END AS correct
  FROM (SELECT l.doc_id, l.quality, f.fraction, CAST(ceil(d.n_chars * f.fraction) AS BIGINT) AS size
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id,
             (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) f(fraction)) s,
       (VALUES ('A', 1000.0::DOUBLE), ('B', 600.0)) m(model, cut))"""

_EMOJI_SQL = sql_string(EMOJI_RUN)
# The Latin pack stays inside what both regex engines read alike.
SIGNALS = {
    "message_length_chars": "length(text)",
    "question_count": "length(text) - length(replace(text, '?', ''))",
    "emoji_count": f"len(regexp_extract_all(text, {_EMOJI_SQL}))",
    "contains_price": (
        f"(regexp_matches(text, {sql_string(LATIN.amount)}) OR (regexp_matches(text, {sql_string(LATIN.price)})"
        f" AND NOT regexp_matches(text, {sql_string(LATIN.not_price)})))"
    ),
    "contains_negotiation": f"regexp_matches(text, {sql_string(LATIN.negotiation)})",
    "contains_objection": f"regexp_matches(text, {sql_string(LATIN.objection)})",
    "contains_commitment": f"regexp_matches(text, {sql_string(LATIN.commitment)})",
    "contains_delay_signal": (
        f"regexp_matches(regexp_replace(text, {sql_string(LATIN.moment)}, '', 'g'), {sql_string(LATIN.delay)})"
    ),
}
_SHORT = {
    "message_length_chars": "len",
    "question_count": "q",
    "emoji_count": "e",
    "contains_price": "price",
    "contains_negotiation": "neg",
    "contains_objection": "obj",
    "contains_commitment": "com",
    "contains_delay_signal": "dly",
}
SIGNALLED = (
    "sig AS (SELECT *, "
    + ", ".join(f"CAST({SIGNALS[k]} AS DOUBLE) AS {v}" for k, v in _SHORT.items())
    + " FROM msgs)"
)
UNSIGNALLED = (
    "sig AS (SELECT *, CAST(length(text) AS DOUBLE) AS len, "
    + ", ".join(f"0.0::DOUBLE AS {v}" for v in list(_SHORT.values())[1:])
    + " FROM msgs)"
)


def feature_sql(names: Sequence[str], size: str = "n") -> str:
    """Select list of features over ``sig`` rows; ``size`` is the length of the (prefix of the) conversation."""
    c, b = "role = 'customer'", "role = 'business'"
    fh = f"pos < {size} // 2"
    sh = f"pos >= {size} // 2"

    def z(x: str) -> str:
        return f"coalesce({x}, 0.0)"

    def f(agg: str, *where: str) -> str:
        return f"{agg} FILTER (WHERE {' AND '.join(where)})"

    nc, nb = f("count(*)", c), f("count(*)", b)

    def rate(x: str) -> str:
        return f"CASE WHEN {nc} = 0 THEN 0.0 ELSE {z(f(f'sum({x})', c))} / {nc} END"

    def last(x: str) -> str:
        return z(f(f"arg_max({x}, pos)", c))

    fl, sl = z(f("avg(len)", c, fh)), z(f("avg(len)", c, sh))
    fd, sd = z(f("avg(delay)", fh)), z(f("avg(delay)", sh))
    table = {
        "total_messages": "count(*)",
        "customer_messages": nc,
        "business_messages": nb,
        "ratio_customer_to_business": f"CASE WHEN {nb} = 0 THEN 0.0 ELSE {nc} / {nb} END",
        "mean_customer_msg_length": z(f("avg(len)", c)),
        "median_customer_msg_length": z(f("median(len)", c)),
        "std_customer_msg_length": z(f("stddev_samp(len)", c)),
        "min_customer_msg_length": z(f("min(len)", c)),
        "max_customer_msg_length": z(f("max(len)", c)),
        "total_customer_chars": z(f("sum(len)", c)),
        "total_customer_questions": z(f("sum(q)", c)),
        "total_customer_emojis": z(f("sum(e)", c)),
        "customer_price_mentions": z(f("sum(price)", c)),
        "customer_negotiation_mentions": z(f("sum(neg)", c)),
        "customer_objection_mentions": z(f("sum(obj)", c)),
        "customer_commitment_mentions": z(f("sum(com)", c)),
        "customer_delay_signals": z(f("sum(dly)", c)),
        "total_customer_bool_signals": z(f("sum(price + neg + obj + com + dly)", c)),
        "question_rate": rate("q"),
        "emoji_rate": rate("e"),
        "commitment_rate": rate("com"),
        "objection_rate": rate("obj"),
        "negotiation_rate": rate("neg"),
        "delay_signal_rate": rate("dly"),
        "mean_response_delay_customer": z(f("avg(delay)", c)),
        "median_response_delay_customer": z(f("median(delay)", c)),
        "max_response_delay_customer": z(f("max(delay)", c)),
        "mean_response_delay_business": z(f("avg(delay)", b)),
        "last_response_delay": "arg_max(delay, pos)",
        "session_count": "1 + count(*) FILTER (WHERE pos > 0 AND delay > 60)",
        "max_session_gap_minutes": z("max(delay) FILTER (WHERE pos > 0)"),
        "first_half_commitment_count": z(f("sum(com)", c, fh)),
        "first_half_objection_count": z(f("sum(obj)", c, fh)),
        "commitment_in_second_half": z(f("max(com)", c, sh)),
        "objection_in_second_half": z(f("max(obj)", c, sh)),
        "price_in_second_half": z(f("max(price)", c, sh)),
        "negotiation_in_second_half": z(f("max(neg)", c, sh)),
        "last_role_is_customer": "arg_max(CASE WHEN role = 'customer' THEN 1.0 ELSE 0.0 END, pos)",
        "last_customer_has_commitment": last("com"),
        "last_customer_has_objection": last("obj"),
        "last_customer_has_question": last("CASE WHEN q > 0 THEN 1.0 ELSE 0.0 END"),
        "last_customer_has_delay_signal": last("dly"),
        "last_customer_has_price": last("price"),
        "first_half_mean_customer_length": fl,
        "second_half_mean_customer_length": sl,
        "customer_length_change": f"{sl} - {fl}",
        "first_half_mean_response_delay": fd,
        "second_half_mean_response_delay": sd,
        "response_delay_change": f"{sd} - {fd}",
        "first_half_customer_message_count": f("count(*)", c, fh),
        "second_half_customer_message_count": f("count(*)", c, sh),
    }
    return ",\n  ".join(f"round(CAST({table[n]} AS DOUBLE), 6) AS {n}" for n in names)
