"""Queries on messages, prefixes, signals and behavioral features."""

from __future__ import annotations

from pyspark.sql import functions as F

from convsignals import schema as S
from convsignals.functions import lexicon as lx
from convsignals.functions import text as tx
from convsignals.operators import behavior as bh
from convsignals.operators import conversation as cv
from convsignals.operators import labels as lb
from convsignals.operators import profile as pf
from convsignals.operators import standardize as st
from convsignals.plans.catalog import common as c
from convsignals.session import stored
from convsignals.sources import tables as tb

SUMMARY_FEATURES = [
    "total_messages",
    "customer_messages",
    "business_messages",
    "ratio_customer_to_business",
    "mean_response_delay_customer",
    "median_response_delay_customer",
    "max_response_delay_customer",
    "mean_response_delay_business",
    "session_count",
    "max_session_gap_minutes",
]


def session_outcome_summary(spark, folder):
    features = bh.behavioral_features(c.timed(spark, folder), SUMMARY_FEATURES)
    outcomes = tb.event_outcomes(tb.table(spark, folder, "events"))
    label = lb.class_of(F.col("final_outcome"), c.OUTCOME_MAPPING)
    joined = features.join(outcomes, "conversation_id")
    return c.rounded(
        joined.groupBy(label.alias("label")).agg(
            F.count(F.lit(1)).alias("n_conversations"),
            *[F.avg(n).alias(f"avg_{n}") for n in SUMMARY_FEATURES],
        )
    )


def timed_messages(spark, folder):
    m = c.timed(spark, folder)
    return c.rounded(m.select("conversation_id", "pos", "n", "role", "response_delay_minutes", "event_id"))


def message_sessions(spark, folder):
    m = bh.session_numbers(c.timed(spark, folder))
    return c.rounded(m.select("conversation_id", "pos", "response_delay_minutes", "session"))


def conversation_text(spark, folder):
    text = cv.conversation_text(c.turns(spark, folder))
    return c.rounded(text.withColumn("chars", F.length("text")))


def prefix_text(spark, folder):
    return c.rounded(cv.prefix_text(c.turns(spark, folder)))


def prefix_stats(spark, folder):
    return c.rounded(cv.prefix_statistics(cv.prefix_text(c.turns(spark, folder))))


def message_signals(spark, folder):
    m = lx.with_message_signals(c.turns(spark, folder), lx.LATIN)
    return c.rounded(m.select("conversation_id", "pos", *S.SIGNAL_NAMES))


def document_signals(spark, folder):
    docs = tb.text_table(spark, folder, "documents")
    return c.rounded(lx.with_message_signals(docs, lx.LATIN).select("doc_id", *S.SIGNAL_NAMES))


def behavior_features_text(spark, folder):
    m = lx.with_message_signals(c.turns(spark, folder), lx.LATIN)
    return c.rounded(bh.behavioral_features(m))


def _with_length(messages):
    return messages.withColumn("message_length_chars", F.length("text"))


def behavior_features_timing(spark, folder):
    return c.rounded(bh.behavioral_features(_with_length(c.timed(spark, folder)), S.PURE_FEATURES))


def prefix_behavior_features(spark, folder):
    return c.rounded(bh.prefix_features(_with_length(c.timed(spark, folder))))


def feature_statistics(spark, folder):
    features = stored(bh.behavioral_features(_with_length(c.timed(spark, folder)), S.PURE_FEATURES))
    return c.rounded(pf.feature_statistics(features, S.PURE_FEATURES))


SCALED = S.PURE_FEATURES


def standardized_features(spark, folder):
    features = bh.behavioral_features(_with_length(c.timed(spark, folder)), SCALED)
    train = F.substring(F.md5(F.col("conversation_id").cast("string")), 1, 1) < "b"
    rows = features.withColumn("split", F.when(train, "train").otherwise("test"))
    return c.rounded(st.standardized(rows, SCALED))


def normalize_text(spark, folder):
    docs = tb.text_table(spark, folder, "documents")
    return docs.select("doc_id", tx.normalized(F.col("text")).alias("norm"))


def clean_text(spark, folder):
    docs = tb.text_table(spark, folder, "documents")
    return docs.select("doc_id", tx.cleaned(F.col("text"), phones=False, numbers=True).alias("cleaned"))


def clean_pages(spark, folder):
    pages = tb.text_table(spark, folder, "pages")
    both = F.concat_ws(" ", "url", "html")
    return pages.select("page_id", tx.cleaned(both, phones=False).alias("cleaned"))


def clean_text_phones(spark, folder):
    docs = tb.text_table(spark, folder, "documents")
    return docs.select("doc_id", tx.cleaned(F.col("text")).alias("cleaned"))


def json_props(spark, folder):
    events = tb.table(spark, folder, "events")
    return events.select(
        "event_id",
        cv.json_field(F.col("props"), "k").cast("long").alias("k"),
        cv.json_field(F.col("props"), "a.b").alias("missing"),
    )


def final_scores(spark, folder):
    """Value of the user's last customer-side event as the final score."""
    m = c.timed(spark, folder).join(tb.table(spark, folder, "events").select("event_id", "value"), "event_id")
    return c.rounded(cv.last_customer_score(m.withColumnRenamed("value", "interest_score")))


def char_ngram_counts(spark, folder):
    docs = tb.table(spark, folder, "benchmark")
    terms = docs.select(F.explode(tx.char_ngrams(F.col("text"))).alias("gram"))
    return terms.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def class_probabilities(spark, folder):
    """Softmax and argmax over all embedding values as logits; the probabilities in order, six digits each."""
    rows = tb.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("logits"))
    rows = rows.withColumn("p", tx.softmax(F.col("logits")))
    rows = rows.select("vec_id", F.posexplode("p").alias("class_id", "probability"), tx.argmax(F.col("logits")).alias("predicted"))
    return c.rounded(rows)


QUERIES = {
    f.__name__: f
    for f in [
        session_outcome_summary,
        timed_messages,
        message_sessions,
        conversation_text,
        prefix_text,
        prefix_stats,
        message_signals,
        document_signals,
        behavior_features_text,
        behavior_features_timing,
        prefix_behavior_features,
        feature_statistics,
        standardized_features,
        normalize_text,
        clean_text,
        clean_pages,
        clean_text_phones,
        json_props,
        final_scores,
        char_ngram_counts,
        class_probabilities,
    ]
}

_FEATURES_TIMED = f"WITH {c.TIMED}, {c.UNSIGNALLED}"
_PURE = c.feature_sql(S.PURE_FEATURES)
_FRACTIONS = "(VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) f(fraction)"
_PREFIX = f"""WITH {c.TURNS},
p AS (SELECT *, greatest(1, CAST(ceil(n * fraction) AS BIGINT)) AS plen FROM msgs, {_FRACTIONS}),
t AS (SELECT cid AS conversation_id, fraction,
  coalesce(string_agg(text, ' [SEP] ' ORDER BY pos) FILTER (WHERE role = 'customer' AND text <> ''), '') AS text,
  max(plen) AS n_total, count(*) FILTER (WHERE role = 'customer' AND text <> '') AS n_customer
  FROM p WHERE pos < plen GROUP BY cid, fraction)"""
_SIGNAL_LIST = ", ".join(f"{sql} AS {name}" for name, sql in c.SIGNALS.items())


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_NORM = (
    r"translate(regexp_replace(nfc_normalize(" + _strip("text") + r"), '\s+', ' ', 'g'), '“”‘’״׳', '""''''\"''')"
)
_NORM = _NORM.replace('\\"', '"')


def clean_sql(x: str, numbers: bool) -> str:
    x = rf"regexp_replace({x}, '(?i)(https?://\S+|www\.\S+)', ' <URL> ', 'g')"
    x = rf"regexp_replace({x}, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+', ' <EMAIL> ', 'g')"
    if numbers:
        x = rf"regexp_replace({x}, '\p{{Nd}}+(?:\.\p{{Nd}}+)?', ' <NUM> ', 'g')"
    x = rf"""regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s.,!?;:''"\-()<>\[\]]', ' ', 'g')"""
    return _strip(rf"regexp_replace(lower({x}), '\s+', ' ', 'g')")


NORM_SQL = _strip(f"regexp_replace({_NORM}, '[.!,;:]+$', '')")

ORACLES = {
    "session_outcome_summary": f"""{_FEATURES_TIMED}, {c.OUTCOMES},
feats AS (SELECT cid, {c.feature_sql(SUMMARY_FEATURES).replace("round(", "(").replace(", 6)", ")")} FROM sig GROUP BY cid)
SELECT {c.sql_class("final_outcome")} AS label, count(*) AS n_conversations,
  {", ".join(f"round(avg({n}), 6) AS avg_{n}" for n in SUMMARY_FEATURES)}
FROM feats JOIN outcomes USING (cid) GROUP BY 1""",
    "timed_messages": f"""WITH {c.TIMED}
SELECT cid AS conversation_id, pos, n, role, delay AS response_delay_minutes, event_id FROM msgs""",
    "message_sessions": f"""WITH {c.TIMED}
SELECT cid AS conversation_id, pos, delay AS response_delay_minutes,
  CAST(1 + sum(CASE WHEN pos > 0 AND delay > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY cid ORDER BY pos
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM msgs""",
    "conversation_text": f"""WITH {c.TURNS},
t AS (SELECT cid AS conversation_id, coalesce(string_agg(text, ' [SEP] ' ORDER BY pos)
  FILTER (WHERE role = 'customer' AND text <> ''), '') AS text FROM msgs GROUP BY cid)
SELECT conversation_id, text, length(text) AS chars FROM t""",
    "prefix_text": f"{_PREFIX} SELECT * FROM t",
    "prefix_stats": f"""{_PREFIX}
SELECT fraction, count(*) AS n_conversations, round(avg(n_total), 6) AS avg_total_msgs,
  round(avg(n_customer), 6) AS avg_customer_msgs,
  round(avg(CASE WHEN n_customer = 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_zero_customer,
  round(avg(CASE WHEN length(text) / 1.7 + 2 > 512 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_truncated
FROM t GROUP BY fraction""",
    "message_signals": f"WITH {c.TURNS} SELECT cid AS conversation_id, pos, {_SIGNAL_LIST} FROM msgs",
    "document_signals": f"SELECT doc_id, {_SIGNAL_LIST} FROM documents",
    "behavior_features_text": f"""WITH {c.TURNS}, {c.SIGNALLED}
SELECT cid AS conversation_id, {c.feature_sql(S.FEATURES)} FROM sig GROUP BY cid""",
    "behavior_features_timing": f"{_FEATURES_TIMED} SELECT cid AS conversation_id, {_PURE} FROM sig GROUP BY cid",
    "prefix_behavior_features": f"""{_FEATURES_TIMED},
p AS (SELECT *, greatest(1, CAST(ceil(n * fraction) AS BIGINT)) AS plen FROM sig, {_FRACTIONS})
SELECT cid AS conversation_id, fraction, {c.feature_sql(S.PURE_FEATURES, "plen")}
FROM p WHERE pos < plen GROUP BY cid, fraction""",
    "feature_statistics": f"""{_FEATURES_TIMED},
feats AS (SELECT cid, {_PURE.replace("round(", "(").replace(", 6)", ")")} FROM sig GROUP BY cid),
long AS (UNPIVOT feats ON {", ".join(S.PURE_FEATURES)} INTO NAME feature VALUE value)
SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min,
  round(max(value), 6) AS max, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75
FROM long GROUP BY feature""",
    "standardized_features": f"""{_FEATURES_TIMED},
feats AS (SELECT cid, {c.feature_sql(SCALED).replace("round(", "(").replace(", 6)", ")")} FROM sig GROUP BY cid),
s AS (SELECT *, CASE WHEN substr(md5(CAST(cid AS VARCHAR)), 1, 1) < 'b' THEN 'train' ELSE 'test' END AS split FROM feats),
m AS (SELECT {", ".join(f"avg({n}) AS m_{n}, CASE WHEN stddev_pop({n}) > 1e-12 THEN stddev_pop({n}) ELSE 1.0 END AS s_{n}" for n in SCALED)}
  FROM s WHERE split = 'train')
SELECT cid AS conversation_id, split, {", ".join(f"round(({n} - m_{n}) / s_{n}, 6) AS {n}" for n in SCALED)} FROM s, m""",
    "normalize_text": f"SELECT doc_id, {NORM_SQL} AS norm FROM documents",
    "clean_text": f"SELECT doc_id, {clean_sql('text', True)} AS cleaned FROM documents",
    "clean_pages": f"""SELECT page_id, {clean_sql("(url || ' ' || html)", False)} AS cleaned FROM pages""",
    "json_props": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  json_extract_string(props, '$.a.b') AS missing FROM events""",
    "final_scores": f"""WITH {c.TIMED}
SELECT cid AS conversation_id, round(arg_max(value, pos) FILTER (WHERE role = 'customer'), 6) AS final_interest_score
FROM msgs JOIN events USING (event_id) GROUP BY cid""",
    "char_ngram_counts": r"""WITH words AS (
  SELECT unnest(regexp_split_to_array(trim(lower(text)), '\s+')) AS w FROM benchmark),
padded AS (SELECT ' ' || w || ' ' AS p FROM words WHERE w <> ''),
sized AS (SELECT p, unnest(range(2, least(4, length(p)) + 1)) AS n FROM padded),
grams AS (SELECT substr(p, i, n) AS gram FROM (SELECT p, n, unnest(range(1, length(p) - n + 2)) AS i FROM sized))
SELECT gram, count(*) AS n FROM grams GROUP BY gram""",
    "class_probabilities": """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a,
  unnest(range(len(embedding))) AS class_id FROM embeddings),
y AS (SELECT *, sum(exp(a)) OVER v AS total, arg_max(class_id, struct_pack(a := a, k := -class_id)) OVER v AS predicted
  FROM x WINDOW v AS (PARTITION BY vec_id))
SELECT vec_id, class_id, round(exp(a) / total, 6) AS probability, predicted FROM y""",
}
