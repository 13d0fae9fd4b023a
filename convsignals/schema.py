"""Data model: schemas, fixed vocabularies and feature-name lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------- schemas
SIGNAL_FIELDS = [
    ("message_length_chars", T.IntegerType()),
    ("question_count", T.IntegerType()),
    ("emoji_count", T.IntegerType()),
    ("contains_price", T.BooleanType()),
    ("contains_negotiation", T.BooleanType()),
    ("contains_objection", T.BooleanType()),
    ("contains_commitment", T.BooleanType()),
    ("contains_delay_signal", T.BooleanType()),
]
SIGNAL_SCHEMA = T.StructType([T.StructField(n, t) for n, t in SIGNAL_FIELDS])
SIGNAL_NAMES = [n for n, _ in SIGNAL_FIELDS]
FLAG_NAMES = SIGNAL_NAMES[3:]

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("message_index", T.IntegerType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("response_delay_minutes", T.IntegerType()),
        T.StructField("interest_label", T.StringType()),
        T.StructField("interest_score", T.DoubleType()),
        T.StructField("behavioral_features", SIGNAL_SCHEMA),
        T.StructField("timestamp", T.StringType()),
    ]
)
METADATA_SCHEMA = T.StructType(
    [
        T.StructField("channel", T.StringType()),
        T.StructField("contains_personal_data", T.BooleanType()),
        T.StructField("quality_status", T.StringType()),
        T.StructField("generator_seed", T.LongType()),
    ]
)
CONVERSATION_SCHEMA = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("locale", T.StringType()),
        T.StructField("synthetic", T.BooleanType()),
        T.StructField("domain", T.StringType()),
        T.StructField("domain_he", T.StringType()),
        T.StructField("product_or_service", T.StringType()),
        T.StructField("customer_persona", T.StringType()),
        T.StructField("business_style", T.StringType()),
        T.StructField("interest_trajectory", T.StringType()),
        T.StructField("initial_interest_score", T.DoubleType()),
        T.StructField("final_interest_score", T.DoubleType()),
        T.StructField("final_outcome", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE_SCHEMA)),
        T.StructField("metadata", METADATA_SCHEMA),
    ]
)
FLAT_TEXT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)
PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("actual_label", T.StringType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("probability_interested", T.DoubleType()),
        T.StructField("probability_losing_interest", T.DoubleType()),
        T.StructField("correct", T.IntegerType()),
    ]
)

# ------------------------------------------------- fixed values: vocabularies
# These must equal the corpus format, word for word.
OUTCOMES = [
    "converted",
    "explicit_rejection",
    "ghosted",
    "appointment_set",
    "competitor_loss",
    "delivery_loss",
    "pending",
    "trust_loss",
    "reengaged_pending",
]
TRAJECTORY_OUTCOME = {
    "high_to_conversion": "converted",
    "high_to_price_rejection": "explicit_rejection",
    "high_to_ghosting": "ghosted",
    "high_to_delivery_loss": "delivery_loss",
    "high_to_trust_loss": "trust_loss",
    "medium_to_discount_conversion": "converted",
    "medium_to_competitor_loss": "competitor_loss",
    "medium_to_pending": "pending",
    "low_to_appointment": "appointment_set",
    "low_to_reengagement": "reengaged_pending",
}
TRAJECTORIES = list(TRAJECTORY_OUTCOME)
INTEREST_LABELS = [
    "interested",
    "high_interest",
    "uncertain",
    "losing_interest",
    "reengaged",
    "converted",
    "rejected",
    "not_applicable",
]
ROLES = ["customer", "business"]
LABEL_MAPPING = {
    "interested": ["converted", "appointment_set", "pending", "reengaged_pending"],
    "losing_interest": [
        "explicit_rejection",
        "competitor_loss",
        "delivery_loss",
        "trust_loss",
        "ghosted",
    ],
}
POSITIVE_CLASS = "losing_interest"
FRACTIONS = [0.25, 0.50, 0.75, 1.00]
SEPARATOR = " [SEP] "
LANGUAGE, LOCALE, CHANNEL = "he", "he-IL", "whatsapp"
ID_PREFIX = "he_sales_"
ID_PATTERN = r"^he_sales_([0-9]{6})$"
TIMESTAMP_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}$"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm"

# Fields derived from the target; never a model input.
FORBIDDEN_FIELDS = frozenset(
    [
        "interest_score",
        "interest_label",
        "final_interest_score",
        "initial_interest_score",
        "interest_trajectory",
        "final_outcome",
    ]
)

# ------------------------------------------------ fixed values: feature names
FEATURE_GROUPS = {
    "counts": [
        "total_messages",
        "customer_messages",
        "business_messages",
        "ratio_customer_to_business",
    ],
    "customer_length": [
        "mean_customer_msg_length",
        "median_customer_msg_length",
        "std_customer_msg_length",
        "min_customer_msg_length",
        "max_customer_msg_length",
        "total_customer_chars",
    ],
    "signal_totals": [
        "total_customer_questions",
        "total_customer_emojis",
        "customer_price_mentions",
        "customer_negotiation_mentions",
        "customer_objection_mentions",
        "customer_commitment_mentions",
        "customer_delay_signals",
        "total_customer_bool_signals",
    ],
    "signal_rates": [
        "question_rate",
        "emoji_rate",
        "commitment_rate",
        "objection_rate",
        "negotiation_rate",
        "delay_signal_rate",
    ],
    "response_time": [
        "mean_response_delay_customer",
        "median_response_delay_customer",
        "max_response_delay_customer",
        "mean_response_delay_business",
        "last_response_delay",
    ],
    "sessions": ["session_count", "max_session_gap_minutes"],
    "half_signals": [
        "first_half_commitment_count",
        "first_half_objection_count",
        "commitment_in_second_half",
        "objection_in_second_half",
        "price_in_second_half",
        "negotiation_in_second_half",
    ],
    "ending": [
        "last_role_is_customer",
        "last_customer_has_commitment",
        "last_customer_has_objection",
        "last_customer_has_question",
        "last_customer_has_delay_signal",
        "last_customer_has_price",
    ],
    "half_structure": [
        "first_half_mean_customer_length",
        "second_half_mean_customer_length",
        "customer_length_change",
        "first_half_mean_response_delay",
        "second_half_mean_response_delay",
        "response_delay_change",
        "first_half_customer_message_count",
        "second_half_customer_message_count",
    ],
}
FEATURES = [name for names in FEATURE_GROUPS.values() for name in names]
# Lexical features look at the words of a message; "last role" is structural.
LEXICAL_FEATURES = [
    name
    for group in ("signal_totals", "signal_rates", "half_signals", "ending")
    for name in FEATURE_GROUPS[group]
    if name != "last_role_is_customer"
]
PURE_FEATURES = [name for name in FEATURES if name not in set(LEXICAL_FEATURES)]


class DataError(ValueError):
    """The input breaks a rule that the caller must fix."""


def assert_no_leakage(df: DataFrame) -> DataFrame:
    """Refuse a feature table that still carries target-derived columns."""
    leaked = sorted(FORBIDDEN_FIELDS.intersection(df.columns))
    if leaked:
        raise DataError(f"target-derived columns may not be model inputs: {leaked}")
    return df


def in_canonical_order(df: DataFrame) -> DataFrame:
    """Reorder and cast the columns, nested fields included, by name; absent ones become null."""
    return df.to(CONVERSATION_SCHEMA)
