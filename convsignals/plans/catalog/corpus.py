"""Queries on corpus profile, quality, validation, duplicates and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from convsignals import schema as S
from convsignals.functions import lexicon as lx
from convsignals.functions import text as tx
from convsignals.operators import duplicates as dp
from convsignals.operators import profile as pf
from convsignals.operators import quality as ql
from convsignals.operators import similarity as sm
from convsignals.operators import tfidf as tf
from convsignals.operators import validate as vl
from convsignals.operators.conversation import explode_messages
from convsignals.plans import corpus_build
from convsignals.plans.catalog import common as c
from convsignals.plans.catalog.messages import NORM_SQL
from convsignals.session import stored
from convsignals.sources import tables as tb


def _documents(spark, folder):
    return tb.text_table(spark, folder, "documents")


# ------------------------------------------------------------------- profile
def distributions(spark, folder):
    docs = _documents(spark, folder).join(tb.table(spark, folder, "labels"), "doc_id", "left")
    return pf.distributions(docs, ["lang", "source", "quality", "toxic"])


def top_sources(spark, folder):
    return pf.top_values(pf.distributions(_documents(spark, folder), ["source"]), 10)


def id_counts(spark, folder):
    """Turns by conversation id: every id of a longer conversation repeats."""
    return pf.id_counts(tb.text_table(spark, folder, "conversations"), "conv_id")


def length_percentiles(spark, folder):
    return c.rounded(pf.length_profile(stored(pf.conversation_sizes(c.turns(spark, folder)))))


def truncation_shares(spark, folder):
    return c.rounded(pf.truncation_shares(pf.conversation_sizes(c.turns(spark, folder))))


def document_percentiles(spark, folder):
    """Nearest-rank percentiles of document length."""
    from convsignals.operators.percentiles import exact_percentiles

    rows = _documents(spark, folder).select(F.lit("n_chars").alias("measure"), F.col("n_chars").cast("double").alias("value"))
    return c.rounded(exact_percentiles(rows, "measure", "value", pf.LENGTH_FRACTIONS, "nearest"))


# ------------------------------------------------------------------- quality
def repeated_messages(spark, folder):
    return ql.repeated(_documents(spark, folder))


def message_totals(spark, folder):
    return c.rounded(ql.message_totals(_documents(spark, folder)))


def opening_closing(spark, folder):
    return ql.openings(c.turns(spark, folder))


def repeated_openings(spark, folder):
    """Opening event types of users that several users share."""
    m = c.timed(spark, folder).withColumn("text", F.col("event_type"))
    return ql.repeated(ql.openings(m), "opening")


PHRASES = ["with the", "that the", "de la", "que le", "und der", "en el", "the of"]
EXEMPT = ["de", "es"]


def misplaced_phrases(spark, folder):
    docs = _documents(spark, folder).withColumn("text", F.lower("text"))
    return ql.misplaced_phrases(docs, PHRASES, EXEMPT, "lang").select("doc_id", "lang", "phrase")


def phrase_hits(spark, folder):
    docs = _documents(spark, folder).withColumn("text", F.lower("text"))
    return ql.phrase_hits(docs, PHRASES).select("doc_id", "phrase")


def new_batch(spark, folder):
    docs = _documents(spark, folder).withColumn(
        "conversation_id", F.format_string("%s_%06d", F.col("source"), F.col("doc_id"))
    )
    return ql.new_batch(docs, 500).select("conversation_id", "lang")


def _with_ids(spark, folder):
    return tb.table(spark, folder, "labels").select(
        tx.format_id(F.col("doc_id"), S.ID_PREFIX).alias("conversation_id")
    )


def max_id(spark, folder):
    return ql.max_id(_with_ids(spark, folder))


def allocated_ids(spark, folder):
    batch = tb.table(spark, folder, "benchmark").select("item_id")
    return ql.allocate_ids(batch, _with_ids(spark, folder), "item_id")


def recent_message_sample(spark, folder):
    return c.rounded(ql.recent_message_sample(c.turns(spark, folder)))


PRICES = {"view": (0.1, 0.2), "click": (0.2, 0.4), "err": (1.0, 2.0)}


def run_costs(spark, folder):
    """Events priced as runs: name = event type, tokens in = value, tokens out = property k."""
    events = tb.table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("model"),
        (F.col("value") * 1000).alias("input_tokens"),
        (F.get_json_object("props", "$.k").cast("double") * 1000).alias("output_tokens"),
    )
    return c.rounded(ql.run_cost(events, PRICES).select("event_id", "cost_usd"))


def _attributes(spark, folder):
    """Domain, trajectory and outcome stand-ins of each conversation, from its first turn."""
    m = c.turns(spark, folder)
    first = m.groupBy("conversation_id").agg(F.min_by("text", "pos").alias("opening"))
    vowels = F.regexp_count(F.col("opening"), F.lit("[aeiou]"))
    return first.select(
        "conversation_id",
        F.concat(F.lit("domain"), (vowels % 5).cast("string")).alias("domain"),
        F.element_at(F.array(*[F.lit(t) for t in S.TRAJECTORIES]), (F.length("opening") % 10 + 1).cast("int")).alias(
            "interest_trajectory"
        ),
    ).withColumn("final_outcome", tb.mapped(F.col("interest_trajectory"), S.TRAJECTORY_OUTCOME))


def structure_signatures(spark, folder):
    signed = pf.signatures(c.turns(spark, folder), _attributes(spark, folder))
    return pf.signature_counts(signed)


def coverage_gaps(spark, folder):
    """Source and language strata that are rare; absent combinations count 0."""
    docs = _documents(spark, folder)
    langs = F.explode(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es", "it")]))
    options = docs.select("source").distinct().withColumn("lang", langs)
    options = options.select(F.concat_ws(":", "source", "lang").alias("stratum"))
    counts = docs.groupBy(F.concat_ws(":", "source", "lang").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return pf.underrepresented(options, counts, "stratum")


def unused_combinations(spark, folder):
    used = _attributes(spark, folder).select(
        "domain", F.lit("any").alias("product"), F.col("interest_trajectory").alias("trajectory")
    )
    catalog = used.select("domain", "product").distinct()
    return pf.unused_combinations(catalog, used).select("domain", "trajectory")


def combined_sources(spark, folder):
    """Bag union of two text tables."""
    docs = _documents(spark, folder).select(F.col("doc_id").alias("id"), "text")
    items = tb.table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    both = docs.unionByName(items)
    return both.select("id", F.length("text").cast("long").alias("chars"))


# ---------------------------------------------------------------- validation
def turn_violations(spark, folder):
    v = vl.turn_violations(c.turns(spark, folder))
    return c.rounded(v.drop("detail"))


def turn_validation_summary(spark, folder):
    m = c.turns(spark, folder)
    ids = m.select("conversation_id").distinct()
    return vl.validation_summary(ids, vl.turn_violations(m))


def _nested(spark, folder):
    """Turns as nested conversations with the remaining fields filled in."""
    m = c.turns(spark, folder)
    message = F.struct(
        F.col("pos").alias("message_index"),
        "role",
        "text",
        F.lit(5).alias("response_delay_minutes"),
        F.when(F.col("role") == "business", "not_applicable").otherwise("interested").alias("interest_label"),
        F.lit(None).cast("double").alias("interest_score"),
        lx.signals(F.col("text"), lx.LATIN).alias("behavioral_features"),
        F.format_string("2024-01-01T10:%02d", (F.col("pos") * 4).cast("int")).alias("timestamp"),
    )
    nested = m.groupBy("conversation_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    a = _attributes(spark, folder)
    full = nested.join(a, "conversation_id")
    return full.select(
        tx.format_id(F.col("conversation_id"), S.ID_PREFIX).alias("conversation_id"),
        *[F.lit("x").alias(n) for n in ("source_dataset", "domain_he", "product_or_service", "customer_persona", "business_style")],
        F.lit("he").alias("language"),
        F.lit("he-IL").alias("locale"),
        F.lit(True).alias("synthetic"),
        "domain",
        "interest_trajectory",
        F.lit(0.5).alias("initial_interest_score"),
        F.lit(0.5).alias("final_interest_score"),
        F.lit("converted").alias("final_outcome"),
        "messages",
        F.struct(
            F.lit("whatsapp").alias("channel"),
            F.lit(False).alias("contains_personal_data"),
            F.lit("ok").alias("quality_status"),
            F.lit(1).cast("long").alias("generator_seed"),
        ).alias("metadata"),
    )


def nested_violations(spark, folder):
    """All rules over conversations rebuilt from the turns, Latin letters as the script."""
    return vl.rule_counts(vl.violations(_nested(spark, folder), letters="[A-Za-z]"))


# ---------------------------------------------------------------- duplicates
def _normed_documents(spark, folder):
    return dp.with_norm(_documents(spark, folder).withColumn("conversation_id", F.col("doc_id")))


def exact_duplicates(spark, folder):
    """Documents equal to an earlier one after normalization."""
    rows = _normed_documents(spark, folder)
    matched = dp.exact_matches(rows, dp.message_index(rows), "doc_id")
    return matched.where("owner <> doc_id").select("doc_id", "owner")


def phrase_frequencies(spark, folder):
    return pf.top_values(dp.phrase_counts(_normed_documents(spark, folder)), 20, tie="norm")


def in_conversation_repeats(spark, folder):
    """Documents of one source as the messages of a conversation."""
    rows = dp.with_norm(
        _documents(spark, folder).select(F.col("source").alias("conversation_id"), F.col("doc_id").alias("pos"), "text")
    )
    return dp.repeats(rows).select("conversation_id", "pos")


def turn_fuzzy_matches(spark, folder):
    """Best fuzzy match of every distinct turn text among all turns of the corpus."""
    index = dp.message_index(dp.with_norm(c.turns(spark, folder)))
    return c.rounded(dp.best_fuzzy_matches(index, index, same=True))


def fuzzy_matches(spark, folder):
    """Best fuzzy match of every distinct document text among all documents."""
    index = dp.message_index(_normed_documents(spark, folder))
    return c.rounded(dp.best_fuzzy_matches(index, index, same=True))


def benchmark_matches(spark, folder):
    """Benchmark items as a new batch against all documents."""
    items = tb.table(spark, folder, "benchmark").withColumn("conversation_id", F.col("item_id"))
    old = dp.message_index(_normed_documents(spark, folder))
    return c.rounded(dp.best_fuzzy_matches(dp.message_index(dp.with_norm(items)), old))


def _versions(spark, folder):
    """A batch in which every conversation comes three times, each longer than the one before by a fifth of its texts.

    Neighbours are near copies, the first and the third are not, so the third depends on the second being rejected.
    """

    nested = _nested(spark, folder).withColumn("version", F.explode(F.array(*[F.lit(v) for v in range(3)])))

    def text(m):
        def grow(t):
            return F.concat(t, F.lit(" "), F.substring(t, F.lit(1), F.floor(F.length(t) / 5).cast("int")))

        once = grow(m["text"])
        return m.withField("text", F.when(F.col("version") == 0, m["text"]).when(F.col("version") == 1, once).otherwise(grow(once)))

    grown = nested.withColumn("messages", F.transform("messages", text))
    return grown.withColumn("conversation_id", F.concat_ws("-", "conversation_id", F.col("version").cast("string"))).drop("version")


def version_fuzzy_matches(spark, folder):
    """Best fuzzy match of every distinct text of the grown conversations among all of them."""
    index = dp.message_index(dp.with_norm(explode_messages(_versions(spark, folder))))
    return c.rounded(dp.best_fuzzy_matches(index, index, same=True))


def corpus_accept(spark, folder):
    """Grown conversations taken in order, each accepted or rejected for its likeness to accepted ones.

    Documents are not compared (threshold above 100): three versions of a conversation are too alike as a whole.
    """
    new = _versions(spark, folder)
    issues = corpus_build.accept_batch(new, new.where("false"), conversation_threshold=101.0)
    order = F.struct("pos", "issue")
    first = issues.groupBy("conversation_id").agg(F.min_by(F.struct("issue", "pos", "match"), order).alias("m"))
    out = new.select("conversation_id").join(first, "conversation_id", "left")
    return c.rounded(out.select("conversation_id", F.coalesce("m.issue", F.lit("accepted")).alias("decision"), "m.pos", "m.match"))


# ---------------------------------------------------------------- similarity
def tfidf_weights(spark, folder):
    docs = tb.text_table(spark, folder, "documents").select("doc_id", "text")
    return c.rounded(tf.document_weights(docs, "doc_id", tf.word_terms(F.col("text"))).drop("df"))


def _conversation_documents(spark, folder):
    texts = c.turns(spark, folder).groupBy("conversation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), " ").alias("texts")
    )
    a = _attributes(spark, folder)
    return texts.join(a, "conversation_id").select(
        "conversation_id",
        sm.conversation_document(F.col("domain"), F.col("interest_trajectory"), F.col("final_outcome"), F.col("texts")).alias("document"),
    )


def similar_conversations(spark, folder):
    return c.rounded(sm.most_similar(_conversation_documents(spark, folder), "conversation_id"), 4)


def benchmark_similarity(spark, folder):
    """Most similar accepted benchmark item of each document, whole tables on both sides.

    The threshold is 50, not the 82 of the operator: documents hold more than the item, so their cosine is lower.
    """
    items = tb.table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("document"))
    docs = _documents(spark, folder).select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    return c.rounded(sm.most_similar_accepted(docs, items, "id", 50.0), 4)


QUERIES = {
    f.__name__: f
    for f in [
        distributions,
        top_sources,
        id_counts,
        length_percentiles,
        truncation_shares,
        document_percentiles,
        repeated_messages,
        message_totals,
        opening_closing,
        repeated_openings,
        misplaced_phrases,
        phrase_hits,
        new_batch,
        max_id,
        allocated_ids,
        recent_message_sample,
        run_costs,
        structure_signatures,
        coverage_gaps,
        unused_combinations,
        combined_sources,
        turn_violations,
        turn_validation_summary,
        nested_violations,
        exact_duplicates,
        phrase_frequencies,
        in_conversation_repeats,
        fuzzy_matches,
        turn_fuzzy_matches,
        benchmark_matches,
        version_fuzzy_matches,
        corpus_accept,
        tfidf_weights,
        similar_conversations,
        benchmark_similarity,
    ]
}

_SIZES = f"""WITH {c.TURNS},
sizes AS (SELECT cid, count(*) AS total_messages, count(*) FILTER (WHERE role = 'customer') AS customer_messages,
  length(coalesce(string_agg(text, ' [SEP] ' ORDER BY pos) FILTER (WHERE role = 'customer' AND text <> ''), '')) AS customer_chars,
  count(*) FILTER (WHERE role = 'customer' AND text <> '' AND trim(text) = '') AS blank_texts FROM msgs GROUP BY cid)"""


def _nearest(values: str, key: str = "measure") -> str:
    def at(p: int) -> str:
        return f"max(value) FILTER (WHERE i = least(n * {p} // 100, n - 1))"

    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY {key}) AS n FROM {values})
SELECT {key}, round(min(value), 6) AS min, {", ".join(f"round({at(p)}, 6) AS p{p}" for p in (50, 90, 95, 99))}, round(max(value), 6) AS max
FROM ranked GROUP BY {key}"""


_HITS = " UNION ALL ".join(f"SELECT doc_id, {c.sql_string(p)} AS phrase FROM documents WHERE contains(lower(text), {c.sql_string(p)})" for p in PHRASES)
_FIRST = "CASE " + " ".join(f"WHEN contains(lower(text), {c.sql_string(p)}) THEN {c.sql_string(p)}" for p in PHRASES) + " END"
_TRAJ = "[" + ", ".join(map(c.sql_string, S.TRAJECTORIES)) + "]"
_OUTCOME = "CASE interest_trajectory " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.TRAJECTORY_OUTCOME.items()) + " END"
_ATTR = f"""attr0 AS (SELECT conv_id AS cid, 'domain' || (len(regexp_extract_all(text, '[aeiou]')) % 5) AS domain,
  {_TRAJ}[length(text) % 10 + 1] AS interest_trajectory FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
attr AS (SELECT *, {_OUTCOME} AS final_outcome FROM attr0)"""
_NORMED = f"""nd AS (SELECT * FROM (SELECT *, {NORM_SQL} AS norm FROM documents) WHERE norm <> ''
  AND norm NOT IN ({", ".join(map(c.sql_string, lx.SHORT_REPLIES))}))"""
_RULES = """v AS (
  SELECT cid, pos, 'role' AS rule FROM msgs WHERE role NOT IN ('customer', 'business')
  UNION ALL SELECT cid, pos, 'empty_text' FROM msgs WHERE trim(coalesce(text, '')) = ''
  UNION ALL SELECT cid, pos, 'no_script_letter' FROM msgs WHERE trim(coalesce(text, '')) <> '' AND NOT regexp_matches(text, '[A-Za-z]')
  UNION ALL SELECT cid, NULL, 'message_index' FROM msgs GROUP BY cid HAVING min(pos) <> 0 OR max(pos) <> count(*) - 1
  UNION ALL SELECT cid, NULL, 'first_role' FROM msgs GROUP BY cid HAVING arg_min(role, pos) <> 'customer'
  UNION ALL SELECT cid, NULL, 'no_customer' FROM msgs GROUP BY cid HAVING count(*) FILTER (WHERE role = 'customer') = 0
  UNION ALL SELECT cid, NULL, 'no_business' FROM msgs GROUP BY cid HAVING count(*) FILTER (WHERE role = 'business') = 0)"""


def _grams(source: str) -> str:
    r"""CTEs from ``source(id, document)`` to ``tf(id, gram, tf)`` of padded character n-grams."""
    return rf"""words AS (SELECT id, unnest(regexp_split_to_array(trim(lower(document)), '\s+')) AS w FROM {source}),
padded AS (SELECT id, ' ' || w || ' ' AS p FROM words WHERE w <> ''),
sized AS (SELECT id, p, unnest(range(2, least(4, length(p)) + 1)) AS k FROM padded),
placed AS (SELECT id, p, k, unnest(range(1, length(p) - k + 2)) AS i FROM sized),
tf AS (SELECT id, substr(p, i, k) AS gram, count(*) AS tf FROM placed GROUP BY 1, 2)"""


def _vectors(vocab_from: str, docs: str) -> str:
    return f"""vocab AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM {docs})) / (1 + count(*))) + 1 AS idf
  FROM {vocab_from} GROUP BY gram ORDER BY sum(tf) DESC, gram LIMIT 8000)"""


ORACLES = {
    "distributions": """WITH d AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
u AS (SELECT 'lang' AS field, lang AS value FROM d UNION ALL SELECT 'source', source FROM d
  UNION ALL SELECT 'quality', CAST(quality AS VARCHAR) FROM d UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR) FROM d)
SELECT field, coalesce(value, 'unknown') AS value, count(*) AS n FROM u GROUP BY 1, 2""",
    "top_sources": """SELECT 'source' AS field, source AS value, count(*) AS n FROM documents GROUP BY source
ORDER BY n DESC, value LIMIT 10""",
    "id_counts": """WITH k AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT CAST(sum(n) AS BIGINT) AS n_records, count(*) AS n_unique_ids, count(*) FILTER (WHERE n > 1) AS n_duplicate_ids FROM k""",
    "length_percentiles": f"""{_SIZES},
long AS (SELECT 'total_messages' AS measure, CAST(total_messages AS DOUBLE) AS value FROM sizes
  UNION ALL SELECT 'customer_messages', customer_messages FROM sizes UNION ALL SELECT 'customer_chars', customer_chars FROM sizes
  UNION ALL SELECT 'estimated_tokens', customer_chars / 1.7::DOUBLE + 2 FROM sizes),
{_nearest("long")}""",
    "truncation_shares": f"""{_SIZES}
SELECT count(*) AS n_conversations, CAST(sum(blank_texts) AS BIGINT) AS n_blank_texts,
  {", ".join(f"round(avg(CASE WHEN customer_chars / 1.7 + 2 > {k} THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_over_{k}" for k in pf.TOKEN_LIMITS)}
FROM sizes""",
    "document_percentiles": """WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT 'n_chars' AS measure, p / 100.0::DOUBLE AS fraction, CAST(max(n_chars) AS DOUBLE) AS percentile
FROM r, (VALUES (50), (90), (95), (99)) q(p) WHERE i = least(n * p // 100, n - 1) GROUP BY p""",
    "repeated_messages": "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "message_totals": """SELECT count(*) AS total_messages, count(DISTINCT text) AS unique_messages,
  round(100.0 * count(DISTINCT text) / count(*), 6) AS unique_pct FROM documents""",
    "opening_closing": """SELECT conv_id AS conversation_id, arg_min(text, turn) AS opening, arg_max(text, turn) AS closing
FROM conversations GROUP BY conv_id""",
    "repeated_openings": f"""WITH {c.TIMED} SELECT event_type AS opening, count(*) AS n FROM msgs WHERE pos = 0 GROUP BY 1 HAVING count(*) > 1""",
    "misplaced_phrases": f"""SELECT doc_id, lang, {_FIRST} AS phrase FROM documents
WHERE lang NOT IN ('de', 'es') AND {_FIRST} IS NOT NULL""",
    "phrase_hits": _HITS,
    "new_batch": """SELECT source || '_' || printf('%06d', doc_id) AS conversation_id, lang FROM documents WHERE doc_id >= 500""",
    "max_id": "SELECT coalesce(max(doc_id), 0) AS max_id FROM labels",
    "allocated_ids": f"""SELECT item_id, '{S.ID_PREFIX}' || printf('%06d', (SELECT max(doc_id) FROM labels)
  + row_number() OVER (ORDER BY md5(CAST(item_id AS VARCHAR)), item_id)) AS conversation_id FROM benchmark""",
    "recent_message_sample": """WITH last AS (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id DESC LIMIT 30)
SELECT conv_id AS conversation_id, turn AS pos, trim(text) AS text FROM conversations
WHERE conv_id IN (SELECT conv_id FROM last) AND length(trim(text)) > 10 ORDER BY md5(conv_id || ':' || turn || ':42') LIMIT 10""",
    "run_costs": """WITH e AS (SELECT event_id, event_type, value * 1000 AS i, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1000 AS o FROM events)
SELECT event_id, round_even(CASE event_type WHEN 'view' THEN i / 1e6 * 0.1::DOUBLE + o / 1e6 * 0.2::DOUBLE WHEN 'click' THEN i / 1e6 * 0.2::DOUBLE + o / 1e6 * 0.4::DOUBLE
  WHEN 'error' THEN i / 1e6 * 1.0::DOUBLE + o / 1e6 * 2.0::DOUBLE END, 6) AS cost_usd FROM e""",
    "structure_signatures": f"""WITH {c.TURNS}, {_ATTR},
shape AS (SELECT cid, count(*) // 4 * 4 AS b, arg_min(role, pos) AS f, arg_max(role, pos) AS l FROM msgs GROUP BY cid)
SELECT concat_ws('|', domain, interest_trajectory, final_outcome, b, f || '-' || l) AS signature, count(*) AS n
FROM attr JOIN shape USING (cid) GROUP BY 1""",
    "coverage_gaps": """WITH o AS (SELECT source || ':' || lang AS stratum FROM (SELECT DISTINCT source FROM documents),
  (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) l(lang)),
k AS (SELECT o.stratum, count(d.doc_id) AS n FROM o LEFT JOIN documents d ON d.source || ':' || d.lang = o.stratum GROUP BY 1)
SELECT stratum, n FROM k WHERE n <= (SELECT min(n) FROM k) + 2""",
    "unused_combinations": f"""WITH {_ATTR}, t AS (SELECT unnest({_TRAJ}) AS trajectory)
SELECT d.domain, t.trajectory FROM (SELECT DISTINCT domain FROM attr) d, t
WHERE NOT EXISTS (SELECT 1 FROM attr a WHERE a.domain = d.domain AND a.interest_trajectory = t.trajectory)""",
    "combined_sources": "SELECT doc_id AS id, length(text) AS chars FROM documents UNION ALL SELECT item_id, length(text) FROM benchmark",
    "turn_violations": f"WITH {c.TURNS}, {_RULES} SELECT cid AS conversation_id, pos AS message_index, rule FROM v",
    "turn_validation_summary": f"""WITH {c.TURNS}, {_RULES}, k AS (SELECT count(DISTINCT cid) AS total FROM msgs), b AS (SELECT count(DISTINCT cid) AS bad FROM v)
SELECT total AS total_conversations, total - bad AS valid_conversations, bad AS invalid_conversations FROM k, b""",
    "nested_violations": f"""WITH {c.TURNS}, {_RULES}, {_ATTR},
all_v AS (SELECT rule FROM v UNION ALL SELECT 'trajectory_outcome' FROM attr WHERE final_outcome <> 'converted'
  UNION ALL SELECT 'delay_mismatch' FROM msgs WHERE pos > 0)
SELECT rule, count(*) AS n FROM all_v GROUP BY rule""",
    "exact_duplicates": f"""WITH {_NORMED}, o AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS owner FROM nd)
SELECT doc_id, owner FROM o WHERE owner <> doc_id""",
    "phrase_frequencies": f"WITH {_NORMED} SELECT norm, count(*) AS n FROM nd GROUP BY norm ORDER BY n DESC, norm LIMIT 20",
    "in_conversation_repeats": f"""WITH {_NORMED} SELECT source AS conversation_id, doc_id AS pos FROM nd
QUALIFY row_number() OVER (PARTITION BY source, norm ORDER BY doc_id) > 1""",
    "tfidf_weights": r"""WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
terms AS (SELECT doc_id, w[i] AS term FROM placed UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM placed WHERE i < len(w)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) <= (SELECT n FROM nd) * 0.95 ORDER BY sum(tf) DESC, term LIMIT 20000),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT n FROM nd)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
    "similar_conversations": f"""WITH {_ATTR}, texts AS (SELECT conv_id AS cid, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
docs AS (SELECT cid AS id, concat_ws(' ', domain, interest_trajectory, final_outcome, t) AS document FROM attr JOIN texts USING (cid)),
{_grams("docs")}, {_vectors("tf", "docs")},
raw AS (SELECT id, gram, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (gram)),
vec AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
sims AS (SELECT a.id, b.id AS other, sum(a.w * b.w) AS s FROM vec a JOIN vec b ON a.gram = b.gram AND a.id <> b.id GROUP BY 1, 2)
SELECT id AS conversation_id, round(s * 100, 4) AS score, other AS match FROM sims WHERE s >= 0.82 - 1e-9
QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, other) = 1""",
    "benchmark_similarity": f"""WITH docs AS (SELECT 'b' || item_id AS id, text AS document FROM benchmark UNION ALL SELECT 'd' || doc_id, text FROM documents),
{_grams("docs")}, {_vectors("(SELECT * FROM tf WHERE id[1] = 'b')", "benchmark")},
raw AS (SELECT id, gram, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (gram)),
vec AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
sims AS (SELECT a.id, CAST(b.id[2:] AS BIGINT) AS other, sum(a.w * b.w) AS s FROM vec a JOIN vec b ON a.gram = b.gram AND a.id[1] = 'd' AND b.id[1] = 'b' GROUP BY 1, 2)
SELECT CAST(id[2:] AS BIGINT) AS id, round(s * 100, 4) AS score, other AS match FROM sims WHERE s >= 0.5 - 1e-9
QUALIFY row_number() OVER (PARTITION BY sims.id ORDER BY round(s, 9) DESC, other) = 1""",
}
