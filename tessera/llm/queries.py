"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    filter_audit, fingerprints, language_id, lexical_search, license_scan, mixing, ngram_join, packing, quality_classifier, quality_rules, retrieval_packing,
    secret_scan, warc,
)
from tessera.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdicts of its policies."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


SQL_1 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
      FROM t LEFT JOIN r ON r.doc_id = t.doc_id LEFT JOIN l ON l.doc_id = t.doc_id),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > word_chars)::BIGINT
             + 8 * (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failure_bits,
       (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept
FROM b
"""

def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents."""
    return ngram_join.similarity_join(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labels of two thirds of them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.score_quality(docs, labels, quality_classifier.third())


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents, for domains that the labels name."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, by a fresh ledger."""
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from three quarters of them."""
    return language_id.identify(table(spark, sf_dir, "documents"), language_id.fourth())


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as an archive and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL_11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                  lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                  lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
a AS (SELECT i, item_id, unnest(t) AS term FROM q),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
m AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)) AS impact FROM p, s),
g AS (SELECT i, item_id, r, doc_id, sum(w * impact)::BIGINT AS score FROM a JOIN m USING (term) JOIN w USING (term) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM g WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on all documents, in each of their orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL_12 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e
      FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
h AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order FROM f p, f q, f r, f s, f u
      WHERE p.bit | q.bit | r.bit | s.bit | u.bit = 31),
x AS (SELECT filter_order, step, f.bit, coalesce((SELECT sum(g.bit) FROM f g WHERE strpos(filter_order, g.f) < step), 0)::INT AS before
      FROM o, range(1, 6) k(step), f WHERE f.f = filter_order[step]),
y AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n_good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n_toxic ELSE 0 END) AS toxic_lost
      FROM h, x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM y
"""


def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed with their neighbours."""
    return retrieval_packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_source_mixing": op4_source_mixing,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_license_scan": op8_license_scan,
    "op9_warc_writer": op9_warc_writer,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_lexical_search": op11_lexical_search,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
    "op13_retrieval_packing": op13_retrieval_packing,
}
ORACLES: dict[str, str] = {"op1_quality_rules": SQL_1, "op11_lexical_search": SQL_11, "op12_filter_interaction_audit": SQL_12}
