"""Queries of the training-data operators, and SQL for those that SQL can express over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import chunking, cooccur, langid, mixing, near_dup, packing, pii, tokens
from threadloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_items(chunking.project_items(table(spark, d, "curated"), table(spark, d, "chunk")), table(spark, d, "split_limit"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.found_items(p1_pieces(spark, d))


def _near(spark: SparkSession, d: str) -> near_dup.Join:
    return near_dup.Join(near_dup.curated_texts(table(spark, d, "curated")), words=3, threshold=Fraction(1, 2), min_words=30)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs()


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.cooccurrence(cooccur.artifact_baskets(table(spark, d, "artifact")), min_count=1, min_share=0.0)
    return pairs.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n_total", F.round("expected", 6).alias("expected"), F.round("lift", 6).alias("lift"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.cooccurrence(cooccur.artifact_baskets(table(spark, d, "artifact")), min_lift=2.0).select("item_a", "item_b")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.mentions(pii.bodies(table(spark, d, "curated")))
    return found.select("record_id", "thread_pos", "pii_kind", "start_pos").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(pii.bodies(table(spark, d, "curated"))).distinct()


def _sizes(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return tokens.count_tokens(table(spark, d, "documents"), "doc_id", "text", *keep)


def p6_assign(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), table(spark, d, "container_size"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_assign(spark, d))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p6_assign(spark, d))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(_sizes(spark, d, "source"), table(spark, d, "mix_target"))


def p7_chosen(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).chosen()


def p7_order(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).ordered()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def _passages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents, reference = table(spark, d, "documents"), table(spark, d, "language_ref")
    return documents, langid.labelled_segments(documents, reference, *langid.fit_documents(documents, reference))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.wrong_labels(_passages(spark, d)[1])


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d)[1].drop("label").distinct()


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(*_passages(spark, d))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_groups, p4_found, p4_pairs, p5_found, p5_redacted, p6_assign, p6_fill, p6_summary, p7_chosen, p7_order, p7_shares, p8_found, p8_segments, p8_documents)}


_PAIRS = r"""
WITH last AS (SELECT artifact_id, max(struct_pack(e := extracted_at, t := type, g := tags)) AS r FROM artifact GROUP BY artifact_id),
 raw AS (SELECT artifact_id, 'type:' AS k, r.t AS x FROM last UNION ALL SELECT artifact_id, 'tag:', unnest(r.g) FROM last),
 trimmed AS (SELECT artifact_id, k, translate(lower(regexp_replace(x, '^\s+|\s+$', '', 'g')), ' -', '__') AS x FROM raw WHERE x IS NOT NULL),
 item AS (SELECT DISTINCT artifact_id, k || x AS item FROM trimmed WHERE x <> ''),
 total AS (SELECT count(*) AS n FROM last),
 single AS (SELECT item, count(*) AS n FROM item GROUP BY item),
 pair AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n FROM item a JOIN item b ON a.artifact_id = b.artifact_id AND a.item < b.item GROUP BY ALL)
SELECT pair.item_a, pair.item_b, a.n AS n_a, b.n AS n_b, pair.n AS n_ab, total.n AS n_total,
 round(a.n::DOUBLE * b.n / total.n, 6) AS expected, round(pair.n::DOUBLE * total.n / (a.n::DOUBLE * b.n), 6) AS lift
FROM pair JOIN single a ON a.item = item_a JOIN single b ON b.item = item_b CROSS JOIN total
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
SELECT DISTINCT item_kind, item_id FROM (
 SELECT 'curated' AS item_kind, record_id AS item_id, formatted_discussion AS text FROM curated
 UNION ALL SELECT 'chunk', chunk_no, text FROM chunk) JOIN split_limit USING (item_kind) WHERE length(text) > max_chars""",
        "p2_found": """
WITH t AS (SELECT DISTINCT record_id, lower(coalesce(input_vector.title, '') || ' ' || coalesce(input_vector.body, '')) AS x FROM curated),
 w AS (SELECT record_id, regexp_extract_all(x, '[a-z0-9]+') AS w FROM t),
 s AS (SELECT DISTINCT record_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 30),
 n AS (SELECT record_id, count(*) AS n FROM s GROUP BY ALL),
 o AS (SELECT a.record_id AS record_id_a, b.record_id AS record_id_b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.record_id < b.record_id GROUP BY ALL)
SELECT record_id_a, record_id_b FROM o JOIN n a ON a.record_id = record_id_a JOIN n b ON b.record_id = record_id_b WHERE 2 * o >= a.n + b.n - o""",
        "p4_pairs": _PAIRS,
        "p4_found": f"SELECT item_a, item_b FROM ({_PAIRS}) WHERE n_ab >= 10 AND 1000 * n_ab >= n_total AND n_ab * n_total >= 2 * n_a * n_b",
    }
