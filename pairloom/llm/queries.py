"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import ann, quality, toxicity
from pairloom.llm.best_fit import pack_best_fit
from pairloom.llm.common import small_batches, table
from pairloom.llm.decontamination import decontaminate
from pairloom.llm.hard_negatives import mine
from pairloom.llm.html_extract import extract_text
from pairloom.llm.lm import score_texts
from pairloom.llm.packing import pack_documents
from pairloom.llm.simhash import near_duplicates
from pairloom.llm.token_counts import count_tokens
from pairloom.llm.token_output import read_token_index, write_token_shards
from pairloom.llm.vector_codes import compress

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(rows), rows.where("vec_id % 20 = 0"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_index(write_token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"), label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


#: Each asks for small Arrow batches first, a setting of the session that bounds the tasks' memory.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: _bounded(q)
    for q in (
        op1_lm_scoring,
        op2_nearest_neighbours,
        op3_token_counts,
        op4_near_duplicates,
        op5_html_extraction,
        op6_toxicity,
        op7_packing,
        op8_quality,
        op9_token_output,
        op10_decontamination,
        op11_vector_codes,
        op12_hard_negatives,
        op13_best_fit,
    )
}
WORDS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The other operators need hashes, tokenizers, learned models or an approximate index, which SQL doesn't have.
ORACLE_SQL: dict[str, str] = {
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, ROW_NUMBER() OVER () AS rid, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bk AS (SELECT item_id, w, LEAST(10, len(w)) AS n, UNNEST(generate_series(1, GREATEST(1, len(w) - 9))) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS key FROM bk),
sizes AS (SELECT DISTINCT n FROM bw),
dk AS (SELECT rid, w, n, UNNEST(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS key FROM dk),
hit AS (SELECT DISTINCT rid, k, n, item_id FROM dw JOIN bw USING (n, key)),
places AS (SELECT rid, UNNEST(generate_series(k, k + n - 1)) AS p FROM hit),
found AS (SELECT rid, COUNT(DISTINCT p) AS n_hit FROM places GROUP BY rid),
names AS (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL),
listed AS (SELECT rid, COUNT(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS s FROM names GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, COALESCE(s, sha256('')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN found USING (rid) LEFT JOIN listed USING (rid)
"""
}

#: Four rounds of assigning parts to entries and averaging them; dot products of whole numbers are exact in doubles.
_NEAREST = "SELECT x.rid, x.part, arg_min(b.entry, (list_dot_product(x.v, x.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(x.v, b.v)) * 1000 + b.entry) AS entry, MIN(list_dot_product(x.v, x.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(x.v, b.v)) AS error FROM parts x JOIN book{k} b ON x.part = b.part GROUP BY x.rid, x.part"
_ROUND = """
near{k} AS MATERIALIZED ({nearest}),
sums{k} AS (SELECT part, entry, place, floor(SUM(v[place]) / COUNT(*)) AS c FROM near{k} JOIN parts USING (rid, part), generate_series(1, len(v)) AS g(place) GROUP BY ALL),
means{k} AS (SELECT part, entry, list(c ORDER BY place) AS v FROM sums{k} GROUP BY ALL),
book{n} AS MATERIALIZED (SELECT b.part, b.entry, COALESCE(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m USING (part, entry)),"""
ORACLE_SQL["op11_vector_codes"] = f"""
WITH kept AS (SELECT vec_id, label, ROW_NUMBER() OVER (ORDER BY vec_id NULLS LAST) AS rid, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, part, q[part * len(q) // 4 + 1 : (part + 1) * len(q) // 4] AS v FROM kept, generate_series(0, 3) AS g(part)),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM parts WHERE rid <= 256),{"".join(_ROUND.format(k=k, n=k + 1, nearest=_NEAREST.format(k=k)) for k in range(4))}
final AS MATERIALIZED ({_NEAREST.format(k=4)}),
coded AS (SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(SUM(error) AS BIGINT) AS error FROM final GROUP BY rid),
text AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, entry)) AS s FROM book4)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM kept JOIN coded USING (rid), text
"""
ORACLE_SQL["op12_hard_negatives"] = """
WITH kept AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(ROW_NUMBER() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
