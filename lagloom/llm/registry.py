"""Queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from lagloom.llm.ball_tree import op8_ball_tree
from lagloom.llm.bpe_transducer import op9_bpe_transducer
from lagloom.llm.decontaminate import op7_decontaminate
from lagloom.llm.language_id import op6_language_id
from lagloom.llm.sharding import op10_sharding
from lagloom.llm.simhash_trie import op5_simhash_trie
from lagloom.llm.substring_dedup import op3_substring_dedup
from lagloom.llm.token_counts import op1_token_counts
from lagloom.llm.token_files import op4_token_files
from lagloom.llm.toxicity import op2_toxicity_ftrl

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity_ftrl": op2_toxicity_ftrl,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_files": op4_token_files,
    "op5_simhash_trie": op5_simhash_trie,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_ball_tree": op8_ball_tree,
    "op9_bpe_transducer": op9_bpe_transducer,
    "op10_sharding": op10_sharding,
}

#: Exact statements; the others are tested against brute force, round trips or held-out accuracy.
SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, s, w[s:s + 19] AS win FROM words, unnest(generate_series(1, len(w) - 19)) AS t(s)
        ), later AS (
            SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1
        ), gone AS (
            SELECT DISTINCT doc_id, s + k AS p FROM later, generate_series(0, 19) AS g(k)
        ), flat AS (
            SELECT doc_id, p, w[p] AS word FROM words, unnest(generate_series(1, len(w))) AS t(p)
        ), kept AS (
            SELECT f.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN f.word END, ' ' ORDER BY f.p) AS kept
            FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p GROUP BY f.doc_id
        )
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "op8_ball_tree": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        ) WHERE rank <= 10
    """,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
