"""Queries op1 to op13 over the whole of their tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm._spark import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


#: Fixed rules of op2: host, path prefix, kind.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.ppm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.embedding_dedup import near_duplicate_embeddings

    return near_duplicate_embeddings(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_REST = "substr(url, strpos(url, '://') + 3)"
_HOST = f"coalesce(case when strpos(url, '://') > 0 then translate(regexp_extract({_REST}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end, '')"
_PATH = f"coalesce(case when strpos(url, '://') > 0 then regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) end, '')"

_COMPONENTS = """
        r AS (SELECT a AS node, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node),
        m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
"""

ORACLE_SQL = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS x, len(w) >= 5 AS k FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        {_COMPONENTS}
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = w.doc_id
    """,
    "op5_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        {_COMPONENTS},
        k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
        FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN m ON m.node = vec_id
    """,
    "op2_url_filter": f"""
        WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        r(rh, rp, kind) AS (VALUES {", ".join(str(x) for x in URL_RULES)}),
        j AS (
            SELECT u.*, (SELECT struct_pack(rule := rh || rp, kind := kind) FROM r
                         WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
                         ORDER BY length(rh) DESC, length(rp) DESC LIMIT 1) AS hit
            FROM u)
        SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.kind, 'allow') AS verdict FROM j
    """,
}


#: Target shares of tokens of op9, by language as the domain.
TARGETS = {"en": 0.4, "fr": 0.25, "de": 0.2, "es": 0.15}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mix_to_targets

    docs = table(spark, sf_dir, "documents")
    return mix_to_targets(docs, known_domains(docs, table(spark, sf_dir, "labels")), TARGETS)


def known_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, domain) of the documents in the labelled table; the domains of all others are predicted."""
    return docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").selectExpr("doc_id as id", "lang as domain")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.token_alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.multi_index import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.spelling import spelling_variants, word_counts

    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), slip=97))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL
