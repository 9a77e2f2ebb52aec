"""Each operator as a query over the whole ``documents`` table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import (
    balance,
    decontamination,
    exact_dedup,
    filter_audit,
    hilbert,
    jaccard_trees,
    language_cnn,
    lexical,
    pii,
    suffix_runs,
    token_counts,
    toxicity,
    url_rules,
)
from cadenza.llm.common import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(documents(spark, sf_dir), 16)


def op2_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_jaccard_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trees.join(documents(spark, sf_dir))


def op5_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_runs.dedup(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(exact_dedup.thirds(documents(spark, sf_dir)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query needs the vocabulary files

    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_cnn.identify(documents(spark, sf_dir))


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.mix(documents(spark, sf_dir))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = (
    op1_hilbert_shards,
    op2_toxicity_kernel,
    op3_latent_decontamination,
    op4_jaccard_trees,
    op5_suffix_runs,
    op6_exact_dedup,
    op7_token_counts,
    op8_language_cnn,
    op9_entropy_mix,
    op10_pii_spans,
    op11_url_rules,
    op12_lexical_search,
    op13_filter_audit,
)
REGISTRY: dict[str, Query] = {f.__name__: f for f in QUERIES}

_UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), {_UPPER_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op11_url_rules": rf"""
        WITH RECURSIVE parts AS (
            SELECT page_id, row_number() OVER () AS page,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_UPPER_LOWER}) AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query
            FROM pages
        ),
        pieces AS (
            SELECT page, 'host:' || unnest(string_split(host, '.')) AS token FROM parts
            UNION SELECT page, 'path:' || unnest(string_split(path, '/')) FROM parts
            UNION SELECT page, 'query:' || unnest(regexp_split_to_array(query, '[&=]')) FROM parts
        ),
        tokens AS (SELECT page, token FROM pieces WHERE token NOT IN ('host:', 'path:', 'query:')),
        marks AS (
            SELECT doc_id, coalesce(max(toxic), 0) = 1 OR coalesce(min(quality), 1) = 0 AS bad
            FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ),
        labelled AS (SELECT page, bad FROM parts JOIN marks ON page_id = doc_id),
        least AS (SELECT greatest(5, ceil(0.01 * count(*))) AS n FROM labelled WHERE bad),
        seen AS (
            SELECT token, count(*) AS n, count(*) FILTER (bad) AS n_bad
            FROM labelled JOIN tokens USING (page) GROUP BY token
        ),
        mined AS (
            SELECT page, token FROM labelled JOIN tokens USING (page) JOIN seen USING (token)
            WHERE bad AND n_bad >= (SELECT n FROM least)
            QUALIFY row_number() OVER (PARTITION BY page ORDER BY -n_bad / n, token) <= 12
        ),
        sets AS (
            SELECT [token] AS items FROM mined GROUP BY token HAVING count(*) >= (SELECT n FROM least)
            UNION ALL
            SELECT list_append(s.items, m.token) AS items
            FROM sets s JOIN (SELECT page, list(token) AS own FROM mined GROUP BY page) b ON list_has_all(b.own, s.items)
            JOIN mined m ON m.page = b.page AND m.token > s.items[len(s.items)]
            GROUP BY 1 HAVING count(*) >= (SELECT n FROM least)
        ),
        baskets AS (SELECT page, list(token) AS own FROM tokens GROUP BY page),
        rules AS (
            SELECT items, count(*) FILTER (bad) AS support, count(*) FILTER (bad) / count(*) AS confidence
            FROM sets JOIN baskets ON list_has_all(own, items) JOIN labelled USING (page)
            GROUP BY items HAVING confidence >= 0.6
        ),
        useful AS (
            SELECT * FROM rules r WHERE NOT EXISTS (
                SELECT 1 FROM rules s
                WHERE len(s.items) < len(r.items) AND list_has_all(r.items, s.items) AND s.confidence >= r.confidence)
        ),
        best AS (
            SELECT page, items, confidence FROM baskets JOIN useful ON list_has_all(own, items)
            QUALIFY row_number() OVER (PARTITION BY page ORDER BY confidence DESC, support DESC, len(items), items) = 1
        ),
        judged AS (
            SELECT *, CASE
                WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule
            FROM parts LEFT JOIN best USING (page)
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN items IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
               array_to_string(items, ' ') AS mined_tokens, confidence AS mined_confidence
        FROM judged
    """,
    "op12_lexical_search": f"""
        WITH words AS (
            SELECT d, doc_id, unnest({_TERMS}) AS term
            FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)
        ),
        tf AS (SELECT d, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        sizes AS (SELECT d, count(*) AS n FROM words GROUP BY d),
        whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
        df AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
        m AS (SELECT d, 100 - 50 + (50 * n * docs) // terms AS m FROM sizes, whole),
        asked AS (
            SELECT DISTINCT i, item_id, unnest({_TERMS}) AS term
            FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
        ),
        scores AS (
            SELECT i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN m USING (d) GROUP BY ALL
        )
        SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
        WINDOW best AS (PARTITION BY i ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 50
    """,
    "op13_filter_audit": f"""
        WITH RECURSIVE orders AS (
            SELECT '' AS filter_order
            UNION ALL
            SELECT filter_order || letter FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS f(letter)
            WHERE NOT contains(filter_order, letter)
        ),
        steps AS (
            SELECT filter_order, step, filter_order[step] AS letter
            FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step) WHERE length(filter_order) = 5
        ),
        split AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
        first_ids AS (SELECT text, min(doc_id) AS first_id FROM split GROUP BY text),
        failing AS (
            SELECT doc_id, coalesce(lang, '') AS part,
                   (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END)
                   || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
                   || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END)
                   || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
                   || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails
            FROM split JOIN first_ids USING (text)
        ),
        marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        groups AS (
            SELECT part, fails, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic, count(*) AS n
            FROM failing LEFT JOIN marks USING (doc_id) GROUP BY ALL
        ),
        counted AS (
            SELECT part, filter_order, step, letter,
                   sum(n) FILTER (regexp_extract_all(fails, '[' || filter_order[1:step] || ']') = []) AS kept,
                   sum(n) FILTER (here) AS removed,
                   sum(n) FILTER (contains(fails, letter) AND NOT here) AS redundant,
                   sum(n) FILTER (fails = letter) AS unique_fails,
                   sum(n) FILTER (here AND good) AS good_lost,
                   sum(n) FILTER (here AND toxic) AS toxic_lost
            FROM (SELECT *, contains(fails, letter)
                         AND (step = 1 OR regexp_extract_all(fails, '[' || filter_order[1:step - 1] || ' ]') = []) AS here
                  FROM groups, steps)
            GROUP BY ALL
        )
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
               coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM counted
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY sha256(coalesce(text, '')))
    """,
}
