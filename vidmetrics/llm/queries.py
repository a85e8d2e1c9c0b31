"""The registered queries of the corpus operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vidmetrics.llm import attention, codebooks, compression, discriminant, fingerprints, language, packing, secrets, simhash, suffixes, templates, toxicity, whitening
from vidmetrics.llm.common import table


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_rules(table(spark, sf_dir, "documents"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.repeats(table(spark, sf_dir, "documents"), least=400))


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op5_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held_out=2, threshold=0.3
    )


def op6_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held_out=1)


def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, errors=3)


def op8_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op9_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of(table(spark, sf_dir, "documents"), folds=5, held_out=0)


def op10_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.text_scores(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, folds=10, held_out=0
    )


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op12_adaptive_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.vector_codes(table(spark, sf_dir, "embeddings"), entries=256, parts=4, rounds=4, scale=1024)


def op13_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"), radius=7, spare=1, every=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_template_leaks, op2_compression_bands, op3_suffix_repeats, op4_trigram_secrets, op5_subsequence_toxicity, op6_quadratic_quality, op7_simhash_trie, op8_complement_packing,
        op9_viterbi_language, op10_attention_scores, op11_chebyshev_whitening, op12_adaptive_codebooks,
        op13_simhash_fingerprints,
    )
}
_SPACE = r"[ \t\n\x0B\f\r]"


def _template_sql(source: str, key: str) -> str:
    """Template words and raw words of a table, with their places, one row each."""
    units = "|".join(templates.UNITS)
    text = r"regexp_replace(text, '[\x01-\x03]', '', 'g')"
    steps = (
        (r"[0-9]+([.,:/-][0-9]+)*", r"chr(2)"),
        (rf"(?i)(\x02{_SPACE}?)({units})([^\p{{L}}\p{{N}}\x01-\x03]|$)", r"'\1' || chr(3) || '\3'"),
        (rf"([\p{{Ll}},;:\x02\x03]{_SPACE})\p{{Lu}}\p{{L}}*", r"'\1' || chr(1)"),
        *[(rf"(\x01{_SPACE})\p{{Lu}}\p{{L}}*", r"'\1' || chr(1)")] * 2,
    )
    made = text
    for pattern, put in steps:
        made = f"regexp_replace({made}, '{pattern}', {put}, 'g')"
    made = rf"regexp_replace(lower({made}), '[^\p{{L}}\x01-\x03 \t\n\x0B\f\r]+', '', 'g')"
    return f"""
        SELECT {key}, t, raw, row_number() OVER (PARTITION BY {key} ORDER BY cell) - 1 AS place0 FROM (
            SELECT {key}, unnest(string_split_regex({made}, '{_SPACE}')) AS t, unnest(string_split_regex({text}, '{_SPACE}')) AS raw,
                generate_subscripts(string_split_regex({made}, '{_SPACE}'), 1) AS cell
            FROM {source} WHERE {key} IS NOT NULL AND text IS NOT NULL
        ) WHERE t <> ''"""


def _leaks_sql(window: int = templates.WINDOW, literals: int = templates.LEAST_LITERALS, coverage: float = templates.COVERAGE) -> str:
    """For items of at least ``window`` words, which all of the given ones are."""
    def windows(name: str, key: str) -> str:
        parts = ", ".join(f"lead(t, {k}) OVER w AS t{k}" for k in range(1, window))
        return f"""SELECT {key}, place0, concat_ws(' ', t, {', '.join(f't{k}' for k in range(1, window))}) AS words,
            {' + '.join(f"(NOT regexp_matches(t{k or ''}, '[\\x01-\\x03]'))::INT" for k in range(window))} AS literals
            FROM (SELECT {key}, place0, t, {parts} FROM {name} WINDOW w AS (PARTITION BY {key} ORDER BY place0)) WHERE t{window - 1} IS NOT NULL"""

    return f"""
    WITH d AS MATERIALIZED ({_template_sql('documents', 'doc_id')}), b AS MATERIALIZED ({_template_sql('benchmark', 'item_id')}),
    bw AS MATERIALIZED ({windows('b', 'item_id')}), dw AS MATERIALIZED ({windows('d', 'doc_id')}),
    found AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, bw.place0 AS item_at, dw.place0 - bw.place0 AS line FROM dw JOIN bw USING (words) WHERE bw.literals >= {literals}),
    places AS (SELECT DISTINCT doc_id, item_id, line, item_at + k AS place FROM found, range({window}) r(k)),
    met AS (SELECT p.doc_id, p.item_id, line, place, lower(rtrim(b.raw, '.,;:!?')) AS iv, lower(rtrim(d.raw, '.,;:!?')) AS dv
        FROM places p JOIN b ON b.item_id = p.item_id AND b.place0 = place JOIN d ON d.doc_id = p.doc_id AND d.place0 = place + line
        WHERE regexp_matches(b.t, '[\x01-\x03]')),
    lines AS (SELECT doc_id, item_id, line, count(DISTINCT iv) AS v, count(DISTINCT (iv, dv)) AS p, count(DISTINCT place) AS slots,
        count(DISTINCT place) FILTER (iv <> dv) AS changed FROM met GROUP BY ALL),
    odd AS (SELECT doc_id, item_id, line FROM lines WHERE p > v),
    e AS (SELECT doc_id, item_id, count(DISTINCT item_at) AS n_windows FROM found ANTI JOIN odd USING (doc_id, item_id, line) GROUP BY ALL),
    c AS (SELECT doc_id, item_id, count(DISTINCT place) AS covered_words FROM places ANTI JOIN odd USING (doc_id, item_id, line) GROUP BY ALL),
    s AS (SELECT doc_id, item_id, sum(slots) AS n_slots, sum(changed) AS n_changed FROM lines WHERE p <= v GROUP BY ALL),
    n AS (SELECT item_id, count(*) AS item_words FROM b GROUP BY ALL)
    SELECT e.doc_id, e.item_id, n_windows, item_words, covered_words, coalesce(n_slots, 0)::BIGINT AS n_slots,
        coalesce(n_changed, 0)::BIGINT AS n_changed
    FROM e JOIN c USING (doc_id, item_id) JOIN n USING (item_id) LEFT JOIN s ON s.doc_id = e.doc_id AND s.item_id = e.item_id
    WHERE covered_words >= {coverage} * item_words"""


ORACLES: dict[str, str] = {"op1_template_leaks": _leaks_sql()}
