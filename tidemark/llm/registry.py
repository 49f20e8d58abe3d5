"""The corpus operators' queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, langid, packing, quality, quotes, rules, simhash, suffix_dedup, topk
from .common import stored, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, posteriors and verdict of every document; source stands for the host, lang for the path."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LEDGERS: dict[tuple[str, str], DataFrame] = {}


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rule ledger of all documents; texts are measured once a session, and policies and ablations read this."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LEDGERS:
        _LEDGERS[key] = stored(rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    return _LEDGERS[key]


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdicts of the base and the current policy for every document."""
    book = rules.judged(_ledger(spark, sf_dir))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op2_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule removes, alone and with others, from the stored ledger."""
    return rules.ablations(_ledger(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of the ids of every text, and of the bytes they decode to."""
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes and runs of every document, and the digest of what is left."""
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences along the curve."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN).drop("ids")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and score of every text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    sample = langid.learn(docs.where(langid.fold() != langid.HELD_OUT))
    found = langid.identify(docs, sample)
    held_out = F.coalesce(langid.fold() == langid.HELD_OUT, F.lit(False))  # a row without an id has no such remainder, and is not learned from
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best candidates of every query vector."""
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    best = topk.search(vectors, vectors.where("id % 20 = 0"))
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with what it replies to and its place in its thread."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_quality_rules": op2_quality_rules,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_packing": op5_packing,
        "op6_language_id": op6_language_id,
        "op7_simhash": op7_simhash,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_topk": op9_topk,
        "op10_html_extraction": op10_html_extraction,
        "extra2_rule_ablations": op2_rule_ablations,
    }


_MEASURES = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
listed AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
win AS (
  SELECT doc_id, i, list_aggregate(w[i : i + 7], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM listed WHERE len(w) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
m AS (
  SELECT listed.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(text) - length(regexp_replace(text, '[A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ]', '', 'g')))::BIGINT AS n_capitals,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT AS n_stutters,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM listed LEFT JOIN cov ON cov.doc_id = listed.doc_id),
book AS (
  SELECT *, ((n_words < 20)::INT
     + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 8 * word_chars)::INT
     + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::INT + 16 * (100 * n_capitals > 40 * word_chars)::INT
     + 32 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words))::INT
     + 64 * (100 * n_exclaims > 30 * n_words)::INT + 128 * (100 * n_stutters > 30 * n_words)::INT)::INT AS failed FROM m)
"""


_REPEATS = """
WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, (2 * i + 1)::BIGINT, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 199, 0))) AS i FROM b)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
edge AS (SELECT doc_id, i, (coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true))::INT AS new FROM dup),
run AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge) GROUP BY doc_id, r),
gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM run),
piece AS (
  SELECT g.doc_id, string_agg(substr(b.x, (2 * f + 1)::BIGINT, (2 * (a - f))::BIGINT), '' ORDER BY a) AS head, max(z) AS last, sum(z - a) AS n_removed, count(*) AS n_spans
  FROM gap g JOIN b ON b.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT b.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM b LEFT JOIN piece ON piece.doc_id = b.doc_id"""


def oracle_sql() -> dict:
    rows = ", ".join(f"('{name}', {1 << bit})" for name, (bit, _) in rules.RULES.items())
    return {
        "op4_suffix_dedup": _REPEATS,
        "op9_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
WHERE rank <= 20""",
        "op2_quality_rules": _MEASURES + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM book""",
        "extra2_rule_ablations": _MEASURES + f"""
SELECT '{rules.CURRENT}' AS policy, rule, count(*) FILTER (WHERE failed & one <> 0)::BIGINT AS fails,
       count(*) FILTER (WHERE failed = one)::BIGINT AS fails_alone,
       count(*) FILTER (WHERE failed & (255 - one) = 0)::BIGINT AS kept_without
FROM (VALUES {rows}) AS r(rule, one), book GROUP BY rule""",
    }
