"""The thin queries over the operators, and the SQL that says what some must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread


#: The key of the surrogates of these queries; a real run has one of its own.
SURROGATE_KEY = "queries"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens, merge_counter

    return count_tokens(table(spark, sf_dir, "documents"), lambda: merge_counter(vocabulary("byte_bpe_50k.json")))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import replace_entities

    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeated_bytes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digest, expand

    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(expand(table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra)))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold="0.85")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_folder, read_archives, write_archives

    path = archive_folder(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, word_encoder

    pieces = pack(table(spark, sf_dir, "documents"), lambda: word_encoder(vocabulary("word_bpe_49k.json")), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens")


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_on, identify

    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_embedding_dedup": OP4, "op6_chat_format": OP6, "op8_warc": OP8}


#: What op6 must return; the lengths follow from the template and the number of escapes in each text.
OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    4 + length(role) + 2 + length(text) + 9
      + length(text) - length(replace(text, '\', ''))
      + (length(text) - length(replace(text, '###', ''))) // 3
      + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM s
)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n - 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP8 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, unhex(sha1(coalesce(html, ''))) AS d FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS original,
    list_reduce(list_prepend('', list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(substr(bits, 1 + CAST(5 * i AS INTEGER), 1) AS INTEGER) * 16 + CAST(substr(bits, 2 + CAST(5 * i AS INTEGER), 1) AS INTEGER) * 8
        + CAST(substr(bits, 3 + CAST(5 * i AS INTEGER), 1) AS INTEGER) * 4 + CAST(substr(bits, 4 + CAST(5 * i AS INTEGER), 1) AS INTEGER) * 2
        + CAST(substr(bits, 5 + CAST(5 * i AS INTEGER), 1) AS INTEGER), 1))), lambda x, y: x || y) AS payload_digest
  FROM (SELECT *, CAST(CAST(d AS BIT) AS VARCHAR) AS bits FROM p)
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM b
"""

OP4 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND list_bool_or(list_transform(embedding, lambda c: c <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95
), reach(id, seen) AS (
  SELECT a, a FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.seen
), c AS (
  SELECT id, least(id, min(seen)) AS component FROM reach GROUP BY id
), n AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
