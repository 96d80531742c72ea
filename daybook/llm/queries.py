"""The operators applied to whole tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import bpe_codec, jaccard_join, line_dedup, packing, quality_rules, shards, token_counts, toxicity, transcripts, vector_search
from daybook.llm.common import shared_folder, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_codec.encode(table(spark, sf_dir, "documents"), ranks)
    decoded = bpe_codec.decode(encoded, ranks)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.is_held_out())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard_table = shards.ShardTable(spark, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    shard_table.append(table(spark, sf_dir, "documents"))
    shard_table.compact()
    shard_table.vacuum()
    rows = shard_table.read().select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "lang", "source", "n_chars", "shard")
    return rows.groupBy("doc_id", "text_md5", "lang", "source", "n_chars").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("shard").alias("n_shards"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", F.col("lines_before").cast("long").alias("lines_before"), F.col("lines_removed").cast("long").alias("lines_removed"), F.md5("text").alias("text_md5"))


def op9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = transcripts.as_transcript(table(spark, sf_dir, "conversations"))
    found = transcripts.render(transcripts.turns(transcripts.parse_transcripts(lines)))
    return found.select("conv_id", "turn_no", "role", "n_lines", F.md5("rendered").alias("rendered_md5"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_top_k, op3_bpe_codec, op4_packing, op5_jaccard_join, op6_toxicity, op7_shards, op8_line_dedup, op9_transcripts, op10_quality_rules)
}

ORACLE_SQL = {
    "op2_top_k": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS copy, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, q.copy, c.vec_id, coalesce(CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT), 0) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, copy ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_shards": """
        SELECT doc_id, md5(coalesce(text, '')) AS text_md5, lang, source, n_chars, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_shards
        FROM documents GROUP BY ALL""",
    "op8_line_dedup": r"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
        b AS (SELECT trim(line) AS key, min({'d': doc_id, 'l': line_no}) AS first FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
              GROUP BY 1 HAVING count(DISTINCT source) >= 5),
        m AS (SELECT l.*, b.key IS NOT NULL AND {'d': l.doc_id, 'l': l.line_no} <> b.first AS gone FROM l LEFT JOIN b ON trim(l.line) = b.key),
        c AS (SELECT doc_id, count(*) AS lines_before, CAST(count(*) FILTER (gone) AS BIGINT) AS lines_removed,
                     string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
        SELECT d.doc_id, coalesce(lines_before, 0) AS lines_before, coalesce(lines_removed, 0) AS lines_removed,
               CASE WHEN d.text IS NOT NULL THEN md5(coalesce(kept, '')) END AS text_md5
        FROM documents d LEFT JOIN c USING (doc_id)""",
}
