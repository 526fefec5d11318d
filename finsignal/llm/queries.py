"""One query for each operator over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, chat, exact_dedup, exact_topk, mixing, pii, repeats, sharding, simhash, spiece, toxicity, whitening


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op5_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_kmeans_tree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_read(spark, sf_dir, "embeddings"))


def op8_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_read(spark, sf_dir, "embeddings"))


SQL_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20"""


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, _read(spark, sf_dir, "labels")))


def op7_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op4_viterbi_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.encode(_read(spark, sf_dir, "documents"))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"))


def op11_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"))


def op12_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


SQL_OP13 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM t WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id)"""

#: CRC-32 bit by bit over the bytes; DuckDB has no function for it.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
  lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, list_reduce([xor(c, b) & 255, 1, 2, 3, 4, 5, 6, 7, 8],
  lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END))))"""

SQL_OP10 = f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, ({_CRC})::BIGINT AS text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS k1, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 9, 8))::BIGINT AS k0
  FROM documents),
jumps AS (
  SELECT r, 0::BIGINT AS j, k1::HUGEINT * 4294967296 + k0 AS k FROM base
  UNION ALL
  SELECT r, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / (((k2 // 8589934592) + 1)::DOUBLE)))::BIGINT, k2
  FROM (SELECT r, j, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM jumps WHERE j < 17)),
placed AS (SELECT r, CAST(max(j) FILTER (j < 16) AS INTEGER) AS shard, CAST(max(j) FILTER (j < 17) AS INTEGER) AS grown_shard FROM jumps GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY k0 % 512, grown_shard, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM base JOIN placed USING (r)"""


def op2_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations plus conversation -1, rendered, then read back from the rendered text."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.format_turns(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(column: str) -> str:
    for plain, code in chat.Template().codes():
        column = f"replace({column}, '{plain}', '{code}')"
    return column


SQL_OP2 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>' || replace({_sql_escaped("role")}, chr(10), '\n') || chr(10) || {_sql_escaped("text")} || '<|end|>'))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

def op1_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its calibrated probability (6 decimals) and whether the sample holds it."""
    return mixing.mix(_read(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6))


def _sql_op1(targets: mixing.Targets = mixing.Targets()) -> str:
    ctes = [
        f"""words AS MATERIALIZED (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS t, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{mixing.ANCHOR}')) AS ws FROM documents)""",
        "df AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM words) GROUP BY word)",
        f"""anchors AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY n, word) AS place FROM (SELECT * FROM df WHERE n * {mixing.TOPIC_LEAST} >= (SELECT count(*) FROM words)
          AND n * {mixing.TOPIC_MOST} <= (SELECT count(*) FROM words) ORDER BY n DESC, word LIMIT {mixing.TOPICS}))""",
        "topics AS MATERIALIZED (SELECT r, arg_min(word, place) AS topic FROM (SELECT r, unnest(ws) AS word FROM words) JOIN anchors USING (word) GROUP BY r)",
        """facts AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(topic, '(other)') AS topic,
          len(regexp_extract_all(t, '[^ \\t\\n\\v\\f\\r]+'))::BIGINT AS tokens FROM words LEFT JOIN topics USING (r))""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM facts GROUP BY ALL)",
    ]
    for dim in mixing.DIMS:
        if dim in targets.weights:
            whens = " ".join(f"WHEN {dim} = '{k}' THEN {v}" for k, v in targets.weights[dim].items())
            raw = f"CASE {whens} ELSE share END"
        else:
            raw = f"pow(share, {targets.exponents.get(dim, 1.0)})"
        ctes.append(f"v_{dim} AS MATERIALIZED (SELECT {dim}, CASE WHEN share > 0 THEN {raw} ELSE 0 END AS raw FROM (SELECT {dim}, sum(tokens) / (SELECT sum(tokens) FROM cells) AS share FROM cells GROUP BY {dim}))")
        ctes.append(f"t_{dim} AS MATERIALIZED (SELECT {dim}, raw / (SELECT sum(raw) FROM v_{dim}) * (SELECT sum(tokens) FROM cells) AS g_{dim} FROM v_{dim})")
    ctes.append("w0 AS MATERIALIZED (SELECT *, tokens AS w FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    steps = [dim for _ in range(targets.sweeps) for dim in mixing.DIMS]
    for i, dim in enumerate(steps):
        ctes.append(f"w{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {dim}) > 0 THEN w * g_{dim} / sum(w) OVER (PARTITION BY {dim}) ELSE 0 END AS w) FROM w{i})")
    ctes.append(f"rates AS MATERIALIZED (SELECT source, lang, topic, r / max(r) OVER () AS rate FROM (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS r FROM w{len(steps)}))")
    draw = f"('0x' || substr(md5('{targets.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496"
    return f"""WITH {", ".join(ctes)}
    SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, p >= 1 OR {draw} < p AS selected, (p >= 1 OR {draw} < p)::INTEGER AS copies
    FROM (SELECT *, CASE WHEN tokens = 0 THEN 1.0 ELSE rate END::DOUBLE AS p FROM facts JOIN rates USING (source, lang, topic))"""


QUERIES = {"op13_streaming_exact_dedup": op13_streaming_exact_dedup, "op12_jacobi_davidson_whitening": op12_jacobi_davidson_whitening, "op11_merge_path_alignment": op11_merge_path_alignment, "op6_repeated_bytes": op6_repeated_bytes, "op4_viterbi_sentencepiece": op4_viterbi_sentencepiece, "op7_crf_pii": op7_crf_pii, "op9_crf_toxicity": op9_crf_toxicity, "op3_kmeans_tree_ann": op3_kmeans_tree_ann, "op8_kdtree_topk": op8_kdtree_topk, "op5_simhash_popcount": op5_simhash_popcount, "op1_raked_mixture": op1_raked_mixture, "op2_chat_events": op2_chat_events, "op10_jump_sharding": op10_jump_sharding}
ORACLE = {"op13_streaming_exact_dedup": SQL_OP13, "op8_kdtree_topk": SQL_OP8, "op1_raked_mixture": _sql_op1(), "op2_chat_events": SQL_OP2, "op10_jump_sharding": SQL_OP10}
