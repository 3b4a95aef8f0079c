"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, decontamination, exact_dedup, langid, lm, mixing, phrases, secrets, sharding, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.sql("SELECT -7L AS conv_id, turn, role, text FROM VALUES (0L, 'user', :t), (1L, 'assistant', :t) AS v(turn, role, text)", {"t": CONTROL_TEXT})
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return chat.chat_digest(chat.format_chats(turns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.filter(~out))
    return langid.identify(docs.withColumn("held_out", out), model, keep=("held_out",))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_texts(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "op11_phrases": op11_phrases,
    "op12_bpe": op12_bpe,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), m AS (
          SELECT *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') AS esc,
            coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS first
          FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(length(esc) + CASE WHEN first
            THEN length('### ' || replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') || ': ') + length('</turn>') + 1
            ELSE length('<cut>') END)::BIGINT AS formatted_chars
        FROM m GROUP BY conv_id
    """,
    "op2_exact_dedup": """
        WITH d AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
          doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op6_decontamination": r"""
        WITH w AS (
          SELECT doc_id AS id, 0 AS side, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark
        ), l AS (
          SELECT id, side, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM w
        ), s AS (
          SELECT DISTINCT id, side, array_to_string(ws[i:i + 4], ' ') AS s
          FROM (SELECT id, side, ws, unnest(range(1, len(ws) - 3)) AS i FROM l WHERE len(ws) >= 5)
        ), n AS (SELECT id, count(*) AS n_shingles FROM s WHERE side = 1 GROUP BY id)
        SELECT d.id AS doc_id, b.id AS item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
        FROM s d JOIN s b ON d.s = b.s AND d.side = 0 AND b.side = 1 JOIN n ON n.id = b.id
        GROUP BY d.id, b.id, n_shingles HAVING count(*) >= 0.8 * n_shingles
    """,
    "op11_phrases": r"""
        WITH p AS (
          SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
          FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
        ), c AS MATERIALIZED (
          SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS a
          FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p), (VALUES (1), (2), (3)) AS v(m)
          WHERE i + m - 1 <= len(ws) GROUP BY lang, m, phrase
        ), x AS MATERIALIZED (
          SELECT lang, m, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:m], ' ') AS rp
          FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS cut FROM c WHERE m > 1 AND a >= 10)
        ), k AS (
          SELECT x.*, l.a AS l, r.a AS r, (1000000::HUGEINT * x.a * x.a // (l.a::HUGEINT * r.a))::BIGINT AS score
          FROM x JOIN c l ON l.lang = x.lang AND l.phrase = x.lp JOIN c r ON r.lang = x.lang AND r.phrase = x.rp
        ), gone AS (
          SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a, unnest([lp, rp]) AS phrase FROM x WHERE m = 3) t
          JOIN c s ON s.lang = t.lang AND s.phrase = t.phrase WHERE s.m = 2 AND 100 * t.a >= 50 * s.a
        ), o AS (
          SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
          FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM k)
          JOIN (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang) USING (lang)
          ANTI JOIN gone USING (lang, phrase) WHERE best = 1
        )
        SELECT * FROM o WHERE rank <= 2000
    """,
}
