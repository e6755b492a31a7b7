"""One query for each operator of this folder, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, chat, decontamination, fim, kneser_ney, mixing, packing, pii, quality_rules, simhash, substring, token_codes
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.encode_and_read(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], turns.schema)
    return chat.digest(chat.format_chats(turns.union(planted)))


def _op4_sql() -> str:
    t = chat.Template()
    text = lambda c: f"coalesce({c}, '')"

    def escaped(x: str) -> str:
        for c in t.controls:
            head, last = re.escape(c[:-1]), re.escape(c[-1])
            x = rf"regexp_replace({x}, '({head})(\\*)({last})', '\1\2\\\3', 'g')"
        return x

    role = r"replace(replace(coalesce(role, ''), '\', '\\'), chr(10), '\n')"
    fixed = len(t.start) + len(t.after_role) + len(t.end)
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(coalesce(role, '') || chr(10) || {text("text")} || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
        CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length({text("text")}) END), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN {text("text")} END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), '')) AS loss_sha256,
        CAST(sum({fixed} + length({escaped(role)}) + length({escaped(text("text"))})) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.report(decontamination.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_token_codes, op3_simhash_near_dedup, op4_chat_formatting, op5_packing, op6_substring_dedup, op7_kneser_ney, op8_source_mixing, op9_personal_data,
        op10_nearest_vectors, op11_fill_in_middle, op12_decontamination, op13_filter_audit,
    )
}
SQL: dict[str, str] = {"op4_chat_formatting": _op4_sql(), "op6_substring_dedup": substring.sql(), "op8_source_mixing": mixing.sql(), "op11_fill_in_middle": fim.sql(), "op12_decontamination": decontamination.sql(), "op13_filter_audit": audit.sql()}
