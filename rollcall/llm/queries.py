"""Registered queries over the driver's tables: each applies one operator,
with production parameters, to its whole table and derives the digest columns
of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import (chat_format, conversation_repair, decontam, html_extract, langid, line_dedup, ngram_join, packing, quality,
                          secret_scan, substring_dedup, token_files, vector_codes)
from rollcall.llm.common import written
from rollcall.session import scratch_path
from rollcall.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

#: the public vocabulary file the token queries use
TOKENIZER = "word_bpe_49k.json"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents", ["doc_id", "text"])


def op1_html_extract(spark, d):
    pages = read_table(spark, d, "pages", ["page_id", "url", "html"])
    return html_extract.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op2_line_dedup(spark, d):
    out = line_dedup.dedup_lines(_documents(spark, d), min_chars=1, min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_packing(spark, d):
    return packing.pack_documents(_documents(spark, d), public_tokenizers.path(TOKENIZER))


def op4_token_files(spark, d):
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_documents(spark, d), path, public_tokenizers.path(TOKENIZER))
    return token_files.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_decontam(spark, d):
    bench = read_table(spark, d, "benchmark", ["item_id", "text"])
    out = decontam.decontaminate(_documents(spark, d), bench)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      "contaminated")


def op6_langid(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "text", "lang"])
    out = langid.held_out()
    learned = docs.where(F.col("doc_id").isNotNull() & ~out)
    model = langid.train(langid.training_rows(learned, "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_secret_scan(spark, d):
    docs = _documents(spark, d)
    found = secret_scan.find_secrets(docs, secret_scan.learn_formats(docs))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op8_substring_dedup(spark, d):
    return substring_dedup.repeated_passages(_documents(spark, d))


def op9_quality(spark, d):
    return quality.score_quality(_documents(spark, d), keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "p_good")


def op10_ngram_join(spark, d):
    return ngram_join.jaccard_components(_documents(spark, d), words=4, num=85, den=100).select(
        "doc_id", "n_shingles", "component_id")


def op11_vector_codes(spark, d):
    rows = read_table(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    coded, books = vector_codes.compress(rows)
    return vector_codes.with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults: a row in twenty goes, loses its text, loses its
    sentence ends, stands twice or becomes a user's, by the hash of its key (nulls:
    one space)."""
    def filled(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    copies = F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))
    text = F.when(fault == 1, "").when(fault == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    return conversations.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(filled("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def op12_conversation_repair(spark, d):
    conversations = read_table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    rows = damaged(conversations)
    report = written(conversation_repair.repair_report(rows, ids=conversations), "repair-report")
    return conversation_repair.repaired_digests(rows, report)


def op13_chat_format(spark, d):
    conversations = read_table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    return chat_format.formatted_digests(chat_format.planted(spark, conversations))


def queries() -> dict[str, Query]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_line_dedup": op2_line_dedup,
        "op3_packing": op3_packing,
        "op4_token_files": op4_token_files,
        "op5_decontam": op5_decontam,
        "op6_langid": op6_langid,
        "op7_secret_scan": op7_secret_scan,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_quality": op9_quality,
        "op10_ngram_join": op10_ngram_join,
        "op11_vector_codes": op11_vector_codes,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_chat_format": op13_chat_format,
    }
