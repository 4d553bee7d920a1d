"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import archive, bpe, hosts, htmltext, langid, media, mixing, negatives, quotes, rules, secrets, simhash, whitening
from tickloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, as text; read where the query is built."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


@query("op3_bpe")
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encode and decode every document; repeated rows are repeated in the result."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digests(docs, vocabulary()).drop("text")


@query("op9_rules", rules.oracle_sql())
def op9_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements, failure bits and the verdict of the newest policy for every document, from the stored ledger."""
    out = rules.verdicts(rules.stored(table(spark, folder, "documents"), "doc_id"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits",
    )


@query("rule_ablations", rules.ablation_sql())
def rule_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule of each version of the policies decides, from the stored ledger of all documents."""
    return rules.ablations(rules.stored(table(spark, folder, "documents"), "doc_id"))


@query("op5_secrets")
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.scanned(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query("op2_langid")
def op2_langid(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those whose id's checksum is not 2 modulo 4.

    A null id belongs to neither part: it isn't learned from and isn't held out.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.train(docs, learn=fold != 2, order=F.col("doc_id"))
    out = langid.identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op8_simhash")
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, two bits."""
    g = simhash.grouped(table(spark, folder, "documents"), words=3, radius=2)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_mixing", mixing.oracle_sql())
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Block window, slot and place in the mixture of every document."""
    return mixing.scheduled(table(spark, folder, "documents").select("doc_id", "source"))


@query("op6_hosts", hosts.oracle_sql())
def op6_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict for every page; a page's outcome is the label with its number: bad if toxic or of low quality."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.coalesce(bad, F.lit(0)).alias("bad"))
    return hosts.judged(table(spark, folder, "pages").select("page_id", "url"), labels).drop("url")


@query("op10_archive", archive.ORACLE_SQL)
def op10_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Archive all pages, then read the archive back and check it."""
    made = archive.write(table(spark, folder, "pages"))
    return archive.read(spark, made).select(
        F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to",
    )


@query("op1_webp")
def op1_webp(spark: SparkSession, folder: str) -> DataFrame:
    """Every text stored as lossless WebP and read back."""
    return media.round_trip(table(spark, folder, "documents"))


@query("op4_quotes")
def op4_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Reply trees of all conversations, stored as mail that quotes two messages back.

    The conversations of the test tables hold no quotes, so each message is
    first given those a mail program would add; the operator sees only texts.
    """
    return quotes.linked(quotes.as_mail(table(spark, folder, "conversations")))


@query("op11_negatives", negatives.oracle_sql())
def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives for every fiftieth vector; a seventh of all labels are first moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.mined(rows, "vec_id", "embedding", "label", anchors=F.col("vec_id") % 50 == 0)


@query("op12_main_text")
def op12_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page, by weights of all pages that mark theirs."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return htmltext.extracted(pages, htmltext.learned(pages)).select("page_id", "url", "text", "n_chars")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened vectors, 32 components."""
    return whitening.whitened(table(spark, folder, "embeddings"), "vec_id", "embedding")
