"""Build of a training corpus: quality rules, near-duplicates, secrets, mixture, tokens.

Each stage takes the whole result of the one before it and is written to the
shared folder and reread, so a lost executor repeats one stage at most.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, mixing, rules, secrets, simhash
from tickloom.llm.common import spare, table, written
from tickloom.llm.queries import vocabulary

# Near-duplicates share 0.8 of their five-word shingles, counted exactly; candidates agree in a
# band of least hashes, or in all but 10 of 64 bits and all but 12 of a second fingerprint.
NEAR = {"words": 5, "radius": 10, "verify": 12, "jaccard": 0.8}

# The weights as they are; rows that agree in id and text are interchangeable.
MIX = {"ties": ["text"], "exact": True}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the newest policy keeps; a null text has no words and goes."""
    prefix = spare(docs, "rules_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return rules.judged(docs, prefix=prefix).filter(F.col(prefix + "kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id."""
    return simhash.deduplicated(docs, **NEAR)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; ``n_chars`` follows the text where it was its length."""
    out = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    size = F.coalesce(F.length("text").cast(kind), F.col("n_chars"))
    return out.withColumn("n_chars", size).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, in which every source keeps its target share."""
    return mixing.mixed(docs, **MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, place, ids, n_tokens, decoded_sha256): the token ids of every document, and the
    digest of what the decoder makes of them, in the order of the mixture.

    A scan doesn't keep the order of the files it reads, so ``place`` is worked
    out again from the rows, by the schedule the mixture was written in.
    """
    keep = docs.select(*[c for c in ("doc_id", "source", "lang", "text") if c in docs.columns])
    return bpe.encode_documents(mixing.placed(keep, **MIX), vocabulary(), decoded="decoded_sha256").drop("text")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

# Fingerprints and merges aren't SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the rows come in the order of the mixture."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs.orderBy("place")
