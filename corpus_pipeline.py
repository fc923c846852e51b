"""A training corpus from documents: quality rules, near-duplicates, secrets, packing.

Every stage reads all that the stage before it kept; all but the last return the
columns they get, whatever these are beside doc_id and text.  Each function takes
(spark, docs, sf_dir).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import packing, quality_rules, secret_scan, simhash
from gridloom.llm.arrow import map_rows
from gridloom.llm.queries import MAX_TOKENS, vocabulary
from gridloom.plans.durable import drop, scratch, stored

#: Near-duplicates: words in a shingle, and bits of 64 in which copies may differ (a similarity of 0.95 or more).
SHINGLE_WORDS, COPY_BITS = 5, 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines.

    A null or empty text has too few words and goes; a very long one is judged
    whole; rows that repeat, or have no id, are judged one by one; an empty table
    stays empty.  ``n_chars``, if there, is that of the cleaned text; other columns
    stay as they are, whatever their names.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), "text")
    found = quality_rules.assess(whole, id_col="row").filter("kept")
    changed = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("bigint")}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Texts without words are copies of each other; a row without an id stays only
    if no row of its group has one; rows that repeat the id that stays all stay,
    as the id can't tell them apart; an empty table stays empty.  Other columns
    stay as they are.
    """
    return simhash.representatives(docs, max_bits=COPY_BITS, width=SHINGLE_WORDS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked.

    A null text stays null; a very long one is scanned whole; overlapping spans
    are masked as one; an empty table stays empty.  ``n_chars``, if there, is that
    of the masked text where something is masked; other columns stay as they are.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def fn(*row):
        text = secret_scan.redact_text(row[at])
        out = list(row)
        if text is not row[at]:
            out[at] = text
            if chars is not None:
                out[chars] = len(text)
        yield tuple(out)

    return map_rows(docs, fn, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens, with the pieces' ids (little-endian unsigned 32-bit integers).

    A null or empty text is its end id alone; a very long one is cut; ties, repeated
    rows and rows without an id are as in :mod:`gridloom.llm.packing`; an empty
    table gives an empty result.  Columns beside doc_id and text are not read.
    """
    return packing.pack_documents(docs, vocabulary(), max_tokens=MAX_TOKENS, with_ids=True)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("secret_scan", secrets), ("best_fit_packing", packed)]
#: Fingerprints, components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each written to the shared folder; what a stage made on its way, and its input, goes once it is written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            new, new_path = stored(stage(spark, docs, sf_dir), name, keep=True)
        if path:
            drop(spark, path)
        docs, path = new, new_path
    return docs
