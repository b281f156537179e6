"""Training corpus in five stages: toxicity, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents (doc_id, text, lang, source, n_chars). Other
columns, whatever their names, are left behind by the first; an empty table passes all stages
as one; texts of any length are read whole; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, neardup, packing, suffixes, toxicity
from weftline.llm.common import row_keys, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.7 go; all others stay as they are, repeated rows, null ids and empty texts too."""
    docs = clean(docs)
    model = toxicity.model_of(docs, table(spark, sf_dir, "labels"))
    return clean(toxicity.score(docs, model, COLUMNS).where(F.col("score") < toxicity.THRESHOLD))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the least doc_id, nulls last, and of its rows the least by hash. Documents without words all stay."""
    docs = clean(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = neardup.near_duplicates(docs, by_row=True).where(F.col("group").isNotNull())
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("m")).select("m.k1", "m.k2")
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""
    rows = docs.where(~blank).withColumns({k: c for k, c in zip(("k1", "k2"), row_keys("doc_id", "text"), strict=True)}).dropDuplicates(["k1", "k2"])
    return clean(rows.join(first, ["k1", "k2"], "left_semi")).unionByName(clean(docs.where(blank)))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of 200 bytes or more that occur elsewhere go, the first occurrence too; documents that had text and are left with none go as well, those that had none stay."""
    docs = clean(docs)
    cut = suffixes.remove_repeats(docs, extra=("lang", "source"))
    cut = cut.where((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    return clean(cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each pass over its source that takes words of it; documents without words stay. Null sources form one; rows that tie are the same."""
    docs = clean(docs).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    mixed = mixing.mix(docs, extra=("h1", "h2", "lang", "n_chars"))
    passes = [F.when(F.col(f"epoch_{e}") > 0, F.lit(e)) for e in range(mixing.MOST)]
    times = mixed.withColumn("times", F.when(F.col("size") == 0, F.array(F.lit(0))).otherwise(F.array_compact(F.array(*passes))))
    chosen = times.select(*[c for c in COLUMNS if c != "text"], "h1", "h2", F.explode("times").alias("time"))
    texts = docs.select("h1", "h2", "text").dropDuplicates(["h1", "h2"])  # many rows may share a text
    return clean(chosen.join(texts, ["h1", "h2"]))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a sequence of 4096 tokens (columns of packing.pack)."""
    return packing.pack(stored(packing.pieces(clean(docs))))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeats),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]
#: The learned lexicon, the signatures and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's rows written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
