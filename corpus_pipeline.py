"""Corpus pipeline: language ID, near-duplicates, repeated passages, secrets, packing.

``STAGES`` are functions ``(spark, docs, sf_dir) -> DataFrame`` over the
columns of ``documents``; each works on all rows its predecessor kept, and
all but the last return those columns.  ``run`` applies them in turn,
writing each stage's rows as Parquet below ``spark.checkpoint.dir`` and
reading them again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; missing ones are null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    have = set(docs.columns)
    return docs.select(*[(docs[c] if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with ``row``, a written number of their own: ``doc_id`` may be null or repeated."""
    return cut(docs.withColumn("row", F.monotonically_increasing_id()), name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letter go; ``lang`` is the prediction (null where no language could be learned)."""
    from ticklake.llm.langid import fit, predict
    docs = _shaped(docs)
    found = predict(docs, fit(docs), keep_columns=True).where(F.col("text").rlike(r"\p{L}"))
    return found.select("doc_id", "text", F.nullif("lang_pred", F.lit("und")).alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the smallest id (null ids last).  Empty texts stay."""
    from ticklake.llm.minhash import near_dedup
    rows = _numbered(_shaped(docs), "rows-near")
    found = near_dedup(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    kept = rows.select("row", "doc_id").join(found, "row").groupBy("component_id").agg(F.min(first).alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by passages of 200 bytes that occur more than once are cut out; emptied documents go."""
    from ticklake.llm.suffix_dedup import remove_repeats
    clean = remove_repeats(_shaped(docs), keep=["lang", "source"], by_content=True).where("n_removed < n_bytes OR n_bytes = 0")
    return clean.select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark that names its kind."""
    from ticklake.llm.secret_scan import fit, redact
    docs = _shaped(docs)
    return redact(docs, fit(docs)).select(
        "doc_id", F.col("redacted").alias("text"), "lang", "source", F.char_length("redacted").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 1024 (see ``ticklake.llm.packing``)."""
    import public_tokenizers

    from ticklake.llm.packing import pack_documents
    return pack_documents(_shaped(docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: Model fitting, near-duplicate components and token ids have no SQL form; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


REGISTERED = ({"pipeline": run}, {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL})
