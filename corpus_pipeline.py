"""The corpus pipeline: toxic documents go, repeated line runs go, one document of each near-duplicate group stays, the rest is packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import lines, minhash, packing, toxicity
from rillflow.llm.common import cut, table


def _columns(docs: DataFrame, changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns of docs, out of the row that an operator has kept; or what stands in changed."""
    return [(changed or {}).get(c, F.col("row")[c]).alias(c) for c in docs.columns]


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest segment scores under the threshold; the model is fitted on labelled rows of docs."""
    value, bias = toxicity.model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, value, bias).where(F.col("toxic_score") < toxicity.THRESHOLD).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs. A document that had words and has none left goes; n_chars is set anew."""
    found = lines.repeated_lines(docs)
    has_words = F.coalesce(F.regexp_like("kept_text", F.lit("\\S")), F.lit(False))
    same = F.size("line_runs") == 0
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, F.col("row")["n_chars"]).otherwise(F.length("kept_text").cast(dict(docs.dtypes)["n_chars"]))
    return found.where(same | has_words).select(*_columns(docs, changed))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates (5 words, 0.8).

    Rows are judged by doc_id and text: of rows that share a doc_id, one goes if its own text is in the group of a lesser
    doc_id. Rows that repeat both stay or go together. A null doc_id is behind all others; in a group without
    any, the text of the least MD5 stays.
    """
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    marked = minhash.near_duplicates(docs.select("doc_id", "text", key.alias("_text")), key="_text")
    gone = marked.where("not kept").select(F.col("doc_id").alias("_id"), "_text").distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (key == F.col("_text")), "left_anti").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and place."""
    return packing.pack_documents(docs, escape=False)


STAGES = [("toxicity", toxic_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole of documents, each on all rows that the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
