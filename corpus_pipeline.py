"""From raw documents to packed training sequences.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame; each
result is written as Parquet and is the next stage's docs. All but the last return the columns
of documents, and each stage works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pivolith.llm import langid, linededup, neardup, packing, substring
from pivolith.llm.common import forget, table, written

#: Texts that are cut keep their place; only what has no recognisable language and near copies go.
LANGUAGE_SCORE = 0.5


def _through(docs: DataFrame, use: Callable[[DataFrame], DataFrame], where: Column | None = None, recount: bool = True) -> DataFrame:
    """use(docs), where it holds, with the columns of docs and only these: all but doc_id and text go through it
    under names of their own, so that nothing use() adds can take their place. recount: n_chars is made anew."""
    named = {c: c if c in ("doc_id", "text") else f"_carried_{i}" for i, c in enumerate(docs.columns)}
    out = use(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]))
    out = out if where is None else out.where(where)
    return out.select(*[F.length("text").cast("long").alias(c) if recount and c == "n_chars" else F.col(f"`{n}`").alias(c) for c, n in named.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, unchanged. Null and empty texts, texts without letters and unclear
    ones go; a null lang only keeps a row out of the learning, a null doc_id too. Repeated rows
    all stay or all go; an empty table stays empty."""
    model = langid.fit(docs)
    return _through(docs, lambda d: langid.identify(d, model), (F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE), recount=False)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the chunks of lines that occur earlier; one that loses all its lines, as a copy may, goes.
    Null and empty texts stay as they are; repeated rows are one document; a null doc_id comes before all others; an
    empty table stays empty."""
    return _through(docs, linededup.dedup_lines, (F.col("n_lines_removed") == 0) | (F.col("n_lines_removed") < F.col("n_lines_before")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 0.8 of their five-word shingles. Null, empty
    and blank texts and rows without doc_id stay; of rows with the same doc_id all stay or all go; an
    empty table stays empty."""
    gone = neardup.near_duplicates(docs, words=5, percent=80).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of 20-word windows that start earlier. A null text stays null, repeated rows are
    one document, a null doc_id comes before all others; an empty table stays empty."""
    return _through(docs, lambda d: substring.remove_repeats(d, outputs=("text",)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 1024 ids. A null or empty text is one closing id;
    repeated rows are packed each; an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packed)]

#: Tokenising and the learned language model can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        forget(before)  # if it is a stage's table
    return STAGES[-1][1](spark, docs, sf_dir)
