"""Documents to training data in five stages: toxicity, SimHash near-dedup, benchmark decontamination, mixing, token ids.

Each stage works on all rows that the one before it kept, is written as Parquet and read again. The first four return the
columns of documents. Clean documents, empty ones among them, pass the filtering stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxtally.llm import decontaminate, mixing, simhash, token_files, toxicity
from voxtally.llm.common import fresh_dir, remove_dir
from voxtally.llm.queries import tokenizer_file

TOKENIZER, END_ID = "byte_bpe_50k.json", 0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The lexicon is learned from these documents and the labels that aren't held out."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. The rows aren't put in the shards' order, as the token files are written by ascending doc_id."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents as files in the shared folder; a row for each document of the files."""
    out = fresh_dir(spark, "token-files")
    token_files.write_token_files(docs, out, tokenizer_file(TOKENIZER), end_id=END_ID)
    return token_files.read_token_files(spark, out)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
    ("token_files", write_tokens),
]

#: SQL can't express the lexicon, the fingerprints, the draws or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's folder goes when the next one's is written; the last one's and the token files stay."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        if before is not None:
            remove_dir(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
