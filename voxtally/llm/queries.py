"""The registered query of each operator and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxtally.llm import decontaminate, jaccard, search, spelling


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.llm.ogg import media_to_features, text_to_media

    return media_to_features(text_to_media(documents(spark, sf_dir)))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.llm.langid import identify, learn_profiles

    docs = documents(spark, sf_dir)
    return identify(docs, learn_profiles(docs))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.llm.common import fresh_dir
    from voxtally.llm.token_files import read_token_files, write_token_files

    out = fresh_dir(spark, "token-files")
    write_token_files(documents(spark, sf_dir), out, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, out)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.llm.mixing import mixing_report

    return mixing_report(documents(spark, sf_dir))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.llm.main_text import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.llm.sanitise import private_spans

    return private_spans(documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.llm.decontaminate import contamination_report

    return contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op9_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.llm.unigram_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.llm.toxicity import learn, score_documents

    docs = documents(spark, sf_dir)
    return score_documents(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.llm.spelling import variants

    return variants(documents(spark, sf_dir))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg_media": op1_ogg_media,
    "op2_language": op2_language,
    "op3_token_files": op3_token_files,
    "op4_mix": op4_mix,
    "op5_main_text": op5_main_text,
    "op6_sanitise": op6_sanitise,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_unigram_counts": op9_unigram_counts,
    "op10_toxicity": op10_toxicity,
    "op11_spelling": op11_spelling,
    "op12_search": op12_search,
    "op13_jaccard": op13_jaccard,
}

ORACLES: dict[str, str] = {"op7_decontaminate": decontaminate.SQL, "op11_spelling": spelling.SQL, "op12_search": search.SQL, "op13_jaccard": jaccard.SQL}
