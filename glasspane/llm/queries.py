"""The registered queries of this package; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import Shelf, read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, search

    return digest(search(read(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import cross_checked

    return cross_checked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import digest, scan

    return digest(scan(read(spark, sf_dir, "documents")))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup

    return dedup(read(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import verdicts

    return verdicts(read(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judge(read(spark, sf_dir, "documents")).select(*columns)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import cross_checked

    return cross_checked(read(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import link

    return link(read(spark, sf_dir, "documents"), size=4)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tries import trie

    return trie(read(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import token_files

    folder = f"{Shelf(spark, 'tokens').root}/files"
    token_files.write(read(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end=2)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_licenses": op2_licenses, "op3_lines": op3_lines, "op4_urls": op4_urls, "op5_quality": op5_quality, "op6_language": op6_language, "op7_minhash": op7_minhash, "op8_pii": op8_pii, "op9_packing": op9_packing, "op10_decontamination": op10_decontamination, "op11_trie": op11_trie, "op12_alignment": op12_alignment, "op13_tokens": op13_tokens}


def oracle_sql() -> dict[str, str]:
    from .tries import trie_sql
    from .urls import verdicts_sql

    return {"op4_urls": verdicts_sql(), "op11_trie": trie_sql()}
