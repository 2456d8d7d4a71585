"""The registered queries of this subpackage: each runs its operator over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.decontam import decontaminate
from skyloom.llm.fim import fill_in_middle, restored
from skyloom.llm.htmltext import main_text
from skyloom.llm.langid import language_id
from skyloom.llm.licenses import license_scan
from skyloom.llm.linededup import line_dedup
from skyloom.llm.lm import lm_scores
from skyloom.llm.minhash import near_duplicates
from skyloom.llm.negatives import hard_negatives
from skyloom.llm.oracles import ORACLES
from skyloom.llm.packing import pack
from skyloom.llm.quality import quality
from skyloom.llm.suffix import suffix_dedup
from skyloom.llm.toxicity import toxicity


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality_rules(spark, sf_dir):
    return quality(read(spark, sf_dir, "documents"))


def op2_near_duplicates(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), k=2)


def op3_decontamination(spark, sf_dir):
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("distance")


def op4_best_fit_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), bpe_path())


def op5_lm_scores(spark, sf_dir):
    return lm_scores(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed_lines", "n_removed_chunks")


def op8_main_text(spark, sf_dir):
    return main_text(read(spark, sf_dir, "pages"))


def op9_toxicity(spark, sf_dir):
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_license_scan(spark, sf_dir):
    return license_scan(read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(read(spark, sf_dir, "documents"))
    digests = [F.sha2(x, 256).alias(c) for x, c in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_language_id(spark, sf_dir):
    return language_id(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(256 * v.cast("double")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").where(finite).select("vec_id", label.alias("label"), whole.alias("vector"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_near_duplicates, op3_decontamination, op4_best_fit_packing, op5_lm_scores, op6_suffix_dedup, op7_line_dedup, op8_main_text, op9_toxicity, op10_license_scan, op11_fill_in_middle, op12_language_id, op13_hard_negatives)}

