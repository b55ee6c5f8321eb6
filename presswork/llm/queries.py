"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.llm import decontaminate, exact_dedup, hard_negatives, html_text, merkle, minhash, mixing, pii, ppm, sharding, token_counts, token_files, toxicity
from presswork.plans.registry import Registry
from presswork.session import table

R = Registry()


def tokenizer(name: str) -> str:
    """Where a public tokenizer's vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@R.add("op1_ipf_source_mixing", mixing.sample_report_sql())
def op1(spark, d):
    return mixing.sample_report(table(spark, d, "documents"))


@R.add("op2_pigeonhole_decontamination")
def op2(spark, d):
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@R.add("op3_histogram_sort_sharding")
def op3(spark, d):
    return sharding.shard(table(spark, d, "documents"), 16)


@R.add("op4_prefix_token_counts")
def op4(spark, d):
    return token_counts.token_counts(table(spark, d, "documents"), tokenizer("byte_bpe_50k.json"))


@R.add("op5_ppm_scores")
def op5(spark, d):
    return ppm.ppm_scores(table(spark, d, "documents"), ppm.held_out_fold())


@R.add("op6_orc_token_files")
def op6(spark, d):
    return token_files.tokenise_to_files(table(spark, d, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


@R.add("op7_min_cut_html_text")
def op7(spark, d):
    return html_text.extract(table(spark, d, "pages"))


@R.add(
    "op8_progressive_exact_dedup",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g USING (x)""",
)
def op8(spark, d):
    docs = table(spark, d, "documents").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup.exact_dedup(docs, carry=("text_sha256",), hash_col="text_sha256")


@R.add("op9_ftrl_toxicity")
def op9(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@R.add("op10_circulant_minhash_near_dedup")
def op10(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents"), n=4, percent=80)


@R.add("op11_fagin_hard_negatives", hard_negatives.mined_sql())
def op11(spark, d):
    rows = table(spark, d, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


@R.add("op12_merkle_manifest", merkle.manifest_sql())
def op12(spark, d):
    rows = merkle.manifest(table(spark, d, "documents"), claimed=merkle.tampered())
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root", "verified")


@R.add("op13_bootstrapped_pii")
def op13(spark, d):
    return pii.report(pii.find_pii(table(spark, d, "documents")))


def queries() -> dict:
    return dict(R.queries)


def oracle_sql() -> dict[str, str]:
    return dict(R.sql)
