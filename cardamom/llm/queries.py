"""The queries of the numbered operators, with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardamom.llm import chat, extract, minhash, mixing, oracles, packing, periodic, phrases, pii, quality, suffix, tokens, vectors, warc
from cardamom.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also over copies of every third vector: one twice as long, and one with every eighth component stretched by a factor that the id chooses."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    third = e.where("vec_id % 3 = 0")
    by = 1 + 0.25 * (F.col("vec_id") % 8)
    twice = third.select(F.col("vec_id") + 1_000_000_000, F.transform("embedding", lambda x: x * 2), "label")
    bent = third.select(F.col("vec_id") + 2_000_000_000, F.transform("embedding", lambda x, i: F.when(i % 8 == 0, (x * by).cast("float")).otherwise(x)), "label")
    return vectors.near_vectors(e.union(twice).union(bent), cosine=0.93)


def op4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also over captures of every third page under another URL, every second of them with the same bytes."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    again = p.where("page_id % 3 = 0").select(F.col("page_id") + 1_000_000_000, F.concat("url", F.lit("&again")), F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.concat("html", F.lit("\n"))))
    return warc.round_trip(p.union(again), least=0)


def op10_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also over what was logged of every third conversation earlier, up to some turn, and over copies of every fifth."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    early = c.where("conv_id % 3 = 0 and turn <= conv_id % 4").withColumn("conv_id", F.col("conv_id") + 1_000_000_000)
    copies = c.where("conv_id % 5 = 0").withColumn("conv_id", F.col("conv_id") + 2_000_000_000)
    return chat.rendered(c.union(early).union(copies))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"), size=200)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(table(spark, sf_dir, "documents"))
    base, prose = quality.passes(quality.BASE), quality.passes(quality.PROSE)
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), prose.alias("kept"), "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")), quality.PROSE)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.planned(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic(periodic.planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    found = found.withColumn("r", periodic.longest("runs"))
    milli = F.floor(1000 * F.col("r.length") / F.col("r.period")).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "r.start", "r.length", "r.period", milli.alias("exponent_milli"),
        F.sha2(periodic.listed("runs"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), words=3, least=10, covered=50, top=2000)


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "pipeline": pipeline,
        "op1_minhash": op1_minhash,
        "op2_vectors": op2_vectors,
        "op2_copies": op2_copies,
        "op3_tokens": op3_tokens,
        "op4_warc": op4_warc,
        "op4_copies": op4_copies,
        "op5_packing": op5_packing,
        "op6_suffix": op6_suffix,
        "op7_quality": op7_quality,
        "quality_ablation": quality_ablation,
        "op8_pii": op8_pii,
        "op9_mixing": op9_mixing,
        "op10_chat": op10_chat,
        "op10_snapshots": op10_snapshots,
        "op11_periodic": op11_periodic,
        "op12_phrases": op12_phrases,
        "op13_html": op13_html,
    }


def oracle_sql():
    return dict(oracles.SQL)
