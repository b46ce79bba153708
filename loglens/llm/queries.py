"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import (
    alignment,
    byte_bpe,
    decontaminate,
    filter_audit,
    html_text,
    line_dedup,
    mixing,
    outliers,
    quality,
    simhash,
    suffix_dedup,
    token_rollup,
    url_rules,
)
from loglens.llm.shared import stored
from loglens.session import work_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = decontaminate.scan_column(_table(spark, sf_dir, "benchmark"))
    found = _table(spark, sf_dir, "documents").select("doc_id", scan.alias("scan"))
    return found.select(
        "doc_id",
        "scan.n_words",
        "scan.n_hit",
        F.size("scan.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "scan.items"), 256).alias("items_sha256"),
        decontaminate.is_contaminated("scan").alias("contaminated"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    rows = quality.scored(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id", quality.is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' sources are their hosts."""
    found = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"), dropped="n_dropped")
    return found.select("doc_id", "source", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches: all documents by one tokenizer, all by another, low quality deleted, toxic ones counted
    anew as emptied, and the second batch run again."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    each = stored(
        docs.select(
            "doc_id", "source", "lang",
            token_rollup.words_counter("text").alias("words"), token_rollup.pieces_counter("text").alias("pieces"),
        ),
        "counts",
    )

    def by(frame: DataFrame, *tokenizers: str) -> DataFrame:
        named = [F.struct(F.lit(f"{t}-1").alias("tokenizer"), F.col(t).alias("tokens")) for t in tokenizers]
        rows = frame.withColumn("count", F.explode(F.array(*named)))
        return rows.select("source", "lang", F.col("count.tokenizer").alias("tokenizer"), F.col("count.tokens").alias("tokens"))

    table = token_rollup.Rollup(spark, work_path(spark, "rollup"))
    table.commit("words", token_rollup.inserted(by(each, "words")))
    table.commit("pieces", token_rollup.inserted(by(each, "pieces")))
    low = each.join(labels.filter("quality = 0"), "doc_id", "left_semi")
    table.commit("low quality", token_rollup.deleted(by(low, "words", "pieces")))
    toxic = each.join(labels.filter("toxic = 1 and (quality is null or quality <> 0)"), "doc_id", "left_semi")
    emptied = by(toxic, "words", "pieces").withColumn("old_tokens", F.col("tokens")).withColumn("tokens", F.lit(0))
    table.commit("toxic emptied", token_rollup.revised(emptied))
    table.commit("pieces", token_rollup.inserted(by(each, "pieces")))
    return table.totals()


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.masks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return filter_audit.report(masks)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = byte_bpe.load(spark, path, public_tokenizers.PATTERN)
    docs = byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    both = docs.select("doc_id", F.size("token_ids").alias("n"), byte_bpe.packed_and_decoded("token_ids", vocabulary).alias("ids"))
    return both.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_tokens"),
        F.sha2("ids.packed", 256).alias("ids_sha256"),
        F.sha2("ids.decoded", 256).alias("decoded_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    pair = alignment.load(spark, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    return alignment.measures(_table(spark, sf_dir, "documents"), pair)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_decontamination,
        op3_quality,
        op4_suffix_dedup,
        op5_mixing,
        op6_outliers,
        op7_line_dedup,
        op8_html,
        op9_token_rollup,
        op10_url_rules,
        op11_filter_audit,
        op12_byte_bpe,
        op13_alignment,
    )
}
