"""The operators as queries over their whole tables, with the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import crf, ctph, html_text, mcd, mil, mixing, packing, preference, simhash, warc
from weftgraph.llm.cluster import take

#: Token weights of the mixture, for each domain of the labels table; nothing is wanted of the last one.
TARGETS = {"quality 1, toxic 0": 0.93, "quality 0, toxic 0": 0.04, "quality 1, toxic 1": 0.03, "quality 0, toxic 1": 0.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mcd.rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _runs(mask: str) -> Column:
    """A mask as text: T or M (trained, masked) and a length, for each run."""
    return F.array_join(F.transform(mask, lambda r: F.concat(F.when(r["trained"], F.lit("T")).otherwise(F.lit("M")), r["length"].cast("string"))), " ")


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.format_pairs(preference.swapped_answers(table(spark, sf_dir, "conversations")))
    return pairs.select("pair_id", "n_prefix_turns", "prompt", "chosen", "rejected", _runs("chosen_mask").alias("chosen_mask"), _runs("rejected_mask").alias("rejected_mask"))


OP2_SQL = r"""
WITH held AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS turns
  FROM conversations GROUP BY conv_id),
donors AS (
  SELECT conv_id - 1 AS conv_id, arg_max(text, struct_pack(turn := turn, text := text)) AS answer
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
placed AS (
  SELECT held.conv_id, turns, donors.conv_id IS NOT NULL AS has_donor, answer,
    coalesce(list_max([i FOR i IN range(1, len(turns) + 1) IF turns[i].role = 'assistant']), 0) AS last_at
  FROM held LEFT JOIN donors ON held.conv_id = donors.conv_id),
plain AS (
  SELECT conv_id,
    [struct_pack(role := t.role, text := t.text) FOR t IN CASE WHEN last_at = 0 THEN turns ELSE turns[1:last_at] END] AS chosen,
    list_concat([struct_pack(role := t.role, text := t.text) FOR t IN CASE WHEN last_at > 1 THEN turns[1:last_at - 1] ELSE [] END],
      CASE WHEN has_donor THEN [struct_pack(role := 'assistant', text := answer)] ELSE [] END) AS rejected
  FROM placed),
counted AS (
  SELECT *, coalesce(list_min([i FOR i IN range(1, greatest(len(chosen), len(rejected)) + 1)
    IF i > len(chosen) OR i > len(rejected) OR chosen[i].role IS DISTINCT FROM rejected[i].role OR chosen[i].text IS DISTINCT FROM rejected[i].text]) - 1,
    len(chosen)) AS n FROM plain),
clean AS (
  SELECT conv_id, n,
    [struct_pack(role := replace(coalesce(t.role, ''), '<|im_', '<| im_'), text := replace(coalesce(t.text, ''), '<|im_', '<| im_')) FOR t IN chosen] AS chosen,
    [struct_pack(role := replace(coalesce(t.role, ''), '<|im_', '<| im_'), text := replace(coalesce(t.text, ''), '<|im_', '<| im_')) FOR t IN rejected] AS rejected
  FROM counted),
cut AS (SELECT conv_id, n, chosen[1:n] AS prefix, chosen[n + 1:] AS chosen, rejected[n + 1:] AS rejected FROM clean)
SELECT conv_id AS pair_id, CAST(n AS BIGINT) AS n_prefix_turns,
  coalesce(array_to_string([concat('<|im_start|>', t.role, chr(10), t.text, '<|im_end|>', chr(10)) FOR t IN prefix], ''), '') AS prompt,
  coalesce(array_to_string([concat('<|im_start|>', t.role, chr(10), t.text, '<|im_end|>', chr(10)) FOR t IN chosen], ''), '') AS chosen,
  coalesce(array_to_string([concat('<|im_start|>', t.role, chr(10), t.text, '<|im_end|>', chr(10)) FOR t IN rejected], ''), '') AS rejected,
  coalesce(array_to_string([concat('M', length(t.role) + 13, CASE WHEN t.role = 'assistant' THEN ' T' ELSE ' M' END, length(t.text) + 10, ' M1') FOR t IN chosen], ' '), '') AS chosen_mask,
  coalesce(array_to_string([concat('M', length(t.role) + 13, CASE WHEN t.role = 'assistant' THEN ' T' ELSE ' M' END, length(t.text) + 10, ' M1') FOR t IN rejected], ' '), '') AS rejected_mask
FROM cut
"""


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_domains(table(spark, sf_dir, "labels")), TARGETS)
    return rows.select("doc_id", "words", "domain", F.array_join(F.transform("posterior", lambda p: p.cast("string")), " ").alias("posterior"), "rate", "copies")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.with_main_text(take(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return rows.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", "block_digest", "content_length", F.col("block").cast("string").alias("block"))  # both kinds are UTF-8


def op9_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), " ")
    return rows.select("doc_id", "held_out", "score", "predicted", spans.alias("spans"))


def op10_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.neighbours(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_preference_format, op3_simhash_neardup, op4_quality_classifier, op5_soft_mixing, op6_html_main_text, op7_bestfit_packing, op8_warc_derivatives, op9_toxicity_crf, op10_piecewise_hash)}
ORACLE_SQL = {"op2_preference_format": OP2_SQL}
