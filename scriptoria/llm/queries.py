"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from scriptoria.llm import bpe, langid, mixing, negatives, quality, repair, secretscan, simhash, spans, topk, toxicity, urlfilter, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_url_filter": urlfilter.op2_url_filter,
        "op3_warc": warc.op3_warc,
        "op4_bpe": bpe.op4_bpe,
        "op5_simhash": simhash.op5_simhash,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_mixing": mixing.op7_mixing,
        "op8_quality": quality.op8_quality,
        "op9_substring_dedup": spans.op9_substring_dedup,
        "op10_topk": topk.op10_topk,
        "op11_repair": repair.op11_repair,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_secrets": secretscan.op13_secrets,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict:
    return {
        "op2_url_filter": urlfilter.OP2_SQL,
        "op3_warc": warc.OP3_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op10_topk": topk.OP10_SQL,
        "op11_repair": repair.OP11_SQL,
        "op12_hard_negatives": negatives.OP12_SQL,
        "op13_secrets": secretscan.OP13_SQL,
    }
