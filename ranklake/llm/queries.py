"""The queries of the training-data operators: one for each, over its whole table."""

from __future__ import annotations

from . import decontaminate, html_text, langid, media, near_dup, packing, pii, substring, suffix_array, toxicity


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_pii": pii.query,
        "op2_near_duplicates": near_dup.query,
        "op3_toxicity": toxicity.query,
        "op4_decontamination": decontaminate.query,
        "op5_language": langid.query,
        "op6_suffix_array": suffix_array.query,
        "op7_packing": packing.query,
        "op8_html_text": html_text.query,
        "op9_media": media.query,
        "op10_substring_dedup": substring.query,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontaminate.SQL, "op6_suffix_array": suffix_array.SQL, "op10_substring_dedup": substring.SQL}
