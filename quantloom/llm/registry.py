"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline
from quantloom.llm import bpe, chat, fingerprint, line_dedup, media, packing, quality, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_chat_format": chat.op2_chat_format,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_bpe": bpe.op4_bpe,
        "op5_fingerprint": fingerprint.op5_fingerprint,
        "op6_packing": packing.op6_packing,
        "op7_simhash": simhash.op7_simhash,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_media_columns": media.op9_media_columns,
        "op10_quality": quality.op10_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.SQL,
        "op2_chat_format": chat.SQL,
        "op8_line_dedup": line_dedup.SQL,
    }
