"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, chat, decontaminate, license_scan, line_dedup, near_dedup, sentencepiece_codec, substring_dedup, toxicity, warc

_MODULES = {
    "op1_line_dedup": line_dedup,
    "op2_sentencepiece": sentencepiece_codec,
    "op3_minhash_near_dedup": near_dedup,
    "op4_substring_dedup": substring_dedup,
    "op5_license_scan": license_scan,
    "op6_ann": ann,
    "op7_benchmark_decontamination": decontaminate,
    "op8_chat_formatting": chat,
    "op9_warc": warc,
    "op10_toxicity": toxicity,
}
QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
