"""The queries of the training-data operators, by name, and their DuckDB SQL."""

from __future__ import annotations

from tidemark.llm import bpe, collocations, decontaminate, lm, oddsketch, pii, quality, secrets, simhash, substrings, suffixes, warc, whitening


def queries() -> dict:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_simhash": simhash.op4_simhash,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_pii": pii.op6_pii,
        "op7_difference_cover": suffixes.op7_difference_cover,
        "op8_recurrent_lm": lm.op8_recurrent_lm,
        "op9_warc": warc.op9_warc,
        "op10_debruijn": substrings.op10_debruijn,
        "op11_collocations": collocations.op11_collocations,
        "op12_whitening": whitening.op12_whitening,
        "op13_odd_sketch": oddsketch.op13_odd_sketch,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_difference_cover": suffixes.ORACLE_SQL,
        "op9_warc": warc.ORACLE_SQL,
        "op10_debruijn": substrings.ORACLE_SQL,
        "op11_collocations": collocations.ORACLE_SQL,
        "op13_odd_sketch": oddsketch.ORACLE_SQL,
    }
