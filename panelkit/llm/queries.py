"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm import (
    audit, language, licenses, minhash, mixing, neighbors, pieces, quality, secrets, simhash, tokens, toxicity,
    whitening)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pieces": pieces.query,
        "op2_licenses": licenses.query,
        "op3_mixing": mixing.query,
        "op4_quality": quality.query,
        "op5_language": language.query,
        "op6_simhash": simhash.query,
        "op7_secrets": secrets.query,
        "op8_tokens": tokens.query,
        "op9_neighbors": neighbors.query,
        "op10_minhash": minhash.query,
        "op11_audit": audit.query,
        "op12_whitening": whitening.query,
        "op13_toxicity": toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.sql(), "op11_audit": audit.sql()}
