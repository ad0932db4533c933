"""Queries of the training-data operators and their DuckDB formulations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import (fingerprints, hnsw, lattice, mixing, packing, quality, repair, setsketch, spelling, tokencounts,
                            toxicity, urlfilter, warc)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprints.op1,
        "op2_quality": quality.op2,
        "op3_warc": warc.op3,
        "op4_setsketch": setsketch.op4,
        "op5_token_counts": tokencounts.op5,
        "op6_toxicity": toxicity.op6,
        "op7_urlfilter": urlfilter.op7,
        "op8_lattice": lattice.op8,
        "op9_mixing": mixing.op9,
        "op10_packing": packing.op10,
        "op11_hnsw": hnsw.op11,
        "op12_repair": repair.op12,
        "op13_spelling": spelling.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": warc.OP3_SQL,
        "op5_token_counts": tokencounts.OP5_SQL,
        "op7_urlfilter": urlfilter.OP7_SQL,
    }
