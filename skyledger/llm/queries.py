"""The registered queries of the corpus operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import alignment, langid, mixing, packing, pii, pivots, quality, rules, simhash, substrings, suffixes, toxicity, whitening
from skyledger.session import tune


def _tuned(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(tune(spark), folder)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: _tuned(fn)
    for fn in (
        langid.op1_langid,
        pivots.op2_pivots,
        packing.op3_packing,
        mixing.op4_mixing,
        toxicity.op5_toxicity,
        substrings.op6_substrings,
        rules.op7_rules,
        quality.op8_quality,
        simhash.op9_simhash,
        pii.op10_pii,
        alignment.op11_alignment,
        whitening.op12_whitening,
        suffixes.op13_suffixes,
    )
}

#: the others have no SQL; the tests hold them against brute force or held-out accuracy
ORACLES: dict[str, str] = {"op4_mixing": mixing.OP4_SQL, "op6_substrings": substrings.OP6_SQL, "op7_rules": rules.OP7_SQL, "op13_suffixes": suffixes.OP13_SQL}
