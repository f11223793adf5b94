"""SQL names for the scalar rules.  SQL-bodied functions are inlined by the optimizer: no Python per row."""
from __future__ import annotations

from pyspark.sql import SparkSession

from hiresift import vocab as V

_CENTRE = "(k / CAST(n AS DOUBLE) + 3.8416 / (2 * n))"
_HALF = "1.96 * sqrt((k / CAST(n AS DOUBLE)) * (1 - k / CAST(n AS DOUBLE)) / n + 3.8416 / (4.0 * n * n))"
_DENOM = "(1 + 3.8416 / n)"


def _alias_case(vocab: V.Vocabulary) -> str:
    arms = " ".join(f"WHEN '{v}' THEN '{c}'" for v, c in vocab.aliases.items())
    return f"CASE lower(trim(t)) {arms} ELSE lower(trim(t)) END"


def definitions(vocab: V.Vocabulary = V.DEFAULT) -> dict[str, str]:
    return {
        "wilson_low(k BIGINT, n BIGINT) RETURNS DOUBLE":
            f"CASE WHEN n <= 0 THEN 0.0D ELSE greatest(0.0D, ({_CENTRE} - {_HALF}) / {_DENOM}) END",
        "wilson_high(k BIGINT, n BIGINT) RETURNS DOUBLE":
            f"CASE WHEN n <= 0 THEN 1.0D ELSE least(1.0D, ({_CENTRE} + {_HALF}) / {_DENOM}) END",
        "score_band(s DOUBLE) RETURNS STRING":
            "CASE WHEN s IS NULL THEN 'Not scored' WHEN s >= 80 THEN 'Strong' WHEN s >= 60 THEN 'Workable' "
            "WHEN s >= 40 THEN 'Weak' ELSE 'Very weak' END",
        "canonical_term(t STRING) RETURNS STRING": _alias_case(vocab),
    }


def register(spark: SparkSession, vocab: V.Vocabulary = V.DEFAULT) -> None:
    for signature, body in definitions(vocab).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
