"""The scores and rules as SQL functions, for users who write SQL.

Each is a temporary SQL function whose body the optimizer inlines: no Python runs,
and conditions on a score are pushed down like any other expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.narratives import ANGLE_DEFAULT, ANGLE_RULES, RISK_DEFAULT, RISK_LABELS
from ..operators.periods import CRISIS_DEFAULT, CRISIS_LEVELS
from .rules import POSTURE_DEFAULT, POSTURE_HIGH, POSTURE_RULES, PRIORITIES, PRIORITY_DEFAULT


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _steps(score: str, table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {t} THEN {_text(x)}" for t, x in table) + f" ELSE {_text(default)} END"


def _words(text: str, rules, default: str) -> str:
    tests = ((" OR ".join(f"contains(lower({text}), {_text(w)})" for w in words), answer) for words, answer in rules)
    return "CASE " + " ".join(f"WHEN {t} THEN {_text(a)}" for t, a in tests) + f" ELSE {default} END"


def definitions() -> dict[str, str]:
    """Signature and body of every function, those that others call first."""
    # the error of x * scale by Dekker's product decides ties, as functions.numbers.round_py has it
    big = "(x * 134217729D)"
    hi = f"({big} - ({big} - x))"
    err = f"(({hi} * scale - x * scale) + (x - {hi}) * scale)"
    low = "CAST(floor(x * scale) AS DOUBLE)"
    exact = (f"(CASE WHEN x * scale - {low} = 0.5D THEN CASE WHEN {err} > 0 THEN {low} + 1 WHEN {err} < 0 THEN {low} ELSE rint(x * scale) END "
             "ELSE rint(x * scale) END) / scale")
    velocity = ("least(30D, 10D * log1p(messages / hours / (ref_messages / ref_hours + 1e-9))) "
                "+ CASE WHEN ref_reach > 0 THEN least(20D, 20D * (log1p(reach) / log1p(ref_reach + 1))) ELSE 0D END "
                "+ least(15D, negative_pct / 100D * 15D) + least(15D, retweet_pct / 100D * 15D) + least(20D, (risk / 5D) * 20D)")
    capped = "ref_reach > 0 AND 20D * (log1p(reach) / log1p(ref_reach + 1)) < 20D"
    strategic = ("least(25D, share_pct * 0.45D) + CASE WHEN reach > 0 THEN least(20D, log1p(reach) / 18 * 20) ELSE 0D END "
                 "+ CASE WHEN shares > 0 THEN least(15D, log1p(shares) / 10 * 15) ELSE 0D END + least(20D, negative_pct * 0.20D) + least(20D, (risk / 5) * 20)")
    return {
        "round_exact(x DOUBLE, scale DOUBLE) RETURNS DOUBLE": exact,
        "span_hours(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ) RETURNS DOUBLE": "greatest(1D, timestampdiff(MICROSECOND, a, b) / 1e6 / 3600D)",
        "crisis_velocity_score(messages DOUBLE, hours DOUBLE, ref_messages DOUBLE, ref_hours DOUBLE, reach DOUBLE, ref_reach DOUBLE, negative_pct DOUBLE, "
        "retweet_pct DOUBLE, risk DOUBLE) RETURNS DOUBLE": f"CASE WHEN {capped} THEN rint(({velocity}) * 10D) / 10D ELSE round_exact({velocity}, 10D) END",
        "strategic_risk_score(share_pct DOUBLE, reach DOUBLE, shares DOUBLE, negative_pct DOUBLE, risk DOUBLE) RETURNS DOUBLE": f"round_exact({strategic}, 10D)",
        "crisis_level(score DOUBLE) RETURNS STRING": _steps("score", CRISIS_LEVELS, CRISIS_DEFAULT),
        "narrative_risk_label(score DOUBLE) RETURNS STRING": _steps("score", RISK_LABELS, RISK_DEFAULT),
        "crisis_priority(score DOUBLE) RETURNS STRING": _steps("score", PRIORITIES, PRIORITY_DEFAULT),
        "response_angle(narrative STRING) RETURNS STRING": _words("narrative", ANGLE_RULES, _text(ANGLE_DEFAULT)),
        "response_posture(narrative STRING, score DOUBLE) RETURNS STRING": _words(
            "coalesce(narrative, '')", POSTURE_RULES, f"CASE WHEN coalesce(score, 0) >= 60 THEN {_text(POSTURE_HIGH)} ELSE {_text(POSTURE_DEFAULT)} END"),
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Define the functions in a session; their names."""
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(", 1)[0] for s in definitions()]
