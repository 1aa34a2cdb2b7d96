import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from harness import compare, duck

ORACLE_SAMPLE = ["enrich_narratives", "enrich_entities", "ingest_map_columns", "kpis", "top_authors",
                 "hourly_peaks", "crisis_velocity", "narrative_matrix", "copy_patterns", "guardrail", "crisis_context", "period_engagement_types", "propagation_report"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "messages" in df.columns


def test_registry_shape():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 50
    assert {"answers", "context_json", "agent_context", "crisis_context"} <= set(qs) and "crisis_context" in sql


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle_parity_small(spark, name):
    r = compare(entry.queries()[name](spark, SF_SMALL), duck(SF_SMALL), entry.oracle_sql()[name])
    assert r["cols_match"], r
    assert r["values_match"], r


def test_agent_context_fills_strategy_keys(spark):
    import json

    from crisislens.plans import reports as RP
    from crisislens.plans.q_periods import shared_tables
    row = RP.agent_context(shared_tables(spark, SF_SMALL)).orderBy("period_id").first()
    doc = json.loads(row["agent_context"])
    a4 = doc["agent4_strategie"]
    assert len(a4["messages_prioritaires"]) == 4 and len(a4["plan_action"]) == 4
    assert set(a4["risques"]) == {"silence", "sur_reaction"}
    assert len(doc["agent2_narratifs"]["risk_matrix"]) <= 8 and len(doc["agent5_redaction"]["guardrail"]) <= 12
