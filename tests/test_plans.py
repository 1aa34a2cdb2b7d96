from conftest import SF_SMALL
from crisislens.operators import metrics as M
from crisislens.operators import periods as P
from crisislens.plans.registry import corpus


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_pipeline_not_inlined_into_pushed_filters(spark):
    plan = _plan(M.narratives_table(corpus(spark, SF_SMALL)))
    assert plan.count("translate(") == 1


def test_period_side_broadcast_and_grouped_topk(spark):
    E = corpus(spark, SF_SMALL)
    Ep = P.assign_periods(E, P.peak_day_periods(E, 3).select("period_id", "start", "end"))
    plan = _plan(M.top_authors(Ep, 10, by=["period_id"]))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "PythonUDF" not in plan


def test_scan_prunes_columns(spark, tmpdir_path):
    from crisislens.session import materialize
    E = materialize(corpus(spark, SF_SMALL), "enriched", ["date"])
    plan = _plan(E.where("date = date'2024-01-02'").groupBy("author").count())
    assert "PartitionFilters: [isnotnull(date" in plan and "text_raw" not in plan


def test_topk_plans(spark):
    import __spark_entry__ as entry
    per_period = _plan(entry.queries()["period_top_authors"](spark, SF_SMALL))
    assert per_period.count("WindowGroupLimit") >= 2          # partial limit before the shuffle + final
    assert "TakeOrderedAndProject" in _plan(entry.queries()["top_authors"](spark, SF_SMALL))


def test_reports_scan_events_at_most_three_times(spark):
    import __spark_entry__ as entry
    for name in ("brief_rows", "propagation_report", "crisis_context", "answers", "agent_context"):
        assert _plan(entry.queries()[name](spark, SF_SMALL)).count("events.parquet") <= 3, name
