"""Benchmark: enrich the posts once, then time the headline operators.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from crisislens.functions import rules as RU
from crisislens.operators import metrics as M
from crisislens.operators import narratives as N
from crisislens.operators import periods as P
from crisislens.operators import propagation as PR
from crisislens.operators import segments as SG
from crisislens.operators import strategy as ST
from crisislens.operators import timeline as TL
from crisislens.operators.enrich import enrich, with_risk_level
from crisislens.plans import reports as RP
from crisislens.plans.q_segments import windows
from crisislens.plans.tables import PeriodTables
from crisislens.session import get_spark, materialize
from crisislens.sources.fixtures import POSTS_MAPPING, raw_posts


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    extra = {"spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": str(16 * 1024 * 1024)}
    # single machine: our own scratch folder, used only if none is configured
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, 2 * cpus))))
    spark = get_spark("crisislens-bench", master=f"local[{cpus}]", shuffle_partitions=parts, extra=extra,
                      local_checkpoint_dir=tempfile.mkdtemp(prefix="crisislens-bench-"))

    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    # the text work is materialized once; the risk level (needs the corpus
    # reach quantile) is a cheap projection over the stored columns
    pre = timed("enrich", lambda: materialize(enrich(raw_posts(spark, sf_dir), POSTS_MAPPING, with_risk=False),
                                              "enriched", partition_by=["date"], cluster_tiebreak="post_id"))
    E = timed("risk_level", lambda: with_risk_level(pre))
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")

    timed("kpis", lambda: M.kpis(E).collect())
    timed("top_authors", lambda: M.top_authors(E, 50).collect())
    timed("top_hashtags", lambda: M.top_hashtags(E, 50).collect())
    timed("top_posts", lambda: M.top_posts(E, 10).collect())
    timed("narratives_table", lambda: M.narratives_table(E).collect())
    timed("sentiment_engagement", lambda: (M.sentiment_table(E).collect(), M.engagement_type_table(E).collect()))
    timed("daily_timeline", lambda: TL.daily_timeline(E).collect())
    timed("hourly_timeline", lambda: TL.hourly_timeline(E).collect())
    timed("hourly_peaks", lambda: TL.hourly_peaks(E, 20).collect())
    timed("bursts", lambda: TL.bursts(E).collect())
    # five rows by construction (a top-k), so collecting them is bounded
    periods = timed("peak_day_periods", lambda: spark.createDataFrame(
        P.peak_day_periods(E, 5).select("period_id", "start", "end").collect(), P.PERIOD_SCHEMA))
    Ep = P.assign_periods(E, periods)
    timed("period_kpis", lambda: M.kpis(Ep, by=["period_id"]).collect())
    timed("crisis_velocity", lambda: P.crisis_velocity(Ep, E).collect())
    timed("period_top_authors", lambda: M.top_authors(Ep, 10, by=["period_id"]).collect())
    timed("narrative_matrix", lambda: N.risk_matrix(N.narrative_matrix(E)).collect())
    timed("narrative_mutation", lambda: N.detect_mutation(N.narrative_timeline(E)).collect())
    timed("actor_narratives", lambda: N.actor_narratives(E, 10).collect())
    timed("narrative_samples", lambda: N.sample_posts(E, 3).collect())
    timed("propagation", lambda: PR.propagation_metrics(E).collect())
    timed("concentration", lambda: PR.concentration_metrics(E).collect())
    copies = timed("copy_patterns", lambda: PR.copy_patterns(E).checkpoint(eager=True))
    timed("coordination", lambda: PR.coordination(PR.propagation_metrics(E), PR.concentration_metrics(E),
                                                  copies, TL.bursts(E)).collect())
    timed("message_pack", lambda: ST.message_pack(ST.strategy_rows(Ep, E)).collect())
    stored = timed("period_posts", lambda: materialize(Ep, "bench-period-posts"))
    for name, build in (("brief_rows", RP.brief_rows), ("strategy_report", RP.strategy_report), ("crisis_context", RP.crisis_context)):
        timed(name, lambda: build(stored, E).collect())            # five rows each
    timed("narratives_report", lambda: RP.narratives_report(stored).collect())
    timed("propagation_report", lambda: RP.propagation_report(stored).collect())
    # reports that share tables: the tables are written by the first of them
    t = PeriodTables(stored, E, keep=True)
    timed("agent_context", lambda: RP.agent_context(t).collect())
    timed("context_json", lambda: RP.context_json(t).collect())
    questions = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"), F.concat(F.lit("peak_day_"), (F.col("conv_id") % 5 + 1).cast("string")).alias("period_id"))
    timed("answers", lambda: RP.answers(questions, t, keys=("conv_id", "turn")).agg(F.count("answer"), F.sum(F.length("answer"))).collect())
    cuts = SG.Cuts(materialize(windows(E), "bench-windows"))
    segments = timed("period_segments", lambda: materialize(SG.segment_table(E, cuts), "bench-segments"))
    timed("period_segments_kpis", lambda: SG.segment_kpis(segments, cuts.covered()).collect())           # 300 rows
    timed("guardrail", lambda: conv.select(*[c.alias(k) for k, c in RU.guardrail(F.col("text")).items()])
          .groupBy("statut").count().collect())

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
