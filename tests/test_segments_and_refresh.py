"""Elementary segments, sketches, incremental refresh, chained and late streams."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from crisislens.operators import metrics as M
from crisislens.operators import periods as P
from crisislens.operators import segments as SG
from crisislens.operators import sketches as SK
from crisislens.operators import timeline as TL
from crisislens.operators.enrich import enrich, exact_quantile
from crisislens.plans import refresh as RF
from crisislens.plans.tables import store
from crisislens.sources.fixtures import POSTS_MAPPING, raw_posts
from crisislens.streaming.bursts import start_bursts
from crisislens.streaming.distinct import read_late, start_distinct


@pytest.fixture(scope="module")
def raw(spark):
    return store(raw_posts(spark, SF_SMALL), "raw")


@pytest.fixture(scope="module")
def E(raw):
    return store(enrich(raw, POSTS_MAPPING), "posts")


def rows(df):
    return sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in df.collect())


def random_periods(spark, E):
    rng = random.Random(4)
    lo = E.agg(F.min("dt")).first()[0]
    out = []
    for i in range(40):
        a = lo + dt.timedelta(seconds=rng.randint(-90_000, 30 * 86_400), microseconds=rng.choice([0, 1, 999_999]))
        out.append((f"p{i}", None if i % 10 == 3 else a, None if i % 10 == 7 else a + dt.timedelta(seconds=rng.choice([0, 59, 3_600, 200_000, 2_000_000]))))
    out += [("empty", lo, lo - dt.timedelta(1)), ("all", None, None), ("same", out[0][1], out[0][2])]
    at = E.orderBy("dt").limit(30).collect()[-1]["dt"]
    return P.periods_frame(spark, [*out, ("point", at, at)])


def test_segments_equal_posts_copied_to_periods(spark, E):
    periods = random_periods(spark, E)
    Ep = P.assign_periods(E, periods)
    cuts = SG.Cuts(periods)
    table, covered = SG.segment_table(E, cuts), cuts.covered()
    want = M.kpis(Ep, ("period_id",))
    assert rows(SG.segment_kpis(table, covered).select(*want.columns)) == rows(want)
    want = M.top_authors(Ep, 7, ("period_id",))
    assert rows(SG.segment_authors(table, covered, 7).select(*want.columns)) == rows(want)
    want = M.narratives_table(Ep, ("period_id",))
    assert rows(SG.segment_narratives(table, covered).select(*want.columns)) == rows(want)
    want = P.crisis_velocity(Ep, E)
    assert rows(SG.segment_velocity(table, covered, E).select(*want.columns)) == rows(want)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and "Generate" not in plan.split("Scan parquet")[0].split("Project")[0]
    assert SG.segment_kpis(SG.segment_table(E, SG.Cuts(periods.limit(0))), SG.Cuts(periods.limit(0)).covered()).count() == 0


def test_sketches_merge(E):
    days = SK.author_estimates(SK.author_sketches(E, "day"), ())
    hours = SK.author_estimates(SK.author_sketches(E, "hour"), ())
    n = E.select("author").distinct().count()
    assert days.first()["authors_estimate"] == hours.first()["authors_estimate"] and abs(days.first()["authors_estimate"] - n) <= 0.03 * n
    merged = SK.merge_reach(SK.reach_sketches(E))
    for q in (0.1, 0.5, 0.95):
        guess = merged.select(SK.quantile_of(F.col("sketch"), F.lit(q))).first()[0]
        below, upto = E.agg(F.avg((F.col("reach") < guess).cast("int")), F.avg((F.col("reach") <= guess).cast("int"))).first()
        assert below - 0.01 <= q <= upto + 0.01 and exact_quantile(E, "reach", q) is not None


def files_of(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_three_increments_equal_one_run(spark, raw, tmpdir_path):
    source, root = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "store")
    days = sorted(r[0] for r in raw.select(F.to_date("dt")).distinct().collect())
    day = F.to_date("dt")
    # the second part has posts of two days only, with a reach that does not move the quantile
    late = raw.where(day.isin(days[:2]) & (F.col("post_id") % 2 == 0))
    parts = [raw.join(late.select("post_id"), "post_id", "left_anti").where(day <= days[9]), late, raw.join(late.select("post_id"), "post_id", "left_anti").where(day > days[9])]
    shown = []
    for i, part in enumerate(parts):
        part.coalesce(2).write.parquet(f"{source}/{i}")
        before = files_of(f"{root}/corpus")
        got = RF.refresh(spark, source, root, POSTS_MAPPING)
        after = files_of(f"{root}/corpus")
        touched = {str(r[0]) for r in part.select(day).distinct().collect()}
        assert got["files"] > 0 and got["dates"] == len(touched)
        assert all(after.get(f) == t for f, t in before.items() if f.split("date=")[1][:10] not in touched)        # other dates keep their files
        shown.append(got["quantile_moved"])
    assert RF.refresh(spark, source, root, POSTS_MAPPING)["files"] == 0 and shown[0]
    whole = enrich(spark.read.parquet(*[f"{source}/{i}" for i in range(3)]), POSTS_MAPPING)
    want = TL.hourly_timeline(whole)
    assert rows(RF.hourly(spark, root).select(*want.columns)) == rows(want)
    want = TL.daily_timeline(whole)
    assert rows(RF.daily(spark, root).select(*want.columns)) == rows(want)
    assert rows(RF.read_corpus(spark, root).select("post_id", "author", "reach")) == rows(whole.select("post_id", "author", "reach"))


def test_a_refresh_that_failed_is_made_good(spark, raw, tmpdir_path, monkeypatch):
    source, root = os.path.join(tmpdir_path, "src2"), os.path.join(tmpdir_path, "store2")
    parts = [raw.where("post_id % 3 = 0"), raw.where("post_id % 3 = 1"), raw.where("post_id % 3 = 2")]
    parts[0].write.parquet(f"{source}/0")
    RF.refresh(spark, source, root, POSTS_MAPPING)
    parts[1].write.parquet(f"{source}/1")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(RF, "exact_quantile", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        RF.refresh(spark, source, root, POSTS_MAPPING)                       # the corpus is written, the batch does not count
    assert RF.read_corpus(spark, root).count() == parts[0].count()
    parts[2].write.parquet(f"{source}/2")                                    # and a further file arrives
    RF.refresh(spark, source, root, POSTS_MAPPING)
    assert rows(RF.read_corpus(spark, root).select("post_id")) == rows(raw.select("post_id"))
    assert RF.daily(spark, root).agg(F.sum("messages")).first()[0] == raw.count()


def test_streamed_bursts_equal_the_batch(spark, raw, E, tmpdir_path):
    src = os.path.join(tmpdir_path, "bursts-src")
    raw.orderBy("dt").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(src)
    q = start_bursts(spark, src, raw.schema, POSTS_MAPPING, os.path.join(tmpdir_path, "bursts"), os.path.join(tmpdir_path, "bursts-ck"), max_files=1)
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(tmpdir_path, "bursts"))
    closed = got.select("span").distinct()
    batch = TL.bursts(E.withColumn("span", F.col("day")), n=None, by=("span",)).join(closed, "span", "left_semi")
    columns = ["span", "hour", "messages", "retweets", "zscore", "retweet_pct", "burst_level"]
    near = lambda df: sorted((str(r["span"]), str(r["hour"]), r["messages"], r["retweets"], round(r["zscore"], 6), round(r["retweet_pct"], 6), r["burst_level"]) for r in df.select(*columns).collect())
    assert closed.count() >= 20 and near(got) == near(batch)
    state = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert max(state) < 200                                                  # the hours of one file and the open ones, not all 720


def test_repeats_and_late_posts(spark, tmpdir_path):
    schema = "post_id long, dt timestamp_ntz, author_src string, full_text string"
    at = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    files = [[(i, at(0, i)) for i in range(30)],
             [(i, at(0, i)) for i in range(10, 30)] + [(100 + i, at(1, i)) for i in range(40)],     # repeats within the watermark
             [(200 + i, at(5, i)) for i in range(20)],
             [(300, at(0, 5)), (301, at(1, 7)), (200, at(5, 0)), (400, at(6))],                      # two late posts and a repeat
             [(500 + i, at(20, i)) for i in range(3)]]
    src = os.path.join(tmpdir_path, "late-src")
    mapping = {"post_id": "post_id", "date": "dt", "author": "author_src", "text": "full_text"}
    out, side, ck = (os.path.join(tmpdir_path, x) for x in ("late-out", "late-side", "late-ck"))
    for i, f in enumerate(files):                                            # one file a run, so batches are those of the list
        spark.createDataFrame([(k, t, "a", "x") for k, t in f], schema).coalesce(1).write.mode("append").parquet(src)
        for q in start_distinct(spark, src, spark.createDataFrame([], schema).schema, mapping, out, side, ck, "2 hours"):
            q.awaitTermination(300)
    late = sorted(r["post_id"] for r in read_late(spark, side).collect())
    assert late == [300, 301]
    want = {}
    for k, t in {(k, t) for f in files for k, t in f}:
        if k not in late:
            want[t.replace(minute=0)] = want.get(t.replace(minute=0), 0) + 1
    got = {r["hour"]: r["messages"] for r in spark.read.parquet(out).collect()}
    assert got == {h: n for h, n in want.items() if h in got} and {at(0), at(1), at(5), at(6)} <= set(got) and at(20) not in got
