"""The tables that reports share: each planned once, and on request written once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import narratives as N
from ..operators import propagation as PR
from ..operators import strategy as ST
from ..operators import timeline as TL
from ..operators.periods import corpus_span, velocity
from ..session import materialize

BY = ("period_id",)
TOP = 10

# the columns of posts that the tables of a name read (see the operators)
READS: dict[str, tuple[str, ...]] = {
    "kpis": ("author", "dt", "is_retweet", "is_original", "is_reply", "is_quote", "likes", "comments", "shares", "impressions",
             "reach", "engagement_total", "sentiment", "risk_level"),
    "narratives": ("narratives",),
    "sentiments": ("sentiment",),
    "authors": ("author", "is_retweet", "likes", "shares", "reach", "impressions", "followers", "risk_level"),
    "posts": (*M.TOP_POST_COLUMNS, "engagement_total"),
    "risks": ("narratives", "reach", "shares", "sentiment", "is_retweet", "risk_level"),
    "actors": ("author", "narratives", "reach", "shares", "likes", "risk_level"),
    "mutations": ("hour", "narratives", "reach", "is_retweet", "risk_level"),
    "propagation": ("hour", "dt", "is_retweet", "author", "reach", "impressions"),
    "concentration": ("author", "reach", "shares", "likes", "is_retweet"),
    "copies": ("fingerprint", "author", "dt", "reach", "post_id", "text_raw"),
    "bursts": ("hour", "author", "is_retweet", "reach"),
}
STRATEGY = ("kpis", "narratives")
BRIEF = (*STRATEGY, "sentiments", "authors")
COORDINATION = ("propagation", "concentration", "copies", "bursts")


def read_by(*names: str) -> list[str]:
    """The columns of posts that the named tables read, each once."""
    return list(dict.fromkeys(c for name in names for c in READS[name]))


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and reread; a folder of our own only in a single-process session that names none."""
    master = df.sparkSession.sparkContext.master
    return materialize(df, name, allow_local=master.startswith("local") and not master.startswith("local-cluster"))


class PeriodTables:
    """Per-period tables by name, over the posts of the periods (``posts``) and the corpus' times and reach (``corpus``).

    With ``keep`` every table, small rows of periods, is written when it is first
    asked for, so that reports that share it read it instead of the posts.
    """

    def __init__(self, posts: DataFrame, corpus: DataFrame | None = None, keep: bool = False):
        self.posts, self.corpus, self.keep = posts, corpus, keep

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return store(df, f"period-{name}") if self.keep else df

    @cached_property
    def kpis(self) -> DataFrame:
        return self._kept(M.kpis(self.posts, BY), "kpis")

    @cached_property
    def velocity(self) -> DataFrame:
        if self.corpus is None:
            raise ValueError("the velocity score needs the corpus")
        return self._kept(velocity(self.kpis, corpus_span(self.corpus)), "velocity")

    @cached_property
    def narratives(self) -> DataFrame:
        return self._kept(M.narratives_table(self.posts, BY), "narratives")

    @cached_property
    def sentiments(self) -> DataFrame:
        return self._kept(M.sentiment_table(self.posts, BY), "sentiments")

    @cached_property
    def _authors(self) -> DataFrame:
        return self._kept(M.top_authors(self.posts, TOP, BY), "authors")

    def authors(self, n: int) -> DataFrame:
        return self._authors.where(F.col("rank") <= n) if n <= TOP else M.top_authors(self.posts, n, BY)

    @cached_property
    def _top_posts(self) -> DataFrame:
        return self._kept(M.top_posts(self.posts, TOP, BY), "posts")

    def top_posts(self, n: int) -> DataFrame:
        return self._top_posts.where(F.col("rank") <= n) if n <= TOP else M.top_posts(self.posts, n, BY)

    @cached_property
    def risks(self) -> DataFrame:
        return self._kept(N.risk_matrix(N.narrative_matrix(self.posts, BY)), "risks")

    @cached_property
    def _actors(self) -> DataFrame:
        return self._kept(N.actor_narratives(self.posts, TOP, BY), "actors")

    def actors(self, n: int) -> DataFrame:
        return self._actors.where(F.col("rank") <= n) if n <= TOP else N.actor_narratives(self.posts, n, BY)

    def mutations(self, bucket: str = "hour") -> DataFrame:
        return self._hourly_mutations if bucket == "hour" else N.detect_mutation(N.narrative_timeline(self.posts, bucket, BY), bucket, BY)

    @cached_property
    def _hourly_mutations(self) -> DataFrame:
        return self._kept(N.detect_mutation(N.narrative_timeline(self.posts, "hour", BY), "hour", BY), "mutations")

    @cached_property
    def propagation(self) -> DataFrame:
        return self._kept(PR.propagation_metrics(self.posts, BY), "propagation")

    def concentration(self, n: int = TOP) -> DataFrame:
        return self._concentration if n == TOP else PR.concentration_metrics(self.posts, n, BY)

    @cached_property
    def _concentration(self) -> DataFrame:
        return self._kept(PR.concentration_metrics(self.posts, TOP, BY), "concentration")

    @cached_property
    def copies(self) -> DataFrame:
        return self._kept(PR.copy_patterns(self.posts, by=BY), "copies")

    @cached_property
    def bursts(self) -> DataFrame:
        return self._kept(TL.bursts(self.posts, by=BY), "bursts")

    def coordination(self, n: int = TOP) -> DataFrame:
        return PR.coordination(self.propagation, self.concentration(n), self.copies, self.bursts, BY)

    def strategy(self, posture: str | None = None) -> DataFrame:
        return ST.strategy_of(self.velocity, ST.dominant_of(self.narratives), posture)


def tables(Ep: DataFrame | PeriodTables, E: DataFrame | None = None) -> PeriodTables:
    return Ep if isinstance(Ep, PeriodTables) else PeriodTables(Ep, E)
