"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in every whole text, with their positions in
code points.  Each candidate value is hashed, and the hashes are counted over
the corpus by distinct repositories and distinct owners.  A value found with
many owners is a widely copied example; any other looks live, its owner's own.

Kinds: ``assign``, ``access`` and ``hex`` are the base; ``vendor`` (tokens with
a vendor's prefix) belongs to the method, as do ``live`` and ``example``, which
cover the value of each candidate.

Cases: a null or empty text has no spans; a null owner counts as one owner
without a name; a null repository counts as one repository; each input row
gives one output row, repeated rows too, and repeats of one (owner, repository)
count once; extra columns are left out.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stored import stored

EXAMPLE_OWNERS = 5               # an example has at least this many owners
EXAMPLE_REPOSITORIES = 10        # and is found in at least this many repositories
SALTS = 32                       # a much-copied value is spread over this many join keys
MASK = "[SECRET]"

# The patterns of each kind, the group that holds the value, its least length.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    # runs of 16 and more are the runs of any length with the shorter ones left out
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "vendor": (r"(?:ghp_|gho_|ghs_|glpat-|xox[abprs]-|sk_live_|rk_live_|npm_|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
}
BASE = ("assign", "access", "hex")
ORDER = (*KINDS, "live", "example")
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|(?:ghp_|gho_|ghs_|glpat-|xox[abprs]-|sk_live_|rk_live_|npm_|AIza)[A-Za-z0-9_-]{16}"""


# What every candidate but a hex one holds, in lower case.
_SIGNS = ("password", "passwd", "secret", "token", "api_key", "apikey", "akia", "ghp_", "gho_", "ghs_", "glpat-", "xox", "sk_live_", "rk_live_", "npm_", "aiza")


def has_candidate(text: Column) -> Column:
    """Whether a text has a candidate; the pattern is tried only on texts with one of its signs."""
    sign = F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [low.contains(x) for x in _SIGNS]))
    return F.coalesce((sign | text.rlike("[0-9a-f]{16}")) & text.rlike(_ANY), F.lit(False))


def _found(text: Column, kind: str) -> Column:
    """[(kind, gap, size, value)] of the matches: code points since the last match, of the match, and the value."""
    pattern, group, _ = KINDS[kind]
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    return F.zip_with(F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.regexp_extract_all(text, p, F.lit(group)).alias("value")),
                      gaps, lambda m, g: F.struct(F.lit(kind).alias("kind"), g.alias("gap"), F.length(m["whole"]).alias("size"), m["value"].alias("value")))


def matches(text: Column) -> Column:
    """All kinds' matches of a text, null where it has no candidate."""
    return F.when(has_candidate(text), F.concat(*[_found(text, k) for k in KINDS]))


def located(rows: DataFrame) -> DataFrame:
    """(_row, _repo, _owner, kind, start, end, value) of the candidates in the column ``_all``, made by ``matches``.

    Positions are running sums of gaps and sizes over one row's matches of one
    kind; ``_row`` tells rows apart.
    """
    flat = (rows.where("_all is not null").select("_row", "_repo", "_owner", F.posexplode("_all").alias("i", "_m"))
            .select("_row", "_repo", "_owner", "i", "_m.*").where("size is not null"))
    before = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, (_, _, n) in KINDS.items()])
    return (flat.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
            .withColumn("start", F.col("end") - F.col("size"))
            .where(F.length("value") >= least).drop("i", "gap", "size"))


def ownership(found: DataFrame) -> DataFrame:
    """(h, n_owners, n_repositories) of each hashed value, over (h, _owner, _repo)."""
    seen = found.select("h", "_owner", "_repo").distinct()
    by_owner = seen.groupBy("h", "_owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def judge(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Candidates with the column ``example``: found with many owners in many repositories."""
    found = found.withColumn("h", F.sha2("value", 256))
    examples = (ownership(found).where((F.col("n_owners") >= example_owners) & (F.col("n_repositories") >= example_repositories))
                .select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("example")))
    return (found.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
            .join(examples, ["h", "_salt"], "left").withColumn("example", F.coalesce("example", F.lit(False))).drop("_salt"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ORDER)), x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source",
         example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example), one row for each row of ``docs``."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(repository).cast("string").alias("_repo"),
                       F.col(owner).cast("string").alias("_owner"), F.col(text).alias("_text"))
    # one pass over the texts leaves a small table of rows with their matches
    small = stored(rows.select("_row", "_key", "_repo", "_owner", matches(F.col("_text")).alias("_all")), "secret-rows")
    found = located(small)
    judged = judge(found, example_owners, example_repositories)
    rank = {k: i + 1 for i, k in enumerate(ORDER)}
    own = F.coalesce(*[F.when(F.col("kind") == k, F.lit(rank[k])) for k in KINDS])
    by_method = F.when(F.col("example"), F.lit(rank["example"])).otherwise(F.lit(rank["live"]))

    def span(start: Column, r: Column, end: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), r.alias("rank"), end.cast("long").alias("end"))

    spans = judged.select("_row", F.explode(F.array(span(F.col("start"), own, F.col("end")), span(F.col("end") - F.length("value"), by_method, F.col("end")))).alias("s")).distinct()
    per_row = spans.groupBy("_row").agg(F.collect_list("s").alias("s"))
    n = lambda k: F.size(F.filter("s", lambda x: x["rank"] == rank[k])).cast("long")
    result = per_row.select("_row", *[n(k).alias(f"n_{k}") for k in (*BASE, "live", "example")], _joined(F.filter("s", lambda x: x["rank"] <= len(BASE))).alias("base"), _joined(F.col("s")).alias("spans"))
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in (*BASE, "live", "example")]
    return small.select("_row", "_key").join(result, "_row", "left").select(
        F.col("_key").alias(key), *counts[:3], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), *counts[3:])


def redact(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", mask: str = MASK) -> DataFrame:
    """``docs`` with every live-looking value replaced by ``mask``; examples and all other text stay.

    Only rows with a candidate take part in the shuffle; the others pass by.
    """
    names = docs.columns
    plain = docs.where(~has_candidate(F.col(text)))
    held = stored(docs.where(has_candidate(F.col(text))).select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc")), "secret-docs")
    rows = held.select("_row", F.col("_doc").getField(repository).cast("string").alias("_repo"), F.col("_doc").getField(owner).cast("string").alias("_owner"), matches(F.col("_doc").getField(text)).alias("_all"))
    live = judge(located(rows)).where("not example").groupBy("_row").agg(F.array_distinct(F.collect_list("value")).alias("_values"))
    # longer values first, so that none is left half masked
    values = F.array_sort("_values", lambda a, b: F.coalesce(F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1), F.lit(0)))
    body = F.aggregate(F.coalesce(values, F.array().cast("array<string>")), F.col("_doc").getField(text), lambda acc, v: F.replace(acc, v, F.lit(mask)))
    changed = held.join(live, "_row", "left").select(*[(body if c == text else F.col("_doc").getField(c)).alias(c) for c in names])
    return plain.unionByName(changed)
