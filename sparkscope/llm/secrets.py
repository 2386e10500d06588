"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Every match becomes a candidate with a hash of its value. Counting the distinct owners and repositories of each hash tells
widely copied examples from values that one owner alone has and that so look live. Matches of the fixed patterns are always
reported; opaque tokens, which the patterns miss, are reported where their ownership says that they look live.

Places are running sums over a document's matches, and what overlaps is told by running extremes over its spans in order:
the time grows with the text and with its matches, sorting aside, never with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Kind, pattern, group with the value, least length of that value.
#: A run of 32 hex digits or of AKIA with 12 more is the same match as an open-ended run that is dropped when short.
BASE_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Long opaque tokens: upper case, lower case and a digit in one run.
OPAQUE = ("opaque", r"[A-Za-z0-9+/_-]{24,}", 0, 24)
#: A value that so many owners, or so many repositories, have is an example.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 4


def _matches(text: Column, rank: int, pattern: str, group: int) -> Column:
    """The pattern's leftmost matches: each one's place among them, the characters before it and its own, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    zipped = F.arrays_zip(found.alias("m"), values.alias("v"), F.slice(gaps, 1, F.size(found)).alias("g"))
    each = F.transform(zipped, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("place"), x["g"].alias("gap"), F.length(x["m"]).cast("long").alias("size"), x["v"].alias("value")))
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<rank:int,place:int,gap:long,size:long,value:string>>"))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidate_spans(matches: DataFrame) -> DataFrame:
    """``row, owner, repository, rank, kind, start, end, hash``: matches that are long enough, opaque ones where they mix
    cases and digits and no base span overlaps them."""
    kinds, opaque = [*BASE_KINDS, OPAQUE], len(BASE_KINDS)
    by_rank = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rank") + 1)
    so_far = Window.partitionBy("row", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    spans = matches.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    spans = spans.filter(F.length("value") >= by_rank([k[3] for k in kinds]))
    base = F.col("rank") < opaque
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.coalesce(F.max(F.when(base, F.col("end"))).over(before) > F.col("start"), F.lit(False))
    reaching = F.coalesce(F.min(F.when(base, F.col("start"))).over(behind) < F.col("end"), F.lit(False))
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    apart = spans.withColumn("apart", ~reached & ~reaching).filter(base | (F.col("apart") & mixed))
    return apart.select("row", "owner", "repository", "rank", by_rank([k[0] for k in kinds]).alias("kind"), "start", "end", F.sha2("value", 256).alias("hash"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n_owners, n_repositories`` from ``hash, owner, repository``: each step combines before it shuffles."""
    pairs = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, wide_owners: int = WIDE_OWNERS,
                 wide_repositories: int = WIDE_REPOSITORIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_assign, n_access, n_hex, base, spans, n_live, n_example, most_owners, most_repositories``.

    ``base`` and ``spans`` are the listed spans. A span is live when its value has fewer than ``wide_owners`` owners and fewer
    than ``wide_repositories`` repositories, else an example; ``n_live`` and ``n_example`` count them, the last two columns
    give the most owners and repositories that a reported value has. Null and empty texts have no spans; a null id, owner or
    repository is allowed, null owners and repositories being one unnamed one. Very long texts are scanned whole, in linear
    time. Spans that start together are listed in the order of the kinds. Repeated rows are scanned each for itself and count
    once per owner and repository. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    found = F.concat(*[_matches(text, i, k[1], k[2]) for i, k in enumerate((*BASE_KINDS, OPAQUE))])
    scanned = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), named(owner).alias("owner"), named(repository).alias("repository"), found.alias("found")))
    matches = scanned.select("row", "owner", "repository", F.explode("found").alias("x")).select("row", "owner", "repository", "x.*")
    candidates = cut_lineage(candidate_spans(matches))
    # A widely copied value is the expected case. Both sides are read as written, with no aggregate between shuffle and join, so
    # that Spark splits its candidates over tasks.
    judged = candidates.join(cut_lineage(ownership(candidates)), "hash").withColumn("live", (F.col("n_owners") < wide_owners) & (F.col("n_repositories") < wide_repositories))
    base = F.col("kind") != OPAQUE[0]
    reported = judged.filter(base | F.col("live"))
    span = F.struct("start", "rank", "end", "kind")
    per_row = reported.groupBy("row").agg(
        *[F.count_if(F.col("kind") == k[0]).alias(f"n_{k[0]}") for k in BASE_KINDS], F.collect_list(F.when(base, span)).alias("base"), F.collect_list(span).alias("spans"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"))
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    text_of = lambda c: F.coalesce(_listed(F.col(c)), F.lit("")).alias(c)
    return scanned.join(per_row, "row", "left").select(F.col("id").alias(id_col), *[count(f"n_{k[0]}") for k in BASE_KINDS], text_of("base"), text_of("spans"), *map(count, ("n_live", "n_example", "most_owners", "most_repositories")))
