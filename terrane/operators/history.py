"""Behaviour over time: revisions, ownership, hotspots, timeline and co-change, from commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import cut

#: Files whose churn says nothing of design (fixed values).
BORING = r"(?i)(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|gemfile\.lock|poetry\.lock|cargo\.lock|go\.sum|composer\.lock|changelog(\.md)?)$"
TICKET = r"\b([A-Z][A-Z0-9]{1,9}-[0-9]{1,6})\b"


def renamed(path: Column) -> Column:
    """The new path of a numstat entry."""
    braced = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1"), "/{2,}", "/"), "^/", "")
    return F.when(path.rlike(r"\{[^{}]* => [^{}]*\}"), braced).when(path.contains(" => "), F.regexp_extract(path, r" => (.*)$", 1)).otherwise(path)


def changes(commits: DataFrame, design_only: bool = True) -> DataFrame:
    """(repo, sha, author, date, month, path, added, deleted): one row per counted commit and file under its new path.

    The latest delivery of a commit holds; merges and reverts, and files of no design interest, are left out unless ``design_only`` is off.
    """
    last = F.max_by(F.struct("author", "date", "subject", "files"), F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp_ntz")))
    once = commits.where("repo IS NOT NULL AND sha IS NOT NULL").groupBy("repo", "sha").agg(last.alias("c")).select("repo", "sha", "c.*")
    if design_only:
        low = F.lower(F.coalesce("subject", F.lit("")))
        once = once.where(~(low.startswith("merge") | low.startswith("revert")))
    rows = once.select("repo", "sha", "author", "date", F.substring("date", 1, 7).alias("month"), F.inline("files"))
    rows = rows.withColumn("path", renamed(F.col("path"))).where("path <> ''")
    if design_only:
        rows = rows.where(~F.col("path").rlike(BORING))
    return rows.groupBy("repo", "sha", "author", "date", "month", "path").agg(
        F.sum(F.coalesce("added", F.lit(0))).alias("added"), F.sum(F.coalesce("deleted", F.lit(0))).alias("deleted")
    )


def file_metrics(ch: DataFrame) -> DataFrame:
    return ch.groupBy("repo", "path").agg(
        F.count("*").alias("revisions"), F.countDistinct("author").alias("authors"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"),
        F.min("date").alias("first_change"), F.max("date").alias("last_change"),
    )


def ownership(ch: DataFrame) -> DataFrame:
    return ch.where("author IS NOT NULL").groupBy("repo", "path", "author").agg(F.count("*").alias("commits"), F.sum("added").alias("added"), F.max("date").alias("last"))


def main_author(own: DataFrame) -> DataFrame:
    """(repo, path, main_author, author_share): most commits, ties by name. One aggregate, no window, so no hot file sorts."""
    return own.groupBy("repo", "path").agg(
        F.min(F.struct((-F.col("commits")).alias("k"), "author"))["author"].alias("main_author"),
        F.round(F.max("commits") / F.sum("commits").cast("double"), 4).alias("author_share"),
    )


def timeline(commits: DataFrame, repos: DataFrame) -> DataFrame:
    """(month, service, repo, commits, authors, files, added, deleted) of all commits, merges included."""
    ch = changes(commits, design_only=False)
    name = repos.groupBy("repo").agg(F.min("service").alias("service"))
    return (
        ch.join(F.broadcast(name) if name.count() <= 100_000 else name, "repo", "left")
        .groupBy("month", F.coalesce("service", "repo").alias("service"), "repo")
        .agg(F.countDistinct("sha").alias("commits"), F.countDistinct("author").alias("authors"), F.countDistinct("path").alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    )


def hotspots(metrics: DataFrame, repo: str | None = None, least: float | None = None) -> DataFrame:
    """(repo, path, hotspot): churn times complexity, each over its greatest value; 0 where either is not positive.

    ``repo`` keeps one repo, measured against the whole estate; ``least`` keeps what scores more than that.
    """
    rows = metrics.groupBy("repo", "path").agg(F.max("revisions").alias("revisions"), F.max("complexity").alias("complexity"))
    top = rows.agg(F.max("revisions").alias("mr"), F.max("complexity").alias("mc"))
    score = F.round(F.log1p(F.col("revisions").cast("double")) / F.log1p(F.col("mr").cast("double")) * F.col("complexity") / F.col("mc"), 6)
    if repo is not None:
        rows = rows.where(F.col("repo") == repo)
    got = rows.crossJoin(F.broadcast(top)).select("repo", "path", F.when((F.col("revisions") > 0) & (F.col("complexity") > 0), score).otherwise(0.0).alias("hotspot"))
    return got if least is None else got.where(F.col("hotspot") > least)


def cochange(ch: DataFrame, min_shared: int = 3, min_degree: float = 0.30, most: int = 40) -> DataFrame:
    """(a, b, a_repo, b_repo, shared, a_revs, b_revs, degree): pairs of files in commits of 2 to ``most`` files.

    Pairs are formed inside the sorted file array of a commit, so a commit never meets another and nothing is self-joined;
    they are counted map-side first. Bounded by ``most`` squared per commit.
    """
    ch = cut(ch.select("repo", "sha", "path"))  # pairs and revisions both count it
    commit = ch.groupBy("repo", "sha").agg(F.array_sort(F.collect_set("path")).alias("p")).where(F.size("p").between(2, most))
    rest = lambda i: F.slice("p", i + 2, F.greatest(F.size("p") - i - 1, F.lit(0)))
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(rest(i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    shared = commit.select("repo", F.inline(pairs)).groupBy("repo", "a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    revs = ch.groupBy("repo", "path").agg(F.count("*").alias("revs")).where(F.col("revs") >= min_shared)
    side = lambda x: revs.select("repo", F.col("path").alias(x), F.col("revs").alias(f"{x}_revs"))
    degree = F.col("shared").cast("double") / ((F.col("a_revs") + F.col("b_revs")) / F.lit(2.0))
    return (
        shared.join(side("a"), ["repo", "a"]).join(side("b"), ["repo", "b"]).where(degree >= min_degree)
        .select(F.concat("repo", F.lit("/"), "a").alias("a"), F.concat("repo", F.lit("/"), "b").alias("b"), F.col("repo").alias("a_repo"), F.col("repo").alias("b_repo"), "shared", "a_revs", "b_revs", F.round(degree, 4).alias("degree"))
    )


def cross_cochange(
    ch: DataFrame, groups: DataFrame, min_shared: int, most: int = 80, factor: float = 1.0, min_degree: float = 0.0, known: DataFrame | None = None
) -> DataFrame:
    """Pairs of files of different repos that share a key (ticket, author and day): (a, b, shared, a_revs, b_revs, degree).

    ``groups`` is (repo, sha, key). Groups of one repo or of more than ``most`` files say nothing and are left out. The group's
    files are one array of at most ``most`` entries. Pairs in ``known`` (a, b), coupled by stronger evidence, are left out.
    """
    rows = ch.join(groups, ["repo", "sha"]).select("key", "repo", F.concat("repo", F.lit("/"), "path").alias("f")).distinct()
    g = rows.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("units"))
    small = rows.join(g.where((F.col("units") >= 2) & (F.col("n") <= most)).select("key"), "key", "left_semi")
    arr = small.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("f", "repo"))).alias("p"))
    rest = lambda i: F.slice("p", i + 2, F.greatest(F.size("p") - i - 1, F.lit(0)))
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.filter(rest(i), lambda y: y["repo"] != x["repo"]), lambda y: F.struct(x["f"].alias("a"), y["f"].alias("b")))))
    shared = arr.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    revs = ch.groupBy(F.concat("repo", F.lit("/"), "path").alias("f")).agg(F.count("*").alias("revs"))
    side = lambda x: revs.select(F.col("f").alias(x), F.col("revs").alias(f"{x}_revs"))
    degree = F.least(F.lit(1.0), F.col("shared").cast("double") / ((F.col("a_revs") + F.col("b_revs")) / F.lit(2.0))) * F.lit(factor)
    if known is not None:
        shared = shared.join(known.select("a", "b").distinct(), ["a", "b"], "left_anti")
    return shared.join(side("a"), "a").join(side("b"), "b").where(degree >= min_degree).select("a", "b", "shared", "a_revs", "b_revs", F.round(degree, 4).alias("degree"))


def tickets(commits: DataFrame) -> DataFrame:
    """(repo, sha, key): the ticket keys in a commit's subject."""
    keys = F.regexp_extract_all("subject", F.lit(TICKET), 1)
    return commits.where("repo IS NOT NULL AND sha IS NOT NULL").select("repo", "sha", F.explode(keys).alias("key")).distinct()


def author_days(commits: DataFrame) -> DataFrame:
    rows = commits.where("repo IS NOT NULL AND sha IS NOT NULL AND author IS NOT NULL")
    return rows.select("repo", "sha", F.concat_ws("|", "author", F.substring("date", 1, 10)).alias("key")).distinct()


def top_owners(own: DataFrame, k: int = 5) -> DataFrame:
    """(repo, author, commits, place): the k authors of a repo by commits, ties by name."""
    per = own.groupBy("repo", "author").agg(F.sum("commits").alias("commits"))
    w = Window.partitionBy("repo").orderBy(F.col("commits").desc(), "author")
    return per.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def knowledge(own: DataFrame) -> DataFrame:
    """(author, files, commits, repos, last): how far each author's knowledge reaches."""
    return own.groupBy("author").agg(
        F.countDistinct(F.concat_ws("|", "repo", "path")).alias("files"), F.sum("commits").alias("commits"), F.countDistinct("repo").alias("repos"), F.max("last").alias("last")
    )


def reviewers(own: DataFrame, changed: DataFrame, k: int = 6) -> DataFrame:
    """(author, commits): who knows the changed (repo, rel) files; a path matches if it is rel or ends in /rel.

    The suffix test is an equi join: each owned path is exploded into its own suffixes.
    """
    parts = F.split("path", "/")
    suffixes = own.select("repo", "author", "commits", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("rel"))
    got = suffixes.join(changed, ["repo", "rel"]).groupBy("author").agg(F.sum("commits").alias("commits"))
    return got.orderBy(F.col("commits").desc(), "author").limit(k)
