"""Items that appear together: an incremental pair table fed by signed deltas of changed baskets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.session import cut, scratch

#: Fixed by the problem: baskets that pair, and when a pair is a case.
SMALLEST, LARGEST = 2, 40
MIN_SHARED, MIN_DEGREE, MIN_LIFT = 3, 0.30, 1.5


def new_path(path: Column) -> Column:
    """The path after a rename as numstat prints it: ``old => new`` or ``dir/{old => new}/file``; others unchanged."""
    braced = F.regexp_replace(F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1"), "/{2,}", "/")
    braced = F.regexp_replace(braced, "^/", "")
    return F.when(path.rlike(r"\{[^{}]* => [^{}]*\}"), braced).when(path.contains(" => "), F.regexp_extract(path, r" => (.*)$", 1)).otherwise(path)


def commit_baskets(commits: DataFrame) -> DataFrame:
    """(grp, basket, items, at): one row per commit (repo, sha), its distinct files under their new paths, sorted.

    The latest delivery of a commit holds. Commits whose subject starts with merge or revert don't count and have null items, so one that
    was counted before is withdrawn; a null subject counts. Rows without repo or sha can't be told apart and are left out. Null
    files are none; null or empty paths are no files. A null load time is the earliest.
    """
    at = F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    low = F.lower(F.coalesce("subject", F.lit("")))
    counted = ~(low.startswith("merge") | low.startswith("revert"))
    one = (
        commits.where("repo IS NOT NULL AND sha IS NOT NULL")
        .groupBy(F.col("repo").alias("grp"), F.col("sha").alias("basket"))
        .agg(F.max_by(F.struct(counted.alias("counted"), F.col("files.path").alias("paths")), at).alias("last"), F.max(at).alias("at"))
    )
    items = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("last.paths", F.array()), new_path), lambda p: F.coalesce(p != "", F.lit(False)))))
    return one.select("grp", "basket", F.when(F.col("last.counted"), items).alias("items"), "at")


class PairTable:
    """Persistent counts of pairs, items and baskets per group, and the scores they give, in hash buckets of a shared folder.

    ``apply`` takes baskets that are new, changed, or (items null) withdrawn; it emits -1 for a basket's old content and
    +1 for its new one, sums the deltas, rewrites only the buckets they fall in, and computes the scores of the affected groups anew. A
    basket older than what the table holds of it changes nothing.

    A bucket is a key's hash modulo the session's spark.sql.shuffle.partitions when the table was made, which is how Spark itself deals
    a shuffle out: the one shuffle that adds old counts and deltas leaves each bucket whole in a task, so nothing is moved again to be
    written, and a cluster set up for larger data makes more buckets. Manifests are numbered, written beside the last and renamed into
    place, so a lost job leaves the former state whole; files no manifest of the last two names are removed.
    """

    KINDS = {"baskets": ("grp", "basket"), "pairs": ("grp", "a", "b"), "items": ("grp", "item"), "groups": ("grp",), "scores": ("grp", "a", "b")}
    SCORE = "shared bigint, a_revs bigint, b_revs bigint, n bigint, degree double, lift double"

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, min_shared: int = MIN_SHARED):
        self.spark, self.root, self.min_shared = spark, root, min_shared
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: kind -> bucket -> versions that hold its rows; several for baskets, whose versions are added, not merged
        self.at: dict[str, dict[int, list[str]]] = {k: {} for k in self.KINDS}
        self.number = 0
        self._fs, folder = self._file(root)
        if self._fs.exists(folder):
            names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
            self.number = max((int(x[9:-5]) for x in names if x.startswith("manifest-")), default=0)
        if self.number:
            self.buckets, self.at = self._manifest(self.number)

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self, number: int) -> tuple[int, dict]:
        x = json.loads(self.spark.read.text(f"{self.root}/manifest-{number}.json", wholetext=True).first()[0])
        return x["buckets"], {k: {int(b): v for b, v in x["at"][k].items()} for k in self.KINDS}

    def _commit(self) -> None:
        fs, temp = self._file(f"{self.root}/_manifest-{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "at": self.at}).encode()))
        out.close()
        self.number += 1
        if not fs.rename(temp, self._file(f"{self.root}/manifest-{self.number}.json")[1]):
            raise RuntimeError("another job has written this pair table")
        if self.number > 2:
            self._clean()

    def _clean(self) -> None:
        """Removes versions that neither this manifest nor the one before names, and older manifests."""
        before = self._manifest(self.number - 1)[1]
        for kind in self.KINDS:
            used = {v for at in (self.at, before) for vs in at[kind].values() for v in vs}
            fs, folder = self._file(f"{self.root}/{kind}")
            for f in fs.listStatus(folder) if fs.exists(folder) else []:
                if f.getPath().getName() not in used:
                    fs.delete(f.getPath(), True)
        fs, old = self._file(f"{self.root}/manifest-{self.number - 2}.json")
        fs.delete(old, False)

    def _schema(self, kind: str) -> str:
        keys = ", ".join(f"{k} string" for k in self.KINDS[kind])
        return keys + {"baskets": ", items array<string>, at timestamp_ntz, seq bigint", "scores": f", {self.SCORE}"}.get(kind, ", n bigint")

    def read(self, kind: str, only: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{kind}/{v}/bucket={b}" for b, vs in self.at[kind].items() if only is None or b in only for v in vs]
        schema = self._schema(kind)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, kind: str) -> Column:
        # pairs, items and baskets of a hot group spread over all buckets; scores lie by group, so that a group's are found together
        keys = ("grp",) if kind == "scores" else self.KINDS[kind]
        return F.pmod(F.hash(*keys), F.lit(self.buckets))

    def _write(self, kind: str, rows: DataFrame, touched: Sequence[int] | None) -> None:
        """A new version of the ``touched`` buckets (None: added to what the buckets hold)."""
        version = uuid.uuid4().hex
        rows.withColumn("bucket", self._bucket(kind)).write.partitionBy("bucket").parquet(f"{self.root}/{kind}/{version}")
        # the folders say which buckets hold rows; nothing is computed twice
        fs, at = self._file(f"{self.root}/{kind}/{version}")
        there = {int(f.getPath().getName()[7:]) for f in fs.listStatus(at) if f.getPath().getName().startswith("bucket=")}
        for b in touched or ():
            self.at[kind].pop(b, None)
        for b in there:
            self.at[kind].setdefault(b, []).append(version)

    def _touched(self, kind: str, delta: DataFrame) -> list[int]:
        return [r[0] for r in delta.select(self._bucket(kind)).distinct().collect()]  # at most ``buckets`` numbers

    def _add(self, kind: str, signed: DataFrame) -> None:
        """Old counts of the touched buckets plus the signed deltas, summed map-side first, in one shuffle."""
        held = self.at[kind]
        touched = self._touched(kind, signed) if held else list(range(self.buckets))
        keys = list(self.KINDS[kind])
        new = self.read(kind, touched).unionByName(signed.select(*keys, F.col("sign").cast("bigint").alias("n")))
        self._write(kind, new.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0"), touched)

    def apply(self, batch: DataFrame) -> DataFrame:
        """Takes (grp, basket, items[, at]), one row per basket. Returns the groups whose scores were computed anew."""
        time = F.coalesce("at", F.lit("1970-01-01").cast("timestamp_ntz")) if "at" in batch.columns else F.lit("1970-01-01").cast("timestamp_ntz")
        b = batch.select("grp", "basket", "items", time.alias("at"))
        if self.at["baskets"]:
            last = F.max_by(F.struct(F.col("items").alias("was"), F.col("at").alias("was_at")), "seq")
            old = self.read("baskets").groupBy("grp", "basket").agg(last.alias("o")).select("grp", "basket", "o.*")
            b = b.join(old, ["grp", "basket"], "left").where(F.col("was_at").isNull() | (F.col("at") >= F.col("was_at")))
        else:
            b = b.withColumn("was", F.lit(None).cast("array<string>"))
        changed = cut(b.where(~F.col("items").eqNullSafe(F.col("was"))).select("grp", "basket", "items", "was", "at"))
        both = F.array(F.struct(F.lit(-1).alias("sign"), F.col("was").alias("items")), F.struct(F.lit(1).alias("sign"), F.col("items").alias("items")))
        signed = changed.select("grp", F.inline(both)).where("items IS NOT NULL")
        rest = lambda i: F.slice("items", i + 2, F.greatest(F.size("items") - i - 1, F.lit(0)))
        pairs = F.flatten(F.transform("items", lambda x, i: F.transform(rest(i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        self._add("pairs", signed.where(F.size("items").between(SMALLEST, LARGEST)).select("grp", "sign", F.inline(pairs)))
        self._add("items", signed.select("grp", "sign", F.explode("items").alias("item")))
        self._add("groups", signed.select("grp", "sign"))
        self._write("baskets", changed.select("grp", "basket", "items", "at", F.lit(self.number).cast("bigint").alias("seq")), None)
        moved = signed.select("grp").distinct()
        # n stands in every score of a group, so a moved group is scored anew, all others keep theirs
        if self.at["scores"]:
            moved = cut(moved)
            touched = self._touched("scores", moved)
            kept = self.read("scores", touched).join(moved, "grp", "left_anti")
            self._write("scores", self._score(moved).unionByName(kept), touched)
        else:
            self._write("scores", self._score(None), list(range(self.buckets)))
        self._commit()
        return moved

    def _score(self, groups: DataFrame | None) -> DataFrame:
        pairs = self.read("pairs").where(F.col("n") >= self.min_shared).withColumnRenamed("n", "shared")
        if groups is not None:
            pairs = pairs.join(groups, "grp", "left_semi")
        side = lambda x: self.read("items").where(F.col("n") >= self.min_shared).select("grp", F.col("item").alias(x), F.col("n").alias(f"{x}_revs"))
        both = pairs.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"]).join(self.read("groups"), "grp")
        shared = F.col("shared").cast("double")
        return both.select(
            "grp", "a", "b", "shared", "a_revs", "b_revs", "n",
            (shared / ((F.col("a_revs") + F.col("b_revs")) / F.lit(2.0))).alias("degree"),
            (shared * F.col("n") / (F.col("a_revs").cast("double") * F.col("b_revs"))).alias("lift"),
        )

    def scores(self) -> DataFrame:
        """(grp, a, b, shared, a_revs, b_revs, n, degree, lift) of pairs with at least ``min_shared`` shared baskets, as kept."""
        return self.read("scores")


def coupled(commits: DataFrame, root: str | None = None) -> DataFrame:
    """All pairs with at least three shared commits, by a pair table filled in two increments.

    The first increment holds the commits delivered up to the middle of the loading period, the second the rest, among
    them late commits and redeliveries, which change nothing. The state stays in ``root`` for the next increment.
    """
    spark = commits.sparkSession
    state = PairTable(spark, root or scratch(spark, "pairs"))
    ends = commits.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    if ends[0] is None:
        increments = [commits]
    else:
        middle = F.lit(ends[0] + (ends[1] - ends[0]) / 2)
        early = F.coalesce(F.col("loaded_at") <= middle, F.lit(True))
        increments = [commits.where(early), commits.where(~early)]
    for part in increments:
        state.apply(commit_baskets(part))
    return state.scores()


def found(commits: DataFrame) -> DataFrame:
    """p6_found: (a, b) as ``repo/path``, a < b."""
    return (
        coupled(commits).where((F.col("degree") >= MIN_DEGREE) & (F.col("lift") >= MIN_LIFT))
        .select(F.concat("grp", F.lit("/"), "a").alias("a"), F.concat("grp", F.lit("/"), "b").alias("b"))
    )


COUNTS_SQL = """
WITH c AS (SELECT DISTINCT repo, sha, subject, files FROM commits WHERE repo IS NOT NULL AND sha IS NOT NULL),
k AS (SELECT repo, sha, files FROM c WHERE NOT starts_with(lower(coalesce(subject, '')), 'merge') AND NOT starts_with(lower(coalesce(subject, '')), 'revert')),
n AS (SELECT repo, count(DISTINCT sha) AS n FROM k GROUP BY repo),
e AS (SELECT repo, sha, u.path AS path FROM (SELECT repo, sha, unnest(files) AS u FROM k)),
p AS (SELECT DISTINCT repo, sha, CASE
        WHEN regexp_matches(path, '\\{[^{}]* => [^{}]*\\}') THEN regexp_replace(regexp_replace(regexp_replace(path, '\\{[^{}]* => ([^{}]*)\\}', '\\1', 'g'), '/{2,}', '/', 'g'), '^/', '')
        WHEN contains(path, ' => ') THEN regexp_extract(path, ' => (.*)$', 1) ELSE path END AS path FROM e),
r AS (SELECT repo, path, count(*) AS revs FROM p GROUP BY repo, path),
s AS (SELECT repo, sha FROM p GROUP BY repo, sha HAVING count(*) BETWEEN 2 AND 40),
q AS (SELECT p.repo, p.sha, p.path FROM p JOIN s USING (repo, sha)),
t AS (SELECT x.repo, x.path AS a, y.path AS b, count(*) AS shared FROM q x JOIN q y ON x.repo = y.repo AND x.sha = y.sha AND x.path < y.path GROUP BY ALL HAVING count(*) >= 3),
w AS (SELECT t.repo, t.a, t.b, t.shared, ra.revs AS a_revs, rb.revs AS b_revs, CAST(shared AS DOUBLE) / ((ra.revs + rb.revs) / 2.0) AS degree,
        CAST(shared AS DOUBLE) * n.n / (CAST(ra.revs AS DOUBLE) * rb.revs) AS lift
      FROM t JOIN r ra ON ra.repo = t.repo AND ra.path = t.a JOIN r rb ON rb.repo = t.repo AND rb.path = t.b JOIN n ON n.repo = t.repo)
"""
FOUND_SQL = COUNTS_SQL + "SELECT repo || '/' || a AS a, repo || '/' || b AS b FROM w WHERE degree >= 0.30 AND lift >= 1.5"
SCORES_SQL = COUNTS_SQL + "SELECT repo, a, b, shared, a_revs, b_revs, round(degree, 4) AS degree, round(lift, 4) AS lift FROM w"
