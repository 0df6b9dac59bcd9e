"""Secrets in texts that have many versions and copies, by an incremental ledger of blobs.

Every version of every path is content-addressed: its blob id is the SHA-256 of
its text. The ledger (a Parquet folder) says which blobs were scanned with
which rule versions and what was found. A scan reads only pairs of blob and rule
version that the ledger doesn't have, appends them, and joins findings back to
all paths of the blob. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.runtime import Scratch

LEDGER = "blob_id binary, scanned array<string>, findings array<struct<rule:string,start:bigint,stop:bigint>>"
#: ids of blobs to scan that are sent to every task, 32 bytes and their rules each; more are joined
BROADCAST_IDS = 200_000


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern, without those whose group has fewer code points than `least`.

    A changed rule gets another version: only then are known blobs scanned with it again.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in word)


# Fixed patterns and lengths of the rules.
_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    # as [0-9a-f]+ of 32 and more: both match whole runs
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def blob_of(text: Column) -> Column:
    """The address of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """What the ledger holds; nothing before the first scan."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def unscanned(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob_id, todo): of each blob of versions (blob_id), the keys of the rules that it wasn't scanned with, where there are any."""
    known = ledger.groupBy("blob_id").agg(F.flatten(F.collect_set("scanned")).alias("known"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    todo = F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))
    return versions.select("blob_id").distinct().join(known, "blob_id", "left").select("blob_id", todo.alias("todo")).where(F.size("todo") > 0)


def _pieces(text: Column, rule: Rule) -> Column:
    """Of each match: the code points before it since the last one, its own, and whether it counts.

    A split at the pattern and the matches themselves give positions, which no function of Spark does.
    """
    p = F.lit(rule.pattern)
    found = [F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("part")]
    each = F.transform(
        F.filter(F.arrays_zip(*found), lambda x: x["whole"].isNotNull()),
        lambda x, i: F.struct(F.lit(rule.key).alias("rule"), i.cast("long").alias("at"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["whole"]).cast("long").alias("size"), (F.length(x["part"]) >= rule.least).alias("counts")),
    )
    return F.when(F.array_contains("todo", rule.key) & text.rlike(rule.pattern), each).otherwise(F.array().cast("array<struct<rule:string,at:bigint,gap:bigint,size:bigint,counts:boolean>>"))


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows of blobs (blob_id, text, todo), one row a blob."""
    rows = blobs.select("blob_id", "todo", F.explode_outer(F.concat(*(_pieces(F.col("text"), r) for r in rules))).alias("m")).select("blob_id", "todo", "m.*")
    so_far = F.sum(F.expr("gap + size")).over(Window.partitionBy("blob_id", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = rows.withColumn("stop", so_far).withColumn("start", F.col("stop") - F.col("size"))
    listed = F.collect_list(F.when(F.col("counts"), F.struct("rule", "start", "stop")))
    return spans.groupBy("blob_id").agg(F.first("todo").alias("scanned"), F.sort_array(listed).alias("findings"))


def update_ledger(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES, text: str = "text") -> None:
    """Scan what the ledger at `path` doesn't have of versions, and append it there.

    An interrupted scan appends nothing, two scans at once may append a blob
    twice, which does no harm. Copies meet before anything is scanned: a text
    that a third of all rows hold is one blob in each task and one afterwards.
    """
    spark = versions.sparkSession
    ledger, scratch = read_ledger(spark, path), Scratch(spark, "secrets")
    rows = versions.select(blob_of(F.col(text)).alias("blob_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blobs = rows.groupBy("blob_id").agg(F.first("text").alias("text"))
    if ledger.isEmpty():
        blobs = blobs.withColumn("todo", F.array(*(F.lit(r.key) for r in rules)))
    else:
        todo = scratch.write(unscanned(rows, ledger, rules), "todo")
        if todo.count() <= BROADCAST_IDS:
            blobs = rows.join(F.broadcast(todo), "blob_id").groupBy("blob_id").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
        else:
            blobs = blobs.join(todo, "blob_id")
    scan_blobs(blobs, rules).write.mode("append").option("compression", "zstd").parquet(path)
    scratch.clear()


def findings(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """versions with `blob_id` and `found`, from the ledger: (start, kind, stop) of each span, by start and then in the order of the rules.

    Spans are of code points, from 0, without the end.
    """
    spark = versions.sparkSession
    place = F.element_at(F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i)))), F.col("f.rule"))
    rows = read_ledger(spark, path).select("blob_id", F.explode("findings").alias("f")).where(F.col("f.rule").isin(*(r.key for r in rules)))
    kind = F.substring_index("f.rule", "@", 1)
    rows = rows.select("blob_id", F.struct(F.col("f.start").alias("start"), place.alias("place"), kind.alias("kind"), F.col("f.stop").alias("stop")).alias("s"))
    spans = rows.groupBy("blob_id").agg(F.array_sort(F.collect_set("s")).alias("found"))
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,stop:bigint>>")
    kept = versions.drop("blob_id", "found")
    return kept.withColumn("blob_id", blob_of(F.col(text))).join(spans, "blob_id", "left").select(*kept.columns, "blob_id", F.coalesce("found", none).alias("found"))


def of_kinds(found: Column, kinds: Sequence[str]) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def digest(found: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(versions: DataFrame, path: str | None = None, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """versions (any columns, a text) with `blob_id` and `found`, the ledger brought up to date first.

    path: the ledger's folder, on storage that all executors share; without one
    a fresh ledger in the shared scratch folder serves this call. A null text
    is the empty blob and has no findings; an empty table gives no rows. Rows
    keep their number: copies, repeated ids and null ids each get the findings
    of their blob. Columns of versions named blob_id or found are replaced,
    all others are kept. Texts are scanned whole.
    """
    path = path or f"{Scratch(versions.sparkSession, 'ledger').root}/ledger"
    update_ledger(versions, path, rules, text)
    return findings(versions, path, rules, text)
