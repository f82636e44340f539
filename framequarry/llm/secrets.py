"""Secret scans over an incremental blob ledger (built-in DataFrame functions only).

Every historical version of a file is content-addressed (SHA-256 of its text).  A ledger, one
Parquet table, has a row for each pair of blob and rule version that was ever scanned, with the
spans found.  A scan reads only pairs that the ledger lacks, appends them, and findings are
joined back to every path that holds the blob.  So a text that a million paths share is scanned
once, and a new rule version is run over old blobs without repeating the other rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """pattern: a Java regular expression whose leftmost non-overlapping matches count if group `group` has min_chars."""

    name: str
    pattern: str
    min_chars: int = 1
    group: int = 0
    version: int = 1


#: Kinds, patterns and least lengths of the scan contract, in its order.
#: A maximal run of one class that is too short holds no other match, so the bound stands in the pattern of the last two.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)

LEDGER = "blob binary, rule string, rule_version int, spans array<struct<start:long,end:long>>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _pieces(text: Column, rule: Rule) -> Column:
    """For each match, in order: code points since the match before, its length, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    inner = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), found.alias("hit"), inner.alias("inner")),
        lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("len"), (F.length(x["inner"]) >= rule.min_chars).alias("ok")),
    )
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<gap:long,len:long,ok:boolean>>"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; empty if nothing was written there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows for the pairs of blob and rule version in versions that ledger lacks; spans are in code points, end exclusive.

    Null texts are the empty blob.  Repeated texts are one blob, chosen before the shuffle, so a
    text that a third of all rows share reaches one task as a row for each map task.  An empty
    table gives no rows.
    """
    blobs = versions.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*(F.lit(f"{r.name}@{r.version}") for r in rules))
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("rule_version").cast("string"))).alias("known"))
        blobs = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", wanted)
    jobs = F.array(
        *(
            F.when(
                F.array_contains("todo", f"{r.name}@{r.version}"),
                F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), _pieces(F.col("text"), r).alias("pieces")),
            )
            for r in rules
        )
    )
    found = blobs.select("blob", F.explode(F.filter(jobs, lambda j: j.isNotNull())).alias("job"))
    found = found.select("blob", "job.rule", "job.rule_version", F.posexplode_outer("job.pieces").alias("i", "piece"))
    # The sums run over the matches of one blob, which is one text.
    before = Window.partitionBy("blob", "rule", "rule_version").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("piece.gap") + F.col("piece.len")).over(before)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("piece.len"))
    span = F.when(F.col("piece.ok"), F.struct("start", "end"))
    return found.groupBy("blob", "rule", "rule_version").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Append what versions add to the ledger at path, and return the whole ledger."""
    spark = versions.sparkSession
    scan(versions, read_ledger(spark, path), rules, text).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Each row of versions, with columns blob and found: array of (start, kind, end) by start, then rule order.

    The ledger's rows of one blob are few; Spark splits a blob with very many paths where it
    joins, as both sides are shuffled for the join alone.
    """
    from .common import cut

    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (f"{r.name}@{r.version}", i)))
    key = F.concat_ws("@", F.col("rule"), F.col("rule_version").cast("string"))
    of = ledger.withColumn("ord", order[key]).where(F.col("ord").isNotNull() & (F.size("spans") > 0))
    rows = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("ord").alias("ord"), F.col("rule").alias("kind"), s["end"].alias("end")))
    digest = of.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(rows))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>")
    kept = [c for c in versions.columns if c not in ("blob", "found")]
    paths = versions.select(*kept, blob_id(F.col(text)).alias("blob"))
    return paths.join(cut(digest), "blob", "left").select(*kept, "blob", F.coalesce("found", none).alias("found"))


def span_text(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
