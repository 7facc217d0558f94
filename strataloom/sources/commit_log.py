"""The commit log as a source: records framed by control characters, read in batch or as a stream.

A record is RS fields-joined-by-US GS change-lines, where RS, US and GS are U+001E, U+001F and U+001D.
Fields: sha, short sha, name, address, authored, committed, parents, subject and body. A change line is
additions, tab, deletions, tab, path; ``-`` counts mark binary files and a path may hold tabs.
Malformed records are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.messages import is_fix, is_revert

RECORD, FIELD, BODY_END = "\x1e", "\x1f", "\x1d"
#: What a log command has to print for this source.
FORMAT = "%x1e%H%x1f%h%x1f%an%x1f%ae%x1f%aI%x1f%cI%x1f%P%x1f%B%x1d"
#: Bounds of the first pass over a history.
FIRST_PASS = {"months": 24, "commits": 20_000}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of text dumps; the record mark is the line separator, so no record is cut at a block boundary."""
    return parse(spark.read.option("lineSep", RECORD).text(path).withColumnRenamed("value", "record"))


def read_log_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The same for dumps that arrive in a folder, as a stream."""
    return parse(spark.readStream.option("lineSep", RECORD).option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "record"))


def changes(lines: Column) -> Column:
    """Array of (path, additions, deletions, is_binary) from the lines after a record's body."""
    rows = F.filter(F.split(lines, "\n"), lambda x: x.rlike(r"^(\d+|-)\t(\d+|-)\t.+"))
    count = lambda x, n: F.regexp_extract(x, r"^(\d+|-)\t(\d+|-)\t", n).try_cast("int")
    return F.transform(
        rows, lambda x: F.struct(F.regexp_replace(x, r"^[\d-]+\t[\d-]+\t", "").alias("path"), F.coalesce(count(x, 1), F.lit(0)).alias("additions"), F.coalesce(count(x, 2), F.lit(0)).alias("deletions"), F.startswith(x, F.lit("-\t-\t")).alias("is_binary"))
    )


def parse(records: DataFrame) -> DataFrame:
    """One row per record with its changes nested."""
    head, tail = F.split_part("record", F.lit(BODY_END), F.lit(1)), F.split_part("record", F.lit(BODY_END), F.lit(2))
    f = F.split(head, FIELD, -1)
    rows = records.filter(F.length(F.trim("record")) > 0).select(f.alias("f"), tail.alias("tail")).filter((F.size("f") == 8) & F.get("f", F.lit(0)).rlike("^[0-9a-f]{7,40}$"))
    at = lambda k: F.get("f", F.lit(k))
    time = lambda k: F.try_to_timestamp(F.regexp_replace(at(k), r"([+-]\d{2}):?(\d{2})$", "$1:$2")).cast("timestamp_ntz")
    message = F.rtrim(at(7), F.lit("\n "))
    parents = F.filter(F.split(at(6), " "), lambda p: p != "")
    out = rows.select(
        at(0).alias("sha"), at(1).alias("short_sha"), at(2).alias("author_name"), at(3).alias("author_email"), time(4).alias("authored_at"), time(5).alias("committed_at"), F.size(parents).alias("parent_count"),
        F.split_part(message, F.lit("\n"), F.lit(1)).alias("subject"), F.trim(F.regexp_replace(message, r"^[^\n]*\n?", ""), F.lit("\n ")).alias("body"), changes(F.col("tail")).alias("files"),
    )
    total = lambda c: F.aggregate("files", F.lit(0), lambda acc, x: acc + x[c])
    return out.withColumns(
        {"is_merge": F.col("parent_count") > 1, "is_fix": is_fix(F.col("subject")), "is_revert": is_revert(F.col("subject"), F.col("body")), "files_changed": F.size("files"), "insertions": total("additions"), "deletions": total("deletions")}
    )


def touched_files(parsed: DataFrame) -> DataFrame:
    return parsed.select("sha", F.explode("files").alias("x")).select("sha", "x.*")


def first_pass(parsed: DataFrame, as_of: Column) -> DataFrame:
    """The window of a first reading: recent months, the newest commits."""
    recent = parsed.filter(F.col("committed_at") >= F.add_months(as_of, -FIRST_PASS["months"]).cast("timestamp_ntz"))
    return recent.orderBy(F.col("committed_at").desc(), "sha").limit(FIRST_PASS["commits"])
