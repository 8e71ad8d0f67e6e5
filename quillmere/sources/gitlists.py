"""Readers of what version control lists, as the tables that pins and attestation take.

A collector runs beside the repositories and leaves text files, one line for each answer, fields apart
by tabs; these readers make tables of them. Nothing here runs version control.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, files: str, n: int) -> tuple[DataFrame, list]:
    """Lines of at least ``n`` fields, and these; others and empty lines don't count."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(files).withColumn("value", F.regexp_replace("value", "\r$", "")).where((F.col("value") != "") & (F.size(parts) >= n))
    return rows, [parts[i] for i in range(n)]


def read_objects(spark: SparkSession, files: str) -> DataFrame:
    """``(repo, name, oid, type)`` of lines 'repo, name asked for, answer', the answer being '<oid> <type> <size>' or '<name> missing'.

    Names without an object have no row, as has one of two answers to one question (the first by oid).
    """
    rows, (repo, name, answer) = _lines(spark, files, 3)
    found = F.regexp_extract(answer, r"^([0-9a-f]{40}|[0-9a-f]{64}) ([a-z]+) [0-9]+$", 1)
    kind = F.regexp_extract(answer, r"^\S+ ([a-z]+) [0-9]+$", 1)
    out = rows.select(repo.alias("repo"), name.alias("name"), found.alias("oid"), kind.alias("type")).where("oid <> ''")
    return out.groupBy("repo", "name").agg(F.min(F.struct("oid", "type")).alias("o")).select("repo", "name", "o.oid", "o.type")


def read_ancestry(spark: SparkSession, files: str) -> DataFrame:
    """``(repo, commit, ref)`` of lines 'repo, commit, ref, exit code of the question whether the ref contains the commit'; 0 says yes."""
    rows, (repo, commit, ref, code) = _lines(spark, files, 4)
    return rows.where(F.trim(code) == "0").select(repo.alias("repo"), commit.alias("commit"), ref.alias("ref")).distinct()


def read_times(spark: SparkSession, files: str) -> DataFrame:
    """``(path, ts)`` of lines 'path, seconds of its last commit'; the latest holds, paths never committed have no row."""
    rows, (path, seconds) = _lines(spark, files, 2)
    return rows.select(path.alias("path"), F.trim(seconds).try_cast("long").alias("ts")).where("ts IS NOT NULL").groupBy("path").agg(F.max("ts").alias("ts"))


def read_history(spark: SparkSession, files: str) -> DataFrame:
    """``(path, commit)`` of lines 'commit, path': the commits that changed each page."""
    rows, (commit, path) = _lines(spark, files, 2)
    return rows.select(path.alias("path"), commit.alias("commit")).distinct()


def read_present(spark: SparkSession, files: str) -> DataFrame:
    """``(repo, owned, batch_failed)`` of lines 'repo, owned or pointed, exit code of its listing'."""
    rows, (repo, kind, code) = _lines(spark, files, 3)
    return rows.groupBy(repo.alias("repo")).agg(F.max(F.trim(kind) == "owned").alias("owned"), F.max(F.trim(code) != "0").alias("batch_failed"))
