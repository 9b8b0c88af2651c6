"""Corpus sources: a folder, an explicit list, version control, any table of paths and texts."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.globs import IGNORE_FILES, ignore_patterns, scan_filter
from weftline.functions.text import digest, language_of, relative_path
from weftline.options import ScanOptions
from weftline.schemas import FILES


class GitError(Exception):
    pass


class NotARepository(GitError):
    pass


class CommandFailed(GitError):
    pass


def load_ignores(root: str) -> list[str]:
    out: list[str] = []
    for name in IGNORE_FILES:
        if os.path.isfile(p := os.path.join(root, name)):
            with open(p, encoding="utf-8", errors="replace") as f:
                out += ignore_patterns(f)
    return out


_BINARY = "path string, modificationTime timestamp, length long, content binary"


def _listing(spark: SparkSession, root: str, follow_symlinks: bool) -> DataFrame:
    if not follow_symlinks:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    paths = [os.path.join(d, n) for d, _, names in os.walk(root, followlinks=True) for n in names]
    return spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], _BINARY)


def listed(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """path (relative), at (as Spark names it), size, mtime and language of the files of known languages that the globs leave. No
    content is read for it."""
    ignore = [*options.ignore, *(load_ignores(root) if options.load_ignores else [])]
    rel = relative_path(F.regexp_replace("path", "^file:/*", "/"), os.path.abspath(root))
    f = _listing(spark, root, options.follow_symlinks).select("path", "length", "modificationTime")
    f = f.select(rel.alias("path"), F.col("path").alias("at"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    return f.withColumn("language", language_of(F.col("path"), True)).where(F.col("language").isNotNull() & scan_filter(F.col("path"), options.include, ignore))


def contents(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """at and content of files; those that cannot be read leave no row."""
    if not paths:
        return spark.createDataFrame([], "at string, content binary")
    read = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return read.load(list(paths)).select(F.col("path").alias("at"), "content")


def text_of(content: Column) -> Column:
    """The text; empty where the bytes are no UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.lit(""))


def scan(spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), kind: str = "blake3", contents_too: bool = True) -> DataFrame:
    """path (relative), size, mtime, hash, language and text of the files of known languages that the globs leave.

    Files are listed and judged first, and the content of those that stay is read once, by executors. A file that cannot be read has a
    null hash and text (:func:`invalid` finds them); a text that is no UTF-8 is empty."""
    found = listed(spark, root, options)
    cols = ["path", "size", "mtime"]
    if not contents_too:
        return found.select(*cols, F.lit(None).cast("string").alias("hash"), "language")
    paths = [r["at"] for r in found.select("at").toLocalIterator()]  # Spark's file index on the driver holds all paths anyway
    read = contents(spark, paths)
    rows = read.select("at", digest(F.col("content"), kind).alias("hash"), text_of(F.col("content")).alias("text"))
    return found.join(rows, "at", "left").select(*cols, "hash", "language", "text")


def invalid(scanned: DataFrame) -> DataFrame:
    """path of the files of a scan that could not be read."""
    return scanned.where("hash is null").select("path")


def explicit_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Placeholders, as jobs with a list of files have them."""
    return spark.createDataFrame([(p, 0, 0, "", None) for p in paths], FILES)


def read_texts(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """file_path, text, language of listed files; what cannot be read is empty. Executors read the files."""
    full = {p: os.path.abspath(os.path.join(root, p)) for p in paths}
    read = contents(spark, sorted({f for f in full.values() if os.path.isfile(f)}))
    read = read.select(F.regexp_replace("at", "^file:/*", "/").alias("_at"), text_of(F.col("content")).alias("text"))
    asked = spark.createDataFrame(list(full.items()), "file_path string, _at string")
    df = asked.join(read, "_at", "left").select("file_path", F.coalesce("text", F.lit("")).alias("text"))
    return df.withColumn("language", language_of(F.col("file_path"), False))


def _git(folder: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=False)
    if done.returncode:
        raise (NotARepository if "not a git repository" in done.stderr.lower() else CommandFailed)(done.stderr.strip())
    return [x for x in done.stdout.splitlines() if x]


def git_tracked(folder: str) -> list[str]:
    return _git(folder, "ls-files", "--exclude-standard")


def git_diff(folder: str, old: str, new: str) -> list[str]:
    return _git(folder, "diff", "--name-only", old, new)
