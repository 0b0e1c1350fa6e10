"""Statistics over a relation of files (path, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import md

# What is scanned, and folders that are not.
FORMATS = [".pdf", ".docx", ".pptx", ".xlsx", ".csv", ".html", ".txt", ".md"]
IGNORED = [".venv", "venv", ".git", "node_modules", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".kb-artifacts", ".obsidian", ".cache", "dist", "build", ".egg-info"]
LARGE = 50 * 1024
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


def files(rows: DataFrame) -> DataFrame:
    """path, size, name, directory (`.` at the top), extension in lower case; files in ignored or hidden folders are left out."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    hidden = F.exists(folders, lambda p: p.isin(IGNORED) | (F.startswith(p, F.lit(".")) & (p != ".") & (p != "..")))
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    return rows.filter(F.col("path").isNotNull() & ~hidden).select(
        "path", "size", F.substring_index("path", "/", -1).alias("name"), directory.alias("directory"), F.lower(F.regexp_extract(F.substring_index("path", "/", -1), r"(\.[^.]+)$", 1)).alias("extension")
    )


def format_stats(found: DataFrame) -> DataFrame:
    """extension (null = all), n_files, n_bytes of scanned formats."""
    return found.filter(F.col("extension").isin(FORMATS)).rollup("extension").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def skipped(found: DataFrame) -> DataFrame:
    return found.filter(~F.col("extension").isin(FORMATS)).groupBy("extension").agg(F.count("*").alias("n_files"))


def directory_groups(found: DataFrame) -> DataFrame:
    return found.groupBy("directory").agg(F.count("*").alias("n_files")).filter("n_files >= 2 and directory <> '.'")


def name_groups(names: DataFrame) -> DataFrame:
    """kind, label, n: `PREFIX-NNN` patterns met twice and first words met three times that aren't such a prefix (names: name)."""
    prefix = F.upper(F.regexp_extract("name", r"^([A-Za-z]+)[_\-](\d+)", 1))
    numbered = names.select(prefix.alias("label")).filter("label <> ''").groupBy("label").agg(F.count("*").alias("n")).filter("n >= 2")
    word = F.regexp_extract(md.stem(F.col("name")), r"^([^\s_\-.]{2,})", 1)
    words = names.select(word.alias("label")).filter("label <> ''").groupBy("label").agg(F.count("*").alias("n")).filter("n >= 3")
    taken = numbered.select(F.col("label").alias("taken"))
    words = words.join(taken, F.upper("label") == F.col("taken"), "left_anti")
    return numbered.select(F.lit("numbered_pattern").alias("kind"), F.concat("label", F.lit("-NNN")).alias("label"), "n").unionByName(words.select(F.lit("common_prefix").alias("kind"), "label", "n"))


def language_bias(found: DataFrame) -> DataFrame:
    """bias of the first 1,024 characters of the names in path order: cjk above a half, mixed above a tenth, latin, or unknown without letters."""
    first = found.select("path", "name").orderBy("path").limit(1024)  # each name has a character or more
    sample = F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "name"))), lambda x: x["name"]), ""), F.lit(1024))
    ratio = F.try_divide(F.regexp_count("sample", F.lit(HAN)), F.regexp_count("sample", F.lit(r"\p{L}")))
    bias = F.when(ratio.isNull(), "unknown").when(ratio > 0.5, "cjk").when(ratio > 0.1, "mixed").otherwise("latin")
    return first.agg(sample.alias("sample")).select(bias.alias("bias"))


def large_files(found: DataFrame, above: int = LARGE) -> DataFrame:
    return found.filter((F.col("size") > above) & F.col("extension").isin(FORMATS)).select("path", "size", md.human_size(F.col("size")).alias("shown"))
