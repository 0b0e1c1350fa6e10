"""Vaults on disk: reading trees of pages, converting text formats, writing pages.

Spark's own readers skip names that begin with `_` or `.`; pages of such names are wanted here, so paths are listed through the
Hadoop file system and read by `binaryFile`-like tasks only where needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import md
from vaultspark.operators.scan import FORMATS


def read_pages(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path (below root), content, size, mtime of the pages under a folder, bytes that are no UTF-8 becoming U+FFFD.

    Hidden names and those that begin with `_` are left out, as Spark does; read_marked_pages has the latter.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    path = F.substring_index("path", base, -1)
    return found.select(path.alias("path"), F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def list_files(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path below root, size) of every file under a folder, hidden ones included, through the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(base).toString().rstrip("/") + "/"
    walk, out = fs.listFiles(base, True), []
    while walk.hasNext():
        status = walk.next()
        out.append((status.getPath().toString()[len(prefix) :], status.getLen()))
    return sorted(out)


def file_table(spark: SparkSession, root: str) -> DataFrame:
    """path, size of every file under a folder, for the scan operators."""
    return spark.createDataFrame(list_files(spark, root), "path string, size bigint")


def read_marked_pages(spark: SparkSession, root: str) -> DataFrame:
    """path, content of pages whose names begin with `_`, which Spark's readers skip. The folder must be seen by all executors."""
    names = [p for p, _ in list_files(spark, root) if p.rsplit("/", 1)[-1].startswith("_") and p.endswith(".md")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [open(f"{root}/{p}", encoding="utf-8", errors="replace").read() for p in batch["path"]]
            yield pd.DataFrame({"path": batch["path"], "content": texts})

    return spark.createDataFrame([(p,) for p in names], "path string").mapInPandas(run, "path string, content string")


def html_to_markdown(html: str) -> str:
    """Headings, paragraphs, list items, links, emphasis, code and tables of an HTML text as Markdown."""
    from html.parser import HTMLParser

    class Writer(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out: list[str] = []
            self.skip, self.href, self.cells, self.rows = 0, "", None, None

        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag in ("script", "style"):
                self.skip += 1
            elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag in ("p", "div", "ul", "ol", "section", "article"):
                self.out.append("\n\n")
            elif tag == "br":
                self.out.append("\n")
            elif tag == "li":
                self.out.append("\n- ")
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("*")
            elif tag == "code":
                self.out.append("`")
            elif tag == "a":
                self.href = dict(attrs).get("href") or ""
                self.out.append("[")
            elif tag == "table":
                self.rows = []
            elif tag == "tr" and self.rows is not None:
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.cells = len(self.out)

        def handle_endtag(self, tag: str) -> None:
            if tag in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("*")
            elif tag == "code":
                self.out.append("`")
            elif tag == "a":
                self.out.append(f"]({self.href})")
            elif tag in ("td", "th") and self.cells is not None:
                self.rows[-1].append(" ".join("".join(self.out[self.cells :]).split()))
                del self.out[self.cells :]
                self.cells = None
            elif tag == "table" and self.rows is not None:
                rows = [r for r in self.rows if r]
                if rows:
                    n = len(rows[0])
                    lines = [rows[0], ["---"] * n, *((r + [""] * n)[:n] for r in rows[1:])]
                    self.out.append("\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in lines) + "\n")
                self.rows = None

        def handle_data(self, data: str) -> None:
            if not self.skip:
                self.out.append(data if self.cells is None and "\n" not in data else " ".join(data.split()))

    writer = Writer()
    writer.feed(html)
    text = "".join(writer.out)
    lines = [line.rstrip() for line in text.split("\n")]
    kept = [line for k, line in enumerate(lines) if line or (k and lines[k - 1])]
    return "\n".join(kept).strip()


def csv_to_markdown(text: str) -> str:
    """A CSV text as one Markdown table, rows padded or cut to the header."""
    import csv
    import io

    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        return ""
    n = len(rows[0])
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * n, *((r + [""] * n)[:n] for r in rows[1:])])


CONVERTERS: dict[str, Callable[[str], str]] = {".html": html_to_markdown, ".htm": html_to_markdown, ".csv": csv_to_markdown, ".txt": lambda t: t, ".md": lambda t: t}


def convert(files: DataFrame, converters: dict[str, Callable[[str], str]] | None = None) -> DataFrame:
    """path, status, markdown of files (path, content): converted, or needs_provider for formats without a converter, or empty.

    Further converters, such as for office formats, are given by extension. Null contents are empty.
    """
    known = CONVERTERS | (converters or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                kind = "." + path.rsplit(".", 1)[-1].lower() if "." in path else ""
                if kind not in known:
                    rows.append((path, "needs_provider" if kind in FORMATS else "unsupported", None))
                elif not content:
                    rows.append((path, "empty", None))
                else:
                    rows.append((path, "converted", known[kind](content)))
            yield pd.DataFrame(rows, columns=["path", "status", "markdown"])

    return files.filter("path is not null").select("path", "content").mapInPandas(run, "path string, status string, markdown string")


def combine(parts: DataFrame) -> DataFrame:
    """book, title, text: the converted parts (book, ord, path, markdown) of each book in order, each under its title and source line.

    A book is one text by its nature; the first part's title is the book's.
    """
    name = md.title(F.col("markdown"), md.stem(F.col("path")))
    piece = F.concat(F.lit("# "), name, F.lit("\n\nSource file: "), F.col("path"), F.lit("\n\n"), F.col("markdown"))
    listed = parts.filter("markdown is not null").groupBy("book").agg(F.array_sort(F.collect_list(F.struct("ord", "path", name.alias("title"), piece.alias("piece")))).alias("parts"))
    return listed.select("book", F.col("parts")[0]["title"].alias("title"), F.array_join(F.transform("parts", lambda p: p["piece"]), "\n\n").alias("text"))


def write_pages(pages: DataFrame, root: str) -> DataFrame:
    """Write pages (path, content) below a folder that all executors share and return path, action (written, identical, refused).

    A page is written to a temporary name and renamed, identical ones are left alone, paths that leave the root are refused. The
    result is lazy: it must be collected or written for the pages to be.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        base = os.path.realpath(root)
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                target = os.path.realpath(os.path.join(base, path))
                if not target.startswith(base + os.sep):
                    rows.append((path, "refused"))
                    continue
                if os.path.exists(target) and open(target, encoding="utf-8", errors="replace", newline="").read() == content:
                    rows.append((path, "identical"))
                    continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
                os.replace(part, target)
                rows.append((path, "written"))
            yield pd.DataFrame(rows, columns=["path", "action"])

    return pages.filter("path is not null and content is not null").select("path", "content").mapInPandas(run, "path string, action string")
