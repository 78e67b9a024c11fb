"""Ragged patient files (one stay per file, one row per hour) as one panel DataFrame.

Headers differ between files, and Spark's CSV reader maps columns by position. Small ``.psv`` files are read whole,
so header and rows meet without a shuffle. ``.csv`` files, and ``.psv`` files above ``whole_file_bytes``, are grouped
by their header line, and each group goes through Spark's own CSV reader under its own schema: large files are split
between tasks, and files with a line break inside quotes are read with ``multiLine``. A header is one line.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit import catalog
from panelkit.catalog import PanelSpec
from panelkit.functions.clinical import missing_as_null
from panelkit.operators import ranking

FILES = "*.{psv,csv}"
ORDER = "ICULOS"
WHOLE_FILE_BYTES = 32 * 1024 * 1024
HOURS_PER_BLOCK = 4096
LINES_PER_BLOCK = 65536


def panel_spec(channels: Sequence[str] = catalog.MEASURED) -> PanelSpec:
    """How a scanned panel is keyed: by file path, since two folders may hold equal stems."""
    return PanelSpec("file_path", "ord", catalog.LABEL, tuple(channels), "block")


def _roots(paths) -> list[str]:
    """Distinct roots, without those that lie inside another one."""
    roots = [paths] if isinstance(paths, str) else list(paths)
    roots = sorted({r.rstrip("/") for r in roots})
    return [r for r in roots if not any(r != o and r.startswith(o + "/") for o in roots)]


def _read(spark: SparkSession, roots, recursive: bool, whole: bool) -> DataFrame:
    reader = (spark.read.option("pathGlobFilter", FILES).option("ignoreCorruptFiles", True)
              .option("recursiveFileLookup", recursive))
    return reader.text(roots, wholetext=whole)


def _cells(line: Column, separator: str) -> Column:
    """Split a plain row; quotes round a cell and a byte order mark go."""
    return F.transform(F.split(line, separator, -1), lambda c: F.trim(F.regexp_replace(c, "[\"\r\ufeff]", "")))


def _small_lines(spark, roots, recursive, limit) -> DataFrame:
    """Every data line of the small ``.psv`` files, with its file's header."""
    files = _read(spark, roots, recursive, True).filter(
        (F.col("_metadata.file_size") <= limit) & F.col("_metadata.file_path").endswith(".psv")).select(
        "value", "_metadata.file_path", "_metadata.file_name")
    lines = F.split("value", "\r?\n", -1)
    files = files.select("file_path", "file_name", lines.alias("_lines"),
                         _cells(F.get(lines, F.lit(0)), r"\|").alias("_header"))
    rows = files.select("file_path", "file_name", "_header", F.posexplode("_lines").alias("line", "text"))
    return rows.filter("line > 0 and trim(text) <> ''").select(
        "file_path", "file_name", "_header", _cells(F.col("text"), r"\|").alias("_cells"),
        F.lit(0).cast("bigint").alias("part"), F.col("line").cast("bigint").alias("line"),
        F.floor(F.col("line") / LINES_PER_BLOCK).alias("_chunk"))


@dataclass(frozen=True)
class Layout:
    """Files that Spark's CSV reader can read under one schema."""

    header: tuple[str, ...]
    separator: str
    multiline: bool
    paths: tuple[str, ...]


def layouts(spark: SparkSession, paths, recursive: bool = True,
            whole_file_bytes: int = WHOLE_FILE_BYTES) -> list[Layout]:
    """The ``.csv`` and the large ``.psv`` files by header, separator and need of ``multiLine``.

    One aggregate over their lines, combined before the shuffle: the first line of each file, and whether any line
    has an odd number of quotes, which is where a quoted cell runs on. What reaches the driver is one row a file,
    which Spark's own file listing holds there too.
    """
    path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    lines = _read(spark, _roots(paths), recursive, False).filter(path.endswith(".csv") | (size > whole_file_bytes))
    first = F.when(F.col("_metadata.file_block_start") == 0, F.struct(F.monotonically_increasing_id(), "value"))
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    groups: dict[tuple, list[str]] = defaultdict(list)
    for row in lines.select(path.alias("file_path"), "value", first.alias("first"), (odd % 2 == 1).alias("odd")).groupBy(
            "file_path").agg(F.min("first")["value"].alias("header"), F.max("odd").alias("odd")).collect():
        separator = "|" if row["file_path"].endswith(".psv") else ","
        names = next(csv.reader([(row["header"] or "").lstrip("\ufeff")], delimiter=separator), [])
        groups[tuple(n.strip() for n in names), separator, row["odd"]].append(row["file_path"])
    return [Layout(*key, tuple(sorted(found))) for key, found in sorted(groups.items())]


def _plain(name: str) -> Column:
    """A listed file's name as it stands in its folder; listings have it encoded."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _as_path(uri: str) -> str:
    """A listed file's address as a reader's path: decoded, and its glob signs meant literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _layout_rows(spark: SparkSession, layout: Layout) -> DataFrame:
    """Rows of one layout; cells by place, their lines numbered within each part of a file."""
    cells = [f"_{i}" for i in range(len(layout.header))]
    rows = (spark.read.schema(", ".join(f"{c} string" for c in cells)).option("sep", layout.separator)
            .option("header", True).option("escape", '"').option("multiLine", layout.multiline)
            .option("ignoreCorruptFiles", True).csv([_as_path(p) for p in layout.paths]))
    return rows.select(
        "_metadata.file_path", "_metadata.file_name", *[F.trim(c).alias(c) for c in cells],
        F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"),
        F.col("_metadata.file_block_start").alias("_chunk"))


def file_table(spark: SparkSession, paths, recursive: bool = True) -> DataFrame:
    """``(file_path, length)`` from the listing alone; no content is read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", FILES)
            .option("recursiveFileLookup", recursive).load(_roots(paths))
            .select("_metadata.file_path", "length"))


def header_names(lines: DataFrame, groups: Sequence[Layout] = ()) -> list[str]:
    """All column names that occur in any header, sorted."""
    names = lines.select(F.explode("_header").alias("name")).distinct().filter("name <> ''")
    return sorted({r["name"] for r in names.collect()} | {n for g in groups for n in g.header if n})


def scan_panel(spark: SparkSession, paths, channels: Sequence[str] | None = catalog.MEASURED,
               label: str | None = catalog.LABEL, recursive: bool = True,
               max_files: int | None = None, seed: int = 42,
               whole_file_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """Scan patient files into ``(file_path, patient_id, ICULOS, channels..., label, ord, block)``.

    Absent channels are null; ``NaN``, empty and non-numeric cells are null. Files that cannot be
    read or that lack the label column are skipped (``label=None`` keeps all). ``channels=None``
    keeps every column found in any header. ``max_files`` draws that many files first. Raises if
    there is no input or nothing usable.
    """
    files = file_table(spark, paths, recursive)
    if files.isEmpty():
        raise FileNotFoundError(f"no .psv or .csv patient files in {paths}")
    lines = _small_lines(spark, _roots(paths), recursive, whole_file_bytes)
    groups = [g for g in layouts(spark, paths, recursive, whole_file_bytes) if not label or label in g.header]
    if channels is None:
        channels = [c for c in header_names(lines, groups) if c not in (ORDER, label)]
    wanted = [ORDER, *channels] + ([label] if label else [])
    if label:
        lines = lines.filter(F.array_contains("_header", label))

    def values(rows, text):
        number = {c: missing_as_null(text(c).try_cast("double")) for c in wanted}
        return rows.select(
            "file_path", F.regexp_extract(_plain("file_name"), r"^(.*)\.[^.]+$", 1).alias("patient_id"),
            *[number[c].alias(c) for c in wanted], "part", "line", "_chunk")

    def in_line(name):
        at = F.array_position("_header", name).cast("int")
        return F.when(at > 0, F.get("_cells", at - 1))

    def in_group(group):
        return lambda name: (F.col(f"_{group.header.index(name)}") if name in group.header
                             else F.lit(None).cast("string"))

    panel = reduce(DataFrame.unionByName, [values(_layout_rows(spark, g), in_group(g)) for g in groups],
                   values(lines, in_line))
    if max_files is not None:
        drawn = ranking.take_exact(files.select("file_path"), max_files, "file_path", f"files:{seed}")
        panel = panel.join(drawn, "file_path", "left_semi")
    if label:
        panel = panel.withColumn(label, F.col(label).cast("int"))
    hours = F.floor(F.col(ORDER) / HOURS_PER_BLOCK)
    ordered = panel.select(
        "file_path", "patient_id", *wanted,
        # Unknown hours sort last, ties in file order.
        F.struct(F.col(ORDER).isNull().cast("int").alias("unknown"), F.col(ORDER).alias("hour"),
                 "part", "line").alias("ord"),
        F.coalesce(hours, F.lit(1 << 40) + F.col("_chunk")).cast("bigint").alias("block"))
    if ordered.isEmpty():
        raise ValueError(f"no usable patient rows in {paths}")
    return ordered


def convert_to_parquet(panel: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Write a scanned panel once as Parquet, clustered by file, and read that from then on."""
    clustered = panel.repartition(partitions, "file_path") if partitions else panel
    clustered.write.mode("overwrite").parquet(path)
    return panel.sparkSession.read.parquet(path)


def write_extract(extract: DataFrame, path: str, fmt: str = "csv") -> None:
    """Store an hour extract as CSV with a header, or as Parquet."""
    writer = extract.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def union_panels(panels: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; a column one panel lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), panels)
