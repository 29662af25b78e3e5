"""Flow CSV files of any layout: discovery, inspection, quarantine, load.

A file is read three times: once as lines, for its header, its encoding and cells that go over several lines; once as
cells, for all that is decided about it (quarantine, units, reading of dates); and then for its flows.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prepare import file_facts, prepare_flows, standardize_columns, unusable_ports
from ..schema import SKIP_FILE_WORDS

# --- fixed values: cell texts that mean "missing" ----------------------------
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Tried in this order; the two single-byte encodings differ in bytes 0x80-0x9f only.
UTF8, WINDOWS, LATIN = "UTF-8", "windows-1252", "ISO-8859-1"
_HIGH_BYTES = {chr(b): bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)}
_NOT_WINDOWS = "[" + "".join(c for c, w in _HIGH_BYTES.items() if w == "\ufffd") + "]"


@dataclass(frozen=True)
class FileGroup:
    """Files that share a header line and an encoding, read by one scan.

    Files with a cell that goes over several lines are a group of their own: such a file is read by one task.
    """

    columns: tuple[str, ...]
    encoding: str
    paths: tuple[str, ...]
    multi_line: bool = False


def is_flow_file(name: Column) -> Column:
    """False for documentation files that lie next to the data."""
    return ~reduce(lambda a, b: a | b, [F.lower(name).contains(w) for w in SKIP_FILE_WORDS])


def discover(spark: SparkSession, paths: list[str]) -> list[str]:
    """CSV files named by ``paths`` or anywhere below them, in path order."""
    for path in paths:
        if not path.lower().endswith(".csv") and _is_file(spark, path):
            raise ValueError(f"unsupported file type: {path}")
    # Only path columns are used, so no file content is read here.
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.[cC][sS][vV]").load(paths))
    name = F.element_at(F.split("path", "/"), -1)
    found = [r["path"] for r in listing.filter(is_flow_file(name)).select("path").orderBy("path").collect()]
    if not found:
        raise FileNotFoundError(f"no CSV files in {paths}")
    return found


def _is_file(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isFile()


def _lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    if encoding == UTF8:
        return spark.read.text(paths).select("value", "_metadata")
    single = T.StructType([T.StructField("value", T.StringType())])
    return (spark.read.schema(single).option("encoding", LATIN).option("sep", "\u0001")
            .option("quote", "").csv(paths).select("value", "_metadata"))


def _decoded(text: Column, encoding: str) -> Column:
    """Text read as Latin-1 with its Windows characters restored."""
    if encoding != WINDOWS:
        return text
    return F.translate(text, "".join(_HIGH_BYTES), "".join(_HIGH_BYTES.values()))


def _headers(spark: SparkSession, paths: list[str], encoding: str, flag: Column) -> dict[str, tuple[str, bool, bool]]:
    """First line of each file, whether any of its lines is flagged, and whether one opens or closes a longer cell."""
    lines = _lines(spark, paths, encoding).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    per_file = lines.groupBy("path").agg(
        F.min_by("value", F.struct("block", "line")).alias("header"), F.bool_or(flag).alias("flagged"),
        F.bool_or(quotes % 2 == 1).alias("multi_line"))
    return {r["path"]: (r["header"], r["flagged"], bool(r["multi_line"])) for r in per_file.collect()}


def inspect(spark: SparkSession, paths: list[str]) -> list[FileGroup]:
    """Header and encoding of every file; per-file results only reach the driver.

    A file is read in the first encoding that decodes all of its bytes.
    """
    value = F.col("value")
    found = _headers(spark, paths, UTF8, ~F.is_valid_utf8(value))
    headers = {path: (header, UTF8, multi_line) for path, (header, invalid, multi_line) in found.items() if not invalid}
    single_byte = [path for path in found if path not in headers]
    if single_byte:
        for path, (header, latin, multi_line) in _headers(spark, single_byte, LATIN, value.rlike(_NOT_WINDOWS)).items():
            names = header if latin else header.translate(str.maketrans(_HIGH_BYTES))
            headers[path] = (names, LATIN if latin else WINDOWS, multi_line)
    groups: dict[tuple[str, str, bool], list[str]] = {}
    for path, kind in sorted(headers.items()):
        groups.setdefault(kind, []).append(path)
    return [FileGroup(_unique(next(csv.reader([header]))), encoding, tuple(files), multi_line)
            for (header, encoding, multi_line), files in groups.items()]


def _unique(names: list[str]) -> tuple[str, ...]:
    """Number repeated header names: a, a.1, a.2."""
    seen: dict[str, int] = {}
    result = []
    for name in names:
        count = seen.get(name, 0)
        seen[name] = count + 1
        result.append(f"{name}.{count}" if count else name)
    return tuple(result)


def read_group(spark: SparkSession, group: FileGroup, paths: list[str] | None = None) -> DataFrame:
    """All cells as text, missing ones null; ``_path``, ``_block`` and ``_line`` say where
    from, ``_too_long`` whether the row has more cells than the header."""
    # One column more than the header has: only a row that is too long fills it.
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*group.columns, "_extra")])
    raw = (spark.read.schema(schema)
           .options(header=True, encoding=UTF8 if group.encoding == UTF8 else LATIN, quote='"', escape='"', emptyValue="",
                    mode="PERMISSIVE", multiLine=group.multi_line)
           .csv(list(paths or group.paths)))
    cells = [F.when(~F.col(f"`{c}`").isin(MISSING_TEXTS), _decoded(F.col(f"`{c}`"), group.encoding)).alias(c)
             for c in group.columns]
    return raw.select(*cells, F.col("_metadata.file_path").alias("_path"),
                      F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"),
                      F.col("_extra").isNotNull().alias("_too_long"))


def _facts(spark: SparkSession, group: FileGroup) -> DataFrame:
    """One row per file: the counts of its verdict and what else is decided file by file."""
    named = standardize_columns(read_group(spark, group))
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count_if(unusable_ports(named)).alias("bad_rows"),
              F.count_if("_too_long").alias("too_long_rows")]
    return file_facts(named, "_path", counts).withColumn("accepted", (F.col("bad_rows") == 0) & (F.col("too_long_rows") == 0))


def quarantine_report(spark: SparkSession, groups: list[FileGroup]) -> DataFrame:
    """Per file: rows, rows with unusable ports, rows that are too long, verdict."""
    return reduce(lambda a, b: a.unionByName(b), [
        _facts(spark, group).select(F.col("_path").alias("path"), "n_rows", "bad_rows", "too_long_rows", "accepted") for group in groups])


def load_flows(spark: SparkSession, paths: list[str], **prepare) -> tuple[DataFrame, DataFrame]:
    """Canonical flows of all readable files, and the per-file report.

    A file with unusable ports or ragged rows is left out as a whole. Time units and the reading of dates are decided
    for each file. Files without a time column are spaced in line order, each from the same start.
    """
    prepare.setdefault("order_by", [F.col("_path"), F.col("_block"), F.col("_line")])
    tables, reports = [], []
    for group in inspect(spark, discover(spark, paths)):
        # One row per file: the same list the scan itself needs on the driver.
        facts = _facts(spark, group)
        rows = facts.collect()
        facts = spark.createDataFrame(rows, facts.schema)
        reports.append(facts.select(F.col("_path").alias("path"), "n_rows", "bad_rows", "too_long_rows", "accepted"))
        kept = [r["_path"] for r in rows if r["accepted"]]
        if kept:
            raw = read_group(spark, group, kept).drop("_too_long")
            tables.append(prepare_flows(raw, source="_path", facts=facts, **prepare).drop("_path", "_block", "_line"))
    if not tables:
        raise FileNotFoundError("no readable CSV inputs")
    flows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return flows, reduce(lambda a, b: a.unionByName(b), reports)
