"""Files as DataFrames: text corpora, JSON lines, scripts, workbooks and server-sent events."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TEXT_SUFFIX = r"(?i)\.(md|markdown|txt)$"
# Words in the paths of exam and answer files, and the names of standard sheets.
EXAM_WORDS = "试题|试卷|考核|考试|答案"
SHEETS = ["单选题", "多选题", "判断题", "填空题", "简答题"]


def path_key(path: F.Column) -> F.Column:
    """A path for comparison: without its scheme, lower-cased."""
    return F.lower(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"))


def text_corpus(spark: SparkSession, root: str, excluded: DataFrame | None = None) -> DataFrame:
    """(doc_path, text) of the markdown and text files below root; exam and answer files and excluded (path) ones don't count.

    The path decides before a file is read. Bytes that aren't UTF-8 are replaced.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    files = files.select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text"))
    inside = F.replace(F.col("doc_path"), F.lit(root), F.lit(""))
    files = files.where(F.col("doc_path").rlike(TEXT_SUFFIX) & ~inside.rlike(EXAM_WORDS))
    if excluded is not None:
        files = files.withColumn("_key", path_key(F.col("doc_path"))).join(excluded.select(path_key(F.col("path")).alias("_key")).distinct(), "_key", "left_anti").drop("_key")
    return files


QA_SCHEMA = "query string, expected_answer string, split string, meta string"


def json_lines(spark: SparkSession, path: str, schema: str = QA_SCHEMA, strict: bool = True) -> DataFrame:
    """Records of a known schema; a malformed line is an error, or else dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def qa_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records with query and expected_answer, numbered in the files' order; the limit counts those that are kept."""
    rows = json_lines(spark, path, strict=False).where("query is not null and expected_answer is not null").withColumn("idx", F.monotonically_increasing_id())
    return rows.orderBy("idx").limit(limit) if limit is not None else rows


def qa_records_or(spark: SparkSession, path: str, fallback: str | None) -> DataFrame:
    """The records of path, or of fallback where path is missing and a fallback is allowed; none at all is an error."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        if fallback is None:
            raise FileNotFoundError(path)
        path = fallback
    rows = qa_records(spark, path)
    if rows.isEmpty():
        raise ValueError(f"{path} has no records")
    return rows


def scripts(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, turn, output); of records that share a sample_id the last counts."""
    rows = spark.read.schema("sample_id long, outputs array<string>").json(path).withColumn("_n", F.monotonically_increasing_id())
    last = rows.groupBy("sample_id").agg(F.max_by("outputs", "_n").alias("outputs"))
    return last.select("sample_id", F.posexplode("outputs").alias("turn", "output"))


# --- Workbooks ----------------------------------------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of the rows of an xlsx file; cells are texts, gaps null."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        read = lambda name: ElementTree.fromstring(archive.read(name))
        names = set(archive.namelist())
        shared = ["".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")) for item in read("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        targets = {rel.get("Id"): rel.get("Target") for rel in read("xl/_rels/workbook.xml.rels")}
        for sheet in read("xl/workbook.xml").findall("m:sheets/m:sheet", _NS):
            target = targets[sheet.get(_REL)].lstrip("/")
            for row in read(target if target.startswith("xl/") else f"xl/{target}").iter(f"{{{_NS['m']}}}row"):
                cells: list[str | None] = []
                for cell in row.findall("m:c", _NS):
                    at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    cells.append(_value(cell, shared))
                yield sheet.get("name"), int(row.get("r", "0")), cells


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
    value = cell.find("m:v", _NS)
    if value is None or value.text is None:
        return None
    return shared[int(value.text)] if cell.get("t") == "s" else {"1": "True", "0": "False"}[value.text] if cell.get("t") == "b" else value.text


CELLS = "source_file string, sheet string, row_num int, cells array<string>"


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all xlsx files below path but lock files; a file that can't be read gives one row without a sheet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path)
    files = files.select("path", "content").where(~F.col("path").rlike(r"/(~\$|\.~)[^/]*$"))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path_, content in frame.itertuples(index=False):
                name = path_.rsplit("/", 1)[-1]
                try:
                    found = [(name, *r) for r in workbook_rows(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    found = [(name, None, 0, None)]
                yield pd.DataFrame(found, columns=["source_file", "sheet", "row_num", "cells"])

    return files.mapInPandas(rows, CELLS)


class WorkbookSource(DataSource):
    """spark.dataSource.register(WorkbookSource); spark.read.format("workbook").load(file): the rows of one workbook."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, row_num int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options["path"])


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as file:
            yield from workbook_rows(file.read())


def question_banks(rows: DataFrame) -> DataFrame:
    """The rows of workbooks with at least one standard sheet."""
    books = rows.where(F.col("sheet").isin(SHEETS)).select("source_file").distinct()
    return rows.join(books, "source_file", "left_semi")


def synonyms(spark: SparkSession, path: str) -> list[list[str]]:
    """The groups of a JSON file {"groups": [[...], ...]}, as grading takes them; a missing file has none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return []
    row = spark.read.schema("groups array<array<string>>").option("multiLine", True).json(path).first()
    return [[w for w in group if w and w.strip()] for group in (row["groups"] if row and row["groups"] else [])]


# --- Server-sent events -------------------------------------------------------------------------------------------------


def sse_frames(lines: DataFrame, key: str = "stream", place: str = "n", line: str = "line") -> DataFrame:
    """(stream, frame, event, id, data): a blank line ends a frame; comments don't count, an id stays until the next one.

    A frame without data is none. One space after the colon goes; data lines are joined by line feeds.
    """
    before = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raw = F.regexp_replace(F.col(line), "\r$", "")
    rows = lines.select(key, place, raw.alias("_l")).withColumn("frame", F.coalesce(F.sum((F.col("_l") == "").cast("int")).over(before), F.lit(0)))
    rows = rows.where(~F.col("_l").startswith(":")).withColumn("_f", F.substring_index("_l", ":", 1)).withColumn("_v", F.regexp_replace(F.regexp_replace("_l", "^[^:]*:?", ""), "^ ", ""))
    rows = rows.withColumn("id", F.last(F.when(F.col("_f") == "id", F.col("_v")), ignorenulls=True).over(up_to))
    own = lambda f: F.when(F.col("_f") == f, F.col("_v"))
    data = F.transform(F.array_sort(F.collect_list(F.when(F.col("_f") == "data", F.struct(place, "_v")))), lambda d: d["_v"])
    frames = rows.groupBy(key, "frame").agg(F.coalesce(F.max_by(own("event"), F.when(F.col("_f") == "event", F.col(place))), F.lit("message")).alias("event"), F.max_by("id", place).alias("id"), data.alias("_d"))
    return frames.where(F.size("_d") > 0).select(key, "frame", "event", "id", F.array_join("_d", "\n").alias("data"))
