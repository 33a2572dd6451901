"""Documents into chunks: long paragraphs by windows, markdown by headings and sizes, and section catalogs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERLAP = 120
CHUNK = "doc_path string, chunk_id int, heading string, heading_level int, section_path array<string>, doc_title string, text string"
ARROW_CHUNK = pa.schema([("doc_path", pa.string()), ("chunk_id", pa.int32()), ("heading", pa.string()), ("heading_level", pa.int32()), ("section_path", pa.list_(pa.string())), ("doc_title", pa.string()), ("text", pa.string())])
#: So many documents are cut into rows at once.
DOCS_AT_ONCE = 64


def windows(text: Column, most: int, overlap: int = OVERLAP) -> Column:
    """array<struct<place, part>>: the trimmed text in windows of most characters; one if it fits.

    The stride is most less the overlap, or half of most if that is more.
    """
    t = F.btrim(text, F.lit(" \t\r\n"))
    stride = max(most - overlap, most // 2)
    starts = F.sequence(F.lit(0), F.char_length(t) - 1, F.lit(stride))
    cut = F.filter(F.transform(starts, lambda s: F.struct(F.floor(s / stride).cast("int").alias("place"), F.btrim(F.substring(t, s + 1, F.lit(most)), F.lit(" \t\r\n")).alias("part"))), lambda p: p.part != "")
    whole = F.array(F.struct(F.lit(0).alias("place"), t.alias("part")))
    return F.when(F.char_length(t) == 0, F.array().cast("array<struct<place:int,part:string>>")).when(F.char_length(t) <= most, whole).otherwise(cut)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, line): the lines that aren't blank, with their places among all lines."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("place", "line")).where(F.trim("line") != "")


def lines_under_headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that aren't headings, each with the last heading above it and its level."""
    mark = r"^ {0,3}(#{1,6})\s+(.+?)\s*$"
    rows = lines(docs, key, text).withColumn("level", F.char_length(F.regexp_extract("line", mark, 1))).withColumn("title", F.when(F.col("level") > 0, F.regexp_extract("line", mark, 2)))
    above = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("heading", F.coalesce(F.last("title", ignorenulls=True).over(above), F.lit(""))).withColumn("heading_level", F.coalesce(F.last(F.when(F.col("level") > 0, F.col("level")), ignorenulls=True).over(above), F.lit(0)))
    return rows.where("level = 0").select(key, "place", "heading", "heading_level", "line")


def pieces_of(paragraph: str, most: int) -> list[str]:
    paragraph = paragraph.strip()
    if len(paragraph) <= most:
        return [paragraph] if paragraph else []
    step = max(most - OVERLAP, most // 2)
    return [p for p in (paragraph[i : i + most].strip() for i in range(0, len(paragraph), step)) if p]


HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(.+?)\s*$")
NUMBERED = re.compile(r"^\s*[【\[]\s*(\d+(?:\.\d+){0,5})\s*[】\]]\s*(.{1,140}?)\s*$|^\s*(\d{1,2}(?:\.\d{1,3}){1,5})(?:\s+|[、．]\s*|\.\s+)(.{1,140}?)\s*$")
CONTENTS = re.compile(r"目录|contents|table\s+of\s+contents", re.IGNORECASE)
SENTENCE_END = tuple("。.!?！？；;")


def numbered_heading(line: str) -> tuple[int, str] | None:
    """(level, title) of a line that is a section number with a title, not a measurement or a table row."""
    start = line.lstrip()[:1]
    if not (start.isdecimal() or start in ("【", "[")):
        return None
    found = NUMBERED.match(" ".join(line.split()))
    if not found:
        return None
    number, title = (found[1], found[2]) if found[1] else (found[3], found[4])
    title = " ".join(title.split())
    numbers = re.findall(r"\b\d+(?:\.\d+)?\b", title)
    told = len(re.findall("[一-鿿]", title)) >= 2 or len(re.findall("[A-Za-z]", title)) >= 3
    doubtful = not title or title[0].isdigit() or title[0] in "%‰+-=<>" or number.split(".")[0] == "0"
    tabular = len(re.findall(r"\d", title)) > 0.35 * len(title) or len(numbers) >= 4 or (re.search("[<>=]", title) and len(numbers) >= 2)
    return None if doubtful or tabular or not told else (number.count(".") + 1, f"【{number}】{title}")


def chunks_of(path: str, text: str, most: int = 2600, least: int = 650) -> Iterator[tuple]:
    """The chunks of one document: cut at headings, at the size limit, and after a sentence once the least size is met."""
    title = " ".join(re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]).split())
    stack: list[str] = []
    level, heading, named, number, held = 0, "", False, 0, []

    def cut() -> Iterator[tuple]:
        nonlocal number
        for part in pieces_of("\n\n".join(held), most):
            yield path, number, heading, level, [s for s in stack if s], title, part
            number += 1
        held.clear()

    for line in text.splitlines():
        mark = HEADING.match(line) if "#" in line else None
        section = (len(mark[1]), " ".join(mark[2].split())) if mark else numbered_heading(line)
        if section:
            yield from cut()
            level, heading = section
            if mark and level == 1 and heading and not named and not CONTENTS.search(heading):
                title, named = heading, True
            stack[:] = [*stack[: level - 1], *[""] * (level - 1 - len(stack)), heading]
            continue
        line = line.strip()
        if not line:
            continue
        if held and sum(map(len, held)) + len(line) > most:
            yield from cut()
        held.append(line)
        if sum(map(len, held)) >= least and line.endswith(SENTENCE_END):
            yield from cut()
    yield from cut()


def chunk_documents(docs: DataFrame, path: str = "doc_path", text: str = "text", most: int = 2600, least: int = 650) -> DataFrame:
    """Chunks of markdown or plain texts. A document is one pass over its lines; documents are independent.

    A task holds its batch as it came and the rows of a few documents beside it, whatever the size of a batch.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(start, DOCS_AT_ONCE)
                rows = [r for p, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()) for r in chunks_of(p or "", t or "", most, least)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(ARROW_CHUNK.types)], schema=ARROW_CHUNK)

    return docs.select(path, text).mapInArrow(chunks, CHUNK)


def catalog(chunks: DataFrame, samples: int = 3, headings: int = 12, sample: int = 900) -> DataFrame:
    """One entry for each document (its first headings and samples) and one for each section path, with its first chunk."""
    text = F.trim(F.regexp_replace(F.substring("text", 1, sample), r"(?U)\s+", " "))
    rows = chunks.withColumn("_sample", text)
    by_doc, by_path = Window.partitionBy("doc_path").orderBy("chunk_id"), Window.partitionBy("doc_path", "section_path").orderBy("chunk_id")
    rows = rows.withColumn("_n", F.row_number().over(by_doc)).withColumn("_m", F.row_number().over(by_path))
    joined = lambda c, n, k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(n) <= k, F.struct("chunk_id", c)))), lambda s: s[c]), " ")
    documents = rows.groupBy("doc_path").agg(F.max_by("doc_title", "chunk_id").alias("doc_title"), F.lit(None).cast("array<string>").alias("section_path"), joined("heading", "_n", headings).alias("headings"), joined("_sample", "_n", samples).alias("search_text"), F.lit(0).alias("level"), F.min("chunk_id").alias("chunk_id"))
    sections = rows.where(F.size("section_path") > 0).groupBy("doc_path", "section_path").agg(F.max_by("doc_title", "chunk_id").alias("doc_title"), F.max("heading").alias("headings"), joined("_sample", "_m", samples).alias("search_text"), F.max("heading_level").alias("level"), F.min("chunk_id").alias("chunk_id"))
    return documents.unionByName(sections)
