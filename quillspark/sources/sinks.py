"""Where results go: JSON lines, flat CSV, markdown, reports, replay texts and batch posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import replay_value, source_title

OPTIONS = 12


def to_json_lines(rows: DataFrame, path: str, files: int | None = None) -> None:
    (rows.coalesce(files) if files else rows).write.mode("overwrite").json(path)


def rag_text(question: Column, options: Column, answer: Column) -> Column:
    """题目, 选项 and 答案 as one text."""
    listed = F.array_join(F.transform(options, lambda o, i: F.concat(F.chr(F.lit(65) + i), F.lit(". "), o)), "\n")
    return F.concat_ws("\n", F.concat(F.lit("题目："), question), F.when(F.size(options) > 0, F.concat(F.lit("选项：\n"), listed)), F.concat(F.lit("答案："), answer))


def questions_to_json(questions: DataFrame, path: str) -> None:
    """Questions with source_title and rag_text."""
    out = questions.withColumn("source_title", source_title("source_file")).withColumn("rag_text", rag_text(F.col("question"), F.col("options"), F.col("answer")))
    to_json_lines(out, path)


def flat_questions(questions: DataFrame) -> DataFrame:
    """20 columns: options padded to twelve."""
    options = [F.coalesce(F.get("options", F.lit(i)), F.lit("")).alias(f"option_{chr(97 + i)}") for i in range(OPTIONS)]
    return questions.select("qtype", "question", "answer", *options, "knowledge_points", "difficulty", "explanation", "source_file", "row_num")


def to_csv(rows: DataFrame, path: str, mark: bool = True) -> None:
    """CSV with a header in each file; with mark the first column's name carries the byte order mark that spreadsheets look for."""
    first = rows.columns[0]
    out = rows.withColumnRenamed(first, "﻿" + first) if mark else rows
    out.write.mode("overwrite").option("header", True).csv(path)


def file_name(x: Column) -> Column:
    """A title as a file name: no separators, at most 120 characters."""
    return F.substring(F.regexp_replace(F.trim(x), r'[\\/:*?"<>|]', "_"), 1, 120)


def markdown(questions: DataFrame) -> DataFrame:
    """(source, text): the questions of each source in order, as markdown."""
    numbered = F.concat(F.lit("## "), F.col("row_num").cast("string"), F.lit("\n\n"), rag_text(F.col("question"), F.col("options"), F.col("answer")))
    each = questions.select(file_name(source_title("source_file")).alias("source"), F.struct("source_sheet", "row_num", numbered.alias("text")).alias("q"))
    return each.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("q")), lambda q: q.text), "\n\n").alias("text"))


def to_markdown(questions: DataFrame, path: str) -> None:
    markdown(questions).repartition("source").write.mode("overwrite").partitionBy("source").option("lineSep", "\n").text(path)


def renumbered(questions: DataFrame) -> DataFrame:
    """Questions numbered anew within their type, in order of file, sheet and row."""
    from pyspark.sql import Window

    return questions.withColumn("number", F.row_number().over(Window.partitionBy("qtype").orderBy("source_file", "source_sheet", "row_num")))


def report(questions: DataFrame, rejects: DataFrame) -> DataFrame:
    """(section, key, n): totals, questions by type and reasons of rejects, the commonest first."""
    total = questions.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit("questions").alias("key"), "n")
    kinds = questions.groupBy(F.col("qtype").alias("key")).agg(F.count("*").alias("n")).select(F.lit("type").alias("section"), "key", "n")
    reasons = rejects.groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("key")).agg(F.count("*").alias("n")).select(F.lit("reject").alias("section"), "key", "n")
    return total.unionByName(kinds).unionByName(reasons).orderBy("section", F.desc("n"), "key")


def replay_lines(turns: DataFrame, values: list[str], numbers: list[str], key: str = "sample_id", order: str = "turn") -> DataFrame:
    """(sample_id, text): each turn as sorted key=value pairs, numbers with four places, texts on one line and cut."""
    pairs = {c: F.concat(F.lit(f"{c}="), replay_value(F.col(c).cast("string"))) for c in values} | {c: F.format_string(f"{c}=%.4f", F.col(c).cast("double")) for c in numbers}
    line = F.concat_ws(" ", F.lit("turn"), *(pairs[c] for c in sorted(pairs)))
    return turns.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda t: t.line), "\n").alias("text"))


def post_batches(post: Callable[[list[dict]], None], fallback: str, size: int = 256, attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows in lists of at most size to post, from the executors; what still fails after so many
    attempts is appended to fallback as JSON lines, so a batch never fails for its receiver. At least once: batch_id and
    the place in it go along, and a receiver may drop what it has seen."""

    def write(batch: DataFrame, batch_id: int) -> None:
        names = batch.columns

        def send(frames):
            import pandas as pd

            failed = []
            for frame in frames:
                rows = frame.assign(batch_id=batch_id).to_dict("records")
                for i in range(0, len(rows), size):
                    for attempt in range(attempts):
                        try:
                            post(rows[i : i + size])
                            break
                        except Exception:  # noqa: BLE001  any failure of the receiver is one
                            if attempt == attempts - 1:
                                failed.append(frame.iloc[i : i + size])
            yield pd.concat(failed)[names] if failed else pd.DataFrame({n: [] for n in names})

        batch.mapInPandas(send, batch.schema).write.mode("append").json(fallback)

    return write


# The header lines of the standard sheets.
CHOICE_HEADER = ["序号（必填）", "题目(必填)", "正确答案(必填)", "选项", *[""] * 11, "知识点", "难度*(必填)", "答案解析"]
HEADERS = {
    "单选题": [CHOICE_HEADER, ["", "", "", *(f"{chr(65 + i)}{'' if i < 4 else '(勿删)'}" for i in range(OPTIONS))]],
    "多选题": [CHOICE_HEADER, ["", "", "", *(f"{chr(65 + i)}{'' if i < 4 else '(勿删)'}" for i in range(OPTIONS))]],
    "判断题": [["序号（必填）", "题目(必填)", "正确答案(必填)", "知识点", "难度*(必填)", "答案解析"]],
    "填空题": [["序号（必填）", "题目(必填)", "填空项", *[""] * 9, "知识点", "难度*(必填)"], ["", "", *(f"空{i}" for i in range(1, 11))]],
    "简答题": [["序号（必填）", "题目(必填)", "关键词", *[""] * 9, "知识点", "难度*(必填)"], ["", "", *(f"关键词{i}" for i in range(1, 11))]],
}


def sheet_rows(questions: DataFrame) -> DataFrame:
    """(qtype, number, cells) of each question, numbered anew."""
    n = renumbered(questions)
    pad = lambda k: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get("options", i), F.lit("")))
    head, tail = F.array(F.col("number").cast("string"), F.col("question")), F.array("knowledge_points", "difficulty")
    choice = F.concat(head, F.array("answer"), pad(OPTIONS), tail, F.array("explanation"))
    judge = F.concat(head, F.array("answer"), tail, F.array("explanation"))
    cells = F.when(F.col("qtype").isin("单选题", "多选题"), choice).when(F.col("qtype") == "判断题", judge).otherwise(F.concat(head, pad(10), tail))
    return n.select("qtype", "number", cells.alias("cells"))


def to_workbook(questions: DataFrame, path: str) -> None:
    """One xlsx file with the standard sheets, on the driver's disk: rows pass through it one partition at a time."""
    import zipfile
    from xml.sax.saxutils import escape

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    rows = sheet_rows(questions)
    names = list(HEADERS)

    def line(n: int, cells: list[str]) -> str:
        return f'<row r="{n}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in cells) + "</row>"

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        out.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        out.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, name in enumerate(names, 1):
            with out.open(f"xl/worksheets/sheet{i}.xml", "w") as sheet:
                sheet.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                n = 0
                for n, cells in enumerate(HEADERS[name], 1):
                    sheet.write(line(n, cells).encode())
                for row in rows.where(F.col("qtype") == name).orderBy("number").toLocalIterator():
                    n += 1
                    sheet.write(line(n, row["cells"]).encode())
                sheet.write(b"</sheetData></worksheet>")
