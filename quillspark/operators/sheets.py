"""Workbook rows into validated questions and reject reasons. Column expressions; a sheet is found its header once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.grading import knowledge_points, sheet_choice, sheet_judgement
from quillspark.functions.text import clean_cell, header_form, is_example
from quillspark.sources.files import SHEETS

SINGLE, MULTIPLE, JUDGE, FILL, SHORT = SHEETS
BLANKS, OPTIONS = 10, 12
USUAL_DIFFICULTY = "简单"


def _place(headers: Column, *names: str) -> Column:
    """The zero-based place of the first header that contains a name or is contained in it; names in order; null if none."""
    found = [F.array_position(F.transform(headers, _fits(name)), F.lit(True)) for name in names]
    return F.coalesce(*(F.when(p > 0, p.cast("int") - 1) for p in found))


def _fits(name: str):
    return lambda h: (h != "") & (F.contains(h, F.lit(name)) | F.contains(F.lit(name), h))


def _cells(cells: Column, start: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: clean_cell(F.get(cells, start + i)))


def standardised(rows: DataFrame) -> DataFrame:
    """(source_file, sheet, row_num, reason, question columns) for rows (source_file, sheet, row_num, cells) of standard sheets.

    reason is null for a question; a sheet without a header, or with one that lacks the question's or answer's column,
    gives one row with row_num 0. Rows without a question, and examples, are left out.
    """
    rows = rows.where(F.col("sheet").isin(SHEETS)).withColumn("cells", F.coalesce("cells", F.array().cast("array<string>")))
    marks = F.transform(F.slice("cells", 1, 8), header_form)
    is_header = F.array_contains(marks, "序号") & (F.array_contains(marks, "题目") | F.array_contains(marks, "试题"))
    heads = rows.groupBy("source_file", "sheet").agg(F.min(F.when(is_header, F.col("row_num"))).alias("head"), F.min_by(F.transform("cells", header_form), F.when(is_header, F.col("row_num"))).alias("headers"))
    h = F.col("headers")
    heads = heads.select("source_file", "sheet", "head", _place(h, "题目").alias("q"), _place(h, "正确答案", "答案").alias("a"), _place(h, "选项").alias("o"), _place(h, "填空项").alias("b"), _place(h, "关键词").alias("k"), _place(h, "知识点").alias("kp"), _place(h, "难度").alias("d"), _place(h, "答案解析", "解析").alias("e"))
    needs_answer = F.col("sheet").isin(SINGLE, MULTIPLE, JUDGE)
    bad = heads.withColumn("reason", F.when(F.col("head").isNull(), "missing_header").when(F.col("q").isNull() | (needs_answer & F.col("a").isNull()), "bad_header"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in QUESTION]
    broken = bad.where("reason is not null").select("source_file", "sheet", F.lit(0).alias("row_num"), "reason", *none)

    # a second header line follows everywhere but on the judgement sheet
    below = F.col("head") + F.when(F.col("sheet") == JUDGE, 0).otherwise(1)
    own = rows.join(bad.where("reason is null").drop("reason"), ["source_file", "sheet"]).where(F.col("row_num") > below)
    cell = lambda at: clean_cell(F.get("cells", at))
    own = own.withColumn("question", cell(F.col("q"))).where((F.col("question") != "") & ~is_example("question"))
    choice = F.col("sheet").isin(SINGLE, MULTIPLE)
    options = (
        F.when(choice, _cells(F.col("cells"), F.coalesce("o", F.lit(3)), OPTIONS))
        .when(F.col("sheet") == FILL, _cells(F.col("cells"), F.coalesce("b", F.lit(2)), BLANKS))
        .when(F.col("sheet") == SHORT, _cells(F.col("cells"), F.coalesce("k", F.lit(2)), BLANKS))
        .otherwise(F.array().cast("array<string>"))
    )
    own = own.withColumn("options", options)
    joined = F.nullif(F.array_join(F.filter("options", lambda o: o != ""), "|"), F.lit(""))
    raw = F.get("cells", F.col("a"))
    own = own.withColumn("answer", F.when(choice, sheet_choice(raw, F.col("sheet") == SINGLE)).when(F.col("sheet") == JUDGE, sheet_judgement(raw)).otherwise(joined))
    letters = F.filter(F.transform("options", lambda o, i: F.when(o != "", F.chr(F.lit(65) + i))), lambda x: x.isNotNull())
    outside = choice & (F.size(letters) > 0) & F.exists(F.split("answer", ""), lambda x: (x != "") & ~F.array_contains(letters, x))
    at = F.concat(F.col("sheet"), F.lit(":row"), F.col("row_num").cast("string"), F.lit(":"))
    reason = F.when(F.col("answer").isNull(), F.concat(at, F.when(F.col("sheet") == SHORT, "missing_keywords").otherwise("missing_answer"))).when(outside, F.concat(at, F.lit("answer_out_of_range")))
    told = F.when(F.col("sheet").isin(FILL, SHORT), "").otherwise(F.coalesce(cell(F.col("e")), F.lit("")))
    whole = own.select("source_file", "sheet", "row_num", reason.alias("reason"), F.col("sheet").alias("qtype"), "question", "answer", "options", knowledge_points(cell(F.col("kp"))).alias("knowledge_points"), F.coalesce(F.nullif(cell(F.col("d")), F.lit("")), F.lit(USUAL_DIFFICULTY)).alias("difficulty"), told.alias("explanation"))
    return whole.unionByName(broken)


QUESTION = [("qtype", "string"), ("question", "string"), ("answer", "string"), ("options", "array<string>"), ("knowledge_points", "string"), ("difficulty", "string"), ("explanation", "string")]


def questions_and_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    whole = standardised(rows)
    kept = whole.where("reason is null").drop("reason").withColumn("source_sheet", F.col("sheet")).drop("sheet")
    return kept, whole.where("reason is not null").select("source_file", "sheet", "row_num", "reason")


def file_reports(rows: DataFrame) -> DataFrame:
    """(source_file, status, issues, questions): ok, error, not_question_bank or empty_or_invalid."""
    whole = standardised(rows).groupBy("source_file").agg(F.count_if(F.col("reason").isNull()).alias("questions"), F.array_sort(F.collect_list("reason")).alias("issues"))
    books = rows.groupBy("source_file").agg(F.count_if(F.col("sheet").isin(SHEETS)).alias("standard"), F.count_if(F.col("sheet").isNull()).alias("broken"))
    out = books.join(whole, "source_file", "left")
    status = F.when(F.col("broken") > 0, "error").when(F.col("standard") == 0, "not_question_bank").when(F.coalesce("questions", F.lit(0)) == 0, "empty_or_invalid").otherwise("ok")
    return out.select("source_file", status.alias("status"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"), F.coalesce("questions", F.lit(0).cast("long")).alias("questions"))
