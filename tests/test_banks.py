"""Exam files, workbooks and their sinks."""

import io
import zipfile

from pyspark.sql import functions as F

from quillspark.operators import exams, sheets
from quillspark.sources import files, sinks

CASES = [
    ("/d/questions/19.MO case summary试题.md", "选择题\n1. 哪些需要确认 A. 人员 B. 机台 C. 参数 D. 以上都要确认"),
    ("/d/answers/19.MO case summary答案.md", "选择题：\nD"),
    ("/d/a/Group 1 CDSEM-试卷.md", "填空题\n1. 用于____ 的工具\n2. 数据库是____ 产品"),
    ("/d/a/Group 1 CDSEM-答案.md", "填空题：\n快速建立OPC Recipe\nSQL server"),
    ("/d/b/Group 9 Safety-试卷.md", "填空题\n1. 第一空____ 内容\n2. 第二空____ 内容\n3. 第三空____ 内容"),
    ("/d/b/Group 9 Safety-答案.md", "填空题：\n甲\n乙"),
    ("/d/c/Group 8 Ops-试卷.md", "单选题\n1. 第一题选什么 A. Alpha B. Beta\n2. 第二题选什么 A. Gamma B. Delta"),
    ("/d/c/Group 8 Ops-答案.md", "答案：\n1. 2:B"),
    ("/d/e/05-Zero MO试题.md", "多选题\n1. 哪些属于安全设施（A C） A. 护栏 B. 椅子 C. 联锁"),
    ("/d/f/试题format.md", "判断题\n1. 。。。（对）\n2. ____（错）"),
]


def test_exam_files_bind_as_they_should(spark):
    bank = exams.question_bank(spark.createDataFrame(CASES, "path string, text string")).collect()
    got = {(r["question_path"].rsplit("/", 1)[-1], r["qtype"], r["ordinal"]): (r["answer"], r["answer_detail"]) for r in bank}
    assert got[("19.MO case summary试题.md", "single", 1)] == ("D", "以上都要确认")
    assert got[("Group 1 CDSEM-试卷.md", "fill", 2)][0] == "SQL server"
    assert not [k for k in got if "Group 9" in k[0]]
    assert {k: v for k, v in got.items() if "Group 8" in k[0]} == {("Group 8 Ops-试卷.md", "single", 2): ("B", "Delta")}
    assert got[("05-Zero MO试题.md", "multiple", 1)][0] == "A,C"
    assert not [k for k in got if "format" in k[0]]


def test_ambiguous_names_do_not_pair(spark):
    names = ["/x/Group 1 ABC-试卷.md", "/x/Group 2 ABC-试卷.md", "/y/Group 3 ABC-答案.md"]
    pairs = exams.pair_files(spark.createDataFrame([(n, "") for n in names], "path string, text string")).collect()
    assert {(r["question_path"], r["answer_path"]) for r in pairs} == {(n, n) for n in names[:2]}


def workbook(sheets_: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets_, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets_) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets_.values(), 1):
            cells = lambda r, row: "".join(f'<c r="{chr(65 + k)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(row) if v is not None)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r}">{cells(r, row)}</row>' for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>")
    return out.getvalue()


CHOICE = ["序号（必填）", "题目(必填)", "正确答案(必填)", "选项", None, None, None, None, None, None, None, None, None, None, None, "知识点", "难度*(必填)", "答案解析"]


def test_workbooks_give_questions_and_reasons(spark, tmp_path):
    row = lambda n, q, a, *o: [str(n), q, a, *o, *[None] * (12 - len(o)), "k1|k2", "", "why"]
    book = {
        "单选题": [["说明"], CHOICE, [None, None, None, "A", "B"], row(1, "一 问", "b", "x", "y"), row(2, "二问", "", "x", "y"), row(3, "三问", "D", "x", "y"), row(4, "这是单选题题目", "A", "x")],
        "判断题": [["序号", "题目", "正确答案", "知识点", "难度", "答案解析"], ["1", "对吗", "TRUE", "", "难", ""], ["2", "混", "maybe"]],
        "填空题": [["序号", "题目", "填空项"], [None, None, "空1", "空2"], ["1", "空____", "甲", "乙"]],
        "简答题": [["序号", "试题", "关键词"], [], ["1", "为何", "k"]],
    }
    (tmp_path / "a.xlsx").write_bytes(workbook(book))
    (tmp_path / "b.xlsx").write_bytes(workbook({"Other": [["x"]]}))
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    rows = files.workbooks(spark, str(tmp_path))
    questions, rejects = sheets.questions_and_rejects(rows)
    got = {(r["qtype"], r["question"]): r for r in questions.collect()}
    assert {k: r["answer"] for k, r in got.items()} == {("单选题", "一 问"): "B", ("判断题", "对吗"): "对", ("填空题", "空____"): "甲|乙"}
    assert got[("判断题", "对吗")]["difficulty"] == "难" and got[("单选题", "一 问")]["difficulty"] == "简单"
    assert {r["reason"] for r in rejects.collect()} == {"单选题:row5:missing_answer", "单选题:row6:answer_out_of_range", "判断题:row3:missing_answer", "bad_header"}
    assert {r["source_file"]: r["status"] for r in sheets.file_reports(rows).collect()} == {"a.xlsx": "ok", "b.xlsx": "not_question_bank", "c.xlsx": "error"}
    assert sinks.flat_questions(questions).columns[3] == "option_a" and len(sinks.flat_questions(questions).columns) == 20
    sinks.to_csv(sinks.flat_questions(questions), f"{tmp_path}/csv")
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    sinks.questions_to_json(questions, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").where("rag_text like '题目：%'").count() == 3
    assert sinks.markdown(questions).first()["source"] == "a"
    assert sinks.report(questions, rejects).where("section = 'total'").first()["n"] == 3
    spark.dataSource.register(files.WorkbookSource)
    assert spark.read.format("workbook").load(str(tmp_path / "a.xlsx")).where(F.col("sheet") == "判断题").count() == 3


def test_server_sent_events(spark):
    lines = [": keepalive", "id: 7", "event: log", "data: one", "data:  two", "", "data: three", "", "event: end", "", "data: tail"]
    frames = files.sse_frames(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream string, n int, line string")).sort("frame").collect()
    assert [(r["event"], r["id"], r["data"]) for r in frames] == [("log", "7", "one\n two"), ("message", "7", "three"), ("message", "7", "tail")]


def test_json_lines_and_corpora(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"query":"a","expected_answer":"[single] A"}\n\nnot json\n{"query":"b"}\n{"query":"c","expected_answer":"x"}\n')
    assert [r["query"] for r in files.qa_records(spark, str(tmp_path / "r.jsonl"), 2).collect()] == ["a", "c"]
    assert files.qa_records_or(spark, str(tmp_path / "none"), str(tmp_path / "r.jsonl")).count() == 2
    (tmp_path / "s.jsonl").write_text('{"sample_id":1,"outputs":["x"]}\n{"sample_id":1,"outputs":["y","z"]}\n')
    assert [(r["turn"], r["output"]) for r in files.scripts(spark, str(tmp_path / "s.jsonl")).sort("turn").collect()] == [(0, "y"), (1, "z")]
    docs = tmp_path / "docs"
    docs.mkdir()
    for name in ("a.md", "b试题.md", "c.bin", "d.txt"):
        (docs / name).write_text("# T\ntext")
    out = spark.createDataFrame([(f"file://{docs}/d.txt",)], "path string")
    assert [r["doc_path"].rsplit("/", 1)[-1] for r in files.text_corpus(spark, str(docs), out).collect()] == ["a.md"]


def test_bank_matches_compare_whole_keys(spark):
    from quillspark.operators import retrieval

    asked, far = "waferetchchamberpressure", "x".join(str(i) for i in range(400))
    items = [(1, far + asked, ["other"]), (2, "chamber", ["chamber"]), (3, "unrelated", ["unrelated"]), (4, "waferzzetch", ["wafer", "etch"])]
    queries = spark.createDataFrame([(7, asked, ["wafer", "etch", "chamber", "pressure", "limit"])], "query_id long, key string, tokens array<string>")
    found = retrieval.bank_matches(queries, spark.createDataFrame(items, "item_id long, key string, tokens array<string>"), 5).collect()
    # the first holds the query at its end, the second is part of it; two long tokens of five are a coverage of 0.4
    assert [(r["item_id"], r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (2, 2), (4, 3)]
    assert [round(r["score"], 6) for r in found if r["item_id"] < 3] == [0.96, 0.96]


def test_bank_pairs_are_pruned_where_the_items_lie(spark, monkeypatch):
    """Hundreds of items share a common token with a query; few pairs leave the tasks, and the best are those of all pairs."""
    from quillspark.operators import retrieval, scoring

    monkeypatch.setattr(scoring, "CELLS", 64)
    monkeypatch.setattr(scoring, "WAITING", 32)
    items = [(i, f"item{i:04d}" + "with" * (i % 7) + "chamberpressure" * (i % 2), sorted({"with", f"t{i % 13}", "chamber" if i % 3 else "wafer"})) for i in range(600)] + [(900, "cham", []), (901, "", ["with", "t5"])]
    items = spark.createDataFrame(items, "item_id long, key string, tokens array<string>").repartition(4)
    queries = spark.createDataFrame([(1, "chamberpressurewith", ["with", "chamber", "t5"]), (2, "item0007", ["nothing"]), (3, "", [])], "query_id long, key string, tokens array<string>")
    pairs = scoring.bank_pairs(queries, items, 3)
    assert pairs.count() < 600
    found = {(r.query_id, r.rank): (r.item_id, round(r.score, 6)) for r in retrieval.bank_matches(queries, items, 3).collect()}
    everything = {(r.query_id, r.rank): (r.item_id, round(r.score, 6)) for r in retrieval.bank_matches(queries, items, 1000).collect()}
    assert found == {at: r for at, r in everything.items() if at[1] <= 3} and found[2, 1] == (7, 0.96)
