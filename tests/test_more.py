"""Titles, prompts, judged grades, catalogs and resolved configurations."""

from pyspark.sql import functions as F

from quillspark.functions import clean, titles
from quillspark.operators import chunking, configs, judge, prompts, search, sheets, telemetry
from quillspark.sources import files, sinks


def test_titles(spark):
    rows = [("【1.2】设备维护手册", "设备维护手册"), ("3.1 page 4", "3.1 page 4"), ("1.2.3-4 Safety rules", "Safety rules"), ("Plain", "Plain"), ("", "")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", titles.canonical(F.col("t")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
    one = spark.range(1).select(titles.preferred(F.array(*map(F.lit, ["page 1", "【2】Valve manual", "Valve manual"]))).alias("p"), titles.path_label(F.lit("Valve manual"), F.array(F.lit("【2】Valve manual"), F.lit("Open"))).alias("l"), titles.group_key(F.lit("a/b"), F.lit("page 3")).alias("k")).first()
    assert tuple(one) == ("Valve manual", "【2】Valve manual > Open", "path:a/b")


def test_prompts(spark):
    q = "下面是一道多选题，请作答。\n\n\n题目：x\n选项：\nA. 1\n作答后，把最终答案放入 \\boxed{}\n"
    got = spark.createDataFrame([(q,), (None,)], "query string")
    rows = prompts.data(got, "SYS", "").collect()
    assert rows[0]["prompt"] == "SYS\n\n真实题目如下。\n\n题型：多选题\n题目：x\n选项：\nA. 1"
    assert rows[1]["message_log"][0]["role"] == "user"


def test_judge_falls_back_to_rules(spark):
    rows = spark.createDataFrame([("题目：q", "low \\boxed{a}", "[short] a ||| q"), ("q", "no box", "[short] a"), ("q", "\\boxed{A}", "[single] A"), ("fail", "\\boxed{a}", "[short] a ||| c")], "query string, completion string, expected_answer string")

    def ask(prompt: str) -> str:
        if "fail" in prompt:
            raise OSError
        return '{"score": 0.8}'

    assert [r["grade"] for r in judge.judged(rows, ask).collect()] == [0.8, -0.5, 1.0, 0.5]
    assert [r["grade"] for r in judge.judged(rows).collect()] == [0.5, -0.5, 1.0, 0.5]
    assert judge.score_in("say 1.7") == 1.0 and judge.score_in("none") is None


def test_catalog_search(spark):
    docs = [("a/泵.md", "# 真空泵 维护\n泵油 更换 周期。\n## 更换 步骤\n先 停机 再 换油。"), ("b/阀.md", "# 阀门 手册\n开关 说明。")]
    sections = chunking.catalog(chunking.chunk_documents(spark.createDataFrame(docs, "doc_path string, text string")))
    hits = search.search_catalog(spark.createDataFrame([(1, "真空泵 更换 步骤")], "query_id long, query string"), sections).sort("rank").collect()
    assert hits[0]["doc_path"] == "a/泵.md" and all(h["doc_path"] == "a/泵.md" for h in hits)


def test_configurations_resolve():
    files = {"base": {"a": {"x": 1}}, "mid": {"defaults": ["base"], "a": {"y": 2}}, "top": {"defaults": ["mid", 3], "a": {"x": 9}}}
    assert configs.resolved("top", files.get) == {"a": {"x": 9, "y": 2}}


def test_job_scope(spark):
    actors = spark.createDataFrame([("j", "n1", "ALIVE"), ("j", "n1", None), ("j", "n2", "DEAD"), ("k", "n3", "restarting")], "job_id string, node_id string, state string")
    fallback = spark.createDataFrame([("j", "d"), ("k", "d")], "job_id string, node_id string")
    nodes = telemetry.job_scope(actors, fallback)
    assert {tuple(r) for r in nodes.collect()} == {("j", "n1"), ("k", "d")}
    gauges = spark.createDataFrame([("n1", 1.0), ("n2", 2.0)], "node_id string, value double")
    assert telemetry.scoped(gauges, nodes).count() == 1


def test_reading_outward(spark):
    chunks = spark.createDataFrame([("d", i, "h", t) for i, t in enumerate(["第一段 正文 内容。", "目录 1 2", "中间 段落 在这里。", "x", "第五段 也 可以 读。"])], "doc_path string, chunk_id int, heading string, text string")
    hits = spark.createDataFrame([(1, 1, "d", 2)], "query_id int, rank int, doc_path string, chunk_id int")
    assert [r["chunk_id"] for r in search.read_outward(hits, chunks, 3).sort("distance", "chunk_id").collect()] == [2, 0, 4]


def test_feedback_items():
    text = "1. 资料：" + "甲乙丙丁戊己庚辛" * 8 + "2. 资料：" + "甲乙丙丁戊己庚辛" * 8 + "\n3. 文档：其他\n下一步"
    assert clean.feedback(text) == "1. 资料：" + "甲乙丙丁戊己庚辛" * 8 + "\n3. 文档：其他\n下一步"


def test_workbooks_round_trip(spark, tmp_path):
    rows = [("单选题", "q & <1>", "A", ["x", "y"], "k", "难", "why", "f.xlsx", "单选题", 3), ("填空题", "空", "甲|乙", ["甲", "乙"], "", "简单", "", "f.xlsx", "填空题", 3), ("判断题", "对?", "对", [], "", "简单", "", "f.xlsx", "判断题", 2)]
    questions = spark.createDataFrame(rows, "qtype string, question string, answer string, options array<string>, knowledge_points string, difficulty string, explanation string, source_file string, source_sheet string, row_num int")
    sinks.to_workbook(questions, str(tmp_path / "out.xlsx"))
    back, rejects = sheets.questions_and_rejects(files.workbooks(spark, str(tmp_path)))
    assert {(r["qtype"], r["question"], r["answer"]) for r in back.collect()} == {(r[0], r[1], r[2]) for r in rows}
    assert rejects.count() == 0


def test_search_intents_read_whole_texts(spark, tmp_path):
    from quillspark.plans import queries

    text = "alpha beta " + " " * 60 + "gamma; delta epsilon"
    spark.createDataFrame([(1, text), (3, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.queries()["search_intents"](spark, str(tmp_path)).collect()}
    assert all("gamma; delta" in r["cleaned"] for r in rows.values())
    assert "alpha beta gamma" in rows[1]["intents"]


def test_ocr_noise_lines_as_sql_on_odd_lines(spark, tmp_path):
    import duckdb

    from quillspark.plans import queries

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    codes = " ".join(f"éA{i}é" for i in range(100, 110))
    lines = ["user: said", "No text detected", "FileNotFoundError: x", "## Notes", "cpu: 1 oos: 2", f"{words} 中文字符五六", " x", "\x0b", codes, " ".join(f"Module-{i}" for i in range(10)), "选择时间 查询 导出 2024-01-01 2024-01-02", "1234567890 " * 14 + "中" * 120, "a b", "x\r", "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(db.sql(queries.oracle_sql()["ocr_noise_lines"]).fetchall())
    assert sorted(tuple(r) for r in queries.ocr_noise_lines(spark, str(tmp_path)).collect()) == want


def test_chunks_are_made_of_few_documents_at_once():
    """A batch of many documents comes out as several, with the same chunks."""
    import pyarrow as pa

    from quillspark.operators import chunking

    real = pa.RecordBatch.from_arrays

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, make, _):
            rows = [(f"a/{i}.md", f"# T{i}\n" + "some words. " * 300 + "\n## S\nend.") for i in range(200)] + [(None, None)]
            return list(make(iter([real([pa.array([p for p, _ in rows]), pa.array([t for _, t in rows])], names=["p", "t"])]))), rows

    seen, rows = chunking.chunk_documents(Docs())
    assert len(seen) > 3 and max(b.num_rows for b in seen) <= 64 * 4
    got = [tuple(r.values()) for b in seen for r in b.to_pylist()]
    assert got == [c for p, t in rows for c in chunking.chunks_of(p or "", t or "")]
