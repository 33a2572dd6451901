"""Episodes replayed turn by turn over a small corpus."""

import pytest

from quillspark.operators import chunking, episodes, records, search

DOCS = [("spc.md", "# 控制图分析\n\n控制图分析时，Exclude 功能可以永久排除 Sample，其它功能不可以。"), ("bad.md", "# 请假\n\n员工可以在系统里提交请假单。")]
QUESTION = "控制图分析 中 永久排除 Sample 的 功能 是什么"


@pytest.fixture(scope="module")
def retrieval(spark):
    chunks = chunking.chunk_documents(spark.createDataFrame(DOCS, "doc_path string, text string")).cache()
    return episodes.over_index(search.index(chunks), chunks)


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "sample_id long, query string, expected_answer string, split string")


def script(spark, outputs):
    return spark.createDataFrame([(i, t, x) for i, said in enumerate(outputs) for t, x in enumerate(said)], "sample_id long, turn int, output string")


def test_replay(spark, retrieval):
    rows = table(spark, [(QUESTION, "[single] A", "train"), (QUESTION, "[multiple] A,C", "val"), (QUESTION, "[single] B", "train"), (None, None, None)])
    said = [
        ["<search>控制图分析 永久排除 Sample</search>", "<search>again</search>", "\\boxed{A}"],
        ["<search>控制图分析 永久排除 Sample</search>", "<read>1 9</read>", "\\boxed{A,B,C}"],
        ["nothing", "<search>a</search>\\boxed{B}", "<read>3</read>"],
        ["\\boxed{x}"],
    ]
    turns = episodes.replay(rows, script(spark, said), *retrieval, episodes.Limits(max_turns=3)).collect()
    got = {(r["sample_id"], r["turn"]): r for r in turns}
    assert got[0, 0]["search_nonempty"] and "永久排除" in got[0, 0]["observation"] and got[0, 0]["reward"] == pytest.approx(0.06)
    assert got[0, 0]["answer_mode"] and got[0, 1]["answer_mode_search"] and got[0, 1]["reward"] == -0.2
    assert (got[0, 2]["reward"], got[0, 2]["terminated"], got[0, 2]["answer"]) == (1.0, True, "A")
    assert got[1, 0]["reward"] == 0 and got[1, 1]["missing_reads"] == 1 and got[1, 1]["read_nonempty"]
    assert got[1, 2]["reward"] == 0.75 and not got[1, 2]["final_correct"]
    assert got[2, 0]["reward"] == pytest.approx(-0.1) and got[2, 1]["reward"] == -0.2
    assert got[2, 2]["timeout"] and got[2, 2]["reward"] == -1.0 and got[2, 2]["terminated"]
    assert got[3, 0]["terminated"]
    summary = records.episode_summary(spark.createDataFrame(turns).withColumnRenamed("sample_id", "episode_id")).first()
    assert summary["episodes"] == 4 and summary["boxed_rate"] == 0.75


def test_gold_scripts_score_full(spark, retrieval):
    rows = table(spark, [(QUESTION, "[single] A", "train"), ("题目：" + QUESTION + "\n选项：\nA. x\nB. y", "[bool] B", "train")])
    turns = episodes.replay(rows, episodes.gold_scripts(rows), *retrieval).where("terminated").collect()
    assert [r["reward"] for r in turns] == [1.0, 1.0]
    assert episodes.replay(rows.limit(0), episodes.gold_scripts(rows).limit(0), *retrieval).count() == 0


def test_quality():
    assert episodes.quality("q", " ") == "none" and episodes.quality(QUESTION, "完全 无关") == "none"
    assert episodes.quality("控制图分析的永久排除功能", "x 控制图分析的永久排除功能 y") == "strong"
    assert episodes.quality("How many arms are there", "arms are long") == "weak"


def test_bank_then_catalog_then_reads(spark):
    docs = [("泵.md", "# 真空泵 维护\n泵油 更换 周期 为 三个月。\n## 更换 步骤\n先 停机 再 换油，最后 检查 真空泵 压力。"), ("阀.md", "# 阀门 手册\n开关 说明 在 这里。")]
    chunks = chunking.chunk_documents(spark.createDataFrame(docs, "doc_path string, text string"))
    bank = spark.createDataFrame([(1, "阀门 压力 超限 时 应当 先 关闭 哪个 开关", "B 总开关")], "item_id long, question string, answer string")
    find, read = episodes.over_index(search.index(chunks), chunks, bank=bank, sections=chunking.catalog(chunks))
    asked = [(0, ["阀门 压力 超限 时 应当 先 关闭 哪个 开关"], 500), (1, ["真空泵 更换 步骤"], 500), (2, ["阀"], 500), (3, ["完全 无关 zzz"], 500)]
    hits = {r["sample_id"]: r for r in find(spark.createDataFrame(asked, "sample_id long, queries array<string>, budget int")).collect()}
    assert set(hits) == {0, 1} and "答案：B 总开关" in hits[0]["content"] and [h["doc_path"] for h in hits[0]["hits"]] == [None]
    assert {h["doc_path"] for h in hits[1]["hits"]} == {"泵.md"} and "更换 步骤" in hits[1]["content"]
    wanted = spark.createDataFrame([(i, [h.asDict() for h in hits[i]["hits"][:1]], 500, "真空泵 更换 步骤") for i in (0, 1)], f"sample_id long, hits {episodes.HIT}, budget int, query string")
    got = {r["sample_id"]: r["content"] for r in read(wanted).collect()}
    assert got[0] == "题目：阀门 压力 超限 时 应当 先 关闭 哪个 开关\n答案：B 总开关" and "先 停机 再 换油" in got[1]


def test_lookups_and_signals(spark):
    rows = spark.createDataFrame([("泵",), ("真空泵 压力 超限 处理",), ("CMP VTM",), (None,), ("a b",)], "q string")
    assert [r[0] for r in rows.select(episodes.is_lookup("q")).collect()] == [False, True, True, False, False]
    assert {"灭火", "应急处置"} <= episodes.signal_terms("车间起火") and "急停" in episodes.signal_terms("press EMO")
