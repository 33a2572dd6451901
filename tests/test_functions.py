"""Grading, action grammar, text and token functions on the shapes of known cases."""

import datetime
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.functions import actions, grading, text, tokens
from quillspark.operators import chunking, configs, records, retrieval, telemetry

GRADES = [
    ("[single] B", "答案 \\boxed{B}", 1.0),
    ("[single] B", "\\boxed{C}", 0.0),
    ("[single] B", "我觉得是 B", -0.5),
    ("[bool] A", "\\boxed{A}", 1.0),
    ("[multiple] A,C,D", "\\boxed{D, A, C}", 1.0),
    ("[multiple] A,C,D", "\\boxed{A,C}", 2 / 3),
    ("[multiple] A,C,D", "\\boxed{A,B,C,D}", 2.5 / 3),
    ("[multiple] A,C", "\\boxed{A,B,C}", 0.75),
    ("[fill] 拒收/reject ||| 特采/waive ||| 放行/Release", "\\boxed{reject; 特采; Release}", 1.0),
    ("[fill] 正向 ||| 3V ||| 0V ||| 0.7V", "\\boxed{正向; 3V; 1V; 0.7V}", 0.75),
    ("[short] 低温/掺杂 ||| 纯度高 ||| 横向扩散小", "离子注入是低温工艺，纯度高。\\boxed{低温; 纯度高}", 2 / 3),
    ("no type", "\\boxed{No. TYPE}", 1.0),
    ("[odd] x", "\\boxed{x}", 0.0),
    (None, None, -0.5),
    ("[multiple] ", "\\boxed{}", 0.0),
    ("[fill] a\nb", "\\boxed{}", 0.0),
]
BOXES = [("\\boxed{a_{1} + b}", "a_{1} + b"), ("\\boxed{A} \\boxed {B}", "B"), ("none", None), ("\\boxed{\\boxed{A}}", "A"), ("\\boxed{A} \\boxed{open", "A"), ("\\boxed{", None), (None, None)]


def test_grades(spark):
    table = spark.createDataFrame([(i, *g) for i, g in enumerate(GRADES)], "i int, e string, c string, want double")
    for r in table.withColumn("got", grading.grade("e", "c")).collect():
        assert r["got"] == pytest.approx(r["want"]), r
    own = spark.createDataFrame(BOXES, "t string, want string").withColumn("got", grading.boxed("t"))
    assert [r["got"] for r in own.collect()] == [w for _, w in BOXES]


ACTIONS = [
    ("<search>控制图分析</search> 现在确定 \\boxed{A}", "invalid", "mixed_action"),
    ("<think>需要读第1条。</think><read>1</read>", "read", ""),
    ("<read>1</read>\\boxed{A}", "invalid", "mixed_action"),
    ("答案是 \\boxed {A}", "answer", ""),
    ("<think>\\boxed{A}</think><search>OFD 发票 源文件</search>", "search", ""),
    ("<think>我需要查询资料。<search>OFD 发票 源文件</search>", "search", ""),
    ("<search>关键词</search>", "invalid", "empty_search"),
    ("<search>OFD 发票 源文件</search>我猜答案是 A", "search", ""),
    ("<read>x</read>", "invalid", "empty_read"),
    ("<search>open", "invalid", "malformed_search"),
    ("</READ>", "invalid", "malformed_read"),
    (None, "invalid", "no_action"),
]


def test_actions(spark):
    table = spark.createDataFrame([(i, *a) for i, a in enumerate(ACTIONS)], "i int, t string, action string, error string")
    rows = actions.with_action(table.drop("action", "error"), "t", "a").sort("i").collect()
    assert [(r["a"]["action"], r["a"]["error"]) for r in rows] == [a[1:] for a in ACTIONS]
    assert rows[4]["a"]["search_queries"][0] == "OFD 发票 源文件" and not rows[4]["a"]["has_extra_text"]
    assert rows[7]["a"]["has_extra_text"] and rows[0]["a"]["boxed_answers"] == ["A"] and rows[1]["a"]["read_ids"] == [1]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("value", ["Ａ１　ｂ\n c ﬁ", " plain ", "", None, "Straße x"])
def test_normal_text(spark, value):
    want = " ".join(unicodedata.normalize("NFKC", value or "").split())
    assert one(spark, value, text.normalize_text("x")) == want
    import re

    assert one(spark, value, text.compact("x")) == re.sub(r"[\W_]+", "", want.casefold())


def test_queries_tokens_and_budgets(spark):
    assert one(spark, "私自 by pass 安全设施 处罚", text.clean_query("x")) == "私自 bypass 安全设施 处罚"
    assert one(spark, "请看 检索结果返回", text.clean_query("x")) == "" and one(spark, "X1", text.clean_query("x")) == ""
    assert one(spark, "OFD 电子发票 源文件 必须", tokens.search_intents("x")) == ["OFD 电子发票 源文件 必须"]
    assert one(spark, "a中b文字", tokens.ngrams("x")) == ["中文", "文字", "中文字"]
    assert one(spark, "中", tokens.ngrams("x")) == []
    assert one(spark, "v1.2 CD/SEM 3.5 _x", tokens.latin_tokens("x")) == ["v1.2", "CD/SEM", "3.5", "x"]
    assert one(spark, "中文ab cd", text.estimate_tokens("x")) == 2 + 2
    assert one(spark, "中文中文", text.trim_to_budget("x", 3)) == "中文中..." and one(spark, "short", text.trim_to_budget("x", 9)) == "short"
    assert one(spark, "abcd efgh ijkl", text.trim_to_budget("x", 2)) == "abcd efg..."
    for label, n in (("一", 1), ("十", 10), ("十二", 12), ("三十", 30), ("四十五", 45), ("x", None)):
        assert one(spark, label, text.chinese_number("x")) == n
    assert one(spark, "20260611160325_考试.xlsx", text.source_title("x")) == "考试"
    assert one(spark, "题目 (必填)*", text.header_form("x")) == "题目"
    assert one(spark, "#### 1,234", text.gsm8k_answer("x")) == "1234" and one(spark, "#### 3.5", text.gsm8k_answer("x")) == "3"
    now = F.lit(datetime.datetime(2024, 5, 6, 7, 8, 9)).cast("timestamp")
    for line, want in (("\x1b[31m(W pid=1, ip=1.2.3.4) hi", "2024-05-06 07:08:09 hi"), ("INFO 01-02 03:04:05 x", "2024-01-02 03:04:05 INFO x"), ("2023-01-01 00:00:00 y", "2023-01-01 00:00:00 y"), ("  ", "  ")):
        assert one(spark, line, text.log_line("x", now)) == want
    assert one(spark, '{"a":{"b":1,"c":{"d":2}},"e":3}', telemetry.flattened(F.col("x"))) == {"a.b": "1", "a.c.d": "2", "e": "3"}
    for value, want in (("1", 1.0), ("true", 1.0), ("[2,4]", 3.0), ('"x"', None), ("[true,3]", 2.0), ("[]", None)):
        assert one(spark, value, telemetry.scalar(F.col("x"))) == want
    for n, base, want in ((0, 10, 10), (9, 10, 10), (10, 10, 30), (49, 10, 30), (50, 10, 60), (0, 15, 15), (10, 15, 30), (0, 1, 5)):
        assert spark.range(1).select(telemetry.sampling_interval(F.lit(n), float(base))).first()[0] == want


def test_near_copies_and_ratio(spark):
    assert retrieval.near_copy("", []) and retrieval.near_copy("x" * 60, ["y" + "x" * 60]) and not retrieval.near_copy("ab", ["cd", ""])
    pair = ("abcd" * 40, "abce" * 40)
    got = spark.createDataFrame([pair], "a string, b string").select(retrieval.matching_ratio("a", "b")).first()[0]
    assert got == SequenceMatcher(None, *pair).ratio()


def test_markdown_chunks(spark):
    body = "# Title\nintro line.\n## 目录\n1 a\n## 1 Part\n" + "\n".join(f"sentence {i} of a longer part." for i in range(60)) + "\n【2.1】设备 维护\nx\n3.5 mm 12 14 16 18\n"
    rows = chunking.chunk_documents(spark.createDataFrame([("d/My doc.md", body), ("e", None)], "doc_path string, text string")).sort("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(len(rows))) and rows[0]["doc_title"] == "Title" and rows[0]["section_path"] == ["Title"]
    assert all(len(r["text"]) <= 2600 for r in rows)
    assert rows[-1]["heading"] == "【2.1】设备 维护" and "3.5 mm" in rows[-1]["text"]
    assert [r["level"] for r in chunking.catalog(spark.createDataFrame(rows)).sort("level").collect()][0] == 0
    cut = spark.createDataFrame([("x" * 6000,), ("  ",), (None,)], "t string").select(chunking.windows(F.col("t"), 2600).alias("w")).collect()
    assert [len(p["part"]) for p in cut[0]["w"]] == [2600, 2600, 1040] and not cut[1]["w"]


def test_samples_splits_and_configs(spark):
    rewards = spark.createDataFrame([(i + 1, r) for i, r in enumerate([0.1, 0.9, 0.2, 0.8])], "idx int, reward double")
    assert [r["idx"] for r in records.two_ended_sample(rewards, 2).collect()] == [1, 2]
    assert [r["idx"] for r in records.two_ended_sample(rewards, 1).collect()] == [1]
    assert records.two_ended_sample(rewards, 9).count() == 4
    assert configs.merged({"a": 1, "b": {"x": 1, "y": 2}}, {"b": {"y": 3, "z": 4}, "c": 5}) == {"a": 1, "b": {"x": 1, "y": 3, "z": 4}, "c": 5}
    assert configs.merged({"b": {"x": 1}}, {"b": {"_override_": True, "y": 2}}) == {"b": {"y": 2}}
    assert configs.flat({"a": [1, {"b": None}]}) == [("a[0]", "1"), ("a[1].b", "null")]
    table = configs.table_of(spark, {"l": {"x": 1, "only_a": 5}, "r": {"x": 2, "only_b": 9}})
    found = configs.difference(table.where("name = 'l'"), table.where("name = 'r'")).collect()
    assert {(r["key"], r["kind"]) for r in found} == {("x", "changed"), ("only_a", "only_a"), ("only_b", "only_b")}
    checks = configs.table_of(spark, {"e": {"n": 0, "w": 6, "a": 2, "b": 2, "skip": "${n}"}})
    assert {(r["key"], r["issue"]) for r in configs.issues(checks, ["n", "skip"], [("w", "a", "b")]).collect()} == {("n", "not a positive integer"), ("w", "not a times b")}
    places = configs.epochs(rewards, 10).sort("position").collect()
    assert [r["position"] for r in places] == list(range(10)) and {r["idx"] for r in places[:4]} == {1, 2, 3, 4}
    with pytest.raises(Exception, match="has no query"):
        records.require(spark.createDataFrame([(None,)], "query string"), ["query"]).collect()


def test_no_episodes_give_no_summary(spark):
    schema = "episode_id int, reward double, boxed boolean, valid_search boolean, search_nonempty boolean, extra_action_text boolean, format_error boolean"
    assert records.episode_summary(spark.createDataFrame([], schema)).count() == 0


def test_halves_of_amounts_go_to_the_even_digit(spark):
    sizes = [(1280, "1.2 KB"), (1792, "1.8 KB"), (50593792, "48.2 MB"), (1342177280, "1.2 GB"), (1023, "1023 B")]
    rows = spark.createDataFrame(sizes, "n long, want string").select("want", text.human_bytes(F.col("n")).alias("got"))
    assert all(r.want == r.got for r in rows.collect())
    elapsed = spark.createDataFrame([(0.25, "0.2s"), (0.75, "0.8s"), (3.2, "3.2s")], "s double, want string").select("want", text.format_elapsed(F.col("s")).alias("got"))
    assert all(r.want == r.got for r in elapsed.collect())


def test_white_space_is_that_of_unicode(spark):
    rows = spark.createDataFrame([(chr(i),) for i in range(0x3100) if not 0xD800 <= i < 0xE000], "c string")
    assert rows.where(F.col("c").rlike(f"^{text.SPACE}\\z") != F.col("c").rlike(r"(?U)^\s\z")).count() == 0
    cleaned = spark.createDataFrame([("<a> 　 * b", "a b"), ("a By - Pass b", "a bypass b"), ("x BOXED y", ""), ("baby pass", "baby pass")], "q string, want string")
    assert all(r.got == r.want for r in cleaned.select("want", text.clean_query("q", stable=True).alias("got")).collect())
