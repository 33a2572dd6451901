"""Chunks searched where they lie: tokens, candidates and what a profile seeks against the definitions; what leaves a task."""

from pyspark.sql import functions as F

from quillspark.functions.profile import Finder, Passage, Sought, profile_of, terms_form
from quillspark.functions.text import nfkc
from quillspark.functions.tokens import Counted, feature_tokens, latin_tokens, ngrams
from quillspark.operators import catalogs, passages, retrieval, search

TEXTS = ["Valves, by\npass and BY - PASS bypassed 1.5 v2.0", "真空泵 OFD格式 年 假，有效期", "İstanbul éby pass Straße ２０ x", "", None, "the ñandú ciónga ab,ab ab"]


def test_tokens_are_those_of_the_columns(spark):
    rows = spark.createDataFrame([(f"a/{i}.x.md", i, "Head 年假", t) for i, t in enumerate(TEXTS)], "doc_path string, chunk_id int, heading string, text string")
    for r in search.with_tokens(rows).collect():
        counted = Counted(sorted(set(r["tokens"])))
        met, n = counted.chunk(r["text"] or "", r["heading"], passages.stem_of(r["doc_path"]))
        names = list(counted.number)
        assert n == max(len(r["tokens"]), 1) and {names[i]: k for i, k in met.items()} == {t: r["tokens"].count(t) for t in r["tokens"]}, r
    plain = rows.withColumn("n", nfkc("text"))
    for r in plain.select("n", F.concat(latin_tokens(F.lower("n")), ngrams("n")).alias("f")).collect():
        assert catalogs.features(r["n"]) == set(r["f"])


def test_a_query_looks_for_what_all_look_for():
    asked = ["带薪年假 有效期 OFD发票", "vacuum pump VP-200 EMO valve", "How many arms are there in a process module", "私自 by pass 安全设施 处罚", "ciónga ñandú a b", ""]
    told = ["two Valves of the vacuum pump vp-200s, press EMO/now", "bypass 安全设施 会 处罚", "电子发票 的 源文件 年假", "Each process module has 2 arms.", "xciónga ñandú ab", ""]
    profiles = [profile_of(q) for q in asked]
    finder = Finder([(e["mode"], e["text"], e["id"]) for p in profiles for e in p["entries"]])
    for p in profiles:
        own, sought = {e["id"] for e in p["entries"]}, Sought(p)
        for text in told:
            passage = Passage(terms_form(f"{text} Vacuum pump s"), text, "Vacuum pump", "s")
            assert len(sought.found(passage)) == len(own & set(finder.ids(passage))), (p["raw"], text)


def test_drawn_terms_are_the_rare_ones(spark):
    df = {"a": 5, "b": 1300, "c": 2, "d": 9000, "e": 5}
    asked = spark.createDataFrame([(1, t) for t in [*df, "none"]] + [(2, "d")], "query_id int, term string")
    known = retrieval.rare_terms(asked, spark.createDataFrame(list(df.items()), "term string, df long"), F.lit(20000))
    want = [(r["query_id"], r["term"]) for r in retrieval.capped(known, 1200).sort("query_id", "place").collect()]
    got = [(q, t) for q, own in ((1, [*df, "none"]), (2, ["d"])) for t in passages.drawn(dict.fromkeys(own), df, 20000, 1200)]
    assert got == want == [(1, "c"), (1, "a"), (1, "e"), (1, "b"), (2, "d")]


def test_near_copies_are_no_single_task(spark):
    # all queries were one task's, since their bytes are few: 26 s of one core for 200 queries on sf0.1
    hits = spark.createDataFrame([(q, f"{q} " + chr(97 + i) * 9, i + 1) for q in range(40) for i in range(3)], "query_id long, text_key string, rank int")
    kept = retrieval.distinct_hits(hits, 3, 0.86)
    assert kept.count() == 120
    tasks: list[int] = []
    inner = retrieval.cut
    retrieval.cut = lambda df: (tasks.append(df.withColumn("_p", F.spark_partition_id()).select("_p").distinct().count()) if df.columns == ["query_id", "text_key", "rank"] and "FlatMapCoGroups" in df._jdf.queryExecution().toString() else None) or inner(df)
    try:
        retrieval.distinct_hits(hits, 3, 0.86)
    finally:
        retrieval.cut = inner
    assert tasks and max(tasks) > 3
