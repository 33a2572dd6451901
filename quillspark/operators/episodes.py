"""Multi-turn episodes of a tool-using assistant, all of them a turn at a time.

The state is a table with a row for each episode. A turn joins it with the assistants' outputs, parses the actions, grades
answers, sends all searches and all reads through retrieval as one batch each, shapes rewards and gives the next state and
the turn's rows. What retrieval is, is a pair of functions of DataFrames, so an index stays a table and is joined, not
carried. Between turns the state is cut from its lineage by a checkpoint.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from quillspark.functions import actions, grading
from quillspark.functions.profile import LATIN, QUANTITY, count_evidence, is_generic, matching_form, ngrams, profile_of
from quillspark.functions.text import text_of
from quillspark.operators import retrieval
from quillspark.operators.tables import cut, few

HIT = "array<struct<id:int,doc_path:string,chunk_id:int,label:string>>"
STATE = [("num_turns", "int", 0), ("answer_mode", "boolean", False), ("search_attempts", "int", 0), ("read_attempts", "int", 0), ("tokens_used", "int", 0), ("evidence_quality", "string", "none")]
FULL = 0.999
# What the environment says.
TIMED_OUT = "\n已达到最大轮数，本题未完成作答。\n"
READ_ENOUGH = "\n已经读过足够多的上下文。请根据已有资料输出 boxed 作答动作。\n"


@dataclass(frozen=True)
class Limits:
    max_turns: int = 6
    max_searches: int = 3
    max_reads: int = 2
    queries: int = 3
    phase: str = "curriculum"
    total_tokens: int = 560


#: requests (sample_id, queries array<string>, budget int) to (sample_id, content string, tokens int, hits HIT)
Search = Callable[[DataFrame], DataFrame]
#: requests (sample_id, hits HIT, budget int, query string: the question and the last searches) to (sample_id, content string, tokens int)
Read = Callable[[DataFrame], DataFrame]


def begin(records: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The state before the first turn, for records (sample_id, query, expected_answer and, if there is one, split)."""
    split = F.col("split") if "split" in records.columns else F.lit("train")
    start = records.select("sample_id", text_of("query").alias("query"), text_of("expected_answer").alias("expected_answer"), F.coalesce(split, F.lit("train")).alias("split"), F.lit(limits.max_turns).alias("max_turns"))
    none = F.array().cast("array<string>")
    return start.withColumns({c: F.lit(v).cast(kind) for c, kind, v in STATE} | {"search_history": none, "last_hits": F.array().cast(HIT)})


def signal_terms(x: str) -> set[str]:
    wider = [t for told, more in WIDER if any(w in x.casefold() for w in told) for t in more]
    return {t for t in (*(w.casefold() for w in LATIN.findall(x) if len(w) >= 2), *ngrams(x), *wider) if not is_generic(t)}


def quality(query: str, content: str) -> str:
    """strong, weak or none: how far retrieved text covers a question and, if it has options, one of them."""
    if not (content or "").strip():
        return "none"
    question, _, rest = (query or "").removeprefix("题目：").partition("选项")
    question = "\n".join(line for line in question.splitlines() if not line[:2].rstrip(".．、 ") in {"A", "B", "C", "D", "E", "F"})
    options = [signal_terms(line[2:]) for line in (query or "").splitlines() if line[:1].isalpha() and line[1:2] in ".．、"]
    form = matching_form(question)
    if len(form) >= 8 and form in matching_form(content):
        return "strong"
    told = signal_terms(content)
    met, specific = signal_terms(question) & told, sum(bool((o - signal_terms(question)) & told) for o in options)
    answered = "题目：" in content and "答案：" in content
    if QUANTITY.search(question) and not answered and count_evidence(profile_of(question), content) < 5:
        return "weak" if met else "none"
    if (len(met) >= 2 and (not options or specific)) or (met and specific >= 2):
        return "strong"
    return "weak" if met or specific else "none"


@F.pandas_udf(StringType())
def evidence_quality(query: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([quality(q, c) for q, c in zip(query, content)], dtype=object)


def _key(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"(?U)[\W_]+", ""))


def turn(state: DataFrame, outputs: DataFrame, search: Search, read: Read, limits: Limits = Limits()) -> DataFrame:
    """Each episode's row after a turn: its next state, reward, terminated, answer, observation and the turn's flags.

    outputs: sample_id, output; an episode without an output has said nothing, which is no action.
    """
    now = state.join(outputs.select("sample_id", "output"), "sample_id", "left").withColumn("output", text_of("output"))
    now = actions.with_action(now, "output", "a").withColumns({"num_turns": F.col("num_turns") + 1, "grade": grading.grade("expected_answer", "output")})
    asked = F.filter("a.search_queries", lambda q: ~F.array_contains(F.transform("search_history", _key), _key(q)))
    left = F.lit(limits.total_tokens) - F.col("tokens_used")
    wanted = F.transform("a.read_ids", lambda i: F.get(F.filter("last_hits", lambda h: h.id == i), F.lit(0)))
    now = now.withColumns({"fresh": F.when(left > 0, asked).otherwise(F.array().cast("array<string>")), "wanted": F.filter(wanted, lambda h: h.isNotNull()), "left": F.greatest(left, F.lit(0))})
    now = now.withColumn("searching", (F.col("a.action") == "search") & ~F.col("answer_mode")).withColumn("reading", (F.col("a.action") == "read") & (F.col("read_attempts") < limits.max_reads))
    now = cut(now)

    searching = now.where("searching and size(fresh) > 0").select("sample_id", F.col("fresh").alias("queries"), F.col("left").alias("budget"))
    # reads are told the question and the latest searches
    latest = F.slice("search_history", F.greatest(F.size("search_history") - 2, F.lit(1)), 3)
    reading = now.where("reading and size(wanted) > 0").select("sample_id", F.col("wanted").alias("hits"), F.col("left").alias("budget"), F.concat_ws(" ", "query", latest).alias("query"))
    # retrieval is many jobs; a turn without requests has none
    empty = now.sparkSession.createDataFrame([], f"sample_id {dict(now.dtypes)['sample_id']}, content string, tokens int, hits {HIT}")
    found = (empty if searching.isEmpty() else search(searching)).select("sample_id", F.col("content").alias("_c1"), F.col("tokens").alias("_t1"), "hits")
    seen = (empty if reading.isEmpty() else read(reading)).select("sample_id", F.col("content").alias("_c2"), F.col("tokens").alias("_t2"))
    now = now.join(found, "sample_id", "left").join(seen, "sample_id", "left")
    now = now.withColumns({"content": F.coalesce("_c1", "_c2", F.lit("")), "_tokens": F.coalesce("_t1", "_t2", F.lit(0)), "hits": F.coalesce("hits", F.array().cast(HIT))})
    now = cut(now.withColumn("seen_quality", evidence_quality("query", "content")))

    kind, got, split = F.col("a.action"), F.col("content") != "", F.col("split")
    repeated = F.size("a.search_queries") - F.size(asked)
    stats = {
        "valid_search": kind == "search",
        "search_nonempty": F.col("searching") & got,
        "repeated_queries": F.when(F.col("searching") & (F.col("left") > 0), repeated).otherwise(0),
        "empty_queries": F.when(F.col("searching") & ~got, F.size("fresh")).otherwise(0),
        "answer_mode_search": (kind == "search") & F.col("answer_mode"),
        "extra_action_text": F.col("a.has_extra_text"),
        "valid_read": kind == "read",
        "read_nonempty": F.col("reading") & got,
        "missing_reads": F.when(kind == "read", F.when(F.col("reading"), F.size("a.read_ids") - F.size("wanted")).otherwise(F.size("a.read_ids"))).otherwise(0),
        "boxed": kind == "answer",
        "final_correct": (kind == "answer") & (F.col("grade") >= FULL),
        "format_error": kind == "invalid",
    }
    now = now.withColumns(stats)
    # an answer and the two early returns come before the limit on turns
    early = (kind == "answer") | F.col("answer_mode_search") | ((kind == "read") & ~F.col("reading"))
    now = now.withColumn("timeout", ~early & (F.col("num_turns") >= F.col("max_turns")))
    s = F.struct(*stats)
    shaped = F.when(kind == "search", actions.search_reward(s, F.col("num_turns"), split, F.lit(limits.phase))).when(kind == "read", actions.read_reward(s, split)).otherwise(actions.error_reward(F.col("a.error"), split))
    searches, reads = F.col("search_attempts") + F.col("searching").cast("int"), F.col("read_attempts") + F.col("reading").cast("int")
    strong = F.col("seen_quality") == "strong"
    may_read = (F.col("seen_quality") == "weak") & (F.size("hits") > 0) & (F.col("read_attempts") < limits.max_reads)
    mode = F.when(F.col("searching"), strong | ((searches >= limits.max_searches) & ~may_read)).when(F.col("reading"), got & (strong | (reads >= limits.max_reads))).otherwise(F.col("answer_mode"))
    said = F.when(kind == "answer", "").when(F.col("timeout"), TIMED_OUT).when((kind == "read") & ~F.col("reading"), READ_ENOUGH).when(kind == "invalid", F.concat(F.lit("\n"), F.col("a.error"), F.lit("\n"))).otherwise(F.col("content"))
    return now.select(
        "sample_id", "query", "expected_answer", "split", "max_turns", "num_turns",
        mode.alias("answer_mode"), searches.alias("search_attempts"), reads.alias("read_attempts"), (F.col("tokens_used") + F.col("_tokens")).alias("tokens_used"),
        F.when(F.col("searching") | F.col("reading"), F.col("seen_quality")).otherwise(F.col("evidence_quality")).alias("evidence_quality"),
        F.when(F.col("searching"), F.concat("search_history", "fresh")).otherwise(F.col("search_history")).alias("search_history"),
        F.when(F.col("searching"), F.col("hits")).otherwise(F.col("last_hits")).alias("last_hits"),
        F.when(kind == "answer", F.col("grade")).when(F.col("timeout"), actions.timeout_reward(split)).otherwise(shaped).alias("reward"),
        ((kind == "answer") | F.col("timeout")).alias("terminated"), F.when(kind == "answer", F.coalesce(grading.boxed("output"), F.element_at(F.concat("a.boxed_answers", F.array(F.lit(""))), 1))).alias("answer"),
        said.alias("observation"), F.when(F.col("timeout"), "timeout").otherwise(kind).alias("action"), F.col("a.error").alias("error"), "timeout", *stats,
    )


def replay(records: DataFrame, scripts: DataFrame, search: Search, read: Read, limits: Limits = Limits()) -> DataFrame:
    """The rows of all turns (with column turn, from 0) when each episode says its script: scripts (sample_id, turn, output).

    An episode ends when it terminates or its script does.
    """
    state, rows, n = begin(records, limits), None, 0
    state_columns = state.columns
    while n < limits.max_turns + 1:
        outputs = scripts.where(F.col("turn") == n).select("sample_id", "output")
        active = state.join(outputs.select("sample_id"), "sample_id", "left_semi")
        if active.isEmpty():
            break
        done = cut(turn(active, outputs, search, read, limits).withColumn("turn", F.lit(n)))
        rows = done if rows is None else rows.unionByName(done)
        state, n = done.where("not terminated").select(*state_columns), n + 1
    if rows is None:
        rows = turn(state.limit(0), scripts.select("sample_id", "output"), search, read, limits).withColumn("turn", F.lit(0))
    return rows


def gold_scripts(records: DataFrame, with_search: bool = True) -> DataFrame:
    """(sample_id, turn, output): a search for the question's key words, if wanted, and the right answer boxed."""
    plain = F.regexp_replace(F.regexp_replace(text_of("query"), r"(?s)选项[:：].*$|\n[A-Z][.．、].*", ""), r"^\s*题目[:：]\s*|\n+", " ")
    looked = F.concat(F.lit("需要查题干中的关键术语。<search>"), F.right(F.trim(plain), F.lit(48)), F.lit("</search>"))
    boxed = F.concat(F.lit("\\boxed{"), grading.parse_expected("expected_answer")["gold_answer"], F.lit("}"))
    return records.select("sample_id", F.posexplode(F.array(looked, boxed) if with_search else F.array(boxed)).alias("turn", "output"))


# Fixed values: (words of a text, words that it is widened by).
WIDER = [(["着火", "起火", "火灾", "火警"], ["着火", "起火", "火灾", "火警", "消防", "灭火", "应急", "应急处置"]), (["emo", "紧急停止", "急停"], ["emo", "紧急停止", "急停"])]


@F.pandas_udf(BooleanType())
def is_lookup(query: pd.Series) -> pd.Series:
    """Whether a query says enough to be looked up in a question bank: two terms, and ten characters or two strong terms."""

    def enough(q: str) -> bool:
        told = signal_terms(q or "")
        strong = [t for t in told if len(t) >= 3 or re.fullmatch(r"[a-z]{2,}\d*", t)]
        return len(told) >= 2 and (len(matching_form(q)) >= 10 or len(strong) >= 2)

    return pd.Series([enough(q) for q in query], dtype=bool)


def bank_hits(queries: DataFrame, bank: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, label): items of a bank (item_id, question, answer) for the queries (query_id, query) that say enough."""
    from quillspark.functions.text import compact, nfkc
    from quillspark.functions.tokens import feature_tokens

    def keyed(rows: DataFrame, key: str, said: str) -> DataFrame:
        return rows.select(key, nfkc(said).alias("_n"), compact(said).alias("key")).select(key, F.array_distinct(feature_tokens(F.col("_n"))).alias("tokens"), "key")

    worth = queries.where(is_lookup("query"))
    label = F.concat(F.lit("题目："), text_of("question"), F.lit("\n答案："), text_of("answer"))
    found = retrieval.bank_matches(keyed(worth, "query_id", "query"), keyed(bank, "item_id", "question"), k)
    return found.join(bank.select("item_id", label.alias("label")), "item_id").select("query_id", "rank", "label")


def over_index(indexed: DataFrame, chunks: DataFrame, top_k: int = 4, radius: int = 1, bank: DataFrame | None = None, sections: DataFrame | None = None) -> tuple[Search, Read]:
    """Retrieval over an index of chunks: searches give numbered labels, reads what read_relevant takes around a hit.

    With a bank (item_id, question, answer) its items come first, and only where a request has none of them the rest is
    searched: with sections (as chunking.catalog makes them) the catalog, whose hits are read by their sections' relevance,
    else the chunks. A hit of the bank has no doc_path; reading it gives its label.
    """
    from quillspark.operators import search as engine

    def searched(requests: DataFrame) -> DataFrame:
        each = cut(requests.select("sample_id", "budget", F.posexplode("queries").alias("_n", "query")).withColumn("query_id", F.xxhash64("sample_id", "_n")))
        asked, item, rest = each.select("query_id", "sample_id", "_n", "budget"), None, each
        if bank is not None:
            known = cut(bank_hits(each.select("query_id", "query"), bank).join(asked, "query_id"))
            item = known.select("sample_id", "budget", "_n", "rank", F.lit(None).cast("string").alias("doc_path"), F.lit(None).cast("int").alias("chunk_id"), "label", F.lit("").alias("text"))
            rest = each.join(known.select("sample_id").distinct(), "sample_id", "left_anti")
        if sections is not None:
            path = F.coalesce("section_path", F.array().cast("array<string>"))
            listed = sections.select("doc_path", path.alias("_path"), "doc_title", F.substring("search_text", 1, 160).alias("text"), "chunk_id").where("chunk_id is not null")
            # sections and chunks stay where they lie
            hits = listed.join(few(engine.search_catalog(rest.select("query_id", "query"), sections, top_k).withColumn("_path", path)), ["doc_path", "_path"])
            texts = hits.withColumn("heading", F.array_join(F.array_distinct(F.concat(F.array(F.coalesce("doc_title", F.lit(""))), "_path")), " > "))
        else:
            hits = engine.search(rest.select("query_id", "query"), indexed, top_k)
            texts = chunks.select("doc_path", "chunk_id", "heading", "text").join(few(hits), ["doc_path", "chunk_id"])
        rows = texts.join(asked, "query_id").select("sample_id", "budget", "_n", "rank", "doc_path", F.col("chunk_id").cast("int").alias("chunk_id"), F.col("heading").alias("label"), "text")
        # one row for what several queries of a request found
        rows = rows.groupBy("sample_id", "doc_path", "chunk_id", "label").agg(F.max("budget").alias("budget"), F.min(F.struct("_n", "rank")).alias("_by"), F.first("text").alias("text")).select("sample_id", "budget", "_by._n", "_by.rank", "doc_path", "chunk_id", "label", "text")
        rows = rows if item is None else item.dropDuplicates(["sample_id", "label"]).unionByName(rows)
        per = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("_n", "rank", "doc_path", "chunk_id", "label", "text"))).alias("items"), F.max("budget").alias("budget"))
        hits_ = F.transform("items", lambda x, i: F.struct((i + 1).alias("id"), x.doc_path.alias("doc_path"), x.chunk_id.alias("chunk_id"), x.label.alias("label")))
        content = F.array_join(F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x.label, F.lit("\n"), x.text)), "\n\n")
        return _budgeted(per.select("sample_id", content.alias("content"), "budget", hits_.alias("hits")))

    def looked_up(requests: DataFrame) -> DataFrame:
        told = F.coalesce("query", F.lit("")) if "query" in requests.columns else F.lit("")
        wanted = requests.select("sample_id", "budget", told.alias("_said"), F.posexplode("hits").alias("rank", "h")).select("sample_id", "budget", "_said", "rank", "h.doc_path", "h.chunk_id", "h.label")
        known = wanted.where("doc_path is null").select("sample_id", "rank", F.lit(1).alias("ord"), F.lit("").alias("heading"), F.col("label").alias("text"))
        lying = wanted.where("doc_path is not null").select(F.col("sample_id").alias("query_id"), "rank", "doc_path", "chunk_id", F.concat_ws(" ", "_said", "label").alias("query"))
        around = engine.read_relevant(lying, chunks, radius, prefer_relevant=sections is not None).withColumnRenamed("query_id", "sample_id")
        rows = around.select("sample_id", "rank", "ord", "heading", "text").unionByName(known)
        per = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ord", "heading", "text"))).alias("items")).join(requests.select("sample_id", "budget"), "sample_id")
        shown = F.transform("items", lambda x: F.when(x.heading == "", x.text).otherwise(F.concat(x.heading, F.lit("\n"), x.text)))
        return _budgeted(per.select("sample_id", F.array_join(shown, "\n\n").alias("content"), "budget"))

    def _budgeted(rows: DataFrame) -> DataFrame:
        @F.pandas_udf("struct<content:string,tokens:int>")
        def fitted(content: pd.Series, budget: pd.Series) -> pd.DataFrame:
            out = [engine.cut_to(c, int(b)) for c, b in zip(content, budget)]
            return pd.DataFrame({"content": out, "tokens": [engine.tokens_of(c) for c in out]})

        return rows.withColumn("_f", fitted("content", "budget")).select("sample_id", "_f.content", "_f.tokens", *(["hits"] if "hits" in rows.columns else []))

    return searched, looked_up
