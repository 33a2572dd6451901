"""Exam and answer files into a question bank: parsed by file, paired by name, bound by type and number.

Parsing walks a file's lines once (a function of one file); pairing, binding and the check that a bare list of answers has
as many as there are questions are joins.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions.text import CHINESE_DIGITS, text_of
from quillspark.operators.retrieval import best_pairs, matching_ratio

# Section words and the types that they stand for.
KINDS = {"单选": "single", "多选": "multiple", "判断": "bool", "填空": "fill", "简答": "short", "选择": "single"}
SECTION = re.compile("(单选题?|多选题?|判断题?|填空题?|简答题?|选择题)")
NUMBERED = re.compile(r"^\s*(\d+)\s*[.、．]\s*(.+?)\s*$")
SEVERAL = re.compile(r"\s+(?=\d+\s*[.、．]\s*[一-鿿A-Za-z])")
HEADLINE = re.compile(r"每[题空]|题型|[一二三][、.．]")
OPTION = re.compile(r"([A-Z])\s*[.．、]\s*(.*?)(?=\s+[A-Z]\s*[.．、]\s*|$)")
INLINE = re.compile(r"[（(]\s*([A-Z](?:\s*[,，、/;；]?\s*[A-Z]){0,7}|[√×VXx对错正确错误])\s*[）)]")
PAIR = re.compile(r"(\d+)\s*[:：.、]\s*([A-Z](?:\s+[A-Z]){0,8}|[A-Z]{1,8}|[√×VXx对错正确错误]+)(?=\s*(?:\d+\s*[:：.、]|[;；,，/]|$|\*|\)|）))")
HOLDER = re.compile(r"[\s。.\-—_…·,，、;；:：!?！？()（）【】\[\]]+")
NUMBERS = "".join(CHINESE_DIGITS)
GROUP = re.compile(rf"(?:^|\s)(?:(\d+)|([{NUMBERS}]+))\s*[、.．]\s*(.*?)(?=(?:\s+(?:\d+|[{NUMBERS}]+)\s*[、.．])|$)", re.DOTALL)


def tidy(x: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", x or "").split())


def kind_of(x: str) -> str | None:
    found = SECTION.search(x)
    return KINDS[found[1][:2]] if found else None


def matching_form(x: str) -> str:
    return re.sub(r"[\W_]+", "", re.sub(r"【\d+】|\[\d+\]|\(\s*\)|（\s*）|_", "", tidy(x).casefold()))


def bare(x: str) -> str:
    """Without bold marks, OCR blocks and comments."""
    return re.sub(r"<!--.*?-->", " ", re.sub(r"\*\[Image OCR\].*?\[End OCR\]\*", " ", x.replace("**", " "), flags=re.DOTALL), flags=re.DOTALL)


def core(x: str) -> str:
    """A question without options, answer marks and number."""
    stem = re.split(r"\s+[A-Z]\s*[.．、]\s*", tidy(x), maxsplit=1)[0]
    return re.sub(r"^\d+\s*[.、．]\s*", "", INLINE.sub("（ ）", stem)).strip()


def options_of(x: str, kind: str) -> list[tuple[str, str]]:
    found = [(letter, tidy(INLINE.sub("", said)).strip(" ;；,，")) for letter, said in OPTION.findall(tidy(x))]
    return [o for o in found if o[1]] or ([("A", "对"), ("B", "错")] if kind == "bool" else [])


def answer_form(x: str, kind: str) -> str:
    x = re.sub("[，、 ]", ",", tidy(x).strip("* "))
    low, letters = x.casefold(), re.findall("[A-Z]", x.upper())
    if kind == "bool" and re.search("√|v|对|正确", low):
        return "A"
    if kind == "bool" and re.search("×|x|错|错误", low):
        return "B"
    if kind in ("single", "bool"):
        return letters[0] if letters else x
    return ",".join(letters) if kind == "multiple" and letters else x


def visible(answer: str, options: list[tuple[str, str]], kind: str) -> str:
    if kind not in ("single", "multiple", "bool"):
        return tidy(answer)
    told = dict(options)
    return "；".join(told[c] for c in re.findall("[A-Z]", tidy(answer).upper()) if c in told) or tidy(answer)


def is_question(x: str) -> bool:
    return bool(x) and kind_of(x) is None and not HOLDER.fullmatch(x) and len(matching_form(x)) >= 2 and bool(re.search("[一-鿿A-Za-z0-9]", x))


def numbered_blocks(text: str, inline: bool) -> Iterator[tuple[str | None, str | None]]:
    """(kind, block) of each numbered block with the section it is in; (kind, None) where a section starts."""
    kind, held = None, None
    for line in (part for raw in bare(text).splitlines() for part in SEVERAL.sub("\n", tidy(raw)).splitlines()):
        line = line.strip()
        if not line:
            continue
        section, number = kind_of(line), NUMBERED.match(line)
        title = bool(number) and not inline and re.sub(r"[\W_]+", "", number[2]) in {k + "题" for k in KINDS}
        if section and (not number or title or HEADLINE.search(line)):
            if held:
                yield kind, " ".join(held)
            kind, held = section, None
            yield kind, None
        elif number:
            if held:
                yield kind, " ".join(held)
            held = [number[2]]
        elif held:
            held.append(line)
    if held:
        yield kind, " ".join(held)


ITEMS = "path string, qtype string, ordinal int, position int, question string, score_key string, options array<struct<letter:string,text:string>>, answer string"


def items_of(path: str, text: str, inline: bool) -> Iterator[tuple]:
    """Questions of a file; inline ones bring their answer in brackets and, outside sections, a type that it tells."""
    counts, order = Counter(), []
    for kind, block in numbered_blocks(text, inline):
        if block is None:
            order += [kind] * (kind not in order)
            continue
        answer = ""
        if inline:
            found = INLINE.search(block)
            if not found:
                continue
            if kind in (None, "fill"):
                kind = "bool" if re.search("[√×VXx对错正确错误]", tidy(found[1])) else "multiple" if len(re.findall("[A-Z]", tidy(found[1]).upper())) > 1 else "single"
            answer = answer_form(found[1], kind)
        question = core(block)
        if kind and is_question(question) and (answer or not inline):
            counts[kind] += 1
            yield path, kind, counts[kind], order.index(kind) + 1 if kind in order else 0, question, matching_form(block), [{"letter": a, "text": b} for a, b in options_of(block, kind)], answer


SECTIONS = "path string, qtype string, place int, rank int, body string"


def sections_of(path: str, text: str) -> Iterator[tuple]:
    """Bodies of answers: under section words (place 0), and under numbers, whose place tells the section."""
    clean = bare(text)
    tail = clean[max(clean.rfind("参考答案"), clean.rfind("答案"), 0) :]
    marks = list(SECTION.finditer(tail))
    bodies: dict[str, list[str]] = {}
    for i, mark in enumerate(marks):
        bodies.setdefault(KINDS[mark[1][:2]], []).append(tail[mark.end() : marks[i + 1].start() if i + 1 < len(marks) else len(tail)])
    for kind, parts in bodies.items():
        yield path, kind, 0, 0, "\n".join(parts)
    for i, (digits, chinese, body) in enumerate(GROUP.findall(unicodedata.normalize("NFKC", tail)), 1):
        place = int(digits) if digits else number_of(chinese)
        if place:
            yield path, kind_of(body) if chinese else None, place, i, body


def number_of(label: str) -> int | None:
    d = CHINESE_DIGITS
    if len(label) == 1:
        return d.get(label)
    if len(label) == 2 and label[0] == "十":
        return 10 + d[label[1]]
    if len(label) == 2 and label[1] == "十":
        return 10 * d[label[0]]
    return 10 * d[label[0]] + d[label[2]] if len(label) == 3 and label[1] == "十" else None


def answers_of(body: str, kind: str) -> tuple[str, dict[int, str]]:
    """(explicit or compact, answers by number) of a body; a compact list counts from one."""
    explicit = {int(n): answer_form(a, kind) for n, a in PAIR.findall(body)}
    if explicit:
        return "explicit", explicit
    if kind in ("fill", "short"):
        lines = (re.sub(r"^\d+\s*[.、．]\s*", "", re.sub(r"^(?:答案|参考答案)\s*[:：]?\s*", "", tidy(x))).strip(" *;；:：") for x in unicodedata.normalize("NFKC", body).splitlines())
        found = [x for x in lines if x and kind_of(x) is None]
    else:
        said = re.findall("[A-Z]{1,8}" if kind == "multiple" else "[A-Z]+|[√×VXx对错]", re.sub("^(?:答案|参考答案)\\s*[:：]?", "", tidy(body)))
        split = lambda t: len(t) > 1 and (kind == "single" or (kind == "bool" and re.fullmatch("[ABVX]+", t.upper())))
        found = [answer_form(c, kind) for t in said for c in (t if split(t) else [t])]
    return "compact", dict(enumerate(found, 1))


def _by_file(files: DataFrame, schema: str, of) -> DataFrame:
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", schema)]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for path, text in frame.itertuples(index=False) for r in of(path, text or "")], columns=names)

    return files.select("path", "text").mapInPandas(rows, schema)


@F.pandas_udf(StringType())
def pairing_key(path: pd.Series) -> pd.Series:
    """A file's name without exam and answer words and marks."""
    stem = path.str.replace(r"^.*/", "", regex=True).str.replace(r"\.[^.]*$", "", regex=True)
    stem = stem.str.replace("(?i)参考答案|答案版|答案|试题版|试题|试卷|考核试卷|考试", "", regex=True)
    return stem.str.replace(r"[-_ .（）()【】\[\]&]+", "", regex=True).map(lambda s: s.casefold())


def pair_files(files: DataFrame) -> DataFrame:
    """(question_path, answer_path): for each answer file the best question file, of its own folder first.

    An equal name wins; else the best must be 0.72 or more and ahead by 0.08. Files that hold both, and question files
    without an answer file, pair with themselves.
    """
    named = files.select("path", pairing_key("path").alias("key"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("path").rlike("试题|试卷|考核|考试").alias("asks"), F.contains("path", F.lit("答案")).alias("tells"))
    answers = named.where("tells").select(F.col("path").alias("a"), F.col("key").alias("ka"), F.col("folder").alias("fa"), "asks")
    asking = named.where("asks and not tells").select(F.col("path").alias("b"), F.col("key").alias("kb"), F.col("folder").alias("fb"))

    def best(pairs: DataFrame) -> DataFrame:
        scored = pairs.withColumn("score", F.when(F.col("ka") == F.col("kb"), 1.0).otherwise(matching_ratio("ka", "kb")))
        exact = Window.partitionBy("a").orderBy(F.col("score").desc(), "b")
        top = scored.withColumn("_r", F.row_number().over(exact)).where((F.col("_r") == 1) & (F.col("ka") == F.col("kb"))).select("a", "b")
        return top.unionByName(best_pairs(scored.join(top.select("a"), "a", "left_anti").select("a", "b", "score")).select("a", "b"))

    near = best(answers.join(asking, F.col("fa") == F.col("fb")))
    # names share a beginning or are compared with the files that do
    start = lambda k: F.substring(k, 1, 2)
    far = best(answers.join(near.select("a"), "a", "left_anti").join(asking, start(F.col("ka")) == start(F.col("kb"))))
    found = near.unionByName(far)
    own = answers.join(found.select("a"), "a", "left_anti").where("asks or contains(a, '答案版')").select(F.col("a"), F.col("a").alias("b"))
    alone = asking.join(found.select("b"), "b", "left_anti").select(F.col("b").alias("a"), "b")
    return found.unionByName(own).unionByName(alone).select(F.col("b").alias("question_path"), F.col("a").alias("answer_path")).distinct()


def question_bank(files: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Questions with answers for files (path, text): qtype, ordinal, question, answer, answer_detail, options, score_key, paths.

    Answers by number under a section win over those under a numbered heading unless these are explicit or not fewer; a
    bare list counts only if it has as many answers as the section has questions. What has none takes the answer in
    brackets of the same type and number; what still has none is left out.
    """
    pairs = pair_files(files) if pairs is None else pairs
    asked = _by_file(files, ITEMS, lambda p, t: items_of(p, t, False))
    inline = _by_file(files, ITEMS, lambda p, t: items_of(p, t, True))
    bodies = _by_file(files, SECTIONS, sections_of)
    counts = asked.groupBy("path", "qtype").agg(F.count("*").alias("asked"), F.max("position").alias("position"))

    @F.pandas_udf("struct<source:string,answers:map<int,string>>")
    def read(body: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([answers_of(b, k) for b, k in zip(body, kind)], columns=["source", "answers"])

    under = pairs.join(bodies.withColumnRenamed("path", "answer_path").withColumnRenamed("qtype", "named"), "answer_path")
    under = under.join(counts.withColumnRenamed("path", "question_path"), "question_path")
    under = under.where(F.when(F.col("named").isNotNull(), F.col("named") == F.col("qtype")).otherwise(F.col("place") == F.col("position")))
    told = under.withColumn("r", read("body", "qtype")).select("question_path", "answer_path", "qtype", "asked", "rank", "r.source", "r.answers")
    told = told.where((F.col("source") == "explicit") | (F.size("answers") == F.col("asked"))).where(F.size("answers") > 0)
    better = Window.partitionBy("question_path", "answer_path", "qtype").orderBy((F.col("source") == "explicit").desc(), F.size("answers").desc(), F.col("rank").desc())
    told = told.withColumn("_r", F.row_number().over(better)).where("_r = 1").select("question_path", "answer_path", "qtype", F.explode("answers").alias("ordinal", "told"))

    base = pairs.join(asked.drop("answer").withColumnRenamed("path", "question_path"), "question_path").join(told, ["question_path", "answer_path", "qtype", "ordinal"], "left")
    beside = inline.select(F.col("path").alias("answer_path"), "qtype", "ordinal", F.col("answer").alias("beside"), F.col("options").alias("more"))
    base = base.join(beside, ["answer_path", "qtype", "ordinal"], "left").withColumn("answer", F.coalesce(F.nullif("told", F.lit("")), "beside")).where("answer is not null and answer <> ''")
    whole = base.withColumn("options", F.when((F.size("options") == 0) & F.col("more").isNotNull(), F.col("more")).otherwise(F.col("options")))
    only = pairs.join(asked.select(F.col("path").alias("question_path")).distinct(), "question_path", "left_anti").join(inline.withColumnRenamed("path", "answer_path"), "answer_path").withColumn("question_path", F.col("answer_path"))
    columns = ["qtype", "ordinal", "question", "answer", "options", "score_key", "question_path", "answer_path"]
    bank = whole.select(columns).unionByName(only.select(columns))

    letters = F.regexp_extract_all(F.upper("answer"), F.lit("[A-Z]"), 0)
    seen = F.transform(letters, lambda c: F.get(F.filter("options", lambda o: o.letter == c), F.lit(0)).text)
    detail = F.array_join(F.filter(seen, lambda x: x.isNotNull()), "；")
    return bank.withColumn("answer_detail", F.when(F.col("qtype").isin("single", "multiple", "bool") & (detail != ""), detail).otherwise(text_of("answer")))
