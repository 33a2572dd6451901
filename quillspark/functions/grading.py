"""Rule grading of typed answers as Column expressions.

expected is "[type] gold"; the answer is the last balanced \\boxed{...} of the completion. Types: single and bool (equal
letter sets), multiple (partial credit, exact or F1), fill (blanks by place), short (coverage of key points). Without a box
the grade is NO_BOX; without a type the normalised texts must be equal; an unknown type gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import grading_form, text_of
from quillspark.functions.tokens import letters

NO_BOX = -0.5
WRONG_WEIGHT = 0.5
# Groups of words that count as equal, in the order in which they are tried.
SYNONYMS = [
    ["对", "正确", "是", "yes", "true", "√"],
    ["错", "错误", "否", "no", "false", "×"],
    ["拒收", "reject", "退货"],
    ["特采", "waive", "让步接收"],
    ["放行", "release", "合格放行"],
    ["晶圆", "wafer", "硅片"],
    ["光刻胶", "光阻", "photoresist", "resist"],
    ["退火", "anneal", "annealing"],
    ["掺杂", "doping", "dopant"],
    ["离子注入", "ion implantation", "implant"],
]


def boxed(x: Column | str) -> Column:
    """The content of the last balanced \\boxed{...}, inner ones included; null if there is none.

    Cuts the text at every opening; the last piece whose braces close gives the answer, read on to its closing brace.
    """
    t = text_of(x)
    # depth of braces over the text after an opening, until it falls below zero
    pieces = F.split(t, r"\\boxed\s*\{")
    n = F.size(pieces)
    # what follows the i-th opening, with the openings that were cut out put back
    tails = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(pieces, i + 1, F.greatest(n - i, F.lit(0))), "\\boxed{"))
    contents = F.transform(tails, _to_close)
    found = F.filter(contents, lambda c: c.isNotNull())
    return F.when((n > 1) & (F.size(found) > 0), F.element_at(found, -1))


def _to_close(tail: Column) -> Column:
    """The text up to the brace that closes what was opened before it; null if none does."""
    steps = F.split(tail, r"(?<=[{}])")
    state = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))
    end = F.aggregate(
        steps,
        state,
        lambda a, s: F.when(a.depth <= 0, a).otherwise(F.struct((a.depth + F.when(F.endswith(s, F.lit("{")), 1).when(F.endswith(s, F.lit("}")), -1).otherwise(0)).alias("depth"), (a.taken + F.char_length(s)).alias("taken"))),
    )
    return F.when(end.depth == 0, F.substring(tail, F.lit(1), end.taken - 1))


def question_type(expected: Column | str) -> Column:
    return F.regexp_extract(text_of(expected), r"^\s*\[(\w+)\]", 1)


def gold(expected: Column | str) -> Column:
    return F.btrim(F.regexp_extract(text_of(expected), r"(?s)^\s*\[\w+\]\s*(.*)$", 1), F.lit(" \t\r\n"))


def parse_expected(expected: Column | str) -> Column:
    """struct<answer_type, gold_answer>: the type lower-cased, of one line only; else type unknown and the text itself."""
    t = text_of(expected)
    one_line = r"^\s*\[([A-Za-z]+)\]\s*(.*?)\s*$"
    fits = t.rlike(one_line)
    return F.struct(F.when(fits, F.lower(F.regexp_extract(t, one_line, 1))).otherwise("unknown").alias("answer_type"), F.when(fits, F.regexp_extract(t, one_line, 2)).otherwise(F.trim(t)).alias("gold_answer"))


def grade_multiple(said: Column, right: Column, mode: str = "partial_penalty", wrong_weight: float = WRONG_WEIGHT) -> Column:
    """Grade of a set of letters against the right one."""
    hit = F.size(F.array_intersect(said, right))
    if mode == "exact":
        return F.when(F.array_sort(said) == F.array_sort(right), 1.0).otherwise(0.0)
    if mode == "f1":
        both_empty = (F.size(said) == 0) & (F.size(right) == 0)
        precision, recall = hit / F.size(said), hit / F.size(right)
        return F.when(both_empty, 1.0).when(hit == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    wrong = F.size(F.array_except(said, right))
    return F.when(F.size(right) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (hit - wrong_weight * wrong) / F.size(right)))


def _expanded(forms: Column, synonyms: list[list[str]]) -> Column:
    """forms with all words of each group that they meet, group after group; a group may meet what an earlier one added."""
    groups = F.array(*(F.transform(F.array(*map(F.lit, group)), grading_form) for group in synonyms))
    return F.aggregate(groups, forms, lambda known, group: F.when(F.arrays_overlap(known, group), F.array_union(known, group)).otherwise(known)) if synonyms else forms


def alternatives(blank: Column, synonyms: list[list[str]] | None = None) -> Column:
    """Forms that fill a blank: the whole, its parts at slashes, and the synonyms of these."""
    parts = F.concat(F.array(grading_form(blank)), F.transform(F.split(blank, "[/／]"), grading_form))
    return _expanded(F.array_distinct(F.filter(parts, lambda p: p != "")), SYNONYMS if synonyms is None else synonyms)


def grade_fill(answer: Column, right: Column, synonyms: list[list[str]] | None = None) -> Column:
    """The share of blanks that the answer's parts, blank ones dropped, fill at their place."""
    blanks = F.split(right, r"\|\|\|")
    said = F.filter(F.split(answer, "[;；\n]"), lambda p: F.trim(p) != "")
    hits = F.filter(blanks, lambda b, i: (i < F.size(said)) & F.array_contains(alternatives(b, synonyms), grading_form(F.get(said, i))))
    return F.size(hits) / F.size(blanks)


def grade_short(answer: Column, completion: Column, right: Column, synonyms: list[list[str]] | None = None) -> Column:
    """The share of key points that the answer or the completion has."""
    points = F.filter(F.split(right, r"\|\|\|"), lambda k: grading_form(k) != "")
    where = F.concat(grading_form(answer), F.lit("|"), grading_form(completion))
    hits = F.filter(points, lambda k: F.exists(alternatives(k, synonyms), lambda a: F.contains(where, a)))
    return F.when(F.size(points) == 0, 0.0).otherwise(F.size(hits) / F.size(points))


def grade(expected: Column | str, completion: Column | str, mode: str = "partial_penalty", wrong_weight: float = WRONG_WEIGHT, synonyms: list[list[str]] | None = None) -> Column:
    """The grade of a completion, 0 to 1 or NO_BOX."""
    expected, completion = text_of(expected), text_of(completion)
    answer, kind, right = boxed(completion), question_type(expected), gold(expected)
    same = F.array_sort(letters(answer)) == F.array_sort(letters(right))
    return (
        F.when(answer.isNull(), NO_BOX)
        .when(kind == "", (grading_form(answer) == grading_form(expected)).cast("double"))
        .when(kind.isin("single", "bool"), same.cast("double"))
        .when(kind == "multiple", grade_multiple(letters(answer), letters(right), mode, wrong_weight))
        .when(kind == "fill", grade_fill(answer, right, synonyms))
        .when(kind == "short", grade_short(answer, completion, right, synonyms))
        .otherwise(0.0)
    )


# --- Answers of question banks ---

TRUE_WORDS = ["对", "正确", "true", "t", "yes", "y", "√", "是"]
FALSE_WORDS = ["错", "错误", "false", "f", "no", "n", "×", "否", "不对"]


def sheet_choice(x: Column | str, single: Column | bool) -> Column:
    """Letters A-L of a worksheet's answer, each once; of a single choice the first; null if there is none."""
    from quillspark.functions.text import clean_cell

    found = F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.upper(clean_cell(x)), "[ ,，]", ""), F.lit("[A-L]"), 0))
    one = single if isinstance(single, Column) else F.lit(single)
    return F.when(F.size(found) == 0, None).when(one, F.element_at(F.when(F.size(found) > 0, found), 1)).otherwise(F.array_join(found, ""))


def sheet_judgement(x: Column | str) -> Column:
    """对, 错 or null."""
    from quillspark.functions.text import clean_cell

    t = F.lower(clean_cell(x))
    return F.when(t.isin([*TRUE_WORDS, "a"]), "对").when(t.isin([*FALSE_WORDS, "b"]), "错")


def knowledge_points(x: Column | str, most: int = 5) -> Column:
    from quillspark.functions.text import clean_cell

    parts = F.filter(F.transform(F.split(text_of(x), "[|｜]"), clean_cell), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, most), "|")


def bank_choice(x: Column | str, kind: Column) -> Column:
    """An exam file's answer: judgements as A or B, a single letter, or letters joined by commas."""
    t = F.regexp_replace(F.btrim(text_of(x), F.lit("* ")), "[，、 ]", ",")
    low, found = F.lower(t), F.regexp_extract_all(F.upper(t), F.lit("[A-Z]"), 0)
    first = F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(t)
    return (
        F.when((kind == "bool") & low.rlike("√|v|对|正确"), "A")
        .when((kind == "bool") & low.rlike("×|x|错|错误"), "B")
        .when(kind.isin("single", "bool"), first)
        .when((kind == "multiple") & (F.size(found) > 0), F.array_join(found, ","))
        .otherwise(t)
    )
