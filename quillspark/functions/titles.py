"""Document titles: without leading numbers, told whether they say anything, and as keys to group by. Column expressions.

Titles must be normal (text.normalize_text).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import fold_stable

NOTHING = r"(?i)^(?:(?:page|slide)?\s*\d+|doc|docs|document|manual|index|content|contents|内部文档片段|description)$"
NUMBER = r"^\s*(?:[【\[]\s*\d+(?:\.\d+){0,5}\s*[】\]]\s*|\d+(?:\.\d+){1,5}(?:-\d+)?(?:\s+|[-_、．)]\s*))"


def form(title: Column) -> Column:
    return F.regexp_replace(fold_stable(title), r"(?U)[\W_]+", "")


def is_generic(title: Column) -> Column:
    short = (F.char_length(title) <= 2) & ~title.rlike("[\\u4e00-\\u9fffA-Za-z]")
    return (title == "") | title.rlike(NOTHING) | short


def without_number(title: Column) -> Column:
    for _ in range(3):
        cut = F.regexp_replace(title, NUMBER, "")
        title = F.when(cut != title, F.btrim(cut, F.lit(" -_、．)）"))).otherwise(title)
    return title


def canonical(title: Column) -> Column:
    """The title without its number, if what is left says something."""
    cut = without_number(title)
    return F.when((cut != "") & ~is_generic(cut) & (F.char_length(form(cut)) >= 4), cut).otherwise(title)


def group_key(path: Column, title: Column) -> Column:
    """title:... for titles that say something, else path:..."""
    name = canonical(title)
    return F.when(~is_generic(name) & (F.char_length(form(name)) >= 4), F.concat(F.lit("title:"), form(name))).otherwise(F.concat(F.lit("path:"), path))


def same(a: Column, b: Column) -> Column:
    return (form(canonical(a)) != "") & (form(canonical(a)) == form(canonical(b)))


def preferred(titles: Column) -> Column:
    """Of an ordered array of titles the one to show: the first that says something, in its shorter form if a later one is
    the same but for a number."""
    return F.aggregate(
        titles,
        F.lit(""),
        lambda now, new: F.when(new == "", now)
        .when(is_generic(now), new)
        .when(~same(now, new), now)
        .when((canonical(now) != now) & (canonical(new) == new), new)
        .when((canonical(new) != new) & (canonical(now) == now), now)
        .when(F.char_length(canonical(new)) < F.char_length(canonical(now)), canonical(new))
        .otherwise(now),
    )


def path_label(title: Column, section_path: Column) -> Column:
    """Title and section path joined by >, the title once."""
    parts = F.filter(section_path, lambda p: p != "")
    first = F.get(parts, F.lit(0))
    with_title = F.when((title != "") & ~F.coalesce(same(first, title), F.lit(False)), F.concat(F.array(title), parts)).otherwise(parts)
    return F.array_join(with_title, " > ")
