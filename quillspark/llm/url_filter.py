"""URL filters: rules by host and path, and gradient-boosted trees for what no rule fits. DataFrame functions only.

A rule is a verdict for a host with all its subdomains and a beginning of the path; the longest that fits wins. URLs that
a rule fits are the labelled ones. For the others the verdict is that of gradient-boosted trees on lexical features:
lengths of URL, host and path, depth, share of digits, entropy of the characters, number of parameters and of hyphens,
and statistics of the host's suffix: the smoothed share of blocked URLs among the labelled ones of its last label and of
its last two.

The trees are fitted on at most SAMPLE labelled URLs, chosen by a hash of the URL, so the same for every order and
partitioning; the suffix statistics are counted over all labelled URLs, and for a URL that is fitted on without its own
label. Repeated URLs and page_ids each count. If the labelled URLs all have one verdict it
is that of all others too; without any it is allow. Null URLs and URLs without "://" have an empty host and path, no rule, and
the verdict of their features.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: At most so many labelled URLs are fitted on.
SAMPLE = 4_000
TREES, DEPTH = 8, 4
#: Weight of the overall share of blocked URLs in a suffix's own, in URLs.
SMOOTH = 20.0
FEATURES = ["length", "host_length", "path_length", "depth", "digits", "entropy", "parameters", "hyphens", "last_label", "last_two"]
FIT = r"^(?s).*?://([^/?#]*)([^?#]*).*$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased; path: from there up to ? or #."""
    return F.translate(F.regexp_extract(url, FIT, 1), UPPER, LOWER), F.regexp_extract(url, FIT, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    out = F.lit(None)
    # the last to be tested first: longer rules wrap shorter ones
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out.cast("struct<rule:string,verdict:string>")


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of url, host and path, and the suffixes tail1 and tail2."""
    url = F.coalesce("url", F.lit(""))
    n = F.char_length(url)
    bare = F.regexp_replace(url, "[^0-9]", "")
    letters = F.split(url, "")
    # each character adds -log2 of its share, over its count
    shares = F.transform(F.array_distinct(letters), lambda c: (n - F.char_length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "length": n.cast("double"),
            "host_length": F.char_length("host").cast("double"),
            "path_length": F.char_length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digits": F.when(n > 0, F.char_length(bare) / n).otherwise(0.0),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
            "hyphens": (n - F.char_length(F.replace(url, F.lit("-"), F.lit("")))).cast("double"),
            "tail1": F.substring_index("host", ".", -1),
            "tail2": F.substring_index("host", ".", -2),
        }
    )


def with_suffixes(urls: DataFrame, statistics: list[tuple[str, str, DataFrame]], overall: float, own: Column | None = None) -> DataFrame:
    """Adds last_label and last_two: shares of blocked URLs among the labelled ones of a suffix, drawn towards overall.

    own: the row's own label, which is then taken out of the share.
    """
    for tail, name, seen in statistics:
        blocked, n = F.coalesce("_blocked", F.lit(0.0)), F.coalesce("_n", F.lit(0))
        if own is not None:
            blocked, n = blocked - own, n - 1
        urls = urls.join(seen, tail, "left").withColumn(name, (blocked + SMOOTH * overall) / (n + SMOOTH)).drop("_blocked", "_n")
    return urls


def suffix_statistics(labelled: DataFrame) -> list[tuple[str, str, DataFrame]]:
    """(tail, feature, table): the labelled URLs of each suffix and how many of them are blocked, as written tables."""
    out = []
    for tail, name in (("tail1", "last_label"), ("tail2", "last_two")):
        out.append((tail, name, written(labelled.groupBy(tail).agg(F.sum("label").alias("_blocked"), F.count("*").alias("_n")), name)))
    return out


def train(labelled: DataFrame, statistics: list[tuple[str, str, DataFrame]], overall: float, sample: int = SAMPLE) -> GBTClassificationModel:
    """Trees for labelled (lexical features and label)."""
    chosen = with_suffixes(labelled.orderBy(F.xxhash64("url"), "url").limit(sample), statistics, overall, F.col("label"))
    # a written table of fixed size: the rounds of the fit read it, not the labelled URLs
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(written(chosen.select(*FEATURES, "label").coalesce(1), "sample"))
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False).fit(vectors)


def as_column(model: GBTClassificationModel) -> Column:
    """The trees' margin as one expression: above zero means blocked."""

    def branch(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.col(FEATURES[split.featureIndex()]) <= float(split.threshold()), branch(node.leftChild())).otherwise(branch(node.rightChild()))

    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights):
        total = total + branch(tree._java_obj.rootNode()) * weight
    return total


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and margin (null where a rule fits) for every row of pages."""
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    urls = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    urls = lexical(urls.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)))
    labelled = urls.where("_rule is not null").withColumn("label", (F.col("_rule.verdict") == "block").cast("double"))
    # the features of labelled URLs are made once
    labelled = written(labelled.select("url", "tail1", "tail2", *(f for f in FEATURES if f not in ("last_label", "last_two")), "label"), "labelled")
    counts = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")).first()
    if not 0 < counts["blocked"] < counts["n"]:
        usual = "block" if counts["n"] and counts["blocked"] else "allow"
        urls = urls.withColumn("margin", F.lit(None).cast("double"))
        return _result(urls, F.lit(usual))
    overall, statistics = counts["blocked"] / counts["n"], suffix_statistics(labelled)
    model = train(labelled, statistics, overall, sample)
    free = F.col("_rule").isNull()
    urls = with_suffixes(urls, statistics, overall).withColumn("margin", F.when(free, as_column(model)))
    return _result(urls, F.when(F.col("margin") > 0, "block").otherwise("allow"))


def _result(urls: DataFrame, otherwise: Column) -> DataFrame:
    return urls.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), otherwise).alias("verdict"), "margin")
