"""URL filter: rules by host and path, and gradient-boosted trees on lexical features where no rule fits.

Native: only DataFrame functions and Spark's own tree learner, no Python on executors.

Labelled URLs are those that a rule judges: its verdict is the label. The trees learn from a bounded sample of
them (about SAMPLE_ROWS distinct URLs, by hash) and judge the URLs that no rule fits. Features: lengths, depth,
digit share, entropy of the characters, parameter counts, and suffix statistics (how often the host's last
label and last two labels occur, over all rows; joined by a shuffle above SAMPLE_ROWS values).

Defined cases: a null URL, or one without ://, has an empty host and path, fits no rule and is judged by
the trees; with labels of one kind only, every such verdict is that kind (allow without labels); of rules that
fit, the longest wins (no two are equal); repeated rows get equal answers; a URL of any length is read whole;
only the id and the URL are read, so no other column can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import cut_lineage, share_of_rows

#: The rules of the query's contract.
RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
SAMPLE_ROWS = 10_000
TREES, DEPTH = 20, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters whose shares make up the entropy.
COUNTED = LOWER + "0123456789-._/%"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):  # a longer one replaces a shorter one
        its_host, _, its_path = rule.partition("/")
        fits = ((host == its_host) | host.endswith(f".{its_host}")) & path.startswith(f"/{its_path}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    name, verdict = longest_rule(F.col("host"), F.col("path"))
    return rows.withColumns({"rule": name, "rule_verdict": verdict})


def lexical(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with feature columns from url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    low, n = F.lower(url), F.greatest(F.length(url), F.lit(1)).cast("double")
    occurs = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c)))).cast("double")
    shares = [occurs(low, c) / n for c in COUNTED]
    entropy = reduce(lambda a, b: a + b, [F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares])
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    columns = {
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": occurs(path, "/"),
        "f_labels": occurs(host, "."),
        "f_hyphens": occurs(host, "-"),
        "f_label_length": F.array_max(F.transform(F.split(host, r"\."), F.length)).cast("double"),
        "f_digits": F.length(F.regexp_replace(url, r"[^0-9]", "")) / n,
        "f_entropy": entropy,
        "f_parameters": occurs(query, "="),
        "f_query_length": F.length(query).cast("double"),
        "f_fragment": url.contains("#").cast("double"),
    }
    return df.withColumns(columns), list(columns)


def suffixes(df: DataFrame) -> DataFrame:
    return df.withColumns({"suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2)})


def suffix_counts(rows: DataFrame) -> dict[str, DataFrame]:
    """For suffix1 and suffix2: each value and the logarithm of its count over all rows; broadcast only if it has few values."""
    two = cut_lineage(suffixes(rows).groupBy("suffix2").agg(F.count("*").alias("n")))
    one = cut_lineage(two.groupBy(F.substring_index("suffix2", ".", -1).alias("suffix1")).agg(F.sum("n").alias("n")))
    found = {c: (df.select(c, F.log1p(F.col("n").cast("double")).alias(f"f_{c}")), df.count()) for c, df in (("suffix1", one), ("suffix2", two))}
    return {c: F.broadcast(df) if n <= SAMPLE_ROWS else df for c, (df, n) in found.items()}


def verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages."""
    rows = judged(pages, id_col, url_col)
    labelled = rows.drop("page_id").where("rule is not null").dropDuplicates(["url"])  # distinct before the sample, which repeats would fill
    labelled = cut_lineage(suffixes(labelled).withColumn("blocked", (F.col("rule_verdict") == "block").cast("double")))
    sample = cut_lineage(labelled.where(share_of_rows(F.col("url"), labelled.count(), SAMPLE_ROWS)).coalesce(1))
    kinds = [r[0] for r in sample.select("blocked").distinct().collect()]
    if len(kinds) < 2:
        only = F.lit("block" if kinds == [1.0] else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", only).alias("verdict"))
    stats = suffix_counts(rows)

    def featured(df: DataFrame) -> DataFrame:
        df, names = lexical(suffixes(df))
        for c, table in stats.items():
            df = df.join(table, c, "left")
        df = df.fillna(0.0, [f"f_{c}" for c in stats])
        return VectorAssembler(inputCols=[*names, *(f"f_{c}" for c in stats)], outputCol="features").transform(df)

    learned = cut_lineage(featured(sample).select("features", "blocked").coalesce(1))
    model = GBTClassifier(featuresCol="features", labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(learned)
    said = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    # the trees judge what no rule does
    known = rows.where("rule is not null").select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"))
    open_ = model.transform(featured(rows.where("rule is null"))).select("page_id", "host", "path", "rule", said.alias("verdict"))
    return known.union(open_)
