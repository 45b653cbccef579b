"""Rules over metrics, and matching of failures with known issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..shared import store

#: Scope, metric, least value that is too much (exclusive), message.
THRESHOLDS = (
    ("gnb", "crc_fails", 100.0, "many CRC failures"),
    ("gnb", "reestablishments", 0.0, "reestablishments"),
    ("gnb", "msg3_nok", 0.0, "Msg3 failures"),
    ("gnb", "late_harqs", 0.0, "late HARQs"),
    ("gnb", "failed_pdcch", 0.0, "failed PDCCH allocations"),
    ("gnb", "error_indications", 0.0, "error indications"),
    ("ue", "crc_fails", 10.0, "many CRC failures"),
    ("ue", "loss_percent", 1.0, "packets lost"),
    ("capture", "failures", 0.0, "unsuccessful procedures"),
)


def fired(metrics: DataFrame, key: list[str], rules: DataFrame) -> DataFrame:
    """Rules (metric, threshold, message) that a row of metrics exceeds; missing metrics fire none."""
    names = [n for n in metrics.columns if n not in key]
    long = metrics.select(*key, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(key, names, "metric", "value")
    return long.join(rules, "metric").where("value > threshold").select(*key, "metric", "value", "threshold", "message")


def phrases(texts: DataFrame, failure: str, text: str, least: int = 12) -> DataFrame:
    """failure and its distinct phrases: what stands between full stops and line ends, in lower case, from so many characters on."""
    parts = F.transform(F.split(F.lower(text), r"[.!?\n]+"), lambda x: F.trim(x))
    long = F.filter(F.array_distinct(parts), lambda x: F.length(x) >= least)
    return texts.select(F.col(failure).alias("failure"), F.explode(long).alias("phrase"))


LENGTHS = (8, 3, 1)  # of the runs of characters by which issues are looked up


def _grams(text: Column, n: Column) -> Column:
    """The distinct runs of n characters of a text; the text is cut into characters once."""
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), ""))
    every = fn.let(F.filter(F.split(text, ""), lambda x: x != ""), lambda c: F.when(F.size(c) >= n, runs(c)))
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def match_issues(failures: DataFrame, issues: DataFrame, top: int = 3) -> DataFrame:
    """Best issues (issue, title, body) for failures (failure, phrase): a phrase in the title is tier 1, in the body tier 2.

    Case is ignored, and phrases may begin and end within words.  A failure's ties go to the
    later issue, the one of greater number.  Issues are known by their runs of LENGTHS
    characters, which are listed once.  Phrases whose first run no issue has are left out at
    once; each other one is matched once, however many failures have it: it meets the issues
    that have the rarest of four of its runs, and is then looked for in them.  What is best for
    a failure is among the best of each of its phrases.
    """
    phrase = F.col("phrase")
    texts = issues.select("issue", F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.lower(F.coalesce("body", F.lit(""))).alias("body"))
    both = F.concat_ws("\n", "title", "body")
    index = store(texts.select("issue", F.explode(F.flatten(F.array(*(_grams(both, F.lit(n)) for n in LENGTHS)))).alias("token")), "runs")
    often = store(index.groupBy("token").agg(F.count("*").alias("n")), "run_counts")
    length = F.coalesce(*(F.when(F.length(phrase) >= n, n) for n in LENGTHS))
    lower = failures.select("failure", F.lower("phrase").alias("phrase")).where("phrase <> ''").withColumn("token", F.substr(phrase, F.lit(1), length))
    held = store(lower.join(often.select("token"), "token", "left_semi").select("failure", "phrase").distinct(), "phrases")
    last = F.length(phrase) - length
    runs = F.array_distinct(F.array(*(F.substr(phrase, F.floor(last * k / 3).cast("int") + 1, length) for k in range(4))))
    tokens = held.select("phrase").distinct().select("phrase", F.size(runs).alias("all"), F.explode(runs).alias("token"))
    rarest = tokens.join(often, "token").groupBy("phrase", "all").agg(F.count("*").alias("known"), F.min(F.struct("n", "token")).alias("least")).where("known = all")
    near = rarest.select("phrase", F.col("least.token").alias("token")).join(index, "token").join(texts, "issue")
    tier = F.when(F.contains("title", "phrase"), 1).when(F.contains("body", "phrase"), 2)

    def best(found: DataFrame, by: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(by).orderBy("tier", F.desc("issue")))
        return found.withColumn("nth", nth).where(F.col("nth") <= top)

    by_phrase = best(near.select("phrase", "issue", tier.alias("tier")).where("tier is not null"), "phrase").drop("nth")
    return best(held.join(by_phrase, "phrase").groupBy("failure", "issue").agg(F.min("tier").alias("tier")), "failure")


def group_by_issue(matched: DataFrame) -> DataFrame:
    """Failures of each issue that is their best match, joined."""
    best = matched.where("nth = 1")
    return best.groupBy("issue").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("failure").cast("string"))), ",").alias("failures"))
