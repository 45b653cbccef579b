"""Records of continuous integration taken as tables: addresses, failed jobs, issues, and what checkers leave beside tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pipeline_address(url: Column) -> list[Column]:
    """host, project (as a path, and encoded for a request) and pipeline of a pipeline's web address; null for other ones."""
    path = F.parse_url(url, F.lit("PATH"))
    project = F.nullif(F.regexp_extract(path, r"^/(.+?)/-/pipelines/[0-9]+", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(path, r"/-/pipelines/([0-9]{1,18})(?:/|$)", 1), F.lit("")).cast("bigint")
    return [F.parse_url(url, F.lit("HOST")).alias("host"), project.alias("project"), F.url_encode(project).alias("encoded"), number.alias("pipeline")]


def failed_jobs(jobs: DataFrame, key: list[str], name: str = "name", status: str = "status", number: str = "id") -> DataFrame:
    """The jobs of a key that failed in their last run: of runs of one name, that with the greatest number counts."""
    return jobs.groupBy(*key, name).agg(F.max_by(status, number).alias(status), F.max(number).alias(number)).where(F.col(status) == "failed")


def issues_like(issues: DataFrame, state: str | None = None, labels: tuple[str, ...] = (), search: str | None = None) -> DataFrame:
    """Issues (state, labels, title, body) in a state, with all the labels, and with a text in title or body, ignoring case."""
    out = issues
    if state:
        out = out.where(F.col("state") == state)
    for label in labels:
        out = out.where(F.array_contains("labels", label))
    if search:
        text = F.lower(F.concat_ws("\n", "title", "body"))
        out = out.where(F.contains(text, F.lit(search.lower())))
    return out


def checked_tests(files: DataFrame, tests: DataFrame, key: list[str], order: str) -> DataFrame:
    """Files (key, nth, file) that a checker left with the test (key, order, test) of the same number, counted from 1 in order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return files.join(tests.select(*key, "test", nth.alias("nth")), [*key, "nth"], "left")
