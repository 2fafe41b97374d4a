"""Review comments as a data source; offline, from the JSON Lines files that an export left.

An export is a folder with one folder for each endpoint, `issues` and `pulls`, of files with a
comment a line, and `prs.jsonl` with the pull requests that a search found. Filters on the
endpoint leave files out, those on author and repo lines; `review_comments` has them pushed
down. Without an export there are no rows.
"""

from __future__ import annotations

import glob
import heapq
import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

FIELDS = ("repo", "pr", "endpoint", "url", "created_at", "body", "author")
ENDPOINTS = ("issues", "pulls")

#: Pull requests of a search whose comments are read, the newest ones.
NEWEST = 20


class ReviewComments(DataSource):
    """Options: path (an export's folder, files, or a glob), author (keep this author's comments only), newest (of the search's pull requests), pushdown (true: take filters)."""

    @classmethod
    def name(cls) -> str:
        return "review_comments"

    def schema(self) -> str:
        return "repo string, pr bigint, endpoint string, url string, created_at string, body string, author string"

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(self.options)


def newest_pull_requests(path: str, most: int, author: str | None = None) -> set[tuple[str, int]]:
    """(repo, pr) of the newest pull requests in a search's file, equal times by repo and number; `most` of them are held at a time."""

    def found() -> Iterator[tuple[str, str, int]]:
        with open(path, encoding="utf-8", errors="replace") as lines:
            for line in lines:
                try:
                    row = json.loads(line)
                    if author is None or row.get("author") in (None, author):  # a search may be one author's own
                        yield row.get("created_at") or "", row["repo"], int(row["pr"])
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue

    return {(repo, pr) for _, repo, pr in heapq.nlargest(most, found())}


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.only = options["path"], {}
        self.newest = int(options.get("newest", NEWEST))
        if options.get("author") is not None:
            self.only["author"] = options["author"]

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.path):
            return [InputPartition((p, None, None)) for p in sorted(glob.glob(self.path))] or [InputPartition(None)]
        search = os.path.join(self.path, "prs.jsonl")
        wanted = newest_pull_requests(search, self.newest, self.only.get("author")) if os.path.exists(search) else None
        endpoints = [e for e in ENDPOINTS if self.only.get("endpoint", e) == e]
        files = [(p, e, wanted) for e in endpoints for p in sorted(glob.glob(os.path.join(self.path, e, "*.jsonl")))]
        return [InputPartition(f) for f in files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        path, endpoint, wanted = partition.value
        with open(path, encoding="utf-8", errors="replace") as lines:
            for line in lines:
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if not isinstance(row, dict):
                    continue
                row["endpoint"] = endpoint or row.get("endpoint")
                kept = all(row.get(k) == v for k, v in self.only.items())
                if kept and (wanted is None or (row.get("repo"), row.get("pr")) in wanted) and (wanted is None or (row.get("body") or "").strip()):
                    yield tuple(row.get(f) for f in FIELDS)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("author",), ("repo",), ("endpoint",)) and self.only.get(f.attribute[0], f.value) == f.value:
                self.only[f.attribute[0]] = f.value
            else:
                yield f


def review_comments(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Comments of an export; what is filtered on author, repo and endpoint is not read."""
    spark.dataSource.register(ReviewComments)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("review_comments").options(path=path, pushdown="true", **options).load()
