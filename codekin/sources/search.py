"""Search results as a Spark data source: pages of items in JSON files, as a code host's search API returns them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "full_name string, clone_url string, size int, stars int, pushed_at string, owner string, fork boolean, archived boolean, found_by string, seq long"
PAGE = "query string, items array<struct<full_name: string, clone_url: string, size: int, stargazers_count: int, pushed_at: string, owner: struct<login: string>, fork: boolean, archived: boolean>>"


class SearchSource(DataSource):
    """format("search_pages"): option path is a folder of page files {"query": ..., "items": [...]}; a file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return SearchReader(self.options["path"])


def pages(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from page files on any storage that Spark reads; ``seq`` follows the file names, then the place in the page."""
    files = spark.read.schema(PAGE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    numbered = files.withColumn("file", F.input_file_name())
    number = numbered.select("file").distinct().withColumn("number", F.row_number().over(Window.orderBy("file")) - 1)  # a row per page file
    rows = numbered.join(F.broadcast(number), "file").select("query", "number", F.posexplode("items").alias("i", "it"))
    return rows.select(
        "it.full_name", "it.clone_url", "it.size", F.col("it.stargazers_count").alias("stars"), F.substring(F.coalesce("it.pushed_at", F.lit("")), 1, 10).alias("pushed_at"), F.col("it.owner.login").alias("owner"),
        "it.fork", "it.archived", F.col("query").alias("found_by"), (F.col("number") * 1_000_000 + F.col("i")).cast("long").alias("seq"),
    )


class SearchReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition((i, str(p))) for i, p in enumerate(sorted(Path(self.path).glob("*.json")))] or [InputPartition((0, ""))]

    def read(self, partition):
        number, path = partition.value
        if not path:
            return
        page = json.loads(Path(path).read_text())
        for i, it in enumerate(page.get("items", [])):
            owner = (it.get("owner") or {}).get("login")
            yield (it.get("full_name"), it.get("clone_url"), it.get("size"), it.get("stargazers_count"), (it.get("pushed_at") or "")[:10], owner, it.get("fork"), it.get("archived"), page.get("query"), number * 1_000_000 + i)
