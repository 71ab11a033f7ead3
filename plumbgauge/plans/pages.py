"""A sorted table with a directory of its files, so that any page of it opens only the files the page lies in."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgauge.plans.ranking import number_few
from plumbgauge.session import staging_path

ROWS_PER_FILE = 1_000_000


@dataclass
class PageDirectory:
    """Files of a sorted table in order, and the place of each one's last row."""

    empty: DataFrame
    order: list[Column]
    files: list[str]
    ends: list[int]

    @classmethod
    def build(cls, df: DataFrame, order: list[Column], rows_per_file: int = ROWS_PER_FILE) -> PageDirectory:
        """Sort and write once; the directory has a row per file. End ``order`` with a unique key."""
        path = staging_path(df.sparkSession, "pages")
        df.orderBy(*order).write.option("maxRecordsPerFile", rows_per_file).parquet(path)
        stored = df.sparkSession.read.schema(df.schema).parquet(path)
        # names of files follow the ranges they hold
        sizes = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()
        return cls(stored.limit(0), order, [r["file"] for r in sizes], list(accumulate(r["n"] for r in sizes)))

    def page(self, page: int, size: int) -> DataFrame:
        """One page (counted from 1) with positions; empty beyond the end."""
        skip = (page - 1) * size
        first = bisect_right(self.ends, skip)
        last = bisect_right(self.ends, skip + size - 1)
        files = self.files[first:last + 1]
        if not files:
            return self.empty.withColumn("rank", F.lit(None).cast("bigint"))
        before = self.ends[first - 1] if first else 0
        rows = self.empty.sparkSession.read.schema(self.empty.schema).parquet(*files).orderBy(*self.order).offset(skip - before).limit(size)
        return number_few(rows, self.order).withColumn("rank", F.col("rank") + skip)
