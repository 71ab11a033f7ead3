"""Saved tables, versions, catalogue listings and report jobs, all as Parquet."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbgauge.operators.schema import metadata_summary, schema_summary
from plumbgauge.plans.ranking import global_rank
from plumbgauge.plans.stats import col
from plumbgauge.sources.commits import CommitLog
from plumbgauge.sources.readers import load_table
from plumbgauge.sources.sql import run_sql


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def table_name(path: str) -> str:
    """Table name of a file: its stem in lower case with underscores."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0].lower().replace(" ", "_")


def save_table(df: DataFrame, root: str, name: str) -> DataFrame:
    """Save or replace a table and make it visible to SQL.

    The rows become a new version, which is current only once it is written. So a table can be replaced
    by a result read from it, and a failed run leaves the old rows in place and the next one free to save.
    """
    store = Versions(df.sparkSession, root)
    saved = store.read(name, store.create(name, df, "Saved"))
    saved.createOrReplaceTempView(name)
    return saved


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def table_exists(spark: SparkSession, name: str) -> bool:
    return name.lower() in {t.lower() for t in list_tables(spark)}


class Versions:
    """Numbered snapshots of tables under one folder, and a log of what was created and made current.

    Data are written to a folder of their own; what makes them a version is one entry of the log (:mod:`plumbgauge.sources.commits`). A failed or killed
    write leaves no version and blocks none: its folder is deleted, or later swept. Writers at the same time get different numbers.
    """

    LOG = ("table_name string, seq bigint, kind string, version_num bigint, folder string, description string, "
           "row_count bigint, column_count bigint, created_at timestamp")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/_log", self.LOG)

    def manifest(self) -> DataFrame:
        """All versions of all tables."""
        return self.log.entries().filter("kind = 'version'").select(
            "table_name", "version_num", F.concat(F.lit(f"{self.root}/"), "folder").alias("path"), "description", "row_count", "column_count", "created_at")

    def current(self, name: str) -> int | None:
        """Number of the version in force: the last one created or rolled back to."""
        entry = self.log.current(name)
        return entry["version_num"] if entry else None

    def create(self, name: str, df: DataFrame, description: str) -> int:
        """Write the next version; the description gets the table's dimensions appended."""
        folder = f"{quote(name, safe='')}/data-{uuid.uuid4().hex}"
        path = f"{self.root}/{folder}"
        try:
            df.write.parquet(path)
            rows, width = self.spark.read.parquet(path).count(), len(df.columns)
        except BaseException:
            self.log.files.delete(path)
            raise

        def entry(before: list[Row]) -> dict:
            if not self.log.files.exists(f"{path}/_SUCCESS"):
                raise RuntimeError(f"the rows of {name!r} were swept before they became a version")
            number = max((e["version_num"] for e in before), default=0) + 1
            return {"kind": "version", "version_num": number, "folder": folder, "description": f"{description} [Rows: {rows}, Columns: {width}]",
                    "row_count": rows, "column_count": width, "created_at": _now()}
        return self.log.append(name, entry)["version_num"]

    def sweep(self, name: str, older_than_hours: float = 24.0) -> list[str]:
        """Delete what killed writers of a table left, if unchanged for so long; no write may take longer."""
        parent = f"{self.root}/{quote(name, safe='')}"
        # listed before the log is read: a folder that becomes a version in between is in the log
        old = [child for child, age in self.log.files.children(parent) if age > older_than_hours * 3600]
        known = {e["folder"] for e in self.log.listed(name)}
        left = [f"{parent}/{child}" for child in old if f"{quote(name, safe='')}/{child}" not in known]
        for path in left:
            self.log.files.delete(path)
        return left

    def listing(self, name: str) -> DataFrame:
        """Versions of a table, newest first."""
        return self.manifest().filter(F.col("table_name") == name).orderBy(F.desc("version_num"))

    def read(self, name: str, number: int) -> DataFrame:
        entries = [e for e in self.log.listed(name) if e["kind"] == "version" and e["version_num"] == number]
        if not entries:
            raise ValueError(f"no version {number} of {name!r}")
        return self.spark.read.parquet(f"{self.root}/{entries[0]['folder']}")

    def roll_back(self, name: str, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Make a version current again, for later sessions too; returns it with its schema and metadata summaries."""
        df = self.read(name, number)
        self.log.append(name, lambda before: {"kind": "current", "version_num": number, "created_at": _now()})
        df.createOrReplaceTempView(name)
        return df, schema_summary(df), metadata_summary(df)

    def latest(self, name: str) -> DataFrame:
        """The version in force."""
        number = self.current(name)
        if number is None:
            raise ValueError(f"no version of {name!r}")
        return self.read(name, number)

    def activate(self, name: str, raw_path: str) -> DataFrame:
        """The table if it is still there, else its version in force, else the raw file."""
        if table_exists(self.spark, name):
            return self.spark.table(name)
        known = not self.manifest().filter(F.col("table_name") == name).isEmpty()
        df = self.latest(name) if known else load_table(self.spark, raw_path)
        df.createOrReplaceTempView(name)
        return df

    def duplicate(self, name: str, copy: str) -> int:
        """Copy a table with all its versions under a new name."""
        entries = self.manifest().filter(F.col("table_name") == name).orderBy("version_num").collect()
        for e in entries:
            base = e["description"].rsplit(" [Rows:", 1)[0]
            self.create(copy, self.read(name, e["version_num"]), base)
        return len(entries)


def newest_first(entries: DataFrame, created: str, key: str, only: Column | None = None) -> DataFrame:
    """Catalogue entries, newest first, numbered; optionally those of one owner."""
    rows = entries if only is None else entries.filter(only)
    return global_rank(rows, [col(created).desc(), col(key).asc()])


def refresh_report(spark: SparkSession, name: str, sql: str, out: str,
                   tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a saved query, write its result to a folder of its own and register it in the reports table, so earlier results stay.

    One batch job; whatever starts it on a schedule lives outside.
    """
    path = f"{out.rstrip('/')}/{name}/run-{uuid.uuid4().hex}"
    run_sql(spark, sql, tables).write.parquet(path)
    entry = spark.range(1).select(F.lit(name).alias("report_name"), F.lit(path).alias("path"), F.lit(sql).alias("sql_text"),
                                  F.current_timestamp().alias("created_at"))
    entry.write.mode("append").parquet(f"{out.rstrip('/')}/_reports")
    return spark.read.parquet(path)
