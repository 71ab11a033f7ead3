"""Versions under failing and competing writers, and delimited files cut anywhere."""

import os
import random
import threading
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbgauge.sources import readers, records
from plumbgauge.sources.commits import CommitLog, Files
from plumbgauge.sources.tables import Versions, save_table


# versions

def failing(spark):
    return spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("no"))).cast("long").alias("id"))


def test_a_failed_save_leaves_the_old_rows_and_the_next_save_works(spark, tmp_path):
    save_table(spark.range(3), str(tmp_path), "t")
    for _ in range(2):
        with pytest.raises(Exception):
            save_table(failing(spark), str(tmp_path), "t")
    store = Versions(spark, str(tmp_path))
    assert store.current("t") == 1 and store.latest("t").count() == 3 and store.manifest().count() == 1
    assert save_table(spark.range(7), str(tmp_path), "t").count() == 7
    assert [r["version_num"] for r in store.listing("t").collect()] == [2, 1]
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2  # nothing left of the failed ones


def test_a_first_save_that_fails_blocks_nothing(spark, tmp_path):
    with pytest.raises(Exception):
        save_table(failing(spark), str(tmp_path), "new")
    assert Versions(spark, str(tmp_path)).current("new") is None
    assert save_table(spark.range(2), str(tmp_path), "new").count() == 2


def test_what_a_killed_writer_left_is_swept(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    store.create("t", spark.range(3), "raw")
    orphan = f"{tmp_path}/t/data-killed"
    spark.range(5).write.parquet(orphan)  # written, but its writer died before the log had it
    Path(f"{tmp_path}/_log/t/.draft-killed").write_text("half an ent")
    assert store.create("t", spark.range(4), "next") == 2
    assert store.sweep("t") == [] and os.path.isdir(orphan)  # it may still be at work
    assert store.sweep("t", older_than_hours=0) == [orphan]
    assert not os.path.exists(orphan) and store.read("t", 1).count() == 3 and store.latest("t").count() == 4


def test_a_writer_whose_rows_were_swept_makes_no_version(spark, tmp_path, monkeypatch):
    store = Versions(spark, str(tmp_path))
    counted = spark.range(3)
    append = CommitLog.append
    monkeypatch.setattr(CommitLog, "append", lambda self, *a, **k: (store.sweep("t", 0), append(self, *a, **k))[1])
    with pytest.raises(RuntimeError):
        store.create("t", counted, "raw")
    assert store.manifest().isEmpty()


def test_writers_at_the_same_time_get_different_numbers(spark, tmp_path):
    numbers, failed = [], []

    def write(i):
        try:
            numbers.append((Versions(spark, str(tmp_path)).create("t", spark.range(i), str(i)), i))
        except Exception as error:
            failed.append(error)
    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(n for n, _ in numbers) == [1, 2, 3, 4, 5]
    store = Versions(spark, str(tmp_path))
    for number, i in numbers:
        assert store.read("t", number).count() == i
    assert store.current("t") == 5


def test_a_taken_number_is_never_replaced(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log", "table_name string, seq bigint, word string")
    asked = []

    def late(before):
        asked.append(len(before))
        if len(asked) == 1:  # another writer is faster once
            log.append("a/b [c]", lambda b: {"word": "first"})
        return {"word": "second"}
    assert log.append("a/b [c]", late)["seq"] == 2 and asked == [0, 1]
    assert [(r["seq"], r["word"]) for r in log.listed("a/b [c]")] == [(1, "first"), (2, "second")]
    files = Files(spark)
    for word, wanted in (("one", True), ("two", False)):  # the step that file systems other than local disks take
        Path(f"{tmp_path}/draft").write_text(word)
        at = [files._at(f"{tmp_path}/{n}")[0] for n in ("draft", "final")]
        assert files.renamed(*at) is wanted
    assert Path(f"{tmp_path}/final").read_text() == "one"


# delimited files

@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=30), st.booleans())
@settings(max_examples=200, deadline=None)
def test_states_of_lines(steps, state):
    out, inside = (np.array([s[i] for s in steps], dtype=bool) for i in (0, 1))
    wanted = [state]
    for o, i in steps:
        wanted.append(i if wanted[-1] else o)
    if steps:
        assert records.entered(out, inside, state).tolist() == wanted


def plain_reader(spark, path, sep):
    return spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def fields_of(rng, sep):
    value = "".join(rng.choice(["a", "bc", " ", '""', "\n", sep, "\n\n", "ä", "1"]) for _ in range(rng.randrange(7)))
    loose = "".join(rng.choice(["a", "b c", "9", "ö", 'x"y']) for _ in range(rng.randrange(1, 4)))
    return rng.choice([f'"{value}"', loose, f'"{value}"', "", '""'])


@pytest.mark.parametrize("sep,end", [(",", "\n"), ("\t", "\n"), (",", "\r\n"), ("|", "\n")])
def test_files_cut_anywhere_read_like_whole_ones(spark, tmp_path, sep, end):
    rng = random.Random(f"{sep}{end}")
    for part in range(2):
        rows = [sep.join(["id", '"two\nlines"', "c"])] + [sep.join([str(i), fields_of(rng, sep), fields_of(rng, sep)]) for i in range(150)]
        rows.insert(50, sep.join(["50", '"' + "long\n" * 120 + '"', "x"]))  # over many ranges
        (tmp_path / f"part{part}.csv").write_bytes((end.join(rows) + end).encode())
    wanted = plain_reader(spark, str(tmp_path), sep)
    # with a line break in its header the reader of whole files takes that one for the end of all lines
    wanted = sorted(((*r[:2], r[2].removesuffix("\r") if r[2] else r[2]) if r[2] != "\r" else (*r[:2], None) for r in wanted.collect()), key=str)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (61, 1000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            assert records.breaks_inside_values(spark, str(tmp_path), sep)
            rows, names = readers._fields_as_text(spark, str(tmp_path), sep, True)
            got = sorted((tuple(r)[:3] for r in rows.collect()), key=str)
            assert names == ["id", "two\nlines", "c"] and got == wanted, size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_file_without_quoted_breaks_is_split(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n" + "".join(f'{i},"x ""{i}"" y"\n' for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
        df = readers.load_csv(spark, str(tmp_path / "plain.csv"))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 3000 and df.filter("a = 7").first()["b"] == 'x "7" y'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_long_lines_need_no_stack(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("a,b\n1," + '"' + 'w ""x"" ' * 200_000 + '\nend"\n2,' + '"",' * 9_000 + "\n3,\"" + "q" * 500_000 + '\n"\n')
    rows = readers._fields_as_text(spark, str(tmp_path / "wide.csv"), ",", True)[0].select("a", F.length("b").alias("n")).collect()
    assert sorted(map(tuple, rows)) == sorted((r["a"], len(r["b"] or "")) if r["b"] is not None else (r["a"], None) for r in plain_reader(spark, str(tmp_path / "wide.csv"), ",").collect())


def test_lines_that_end_in_returns_alone(spark, tmp_path):
    (tmp_path / "old.csv").write_bytes(b'a,b\r1,"x"\r2,y\r')
    assert sorted(map(tuple, readers.load_csv(spark, str(tmp_path / "old.csv")).collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert readers.load_csv(spark, str(tmp_path / "empty.csv")).count() == 0
