"""Sinks: a repeated batch, days that a batch no longer has, compaction."""

from fleetlens.sources import tables

T0, DAY = 1_700_000_000_000, 86_400_000


def rows(spark, ids, day=0):
    return spark.createDataFrame([(i, T0 + day * DAY) for i in ids], "id long, at long")


def ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def test_a_repeated_batch_leaves_every_row_once(spark, tmp_path):
    path = str(tmp_path / "t")
    both = rows(spark, [1, 2]).unionAll(rows(spark, [3], 1))
    tables.append_table(both, path, "at", "a")
    tables.append_table(both, path, "at", "a")
    tables.append_table(rows(spark, [4], 1), path, "at", "b")
    assert ids(spark, path) == [1, 2, 3, 4]
    tables.append_table(rows(spark, [1, 2, 9]), path, "at", "a")  # the retry has no rows of the second day
    assert ids(spark, path) == [1, 2, 4, 9]
    tables.append_table(rows(spark, [1]).limit(0), path, "at", "a")
    assert ids(spark, path) == [4]


def test_compaction_keeps_the_rows(spark, tmp_path):
    path, into = str(tmp_path / "t"), str(tmp_path / "c")
    for k in range(6):
        tables.append_table(rows(spark, [2 * k, 2 * k + 1], k % 2).repartition(2), path, "at", f"b{k}")
    tables.compact(spark, path, into)
    assert ids(spark, into) == ids(spark, path) == list(range(12))
    files = lambda p: sum(1 for _ in __import__("pathlib").Path(p).rglob("part-*.parquet"))
    assert files(into) <= files(path)
    tables.append_table(rows(spark, [77]), into, "at", "next")
    assert 77 in ids(spark, into)
