"""A selection of many uids is dealt over tasks by its rows."""

from sessionlake.operators import present


def test_partitions_of_a_selection_follow_its_rows(spark):
    sessions = spark.createDataFrame([("u1", 1), ("u1", 2), ("u2", 3), ("u999", 4), (None, 5)], "uid string, n int")
    uids = spark.createDataFrame([(f"u{k % 500}",) for k in range(2000)] + [(None,)], "uid string")
    found, gone = present.select_entries(sessions, uids, rows_per_task=100)
    assert sorted(r.n for r in found.collect()) == [1, 2, 3]
    lost = [r.uid for r in gone.collect()]
    assert len(lost) == 499 and set(lost) == {f"u{k}" for k in range(500) if k not in (1, 2)} | {None}
    assert gone.rdd.getNumPartitions() == 21
    for one, other in zip((found, gone), present.select_entries(sessions, uids)):
        assert sorted(one.collect(), key=str) == sorted(other.collect(), key=str)
