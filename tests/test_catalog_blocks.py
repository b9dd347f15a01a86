"""One-hot labels beyond the names that may be sent to all tasks."""

from corvane.operators import catalog


def test_blocks_give_what_one_row_gives(spark, monkeypatch):
    labels = spark.createDataFrame([(1, "c3"), (2, "noise"), (3, "zz"), (4, "c11")], "id long, label string")
    classes = spark.createDataFrame([(i, f"c{i}") for i in range(12)], "class_idx int, class string")
    monkeypatch.setattr(catalog, "NAMES_BYTES", 1 << 70)
    whole = sorted(map(tuple, catalog.one_hot(labels, classes).collect()))
    monkeypatch.setattr(catalog, "NAMES_BYTES", -1)
    monkeypatch.setattr(catalog, "BLOCK_CLASSES", 5)
    assert sorted(map(tuple, catalog.one_hot(labels, classes).collect())) == whole
    assert len(whole) == 36 and sum(y for _, _, y in whole) == 2
    assert catalog.one_hot(labels, classes.limit(0)).collect() == []
