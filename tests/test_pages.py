"""Report sink: places without gaps, ties and copies spread, pages read back equal, faults are named."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import pages

DDL = "day date, name string, amount decimal(18,2), at timestamp"


def frame(spark, n=1000):
    """A third of all rows are one row."""
    rows = spark.range(n).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("k"))
    text = F.when(F.col("k") % 7 == 0, "a \"b\", c\nd ").when(F.col("k") % 7 == 1, "").when(F.col("k") % 7 > 2, F.concat(F.lit(" è"), F.col("k").cast("string")))
    return rows.select(F.date_add(F.lit("2024-01-01"), (F.col("k") % 11).cast("int")).alias("day"), text.alias("name"), (F.col("k") / 4).cast("decimal(18,2)").alias("amount"), F.timestamp_micros(F.col("k") * 1000001).alias("at"))


@pytest.mark.parametrize("kind", pages.FORMATS)
def test_pages_are_read_back_in_order(spark, tmp_path, kind):
    df, root = frame(spark), f"{tmp_path}/r"
    manifest = pages.write(df, root, ["day", "amount"], 64, kind)
    back = pages.read(spark, root, df.schema, kind)
    rows = back.orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1000)) and all(r.page == r.place // 64 + 1 for r in rows)
    assert sorted(map(repr, df.collect())) == sorted(repr(r) for r in back.select(*df.columns).collect())
    keys = [(r.day is not None, r.day, r.amount) for r in rows]
    assert keys[334:] == sorted(keys[334:]) and not any(k[0] for k in keys[:334])
    assert manifest.count() == 16 and pages.verify(spark, root, df.schema, kind).count() == 0
    files = {p: glob.glob(f"{root}/pages/page={p}/part-*") for p in range(1, 17)}
    assert all(len(f) == 1 for f in files.values())  # a page is a file
    os.remove(files[2][0])
    with open(files[3][0]) as f:
        lines = f.readlines()
    with open(files[3][0], "w") as f:
        f.writelines(lines[:-1])
    for crc in glob.glob(f"{root}/pages/*/.*.crc"):
        os.remove(crc)
    assert {r.page: r.fault for r in pages.verify(spark, root, df.schema, kind).collect()} == {2: "missing", 3: "changed"}


def test_copies_spread_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, 3000).repartition(4)
        assert [r.place for r in pages.numbered(df, ["day"]).select("place").orderBy("place").collect()] == list(range(3000))
        sizes = [r["count"] for r in pages.ranges(df, ["day"]).groupBy(F.shiftright("_at", 33)).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1200  # the 1,000 equal rows and their neighbours are cut like others
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], DDL)
    assert pages.write(empty, f"{tmp_path}/e", ["day"]).count() == 0
    with pytest.raises(ValueError):
        pages.write(spark.range(1).withColumn("Page", F.lit(1)), f"{tmp_path}/c", ["id"])
    with pytest.raises(ValueError):
        pages.write(spark.range(1), f"{tmp_path}/c", ["id"], 10, "xml")
