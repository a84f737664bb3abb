from __future__ import annotations

from dirgauge.sources.order_tree import OrderTree
from pyspark.sql import functions as F


def test_the_listing_does_not_need_stored_files(spark):
    t = OrderTree(spark, "/root/testdata/sf0.001")
    listed = t["listing"].where("entry_type = 'f'").select("path", "size_bytes", "uid", "inode", "atime")
    assert "files" not in t._tables
    placed = t["files"].join(t["directories"].select("dir_id", "path"), "dir_id")
    expected = placed.select(F.concat_ws("/", "path", "filename").alias("path"), "size_bytes", F.col("owner_uid").alias("uid"), "inode", "atime")
    assert listed.exceptAll(expected).isEmpty() and expected.exceptAll(listed).isEmpty() and not listed.isEmpty()
