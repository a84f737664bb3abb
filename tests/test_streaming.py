import pytest
from helpers import AS_OF, as_set, listing, rows

from dirgauge.operators import tables
from dirgauge.plans import build
from dirgauge.schemas import LISTING
from dirgauge.streaming import finish_ingest, read_stream, stage_listing, stream_totals

BATCHES = [
    [("/d/x", "f", 5, 1), ("/d/bad", "f", 0, 1, "IoError")],   # arrives before its directory
    [("/d", "d", 0, 1), ("/d/e", "d", 0, 1)],
    [("/d/e/y", "f", 7, 2), ("/d/l", "l", 0, 2)],
]


@pytest.fixture
def arrived(spark, tmp_path):
    path = str(tmp_path / "arriving")
    for batch in BATCHES:
        listing(spark, *batch).coalesce(1).write.mode("append").parquet(path)
    return path


def stage(spark, tmp_path, arrived):
    stage_listing(
        read_stream(spark, arrived, files_per_trigger=1), str(tmp_path / "staged"), str(tmp_path / "offsets")
    ).awaitTermination()


def outcome(spark, root):
    stored = tables.open_tables(spark, root)
    paths = stored["directories"].select("dir_id", "path")
    return as_set(stored["files"].join(paths, "dir_id"), "path", "filename", "size_bytes", "owner_uid")


def test_stream_equals_batch(spark, tmp_path, arrived):
    stage(spark, tmp_path, arrived)
    stage(spark, tmp_path, arrived)  # nothing new arrived: nothing is staged twice
    streamed, batch = str(tmp_path / "streamed"), str(tmp_path / "batch")
    for root in (streamed, batch):
        tables.create_tables(spark, root)
    errors = finish_ingest(spark, str(tmp_path / "staged"), streamed, AS_OF)
    assert as_set(errors) == {("/d/bad", "IoError")}
    build.ingest(spark, batch, spark.read.schema(LISTING).parquet(arrived), AS_OF)
    assert outcome(spark, streamed) == outcome(spark, batch) == {("/d", "x", 5, 1), ("/d/e", "y", 7, 2)}


def test_a_replayed_batch_replaces_itself(spark, tmp_path, arrived):
    stage(spark, tmp_path, arrived)
    # The same data from a lost checkpoint: batch ids start again at 0.
    stage_listing(
        read_stream(spark, arrived, files_per_trigger=1), str(tmp_path / "staged"), str(tmp_path / "offsets-2")
    ).awaitTermination()
    staged = spark.read.parquet(str(tmp_path / "staged"))
    assert staged.count() == sum(map(len, BATCHES))


def test_late_files_are_picked_up_on_the_next_run(spark, tmp_path, arrived):
    stage(spark, tmp_path, arrived)
    listing(spark, ("/d/late", "f", 9, 3)).coalesce(1).write.mode("append").parquet(arrived)
    stage(spark, tmp_path, arrived)
    assert spark.read.parquet(str(tmp_path / "staged")).count() == sum(map(len, BATCHES)) + 1


def test_running_totals(spark, tmp_path, arrived):
    seen = []
    query = (
        stream_totals(read_stream(spark, arrived, files_per_trigger=1))
        .writeStream.outputMode("complete")
        .foreachBatch(lambda df, _: seen.append(rows(df)))
        .option("checkpointLocation", str(tmp_path / "offsets"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert seen[-1] == [(2, 12, 1)]
    assert len(seen) == len(BATCHES)


def test_failing_write_stops_the_stream(spark, tmp_path, arrived):
    blocked = tmp_path / "blocked"
    blocked.write_text("a file, not a folder")
    query = stage_listing(read_stream(spark, arrived), str(blocked), str(tmp_path / "offsets"))
    with pytest.raises(Exception):
        query.awaitTermination()



def test_each_batch_is_ingested_once(spark, tmp_path, arrived):
    root, staged = str(tmp_path / "tables"), str(tmp_path / "staged")
    tables.create_tables(spark, root)
    stage(spark, tmp_path, arrived)
    finish_ingest(spark, staged, root, AS_OF)
    listing(spark, ("/d/late", "f", 9, 3)).coalesce(1).write.mode("append").parquet(arrived)
    stage(spark, tmp_path, arrived)
    for _ in range(2):
        finish_ingest(spark, staged, root, AS_OF)
    assert outcome(spark, root) == {("/d", "x", 5, 1), ("/d/e", "y", 7, 2), ("/d", "late", 9, 3)}
    assert tables.read_table(spark, root, "directories").count() == 2


def test_a_marked_batch_with_other_rows_is_an_error(spark, tmp_path, arrived):
    root, staged = str(tmp_path / "tables"), str(tmp_path / "staged")
    tables.create_tables(spark, root)
    stage(spark, tmp_path, arrived)
    finish_ingest(spark, staged, root, AS_OF)
    stage_listing(read_stream(spark, arrived, files_per_trigger=3), staged, str(tmp_path / "offsets-2")).awaitTermination()
    with pytest.raises(ValueError, match="other rows"):
        finish_ingest(spark, staged, root, AS_OF)
