from corvane.operators.references import current_orphans
from corvane.streaming.ledger import LedgerStream

COLUMNS = "ref_table string, key int, refs long, exists long"


def test_batches_from_a_stream(spark, tmp_path):
    source, folder = tmp_path / "deltas", f"file://{tmp_path}/ledger"
    stream = LedgerStream(spark, folder)
    assert stream.ledger().count() == 0
    batches = [[("users", 1, 1, 0), ("users", 2, 1, 0), ("users", 2, 0, 1)], [("users", 1, 0, 1), ("users", 2, 0, -1)], [("users", 2, -1, 0)]]
    wanted = [[("users", 1, 1)], [("users", 2, 1)], []]
    for rows, orphans in zip(batches, wanted, strict=True):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(f"file://{source}")
        deltas = spark.readStream.schema(COLUMNS).parquet(f"file://{source}")
        query = stream.start(deltas, f"file://{tmp_path}/checkpoint")
        query.processAllAvailable()
        query.stop()
        assert [tuple(r) for r in current_orphans(stream.ledger()).collect()] == orphans
    assert [tuple(r) for r in stream.ledger().collect()] == [("users", 1, 1, 1)]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    stream = LedgerStream(spark, f"file://{tmp_path}/ledger", "string")
    deltas = spark.createDataFrame([("users", "a", 2, 0)], "ref_table string, key string, refs long, exists long")
    for batch in (0, 0, 1, 0):
        stream.apply(deltas, batch)
    assert [tuple(r) for r in stream.ledger().collect()] == [("users", "a", 4, 0)]


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    stream = LedgerStream(spark, f"file://{tmp_path}/ledger", buckets=16)
    stream.apply(spark.createDataFrame([("users", k, 1, 0) for k in range(200)], COLUMNS), 0)
    first = dict(stream._state()["parts"])
    assert len(first) == 16
    stream.apply(spark.createDataFrame([("users", 5, 1, 0), ("users", 5, 0, 1)], COLUMNS), 1)
    now = stream._state()["parts"]
    assert [b for b in now.values()].count(1) == 1 and set(now) == set(first)
    assert {r["key"]: r["refs"] for r in stream.ledger().collect()} == {k: 1 + (k == 5) for k in range(200)}
    for batch in (2, 3):  # the batch before last of a bucket goes
        stream.apply(spark.createDataFrame([("users", 5, 1, 0)], COLUMNS), batch)
    assert not list((tmp_path / "ledger" / "batch=1").glob("bucket=*")) and len(list((tmp_path / "ledger" / "batch=0").glob("bucket=*"))) == 15
    stream.apply(spark.createDataFrame([("users", k, -1, 0) for k in range(200)] + [("users", 5, -3, -1)], COLUMNS), 4)
    assert stream.ledger().count() == 0
