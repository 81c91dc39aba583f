import datetime
import random

import pytest

from tallgrass.streaming import ledger


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_ledger_passes_each_line_once_over_batches(spark, rocksdb, tmp_path):
    schema = "session string, call long, path string, content_hash string, start long, end long"
    first = [("s", 1, "a", "h", 1, 3), ("s", 2, "a", "h", 2, 5), ("t", 1, "a", "h", 1, 1)]
    second = [("s", 3, "a", "h", 4, 6), ("s", 4, "a", "new", 1, 1), ("t", 2, "a", "h", 1, 1)]
    source = str(tmp_path / "in")
    got = None
    for batch in (first, second):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = ledger.new_lines(spark.readStream.schema(schema).parquet(source))
        got = ledger.run_to_table(stream, spark, str(tmp_path))
    seen, expected = set(), []
    for session, call, path, digest, a, b in sorted(first + second, key=lambda r: (r[0], r[1])):
        for line in range(a, b + 1):
            if (session, path, digest, line) not in seen:
                seen.add((session, path, digest, line))
                expected.append((session, call, path, digest, line))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_windows_close_with_the_watermark(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", "view", 1.0), ("2024-01-01 05:00:00", "view", 2.0), ("2024-01-09 00:00:00", "view", 4.0)]
    df = spark.createDataFrame(rows, "at string, event_type string, value double").selectExpr("cast(at as timestamp) as ts", "event_type", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = ledger.run_to_table(ledger.event_windows(stream), spark, str(tmp_path)).collect()
    assert [(str(r.start)[:10], r.n, r.total) for r in found] == [("2024-01-01", 2, 3.0)]


def test_spans_equal_sets_of_lines():
    pick = random.Random(2)
    for _ in range(300):
        spans, held = [], set()
        for _ in range(pick.randint(1, 25)):
            start = pick.randint(1, 60)
            end = start + pick.randint(0, 12)
            spans, missing = ledger.add_span(spans, start, end)
            asked = set(range(start, end + 1))
            assert sorted(n for a, b in missing for n in range(a, b + 1)) == sorted(asked - held)
            held |= asked
            assert sorted(n for a, b in zip(spans[::2], spans[1::2], strict=True) for n in range(a, b + 1)) == sorted(held)
            assert all(b + 1 < c for b, c in zip(spans[1::2], spans[2::2], strict=False))


SENT = "session string, ts timestamp, call long, path string, content_hash string, start long, end long"


def ran(spark, tmp_path, batches, wait):
    """All ranges that come out, and what is left in the state, after a batch for each table of rows."""
    source, got = str(tmp_path / "in"), None
    for n, batch in enumerate(batches):
        rows = [(s, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m), *rest) for s, m, *rest in batch]
        spark.createDataFrame(rows, SENT).coalesce(1).write.parquet(f"{source}/batch={n}")
        stream = spark.readStream.schema(SENT).option("pathGlobFilter", "*.parquet").parquet(source)
        got = ledger.run_to_table(ledger.new_ranges(stream.withWatermark("ts", "5 minutes"), wait), spark, str(tmp_path))
    state = spark.read.format("statestore").option("stateVarName", "sent").load(f"{tmp_path}/state")
    return got.collect(), state.selectExpr("user_map_key.path as path", "user_map_value.spans as spans").collect()


def test_calls_out_of_order_are_released_in_order(spark, rocksdb, tmp_path):
    batches = [
        [("s", 2, 3, "a", "h", 5, 9), ("s", 1, 2, "a", "h", 4, 6)],
        [("s", 0, 1, "a", "h", 1, 5), ("s", 3, 4, "b", "h", 2, 1)],
        [("s", 30, 5, "a", "h", 1, 12)],
        [("s", 60, 7, "a", "h", 1, 1), ("t", 60, 1, "z", "h", 1, 1)],
        [("t", 90, 2, "z", "h", 1, 1)],
        [("t", 120, 3, "z", "h", 1, 2)],
    ]
    got, state = ran(spark, tmp_path, batches, "10 minutes")
    rows = sorted((r.session, r.call, r.path, r.start, r.end, r.late) for r in got)
    # Calls 1 to 3 came backwards over two batches: each line still belongs to the first call that asked for it.
    assert rows[:4] == [("s", 1, "a", 1, 5, False), ("s", 2, "a", 6, 6, False), ("s", 3, "a", 7, 9, False), ("s", 5, "a", 10, 12, False)]
    assert {r.path: list(r.spans) for r in state} == {"a": [1, 12], "z": [1, 1]}


def test_late_calls_get_what_is_missing(spark, rocksdb, tmp_path):
    batches = [[("s", 0, 5, "a", "h", 3, 4)], [("s", 1, 2, "a", "h", 1, 6), ("s", 1, 2, "a", "new", 3, 3)], [("s", 2, 6, "a", "h", 1, 6)]]
    got, state = ran(spark, tmp_path, batches, None)
    rows = sorted((r.call, r.content_hash, r.start, r.end, r.late) for r in got)
    assert rows == [(2, "h", 1, 2, True), (2, "h", 5, 6, True), (2, "new", 3, 3, True), (5, "h", 3, 4, False)]
    assert sorted(list(r.spans) for r in state) == [[1, 6], [3, 3]]
