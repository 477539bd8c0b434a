"""Online bouts over files that come one by one: silent keys, late and unordered frames, restarts."""

import datetime
import random

import pytest

SCHEMA = "k int, ts timestamp, on boolean"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
BASE = int(START.timestamp()) * 10


def bouts_of(hits, min_len, gap):
    runs = []
    for f in sorted(hits):
        if runs and runs[-1][1] == f - 1:
            runs[-1][1] = f
        else:
            runs.append([f, f])
    out = []
    for s, e in (r for r in runs if r[1] - r[0] + 1 >= min_len):
        if out and s - out[-1][1] <= gap:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s + 1 >= min_len]


@pytest.fixture
def run(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def batches(files, late, name, fps=10.0):
        """Rows that each file's micro-batch gave out; the query starts anew for every file, from its checkpoint."""
        from tracklore.streaming.online import online_bouts

        folder, seen = tmp_path / name, []
        for n, rows in enumerate(files):
            df = spark.createDataFrame([(k, START + datetime.timedelta(milliseconds=100 * f + 20), v) for k, f, v in rows], SCHEMA)
            df.coalesce(1).write.mode("append").parquet(str(folder / "in"))
            found = online_bouts(spark.readStream.schema(SCHEMA).parquet(str(folder / "in")), "k", "on", 2, 3, fps, late)
            query = found.writeStream.option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True)
            query.format("parquet").option("path", str(folder / "out")).start().awaitTermination(60)
            rows = {(r.k, r.start - BASE, r.end - BASE) for r in spark.read.schema("k int, start long, end long").parquet(str(folder / "out")).collect()}
            seen.append(rows - set().union(*seen))
        return seen

    yield batches
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_silent_key_gives_out_its_last_bout(run):
    first = [(1, f, True) for f in (3, 4, 5, 7, 8)] + [(2, 0, False)]
    seen = run([first, [(2, 9, False)], [(2, 40, False)]], "0 seconds", "silent")
    assert seen[0] | seen[1] == set() or (1, 3, 8) not in seen[0]
    assert set().union(*seen) == {(1, 3, 8)}


def test_unordered_and_late_frames(run):
    rng = random.Random(5)
    hits = {k: {f for f in range(120) if rng.random() < 0.55} for k in (1, 2, 3)}
    rows = [(k, f, f in hits[k]) for k in hits for f in range(120)]
    rows.sort(key=lambda r: r[1] + rng.randrange(15))  # up to 1.5 s out of order
    third = len(rows) // 3
    files = [rows[:third], rows[third : 2 * third], rows[2 * third :] + rows[-5:], [(9, 500, False)], [(1, 50, True), (1, 51, True), (9, 501, False)]]
    seen = run(files, "2 seconds", "unordered")
    want = {(k, s, e) for k in hits for s, e in bouts_of(hits[k], 2, 3)}
    assert set().union(*seen) == want and seen[1] and seen[2]  # the last file's frames of key 1 come too late to count
