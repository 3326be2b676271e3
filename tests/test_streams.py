"""Polled pages, expiring windows and the spool, each against its batch or by hand."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "pages"
    f.mkdir()
    for i in range(5):
        lines = [json.dumps({"page": i, "n": j}) for j in range(3)] + (["{broken", "[1]", ""] if i == 2 else [])
        (f / f"p{i}.jsonl").write_text("\n".join(lines))
    (f / "p3.jsonl").unlink()
    (f / "p3.jsonl").mkdir()  # a page that cannot be opened
    (f / "note.txt").write_text("no page")
    return str(f)


def test_poll_resumes(spark, folder):
    from sentrel.streaming.polling import poll

    whole, end = poll(spark, folder, None)
    parts, at = [], None
    while True:
        df, after = poll(spark, folder, at, 2)
        parts += df.collect()
        if after == at:
            break
        at = after
    assert at == end and sorted(parts) == sorted(whole.collect()) and len(parts) == 4 * 3 + 2 + 1
    assert sorted((r.page, r.status) for r in parts if r.status != "ok") == [("p2.jsonl", "unreadable"), ("p2.jsonl", "unreadable"), ("p3.jsonl", "lost")]


def test_cursors_are_refused(spark, folder, tmp_path):
    from sentrel.streaming.polling import BadCursor, cursor, poll

    for bad in ("", "{", "[]", '{"seen": 1}', cursor(str(tmp_path), 1), cursor(folder, -1), cursor(folder, 6), cursor(folder, True), cursor(folder, 1.0)):
        with pytest.raises(BadCursor):
            poll(spark, folder, bad)


def test_stream_of_pages(spark, folder, tmp_path):
    from sentrel.streaming.polling import PageSource, poll

    spark.dataSource.register(PageSource)

    def run(checkpoint, source):
        stream = spark.readStream.format("sentrel_pages").load(source)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    run("cp", folder)
    (tmp_path / "pages/p5.jsonl").write_text('{"page": 5}')
    run("cp", folder)  # goes on behind the first run
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(got) == sorted(poll(spark, folder, None)[0].collect())
    other = tmp_path / "other"
    other.mkdir()
    (other / "q.jsonl").write_text("{}")
    with pytest.raises(Exception, match="another source"):
        run("cp", str(other))


def test_recent_windows(spark, tmp_path):
    from sentrel.operators.windows import moving_counts
    from sentrel.streaming.recent import recent_counts
    from sentrel.streaming.replay import replay

    r = random.Random(2)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = sorted(((r.randrange(3000), f"k{r.randrange(4)}", r.choice([None, 1, 2, 3, 4, 5])) for _ in range(600)), key=str)
    rows.sort(key=lambda x: x[0])
    kind = "key string, ts timestamp, caller long"
    for i in range(3):
        part = [(k, start + datetime.timedelta(seconds=t), c) for t, k, c in rows[i * 200 : (i + 1) * 200]]
        r.shuffle(part)
        part += [("end", start + datetime.timedelta(days=9), None)] if i == 2 else []
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = recent_counts(replay(spark, str(tmp_path / "in"), kind), 60, 3, "2000 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    e = spark.createDataFrame([(k, t + int(start.timestamp()), c) for t, k, c in rows], "key string, ts long, caller long")
    want = moving_counts(e, ["key"], "caller", 0, 60).where("different >= 3").collect()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((x.key, x.ts, x.callers, x.n) for x in got) == sorted((x.key, x.ts, x.different, x.n) for x in want) and len(want) > 50
    assert held[-1] <= 1  # only the last event is left; all other keys' states have expired


def test_spool(spark, tmp_path):
    from sentrel.streaming.spooling import spool_stream, write_batch

    def batch(n, bad=1):
        rows = [("X402-201", "high", "refuse", i) for i in range(n)] + [("bad code!", "high", "refuse", 0), (None, "high", "refuse", 0)][:bad]
        return spark.createDataFrame(rows, "code string, severity string, decision string, ts long")

    out = str(tmp_path / "spool")
    assert write_batch(batch(6), 0, out, 10) == {"written": 6, "dropped": 1, "segment": 0}
    assert write_batch(batch(6), 1, out, 10) == {"written": 12, "dropped": 2, "segment": 0}
    assert write_batch(batch(6), 1, out, 10) == {"written": 12, "dropped": 2, "segment": 0}  # done again: nothing twice
    assert spark.read.json(f"{out}/segment=*/batch=*").count() == 12
    assert write_batch(batch(20, 2), 2, out, 10)["segment"] == 1
    assert write_batch(batch(3), 3, out, 10) == {"written": 35, "dropped": 5, "segment": 2}  # the first segment goes, its counts stay
    assert spark.read.json(f"{out}/segment=*/batch=*").count() == 23 and not (tmp_path / "spool/segment=0").exists()
    assert write_batch(batch(3), 3, out, 10) == {"written": 35, "dropped": 5, "segment": 2}
    for i in range(2):
        batch(4).write.mode("append").parquet(str(tmp_path / "in"))
        spool_stream(spark.readStream.schema(batch(1).schema).parquet(str(tmp_path / "in")), str(tmp_path / "live"), str(tmp_path / "cp"))
    assert spark.read.json(f"{tmp_path}/live/segment=*/batch=*").count() == 8
