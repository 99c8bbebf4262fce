"""Streaming programs: over several batches, after restarts, and from a socket, against sequential models."""

from __future__ import annotations

import csv
import datetime as dt
import random
import socket
import threading
import time
from collections import Counter
from pathlib import Path

import pytest

from milldam import cli
from milldam.sources import readers, sinks
from milldam.streaming import programs, sketches

STATE = "state string, k long"


def reports(folder):
    """Rows of every batch's report, by batch."""
    out = {}
    for p in sorted(Path(folder).glob("*/part-*.csv")):
        with p.open() as f:
            out[int(p.parent.name)] = list(csv.DictReader(f))
    return out


def stream(spark, folder, schema):
    return readers.file_stream(spark, str(folder), spark.createDataFrame([], schema).schema)


def add(spark, folder, rows, schema):
    """One more file, younger than those before."""
    time.sleep(0.01)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def rank(i):
    return (i * 1103515245 + 12345) % 2147483648


def bloom_model(batches):
    bits, seen, fp, tn, out = set(), set(), 0, 0, []
    for batch in batches:
        for s in batch:
            x = int.from_bytes(s.encode(), "big")
            own = {(a * x + b) % sketches.BITS for a, b in sketches.BLOOM}
            if s not in seen:
                fp, tn = (fp + 1, tn) if own <= bits else (fp, tn + 1)
                seen.add(s)
            bits |= own
        out.append(fp / (fp + tn))
    return out


def test_bloom_goes_on_after_a_restart(spark, tmp_path):
    r = random.Random(3)
    batches = [[r.choice("abcdefghij") * r.randint(1, 12) for _ in range(30)] for _ in range(4)]
    for batch in batches:
        add(spark, tmp_path / "in", [(s, 1) for s in batch] + [(None, 1)], STATE)
        programs.bloom(stream(spark, tmp_path / "in", STATE), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    got = reports(tmp_path / "out")
    assert [float(got[k][0]["FPR"]) for k in range(4)] == pytest.approx(bloom_model(batches))
    kept = {p.name for p in (tmp_path / "state" / "seen").iterdir() if not p.name.startswith(".")}
    assert kept == {"000000002", "000000003"}


def test_counters_rise_and_fall_with_the_sample(spark, tmp_path):
    """A post with two tags lowers both when it goes; counters equal those of the sample kept after every batch."""
    r = random.Random(4)
    schema, held, ids = "id long, tags array<string>", [], iter(range(10**18, 10**18 + 1000))
    for number in range(4):
        batch = [(next(ids), r.sample("abcdefg", r.randint(0, 3))) for _ in range(40)] + [(None, ["z"]), (next(ids), None)]
        batch.append(batch[0])
        add(spark, tmp_path / "in", batch, schema)
        programs.sampled_tags(stream(spark, tmp_path / "in", schema), str(tmp_path / "out"), str(tmp_path / "state"), n=25, availableNow=True).awaitTermination()
        held = sorted(held + [(rank(i), i, t) for i, t in batch if i is not None and t])[:25]
        want = Counter(t for *_, tags in held for t in tags)
        state = programs.Carried(spark, str(tmp_path / "state" / "counts"), "tag string, n long")
        assert {x["tag"]: x["n"] for x in state.before(number + 1).collect()} == dict(want)
        shown = [(x["tag"], int(x["n"])) for x in reports(tmp_path / "out")[number]]
        assert shown == sorted(shown, key=lambda x: (-x[1], x[0])) and all(want[t] == n for t, n in shown)


def test_distinct_over_closed_windows(spark, tmp_path):
    schema, start = "ts timestamp, key string", dt.datetime(2024, 1, 1)
    batches = [[(start + dt.timedelta(seconds=5 * k + 60 * b), f"town{(k * 7) % (9 + b)}") for k in range(12)] for b in range(4)]
    for batch in batches:
        add(spark, tmp_path / "in", [*batch, (batch[0][0], None)], schema)
        programs.distinct(stream(spark, tmp_path / "in", schema), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    got = [x for rows in reports(tmp_path / "out").values() for x in rows]
    assert len(got) > 10 and len({x["Time"] for x in got}) == len(got)
    for row in got:
        first = dt.datetime.strptime(row["Time"], "%Y-%m-%d %H:%M:%S")
        own = {k for batch in batches for ts, k in batch if first <= ts < first + dt.timedelta(seconds=30)}
        assert int(row["Ground Truth"]) == len(own)


def test_posts(spark):
    rows = [(1, (["a", None],)), (2, ([],)), (3, None), (4, (None,))]
    posts = [(i, None if e is None else ([(t,) for t in e[0]] if e[0] is not None else None,)) for i, e in rows]
    got = programs.posts(spark.createDataFrame(posts, programs.POST)).collect()
    assert [(x["id"], x["tags"]) for x in got] == [(1, ["a"])]


def test_append_and_console(spark, tmp_path):
    add(spark, tmp_path / "in", [("a", 1)], STATE)
    add(spark, tmp_path / "in", [("b", 2)], STATE)
    run = sinks.append_batches(stream(spark, tmp_path / "in", STATE), str(tmp_path / "out"), str(tmp_path / "offsets")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {tuple(x) for x in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()} == {("a", "1"), ("b", "2")}
    run = sinks.to_console(stream(spark, tmp_path / "in", STATE)).trigger(availableNow=True).start()
    run.awaitTermination()
    assert run.exception() is None


def test_sample_from_a_socket(spark, tmp_path):
    """The command over a real socket: JSON posts, one malformed and one without tags."""
    server = socket.create_server(("localhost", 0))
    port, open_ = server.getsockname()[1], []

    def serve():
        while True:
            try:
                c, _ = server.accept()
            except OSError:
                return
            open_.append(c)
            for i in range(20):
                c.sendall(f'{{"id": {i}, "entities": {{"hashtags": [{{"text": "t{i % 3}"}}]}}}}\n'.encode())
            c.sendall(b'{"id": 50, "entities": {"hashtags": []}}\nnot json\n')

    threading.Thread(target=serve, daemon=True).start()
    failed = []

    def command():
        try:
            cli.sample(spark, str(port), str(tmp_path / "out"), "localhost", "1")
        except Exception as e:
            failed.append(e)

    runner = threading.Thread(target=command, daemon=True)
    runner.start()
    try:
        for _ in range(120):
            got = {x["tag"]: int(x["n"]) for rows in reports(tmp_path / "out").values() for x in rows}
            if sum(got.values()) >= 20 or failed:
                break
            time.sleep(0.5)
    finally:
        for q in spark.streams.active:
            q.stop()
        runner.join(30)
        server.close()
        for c in open_:
            c.close()
    assert not failed and got == {"t0": 7, "t1": 7, "t2": 6}
