"""Leases of a streamed queue: the batch operators' rules, one owner at a time, and expiry by timers."""

import random
import time

from lumenark.operators import ingest
from lumenark.streaming.leases import NEW, STATE_STORE, after, expired, leased

COMMANDS = "job_id long, seq long, command string, owner string, permanent boolean"


def test_rules_are_those_of_the_batch_operators(spark):
    rng, now = random.Random(5), 1_000_000
    queue = {i: NEW for i in range(60)}
    frame = lambda: spark.createDataFrame([(i, 1, False, 0, s[4], s[0], s[1], s[2], s[3]) for i, s in queue.items()], "id long, priority int, user_requested boolean, updated_ms long, next_attempt_ms long, status string, owner string, lease_ms long, attempts int")
    shown = lambda df: {r.id: (r.status, r.lease_ms if r.status == "RUNNING" else None, r.attempts, r.next_attempt_ms) for r in df.collect()}
    plain = lambda: {i: (s[0], s[2] if s[0] == "RUNNING" else None, s[3], s[4]) for i, s in queue.items()}
    for turn in range(4):
        table = frame()
        claims = {r.id: r for r in ingest.claimed(table, "a", now, 40, 100_000).collect()}
        for i in claims:
            queue[i], outcome = after(queue[i], "CLAIM", "a", False, now, 100_000)
            assert outcome == "CLAIMED" and (queue[i][0], queue[i][2], queue[i][3]) == (claims[i].status, claims[i].lease_ms, claims[i].attempts)
        assert all(after(s, "CLAIM", "b", False, now)[1] == "REFUSED" for i, s in queue.items() if i in claims)
        now += 30_000
        done = [(i, rng.choice(["a", "b"])) for i in queue if rng.random() < 0.3]
        table = ingest.completed(frame(), spark.createDataFrame(done, "id long, owner string"), now)
        want = shown(table)
        for i, by in done:
            queue[i], _ = after(queue[i], "COMPLETE", by, False, now)
        assert plain() == want
        bad = [(i, "a", rng.random() < 0.3) for i, s in queue.items() if s[0] == "RUNNING" and rng.random() < 0.5]
        want = shown(ingest.failed(frame(), spark.createDataFrame(bad, "id long, owner string, permanent boolean"), now))
        for i, by, permanent in bad:
            queue[i], _ = after(queue[i], "FAIL", by, permanent, now)
        assert plain() == want
        now += rng.choice([10_000, 90_000])
        want = shown(ingest.recovered(frame(), now))
        queue = {i: expired(s, now) or s for i, s in queue.items()}
        assert plain() == want, turn


def wait(condition, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not condition():
        time.sleep(0.2)
    assert condition()


def test_no_job_is_held_twice_and_leases_expire(spark, tmp_path):
    folder, name = str(tmp_path / "in"), "leases"
    spark.conf.set(*STATE_STORE)
    q = None

    def send(rows):
        spark.createDataFrame(rows, COMMANDS).coalesce(1).write.mode("append").parquet(folder)

    def rows():
        return spark.table(name).collect()

    try:
        send([(j, 0, "SUBMIT", None, None) for j in range(6)])
        stream = spark.readStream.schema(COMMANDS).parquet(folder)
        q = leased(stream, lease_ms=8_000).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="200 milliseconds").start()
        wait(lambda: len(rows()) >= 6)
        # two owners claim every job in one batch
        send([(j, s, "CLAIM", o, None) for j in range(6) for s, o in ((1, "a"), (2, "b"))])
        wait(lambda: len(rows()) >= 18)
        got = rows()
        assert sorted((r.owner, r.event) for r in got if r.seq in (1, 2)) == [("a", "CLAIMED")] * 6 + [("b", "REFUSED")] * 6
        send([(0, 3, "COMPLETE", "a", None), (1, 3, "COMPLETE", "b", None), (2, 3, "FAIL", "a", True)])
        wait(lambda: len([r for r in rows() if r.seq == 3]) == 3)
        # the others' leases run out by timers alone
        wait(lambda: len([r for r in rows() if r.event == "EXPIRED"]) == 4)
        send([(1, 4, "COMPLETE", "a", None), (1, 5, "CLAIM", "b", None), (0, 5, "CLAIM", "b", None)])
        wait(lambda: len([r for r in rows() if r.seq in (4, 5)]) == 3)
        outcome = {(r.job_id, r.seq): (r.event, r.status, r.attempts) for r in rows() if r.seq is not None and r.seq >= 3}
        assert outcome[0, 3] == ("COMPLETED", "COMPLETE", 1) and outcome[2, 3] == ("FAILED", "FAILED_PERMANENT", 1)
        assert outcome[1, 3][0] == "FENCED" and outcome[1, 4][0] == "FENCED"
        assert outcome[1, 5] == ("CLAIMED", "RUNNING", 1) and outcome[0, 5][0] == "REFUSED"  # the lost attempt does not count
        held = {}
        for r in sorted(rows(), key=lambda r: (r.at_ms, r.event != "EXPIRED", r.seq or 0)):
            if r.event == "CLAIMED":
                assert r.job_id not in held
                held[r.job_id] = r.owner
            elif r.event in ("EXPIRED", "COMPLETED", "FAILED"):
                held.pop(r.job_id)
        assert {r.job_id for r in rows() if r.event == "EXPIRED"} == {1, 3, 4, 5}
    finally:
        if q is not None:
            q.stop()
        spark.conf.unset(STATE_STORE[0])
