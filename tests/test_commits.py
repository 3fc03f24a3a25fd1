"""Optimistic commits: one writer wins, between processes and in threads."""

import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

from lumenark.sources import commits
from lumenark.sources.sinks import append_result_set, result_sets

WRITER = """
import sys, time, pathlib
from lumenark.session import session
from lumenark.sources.sinks import append_result_set
folder, name = sys.argv[1], int(sys.argv[2])
spark = session("writer", "local[1]", **{"spark.driver.memory": "1g"})
hits = spark.range(name)
hits.count()
pathlib.Path(f"{folder}-ready-{name}").touch()
while not pathlib.Path(f"{folder}-go").exists():
    time.sleep(0.01)
print("WON" if append_result_set(hits, folder, "s", name, name, 1) else "LOST")
"""


def test_of_two_drivers_one_wins(spark, tmp_path):
    import os
    import pathlib
    import time

    folder = str(tmp_path / "r")
    assert append_result_set(spark.range(1), folder, "s", 1, 1, None)
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    writers = [subprocess.Popen([sys.executable, "-c", WRITER, folder, str(n)], env=env, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) for n in (5, 7)]
    end = time.time() + 120
    while time.time() < end and not all(pathlib.Path(f"{folder}-ready-{n}").exists() for n in (5, 7)):
        time.sleep(0.05)
    pathlib.Path(f"{folder}-go").touch()
    said = [w.communicate(timeout=120)[0].strip().splitlines()[-1] for w in writers]
    assert sorted(said) == ["LOST", "WON"]
    winner = (5, 7)[said.index("WON")]
    assert result_sets(spark, folder, "s").groupBy("set_id").count().orderBy("set_id").collect() == [(1, 1), (winner, winner)]
    assert len(os.listdir(f"{folder}/sets")) == 2  # the loser's rows are gone


def test_many_threads_commit_in_turn(spark, tmp_path):
    folder = str(tmp_path / "c")
    assert commits.latest(spark, folder) == (-1, None)
    assert commits.commit(spark, folder, 0, {"n": 0}) and not commits.commit(spark, folder, 0, {"n": 9})
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: commits.updated(spark, folder, lambda c: {"n": c["n"] + 1}), range(40)))
    assert commits.latest(spark, folder) == (40, {"n": 40})
