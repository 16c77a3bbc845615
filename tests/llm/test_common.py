"""Stored tables belong to the run that stored them."""

import threading

from tidewater.llm.common import new_path, stored_paths


def test_two_runs_at_once(spark):
    inside, done, other = threading.Event(), threading.Event(), []

    def run():
        inside.wait(10)
        with stored_paths() as paths:
            other.append(new_path(spark, "b"))
            assert paths == other
        done.set()

    thread = threading.Thread(target=run)
    thread.start()
    with stored_paths() as outer:
        first = new_path(spark, "a")
        inside.set()
        assert done.wait(10)
        with stored_paths() as inner:
            second = new_path(spark, "c")
    thread.join()
    assert inner == [second] and outer == [first, second] and new_path(spark, "d") not in outer
