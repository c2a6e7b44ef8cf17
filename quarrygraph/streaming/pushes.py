"""Pushes to refs as a stream of index runs: one commit of a ref in work at a time, the newest of those that wait next.

Events are (ref, sha, at, kind), kind being `push` or `done`. A push starts a run if its ref is idle; otherwise
it waits, in the place of any that waited before it. When the run in work is done, the one that waits starts. A push
that isn't newer than one met before is a repeat or too late, and nothing comes of it. Refs are
independent, so they are state of their own, spread over the cluster by key; a lost executor's state is restored
from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: times are microseconds within the state
RUNS = "ref string, run int, sha string, pushed long, started long"
STATE = "runs int, work string, waiting string, waiting_at long, newest long, newest_sha string"
#: the setting that state of this kind needs
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class OneAtATime(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ref", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """The runs that a batch's events of one ref start; events of a batch are put in order of time first."""
        runs, work, waiting, waiting_at, newest, newest_sha = self.state.get() if self.state.exists() else (0, None, None, None, None, None)
        (ref,) = key
        for at, kind, sha in sorted({(r["at"], r["kind"], r["sha"]) for r in rows}):
            if kind == "push":
                if newest is not None and (at, sha) <= (newest, newest_sha):
                    continue
                newest, newest_sha = at, sha
                if work is not None:
                    waiting, waiting_at = sha, at
                    continue
                work, pushed = sha, at
            elif work is None:
                continue
            elif waiting is None:
                work = None
                continue
            else:
                work, pushed, waiting = waiting, waiting_at, None
            runs += 1
            yield Row(ref=ref, run=runs, sha=work, pushed=pushed, started=at)
        self.state.update((runs, work, waiting, waiting_at, newest, newest_sha))

    def close(self) -> None:
        pass


def index_starts(events: DataFrame) -> DataFrame:
    """(ref, run, sha, pushed, started) of each run that the events of a stream or of a table start."""
    log = events.select("ref", "sha", F.unix_micros("at").alias("at"), "kind")
    runs = log.groupBy("ref").transformWithState(OneAtATime(), RUNS, "Append", "None")
    return runs.select("ref", "run", "sha", *[F.timestamp_micros(c).alias(c) for c in ("pushed", "started")])
