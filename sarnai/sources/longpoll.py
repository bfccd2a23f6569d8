"""A long-poll event source as a streaming data source.

``spark.readStream.format("long_poll").option("connect", "module:function")``; the function gives a client with
``server()`` -> {server, key, ts} and ``check(server, key, ts, wait)`` -> the answer. The stream begins at the
server's position, so what came before is skipped; Spark's checkpoint holds the position, so a restart resumes there.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

FIRST_PAUSE, LONGEST_PAUSE = 1.0, 60.0


class LongPoll:
    """One poll at a time. An expired position is replaced, an expired key renewed, a broken connection tried again."""

    def __init__(self, client, wait: int = 25, sleep: Callable[[float], None] = time.sleep):
        self.client, self.wait, self.sleep, self.at, self.pause = client, wait, sleep, None, FIRST_PAUSE

    def position(self):
        if self.at is None:
            self.at = self.client.server()
        return self.at["ts"]

    def poll(self, ts) -> tuple[list[dict], object]:
        """(updates, next position); no updates when the answer only moves or renews."""
        self.position()
        try:
            answer = self.client.check(self.at["server"], self.at["key"], ts, self.wait)
        except (OSError, ValueError):
            self.sleep(self.pause)
            self.pause = min(2 * self.pause, LONGEST_PAUSE)
            return [], ts
        self.pause = FIRST_PAUSE
        match answer.get("failed"):
            case None | 0:
                return answer.get("updates", []), answer.get("ts", ts)
            case 1:
                return [], answer["ts"]
            case 2 | 3 as code:
                self.at = self.client.server()
                return [], self.at["ts"] if code == 3 else ts
            case _:
                self.sleep(FIRST_PAUSE)
                return [], ts


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        module, name = options["connect"].split(":")
        self.source = LongPoll(getattr(importlib.import_module(module), name)(), int(options.get("wait", 25)))
        self.answers: dict = {}  # position -> updates from there, next position; in the order read

    def initialOffset(self) -> dict:
        return {"ts": self.source.position()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        updates, ts = self.source.poll(start["ts"])
        self.answers[start["ts"]] = (updates, ts)
        return self._rows(updates), {"ts": ts}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A replayed batch: the answers it was made of; after a restart, what the server still holds of that range. Positions
        count updates, so what came after the end is cut off; it belongs to the next batch."""
        at, out = start["ts"], []
        while at != end["ts"] and at in self.answers:
            updates, at = self.answers[at]
            out += updates
        if at != end["ts"]:
            updates, _ = self.source.poll(at)
            numbered = str(at).isdigit() and str(end["ts"]).isdigit()
            out += updates[: int(end["ts"]) - int(at)] if numbered else updates
        return self._rows(out)

    def commit(self, end: dict) -> None:
        """Answers before a committed position are not asked for again."""
        at = next((k for k, (_, after) in self.answers.items() if after == end["ts"]), None)
        for k in list(self.answers):
            if at is None or k == end["ts"]:
                break
            del self.answers[k]
            if k == at:
                break

    @staticmethod
    def _rows(updates: list[dict]) -> Iterator[tuple]:
        return iter([(u.get("type"), json.dumps(u.get("object"), ensure_ascii=False)) for u in updates])


class LongPollSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "long_poll"

    def schema(self) -> str:
        return "type string, object string"

    def simpleStreamReader(self, schema: StructType) -> Reader:
        return Reader(self.options)
