"""A change journal as a streaming source with a cursor: a restart goes on at the next number, a new journal asks for reconciliation.

A journal is a folder that the executors share: `state.json` names the journal, its first and its next number, and
files `<first>-<next>.usn` hold packed records, a range each. Offsets are (journal, number); they live in the query's
checkpoint. A query that begins sees what comes from then on, unless `from` is `first`. If the journal was made anew,
or what the cursor asks for is gone, one row of kind `reconcile` says so and the cursor goes on from the new journal's
next number, as all files have to be looked at then.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "kind string, journal bigint, usn bigint, file_reference decimal(20,0), parent_reference decimal(20,0), reason bigint, file_name string"


class Part(InputPartition):
    def __init__(self, kind: str, journal: int, start: int, end: int, path: str | None = None):
        self.kind, self.journal, self.start, self.end, self.path = kind, journal, start, end, path


class JournalReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.first = options["path"].removeprefix("file://"), options.get("from", "now") == "first"

    def _state(self) -> dict:
        with open(f"{self.folder}/state.json") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        s = self._state()
        return {"journal": s["journal"], "usn": s["first"] if self.first else s["next"]}

    def latestOffset(self) -> dict:
        s = self._state()
        return {"journal": s["journal"], "usn": s["next"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        import os

        files = []
        for name in os.listdir(self.folder):
            stem, _, ending = name.rpartition(".")
            if ending == "usn" and stem.startswith(f"{end['journal']}_"):
                low, high = map(int, stem.partition("_")[2].split("-"))
                files.append((low, high, f"{self.folder}/{name}"))
        # the cursor's own number has to be there, unless nothing came after it
        held = start["journal"] == end["journal"] and (start["usn"] >= end["usn"] or any(low <= start["usn"] < high for low, high, _ in files))
        if not held:
            return [Part("reconcile", end["journal"], end["usn"], end["usn"])]
        return [Part("record", end["journal"], max(low, start["usn"]), min(high, end["usn"]), path) for low, high, path in sorted(files) if low < end["usn"] and high > start["usn"]]

    def read(self, partition: Part) -> Iterator[tuple]:
        from decimal import Decimal

        from stratalog.sources.parsers import usn_records

        if partition.kind == "reconcile":
            yield "reconcile", partition.journal, partition.end, None, None, None, None
            return
        with open(partition.path, "rb") as f:
            for usn, file, parent, reason, name in usn_records(f.read()):
                if partition.start <= usn < partition.end:
                    yield "record", partition.journal, usn, Decimal(file), Decimal(parent), reason, name

    def commit(self, end: dict) -> None:
        """Nothing: the checkpoint holds the cursor, and the journal's owner drops what is old."""


class JournalSource(DataSource):
    """spark.readStream.format("change_journal").load(folder), after `register`."""

    @classmethod
    def name(cls) -> str:
        return "change_journal"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> JournalReader:
        return JournalReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JournalSource)
