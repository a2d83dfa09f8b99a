"""Block ranges as a data source, batch and streaming, over a transport that can be replaced.

The transport ``files`` reads ``<path>/<height>.json`` (or what ``<path>/head`` names as the head), ``module:function``
names a callable ``(options, height or "head") -> str``. Options: ``chain_id``, ``start``, ``end``, ``batch`` (heights
in a partition, 100), ``finality_blocks``, ``maxBlocksPerTrigger``. In a batch, ``hashes`` (comma-separated) reads what
is stored under these names instead of heights, such as receipts of transactions; block_number is then null.

``missing`` says what becomes of heights and names that aren't there: ``row`` gives a row without an envelope, which
decoding puts among the bad ones (names get a column ``name``), ``fail`` fails the range, ``skip`` leaves them out. The
default is ``row`` for heights, which must be without gaps, and ``skip`` for names, of which some may not exist yet. A
batch without ``end`` fails if no head is there; a stream waits for one.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "chain_id string, block_number bigint, envelope string"


def fetch(options: dict, what: int | str) -> str | None:
    name = options.get("transport", "files")
    if name == "files":
        p = Path(options["path"]) / ("head" if what == "head" else f"{what}.json")
        return p.read_text() if p.exists() else None
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)(options, what)


class HashList(InputPartition):
    def __init__(self, hashes: list[str]):
        self.hashes = hashes


class HeightRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def ranges(start: int, end: int, batch: int) -> list[HeightRange]:
    return [HeightRange(a, min(a + batch - 1, end)) for a in range(start, end + 1, batch)]


def _rows(options: dict, part: HeightRange | HashList) -> Iterator[tuple]:
    named = isinstance(part, HashList)
    missing, chain = options.get("missing", "skip" if named else "row"), options.get("chain_id", "1")
    for what in part.hashes if named else range(part.start, part.end + 1):
        body = fetch(options, what)
        if body is None and missing == "fail":
            raise LookupError(f"chain {chain}: nothing at {what}")
        if body is not None or missing == "row":
            yield chain, None if named else what, body, *([what] if named and missing == "row" else [])


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[HeightRange] | list[HashList]:
        o = self.options
        if "hashes" in o:
            names, n = [h.strip() for h in o["hashes"].split(",") if h.strip()], int(o.get("batch", 100))
            return [HashList(names[k : k + n]) for k in range(0, len(names), n)]
        end = o.get("end") or fetch(o, "head")
        if end is None:
            raise LookupError("no head there and no option end")
        end = int(end)
        return ranges(int(o.get("start", 0)), end, int(o.get("batch", 100)))

    def read(self, partition: HeightRange) -> Iterator[tuple]:
        return _rows(self.options, partition)


class BlockStreamReader(DataSourceStreamReader):
    """Follows the head less ``finality_blocks``. The offset is the last height planned, kept in the checkpoint."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"height": int(self.options.get("start", 0)) - 1}

    def latestOffset(self) -> dict:
        o = self.options
        head = fetch(o, "head")
        final = max(int(head) - int(o.get("finality_blocks", 0)), -1) if head else -1
        if self.at is None:
            self.at = self.initialOffset()["height"]
        most = int(o.get("maxBlocksPerTrigger", 0))
        self.at = max(self.at, min(final, self.at + most) if most else final)
        return {"height": self.at}

    def partitions(self, start: dict, end: dict) -> list[HeightRange]:
        self.at = max(self.at if self.at is not None else -1, end["height"])
        return ranges(start["height"] + 1, end["height"], int(self.options.get("batch", 100)))

    def read(self, partition: HeightRange) -> Iterator[tuple]:
        return _rows(self.options, partition)


class BlockRangeSource(DataSource):
    """``spark.dataSource.register(BlockRangeSource)``, then ``spark.read.format("block_range")``."""

    @classmethod
    def name(cls) -> str:
        return "block_range"

    def schema(self) -> str:
        return SCHEMA + ", name string" * ("hashes" in self.options and self.options.get("missing") == "row")

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)

    def streamReader(self, schema) -> BlockStreamReader:
        return BlockStreamReader(self.options)
