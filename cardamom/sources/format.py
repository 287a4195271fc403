"""``spark.read.format("cards")``: the lines of card files as a table, with filters on file, line and tag taken into the source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from cardamom.sources import store
from cardamom.sources.cards import RANGE, TASK_BYTES, WIDTH
from cardamom.sources.parse import tag_names

LINES = "file string, line_no long, tag string, bytes binary"


@dataclass
class Lines(InputPartition):
    """Lines first to last of a file; of these the ones with one of the tags."""

    file: str
    first: int
    last: int
    tags: tuple[str, ...] | None


class CardReader(DataSourceReader):
    """Files are listed without being read. A filter on file drops files, one on line_no cuts ranges, one on tag is decided before lines leave Python."""

    def __init__(self, path: str, lenient: bool):
        self.path, self.lenient = path, lenient
        self.files: set[str] | None = None
        self.tags: set[str] | None = None
        self.low, self.high = 1, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        both = lambda own, more: set(more) if own is None else own & set(more)
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in ("file", "tag") and isinstance(f, EqualTo | In):
                values = f.value if isinstance(f, In) else (f.value,)
                setattr(self, f"{name}s", both(getattr(self, f"{name}s"), values))
            elif name == "line_no" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = store.opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        found = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        out: list[InputPartition] = []
        for f in sorted(found, key=lambda f: f.path):
            name = self.path.rstrip("/") + f.path[len(root.rstrip("/")) :]
            if self.files is not None and name not in self.files:
                continue
            if f.size % WIDTH and not self.lenient:
                raise ValueError(f"{name}: {f.size} bytes are no multiple of {WIDTH}")
            first, last = max(1, self.low), min(f.size // WIDTH, self.high)
            step = TASK_BYTES // WIDTH
            out += [Lines(name, a, min(a + step - 1, last), None if self.tags is None else tuple(sorted(self.tags))) for a in range(first, last + 1, step)]
        return out

    def read(self, part: Lines) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark asks for where there are no partitions
            return
        wanted = None if part.tags is None else [int.from_bytes(b, "big") for t in part.tags if len(b := t.encode("latin-1", "replace")) == 2]
        system, name = store.opened(part.file)
        with system.open_input_file(name) as source:
            for a in range(part.first, part.last + 1, RANGE):
                n = min(RANGE, part.last - a + 1)
                raw = source.read_at(n * WIDTH, (a - 1) * WIDTH)
                if len(raw) != n * WIDTH:
                    raise OSError(f"{part.file}: ends before line {a + n - 1}")
                m = np.frombuffer(raw, np.uint8).reshape(n, WIDTH)
                at = np.arange(n) if wanted is None else np.flatnonzero(np.isin(m[:, 0].astype(np.int64) << 8 | m[:, 1], wanted))
                m = np.ascontiguousarray(m[at])
                cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(at), [None, pa.py_buffer(m)]).cast(pa.binary())
                tags = tag_names(m[:, 0].astype(np.uint16) << 8 | m[:, 1])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part.file, pa.string()), len(at)), pa.array(a + at), tags, cells], names=["file", "line_no", "tag", "bytes"])


class CardSource(DataSource):
    """Options: path (of load), lenient: files that end inside a line are read up to there."""

    @classmethod
    def name(cls) -> str:
        return "cards"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> CardReader:
        return CardReader(self.options["path"], self.options.get("lenient", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CardSource)
