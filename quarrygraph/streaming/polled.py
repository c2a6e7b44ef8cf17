"""A polled table as a streaming source: what a (cursor, key) offset has not seen yet, read in slices.

The table is a folder of Parquet files that grows elsewhere. Its offset is the greatest cursor, and the greatest key of
that cursor. A pull reads every row up to the new offset whose cursor lies past the last one less an
overlap, since rows of close cursors may be committed late; an upsert by key takes up what comes twice.
Row groups are told by their statistics, so a pull opens those alone that may hold rows of it, and
tasks share them. Rows of a null cursor come with the first pull only, as nothing can tell that they are new.

    spark.dataSource.register(PolledTable)
    spark.readStream.format("polled_table").option("path", folder).option("cursor", "ts").option("key", "id").load()

Further options: columns (comma-separated, all by default), overlap (in the cursor's own unit, microseconds for times; two
minutes by default), slices (the most tasks of a pull, 32 by default).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

OVERLAP = 120_000_000
BATCH = 5_000


def _table(folder: str) -> ds.Dataset:
    """The files that stand in a folder now; those being written, which Spark hides, are left out."""
    if "://" in folder or folder.startswith("file:"):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
        return ds.dataset(folder, format="parquet", filesystem=system)
    return ds.dataset(folder, format="parquet")


def _known(kind: pa.DataType) -> pa.DataType:
    """The type as Spark takes it: times by the microsecond."""
    return pa.timestamp("us", kind.tz) if pa.types.is_timestamp(kind) else kind


def number(column: pa.Array) -> pa.Array:
    """A cursor or key as whole numbers, times as microseconds."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(_known(column.type), safe=False)
    return column.cast(pa.int64())


@dataclass
class Slice(InputPartition):
    """Row groups of files, with the bounds of the pull: above `low` or of any cursor if that is None, up to (cursor, key)."""

    parts: list[tuple[str, int]]
    low: int | None
    cursor: int
    key: int


class PolledReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.cursor, self.key = options["path"], options["cursor"], options["key"]
        self.overlap, self.slices = int(options.get("overlap", OVERLAP)), int(options.get("slices", 32))
        self.names = schema.fieldNames()

    def _groups(self) -> Iterator[tuple[str, int, int | None, int | None]]:
        """(file, row group, least and greatest cursor, or None where statistics don't tell)."""
        for fragment in _table(self.path).get_fragments():
            kind, meta = fragment.physical_schema.field(self.cursor).type, fragment.metadata
            place = [meta.schema.column(j).path for j in range(meta.num_columns)].index(self.cursor)
            for group in fragment.row_groups:
                column = meta.row_group(group.id).column(place)
                told = column.physical_type != "INT96" and column.is_stats_set and column.statistics.has_min_max  # the old format of times has none
                bounds = number(pa.array([column.statistics.min, column.statistics.max], kind)).to_pylist() if told else [None, None]
                yield fragment.path, group.id, *bounds

    def _rows(self, path: str, group: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
        dataset = _table(self.path)
        fragment = dataset.format.make_fragment(path, dataset.filesystem, row_groups=[group])
        yield from fragment.to_batches(schema=dataset.schema, columns=columns, batch_size=BATCH)

    def initialOffset(self) -> dict:
        return {"cursor": None, "key": None}

    def latestOffset(self) -> dict:
        groups = list(self._groups())
        tops = [top for _, _, _, top in groups if top is not None]
        best: tuple[int, int] | None = None
        for path, group, _, top in groups:  # only the row groups that may hold the greatest cursor are read
            if top is not None and top < max(tops):
                continue
            for batch in self._rows(path, group, [self.cursor, self.key]):
                cursor, key = number(batch.column(0)), number(batch.column(1))
                high = pc.max(cursor).as_py()
                if high is not None and (best is None or high >= best[0]):
                    at = (high, pc.max(key.filter(pc.equal(cursor, high))).as_py() or 0)
                    best = at if best is None else max(best, at)
        return {"cursor": best[0], "key": best[1]} if best else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["cursor"] is None or start == end:
            return []
        low = None if start["cursor"] is None else start["cursor"] - self.overlap
        due = [(path, group) for path, group, least, top in self._groups() if (low is None or top is None or top > low) and (least is None or least <= end["cursor"])]
        n = min(self.slices, len(due))
        return [Slice(due[i::n], low, end["cursor"], end["key"]) for i in range(n)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        wanted = list(dict.fromkeys([*self.names, self.cursor, self.key]))
        for path, group in partition.parts:
            for batch in self._rows(path, group, wanted):
                cursor, key = number(batch.column(self.cursor)), number(batch.column(self.key))
                upto = pc.or_kleene(pc.less(cursor, partition.cursor), pc.and_kleene(pc.equal(cursor, partition.cursor), pc.less_equal(key, partition.key)))
                due = pc.fill_null(upto, partition.low is None)
                if partition.low is not None:
                    due = pc.and_(due, pc.fill_null(pc.greater(cursor, partition.low), False))
                kept = batch.filter(due).select(self.names)
                if kept.num_rows:
                    columns = [c.cast(_known(c.type), safe=False) for c in kept.columns]
                    yield pa.RecordBatch.from_arrays(columns, self.names)


class PolledTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polled_table"

    def schema(self) -> StructType:
        """The allowed columns as the source has them now; one that it lacks is an error."""
        found = _table(self.options["path"]).schema
        names = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else found.names
        lacking = [c for c in names if c not in found.names]
        if lacking:
            raise ValueError(f"columns not on source: {', '.join(lacking)}")
        return from_arrow_schema(pa.schema([pa.field(c, _known(found.field(c).type)) for c in names]))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PolledReader(dict(self.options), schema)
