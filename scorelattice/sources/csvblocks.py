"""CSV records of files that are read in blocks, quoted line ends included.

A line end ends a record only where the number of quote marks before it is even.
Every block of a file counts for itself: the parity of its marks, and how many
records begin in it if it starts outside quotes and if it starts inside.  Over the
few blocks of a file these compose from left to right, which tells for each block
where it starts and how many records lie before it.  So blocks are read side by side,
numbers are exact, and only records that lie across an edge of a block are gathered.

Quote marks are expected in quoted fields only, a mark within them doubled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import staged

_COUNTED = "file_path string, block long, marks long, n0 long, n1 long"
_CUT = "file_path string, block long, record_no long, part boolean, record string"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """The stretches of a batch that lie in one block."""
    files, blocks, n = batch.column(0), batch.column(1), batch.num_rows
    if n == 0:
        return
    change = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
    edges = (np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1).tolist()
    for a, b in zip([0, *edges], [*edges, n]):
        yield (files[a].as_py(), blocks[a].as_py()), a, b


def _odd_and_blank(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64) % 2
    return odd, pc.equal(pc.utf8_rtrim(lines, "\r"), "").to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its odd lines, and the records that begin in it if it starts outside or inside quotes."""
    at, marks, begun, rows = None, 0, [0, 0], []
    for batch in batches:
        odd, blank = _odd_and_blank(batch.column(2))
        for here, a, b in _runs(batch):
            if here != at:
                if at is not None:
                    rows.append((*at, marks, *begun))
                at, marks, begun = here, 0, [0, 0]
            before = (np.cumsum(odd[a:b]) - odd[a:b] + marks) % 2
            for start in (0, 1):
                begun[start] += int(np.count_nonzero((before == start) & ~blank[a:b]))
            marks += int(odd[a:b].sum())
    if at is not None:
        rows.append((*at, marks, *begun))
    names = ["file_path", "block", "marks", "n0", "n1"]
    yield pa.RecordBatch.from_pylist(
        [dict(zip(names, row)) for row in rows],
        pa.schema([("file_path", pa.string()), *[(n, pa.int64()) for n in names[1:]]]),
    )


class _Block:
    """Records of one block as its lines pass by; the open one is kept until it ends."""

    def __init__(self, here: tuple[str, int], start: int, before: int, marks: int, known: int) -> None:
        self.here, self.parity, self.no, self.expected = here, start, before - 1, (marks, before + known - 1)
        self.marks, self.open, self.part = 0, [], start == 1

    def _rows(self, numbers: np.ndarray, texts: pa.Array, part: bool) -> pa.RecordBatch:
        n = len(texts)
        columns = [
            pa.repeat(pa.scalar(self.here[0], pa.string()), n), pa.repeat(pa.scalar(self.here[1], pa.int64()), n),
            pa.array(numbers, pa.int64()), pa.repeat(pa.scalar(part), n), texts,
        ]
        return pa.RecordBatch.from_arrays(columns, names=["file_path", "block", "record_no", "part", "record"])

    def _close(self, part: bool) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self._rows(np.array([self.no]), pa.array(["\n".join(self.open)], pa.string()), part)
        self.open, self.part = [], False

    def add(self, lines: pa.Array, odd: np.ndarray, blank: np.ndarray) -> Iterator[pa.RecordBatch]:
        within = (np.cumsum(odd) - odd + self.parity) % 2 == 1
        self.marks += int(odd.sum())
        self.parity = int(self.parity + odd.sum()) % 2
        kept = within | ~blank
        lines, starts = lines.filter(pa.array(kept)), np.flatnonzero(~within[kept])
        first = int(starts[0]) if len(starts) else len(lines)
        self.open.extend(lines[:first].to_pylist())
        if len(starts) or not self.parity:
            yield from self._close(self.part)
        if not len(starts):
            return
        whole = starts if self.parity == 0 else starts[:-1]
        end = len(lines) if self.parity == 0 else int(starts[-1])
        if len(whole):
            body = lines[first:end]
            if len(whole) < len(body):
                offsets = pa.array(np.append(whole, end) - first, pa.int32())
                body = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays([body])), "\n")
            yield self._rows(np.arange(self.no + 1, self.no + 1 + len(whole)), body, False)
        self.no += len(starts)
        self.open = lines[end:].to_pylist()

    def end(self) -> Iterator[pa.RecordBatch]:
        if (self.marks, self.no) != self.expected:
            raise ValueError(f"{self.here[0]} changed while it was read")
        yield from self._close(True)


def _cut(edges: bool):
    """Records with their number; first ones and those in part over an edge of a block, or all others."""

    def chosen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            at_edge = pc.or_(batch.column(3), pc.equal(batch.column(2), 0))
            kept = batch.filter(at_edge if edges else pc.invert(at_edge))
            if kept.num_rows:
                yield kept

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            odd, blank = _odd_and_blank(batch.column(2))
            for here, a, b in _runs(batch):
                if block is None or block.here != here:
                    if block is not None:
                        yield from chosen(block.end())
                    block = _Block(here, *[batch.column(i)[a].as_py() for i in range(3, 7)])
                yield from chosen(block.add(batch.column(2)[a:b], odd[a:b], blank[a:b]))
        if block is not None:
            yield from chosen(block.end())

    return work


def csv_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records as in ``csv_records``: the few first ones of files and those over an edge of a block, stored, and all others.

    The lines are read once to count, once for the few and once for the others, and never
    shuffled.  A block that differs between readings fails the job.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    counted = staged(lines.mapInArrow(_count, _COUNTED))
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("start", F.pmod(F.coalesce(F.sum("marks").over(earlier), F.lit(0)), F.lit(2)))
    known = F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1"))
    placed = staged(
        starts.select(
            "file_path", "block", "start", F.coalesce(F.sum(known).over(earlier), F.lit(0)).alias("before"), "marks", known.alias("known")
        )
    )
    # One row a block; broadcast, as a shuffle would not keep the lines in their order.
    read = lines.join(F.broadcast(placed), ["file_path", "block"]).select("file_path", "block", "line", "start", "before", "marks", "known")
    pieces = read.mapInArrow(_cut(True), _CUT).groupBy("file_path", "record_no").agg(
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts")
    )
    few = staged(pieces.select("file_path", "record_no", F.rtrim(F.array_join("parts.record", "\n"), F.lit("\r")).alias("record")))
    others = read.mapInArrow(_cut(False), _CUT).select("file_path", "record_no", F.rtrim("record", F.lit("\r")).alias("record"))
    return few, others


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, record_no, record): the text of every record and its 0-based number in its file.

    Blank lines outside quotes are no records and have no number.  A quote that is
    never closed makes the rest of its file one record.
    """
    few, others = csv_split(spark, path)
    return others.unionByName(few)
