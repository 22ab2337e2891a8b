"""All pairs within buckets, dealt out in blocks so that no task holds a large bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pivolith.llm.common import written

#: Rows of a block.
BLOCK = 256


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of rows sorted by cell (the first three columns): tables that hold whole cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, c = (batch.column(i).to_numpy() for i in range(3))
        new = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])) + 1
        edge = [x.column(i)[x.num_rows - 1].as_py() for x in held[-1:] for i in range(3)]
        if held and edge != [a[0], b[0], c[0]]:
            new = np.concatenate([[0], new])
        if len(new):
            cut = int(new[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def counted(rows: DataFrame) -> DataFrame:
    """(key, _n) of the keys with several rows, as a table, so that a large key's join can be split."""
    return written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows with the columns key, id and _n (rows of the key), dealt to cells (key, i, j): a key's rows fall into
    blocks by a hash of id, and each pair of blocks is a cell. A key of one block is one cell."""
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    kept = [c for c in rows.columns if c not in ("key", "_n")]
    own = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    each = rows.select("key", *kept, own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    dealt = each.select("key", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), *kept, "block")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs that meet in a cell: all pairs in one block's cell, else those across."""
    cell = [table.column(c).to_numpy() for c in ("key", "i", "j")]
    block = table.column("block").to_numpy()
    for step in range(1, table.num_rows):
        same = np.ones(table.num_rows - step, bool)
        for x in cell:
            same &= x[step:] == x[:-step]
        if not same.any():
            return
        a = np.flatnonzero(same)
        b = a + step
        across = (cell[1][a] == cell[2][a]) | (block[a] != block[b])
        yield a[across], b[across]


def in_blocks_across(rows: DataFrame) -> DataFrame:
    """rows with the columns key, id and component, dealt to cells so that each pair of one key and two
    components meets once. The largest component of a key only has to meet the others: its rows are
    dealt to blocks and meet each block of the others; the others meet among themselves."""
    counts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    top = written(counts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("_n")).where("_n > top.c"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    own = lambda b: F.pmod(F.xxhash64("id"), b.cast("long")).cast("int")
    most, few = blocks(F.col("top.c")), blocks(F.col("_n") - F.col("top.c"))
    is_top = F.col("component") == F.col("top.component")
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    of_top = F.transform(F.sequence(F.lit(0), few - 1), lambda j: cell(own(most), j))
    of_few = F.concat(
        F.transform(F.sequence(F.lit(0), most - 1), lambda i: cell(i, own(few))),
        F.transform(F.sequence(F.lit(0), few - 1), lambda j: cell(-1 - F.least(j, own(few)), F.greatest(j, own(few)))),
    )
    kept = [c for c in rows.columns if c != "key"]
    each = rows.join(top, "key").select("key", *kept, F.when(is_top, -1).otherwise(own(few)).alias("block"), F.explode(F.when(is_top, of_top).otherwise(of_few)).alias("_cell"))
    return each.select("key", "_cell.i", "_cell.j", *kept, "block").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def pairs_across(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of two components that meet in a cell of in_blocks_across()."""
    cell = [table.column(c).to_numpy() for c in ("key", "i", "j")]
    block, component = (table.column(c).to_numpy() for c in ("block", "component"))
    for step in range(1, table.num_rows):
        same = component[step:] != component[:-step]
        alike = np.ones(len(same), bool)
        for x in cell:
            alike &= x[step:] == x[:-step]
        if not alike.any():
            return
        a = np.flatnonzero(same & alike)
        b = a + step
        mixed = (block[a] == -1) != (block[b] == -1)
        meet = np.where(cell[1][a] >= 0, mixed, (cell[1][a] == -1 - cell[2][a]) | (block[a] != block[b]))
        yield a[meet], b[meet]
