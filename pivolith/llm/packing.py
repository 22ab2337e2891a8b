"""Best-fit packing with large-item matching.

A document's ids (with a closing id) are cut into pieces; only documents longer than a
sequence are cut, into full pieces, with the remainder as the first piece. A full piece is a
sequence of its own. The rest is bin packing of integers from 1 to the capacity, so the whole
problem is a histogram of at most `capacity` counts, whatever the number of documents:

* plan(): items above a third of the capacity can share a bin at most in pairs; the largest
  first, each takes the largest partner that fits. Then smaller items, the largest first, go
  where the gap is smallest; what fits nowhere opens new bins. Bins with the same content are
  handled together, with a count, so the work is bounded by the capacity, not by the data.
* pack(): each document gets its rank among those of its length; the plan turns a length and
  a rank into a sequence and an offset. Ranks are made within (length, salt), and the
  counts of those groups, at most capacity * salts rows, are all that the driver sees.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pivolith.llm.common import batches_of_rows, release, ship, written

#: Groups that a length is dealt to, so that no task holds one frequent length.
SALTS = 64


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths of the items in order, number of such bins)."""
    left = Counter({n: c for n, c in counts.items() if c})
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    bins: Counter[tuple[int, ...]] = Counter()
    for n in large:
        for m in large:
            if not left[n]:
                break
            if m > n or n + m > capacity:
                continue
            pairs = left[n] // 2 if m == n else min(left[n], left[m])
            if pairs:
                bins[n, m] += pairs
                left[n] -= pairs
                left[m] -= pairs
        if left[n]:
            bins[n,] += left[n]
            left[n] = 0
    by_gap: dict[int, Counter] = defaultdict(Counter)
    for b, c in bins.items():
        by_gap[capacity - sum(b)][b] += c
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            gap = next((g for g in range(n, capacity + 1) if by_gap.get(g)), None)
            if gap is None:
                fit = capacity // n
                full, rest = divmod(left[n], fit)
                if full:
                    by_gap[capacity - fit * n][(n,) * fit] += full
                if rest:
                    by_gap[capacity - rest * n][(n,) * rest] += 1
                left[n] = 0
                break
            for b in sorted(by_gap[gap]):
                # a bin goes on taking items of this length while it has the tightest gap
                most = gap // n
                while most > 1 and any(by_gap.get(g) for g in range(n, gap - n * (most - 1))):
                    most -= 1
                take = min(by_gap[gap][b], left[n] // most)
                if not take:
                    most, take = left[n], 1
                by_gap[gap][b] -= take
                if not by_gap[gap][b]:
                    del by_gap[gap][b]
                by_gap[gap - most * n][b + (n,) * most] += take
                left[n] -= take * most
                break
    return [(b, c) for g in sorted(by_gap) for b, c in sorted(by_gap[g].items()) if c]


class Slots:
    """The plan by length: which ranks go to which run of bins, and where in a bin."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]) -> None:
        slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.bins = 0
        for items, copies in bins:
            at = 0
            for n in items:
                slots[n].append((copies, self.bins, at))
                at += n
            self.bins += copies
        self.by_length = {}
        for n, runs in slots.items():
            copies, first, at = (np.array(x, dtype=np.int64) for x in zip(*runs, strict=True))
            ends = np.cumsum(copies)
            self.by_length[n] = (ends, first - (ends - copies), at)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of items, given their length and their rank in it, from 0."""
        bin_, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            ends, shift, at = self.by_length[int(n)]
            own = length == n
            run = np.searchsorted(ends, rank[own], side="right")
            bin_[own], offset[own] = shift[run] + rank[own], at[run]
        return bin_, offset


_CODECS: dict[str, object] = {}


def fast_codec(vocabulary: str):
    """A function from a text to its ids: the file's vocabulary as ranks in tiktoken, where its
    ids are in merge order and so give the same result; the trie encoder otherwise."""
    if vocabulary not in _CODECS:
        from pivolith.llm.bpe import PRETOKEN, Encoder, encoder

        enc = Encoder(vocabulary)  # not kept: a worker that only packs holds one vocabulary
        slow = lambda text: list(memoryview(encoder(vocabulary).encode([text])[0]).cast("I"))
        order = sorted(enc.rank, key=enc.rank.__getitem__)
        merged = [enc.ids[enc.bytes_of[a] + enc.bytes_of[b]] for a, b in order]
        if merged != sorted(set(merged)) or set(merged) | {enc.ids[bytes([b])] for b in range(256)} != set(enc.ids.values()) or merged[0] < 256:
            _CODECS[vocabulary] = slow
        else:
            import tiktoken

            ranks = tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=enc.ids, special_tokens=enc.added)

            def fast(text: str) -> list[int]:
                try:
                    return ranks.encode(text, allowed_special="all")
                except Exception:  # its pattern engine gives up on very long runs of white space
                    return slow(text)

            _CODECS[vocabulary] = fast
    return _CODECS[vocabulary]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _cut_documents(docs: DataFrame, vocabulary: str, capacity: int, closing_id: int, key: str, text: str, ids: bool) -> DataFrame:
    """A row for each document: n ids, a checksum for each piece, and the ids if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_codec(vocabulary)
        for whole in batches:
            for batch in batches_of_rows(whole):
                n, sums, kept = [], [], []
                for t in batch.column(1).to_pylist():
                    own = np.array([*encode(t or ""), closing_id], dtype="<u4")
                    n.append(len(own))
                    sums.append([zlib.crc32(own[s : s + m]) for s, m in cut(len(own), capacity)])
                    kept.append(own.astype(np.int32))
                cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.list_(pa.int32()))] if ids else [])], names)
        release()

    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_ids", "sums", *["ids"] * ids]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_ids long, sums array<long>" + ", ids array<int>" * ids)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, closing_id: int = 2, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` ids.

    Returns a row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset, and
    with ids=True the piece's ids. A null or empty text is a document of just the closing id.
    Rows with the same key are documents of their own, so a repeated row is packed
    twice. Ties in length are ordered by key. An empty table gives no pieces. Columns other than
    key and text are not read. The driver sees at most capacity * SALTS counts.
    """
    ship(docs.sparkSession)
    rows = written(_cut_documents(docs, vocabulary, capacity, closing_id, key, text, ids))
    items = rows.select(
        "*",
        ((F.col("n_ids") - 1) % capacity + 1).cast("int").alias("first"),
        F.floor((F.col("n_ids") - 1) / capacity).cast("long").alias("full"),
        F.pmod(F.xxhash64(key, "n_ids"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    groups = items.groupBy("first", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()
    totals: Counter[int] = Counter()
    before: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    n_full = 0
    for g in sorted(groups, key=lambda g: (g["first"], g["salt"])):
        before[g["first"]][g["salt"]] = (totals[g["first"]], n_full)
        totals[g["first"]] += g["n"]
        n_full += g["full"]
    slots = Slots(plan(totals, capacity))
    own = Window.partitionBy("first", "salt").orderBy(F.col(key).asc_nulls_first(), "n_ids", "sums")
    ranked = items.select("*", (F.row_number().over(own) - 1).alias("rank"), (F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")).alias("full_before"))
    kind = docs.schema[key].dataType.simpleString()
    columns = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            first, salt, rank, earlier, n = (col[c].to_numpy(zero_copy_only=False) for c in ("first", "salt", "rank", "full_before", "n_ids"))
            start = [before[int(f)][int(s)] for f, s in zip(first, salt, strict=True)]
            bins, at = slots.place(first, rank + np.array([s[0] for s in start]))
            spare = slots.bins + earlier + np.array([s[1] for s in start])
            pieces = (n - first) // capacity + 1
            of = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = piece == 0
            begin = np.where(head, 0, first[of] + (piece - 1) * capacity)
            length = np.where(head, first[of], capacity)
            made = {
                key: col[key].take(pa.array(of)), "piece": pa.array(piece, pa.int32()), "start": pa.array(begin, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": col["sums"].flatten(), "sequence_id": pa.array(np.where(head, bins[of], spare[of] + piece - 1), pa.int64()), "offset": pa.array(np.where(head, at[of], 0), pa.int64()),
            }
            if ids:
                flat, shift = col["ids"].flatten().to_numpy(), np.repeat(np.cumsum(n) - n, pieces)
                made["ids"] = pa.array([flat[s : s + m] for s, m in zip(shift + begin, length, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([made[c] for c in columns], columns)

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * ids
    return ranked.mapInArrow(run, schema)
