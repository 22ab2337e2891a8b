"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of the rotated coordinates make a
balanced code with little quantisation error; several rotations, from different starts, give as many bits
as are needed. The code is cut into chunks, one for each Hamming table, and a vector stands under its
chunk in each: by the pigeonhole principle codes that differ in fewer bits than there are tables share a chunk. A chunk
is SPARE bits wider than the logarithm of the number of vectors, which keeps buckets short at every
size; the number of tables follows from how often bits of sampled vectors turned by the threshold's angle differ,
so that a pair just at the threshold is missed with a chance of at most `miss`. Each length of
vectors has its own codes; a length with few vectors is one bucket.

Keys travel with ids alone. Only members of buckets with several get their codes, and pairs whose codes are
close name the buckets worth looking into; only for these the vectors are fetched, and all pairs in a bucket are
reranked by the cosine of the original vectors. A pair is counted in the first bucket that it shares. Buckets are
dealt out in blocks, and a block returns for each vector its number of links and one representative of its
component, never the pairs, so large groups cost arithmetic but no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pivolith.llm.blocks import cells, counted, in_blocks, pairs
from pivolith.llm.common import batches_of_rows, forget, ship, written
from pivolith.llm.components import components
from pivolith.llm.neardup import mix

#: Rows of a length that the rotations are learned on, and as many that they are measured on, about.
SAMPLE = 4096
#: Keys of a vector at most (and no more than vectors, but 256); chunks get shorter before there are more.
KEYS = 512
#: Bits of a chunk beyond the logarithm of the count: one in 2 ** SPARE vectors meets a chance neighbour in a table.
SPARE = 3
#: Vectors of a length that meet in one bucket, without codes.
FEW = 256
#: Rows of a cell from which its cosines are one product of matrices, and pairs looked at together.
WIDE, TOGETHER = 24, 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Together:
    """Codes of a length with few vectors: one table with one bucket."""

    tables, most = 1, 0

    def chunks(self, vectors: np.ndarray) -> np.ndarray:
        return np.zeros((len(vectors), 1), np.uint32)


class Codes:
    """Rotations learned by iterative quantisation, and how codes are cut into tables."""

    def __init__(self, sample: np.ndarray, count: int, cosine: float, miss: float, rounds: int = 15, probe: np.ndarray | None = None) -> None:
        """Planned for hyperplanes through the origin, then measured: the codes cut around the sample's mean, where
        angles are larger, so tables are added until at most `miss` of the pairs made of probe (by default
        the sample) don't meet. If that takes too many keys, chunks get shorter, down to one bit, where all meet."""
        self.dims, self.rounds = sample.shape[1], rounds
        self.mean = sample.mean(0) if len(sample) else np.zeros(self.dims)
        flip = math.acos(min(1.0, cosine)) / math.pi
        self._x, self._rnd, self._parts = sample - self.mean, np.random.default_rng(11), np.zeros((self.dims, 0))
        tests = [(a - self.mean, b - self.mean) for a, b in self.turned(sample if probe is None else probe, cosine)]
        for self.width in range(min(32, max(8, math.ceil(math.log2(max(2, count))) + SPARE)), 0, -1):
            meet = (1 - flip) ** self.width
            self.tables = max(1, math.ceil(math.log(miss) / math.log(1 - meet))) if meet < 1 else 1
            while self.width == 1 or self.tables <= min(KEYS, max(256, count)):
                bits = self.width * self.tables
                self.turn = self.rotations(bits)
                cut = [tuple(np.concatenate([self._cut(x[i : i + 512]) for i in range(0, len(x), 512)]) for x in pair) for pair in tests]
                apart = [distance(a, b) for a, b in cut]
                self.most = max([math.ceil(bits * flip + 5 * math.sqrt(bits * flip * (1 - flip))), *[math.ceil(d.mean() + 5 * d.std()) for d in apart]])
                lost = max([(~self.meet(a, b)).mean() for a, b in cut], default=0.0)
                if self.width == 1 or lost <= miss:
                    del self._x, self._rnd, self._parts
                    return
                # as many more as tables that missed pairs independently of each other would need
                self.tables = max(self.tables + math.ceil(self.tables / 8), math.ceil(self.tables * math.log(miss) / math.log(min(lost, 0.999))))

    def turned(self, vectors: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Unit vectors and others at just the cosine: turned anywhere, and towards or away from one another."""
        if len(vectors) < 2 or self.dims < 2:
            return []
        rnd, out = np.random.default_rng(12), []
        for to in (rnd.standard_normal(vectors.shape), (np.roll(vectors, 1, 0) - self.mean) * rnd.choice([-1.0, 1.0], (len(vectors), 1))):
            side = to - (to * vectors).sum(1, keepdims=True) * vectors
            size = np.linalg.norm(side, axis=1)
            some = size > 1e-9
            x = vectors[some]
            if len(x):
                out.append((x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * side[some] / size[some, None]))
        return out

    def rotations(self, bits: int) -> np.ndarray:
        """The first columns of the learned rotations, learned as far as they are needed."""
        while self._parts.shape[1] < bits:
            r = np.linalg.qr(self._rnd.standard_normal((self.dims, self.dims)))[0]
            for _ in range(self.rounds if len(self._x) else 0):
                u, _, v = np.linalg.svd(np.where(self._x @ r >= 0, 1.0, -1.0).T @ self._x)
                r = (u @ v).T
            self._parts = np.hstack([self._parts, r])
        return self._parts[:, :bits].copy()

    def _cut(self, centred: np.ndarray) -> np.ndarray:
        bits = (centred @ self.turn >= 0).reshape(len(centred), self.tables, self.width)
        return (bits.astype(np.uint32) << np.arange(self.width, dtype=np.uint32)).sum(2, dtype=np.uint32)

    def chunks(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each vector, a 32-bit number for each table."""
        return self._cut(vectors - self.mean)

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of vectors with these chunks are found."""
        return (a == b).any(1) & (distance(a, b) <= self.most)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def keys(chunks: np.ndarray, dims: int) -> np.ndarray:
    """For each vector of a length its keys; a key's last ten bits are its table's number."""
    table = np.arange(chunks.shape[1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (mix(chunks.astype(np.uint64) + (table << np.uint64(32)) + mix(np.array([dims], np.uint64))) << np.uint64(10)) | table


def first(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the key is the first that pairs of vectors with chunks a and b share."""
    return (a == b).argmax(1) == key & 1023


def near_vectors(vectors: DataFrame, cosine: float = 0.95, miss: float = 0.005, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per vector: key, n_links (other vectors at this cosine or above, in double precision),
    component_id (the smallest key that links reach) and kept (it is the own one).

    Null and empty vectors, zero vectors and ones with a null or non-finite component are linked with nothing;
    vectors of different lengths have no cosine. Every link counted is exact; one at the threshold is
    missed with a chance of at most `miss`, as measured on sampled vectors. Equal vectors are one row in the search and
    count as often as they occur; rows with the same key are vectors of their own with a common
    component. A null key takes no part: no links, no component. An empty table gives an empty one; columns other than
    key and embedding aren't read. The driver sees a count for each length, and of lengths with more than FEW
    vectors a sample of some 2 * SAMPLE.
    """
    spark = vectors.sparkSession
    ship(spark)
    value = F.col(f"`{embedding}`").cast("array<double>")
    odd = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), value.alias("v"), F.coalesce(~odd & F.exists(value, lambda x: x != 0), F.lit(False)).alias("good"))
    good = rows.where("good and id is not null")
    # -0.0 and 0.0 are one value to groupBy() as to the cosine
    classes = written(good.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("d", F.size("v")))
    counts = {r["d"]: r["count"] for r in classes.groupBy("d").count().collect()}
    codes: dict[int, Codes | Together] = {d: Together() for d in counts}
    for d, count in sorted(counts.items()):
        if count > FEW:  # a stretch of the hash, so that no task sees more than its own rows
            part = classes.where((F.col("d") == d) & (F.pmod(F.xxhash64("id", F.lit(d)), F.lit(count)) < 2 * SAMPLE)).select("id", "v").limit(3 * SAMPLE).collect()
            known = unit(np.array([r["v"] for r in sorted(part, key=lambda r: r["id"])]))[np.random.default_rng(7).permutation(len(part))]
            codes[d] = Codes(known[:SAMPLE], count, cosine, miss, probe=known[-SAMPLE:])  # measured on others than those learned from, if there are

    def by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for d in np.unique(lengths):
            yield int(d), np.flatnonzero(lengths == d)

    def matrix(column: pa.Array, d: int) -> np.ndarray:
        return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of_rows(whole, 512):
                for d, at in by_length(batch.column(2).to_numpy()):
                    own = batch.take(pa.array(at))
                    chunk = codes[d].chunks(matrix(own.column(1), d))
                    made = keys(chunk, d).view(np.int64)
                    raw = np.ascontiguousarray(chunk)
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array([c.tobytes() for c in raw], pa.binary()), pa.array(list(made), pa.list_(pa.int64()))], ["id", "d", "code", "keys"])

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in cells(batches):
            for d, at in by_length(every.column("d").to_numpy()):
                table = every.take(pa.array(at))
                own, hit, key_ = codes[d], np.zeros(table.num_rows, bool), table.column("key").to_numpy()
                code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint32).reshape(-1, own.tables)
                for x, y in pairs(table):
                    for s in range(0, len(x), TOGETHER):
                        a, b = x[s : s + TOGETHER], y[s : s + TOGETHER]
                        near = (distance(code[a], code[b]) <= own.most) & first(code[a], code[b], key_[a])
                        hit[a[near]] = hit[b[near]] = True
                yield from table.select(["key", "id"]).filter(pa.array(hit)).to_batches()

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in cells(batches):
            for d, at in by_length(every.column("d").to_numpy()):
                table = every.take(pa.array(at))
                x = matrix(table.column("v").combine_chunks(), d)
                id_, copies, block, key_ = (table.column(c).to_numpy() for c in ("id", "copies", "block", "key"))
                cell = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], 1)
                code = codes[d].chunks(x)
                starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)]))
                sizes = np.diff([*starts, len(cell)])

                def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                    """Candidates: all pairs of small cells, and those of large ones whose product is near the threshold."""
                    small = np.flatnonzero(np.repeat(sizes < WIDE, sizes))
                    for a, b in pairs(table.select(["key", "i", "j", "block"]).take(pa.array(small))):
                        yield small[a], small[b]
                    for s, n in zip(starts[sizes >= WIDE], sizes[sizes >= WIDE], strict=True):
                        a, b = np.nonzero(np.triu(x[s : s + n] @ x[s : s + n].T >= cosine - 1e-9, 1))
                        own = (cell[s, 1] == cell[s, 2]) | (block[a + s] != block[b + s])
                        yield a[own] + s, b[own] + s

                found = [np.zeros((2, 0), np.int64)]
                for every_a, every_b in close():
                    for s in range(0, len(every_a), TOGETHER):
                        a, b = every_a[s : s + TOGETHER], every_b[s : s + TOGETHER]
                        linked = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                        a, b = a[linked], b[linked]
                        own = first(code[a], code[b], key_[a])
                        found.append(np.stack([a[own], b[own]]))
                a, b = np.concatenate(found, 1)
                if not len(a):
                    continue
                links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
                label = id_.copy()
                while True:
                    was = label.copy()
                    np.minimum.at(label, a, was[b])
                    np.minimum.at(label, b, was[a])
                    if (was == label).all():
                        break
                told = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(id_[told]), pa.array(links[told].astype(np.int64)), pa.array(label[told])], ["id", "links", "root"])

    coded = written(classes.select("id", "v", "d").mapInArrow(encode, "id long, d int, code binary, keys array<long>"))
    each = coded.select("id", F.explode("keys").alias("key"))
    members = each.join(counted(each), "key").select("key", "id", "_n")
    dealt = in_blocks(members.join(coded.select("id", "d", "code"), "id").select("key", "id", "d", "code", "_n"))
    chosen = written(dealt.mapInArrow(promising, "key long, id long").distinct())
    again = chosen.join(counted(chosen), "key").join(classes.select("id", "d", "copies", "v"), "id").select("key", "id", "d", "copies", "v", "_n")
    found = written(in_blocks(again).mapInArrow(rerank, "id long, links long, root long"))
    for done in (coded, chosen):
        forget(done)
    placed = written(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "id", "left").join(placed, "id", "left").select("v", "id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    usable = F.col("good") & F.col("id").isNotNull()
    out = rows.select("id", F.when(usable, F.col("v")).alias("v")).join(of_class.withColumnRenamed("id", "rep"), "v", "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("id").cast(vectors.schema[key].dataType).alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))
