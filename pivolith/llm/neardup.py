"""Near-duplicate documents: MinHash signatures joined by a multi-index for Hamming distance.

A document's shingle set gives a signature of 112 symbols of 8 bits (b-bit MinHash): symbol k is
a digest of the least value of hash function k over the set. The signature is split into 16 chunks
of 7. By the pigeonhole principle two signatures that differ in at most 31 symbols have a chunk with
at most one difference; all ways to leave one symbol of a chunk out are its keys, so such a
pair is sure to share a key. Pairs further apart are still found if any chunk has at
most one difference: at similarity 0.8 a symbol differs with chance 0.2, and all chunks fail
with chance 0.4233 ** 16 = 1.1e-6.

Keys only propose. In each key's bucket the members are held against a first one, on their full
shingle sets; the links give components. Where a bucket still spans several components, its
members and those of the other components meet in blocks of signatures. Pairs that are close enough there go on as ids
to be held against each other on their sets; only where a block has more of them than a few a row, its rows meet once
more, with their sets, and its pairs don't become rows. So a group of thousands of copies costs one
comparison for each member, and no link between different texts is lost. Documents with equal sets are
one from the start. Before the keys are exchanged a task sends one document for each of
its keys; the others have that one as their first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pivolith.llm.blocks import cells, in_blocks_across, pairs_across
from pivolith.llm.common import ASCII_LOWER, WORD_PATTERN, batches_of_rows, forget, release, ship, written
from pivolith.llm.components import components

CHUNKS, CHUNK = 16, 7
SYMBOLS = CHUNKS * CHUNK
_RND = np.random.default_rng(20240229)
_FLIP = _RND.integers(0, 2**64, SYMBOLS, dtype=np.uint64)
_TIMES = _RND.integers(0, 2**64, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_PLACE = _RND.integers(0, 2**64, (CHUNKS, CHUNK), dtype=np.uint64) | np.uint64(1)
_SALT = _RND.integers(0, 2**64, (CHUNKS, CHUNK), dtype=np.uint64)
_WORDS: dict[str, int] = {}
_FIND = re.compile(WORD_PATTERN)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_WORDS) > 150_000:
        _WORDS.clear()
    try:
        return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words).difference(_WORDS):
            _WORDS[w] = xxhash.xxh3_64_intdigest(w.encode())
        return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's shingle set."""
    words = _FIND.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    size = min(size, len(h))
    acc = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
    return np.unique(mix(acc + np.uint64(size)))


def shared_values(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two nonempty sorted sets share."""
    few, many = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(many, few)
    return int((many[np.minimum(at, len(many) - 1)] == few).sum())


def signature(own: np.ndarray) -> np.ndarray:
    """The symbols of a nonempty set."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        least = np.minimum(least, ((own[at : at + 1024, None] ^ _FLIP) * _TIMES).min(0))
    return (mix(least) >> np.uint64(56)).astype(np.uint8)


def keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature its keys: every chunk with each symbol left out; the key's number is its last 7 bits."""
    parts = signatures.reshape(-1, CHUNKS, CHUNK).astype(np.uint64) * _PLACE
    own = mix(parts.sum(2, dtype=np.uint64)[:, :, None] - parts + _SALT).reshape(len(signatures), SYMBOLS)
    return (own << np.uint64(7)) | np.arange(SYMBOLS, dtype=np.uint64)


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first key that pairs of signatures share."""
    differ = (a != b).reshape(-1, CHUNKS, CHUNK)
    chunk = (differ.sum(2) <= 1).argmax(1)
    return chunk * CHUNK + np.take_along_axis(differ, chunk[:, None, None], 1)[:, 0].argmax(1)


def most_different(percent: int, miss: float = 1e-6) -> int:
    """Symbols in which the signatures of similar enough sets differ at most, but for a chance of `miss`."""
    p, tail, k = 1 - percent / 100, 1.0, -1
    while tail > miss:
        k += 1
        tail -= math.comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k)
    return k


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of_rows(whole):
                sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
                e1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                e2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
                sig = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(e1.view(np.int64)), pa.array(e2.view(np.int64)), pa.array(sig, pa.binary())], ["id", "own", "n", "e1", "e2", "sig"])
        release()

    return docs.mapInArrow(run, "id long, own long, n long, e1 long, e2 long, sig binary")


_ROWS = "h long, id long, n long, key long, lead long, lead_n long"
_NAMES = ["h", "id", "n", "key", "lead", "lead_n"]
#: Key rows that a task reduces together, and the kinds of rows that it sends: one that stands for its key
#: there, the same with others there, and one of the others, which knows its first and is spread by a key of its own.
TOGETHER = 400_000
ONE, SEVERAL, OTHER = 0, 1, 2


def _reduced(ids: list[np.ndarray], sizes: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
    id_, n = (np.repeat(np.concatenate(x), SYMBOLS) for x in (ids, sizes))
    key = keys(np.concatenate(codes)).reshape(-1)
    order = np.lexsort((id_, key))
    by = key[order]
    head = np.ones(len(by), bool)
    head[1:] = by[1:] != by[:-1]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    kind = np.where(head, np.where(np.append(~head[1:], False), SEVERAL, ONE), OTHER)
    back = np.argsort(order)
    lead, kind = lead[back], kind[back]
    other = kind == OTHER
    h = np.where(other, mix(key + mix(id_.view(np.uint64))), key)
    cols = [h.view(np.int64), id_, (n << 2) | kind, np.where(other, key.view(np.int64), 0), np.where(other, id_[lead], 0), np.where(other, n[lead], 0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _NAMES)


def _send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for whole in batches:
        for batch in batches_of_rows(whole, 1024):
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, SYMBOLS)))
                size += batch.num_rows * SYMBOLS
            if size >= TOGETHER:
                yield _reduced(*map(list, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield _reduced(*map(list, zip(*held, strict=True)))
    release()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and id: the members of keys with two or more, each with a first one."""
    names = ["key", "id", "n", "lead", "lead_n"]
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, id_, n, key, lead, lead_n = (c.to_numpy() for c in batch.columns)
        other = n & 3 == OTHER
        yield pa.RecordBatch.from_arrays([pa.array(c[other]) for c in (key, id_, n >> 2, lead, lead_n)], names)
        h, id_, kind, n = h[~other], id_[~other], n[~other] & 3, n[~other] >> 2
        if not len(h):
            continue
        known = kind == SEVERAL
        lead, lead_n = id_, n
        if held is not None:
            h, id_, n, lead, lead_n, known = (np.concatenate(x) for x in zip(held, (h, id_, n, lead, lead_n, known), strict=True))
        same = h[1:] == h[:-1]
        known[1:] |= same
        known[:-1] |= same
        first = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(h)), 0))
        row = [h, id_, n, lead[first], lead_n[first], known]
        held = tuple(c[-1:] for c in row)
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][known[:-1]]) for c in row[:-1]], names)
    if held is not None and held[-1][0]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[:-1]], names)
    release()


def _across(table: pa.Table, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a table of cells: pairs of two components with close enough signatures, each in the cell of its first key only."""
    key, n = (table.column(c).to_numpy() for c in ("key", "n"))
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
    found = [np.zeros((0, 3), np.int64)]
    for a, b in pairs_across(table):
        near = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[near], b[near]
        far = (code[a] != code[b]).sum(1)
        a, b, far = a[far <= most], b[far <= most], far[far <= most]
        own = first_key(code[a], code[b]) == key[a] & 127
        found.append(np.stack([a[own], b[own], far[own]], 1))
    a, b, far = np.concatenate(found).T
    order = np.argsort(far, kind="stable")
    return a[order], b[order]


#: Close pairs a row from which a cell is dense: its rows, not its pairs, go on to the comparison of sets.
DENSE = 4
_PROMISING = "key long, i int, j int, a long, b long, component long, n long, code binary, block int"


def _promising(most: int, percent: int):
    """Of cells, the pairs that are worth a comparison on full sets, as pairs (a, b) of ids; of a dense cell the
    rows that have such a pair, with b null, which meet in that cell again. Either way no more rows than
    DENSE times those of the cells go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cells(batches):
            id_ = table.column("id").to_numpy()
            a, b = _across(table, most, percent)
            cell = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            group = np.cumsum(np.concatenate([[0], (cell[1:] != cell[:-1]).any(1)]))
            rows, close = np.bincount(group), np.bincount(group[a], minlength=group[-1] + 1)
            dense = (close > DENSE * rows)[group]
            few = ~dense[a]
            none = pa.nulls(int(few.sum()), pa.int64())
            x, y = id_[a[few]], id_[b[few]]
            yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), none.cast(pa.int32()), pa.array(x), pa.array(y), none, none, none.cast(pa.string()).cast(pa.binary()), none.cast(pa.int32())], ["key", "i", "j", "a", "b", "component", "n", "code", "block"])
            hit = np.zeros(len(id_), bool)
            hit[a[~few]] = hit[b[~few]] = True
            own = table.filter(pa.array(hit))
            empty = pa.chunked_array([pa.nulls(own.num_rows, pa.int64())])
            yield from pa.table([own.column("key"), own.column("i"), own.column("j"), own.column("id"), empty, *(own.column(c) for c in ("component", "n", "code", "block"))], ["key", "i", "j", "a", "b", "component", "n", "code", "block"]).to_batches()
        release()

    return run


def _linked(most: int, percent: int):
    """Links between components, on full sets. Closest signatures come first, and components that
    are one already by links in the same table of cells aren't compared again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cells(batches):
            id_, component = (table.column(c).to_numpy() for c in ("id", "component"))
            a, b = _across(table, most, percent)
            own = table.column("own").combine_chunks()
            starts = own.offsets.to_numpy()
            values = own.values.to_numpy().view(np.uint64)  # the sets stay in the table's memory
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            links = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = root(int(component[x])), root(int(component[y]))
                if p == q:
                    continue
                mine, other = values[starts[x] : starts[x + 1]], values[starts[y] : starts[y + 1]]
                if shared_values(mine, other) * (100 + percent) >= percent * (len(mine) + len(other)):
                    parent[max(p, q)] = min(p, q)
                    links.append((int(id_[x]), int(id_[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])
        release()

    return run


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of_rows(whole):
                sets = [shingles(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "own"])
        release()

    return docs.mapInArrow(run, "id long, own array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return written(both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_shingles, component_id, kept.

    Words are runs of other than ASCII white space, A-Z lower-cased; the set holds the distinct
    shingles of `words` words, or the whole sequence of a shorter text. Documents are linked if
    100 * intersection >= percent * union. component_id is the smallest key reachable, kept says that
    it is the own one. Null, empty and blank texts have no shingles and are linked with nothing.
    Rows with the same key are one document (each is returned), also if their texts differ: each text's links count, and
    all share a component. A null key is linked with nothing, has a null component_id and isn't kept. Long texts are
    read whole; an empty table gives an empty one; other columns aren't read, so their names can't clash.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").cast("long").alias("own"))
    unlike = written(rows.where("id is not null").groupBy("id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a <> b").select("id"))
    several = not unlike.isEmpty()
    if several:  # these keys' texts are told apart by ids of their own, and linked
        rows = rows.join(unlike.withColumn("_unlike", F.lit(True)), "id", "left").select(F.when(F.col("_unlike"), F.xxhash64("id", F.xxhash64("text"))).otherwise(F.col("id")).alias("id"), "text", "own")
    signed = written(_signatures(rows, words))
    usable = signed.where("id is not null and n > 0")
    groups = written(usable.groupBy("e1", "e2", "n").agg(F.min("id").alias("rep")))  # a table, so that a large group's join can be split
    firsts = usable.join(groups.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    sent = firsts.select("id", "n", "sig").mapInArrow(_send_keys, _ROWS)
    members = written(sent.repartition("h").sortWithinPartitions("h", "id").mapInArrow(_members, "key long, id long, n long, lead long, lead_n long"))
    near = 100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")
    # the texts move once, by the same plan at every size, and only those that share a key become sets
    named = members.select("id").distinct().hint("shuffle_hash")
    sets = written(_sets(rows.join(named, "id", "left_semi").select("id", "text"), words).dropDuplicates(["id"]))
    links = _confirmed(members.where(near & (F.col("id") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), sets, percent)
    found = written(components(links))
    # keys whose members are not yet of one component
    placed = members.join(found, "id", "left").select("key", "id", "lead", F.coalesce("component", "id").alias("component"))
    leads = found.select(F.col("id").alias("lead"), F.col("component").alias("lead_component"))
    spans = placed.join(leads, "lead", "left").where(F.coalesce("lead_component", "lead") != F.col("component")).select("key").distinct()
    known = firsts.select("id", "n", F.col("sig").alias("code"))
    most = most_different(percent)
    open_ = placed.join(spans, "key").select("key", "id", "component").join(known, "id").select("key", "id", "component", "n", "code")
    chosen = written(in_blocks_across(open_).mapInArrow(_promising(most, percent), _PROMISING))
    few = _confirmed(chosen.where("b is not null").select("a", "b"), sets, percent)
    dense = chosen.where("b is null").drop("b").withColumnRenamed("a", "id").join(sets, "id").select("key", "i", "j", "id", "component", "n", "code", "block", "own")
    more = few.union(dense.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_linked(most, percent), "a long, b long"))
    every = links.union(more)
    if several:
        heads = signed.where("own <> id and n > 0").join(groups, ["e1", "e2", "n"]).select("own", F.col("rep").alias("id")).distinct()
        every = every.union(heads.join(heads.groupBy("own").agg(F.min("id").alias("a")), "own").select("a", F.col("id").alias("b")).where("a <> b"))
    found = written(components(every))
    for done in (chosen, members, sets):
        forget(done)
    rep = signed.join(groups, ["e1", "e2", "n"], "left")
    out = rep.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", "own", "n", F.coalesce("component", "rep", "id").alias("component"))
    if several:
        least = written(out.where("n > 0").groupBy("component").agg(F.min("own").alias("least")))
        out = out.join(least, "component", "left").select("id", "own", "n", F.when(F.col("n") > 0, F.coalesce("least", "own")).otherwise(F.col("own")).alias("component"))
    component = F.when(F.col("own").isNotNull(), F.col("component"))
    return out.select(F.col("own").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("own") == component, F.lit(False)).alias("kept"))
