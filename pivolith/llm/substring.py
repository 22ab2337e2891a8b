"""Substring dedup: repeated fixed-length token windows, merged into removal intervals.

Every window of 20 words has a Rabin-Karp hash; a window goes if an equal one starts earlier, and
the removed windows merge into maximal intervals. Three passes keep the exchanges small and whole:

1. Anchors. A window's anchor is the least hash among its 8-word grams, so equal windows have
   equal anchors at the same place. Neighbouring windows share anchors: about one word in seven is
   one. Anchors that occur once rule their windows out.
2. Windows. The others send their 96-bit window hash with document and position. Sorted by hash,
   then document and position, every row but the first of a hash is a repetition.
3. Removal. A document's repeated windows merge into intervals, and the rest is its text.

Before each exchange a task reduces its own rows: of equal hashes among some 400,000 words only the first
is sent under its hash, the others are decided or known already and travel by a key of
their own. So a passage in a third of all documents puts a few rows in a partition, not one for
each document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pivolith.llm.common import WORD_PATTERN, batches_of_rows, others, release, ship, written
from pivolith.llm.neardup import mix, word_hashes

WINDOW, GRAM = 20, 8
#: Hashed words that a task reduces together.
TOGETHER = 400_000
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FIND = re.compile(WORD_PATTERN)


def rolling(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hash of every window of `size` words, by doubling: a window is two halves."""
    if len(h) < size:
        return h[:0]
    out, done, left, have, power = None, 0, size, h, np.array([base])
    while left:  # have: hashes of windows of 2**k words; out: of the `done` words put together so far
        if left & 1:
            out = have if out is None else out[: len(h) - done - (1 << (size.bit_length() - left.bit_length())) + 1] * power + have[done:]
            done += 1 << (size.bit_length() - left.bit_length())
        left >>= 1
        if left:
            step = 1 << (size.bit_length() - left.bit_length() - 1)
            have = have[:-step] * power + have[step:]
            power = power * power
    return out[: len(h) - size + 1]


def anchors(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every gram, and for every window the position of its least gram (the first of equals)."""
    gram = mix(rolling(h, min(GRAM, size), _BASE))
    wide = size - min(GRAM, size) + 1
    if len(gram) < wide:
        return gram, np.zeros(0, np.int64)
    return gram, np.lib.stride_tricks.sliding_window_view(gram, wide).argmin(1) + np.arange(len(gram) - wide + 1)


def _words(text: str | None) -> list[str]:
    return _FIND.findall(text or "")


#: at: 32 more hash bits, 30 bits of position, two bits of kind.
_ROWS = "h long, id long, sub long, at long"
_NAMES = ["h", "id", "sub", "at"]
_PLACES, _PLACE_NAMES = "id long, sub long, at int", ["id", "sub", "at"]
#: kind: one that stands for its hash in a task; the same, with others there; one of the others.
ONE, SEVERAL, OTHER = 0, 1, 2


def _reduced(parts: list[tuple[np.ndarray, int, np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    """Rows of (hash, document, position, 32 more hash bits), where the first of equal ones by document and position stands for them."""
    h, at, more = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
    id_, sub = (np.repeat(np.array([p[i] for p in parts], np.int64), [len(p[0]) for p in parts]) for i in (1, 4))
    order = np.lexsort((at, sub, id_, more, h))
    h, id_, sub, at, more = h[order], id_[order], sub[order], at[order], more[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
    twice = np.zeros(len(h), bool)  # rows that share key and text repeat the document
    twice[1:] = ~head[1:] & (id_[1:] == id_[:-1]) & (sub[1:] == sub[:-1]) & (at[1:] == at[:-1])
    several = np.append(head[1:] == 0, False)
    kind = np.where(head, np.where(several, SEVERAL, ONE), OTHER).astype(np.int8)
    key = np.where(head, h, mix(h + mix(id_.view(np.uint64) + at.astype(np.uint64) * _BASE + sub.view(np.uint64) * _BASE2)))
    packed = (more.astype(np.uint64) << np.uint64(32)) | (at.astype(np.uint64) << np.uint64(2)) | kind.astype(np.uint64)
    keep = np.argsort(order)  # as they came: neighbours share the document, which packs better
    keep = keep[~twice[keep]]
    return pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(id_[keep]), pa.array(sub[keep]), pa.array(packed[keep].view(np.int64))], _NAMES)


def _place(at: np.ndarray) -> np.ndarray:
    return ((at & 0xFFFFFFFF) >> 2).astype(np.int32)


def _sent(batches: Iterator[pa.RecordBatch], make: Callable) -> Iterator[pa.RecordBatch]:
    """make(row) gives (hash, position, more bits) of a document's rows; reduced together."""
    parts, size = [], 0
    for whole in batches:
        for batch in batches_of_rows(whole):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, at, more = make(row)
                if len(h):
                    parts.append((h, row[0], at, more, row[1]))
                    size += len(h)
                if size >= TOGETHER:
                    yield _reduced(parts)
                    parts, size = [], 0
    if parts:
        yield _reduced(parts)
    release()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash: (id, sub, position) of those whose hash occurs more than once."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, id_, sub, at = (c.to_numpy() for c in batch.columns)
        known = at & 3 != ONE
        if held is not None:
            h, id_, sub, at, known = (np.concatenate([a, b]) for a, b in zip(held, (h, id_, sub, at, known), strict=True))
        same = h[1:] == h[:-1]
        known[1:] |= same
        known[:-1] |= same
        held = tuple(x[-1:] for x in (h, id_, sub, at, known))
        sure = np.flatnonzero(known[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(id_[sure]), pa.array(sub[sure]), pa.array(_place(at[sure]))], _PLACE_NAMES)
    if held is not None and held[4][0]:
        yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[2]), pa.array(_place(held[3]))], _PLACE_NAMES)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, document and position: (id, sub, position) of all but the first of a hash."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, id_, sub, packed = (c.to_numpy() for c in batch.columns)
        done = packed & 3 == OTHER
        gone = [pa.array(id_[done]), pa.array(sub[done]), pa.array(_place(packed[done]))]
        h, id_, sub, packed = h[~done], id_[~done], sub[~done], packed[~done] & ~3
        if last is not None:
            h, id_, sub, packed = (np.concatenate([a, b]) for a, b in zip(last, (h, id_, sub, packed), strict=True))
        if len(h):
            new = np.ones(len(h), bool)  # not the same window of the same document again
            new[1:] = (h[1:] != h[:-1]) | (id_[1:] != id_[:-1]) | (sub[1:] != sub[:-1]) | (packed[1:] != packed[:-1])
            h, id_, sub, packed = h[new], id_[new], sub[new], packed[new]
            again = (h[1:] == h[:-1]) & (packed[1:] >> 32 == packed[:-1] >> 32)
            yield pa.RecordBatch.from_arrays([pa.array(id_[1:][again]), pa.array(sub[1:][again]), pa.array(_place(packed[1:][again]))], _PLACE_NAMES)
            last = (h[-1:], id_[-1:], sub[-1:], packed[-1:])
        yield pa.RecordBatch.from_arrays(gone, _PLACE_NAMES)


def repeated_windows(docs: DataFrame, size: int = WINDOW, by: tuple[str, ...] = ("id", "sub")) -> DataFrame:
    """(id, sub, gone): for each document with some, the starts of the windows that also start earlier.

    docs has the columns id, sub (long, not null; sub tells documents of one id apart) and text. Any others are carried to the windows' pass
    unread, so that its exchange of docs is the same as a later join's and is made once. by: the columns that tell documents
    apart; where sub is one value, id alone spares the exchanges from (id, sub) to id (the result has no sub then).
    """

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(row: tuple) -> tuple:
            gram, least = anchors(word_hashes(_words(row[2])), size)
            at = np.unique(least)
            return gram[at], at, np.zeros(len(at), np.uint64)

        return _sent(batches, make)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(row: tuple) -> tuple:
            h = word_hashes(_words(row[2]))
            _, least = anchors(h, size)
            at = np.flatnonzero(np.isin(least, row[-1]))
            if not len(at):
                return h[:0], at, h[:0]
            return mix(rolling(h, size, _BASE))[at], at, mix(rolling(mix(h), size, _BASE2))[at] >> np.uint64(32)

        return _sent(batches, make)

    found = docs.select("id", "sub", "text").mapInArrow(send_anchors, _ROWS).repartition("h").sortWithinPartitions("h").mapInArrow(_shared, _PLACES)
    marked = found.groupBy(*by).agg(F.collect_set("at").alias("ats"))
    rows = docs.join(marked.hint("shuffle_hash"), list(by)).select(*docs.columns, "ats").mapInArrow(send_windows, _ROWS)
    later = rows.repartition("h").sortWithinPartitions("h", F.shiftright("at", 32), "id", "sub", "at").mapInArrow(_later, _PLACES)
    return later.groupBy(*by).agg(F.collect_list("at").alias("gone"))


_OUT = {"text": T.StringType(), "n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}


def remove_repeats(docs: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("text", "n_words", "n_removed")) -> DataFrame:
    """docs without the words covered by a window of `size` words that also starts earlier, by
    smaller key or, in one document, earlier position. Windows are judged on the input.

    Words are runs of other than ASCII white space, unchanged. outputs: `text` (the kept stretches
    with their own white space, joined by a space; unchanged if nothing goes), n_words, n_removed, kept_sha256 (of
    the kept words joined by one space). Columns of docs with the last three names, in any case, are replaced.
    A null text has no words and stays null; texts under `size` words stay whole. A null key comes
    before all others. Rows that share key and text count as one document and are not held
    against each other; unlike texts of one key, or without one, are documents of their own, in
    order of a hash. Other columns are carried over; an empty table stays empty.
    """
    ship(docs.sparkSession)
    text = next(c for c in docs.columns if c.lower() == text.lower())
    carried = others(docs, (*outputs, text))
    own = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(2**63))).alias("id")
    said = F.xxhash64(F.col(f"`{text}`"))
    unlike = written(docs.select(own, said.alias("sub")).groupBy("id").agg(F.min("sub").alias("a"), F.max("sub").alias("b")).where("a <> b").select("id"))
    rows = docs.select(own, F.lit(0).cast("long").alias("sub"), F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carried)]).alias("_rest"))
    by = ("id",)
    if not unlike.isEmpty():  # else sub is one value, which packs to nothing
        by = ("id", "sub")
        rows = rows.join(unlike.withColumn("_unlike", F.lit(True)), "id", "left").select("id", F.when(F.col("_unlike"), F.xxhash64("text")).otherwise(F.col("sub")).alias("sub"), "text", "_rest")
    rows = rows.join(repeated_windows(rows, size, by).hint("shuffle_hash"), list(by), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of_rows(whole):
                cols: dict[str, list] = {c: [] for c in outputs}
                for t, starts in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                    words = _words(t)
                    cover = np.zeros(len(words) + 1, np.int32)
                    if starts:
                        at = np.unique(np.array(starts, np.int64))
                        cover[at] += 1
                        np.subtract.at(cover, at + size, 1)
                    stay = np.cumsum(cover)[:-1] == 0
                    for c in outputs:
                        if c == "n_words":
                            cols[c].append(len(words))
                        elif c == "n_removed":
                            cols[c].append(int((~stay).sum()))
                        elif c == "kept_sha256":
                            cols[c].append(hashlib.sha256(" ".join(w for w, k in zip(words, stay, strict=True) if k).encode()).hexdigest())
                        elif t is None or stay.all():
                            cols[c].append(t)
                        else:
                            spans = [m.span() for m in _FIND.finditer(t)]
                            edge = np.flatnonzero(np.diff(np.concatenate([[0], stay.astype(np.int8), [0]])))
                            cols[c].append(" ".join(t[spans[a][0] : spans[b - 1][1]] for a, b in edge.reshape(-1, 2)))
                made = [pa.array(cols[c], pa.string() if c in ("text", "kept_sha256") else pa.int64()) for c in outputs]
                yield pa.RecordBatch.from_arrays([batch.column("_rest"), *made], ["_rest", *[f"_{c}" for c in outputs]])
        release()

    schema = T.StructType([T.StructField("_rest", T.StructType([T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(carried)])), *[T.StructField(f"_{c}", _OUT[c]) for c in outputs]])
    out = rows.select("_rest", "text", "gone").mapInArrow(run, schema)
    order = [c for c in docs.columns if c in carried or c == text and "text" in outputs] + [c for c in outputs if c != "text"]
    return out.select(*[F.col(f"_rest._{carried.index(c)}").alias(c) if c in carried else F.col("_text" if c == text else f"_{c}").alias(c) for c in order])


#: DuckDB SQL for op2's rows; quadratic in nothing, but it spells out every window.
ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), g as (
  select doc_id, unnest(range(len(words) - 19)) as p, words from w where len(words) >= 20
), s as (
  select doc_id, p, sha256(array_to_string(words[p + 1 : p + 20], ' ')) as h from g
), later as (
  select doc_id, p from (select *, row_number() over (partition by h order by doc_id, p) as n from s) where n > 1
), gone as (
  select distinct doc_id, p + i as k from later, range(20) t(i)
), each as (
  select doc_id, unnest(words) as word, unnest(range(len(words))) as k from w
), kept as (
  select e.doc_id, count(*) as n, string_agg(word, ' ' order by e.k) as said from each e anti join gone g on e.doc_id = g.doc_id and e.k = g.k group by e.doc_id
)
select w.doc_id, cast(len(w.words) as bigint) as n_words, cast(len(w.words) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(said, '')) as kept_sha256
from w left join kept using (doc_id)
"""
