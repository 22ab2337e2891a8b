"""Language identification by error-correcting output codes.

Every language has a binary codeword. For each bit a logistic regression over hashed letter
n-grams tells the languages with a 1 from those with a 0. Decoding adds up, over the
bits, the logistic loss of a codeword against the bit's margin, weighted by how reliable that
bit was on the training rows; the codeword with the least loss wins, and a small lead over the
second is flagged as ambiguous.

The model is learned from a bounded sample: at most `per_language` rows of each language and
`sample_rows` in all, the first in order of a hash of the key, each with its whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pivolith.llm.common import batches_of_rows, others, release, ship

#: Hash buckets of the n-grams.
WIDTH = 4096
#: Bounds of the training sample.
PER_LANGUAGE, SAMPLE_ROWS = 250, 4000
#: A lead in posterior probability below this is ambiguous.
AMBIGUOUS = 0.2


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def profile(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its unit vector of hashed 1- to 3-grams, and whether it has a letter.

    Letters are lower-cased; every run of anything else counts as one space. The texts are laid
    end to end, so that the n-grams of all are made by a few array operations.
    """
    flat = "\0".join(["", *((t or "").replace("\0", " ").lower() for t in texts), ""])
    code = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32)
    row = np.cumsum(code == 0) - 1  # the border before a text counts as its own
    letter = _letters()[code]
    keep = letter | np.concatenate([[True], letter[:-1]]) | (code == 0)
    code, row, letter = np.where(letter, code, 32)[keep].astype(np.uint64), row[keep], letter[keep]
    has = np.zeros(len(texts) + 1, bool)
    has[row[letter]] = True
    out = np.zeros((len(texts) + 1, WIDTH))
    size = len(out) * WIDTH
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, 4):
        gram = gram[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)
        own = (row[: len(gram)] == row[n - 1 :]) & (letter[: len(gram)] | letter[n - 1 :])
        place = (gram * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)
        out += np.bincount((row[: len(gram)][own] * WIDTH + place[own].astype(np.int64)), minlength=size)[:size].reshape(out.shape)
    out = np.sqrt(out[:-1])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm, norm, 1), has[:-1]


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each language: every split of up to five languages, or the random
    code with the largest least distance of 200, with ten bits for each doubling."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[(s >> i) & 1 for i in range(n - 1)] + [0] for s in range(1, 2 ** (n - 1))]
        return np.array(bits).T * 2.0 - 1
    rnd, best, widest = np.random.default_rng(n), None, -1
    for _ in range(200):
        code = rnd.integers(0, 2, (n, math.ceil(10 * math.log2(n)))) * 2.0 - 1
        code[0, np.abs(code.sum(0)) == n] *= -1  # no bit is the same for all
        least = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        if least > widest:
            best, widest = code, least
    return best


class Model:
    def __init__(self, x: np.ndarray, lang: list[str], steps: int = 150) -> None:
        self.langs = sorted(set(lang))
        self.code = codewords(len(self.langs))
        if len(self.langs) < 2:
            return
        at = np.array([self.langs.index(n) for n in lang])
        y = self.code[at]
        share = 1 / np.bincount(at)[at] / len(self.langs)
        w = np.zeros((x.shape[1] + 1, self.code.shape[1]))
        x = np.hstack([x, np.ones((len(x), 1))])
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):  # Adam on the balanced logistic loss
            g = -x.T @ (share[:, None] * y / (1 + np.exp(np.clip(y * (x @ w), -30, 30)))) + 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        self.w = w.astype(np.float32)
        wrong = (share[:, None] * ((x @ w) * y <= 0)).sum(0)
        self.trust = np.clip(np.log((1 - wrong + 1e-3) / (wrong + 1e-3)), 0.1, 7)
        self.trust /= self.trust.mean()

    def decode(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and lead of each row."""
        if len(self.langs) < 2:
            return [self.langs[0] if self.langs else "und"] * len(x), np.full(len(x), float(len(self.langs))), np.full(len(x), float(len(self.langs)))
        margin = x @ self.w[:-1] + self.w[-1]
        loss = np.stack([(self.trust * np.logaddexp(0, -margin * c)).sum(1) for c in self.code], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        two = np.sort(p, 1)
        return [self.langs[b] for b in best], p.max(1), two[:, -1] - two[:, -2]


def held_out(key: str) -> Column:
    """crc32 of the key as text, mod 4, is 2. A null key is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows with a text and a language outside the held-out quarter."""
    ship(docs.sparkSession)
    usable = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(~held_out("k") & F.col("t").isNotNull() & F.col("l").isNotNull())
    names = [r["l"] for r in usable.groupBy("l").count().orderBy(F.desc("count"), "l").limit(sample_rows).collect()]
    each = max(1, min(per_language, sample_rows // max(1, len(names))))
    order = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    chosen = usable.select("k", "l").withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("k", "l")
    sample = usable.join(F.broadcast(chosen.limit(sample_rows)), ["k", "l"], "left_semi").select("l", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of_rows(whole, 64):
                x, has = profile(batch.column(1).to_pylist())
                rows = [r.astype("<f4").tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(has)], ["l", "x", "has"]).filter(pa.array(has))

    rows = sorted((r["l"], bytes(r["x"])) for r in sample.mapInArrow(run, "l string, x binary, has boolean").limit(2 * sample_rows).collect())
    x = np.stack([np.frombuffer(b, "<f4") for _, b in rows]).astype(np.float64) if rows else np.zeros((0, WIDTH))
    return Model(x, [n for n, _ in rows])


def identify(docs: DataFrame, model: Model, text: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous added; columns of docs with these names, in any case, are replaced.

    A null text or one without a letter gets `und`, score 0, and counts as ambiguous; so
    does every text if nothing could be learned. Whole texts are read; a repeated row gets the same
    answer; an empty table stays empty. No shuffle.
    """
    ship(docs.sparkSession)
    added = ("lang_pred", "score", "ambiguous")
    keep = others(docs, added)
    at = keep.index(next(c for c in keep if c.lower() == text.lower()))
    held = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of_rows(whole, 64):
                x, has = profile(batch.column(at).to_pylist())
                names, score, lead = model.decode(x)
                has &= bool(model.langs)
                made = [pa.array([n if h else "und" for n, h in zip(names, has, strict=True)], pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(~has | (lead < ambiguous))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*held, *added])
        release()

    schema = T.StructType([*[T.StructField(h, docs.schema[c].dataType) for h, c in zip(held, keep, strict=True)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    out = docs.select(*[F.col(f"`{c}`").alias(h) for h, c in zip(held, keep, strict=True)]).mapInArrow(run, schema)
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], *added)
