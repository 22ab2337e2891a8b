"""BPE encoding and decoding by prefix-sharing trie traversal.

A text is cut into pre-tokens by the byte-level pattern. The distinct pre-tokens of a batch that
have not been seen are put in byte order, which is the depth-first order of their trie: a
stack holds one state for each byte of the current path, and a word keeps the states of the
prefix that it shares with the word before it, so each trie node is computed once.

The state of a node is the *last token* of the encoding of its prefix. It is the one
vocabulary entry t which ends the prefix such that the last token p of what stands before
t and t itself stay apart when p + t is encoded alone. An encoding is read off by walking
back from the last byte, so states are two small integers and very long words stay linear.

The result equals the tokenizers library's encode(..., add_special_tokens=False) without
truncation and padding, with added tokens matched in the text, and its
decode(ids, skip_special_tokens=False).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pivolith.llm.common import batches_of_rows, ship

#: Fixed: the byte-level pre-token pattern of this vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where cutting at every space and line feed would differ from the pattern.
_BLANK = {"", *" \t\n\r\x0b\x0c\x00"}
_IRREGULAR = re.compile(r"\x00|[ \n]\s|[^\S \n]|\A\s|\s\Z|[\x1c-\x1f\x85᠎​﻿]")
#: Entries of the word cache of a Python worker (about 250 MB); it is emptied when full.
#: A single text with more distinct words than that still gets them all.
CACHE_WORDS = 1_300_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """One byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without prefix space is needed")
        back = {ord(c): b for b, c in byte_symbols().items()}
        raw = lambda s: bytes(map(back.__getitem__, map(ord, s)))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {raw(k): v for k, v in model["vocab"].items() if k not in self.added}
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for k, v in self.ids.items():
            self.bytes_of[v] = k
        for k, v in self.added.items():
            self.bytes_of[v] = k.encode()
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = (raw(s) for s in (merge if isinstance(merge, list) else merge.split(" ")))
            pair = self.ids[a], self.ids[b]
            self.rank[pair] = r
            self.parts.setdefault(self.ids[a + b], (*pair, r))
        self.pattern = regex.compile(PRETOKEN)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.apart: dict[tuple[int, int], bool] = {}
        self.cache: dict[str | int, bytes] = {}

    @cached_property
    def ending(self) -> dict:
        """The vocabulary entries by their bytes from the last to the first; an entry stands under -1."""
        top: dict = {}
        for k, v in self.ids.items():
            node = top
            for b in reversed(k):
                node = node.setdefault(b, {})
            node[-1] = v
        return top

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens along one edge of a token's merge tree, with the rank that ends each."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until = self.parts[token][2]
            token = self.parts[token][side]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether left and right, side by side, are encoded as just these two tokens.

        A merge across the border would join a token of left's right edge with one of right's
        left edge while both exist; of equal ranks the leftmost is merged first.
        """
        known = self.apart.get((left, right))
        if known is None:
            known, starts = True, self._spine(right, 0)
            for a, a_until in self._spine(left, 1):
                for b, b_until in starts:
                    r = self.rank.get((a, b))
                    if r is not None and r < a_until and r <= b_until:
                        known = False
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            self.apart[left, right] = known
        return known

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian, four bytes each) of distinct pre-tokens, by one trie traversal."""
        todo = sorted((w.encode(), w) for w in words)
        ending, apart, packed, stays_apart = self.ending, self.apart, self.packed, self.stays_apart
        before, last, start = b"", [-1], [-1]  # states of the path, one for each depth
        out = {}
        for word, text in todo:
            n, shared = len(word), 0
            most = min(n, len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            for end in range(shared, n):
                node, begin, fits = ending, end + 1, []
                while begin:
                    begin -= 1
                    node = node.get(word[begin])
                    if node is None:
                        break
                    if -1 in node:
                        fits.append((node[-1], begin))
                for token, begin in reversed(fits):  # the longest first
                    if begin:
                        left = last[begin]
                        if left < 0:
                            continue
                        ok = apart.get((left, token))
                        if not (stays_apart(left, token) if ok is None else ok):
                            continue
                    last.append(token)
                    start.append(begin)
                    break
                else:
                    last.append(-2)
                    start.append(-1)
            found, at = [], n
            while at > 0:
                found.append(packed[last[at]])
                at = start[at]
            found.reverse()
            out[text] = b"".join(found)
            before = word
        return out

    # Keys of the cache: a word alone stands for a space and the word; one that starts with a line
    # feed, or with a null character before it, stands for itself.

    @staticmethod
    def _said(key: str) -> str:
        return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key

    @staticmethod
    def _key(word: str) -> str:
        return word[1:] if word[0] == " " and word[1:2] not in _BLANK else "\0" + word

    def _learn(self, keys: list[str]) -> None:
        """Put keys into the cache. What a key stands for is the pattern's own cut, so one or more pre-tokens."""
        cuts = {k: self.pattern.findall(self._said(k)) for k in keys}
        new = [w for w in {w for c in cuts.values() for w in c} if self._key(w) not in self.cache]
        self.cache.update((self._key(w), ids) for w, ids in self.encode_words(new).items())
        self.cache.update((k, b"".join([self.cache[self._key(w)] for w in c])) for k, c in cuts.items())

    def _cut(self, text: str) -> list[str]:
        """Keys of a text in order. A single space starts a new pre-token and a single line
        feed is one; any other white space goes through the pattern itself."""
        if _IRREGULAR.search(text):
            return ["\0" + w for w in self.pattern.findall(text)]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\0" + keys[0]
        return keys

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (little-endian, four bytes each); none for a null text."""
        pieces: list[list[str | int]] = []
        for text in texts:
            if not text:
                pieces.append([])
            elif self.split is None or not any(k in text for k in self.added):
                pieces.append(self._cut(text))
            else:
                keys: list[str | int] = []
                for part in self.split.split(text):
                    if part in self.added:
                        keys.append(self.added[part])
                    elif part:
                        keys += self._cut(part)
                pieces.append(keys)
        new = [k for k in set().union(*pieces).difference(self.cache) if isinstance(k, str)]
        if len(self.cache) + 2 * len(new) > CACHE_WORDS:
            self.cache.clear()
            new = [k for k in set().union(*pieces) if isinstance(k, str)]
        for at in range(0, len(new), 50_000):
            self._learn(new[at : at + 50_000])
        self.cache.update((i, self.packed[i]) for i in self.added.values())
        return [b"".join(map(self.cache.__getitem__, keys)) for keys in pieces]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept for the life of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_COLUMNS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "decoded": (T.StringType(), pa.string()),
    "n_tokens": (T.LongType(), pa.int64()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode each whole text and decode it again.

    keep: columns of docs that are carried over. outputs: of ids, decoded, n_tokens,
    ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.
    A null text counts as empty: no ids, an empty decoded text. Rows are independent, so
    repeated rows give repeated results; an empty table gives an empty one. Other columns of
    docs are not read, so their names can't clash. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for batch in batches_of_rows(whole):
                cols: dict[str, list] = {c: [] for c in outputs}
                for packed in enc.encode(batch.column(len(keep)).to_pylist()):
                    ids = memoryview(packed).cast("I").tolist()
                    for c in outputs:
                        if c == "n_tokens":
                            cols[c].append(len(ids))
                        elif c == "ids":
                            cols[c].append(ids)
                        elif c == "ids_sha256":
                            cols[c].append(hashlib.sha256(",".join(map(enc.decimal.__getitem__, ids)).encode()).hexdigest())
                        else:
                            said = enc.decode(ids)
                            cols[c].append(said if c == "decoded" else hashlib.sha256(said.encode()).hexdigest())
                made = [pa.array(cols[c], _COLUMNS[c][1]) for c in outputs]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *outputs])

    ship(docs.sparkSession)
    read = docs.select(*keep, docs[text].alias("_text"))
    schema = T.StructType([*[read.schema[c] for c in keep], *[T.StructField(c, _COLUMNS[c][0]) for c in outputs]])
    return read.mapInArrow(run, schema)
