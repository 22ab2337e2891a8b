"""URL filters by a bit-parallel wildcard automaton.

Every glob is a run of bits in one multiword Shift-And state: bit 0 of a glob is its start, bit
j says that its first j literals have been read. One step for a byte c is

    state = ((state << 1) & literal[c]) | (state & loop[c])

where `literal` holds the bits whose literal is c and `loop` the bits that stand before a
wildcard which takes c. All globs advance together, and a whole batch of URLs is stepped at
once in numpy, one column of bytes at a time, the URLs ordered by length.

Globs: `*` takes any bytes but `/`, `**` any bytes, anything else itself. A glob has to cover
the whole canonical URL, which is "." + host + path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pivolith.llm.common import batches_of_rows, ship

#: (host, path, verdict); a rule fits its host and all subdomains and paths that start with its path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Globs that block a URL which no rule fits; any other such URL is allowed.
BLOCKED_FILE = Path(__file__).with_name("blocked_urls.txt")


def read_globs(text: str) -> list[str]:
    """The globs of a block list, whose format its own head explains."""
    out: list[str] = []
    for line in text.splitlines():
        kind, _, word = line.partition("#")[0].strip().partition(" ")
        word = word.strip()
        if kind == "host":
            out += [f"*{before}{word}{after}**" for before in ".-" for after in ".-"]
        elif kind == "part":
            out += [f"**/{word}", f"**/{word}/**"]
        elif kind == "glob":
            out.append(word)
        elif kind:
            raise ValueError(f"a block list has no lines of the kind {kind!r}")
    return list(dict.fromkeys(out))


@lru_cache(1)
def blocked_globs() -> tuple[str, ...]:
    return tuple(read_globs(BLOCKED_FILE.read_text()))


def as_regex(glob: str) -> str:
    """A regular expression that matches what the glob covers, for engines whose dot can take a line feed."""
    return "(?s)^" + "".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.split(r"(\*\*|\*)", glob)) + "$"


class Automaton:
    """Globs packed into the words of one Shift-And state."""

    def __init__(self, globs: Sequence[str]) -> None:
        bits, starts, ends, any_, within = [], [], [], [], []
        for glob in globs:
            raw, k = glob.encode(), 0
            starts.append(len(bits))
            bits.append(-1)  # no byte leads to a start
            while k < len(raw):
                if raw[k] == 42:
                    double = raw[k : k + 2] == b"**"
                    (any_ if double else within).append(len(bits) - 1)
                    k += 1 + double
                else:
                    bits.append(raw[k])
                    k += 1
            ends.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.start = self._pack(starts)
        self.ends = ends
        self.literal = np.stack([self._pack([i for i, b in enumerate(bits) if b == c]) for c in range(256)])
        slash = self._pack(any_)
        self.loop = np.stack([slash if c == 47 else slash | self._pack(within) for c in range(256)])

    def _pack(self, bits: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def run(self, urls: Sequence[bytes]) -> np.ndarray:
        """A row for each URL, a column for each glob: whether it covers the URL."""
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-size, kind="stable")
        at = np.concatenate([[0], np.cumsum(size)])[:-1][order]
        flat = np.frombuffer(b"".join(urls), np.uint8)
        state = np.repeat(self.start[None, :], len(urls), 0)
        ends = -size[order]
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(ends, -k, side="left"))  # those longer than k
            c = flat[at[:live] + k]
            now = state[:live]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.literal[c]) | (now & self.loop[c])
        out = np.empty((len(urls), len(self.ends)), bool)
        for j, b in enumerate(self.ends):
            out[order, j] = (state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def escape(text: str) -> str:
    if "*" in text:
        raise ValueError("a rule's host and path are literal; use globs for wildcards")
    return text


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """Judge every URL: key, host, path, rule, verdict.

    The longest rule that fits decides; of equally long ones a blocking one, then the first in text
    order. Without a rule a URL is blocked if a glob of `blocked` (by default those of blocked_urls.txt) covers
    it, and allowed otherwise.
    A null URL or one without "://" has an empty host and path, fits no rule and is allowed, as are
    empty texts. Rows are judged alone, so repeated rows repeat; an empty table gives an empty
    one; columns other than key and url are not read, whatever their names. No shuffle.
    """
    ship(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    blocked = blocked_globs() if blocked is None else blocked
    globs = [f"*.{escape(h)}{escape(p)}**" for h, p, _ in ranked]
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton([*globs, *blocked])
        for whole in batches:
            for batch in batches_of_rows(whole, 8192):
                parts = [canonical(u) for u in batch.column(1).to_pylist()]
                hit = machine.run([f".{h}{p}".encode() for h, p in parts])
                fits = hit[:, : len(ranked)]
                which = np.where(fits.any(1), fits.argmax(1), -1)
                bad = hit[:, len(ranked) :].any(1)
                rule = [ranked[w][0] + ranked[w][1] if w >= 0 else None for w in which]
                verdict = [ranked[w][2] if w >= 0 else "block" if b else "allow" for w, b in zip(which, bad, strict=True)]
                host, path = ([p[i] for p in parts] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in (host, path, rule, verdict))], [key, "host", "path", "rule", "verdict"])

    return pages.select(F.col(f"`{key}`"), F.col(f"`{url}`")).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")
