"""Line dedup by content-defined chunks.

A text's lines are cut several times, each time by its own rolling hash: a polynomial over the
hashes of the last one or more lines (WINDOWS), which changes by one line at each step. Where it falls below
DENSITY while it was not at the line before, a chunk ends; so chunks have two lines at least, and a boundary
depends on the lines of its window and the one before alone: an inserted line changes
the chunk it stands in and leaves the others as they are. Where one cutting has a run's edge in the wrong place, another
may fit. Chunks with two or more lines that have a word and that occur again, in the same document or another,
in any cutting, are removed but for the first occurrence in order of key and position. Hashes only find
candidates; the decision groups by the chunk's bytes.

Only DataFrame functions are used. Lines are hashed once and the chunks' hashes written; texts travel by key
only, and chunk texts only for chunks whose hash occurs more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivolith.llm.common import others, written
from pivolith.llm.quality import bind

#: Lines under the rolling hash of each cutting; the cuttings use different bytes of the lines' hashes.
WINDOWS = (1, 1, 2)
#: Of 256 values of the rolling hash, those that may end a chunk: half of them give four lines a chunk.
DENSITY = 128
TIMES = 5
_HEX = "0123456789abcdef"


def _cut(size: Column, hashed: Column, byte: int, window: int, density: int) -> Column:
    """array<struct<at, n>>: the chunks of two lines or more of one cutting."""

    def digit(h: Column, k: int) -> Column:
        return F.instr(F.lit(_HEX), F.substring(h, k, 1)) - 1

    def value(i: Column) -> Column:
        h = F.get(hashed, i)
        return F.coalesce(16 * digit(h, 2 * byte + 1) + digit(h, 2 * byte + 2), F.lit(0))

    def rolled(i: Column) -> Column:
        out = value(i)
        for k in range(1, window):
            out = out + TIMES**k * F.when(i >= k, value(F.greatest(i - k, F.lit(0)))).otherwise(0)
        return out % 256

    every = F.sequence(F.lit(0), size - 1)

    def pieces(ends: Column) -> Column:
        def piece(end: Column, k: Column) -> Column:
            at = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, F.greatest(k - 1, F.lit(0))) + 1)
            return F.struct(at.alias("at"), (end - at + 1).alias("n"))

        return F.filter(F.transform(ends, piece), lambda c: c["n"] > 1)

    def ends(r: Column) -> Column:
        return F.filter(every, lambda i: (i == size - 1) | ((i > 0) & (F.get(r, i) < density) & (F.get(r, F.greatest(i - 1, F.lit(0))) >= density)))

    return bind(F.transform(every, rolled), lambda r: bind(ends(r), pieces))


def body(lines: Column, at: Column, n: Column) -> Column:
    return F.concat_ws("\n", F.slice(lines, at + 1, n))


def chunks(text: Column, windows: tuple[int, ...] = WINDOWS, density: int = DENSITY) -> Column:
    """array<struct<at, n, h>>: first line, lines and 64-bit hash of the chunks of all cuttings that have two lines with a word."""

    def of(lines: Column) -> Column:
        def among(hashed: Column) -> Column:
            return F.array_distinct(F.flatten(F.array(*[_cut(F.size(lines), hashed, b, w, density) for b, w in enumerate(windows)])))

        def worded(found: Column) -> Column:
            said = F.transform(lines, lambda s: F.length(F.translate(s, " \t\x0b\f\r", "")) > 0)
            return bind(said, lambda said: F.filter(found, lambda c: F.size(F.filter(F.slice(said, c["at"] + 1, c["n"]), lambda x: x)) > 1))

        found = bind(bind(F.transform(lines, lambda s: F.md5(s)), among), worded)
        return F.when(F.size(lines) > 1, F.transform(found, lambda c: F.struct(c["at"], c["n"], F.xxhash64(body(lines, c["at"], c["n"])).alias("h"))))

    return bind(F.split(text, "\n", -1), of)


def _own(lines: Column, listed: Column) -> Column:
    """Of the chunks listed, those that the lines have."""
    return F.filter(listed, lambda c: (c["at"] + c["n"] <= F.size(lines)) & (F.xxhash64(body(lines, c["at"], c["n"])) == c["h"]))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", windows: tuple[int, ...] = WINDOWS, density: int = DENSITY) -> DataFrame:
    """docs with `text` cut down, and n_lines_before and n_lines_removed added.

    A null text stays null, with no lines; an empty one is a single line and stays. Rows that share
    key and text count as one document, so a repeated row is not a repetition of its own; unlike texts
    of one key, or without one, are documents of their own, in order of a hash; a null key comes before
    all others. If all lines go, the text is empty. Extra columns are carried over; ones named n_lines_before or
    n_lines_removed, in any case, are replaced. An empty table stays empty. A line goes if any chunk with it goes.
    """
    text = next(c for c in docs.columns if c.lower() == text.lower())
    carried = others(docs, ("n_lines_before", "n_lines_removed", text))
    whole = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(whole).alias("_sub"), whole.alias("_text"), F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carried)]).alias("_rest"))
    same = lambda d, g: F.col(f"{d}._key").eqNullSafe(F.col(f"{g}._key")) & (F.col(f"{d}._sub") == F.col(f"{g}._sub"))
    each = written(rows.select("_key", "_sub", F.explode(chunks(F.col("_text"), windows, density)).alias("c")).select("_key", "_sub", "c.*"))
    often = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h"))  # a table, so that a frequent hash's join can be split
    listed = each.join(often, "h").groupBy("_key", "_sub").agg(F.collect_set(F.struct("at", "n", "h")).alias("_listed"))
    joined = rows.select("_key", "_sub", "_text").alias("d").join(listed.alias("l"), same("d", "l"))

    def bodies(text: Column, listed: Column) -> Column:
        return bind(F.split(text, "\n", -1), lambda lines: F.transform(_own(lines, listed), lambda c: F.struct(c["at"], c["n"], c["h"], body(lines, c["at"], c["n"]).alias("body"))))

    found = written(joined.select("d._key", "d._sub", F.explode(bodies(F.col("_text"), F.col("_listed"))).alias("c")).select("_key", "_sub", "c.*"))  # the few repeated chunks, so that the texts aren't gone through again
    first = written(found.groupBy("h", "body").agg(F.min(F.struct("_key", "_sub", "at")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h", "body", "_first"))
    later = found.join(first, ["h", "body"]).where(~F.struct("_key", "_sub", "at").eqNullSafe(F.col("_first"))).groupBy("_key", "_sub").agg(F.collect_set(F.struct("at", "n", "h")).alias("_gone"))
    both = rows.alias("d").join(later.alias("g"), same("d", "g"), "left")

    def left(lines: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform(_own(lines, F.col("_gone")), lambda c: F.sequence(c["at"], c["at"] + c["n"] - 1))))
        return bind(gone, lambda gone: F.struct(F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))).alias("text"), F.size(gone).cast("long").alias("removed")))

    made = F.when(F.col("_gone").isNull(), F.struct(F.col("_text").alias("text"), F.lit(0).cast("long").alias("removed"))).otherwise(bind(F.split("_text", "\n", -1), left))
    out = both.select("_rest", F.when(F.col("_text").isNull(), 0).otherwise(F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1).cast("long").alias("_before"), made.alias("_made"))
    kept = [c for c in docs.columns if c == text or c in carried]
    return out.select(*[F.col("_made.text" if c == text else f"_rest._{carried.index(c)}").alias(c) for c in kept], F.col("_before").alias("n_lines_before"), F.col("_made.removed").alias("n_lines_removed"))


def oracle(windows: tuple[int, ...] = WINDOWS, density: int = DENSITY) -> str:
    """DuckDB SQL for (doc_id, n_lines, n_removed, kept_sha256) over `documents` with distinct doc_ids."""
    digit = lambda k: f"(instr('{_HEX}', substr(h, 2 * b + {k}, 1)) - 1)"
    rolled = " + ".join(f"case when w > {k} then {TIMES**k} * coalesce(lag(v, {k}) over o, 0) else 0 end" for k in range(max(windows)))
    return f"""
with l as (
  select doc_id, i, line, md5(line) as h
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents where text is not null)
), v as (
  select doc_id, i, line, b, w, 16 * {digit(1)} + {digit(2)} as v from l, (values {", ".join(f"({b}, {w})" for b, w in enumerate(windows))}) t(b, w)
), r as (
  select doc_id, i, line, b, ({rolled}) % 256 as r from v window o as (partition by doc_id, b order by i)
), e as (
  select doc_id, i, line, b, case when i > 0 and r < {density} and lag(r) over (partition by doc_id, b order by i) >= {density} then 1 else 0 end as ends from r
), k as (
  select doc_id, i, line, b, coalesce(sum(ends) over (partition by doc_id, b order by i rows between unbounded preceding and 1 preceding), 0) as k from e
), c as (
  select doc_id, min(i) as at_, count(*) as n, string_agg(line, chr(10) order by i) as body, count(*) filter (where regexp_matches(line, '[^\\x20\\x09-\\x0D]')) as words from k group by doc_id, b, k
), s as (
  select *, row_number() over (partition by body order by doc_id, at_) as nth from (select distinct doc_id, at_, n, body from c where words > 1)
), gone as (
  select distinct doc_id, unnest(range(at_, at_ + n)) as i from s where nth > 1
), x as (
  select l.doc_id, count(*) as n, count(gone.i) as removed, string_agg(line, chr(10) order by l.i) filter (where gone.i is null) as kept
  from l left join gone on l.doc_id = gone.doc_id and l.i = gone.i group by l.doc_id
)
select d.doc_id, cast(coalesce(x.n, 0) as bigint) as n_lines, cast(coalesce(x.removed, 0) as bigint) as n_removed,
       case when d.text is not null then sha256(coalesce(x.kept, '')) end as kept_sha256
from documents d left join x using (doc_id)
"""
