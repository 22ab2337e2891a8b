"""Quality by weak supervision: rules vote or abstain, EM weighs them.

Each rule looks at statistics of a whole text and votes good (1), bad (0) or abstains (null).
Expectation-maximisation over the vote patterns estimates how often each rule votes either way in
good and in bad texts, and the share of good texts; a text is kept if its posterior
probability of being good is at least one half. Only DataFrame functions run on the rows;
the patterns, at most 3 to the number of rules whatever the input, are counted in Spark and
the estimates made from these counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivolith.llm.common import written

#: Frequent words of four languages; prose has some of them.
FUNCTION_WORDS = "the of and to in a is that for it was on as with be by der die und in den von zu das mit sich des auf für ist de la le et les des en un une que qui dans pour el los se del las por con una su al lo".split()
_SPACE = r"[\x20\x09-\x0D]+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def statistics(text: Column) -> Column:
    """A struct of counts over a whole text; zeros for a null one.

    n_repeat_words counts the words inside three-word windows that occur twice or more in the text,
    the first occurrence included. Windows are compared by 64-bit hashes. They are sorted with
    their positions, so equal ones are neighbours; a text without repeats isn't sorted.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    squeezed = F.translate(text, " \t\n\x0b\f\r", "")
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, " \t\x0b\f\r", "")) > 0)

    def covered(found: Column) -> Column:
        return F.aggregate(F.transform(found, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(found, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def repeats(h: Column) -> Column:
        def among(pairs: Column) -> Column:
            same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            again = F.filter(pairs, lambda p, k: same(p, F.when(k > 0, F.get(pairs, k - 1))) | same(p, F.get(pairs, k + 1)))
            return bind(F.sort_array(F.transform(again, lambda p: p["i"])), covered)

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), bind(pairs, among)).otherwise(F.lit(0))

    def windows(w: Column) -> Column:
        h = F.transform(w, lambda x: F.xxhash64(x))
        at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return bind(h, lambda h: bind(F.transform(at, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))), repeats))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(squeezed).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long")).alias("n_dup_lines"),
            windows(w).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.length(F.regexp_replace(squeezed, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace(squeezed, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
            F.size(F.array_intersect(F.transform(w, F.lower), F.array(*map(F.lit, dict.fromkeys(FUNCTION_WORDS))))).cast("long").alias("n_function_words"),
            F.size(F.filter(w, lambda x: F.endswith(x, F.lit("!!")))).cast("long").alias("n_shouts"),
        )

    return bind(words, of)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def rules() -> dict[str, Column]:
    """Votes over the columns of statistics()."""
    c = F.col
    return {
        "symbols": _vote(c("n_symbols") * 50 <= c("n_words"), c("n_symbols") * 5 > c("n_words")),
        "lines": _vote((c("n_lines") > 1) & (c("n_dup_lines") == 0), c("n_dup_lines") * 10 > c("n_lines") * 3),
        "repeats": _vote(c("n_repeat_words") * 10 <= c("n_words"), c("n_repeat_words") * 10 > c("n_words") * 3),
        "word_length": _vote(c("word_chars").between(c("n_words") * 3, c("n_words") * 9), ~c("word_chars").between(c("n_words") * 2, c("n_words") * 14)),
        "capitals": _vote(c("n_upper") * 5 <= c("n_letters"), c("n_upper") * 2 > c("n_letters")),
        "letters": _vote(c("n_letters") * 10 >= c("word_chars") * 9, c("n_letters") * 10 < c("word_chars") * 7),
        "function_words": _vote(c("n_function_words") >= 4, c("n_function_words") == 0),
        "shouting": _vote(c("n_shouts") * 100 <= c("n_words"), c("n_shouts") * 5 > c("n_words")),
    }


#: What a rule does on a bad and on a good text before any counting: votes bad, votes good, abstains.
BEFORE = {0: (0.5, 0.3, 0.2), 1: (0.02, 0.78, 0.2)}
_OUTCOME = {0: 0, 1: 1, None: 2}

#: chances[class][rule][outcome], outcomes in the order of BEFORE.
Chances = dict[int, list[tuple[float, ...]]]


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 200, weight: float = 0.01) -> tuple[float, Chances]:
    """Share of good texts, and how often each rule votes bad, good or abstains in either class.

    BEFORE is the start and stays in every estimate as `weight` times the number of texts, so
    that the two classes can't swap and a rule that one kind of junk alone sets off still
    counts."""
    n = len(patterns[0][0])
    total = sum(c for _, c in patterns)
    prior = 1 + weight * total
    share, chances = 0.8, {k: [BEFORE[k]] * n for k in (0, 1)}
    for _ in range(rounds):
        p = [posterior(v, share, chances) for v, _ in patterns]
        new: Chances = {}
        for k in (0, 1):
            own = [(v, c * (x if k else 1 - x)) for (v, c), x in zip(patterns, p, strict=True)]
            size = prior + sum(c for _, c in own)
            new[k] = [tuple((prior * BEFORE[k][o] + sum(c for v, c in own if _OUTCOME[v[r]] == o)) / size for o in range(3)) for r in range(n)]
        now = (1 + sum(c * x for (_, c), x in zip(patterns, p, strict=True))) / (2 + total)
        moved = max(abs(now - share), *(abs(a - b) for k in (0, 1) for x, y in zip(new[k], chances[k], strict=True) for a, b in zip(x, y, strict=True)))
        share, chances = now, new
        if moved < 1e-9:
            break
    return share, chances


def log_odds(share: float, chances: Chances) -> tuple[float, list[tuple[float, ...]]]:
    """The odds of good before any vote, and what each outcome of each rule adds."""
    return math.log(share / (1 - share)), [tuple(math.log(g / b) for g, b in zip(good, bad, strict=True)) for bad, good in zip(chances[0], chances[1], strict=True)]


def posterior(votes: tuple[int | None, ...], share: float, chances: Chances) -> float:
    base, add = log_odds(share, chances)
    z = base + sum(a[_OUTCOME[v]] for v, a in zip(votes, add, strict=True))
    return 1 / (1 + math.exp(-max(z, -700)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, the statistics, base_failed, quality (posterior) and kept.

    base_failed: under 50 words, or over half of them repeated. A null or empty text has no words, so
    it fails. Rows are judged alone once the rules are weighed, so repeated rows get the same
    answer (each counts in the estimates); an empty table gives an empty one. Columns other than
    key and text aren't read.
    """
    votes = rules()
    stats = written(docs.select(F.col(key), statistics(F.col(text)).alias("s")).select(key, "s.*"))
    cast = stats.select("*", *[v.alias(f"vote_{n}") for n, v in votes.items()])
    counts = cast.where("n_words > 0").groupBy(*[f"vote_{n}" for n in votes]).count().collect()
    base, add = log_odds(*estimate(sorted(((tuple(r[:-1]), r[-1]) for r in counts), key=str))) if counts else (0.0, [(0.0, 0.0, 0.0)] * len(votes))
    odds = F.lit(base)
    for n, (bad, good, none) in zip(votes, add, strict=True):
        odds = odds + F.when(F.col(f"vote_{n}") == 1, good).when(F.col(f"vote_{n}") == 0, bad).otherwise(none)
    return (
        cast.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("quality", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )
