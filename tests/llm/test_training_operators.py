"""Operators against brute force, and what they do with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pivolith.llm import bpe, embeddedup, html, langid, linededup, neardup, packing, quality, queries, substring, urlfilter
from pivolith.llm.components import components

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word%d " * 3
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, key string, n int, kept string, gone int, `a b` string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    prose = "the cat sat on the mat and then it ran away from the big old dog that lived next door to us all year long.\nIt was a fine day of the year.\nAnd so on it goes."
    long = " ".join(f"w{i % 5000}" for i in range(40_000))
    rows = [(1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \n\t "), (None, prose), (None, None), (6, long), (7, "12345 !!"), (8, "one"), (9, prose + "\nMore."), (10, "a " * 300), (11, "x\n" * 50)]
    lang = {1: "en", 2: None, 6: "de", 9: "en", 8: "fr"}
    return spark.createDataFrame([(i, t, lang.get(i), None, None, 5, 5, "k", 1, "x", 2, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_odd_rows(odd):
    n = odd.count()
    empty = odd.where("false")
    model = langid.fit(odd)
    runs = {
        "lines": lambda d: linededup.dedup_lines(d), "near": lambda d: neardup.near_duplicates(d, 2), "quality": lambda d: quality.judge(d), "lang": lambda d: langid.identify(d, model),
        "substring": lambda d: substring.remove_repeats(d, outputs=("text", "n_words", "n_removed", "kept_sha256")), "bpe": lambda d: bpe.encode_decode(d, VOCABULARY, outputs=("ids", "decoded", "n_tokens")),
    }
    for name, run in runs.items():
        assert run(odd).count() == n, name
        assert run(empty).count() == 0, name
    assert packing.pack(odd, VOCABULARY, ids=True).where("piece = 0").count() == n
    assert packing.pack(empty, VOCABULARY).count() == 0
    near = defaultdict(list)
    for r in runs["near"](odd).collect():
        near[r["doc_id"]].append((r["component_id"], r["kept"]))
    assert near[2] == [(1, False)] * 2 and near[None] == [(None, False)] * 2 and near[3] == [(3, True)] and near[9] == [(1, False)]
    said = {r["doc_id"]: r for r in runs["lang"](odd).collect()}
    assert [said[i]["lang_pred"] for i in (3, 4, 5, 7)] == ["und"] * 4 and said[3]["score"] == 0
    assert langid.identify(odd, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0
    cut = {r["doc_id"]: r for r in runs["substring"](odd).collect()}
    assert cut[1]["n_removed"] == cut[1]["n_words"] > 0 and cut[3]["text"] is None and cut[4]["text"] == ""
    lines = {r["doc_id"]: r for r in runs["lines"](odd).collect()}
    assert lines[3]["text"] is None and lines[4]["text"] == "" and lines[6]["n_lines_removed"] == 0
    assert all(r["decoded"] == (r["text"] or "") for r in bpe.encode_decode(odd, VOCABULARY, keep=("text",)).collect())


def covers(glob, url):
    """A glob against a URL, letter by letter."""
    at = {0}
    parts = re.findall(r"\*\*|\*|[^*]", glob)
    reach = lambda ks: {j for k in ks for j in range(k, len(parts) + 1) if all(x[0] == "*" for x in parts[k:j])}
    at = reach(at)
    for c in url:
        at = reach({k for k in at if k < len(parts) and (parts[k] == "**" or parts[k] == "*" and c != "/")} | {k + 1 for k in at if k < len(parts) and parts[k] == c})
    return len(parts) in at


def test_url_filter(spark):
    urls = ["http://a.org/x", "http://org/", "http://org", "https://www.EXAMPLE.org/es/1?q", "http://example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/#a", "http://x.com/de/", "ftp://a.casino-x.net", "http://a.net/casino", "http://a.net/x/affiliate/1", "http://a.net/unaffiliated", "http://adult-education.net/", "http://cheap-pills.net/a", "http://roads.net/", "http://my.ads.net/", "http://x.ads1.net/a/banner/b", "no scheme", "", None, "://org/é*", "http://a.com/.org/x", "http://" + "a." * 2000 + "org/" + "p" * 3000]

    def judge(url):
        host, path = urlfilter.canonical(url)
        fits = [r for r in urlfilter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return (host, path, best and best[0] + best[1], best[2] if best else "block" if any(covers(g, f".{host}{path}") for g in urlfilter.blocked_globs()) else "allow")

    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, *urls])], "page_id long, url string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.filter_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert got == {i: judge(u) for i, u in enumerate([*urls, *urls])}
    said = {u: got[i][3] for i, u in enumerate(urls)}
    assert [said[u] for u in ("http://a.net/x/affiliate/1", "http://a.net/unaffiliated", "http://adult-education.net/", "http://cheap-pills.net/a", "http://roads.net/", "http://my.ads.net/")] == ["block", "allow", "allow", "block", "allow", "block"]
    assert urlfilter.filter_urls(df.where("false")).count() == 0
    assert urlfilter.canonical("http://A.É/p?x#y") == ("a.É", "/p")
    many = [f"*.h{i}.org/**" for i in range(40)]  # several words
    hit = urlfilter.Automaton(many).run([b".x.h7.org/", b".h39.org/a/b", b".h40.org/"])
    assert [np.flatnonzero(r).tolist() for r in hit] == [[7], [39], []]


def cut_lines(lines, byte, window):
    """(start, end) of the chunks of one cutting."""
    value = [hashlib.md5(x.encode()).digest()[byte] for x in lines]
    rolled = [sum(5**k * value[i - k] for k in range(window) if i >= k) % 256 for i in range(len(lines))]
    ends = [i for i in range(len(lines)) if i == len(lines) - 1 or i and rolled[i] < 128 <= rolled[i - 1]]
    return list(zip([0, *(e + 1 for e in ends)], [e + 1 for e in ends], strict=False))


def test_lines_by_brute_force(spark):
    rnd = random.Random(8)
    pool = [f"line {i} of the pool" for i in range(60)] + ["", " "]
    made = {i: [rnd.choice(pool) if rnd.random() < 0.5 else f"own {i} {k}" for k in range(rnd.randint(0, 25))] for i in range(60)}
    for i in range(0, 60, 4):
        made[i][3:3] = pool[5 : 5 + rnd.randint(2, 20)]
    made[50], made[51] = list(made[0]), ["same"] * 9
    seen, gone = defaultdict(set), defaultdict(set)
    for i, x in made.items():
        for byte, window in enumerate(linededup.WINDOWS):
            for a, b in cut_lines(x, byte, window) if x else []:
                if sum(bool(y.strip()) for y in x[a:b]) > 1:
                    seen["\n".join(x[a:b])].add((i, a, b))
    for spans in seen.values():
        for i, a, b in sorted(spans)[1:]:
            gone[i] |= set(range(a, b))
    rows = [(i, "\n".join(x), "kept", 4) for i, x in made.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, _made string, N_Lines_Removed int").repartition(3)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    assert {i: (r["text"], r["n_lines_removed"]) for i, r in got.items()} == {i: ("\n".join(y for k, y in enumerate(x) if k not in gone[i]), len(gone[i])) for i, x in made.items()}
    assert got[0]["_made"] == "kept" and sum(map(len, gone.values())) > 50


def test_lines_recall(spark):
    """Runs of n lines planted into otherwise different texts: the share of the second's lines that goes."""
    rnd, rows = random.Random(1), []
    text = lambda k: [f"{k} {rnd.random()}" for _ in range(rnd.randint(5, 20))]
    for n in (5, 10, 20):
        for t in range(300):
            run = [f"run {n} {t} {k}" for k in range(n)]
            rows += [(len(rows), "\n".join([*text("a"), *run, *text("b")]), n), (len(rows) + 1, "\n".join([*text("c"), *run, *text("d")]), n)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n int")).groupBy("n").agg(F.sum("n_lines_removed").alias("s")).collect()
    share = {r["n"]: r["s"] / 300 / r["n"] for r in got}
    assert share[5] > 0.3 and share[10] > 0.65 and share[20] > 0.8


def test_lines_rows_without_a_key(spark):
    a, b = "\n".join(f"a{i}" for i in range(30)), "\n".join(f"b{i}" for i in range(30))
    rows = [(None, a), (None, a), (None, b), (1, a), (2, None), (2, "")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lost = defaultdict(list)
    for r in got:
        lost[r["doc_id"], r["n_lines_before"], (r["text"] or "")[:1]].append(r["n_lines_removed"])
    assert lost[None, 30, "a"] == [0, 0] and lost[None, 30, "b"] == [0] and lost[2, 0, ""] == [0] and lost[2, 1, ""] == [0]
    assert sum(sum(v) for k, v in lost.items() if k[0] == 1) > 20


def test_substring(spark):
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    made = {i: [f"w{rnd.randint(0, 9)}" if i % 3 else f"u{i}_{k}" for k in range(rnd.randint(0, 90))] for i in range(40)}
    for i in (3, 9, 21, 33):
        made[i][5:5] = passage[i % 7 :]
    made[12] = ["a", "b", "c"] * 20
    df = spark.createDataFrame([(i, "  ".join(w)) for i, w in made.items()], "doc_id long, text string").repartition(3)
    seen, gone = {}, defaultdict(set)
    for i in sorted(made):
        for p in range(len(made[i]) - 19):
            w = tuple(made[i][p : p + 20])
            if w in seen:
                gone[i] |= set(range(p, p + 20))
            seen.setdefault(w, i)
    want = {i: (len(w), len(gone[i]), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone[i]).encode()).hexdigest()) for i, w in made.items()}
    got = substring.remove_repeats(df, outputs=("n_words", "n_removed", "kept_sha256")).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and any(gone.values())


def test_substring_unlike_texts_of_one_key(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    unique = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, "a " * 300), (None, unique("u", 400)), (None, unique("v", 5)), (None, None), (7, unique("w", 60)), (7, "b " * 100), (7, "b " * 100), (8, passage + " x"), (8, passage + " y"), (9, unique("w", 60))]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lost = defaultdict(list)
    for r in got:
        lost[r["doc_id"], (r["text"] or "")[:1], r["n_words"]].append(r["n_removed"])
    assert len(got) == len(rows) and lost[None, "u", 400] == [0] and lost[None, "v", 5] == [0] and lost[None, "", 0] == [0]
    assert sorted(n for (i, _, _), v in lost.items() for n in v if i == 8) == [0, 30]
    assert lost[7, "w", 60] == [0] and lost[7, "b", 100] == [99, 99] and lost[9, "", 60] == [60]
    assert lost[None, "a", 300] == [299]


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack(docs, VOCABULARY, ids=True).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 1024
    for i, t in texts(docs).items():
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert sum((r["ids"] for r in own), []) == [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert all(r["length"] == 1024 for r in own[1:]) and [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
    for own in by_bin.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist() and sum(r["length"] for r in own) <= 1024
    assert len(by_bin) <= -(-sum(r["length"] for r in rows) // 1024) * 1.01 + 1


@pytest.mark.parametrize("counts", [{}, {1024: 3}, {600: 5, 400: 7, 500: 3}, {342: 9}, {1: 5000, 1000: 7}, {513: 4, 511: 9, 30: 100}])
def test_plan(counts):
    bins = packing.plan(counts, 1024)
    used = Counter()
    for items, n in bins:
        assert sum(items) <= 1024 and sum(3 * x > 1024 for x in items) <= 2
        for x in items:
            used[x] += n
    assert used == Counter(counts)


def test_near_duplicates(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    made = {}
    for i in range(150):
        w = list(base) if i % 2 else [f"w{rnd.randint(0, 400)}" for _ in range(100)]
        for _ in range(rnd.randint(0, 16)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 99)}"
        made[i] = " ".join(w).upper() if i % 5 == 0 else "\t".join(w)
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} for i, t in made.items() for w in [t.lower().split()]}
    parent = {i: i for i in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in sets:
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in neardup.near_duplicates(df, 2).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates_with_unlike_texts_of_one_key(spark):
    said = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(5, said("a", 50)), (5, said("b", 50)), (3, said("a", 50)), (9, said("b", 50)), (9, said("b", 50)), (7, said("c", 50)), (7, None), (8, None), (None, said("a", 50)), (4, said("d", 9)), (2, "e")]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect())
    assert got == [(-1, 49, None, False), (2, 1, 2, True), (3, 49, 3, True), (4, 8, 4, True), (5, 49, 3, False), (5, 49, 3, False), (7, 0, 7, True), (7, 49, 7, True), (8, 0, 8, True), (9, 49, 3, False), (9, 49, 3, False)]


def test_shared_values_and_cells_of_sets():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        x, y = (np.unique(rnd.integers(0, 40, rnd.integers(1, 30)).astype(np.uint64) << np.uint64(58 + rnd.integers(0, 2))) for _ in range(2))
        assert neardup.shared_values(x, y) == len(set(x.tolist()) & set(y.tolist()))


def test_components_with_hubs(spark):
    rnd = random.Random(3)
    edges = [(0, i) for i in range(1, 700)] + [(90_000, i) for i in range(10_000, 10_700)]  # hubs below and above their neighbours
    edges += [(i, i + 1) for i in range(20_000, 20_040)] + [(10_005, 20_040), (5, 5)]
    edges += [(rnd.randrange(30_000, 30_400), rnd.randrange(30_000, 30_400)) for _ in range(250)]
    edges += [(b, a) for a, b in edges[::7]]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    rows = [(a, b) for a, b in edges] + [(None, 1), (1, None)]
    found = components(spark.createDataFrame(rows, "a long, b long").repartition(8))
    assert sorted(map(tuple, found.collect())) == sorted((x, root(x)) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_in_a_wide_bucket(spark):
    """Many texts around one template: links between some, none between most; no cell holds sets unless close pairs are dense."""
    base = [f"t{i}" for i in range(60)]
    made = {i: base[:40] + [f"u{i // 3}_{k}" for k in range(30)] + ([f"x{i}"] if i % 3 else []) for i in range(900)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 2).collect()}
    assert got == {i: i - i % 3 for i in made}


def test_quality(docs):
    def stats(t):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        seen, cover = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                cover |= {i, i + 1, i + 2}
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover))

    said = texts(docs)
    rows = quality.judge(docs).collect()
    for r in rows:
        s = stats(said[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == s
        assert r["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not (r["base_failed"] and r["kept"])
    share, chances = quality.estimate([((1, 1, None), 90), ((0, 0, 0), 10), ((1, None, 1), 20)])
    assert 0.8 < share < 1 and quality.posterior((0, 0, 0), share, chances) < 0.5 < quality.posterior((1, 1, None), share, chances)


def test_quality_votes_weighed_by_another_em(docs):
    """The classes' tables by plain arrays: same start, same prior, fixed rounds."""
    rows = quality.judge(docs).collect()
    votes = [c for c in rows[0].asDict() if c.startswith("vote_")]
    code = np.array([[2 if r[v] is None else r[v] for v in votes] for r in rows])
    used = np.array([r["n_words"] > 0 for r in rows])
    hot = np.eye(3)[code[used]]
    start = np.array([quality.BEFORE[0], quality.BEFORE[1]])[:, None, :].repeat(len(votes), 1)
    table, share, weight = start.copy(), 0.8, 1 + 0.01 * used.sum()
    for _ in range(200):
        logs = np.einsum("dro,cro->dc", hot, np.log(table)) + np.log([1 - share, share])
        p = 1 / (1 + np.exp(logs[:, 0] - logs[:, 1]))
        table = np.stack([(weight * start[c] + np.einsum("d,dro->ro", w, hot)) / (weight + w.sum()) for c, w in enumerate((1 - p, p))])
        share = (1 + p.sum()) / (2 + len(p))
    logs = np.einsum("dro,cro->dc", np.eye(3)[code], np.log(table)) + np.log([1 - share, share])
    good = logs[:, 1] >= logs[:, 0]
    sure = np.abs(logs[:, 1] - logs[:, 0]) > 1e-6
    assert all(r["kept"] == (bool(g) and not r["base_failed"]) for r, g, x in zip(rows, good, sure, strict=True) if x) and 0 < good.sum() < len(good)


def test_language_by_brute_force(docs):
    """Profiles, margins and decoding, one n-gram, bit and codeword at a time."""
    model = langid.fit(docs)
    said = [*list(texts(docs).values())[:25], "", None, "12 !", "Ünï\0cödé ÉCOLE x"]
    got, has = langid.profile(said)
    names, score, lead = model.decode(got)
    for k, t in enumerate(said):
        kept = [" "]
        for c in (t or "").replace("\0", " ").lower():
            if c.isalpha():
                kept.append(c)
            elif kept[-1] != " ":
                kept.append(" ")
        count = np.zeros(langid.WIDTH)
        for n in (1, 2, 3):
            for i in range(len(kept) - n + 1):
                gram = kept[i : i + n]
                if gram[0] == " " == gram[-1]:
                    continue
                h = naive_gram([ord(c) for c in gram])
                count[(h * 0xD6E8FEB86659FD93 % 2**64) >> 52] += 1
        want = np.sqrt(count)
        want = want / (np.linalg.norm(want) or 1)
        assert bool(has[k]) == any(c.isalpha() for c in t or "")
        if has[k]:
            assert np.allclose(got[k], want)
            margin = [sum(want[i] * model.w[i][b] for i in np.flatnonzero(want)) + model.w[-1][b] for b in range(model.code.shape[1])]
            loss = {n: sum(model.trust[b] * np.log1p(np.exp(-m * model.code[j][b])) for b, m in enumerate(margin)) for j, n in enumerate(model.langs)}
            best = sorted(loss, key=loss.get)
            p = [np.exp(loss[best[0]] - loss[n]) for n in best]
            assert names[k] == best[0] and np.isclose(score[k], p[0] / sum(p), atol=1e-4) and np.isclose(lead[k], (p[0] - p[1]) / sum(p), atol=1e-4)


def naive_gram(code):
    """The hash of a gram: each longer one from the shorter one before it, with its length added."""
    h = 0
    for n, c in enumerate(code, 1):
        h = (h * 0x9E3779B97F4A7C15 + c + n) % 2**64
    return h


def test_extra_columns_with_clashing_names(odd):
    model = langid.fit(odd)
    more = odd.withColumn("Lang_Pred", F.lit("x")).withColumn("SCORE", F.lit(0.25)).withColumn("_0", F.lit(1)).withColumn("_rest", F.lit(2)).withColumn("_text", F.lit(3))
    said = langid.identify(more, model)
    assert said.count() == odd.count() and [c for c in said.columns if c.lower() == "score"] == ["score"]
    cut = substring.remove_repeats(more.withColumn("N_Words", F.lit(1)))
    assert cut.select("_0", "_rest", "_text", "n_words", "text").count() == odd.count()


def test_batches_are_bounded():
    import pyarrow as pa

    from pivolith.llm.common import batches_of_rows

    sizes = [10, 5_000_000, 20, 3_000_000, 3_000_000, *[1000] * 600]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(["x" * n for n in sizes])], ["i", "t"])
    parts = list(batches_of_rows(batch, 256))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or sum(sizes[i] for i in p.column(0).to_pylist()) <= 4 << 20 for p in parts) and max(p.num_rows for p in parts) <= 256


def test_long_texts_within_memory(tmp_path):
    """Sixteen texts of 5 MB through the language profile, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, sys
import pyarrow as pa
from pivolith.llm import langid
from pivolith.llm.common import batches_of_rows
batch = pa.RecordBatch.from_arrays([pa.array(["some words of a long text " * 200_000] * 16)], ["t"])
langid.profile(["a"])
for part in batches_of_rows(batch, 64):
    langid.profile(part.column(0).to_pylist())
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/root/repo", check=True).stdout
    assert int(out.split()[-1]) < 1500


def test_language(docs):
    rows = queries.op7_language_id(docs.sparkSession, "/root/testdata/sf0.01").join(docs.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", F.length("text").alias("size")), "doc_id").where("held_out and size > 100").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 100
    for n in (2, 3, 4, 7, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n and set(np.unique(code)) == {-1.0, 1.0}


def test_embeddings(spark):
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((300, 24))
    x[50:120] = x[0] + 0.05 * rnd.standard_normal((70, 24))
    x[130] = 3 * x[131]
    x[140] = x[141]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, None] * 12), (904, [1.0]), (None, [float(v) for v in x[0]])]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links = {i: int(near[i].sum()) - 1 for i in range(300)}
    assert sum(got[i][0] for i in links) >= 0.98 * sum(links.values()) and all(got[i][0] <= links[i] for i in links)
    assert got[140][0] == 1 and got[141][1] == 140 and got[60][1] == 0 and got[131][1] == 130
    assert all(got[i] == (0, i, True) for i in range(900, 905)) and got[None] == (0, None, False)
    assert embeddedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_embeddings_of_several_lengths_and_sizes(spark):
    big = [1e308, 1e308, 1e308]
    rows = [(1, big), (2, big), (3, [1.0, 2.0]), (4, [2.0, 4.0]), (5, [1.0, -2.0]), (6, [1e-300, 2e-300]), (7, []), (8, [0.0, -0.0]), (9, [float("inf"), 1.0]), (9, [7.0]), (11, [3.0]), (12, [-3.0]), (3, [1.0, 2.0])]
    rows += [(100 + i, [float(x) for x in r]) for i, r in enumerate(np.random.default_rng(1).standard_normal((400, 9)))]
    rows += [(600 + i, [2 * x for x in r[1]]) for i, r in enumerate(rows[-400:])]
    got = defaultdict(list)
    for r in embeddedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r["vec_id"]].append(tuple(r)[1:])
    assert got[1] == [(1, 1, True)] and got[2] == [(1, 1, False)] and got[3] == [(3, 3, True)] * 2 and got[4] == got[6] == [(3, 3, False)] and got[5] == [(0, 5, True)]
    assert got[7] == [(0, 7, True)] and got[8] == [(0, 8, True)] and sorted(got[9]) == [(0, 9, True), (1, 9, True)] and got[11] == [(1, 9, False)] and got[12] == [(0, 12, True)]
    assert all(got[600 + i][0][1] == got[100 + i][0][1] <= 100 + i for i in range(400))


def test_embeddings_recall_near_the_threshold(spark):
    """Pairs planted at cosines from 0.95 to 0.97, against brute force."""
    rnd = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rnd.standard_normal((1500, 64)))
    side = rnd.standard_normal(x.shape)
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    c = rnd.uniform(0.95, 0.97, (len(x), 1))
    every = np.concatenate([x, c * x + np.sqrt(1 - c * c) * side])
    near = unit(every) @ unit(every).T >= 0.95
    want = near.sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddedup.near_vectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(every)], "vec_id long, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.985 * want.sum() > 2900 and all(got[i] <= n for i, n in enumerate(want))


def with_a_common_mean(common, n):
    """Unit vectors of this mean cosine, and for each one at a cosine of 0.95 to 0.96."""
    rnd = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(np.sqrt(common) * np.eye(1, 64) + np.sqrt((1 - common) / 64) * rnd.standard_normal((n, 64)))
    side = rnd.standard_normal(x.shape)
    cosine = rnd.uniform(0.95, 0.96, (n, 1))
    return x, cosine * x + np.sqrt(1 - cosine**2) * unit(side - (side * x).sum(1, keepdims=True) * x)


@pytest.mark.parametrize(("common", "count"), [(0.0, 15_000), (0.72, 15_000), (0.72, 10_000_000), (0.9, 2_000)])
def test_codes_with_a_common_mean(common, count):
    x, y = with_a_common_mean(common, 6000)
    codes = embeddedup.Codes(x[:4096], count, 0.95, 0.005)
    a, b = codes.chunks(x[4096:]), codes.chunks(y[4096:])
    assert codes.meet(a, b).mean() >= 0.985


def test_html(spark):
    chain = html.default_chain()
    wrong = total = 0
    for page, labels in html.labelled_pages(120, seed=123):
        blocks = html.leaf_blocks(page)
        if blocks:
            found = chain.viterbi([sum(chain.weight.get(f, 0.0) for f in html.features(*b)) for b in blocks])
            wrong, total = wrong + sum(a != b for a, b in zip(found, labels, strict=True)), total + len(labels)
    assert wrong <= 0.01 * total
    page = '<html><head><title>t</title><script>if (a < b) "</p>"</script></head><body><nav>Home <a href="/">a</a></nav><article><h1>A &amp; B</h1><p>One<b> two\n three<br>four<p>Five &lt;&eacute;&#x41;&nbsp;x</article><form>Name</form><footer>&copy; x</footer>'
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>x"), (5, "u", "<<>< & <!-- never closed"), (6, "u", "<article>" + "<p>word and more. " * 20_000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.extract_main_text(df).collect()}
    assert got[1]["text"] == "A & B\nOne two three four\nFive <éA x" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[6]["text"].count("\n") == 19_999


def test_html_viterbi_by_brute_force():
    chain = html.default_chain()
    (oo, om), (mo, mm) = chain.move
    step = {(0, 0): oo, (0, 1): om, (1, 0): mo, (1, 1): mm}
    for page, _ in html.labelled_pages(150, seed=77):
        blocks = html.leaf_blocks(page)
        if 0 < len(blocks) <= 11:
            score = [sum(chain.weight.get(f, 0.0) for f in html.features(*b)) for b in blocks]
            total = lambda ls: sum(x for x, y in zip(score, ls, strict=True) if y) + sum(step[a, b] for a, b in zip(ls, ls[1:], strict=False))  # noqa: E731, B023
            best = max((tuple(n >> k & 1 for k in range(len(blocks))) for n in range(2 ** len(blocks))), key=total)
            assert abs(total(best) - total([int(x) for x in chain.viterbi(score)])) < 1e-9


PAGES = [
    ('<header><h1>Daily News</h1></header><div><h1>A thing happened</h1><p>This is a long text of the article, which says a lot.</p><p>And more of it follows here, in another sentence.</p></div>', "A thing happened\nThis is a long text of the article, which says a lot.\nAnd more of it follows here, in another sentence."),
    ('<header><h1>Daily News</h1></header><div><p>This is a long text of the article, which says a lot.</p><p>And more of it follows here, in another sentence.</p></div><div class="reply"><b>Bob</b><p>Nice post!</p></div><div class="reply"><b>Al</b><p>I do not agree at all with what you say.</p></div>', "This is a long text of the article, which says a lot.\nAnd more of it follows here, in another sentence."),
    ('<article><h1>T</h1><p>Long enough a text for an article, it says.</p></article><section id="respond"><h3>Replies</h3><div><b>Bo</b><p>So nice.</p></div><div><b>Al</b><p>Not at all.</p></div></section>', "T\nLong enough a text for an article, it says."),
    ('<nav><a href="/">Home</a></nav><article><h1>Title</h1><p>One <math><mi>x</mi></math> two <canvas>c</canvas> <object>obj</object> three.</p><svg><p>Still here, the svg never ends.</article><footer>&copy; x</footer>', "Title\nOne x two c obj three.\nStill here, the svg never ends."),
    ("<article><p data-id=\"a'b>c\" title='>'>Quoted &gt; signs &amp;amp; all.<template><p>no</p></template><noscript>no</noscript> End.</p></article>", "Quoted > signs &amp; all. End."),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_html_pages(page, text):
    assert html.default_chain().extract(page) == text


def test_html_time_is_linear():
    import time

    chain = html.default_chain()
    for page in ("<div>x", "<a b='c' d=\"e\">", "<p class=q>x</section>", "<ul><li>x"):
        spent = []
        for n in (4000, 40_000):
            runs = []
            for _ in range(3):
                began = time.perf_counter()
                chain.extract(page * n)
                runs.append(time.perf_counter() - began)
            spent.append(min(runs))
        assert spent[1] < 25 * spent[0] + 0.5, page


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "y"), (None, "u", "<article><p>Some text of the article here.", "z")], "page_id long, url string, html string, text string")
    got = html.extract_main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted((r["page_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, 30), (1, 0), (1, 0)]
    assert html.extract_main_text(df.where("false")).count() == 0


def test_bpe_round_trip(docs):
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(VOCABULARY), bpe.Encoder(VOCABULARY)
    rnd = random.Random(1)
    parts = [*"aabcde  \n\n\t'sSt.=-012é漢😀<|>\x00", "<|endoftext|>", "'ll", " the", "ing", "\r\n", "\x85", "\x1c", "  ", " \n"]
    said = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [c * n for c in "a- \n=" for n in (1, 2, 7, 129, 3000)] + ["ab" * 4000]
    for t, packed in zip(said, enc.encode(said), strict=True):
        ids = memoryview(packed).cast("I").tolist()
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids == want and enc.decode(ids) == tok.decode(want, skip_special_tokens=False)
    real = texts(docs)
    for r in queries.op10_bpe(docs.sparkSession, SF).collect():
        ids = tok.encode(real[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_queries_match_sql(spark):
    import duckdb

    c = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF), c.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns), name
        assert sorted(str([r[x] for x in columns]) for r in got.collect()) == sorted(str(list(r)) for r in want.fetchall()), name
