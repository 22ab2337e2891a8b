"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks: runs of text without a block element inside. A block's
features are the tags and the class and id words of its ancestors, what its text looks
like (length, share of link text, final mark, copyright sign), whether it stands before, in or after the
container with the most text of its own, and whether it shares a container with a headline. A two-label chain, trained by
maximum likelihood on labelled pages, is decoded by Viterbi; blocks of the label `main` are
the text.

The labelled pages come from labelled_pages(): templates whose blocks are known to be article
or not. They vary container, nesting, order, class names and text, and include articles without
any telling container, headlines in the page's header and comments under names that tell nothing, so that no
single feature decides.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pivolith.llm.common import batches_of_rows, ship

#: Fixed: elements of HTML that start a block of their own, that are empty, whose content is raw text that no article
#: shows, whose content isn't shown if they end, and blocks that hold other blocks rather than text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul xmp".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
HIDDEN = frozenset("svg template noscript".split())
HOLDS = frozenset("article aside body center details dialog div fieldset footer form header html main nav section table td th".split())
#: An opening tag ends an open element of its group, unless one of the limits stands between.
ENDS = {t: ({"li"}, {"ul", "ol", "menu", "dir"}) for t in ("li",)} | {t: ({"dt", "dd"}, {"dl"}) for t in ("dt", "dd")} | {t: ({"td", "th"}, {"table", "tr"}) for t in ("td", "th")} | {"tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: What moves a tag's scan on: a quoted value, or the tag's end.
_STEP = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')|>""")

#: Features of page headers; a headline there heads no article.
HEAD = frozenset({"in:header", "is:header", "is:masthead", "is:topbar", "is:banner"})

#: text, features of the ancestors, share of link text, and the place: against the page's richest container, and
#: whether the block's own container has a headline
Block = tuple[str, tuple[str, ...], float, str]


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks in page order.

    Character references are decoded, white space becomes one space. Comments, scripts, styles
    and the like have no blocks. Missing and stray end tags are borne as browsers do: a block
    ends an open paragraph, an inline end tag doesn't close a block. known: the only features that
    are wanted. Time and memory grow with the page's length, however deep it nests.
    """
    out: list[tuple[str, tuple[str, ...], float]] = []
    tags: list[str] = []
    merged: list[tuple[str, ...]] = []  # distinct features of an element and its ancestors
    inside: list[int] = []  # the container that an element's text counts for
    open_at: dict[str, list[int]] = defaultdict(list)
    block_at: list[int] = []
    first, last, credit = [0], [-1], [0.0]  # of containers: their blocks, and the characters right in them
    holder: list[int] = []  # of blocks: their container
    run: list[str] = []
    linked: list[str] = []
    endless: set[str] = set()

    def flush() -> None:
        if run:
            text = " ".join(_html.unescape("".join(run)).split())
            if text:
                link = min(1.0, len(" ".join(_html.unescape("".join(linked)).split())) / len(text))
                out.append((text, (*(merged[-1] if merged else ()), f"leaf:{tags[block_at[-1]] if block_at else ''}"), link))
                holder.append(inside[-1] if inside else 0)
                credit[holder[-1]] += len(text) * (1 - link)
            run.clear()
            linked.clear()

    def cut(to: int) -> None:
        for k in range(len(tags) - 1, to - 1, -1):
            open_at[tags[k]].pop()
            if tags[k] in HOLDS:
                last[inside[k]] = len(out)
        while block_at and block_at[-1] >= to:
            block_at.pop()
        del tags[to:], merged[to:], inside[to:]

    def top(names: Iterable[str]) -> int:
        return max((open_at[t][-1] for t in names if open_at[t]), default=-1)

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt != at:
            piece = page[at : lt if lt >= 0 else size]
            run.append(piece)
            if open_at["a"]:
                linked.append(piece)
            if lt < 0:
                break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        closing = page.startswith("/", lt + 1)
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                run.append("<")
                at = lt + 1
            continue
        tag = m[0].lower()
        step = _STEP.search(page, m.end())
        while step and step[0] != ">":  # to the end of the tag, past quoted values
            step = _STEP.search(page, step.end())
        gt = step.start() if step else size
        attrs, at = page[m.end() : gt], min(gt + 1, size)
        if closing:
            if tag in BLOCK:
                flush()
            k = top([tag])
            if k >= 0 and (tag in BLOCK or not block_at or k > block_at[-1]):
                cut(k)
            continue
        if tag in RAW or tag in HIDDEN and tag not in endless:
            if attrs.endswith("/"):
                continue
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            gt = page.find(">", end.end() - 1) if end else -1
            if gt >= 0 or tag in RAW:
                at = gt + 1 if gt >= 0 else size
                continue
            endless.add(tag)  # as any element without an end
        if tag in BLOCK:
            flush()
            if open_at["p"]:
                cut(open_at["p"][0])
            if tag in ENDS:
                group, limits = ENDS[tag]
                k = top(group)
                if k > top(limits):
                    cut(k)
        if tag == "br":
            run.append(" ")
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        words = [w for a in _ATTR.finditer(attrs) for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower())] if "=" in attrs else []
        above = merged[-1] if merged else ()
        own = dict.fromkeys(f for f in (f"in:{tag}", *[f"is:{w}" for w in words if 1 < len(w) < 24]) if f not in above and (known is None or f in known))
        open_at[tag].append(len(tags))
        if tag in BLOCK:
            block_at.append(len(tags))
        if tag in HOLDS:
            inside.append(len(credit))
            first.append(len(out))
            last.append(-1)
            credit.append(0.0)
        else:
            inside.append(inside[-1] if inside else 0)
        tags.append(tag)
        merged.append((*above, *own) if own else above)
    flush()
    cut(0)
    last[0] = len(out)
    home = max(range(len(credit)), key=credit.__getitem__)
    headed = {h for h, b in zip(holder, out, strict=True) if b[1][-1] == "leaf:h1" and not HEAD.intersection(b[1])}
    side = lambda k: "before" if k < first[home] else "after" if k >= last[home] else "in"
    return [(*b, f"{side(k)} {'headless' if not headed else 'headed' if holder[k] in headed else 'apart'}") for k, b in enumerate(out)]


def features(text: str, inherited: tuple[str, ...], link: float, place: str) -> list[str]:
    words = text.count(" ") + 1
    return [
        *inherited, "bias",
        f"words:{min(5, words.bit_length())}",
        f"link:{round(4 * link)}",
        f"home:{place}", *(f"home:{p}" for p in place.split()),
        "stop" if text[-1] in ".!?…:;\"'»”" else "nostop",
        *(["copyright"] if "©" in text else []), *(["head", f"head:{inherited[-1]}"] if HEAD.intersection(inherited) else []),
    ]


#: Fixed: what labelled pages are made of. (element, class or id words) of the parts that aren't article.
NOISE = {
    "menu": ("nav", "ul.menu", "div.navbar", "div#navigation", "div.breadcrumb", "ul.nav", "div.topnav", "div[role=navigation]"),
    "header": ("header", "div.header", "div#masthead", "div.topbar", "div.site-header", "div[role=banner]"),
    "footer": ("footer", "div.footer", "div#colophon", "div.site-footer", "div[role=contentinfo]"),
    "side": ("aside", "div.sidebar", "div#sidebar", "div.widget", "div.related", "section.recommended", "div[role=complementary]"),
    "notice": ("div.cookie", "div#cookie-banner", "div.notice", "div.consent", "div.gdpr", "div.alert", "dialog", "div.popup", "div.modal"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div#banner-ad", "aside.ad", "ins.adsbygoogle"),
    "form": ("form", "form.newsletter", "form#search", "div.subscribe", "form.login"),
    "comment": ("div.comments", "section#comments", "ul.comment-list", "ol.commentlist", "div.comment", "section.comments", "div.replies", "div#disqus", "section#respond", "div.reply", "div.responses", "div.discussion", "section.?", "div.?", "section#?", "div", "section#?", "div.?"),
    "share": ("div.share", "ul.social", "div.tags", "div.byline-links"),
}
HOMES = ("article", "main article", "main", "div.content", "div#content article", "div.post", "div.entry-content", "div.article-body", "section.story", "div[role=main]", "div#main div.text", "body-div", "table-cell", "div.?", "section#?")


def labelled_pages(count: int = 2500, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Pages with the label of each leaf block in order: part of the article or not."""
    rnd = random.Random(seed)
    syllables = ["ba", "co", "de", "fi", "lu", "mar", "no", "per", "qui", "ro", "sta", "ten", "vo", "é", "ß", "ción", "the", "ing"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + rnd.choice([".", ".", ".", "!", "?", "", "***", "."])

    def opened(spec: str) -> tuple[str, str]:
        m = re.fullmatch(r"(\w+)(?:\.([\w-]+)|#([\w-]+)|\[role=(\w+)\])?", spec.replace("?", word()))
        attr = f' class="{m[2]}"' if m[2] else f' id="{m[3]}"' if m[3] else f' role="{m[4]}"' if m[4] else ""
        return f"<{m[1]}{attr}>", f"</{m[1]}>"

    def noise(kind: str, labels: list[bool]) -> str:
        head, tail = opened(rnd.choice(NOISE[kind]))
        body = []
        if (kind in ("menu", "share") and rnd.random() < 0.8) or rnd.random() < 0.2:
            n = rnd.randint(1, 7)
            items = [f'<a href="/{word()}">{words(1, 3)}</a>' if rnd.random() < 0.9 else words(1, 3) for _ in range(n)]
            body.append(f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>")
            labels += [False] * n
        elif kind == "footer":
            body.append(f"&copy; {word()}.example {rnd.choice(['&middot;', '-', ''])} {sentence(1, 12)}")
            labels.append(False)
        elif kind == "header" and rnd.random() < 0.6:  # the site's name, and often a line about it
            body.append(f"<{(h := rnd.choice(['h1', 'h1', 'h2', 'div', 'p']))}>{words(1, 6)}</{h}>")
            labels.append(False)
            if rnd.random() < 0.4:
                body.append(f"<p>{sentence(1, 9)}</p>")
                labels.append(False)
        elif kind == "comment" and rnd.random() < 0.6:  # who, and what they say
            if rnd.random() < 0.6:
                body.append(f"<{(h := rnd.choice(['h2', 'h3', 'h4', 'p']))}>{words(1, 4)}</{h}>")
                labels.append(False)
            for _ in range(rnd.randint(1, 6)):
                each = rnd.choice(["div.?", "div", "li", "article", "div.?"])
                top, end = opened(each)
                n = rnd.randint(1, 2)
                said = "".join(f"<p>{sentence(1, rnd.choice([6, 20, 40]))}</p>" for _ in range(n))
                who = rnd.choice([f"<div>{words(1, 3)}</div>", f"<b>{words(1, 2)}</b>", f'<a href="/{word()}">{words(1, 2)}</a>', ""])
                body.append(top + who + said + end)
                labels += [False] * (n + bool(who))
        else:
            n = rnd.randint(1, 4 if kind == "comment" else 3)
            for _ in range(n):
                e = rnd.choice(["p", "div", "p", "h3", "li", "label", ""]) if n > 1 else rnd.choice(["", "p"])
                if e == "label" and kind != "form":
                    e = "p"
                if e in ("", "label"):
                    e = "div"
                body.append(f"<{e}>{sentence(1, rnd.choice([4, 15, 60]))}</{e}>")
                labels.append(False)
        return head + "".join(body) + tail

    def article(labels: list[bool]) -> str:
        body = []
        if rnd.random() < 0.75:
            body.append(f"<h1>{words(1, 12)}</h1>")
            labels.append(True)
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 14])):
            kind = rnd.random()
            if kind < 0.7:
                text = sentence(1, rnd.choice([1, 3, 20, 60]))
                if rnd.random() < 0.3:
                    text = f"<b>{text}<br>" if rnd.random() < 0.5 else f'{text} <a href="/{word()}">{word()}</a> {sentence(1, 9)}'
                body.append(f"<p>{text}" + ("</p>" if rnd.random() < 0.9 and "<br>" not in text else "<p></p>"))
                labels.append(True)
            elif kind < 0.77:
                body.append(f"<{(h := rnd.choice(['h2', 'h3']))}>{words(1, 7)}</{h}>")
                labels.append(True)
            elif kind < 0.83:
                n = rnd.randint(1, 4)
                body.append("<ul>" + "".join(f"<li>{sentence(1, 12)}</li>" for _ in range(n)) + "</ul>")
                labels += [True] * n
            elif kind < 0.88:
                body.append(f"<{(q := rnd.choice(['blockquote', 'pre', 'figcaption']))}>{sentence(2, 20)}</{q}>")
                labels.append(True)
            else:
                body.append(noise(rnd.choice(["advert", "share", "side", "form", "notice", "menu", "comment"]), labels))
        return "".join(body)

    pages = []
    for _ in range(count):
        labels: list[bool] = []
        parts = []
        for kind in ("menu", "header", "notice", "advert", "side"):
            if rnd.random() < {"menu": 0.75, "header": 0.6}.get(kind, 0.35):
                parts.append(kind)
        rnd.shuffle(parts)
        body = "".join(noise(k, labels) for k in parts)
        home = rnd.choice([HOMES[0], HOMES[0], *HOMES])
        if rnd.random() < 0.96:
            if home == "table-cell":
                body += f"<table><tr><td>{article(labels)}</td></tr></table>"
            elif home == "body-div":
                body += f"<div>{article(labels)}</div>"
            else:
                heads, tails = zip(*(opened(s) for s in home.split()), strict=True)
                body += "".join(heads) + article(labels) + "".join(reversed(tails))
        for kind, share in (("share", 0.2), ("comment", 0.4), ("side", 0.3), ("advert", 0.25), ("form", 0.25), ("notice", 0.15), ("footer", 0.8)):
            if rnd.random() < share:
                body += noise(kind, labels)
        pages.append((f"<html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>", labels))
    return pages


class Chain:
    """Weights of a linear-chain conditional random field with the labels other and main."""

    def __init__(self, pages: list[tuple[str, list[bool]]], steps: int = 300, ridge: float = 2e-5, least: int = 8) -> None:
        """least: blocks that a feature has to occur in."""
        seqs = []
        for page, labels in pages:
            blocks = leaf_blocks(page)
            if len(blocks) != len(labels):
                raise ValueError("labels don't fit the blocks of a labelled page")
            if blocks:
                seqs.append(([features(*b) for b in blocks], labels))
        often = Counter(f for fs, _ in seqs for b in fs for f in b)
        names = sorted(f for f, n in often.items() if n >= least)
        at = {f: i for i, f in enumerate(names)}
        seqs.sort(key=lambda s: -len(s[1]))  # the pages that have a block j are the first live[j]
        size = np.array([len(s[1]) for s in seqs])
        live = [int((size > j).sum()) for j in range(size[0])]
        y, real = np.zeros((len(seqs), size[0]), int), np.arange(size[0]) < size[:, None]
        which: list[list[int]] = []
        for i, (fs, labels) in enumerate(seqs):
            which += [[at[f] for f in b if f in at] for b in fs]
            y[i, : len(labels)] = labels
        flat = np.concatenate(which)  # every block has the feature `bias`
        of = np.repeat(np.arange(len(which)), [len(x) for x in which])
        w, t = np.zeros(len(names)), np.zeros((2, 2))
        mean, var = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
        seen = np.array([[(real[:, 1:] & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        n = len(which)
        for k in range(1, steps + 1):
            s = np.zeros((size[0], 2, len(seqs)))
            one = np.zeros(real.shape)
            one[real] = np.bincount(of, w[flat], n)
            s[:, 1] = one.T
            f, b = s.copy(), np.zeros_like(s)
            for j in range(1, size[0]):
                m = live[j]
                for c in (0, 1):
                    f[j, c, :m] += np.logaddexp(f[j - 1, 0, :m] + t[0, c], f[j - 1, 1, :m] + t[1, c])
            for j in range(size[0] - 2, -1, -1):
                m = live[j + 1]
                for c in (0, 1):
                    b[j, c, :m] = np.logaddexp(s[j + 1, 0, :m] + b[j + 1, 0, :m] + t[c, 0], s[j + 1, 1, :m] + b[j + 1, 1, :m] + t[c, 1])
            z = np.logaddexp(b[0, 0] + s[0, 0], b[0, 1] + s[0, 1])
            p = np.exp(f[:, 1] + b[:, 1] - z).T
            step = real[:, 1:].T
            pair = np.array([[np.exp(f[:-1, c] + t[c, d] + s[1:, d] + b[1:, d] - z)[step].sum() for d in (0, 1)] for c in (0, 1)])
            grads = [np.bincount(flat, (p - y)[real][of], len(w)) / n + ridge * w, (pair - seen) / n + ridge * t]
            for i, (g, v) in enumerate(zip(grads, (w, t), strict=True)):
                mean[i], var[i] = 0.9 * mean[i] + 0.1 * g, 0.99 * var[i] + 0.01 * g * g
                v -= 0.15 * (mean[i] / (1 - 0.9**k)) / (np.sqrt(var[i] / (1 - 0.99**k)) + 1e-9)
        self.weight = {f: float(w[i]) for f, i in at.items()}
        self.move = t.tolist()

    def viterbi(self, scores: list[float]) -> list[bool]:
        """The most probable labels of blocks with these scores for main against other."""
        (oo, om), (mo, mm) = self.move
        back, o, m = [], 0.0, scores[0]
        for s in scores[1:]:
            from_o, from_m = o + oo >= m + mo, o + om >= m + mm
            back.append((0 if from_o else 1, 0 if from_m else 1))
            o, m = max(o + oo, m + mo), s + max(o + om, m + mm)
        label = int(m > o)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]

    def extract(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "", self.weight)
        if not blocks:
            return ""
        get = self.weight.get
        labels = self.viterbi([sum(get(f, 0.0) for f in features(*b)) for b in blocks])
        return "\n".join(b[0] for b, keep in zip(blocks, labels, strict=True) if keep)


@lru_cache(1)
def default_chain() -> Chain:
    return Chain(labelled_pages())


def extract_main_text(pages: DataFrame, chain: Chain | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, then text and n_chars (its code points).

    A null or empty html, and a page without an article, give an empty text. The whole page is
    read, whatever its length; rows are independent, so repeated rows repeat; an empty table
    gives an empty one; other columns aren't read. No shuffle.
    """
    ship(pages.sparkSession)
    chain = chain or default_chain()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of_rows(whole):
                texts = [chain.extract(h) for h in batch.column(len(keep)).to_pylist()]
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, "text", "n_chars"])

    read = pages.select(*keep, pages[html].alias("_html"))
    kinds = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keep)
    return read.mapInArrow(run, f"{kinds}, text string, n_chars long")
