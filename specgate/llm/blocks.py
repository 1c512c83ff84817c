"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its text blocks. Each block is a vector: its hashed tag path (all open tags with their
class and id words, outer ones with falling weight), its hashed words, and a few measures of it. Every part is bounded, so a
block of any length looks like one of usual length. A bidirectional LSTM in numpy reads the whole sequence and labels every
block, so a block's label rests on its own vector and on all the page. The text of the blocks labelled as article, in page
order, is the result.

The model is fitted on the driver on at most `SAMPLE_PAGES` pages, those with the least hash of page_id, by labels that
the pages' own tags give without doubt (navigation, footers, asides, forms, named adverts, notices and comments against
articles). To learn more layouts than a crawl's few hosts have, each sample page is also read in variants in which its
own blocks stand under other usual containers, deeper, joined to long ones, or alone. Every page is labelled, whole.

Defined cases: null and empty html, and pages without an article, give empty text and n_chars 0; markup that never closes
runs to the end of its parent; elements with the attribute hidden or the style display:none are left out; white space inside a block, line breaks by <br> too, becomes one space; repeated rows are
labelled alike; an empty table gives an empty result (and needs no model). Only `page_id`, `url`, `html` are read.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgate.llm.common import by_bytes, on_workers
from specgate.llm.shingles import words_of

SAMPLE_PAGES = 300
#: Blocks of one sample page that the model is fitted on: of a longer page a stretch of so many, at a place drawn by its
#: page_id. Bounds the driver's sample; the blocks themselves are read whole.
SAMPLE_BLOCKS = 120
VARIANTS = 5
PATH, WORDS, MEASURES, HIDDEN = 96, 24, 5, 20
#: Weight of a tag against the one inside it. Plain div levels say nothing and leave the path as it is.
FALL = 0.8
PLAIN = "div"
EPOCHS, RATE, BATCH = 14, 0.01, 32
BATCH_BYTES = 2 << 20

#: Fixed values of HTML: elements whose text is not shown, elements without end, and elements that begin a new block.
HIDDEN_TAGS = "script style noscript template title textarea select svg math iframe object canvas audio video"
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr"
INLINE_TAGS = "a abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr"
HEAD_TAGS = frozenset("head title meta link base style script noscript template".split())
_HIDDEN, _VOID, _INLINE = (frozenset(x.split()) for x in (HIDDEN_TAGS, VOID_TAGS, INLINE_TAGS))

SENTENCE_ENDS = ".!?…"
#: Names of elements, and words of class and id, that leave no doubt.
OUTSIDE_TAGS = frozenset("nav footer aside form header button menu dialog".split())
INSIDE_TAGS = frozenset("article main".split())
OUTSIDE_WORDS = ("ad ads advert advertisement banner sponsor sponsored promo cookie consent notice popup modal newsletter subscribe "
                 "comment comments respond reply replies discussion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
                 "header masthead related share social widget pagination").split()
INSIDE_WORDS = "article content story post entry body text main".split()
_OUTSIDE_WORDS, _INSIDE_WORDS = frozenset(OUTSIDE_WORDS), frozenset(INSIDE_WORDS)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_NOT_SHOWN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)""", re.I)
_NO_DISPLAY = re.compile(r"""\bstyle\s*=\s*(?:"[^"]*?\bdisplay\s*:\s*none|'[^']*?\bdisplay\s*:\s*none|display:none)""", re.I)


class Block:
    """A text block; `path` are its open tags where they are asked for, `vector` the hashed path."""

    __slots__ = ("path", "vector", "text", "linked")

    def __init__(self, path: tuple[str, ...], vector: np.ndarray, text: str, linked: int) -> None:
        self.path, self.vector, self.text, self.linked = path, vector, text, linked


class Measured:
    """A sample block without its text: path, counts of hashed words, words, characters, linked ones, whether it ends a sentence."""

    __slots__ = ("path", "counts", "n", "length", "linked", "ends")

    def __init__(self, path: tuple[str, ...], counts: np.ndarray, n: int, length: int, linked: int, ends: bool) -> None:
        self.path, self.counts, self.n, self.length, self.linked, self.ends = path, counts, n, length, linked, ends

    def at(self, path: tuple[str, ...], linked: int) -> Measured:
        return Measured(path, self.counts, self.n, self.length, linked, self.ends)


def joined(blocks: list[Measured], times: int) -> Measured:
    """One long block of these blocks, so many times over."""
    return Measured(blocks[0].path, times * sum(b.counts for b in blocks), times * sum(b.n for b in blocks),
                    times * sum(b.length + 1 for b in blocks) - 1, times * sum(b.linked for b in blocks), blocks[-1].ends)


@functools.lru_cache(maxsize=4096)
def _name(tag: str, attributes: str) -> str:
    """The tag with its class, id and role words."""
    words = [w for m in _NAMES.finditer(attributes) for w in _WORD.findall("".join(filter(None, m.groups())).lower())]
    return " ".join([tag, *words])


@functools.lru_cache(maxsize=1 << 14)
def _name_vector(name: str) -> np.ndarray:
    out = np.zeros(PATH, "f4")
    for word in name.split(" "):
        for h in (zlib.crc32(word.encode()), zlib.crc32(b"2" + word.encode())):
            out[h % PATH] += 1 if h >> 31 else -1
    return out


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH, "f4")
    for name in path:
        out = _inside(out, name)
    return out


def _inside(outer: np.ndarray, name: str) -> np.ndarray:
    return outer if name == PLAIN else FALL * outer + _name_vector(name)


def not_shown(attributes: str) -> bool:
    """Whether an element's attributes hide it."""
    return "hidden" in attributes.lower() and bool(_NOT_SHOWN.search(_QUOTED.sub('""', attributes))) or bool(_NO_DISPLAY.search(attributes))


def blocks_of(page: str | None, paths: bool = False) -> list[Block]:
    """The shown text blocks of a page in order, character references decoded and white space made single."""
    out: list[Block] = []
    nothing = np.zeros(PATH, "f4")
    stack: list[tuple[str, str, np.ndarray, bool]] = []  # tag, tag with names, vector of the path, hidden
    opened: Counter[str] = Counter()  # open tags; under "" the hidden ones
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(e[1] for e in stack if e[0] not in _INLINE) if paths else (), stack[-1][2] if stack else nothing, text, linked))
            parts.clear()
        linked = 0

    def push(tag: str, name: str | None, attributes: str) -> None:
        vector = stack[-1][2] if stack else nothing
        hidden = not_shown(attributes)
        stack.append((tag, name or tag, vector if name is None else _inside(vector, name), hidden))
        opened[tag] += 1
        opened[""] += hidden

    def pop() -> str:
        tag, _, _, hidden = stack.pop()
        opened[tag] -= 1
        opened[""] -= hidden
        return tag

    page, at = page or "", 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        ending, tag, attributes, text = m.groups()
        if stack and (tag and not ending and tag.lower() not in HEAD_TAGS or text and not text.isspace()) and opened["head"]:
            close()
            while opened["head"]:  # left open by the author
                pop()
        if text is not None:
            if not opened[""]:
                parts.append(text)
                if opened["a"]:
                    linked += len(text)
        elif tag is None:
            if m[0].startswith("<![CDATA[") and not opened[""]:
                parts.append(html_lib.escape(m[0][9:-3]))
        elif ending:
            tag = tag.lower()
            if tag not in _INLINE:
                close()
            if opened[tag]:
                while pop() != tag:
                    pass
            if tag in ("p", "br"):
                parts.append(" ")
        else:
            tag = tag.lower()
            if tag in _HIDDEN:
                if tag not in _INLINE:
                    close()
                if not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                continue
            if tag in _INLINE:
                if tag in ("br", "img", "wbr"):
                    parts.append(" " if tag == "br" else "")
                elif not attributes.endswith("/"):
                    push(tag, None, attributes)
                continue
            close()
            if tag in _VOID or attributes.endswith("/"):
                continue
            for owner, until in (("p", None), ("li", "ul ol menu"), ("td", "table tr"), ("tr", "table")):  # left open by the author
                if opened[owner] and (owner == "p" or owner == tag):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == owner:
                            while len(stack) > k:
                                pop()
                            break
                        if stack[k][0] not in _INLINE and (until is None or stack[k][0] in until.split()):
                            break
            push(tag, _name(tag, attributes), attributes)
    close()
    return out


def sure_label(path: tuple[str, ...], by_words: bool = False) -> int:
    """1: article, 0: not, -1: the tags do not say. With `by_words`, the class and id of a container say it too."""
    inside = False
    for name in path:
        tag, *words = name.split(" ")
        if tag in OUTSIDE_TAGS and not (tag == "header" and inside) or _OUTSIDE_WORDS.intersection(words):
            return 0
        inside = inside or tag in INSIDE_TAGS or by_words and tag != "body" and bool(_INSIDE_WORDS.intersection(words))
    return 1 if inside else -1


def labels_of(pages: list[list[Measured]]) -> list[list[int]]:
    """Labels of the blocks of all sample pages: by tags; if no page has an article by those, by words of class and id too;
    if none has one then, unlinked sentences outside all other containers count as article."""
    for by_words in (False, True):
        labels = [[sure_label(b.path, by_words) for b in blocks] for blocks in pages]
        if any(1 in page for page in labels):
            return labels
    return [[1 if y < 0 and not b.linked and b.ends else y for b, y in zip(blocks, page, strict=True)]
            for blocks, page in zip(pages, labels, strict=True)]


def counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed words and of words of each text."""
    words, _, _, first = words_of(pa.array(texts, pa.string()))
    n = np.diff(first)
    bag = np.bincount(np.repeat(np.arange(len(texts)), n) * WORDS + (words % np.uint64(WORDS)).astype("i8"), minlength=len(texts) * WORDS)
    return bag.reshape(-1, WORDS), n


def _vectors(paths: list[np.ndarray], bag: np.ndarray, n, length, linked, ends, sizes: list[int]) -> np.ndarray:
    """One vector for each block of pages of so many blocks."""
    length, n = np.asarray(length, "f8"), np.asarray(n, "f8")
    place = np.concatenate([np.arange(k) / max(1, k - 1) for k in sizes])
    shape = bag / np.maximum(np.sqrt((bag.astype("f8") ** 2).sum(axis=1)), 1)[:, None]
    measures = np.column_stack([np.tanh(length / 200), np.tanh(n / 15), np.asarray(linked) / np.maximum(length, 1), place, ends])
    return np.concatenate([np.stack(paths), shape, measures], axis=1).astype("f4")


def vectors_of(pages: list[list[Block]]) -> np.ndarray:
    """One vector for each block of all pages, in order."""
    every = [b for blocks in pages for b in blocks]
    if not every:
        return np.zeros((0, PATH + WORDS + MEASURES), "f4")
    bag, n = counts_of([b.text for b in every])
    return _vectors([b.vector for b in every], bag, n, [len(b.text) for b in every], [b.linked for b in every],
                    [b.text[-1] in SENTENCE_ENDS for b in every], [len(p) for p in pages])


def measured(blocks: list[Block]) -> list[Measured]:
    bag, n = counts_of([b.text for b in blocks])
    return [Measured(b.path, c, k, len(b.text), b.linked, b.text[-1] in SENTENCE_ENDS) for b, c, k in zip(blocks, bag, n.tolist(), strict=True)]


def vectors_of_sample(blocks: list[Measured]) -> np.ndarray:
    return _vectors([path_vector(b.path) for b in blocks], np.stack([b.counts for b in blocks]), [b.n for b in blocks],
                    [b.length for b in blocks], [b.linked for b in blocks], [b.ends for b in blocks], [len(blocks)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, page, HIDDEN) of one direction; a page's state stands still after its end."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), "f4"), np.zeros((n, HIDDEN), "f4")
    given = x @ w + b
    out, trace = np.empty((steps, n, HIDDEN), "f4"), []
    for t in range(steps):
        z = given[t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        c_new = f * c + i * g
        tanh_c = np.tanh(c_new)
        m = mask[t][:, None]
        if keep:
            trace.append((h, c, i, f, o, g, tanh_c, m))
        c = np.where(m, c_new, c)
        h = np.where(m, o * tanh_c, h)
        out[t] = h
    return out, trace


def _back(d_out: np.ndarray, x: np.ndarray, u: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), "f4")
    du = np.zeros_like(u)
    dh, dc = np.zeros_like(trace[0][0]), np.zeros_like(trace[0][0])
    for t in range(len(trace) - 1, -1, -1):
        h, c, i, f, o, g, tanh_c, m = trace[t]
        dh = dh + d_out[t]
        dh_m = np.where(m, dh, 0)
        dc_t = np.where(m, dc + dh_m * o * (1 - tanh_c**2), 0)
        dz = np.concatenate([dc_t * g * i * (1 - i), dc_t * c * f * (1 - f), dh_m * tanh_c * o * (1 - o), dc_t * i * (1 - g**2)], axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh = np.where(m, dz @ u.T, dh)
        dc = np.where(m, dc_t * f, dc)
    flat = dz_all.reshape(-1, dz_all.shape[2])
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def _reverse(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Indices (time, page) that read each page from its end to its beginning."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def forward(x: np.ndarray, lengths: np.ndarray, p: dict[str, np.ndarray], keep: bool = False):
    """Article logits (time, page) of padded pages x (time, page, features)."""
    steps, n, _ = x.shape
    mask = np.arange(steps)[:, None] < lengths
    back, pages = _reverse(lengths, steps), np.arange(n)
    ahead, trace_a = _run(x, mask, p["wa"], p["ua"], p["ba"], keep)
    turned = x[back, pages]
    behind, trace_b = _run(turned, mask, p["wb"], p["ub"], p["bb"], keep)
    both = np.concatenate([ahead, behind[back, pages]], axis=2)
    logits = both @ p["v"] + x @ p["s"] + p["c"][0]
    return logits, (both, turned, back, trace_a, trace_b)


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    x = np.zeros((lengths.max(), len(sequences), sequences[0].shape[1]), "f4")
    for k, s in enumerate(sequences):
        x[: len(s), k] = s
    return x, lengths


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy of all blocks with a sure label."""
    random, size = np.random.default_rng(5), PATH + WORDS + MEASURES
    p = {}
    for k in "ab":
        p[f"w{k}"] = random.standard_normal((size, 4 * HIDDEN)).astype("f4") * 0.1
        p[f"u{k}"] = random.standard_normal((HIDDEN, 4 * HIDDEN)).astype("f4") * 0.1
        p[f"b{k}"] = np.zeros(4 * HIDDEN, "f4")
    p |= {"v": random.standard_normal(2 * HIDDEN).astype("f4") * 0.1, "s": np.zeros(size, "f4"), "c": np.zeros(1, "f4")}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = random.permutation(len(sequences))
        order = order[np.argsort([len(sequences[k]) for k in order], kind="stable")]  # pages of like length together
        for at in random.permutation(range(0, len(order), BATCH)):
            chosen = order[at : at + BATCH]
            x, lengths = padded([sequences[k] for k in chosen])
            y = np.full(x.shape[:2], -1)
            for k, j in enumerate(chosen):
                y[: len(labels[j]), k] = labels[j]
            logits, (both, turned, back, trace_a, trace_b) = forward(x, lengths, p, keep=True)
            d = np.where(y >= 0, _sigmoid(logits) - y, 0).astype("f4") / max(1, (y >= 0).sum())
            g = {"v": np.tensordot(d, both, ([0, 1], [0, 1])), "s": np.tensordot(d, x, ([0, 1], [0, 1])) + 1e-3 * p["s"], "c": np.array([d.sum()], "f4")}
            d_both = d[:, :, None] * p["v"]
            g["wa"], g["ua"], g["ba"] = _back(d_both[:, :, :HIDDEN], x, p["ua"], trace_a)
            g["wb"], g["ub"], g["bb"] = _back(d_both[back, np.arange(x.shape[1]), HIDDEN:], turned, p["ub"], trace_b)
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype("f4")
    return p


def variants(blocks: list[Measured], labels: list[int], n: int, seed: int) -> list[tuple[list[Measured], list[int]]]:
    """The page, and `n` more in which its blocks stand under other usual containers."""
    random = np.random.default_rng(seed)
    out = [(blocks, labels)]
    inner = [b for b, y in zip(blocks, labels, strict=True) if y == 1]
    outer = [b for b, y in zip(blocks, labels, strict=True) if y == 0]
    pick = lambda values: values[int(random.integers(len(values)))]

    def place(b: Measured, path: tuple[str, ...], y: int) -> tuple[Measured, int]:
        return b.at(("html", "body", *path), b.length if y == 0 and random.random() < 0.3 else 0), y

    def deeper(most: int) -> tuple[str, ...]:
        """Levels of containers that say little, on some pages."""
        return tuple(pick(("section", "div row", "div col", "div inner", "div box")) for _ in range(int(random.integers(most)) if random.random() < 0.2 else 0))

    for _ in range(n if inner else 0):
        shape = random.random()
        inside = list(inner)
        if shape < 0.3:  # paragraphs joined to long ones, or all in one
            k = int(random.integers(1, len(inside) + 1))
            inside = [joined(inside[i : i + k], int(pick((1, 1, 3, 20, 200, 2_000)))) for i in range(0, len(inside), k)]
        wrap = tuple("div" if random.random() < 0.5 else f"div {pick(('page', 'wrapper', 'container', 'layout', 'site'))}" for _ in range(int(random.integers(3))))
        article = pick((("article",), ("main",), ("main", "article"), ("div content", "article"), *((f"div {w}",) for w in INSIDE_WORDS),
                        ("div post", "div post content"), ("section", "div article body"), ("div main", "div story")))
        tags = lambda: pick(("p", "p", "p", "h", "li", "blockquote", "div", "td"))
        article = (*deeper(4), *article, *deeper(7))
        page = []
        texts = outer + inner
        alone = random.random() < 0.05

        def junk(parent: tuple[str, ...], most: int) -> list[tuple[Measured, int]]:
            if alone:
                return []
            kind = random.random()
            if kind < 0.45:
                holder = (pick(tuple(OUTSIDE_TAGS)),)
            else:
                word = pick(OUTSIDE_WORDS)
                holder = (f"{pick(('div', 'section', 'ul', 'p', 'aside'))} {pick((word, f'{word} {pick(OUTSIDE_WORDS)}', f'{word} box', f'site {word}'))}",)
            leaf = pick(((), ("p",), ("ul", "li"), ("div",), ("div", "p"), ("h",)))
            return [place(pick(texts), (*parent, *holder, *leaf), 0) for _ in range(1 + int(random.integers(most)))]

        for _ in range(int(random.integers(1, 4))):
            page += junk(wrap, 6)
        if len(inside) > 1:
            page.append(place(inside[0], (*wrap, *article, pick(("h", "h", "header h"))), 1))
        for b in inside[len(inside) > 1 :]:
            page.append(place(b, (*wrap, *article, tags()), 1))
            if random.random() < 0.08:
                page += junk((*wrap, *article), 2)
        if random.random() < 0.5:
            page += junk((*wrap, *article), 4)
        for _ in range(int(random.integers(1, 4))):
            page += junk(wrap, 6)
        out.append(([b for b, _ in page], [y for _, y in page]))
    return out


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, np.ndarray] | None:
    """Weights fitted on a bounded sample; None if no page of it has blocks with sure labels."""
    sample = pages.filter("html IS NOT NULL").select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    parsed = sample.mapInArrow(on_workers(_sample_blocks), SAMPLE)
    sequences, labels = [], []
    rows = parsed.orderBy("page_id").collect()  # at most sample_pages rows of SAMPLE_BLOCKS blocks, without their texts
    read = [[Measured(tuple(p), np.array(c), *rest) for p, c, *rest in zip(r["paths"], r["counts"], r["n"], r["length"], r["linked"], r["ends"], strict=True)]
            for r in rows]
    for row, blocks, known in zip(rows, read, labels_of(read), strict=True):
        for own, y in variants(blocks, known, VARIANTS, zlib.crc32(str(row["page_id"]).encode())):
            if own and max(y) >= 0:
                sequences.append(vectors_of_sample(own))
                labels.append(np.array(y))
    return fit(sequences, labels) if sequences else None


SAMPLE = ("page_id long, paths array<array<string>>, counts array<array<long>>, n array<long>, length array<long>, linked array<long>, "
          "ends array<boolean>")


def _sample_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "html", BATCH_BYTES):
        for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found = blocks_of(html, paths=True)
            first = zlib.crc32(f"{page}".encode()) % max(1, len(found) - SAMPLE_BLOCKS + 1)
            found = found[first : first + SAMPLE_BLOCKS]
            rows = measured(found)
            lists = {"paths": [list(b.path) for b in rows], "counts": [b.counts.tolist() for b in rows],
                     **{k: [getattr(b, k) for b in rows] for k in ("n", "length", "linked", "ends")}}
            kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            columns = {k: pa.array([v], pa.list_(kind)) for (k, v), kind in zip(lists.items(), kinds, strict=True)}
            yield pa.RecordBatch.from_pydict({"page_id": pa.array([page], pa.int64()), **columns})


def _texts(batches: Iterator[pa.RecordBatch], p: dict[str, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "html", BATCH_BYTES):
        pages = [blocks_of(h) for h in batch.column("html").to_pylist()]
        every = vectors_of(pages)
        ends = np.cumsum([len(b) for b in pages])
        texts = [""] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k])) if p else []
        at = 0
        while at < len(order):  # pages of like length together; fewer of them, the longer they are
            chosen = order[at : at + max(1, min(64, 20_000 // len(pages[order[min(len(order) - 1, at + 63)]])))]
            at += len(chosen)
            x, lengths = padded([every[ends[k] - len(pages[k]) : ends[k]] for k in chosen])
            logits, _ = forward(x, lengths, p)
            for column, k in enumerate(chosen):
                texts[k] = "\n".join(b.text for b, z in zip(pages[k], logits[:, column], strict=False) if z > 0)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = rows.mapInArrow(on_workers(_texts, learn(rows, sample_pages)), "page_id long, url string, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
