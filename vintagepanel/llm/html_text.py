"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (text between block-level tags). Each block
is described by its tag path with class and id words (hashed), its words (hashed and
averaged) and a few measures (length, share of links, sentence ends). A bidirectional LSTM
in numpy reads the whole sequence and labels every block with the context of the document.

The labeller is trained here, on pages made by rule for the purpose: menus, headers,
notices, adverts, forms, sidebars, comments and footers in many notations around and
inside articles, with sound and with unclosed tags, in invented words.
"""

import hashlib
import html
import inspect
import io
import posixpath
import re
import sys
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from vintagepanel.llm.common import giving_back, shared_dir, small_batches
from vintagepanel.llm.shingles import parts, word_hashes

_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9-]*)")
#: What matters within a tag: its end, and a value in quotes.
_WITHIN = re.compile(r""">|=\s*["']""")
# fixed values: HTML's elements without an end, whose content is no text of the page (raw text, to the end of the page if
# unclosed; or markup, skipped if closed), and that stand inside a line
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "iframe"}
UNSEEN = {"noscript", "template", "svg", "object", "canvas"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that end the reach of CLOSES.
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "body"}

PATH_DIMS, WORD_DIMS, MEASURES = 128, 48, 10
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
_INNER, _HIDDEN = 32, 24
#: Depth of a path from which on deeper ones are alike to the labeller.
_DEPTH = 30

_RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
_UNQUOTED = re.compile(r"""=\s*[^\s"'>]+\Z""")


def _self_closed(tag: str, attributes: str) -> bool:
    """Whether a start tag is its own end: a final slash counts in foreign content only, and not as part of an unquoted value."""
    return tag == "svg" and attributes.endswith("/") and not _UNQUOTED.search(attributes)


class Tag(NamedTuple):
    """A tag, comment or raw element of a page: where it begins and ends, its name (empty: a comment or raw element), whether it is an end tag, and its attributes."""

    start: int
    end: int
    name: str
    closing: bool
    attributes: str


def tags(page: str) -> Iterator[Tag]:
    """The tags of a page in order, in time linear in its length.

    Values in quotes may hold '>'. A quote that is never closed, and a tag that ends
    nowhere outside of quotes, end at the next '>'. A '<' that begins no tag is text.
    """
    at, size = 0, len(page)
    loose = False  # a search for a tag's end has run to the end of the page: quotes count no more
    unclosed: set[str] = set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            yield Tag(start, at, "", False, "")
            continue
        m = _NAME.match(page, start + 1)
        if not m:
            at = start + 1
            if page[at : at + 1] in ("!", "?", "/") and (end := page.find(">", at)) >= 0:
                at = end + 1
                yield Tag(start, at, "", False, "")
            elif page[at : at + 1] in ("!", "?", "/"):
                return
            continue
        end, k = -1, m.end()
        while not loose and (found := _WITHIN.search(page, k)):
            mark = found[0][-1]
            if mark == ">":
                end = found.start()
                break
            close = -1 if mark in unclosed else page.find(mark, found.end())
            if close < 0:
                unclosed.add(mark)
                k = found.end()
            else:
                k = close + 1
        if end < 0:
            loose = True
            end = page.find(">", m.end())
            if end < 0:
                return
        at = end + 1
        name, attributes = m[2].lower(), page[m.end() : end]
        if name in RAW and not m[1]:
            close = _RAW_END[name].search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else size
            yield Tag(start, at, "", False, "")
        else:
            yield Tag(start, at, name, bool(m[1]), attributes)


def _unseen_ends(found: list[Tag]) -> dict[int, int]:
    """For the start tags of UNSEEN elements that have an end tag: where they begin, and where their end tag ends."""
    opened: dict[str, list[int]] = {tag: [] for tag in UNSEEN}
    ends = {}
    for t in found:
        if t.name in UNSEEN:
            if not t.closing:
                if not _self_closed(t.name, t.attributes):
                    opened[t.name].append(t.start)
            elif opened[t.name]:
                ends[opened[t.name].pop()] = t.end
    return ends


class Step:
    """An open element on the way to a block: tag, class and id words, and the step before it. A path is its last step, so blocks share what they have in common."""

    __slots__ = ("above", "depth", "marks", "names", "tag")

    def __init__(self, tag: str, names: tuple[str, ...], above: "Step | None"):
        self.tag, self.names, self.above = tag, names, above
        self.depth: int = above.depth + 1 if above else 1
        self.marks: np.ndarray | None = None

    def vector(self) -> np.ndarray:
        """Which of PATH_DIMS buckets the path's tags and names fall into."""
        todo = []
        step: Step | None = self
        while step is not None and step.marks is None:
            todo.append(step)
            step = step.above
        for s in reversed(todo):
            s.marks = np.zeros(PATH_DIMS, bool) if s.above is None else s.above.marks.copy()
            s.marks[[_bucket(s.tag, PATH_DIMS), *(_bucket("." + n, PATH_DIMS) for n in s.names)]] = True
        return self.marks


class Block(NamedTuple):
    text: str
    path: Step | None
    linked: int


class _Open:
    """The open elements of a page; every step is done in constant time, but for what is closed."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Step | None]] = []  # tag, and the path down to it
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def path(self) -> Step | None:
        return self.stack[-1][1] if self.stack else None

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        above = self.path()
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, above if tag in INLINE else Step(tag, names, above)))

    def cut(self, to: int) -> None:
        while len(self.stack) > to:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def close(self, tag: str) -> None:
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def make_room(self, tag: str) -> None:
        """Close what a start tag ends without an end tag."""
        last = max((self.places[c][-1] for c in CLOSES.get(tag, ()) if self.places.get(c)), default=-1)
        if last >= 0 and last > (self.scopes[-1] if self.scopes else -1):
            self.cut(last)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, without empty ones: character references decoded, white space made single. Linear in the page's length."""
    out: list[Block] = []
    opened = _Open()
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, opened.path(), linked))
            pieces.clear()
        linked = 0

    found = list(tags(page))
    ends = _unseen_ends(found)
    at = 0
    for t in [*found, None]:
        start = t.start if t else len(page)
        if start < at:  # within what is not seen
            continue
        if start > at:
            pieces.append(page[at:start])
            linked += (start - at) * bool(opened.places.get("a"))
        if not t:
            break
        at, tag = t.end, t.name
        if not tag:
            continue
        if t.closing:
            if tag not in INLINE:
                flush()
            opened.close(tag)
        elif tag in UNSEEN:
            at = ends.get(t.start, at)
        elif tag == "br":
            pieces.append(" ")
        else:
            if tag not in INLINE:
                flush()
                opened.make_room(tag)
            if tag not in VOID:
                named = tuple(w for x in _NAMED.findall(t.attributes) for w in _WORD.findall("".join(x).lower())) if t.attributes else ()
                opened.push(tag, named)
    flush()
    return out


def _bucket(word: str, dims: int) -> int:
    return zlib.crc32(word.encode()) % dims


@lru_cache(maxsize=4096)
def _leaf_bucket(tag: str) -> int:
    return _bucket("leaf " + tag, PATH_DIMS)


def describe(pages: list[list[Block]], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row of DIMS numbers for every block of the pages. first, total: where the one page given stands in a longer one."""
    flat = [b for p in pages for b in p]
    out = np.zeros((len(flat), DIMS), np.float32)
    if not flat:
        return out
    for i, b in enumerate(flat):
        if b.path is not None:
            out[i, :PATH_DIMS] = b.path.vector()
            out[i, _leaf_bucket(b.path.tag)] = 1
    hashes, of = word_hashes([b.text for b in flat])
    words = np.maximum(np.bincount(of, minlength=len(flat)), 1)
    cell = of * WORD_DIMS + (hashes % np.uint64(WORD_DIMS)).astype(np.int64)
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(cell, minlength=len(flat) * WORD_DIMS).reshape(-1, WORD_DIMS) / words[:, None]
    size = np.array([len(b.text) for b in flat])
    sizes = [total or len(p) for p in pages]
    place = np.concatenate([(first + np.arange(len(p))) / max(1, n) for p, n in zip(pages, sizes, strict=True)])
    stops = np.array([b.text.count(".") + b.text.count("!") + b.text.count("?") for b in flat])
    marks = np.array([b.text.count("|") + b.text.count("©") + b.text.count("»") for b in flat])
    m = out[:, PATH_DIMS + WORD_DIMS :]
    m[:, 0], m[:, 1] = np.log1p(size) / 6, np.log1p(words) / 5
    m[:, 2] = np.minimum(1, np.array([b.linked for b in flat]) / np.maximum(size, 1))
    m[:, 3], m[:, 4] = stops > 0, np.minimum(stops, 6) / 6
    m[:, 5], m[:, 6] = place, np.concatenate([np.full(len(p), np.log1p(n) / 5) for p, n in zip(pages, sizes, strict=True)])
    m[:, 7] = np.minimum(marks, 3) / 3
    m[:, 8] = np.array([b.text[-1] in ".!?" for b in flat])
    m[:, 9] = np.array([min(b.path.depth, _DEPTH) if b.path else 0 for b in flat]) / 10
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Projection, one LSTM in each direction, and a logistic output over both."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {"in": draw(DIMS, _INNER), "in_b": np.zeros(_INNER, np.float32), "out": draw(2 * _HIDDEN, 1), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"{d}x": draw(_INNER, 4 * _HIDDEN), f"{d}h": draw(_HIDDEN, 4 * _HIDDEN), f"{d}_b": np.concatenate([np.zeros(_HIDDEN), np.ones(_HIDDEN), np.zeros(2 * _HIDDEN)]).astype(np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: bool, state: list[np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        """Hidden states; state: that before the first step, replaced by that after the last."""
        b, t, _ = x.shape
        n = _HIDDEN
        driven = x @ self.w[f"{d}x"] + self.w[f"{d}_b"]
        h, c = state or (np.zeros((b, n), np.float32), np.zeros((b, n), np.float32))
        out, tape = np.empty((b, t, n), np.float32), []
        for k in range(t):
            z = driven[:, k] + h @ self.w[f"{d}h"]
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            before = c
            c = f * before + i * g
            squashed = np.tanh(c)
            if keep:
                tape.append((h, before, i, f, o, g, squashed))
            h = o * squashed
            out[:, k] = h
        if state is not None:
            state[:] = [h, c]
        return out, tape

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits (documents x blocks) of padded sequences."""
        inner = np.tanh(x @ self.w["in"] + self.w["in_b"])
        steps = np.arange(x.shape[1])
        turned = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
        rows = np.arange(len(x))[:, None]
        ahead, tape_f = self._run(inner, "f", keep)
        back, tape_b = self._run(inner[rows, turned], "b", keep)
        both = np.concatenate([ahead, back[rows, turned]], axis=2)
        return (both @ self.w["out"])[..., 0] + self.w["out_b"], (inner, turned, rows, both, tape_f, tape_b)

    def _back(self, grad: np.ndarray, x: np.ndarray, d: str, tape: list, g: dict[str, np.ndarray]) -> np.ndarray:
        n = _HIDDEN
        dh, dc, dz_all = np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0]), np.empty((*grad.shape[:2], 4 * n), np.float32)
        for k in range(grad.shape[1] - 1, -1, -1):
            h, before, i, f, o, new, squashed = tape[k]
            dh = dh + grad[:, k]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
            dz_all[:, k] = dz
            g[f"{d}h"] += h.T @ dz
            dh, dc = dz @ self.w[f"{d}h"].T, dc * f
        g[f"{d}x"] += np.tensordot(x, dz_all, ([0, 1], [0, 1]))
        g[f"{d}_b"] += dz_all.sum((0, 1))
        return dz_all @ self.w[f"{d}x"].T

    def gradients(self, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        logits, (inner, turned, rows, both, tape_f, tape_b) = self.forward(x, lengths, True)
        mask = np.arange(x.shape[1]) < lengths[:, None]
        err = ((_sigmoid(logits) - labels) * mask / mask.sum()).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"] = np.tensordot(both, err[..., None], ([0, 1], [0, 1]))
        g["out_b"] = np.array([err.sum()])
        grad = err[..., None] * self.w["out"][:, 0]
        d_inner = self._back(grad[..., :_HIDDEN], inner, "f", tape_f, g)
        turned_grad = self._back(grad[..., _HIDDEN:][rows, turned], inner[rows, turned], "b", tape_b, g)
        d_inner = d_inner + turned_grad[rows, turned]
        d_inner *= 1 - inner**2
        g["in"] = np.tensordot(x, d_inner, ([0, 1], [0, 1]))
        g["in_b"] = d_inner.sum((0, 1))
        return g

    def _label_long(self, page: list[Block], piece: int) -> np.ndarray:
        """label() of one page a piece at a time, the states carried from piece to piece: the same result in bounded memory."""
        cuts = list(range(0, len(page), piece))
        inner = lambda a: np.tanh(describe([page[a : a + piece]], a, len(page)) @ self.w["in"] + self.w["in_b"])[None]
        fresh = lambda: [np.zeros((1, _HIDDEN), np.float32), np.zeros((1, _HIDDEN), np.float32)]
        back, state = np.empty((len(page), _HIDDEN), np.float32), fresh()
        for a in reversed(cuts):
            back[a : a + piece] = self._run(inner(a)[:, ::-1], "b", False, state)[0][0, ::-1]
        out, state = np.empty(len(page), bool), fresh()
        for a in cuts:
            ahead = self._run(inner(a), "f", False, state)[0][0]
            out[a : a + piece] = (np.concatenate([ahead, back[a : a + piece]], 1) @ self.w["out"])[:, 0] + self.w["out_b"] > 0
        return out

    def label(self, pages: list[list[Block]], cells: int = 60_000) -> list[np.ndarray]:
        """For each page, which of its blocks are main text. Pages of like length are run together, about `cells` blocks at a time; longer ones in pieces."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        for i, p in enumerate(pages):
            if len(p) > cells:
                out[i] = self._label_long(p, cells)
        pages = [p if len(p) <= cells else [] for p in pages]
        rows = describe(pages)
        lengths = np.array([len(p) for p in pages], np.int64)
        begins = np.cumsum(lengths) - lengths
        order = [i for i in np.argsort(lengths, kind="stable").tolist() if lengths[i]]
        while order:
            t, take = lengths[order[-1]], []
            while order and (len(take) + 1) * t <= max(cells, t) and lengths[order[-1]] * 2 >= t:
                take.append(order.pop())
            x = np.zeros((len(take), t, DIMS), np.float32)
            for k, i in enumerate(take):
                x[k, : lengths[i]] = rows[begins[i] : begins[i] + lengths[i]]
            logits, _ = self.forward(x, lengths[take])
            for k, i in enumerate(take):
                out[i] = logits[k, : lengths[i]] > 0
        return out


def train(pages: int = 2400, epochs: int = 6, batch: int = 24, rate: float = 6e-3, seed: int = 1) -> Labeller:
    """A labeller from generated pages, by Adam; the rate falls over the epochs."""
    from vintagepanel.llm.html_pages import labelled_page

    rng = np.random.default_rng(seed)
    made = [labelled_page(rng) for _ in range(pages)]
    rows = [describe([b]) for b, _ in made]
    model = Labeller(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in model.w.items()}, {k: np.zeros_like(v) for k, v in model.w.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(pages).tolist(), key=lambda i: len(rows[i]) // 8)
        chunks = [order[i : i + batch] for i in range(0, pages, batch)]
        for c in rng.permutation(len(chunks)):
            chosen = chunks[c]
            lengths = np.array([len(rows[i]) for i in chosen])
            x, y = np.zeros((len(chosen), lengths.max(), DIMS), np.float32), np.zeros((len(chosen), lengths.max()), np.float32)
            for k, i in enumerate(chosen):
                x[k, : lengths[k]], y[k, : lengths[k]] = rows[i], made[i][1]
            step += 1
            for k, g in model.gradients(x, lengths, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                pace = rate * (1 - epoch / epochs) ** 0.7
                model.w[k] = (model.w[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


_trained: list[Labeller] = []


def default_labeller(spark: SparkSession) -> Labeller:
    """The labeller that train() gives by default. It is trained once and kept in the shared folder, under a digest of the code that makes it."""
    if not _trained:
        from vintagepanel.llm import html_pages

        made_by = hashlib.sha256("".join(inspect.getsource(m) for m in (sys.modules[__name__], html_pages)).encode()).hexdigest()[:24]
        fs, path = pafs.FileSystem.from_uri(f"{shared_dir(spark)}/html-labeller-{made_by}.npz")
        labeller = Labeller()
        if fs.get_file_info(path).is_file:
            with fs.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as held:
                labeller.w = {k: held[k] for k in held.files}
        else:
            labeller = train()
            body = io.BytesIO()
            np.savez(body, **labeller.w)
            fs.create_dir(posixpath.dirname(path), recursive=True)
            part = f"{path}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part, compression=None) as f:
                f.write(body.getvalue())
            fs.move(part, path)  # whole or not at all
        _trained.append(labeller)
    return _trained[0]


def texts(labeller: Labeller, pages: list[str]) -> list[str]:
    parsed = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, keep in zip(p, kept, strict=True) if keep) for p, kept in zip(parsed, labeller.label(parsed), strict=True)]


def extract(pages: DataFrame, labeller: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    text is the main text of the whole html: its blocks in page order, joined by line
    feeds; empty if there is none, and for null or empty html. n_chars counts its code
    points. Null ids and urls, repeated rows and other columns (not read) do no harm; an
    empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(labeller or default_labeller(pages.sparkSession))
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in parts([p or "" for p in batch.column(2).to_pylist()], 1 << 19):
                found = texts(shared.value, part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])
                at += len(part)

    read = pages.select(pages[f"`{id_col}`"].alias("page_id"), pages[f"`{url_col}`"].cast("string").alias("url"), pages[f"`{html_col}`"].cast("string").alias("html"))
    return read.mapInArrow(giving_back(run), f"page_id {id_type}, url string, text string, n_chars long")


def op2(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages)
