"""Toxicity by a gap-weighted subsequence kernel, a support vector machine and Nyström landmarks.

Two strings are similar in so far as they share subsequences of four symbols, each
weighted down by the gaps it spans: an insult with characters put between its letters
still shares most of its subsequences with the plain one. The machine works on Nyström
features, similarities to a fixed number of landmark strings. It is linear in them, and
they are linear in the subsequence counts, so a trained machine folds into one table of
weights per subsequence, and scoring whole texts is one pass of table look-ups.

Labels are those of documents, so training sees stretches of a sentence's length (16
positions and the gaps these span) under the label of their document. Which stretch of a toxic
document is to blame is latent: rounds alternate between picking the best stretch of each
document under the current machine (for clean ones: the worst mistakes) and refitting. The words that only toxic documents
hold are also shown with marks put between their letters.
A bounded sample of labelled rows is read: at most `sample` a class, of at most
`sample_chars` code points each; scoring reads all rows and whole texts. Where a class is
sampled, its rows stand for the others when the probabilities are set, so that 0.5 means
the same however large the table is.
"""

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagepanel.llm.common import giving_back, small_batches
from vintagepanel.llm.shingles import parts

#: Length of subsequences, the longest stretch one spans, and the weight of each gap.
LENGTH, SPAN, DECAY = 4, 7, 0.6
#: Positions whose subsequences make up one scored stretch of a sentence.
WINDOW = 16
#: Characters of texts whose symbols are worked on at a time.
_PART = 1 << 19
#: Blanks between texts, so that no stretch or subsequence of one text reaches the next.
_PAD = WINDOW + SPAN
_SYMBOLS = 32
_BLANK, _DIGIT, _MARK, _LETTER = 0, 27, 28, 29
_PATTERNS = [(0, *rest) for rest in combinations(range(1, SPAN), LENGTH - 1)]
_WEIGHTS = [DECAY ** (p[-1] - LENGTH + 1) for p in _PATTERNS]


@cache
def _symbols() -> np.ndarray:
    """A symbol of 32 for each code point: the 26 letters without accents, and classes of the rest."""
    out = np.empty(0x110000, np.uint8)
    for c in range(0x110000):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower() if c < 0x3000 else ""
        kind = unicodedata.category(chr(c))[0]
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif kind == "Z" or c in (9, 10, 11, 12, 13):
            out[c] = _BLANK
        else:
            out[c] = {"N": _DIGIT, "L": _LETTER + c % 3}.get(kind, _MARK)
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each after a blank and followed by _PAD of them, and where each text begins, its blank included (one more entry)."""
    joined = "".join(f" {t}{' ' * _PAD}" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _symbols()[points], np.concatenate([[0], np.cumsum([1 + len(t) + _PAD for t in texts])]).astype(np.int64)


def _subsequences(symbols: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """For each gap pattern its weight and, per position, the number of the subsequence that begins there."""
    padded = np.concatenate([symbols, np.zeros(SPAN, np.uint8)]).astype(np.int32)
    n = len(symbols)
    for weight, (_, *offsets) in zip(_WEIGHTS, _PATTERNS, strict=True):
        number = padded[:n]
        for o in offsets:
            number = (number << 5) | padded[o : o + n]
        yield weight, number


def profile(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subsequences of a string with their summed weights: those without a blank at either end, and those
    whose one blank is at an end, which tell where words begin and end."""
    numbers, weights = [], []
    for weight, number in _subsequences(symbols):
        a, b, c, d = (((number >> shift) & 31) > 0 for shift in (15, 10, 5, 0))
        counted = (a & d) | (b & c & (a | d))
        numbers.append(number[counted])
        weights.append(np.full(int(counted.sum()), weight))
    found, at = np.unique(np.concatenate(numbers), return_inverse=True)
    return found, np.bincount(at, np.concatenate(weights), minlength=len(found))


@dataclass
class Machine:
    """weights per subsequence, bias, and the slope and offset that turn a margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def stretches(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Per position the machine's value of the stretch of WINDOW positions that begins there; between texts, very low."""
        each = np.zeros(len(symbols), np.float32)
        for weight, number in _subsequences(symbols):
            each += self.weights[number] * np.float32(weight)
        total = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
        ends = np.minimum(np.arange(len(symbols)) + WINDOW, len(symbols))
        value = total[ends] - total[:-1] + self.bias
        value[(begins[1:, None] - np.arange(1, _PAD)).ravel()] = -1e9
        return value

    def margins(self, texts: list[str]) -> np.ndarray:
        """The largest value of a stretch of each text."""
        symbols, begins = codes(texts)
        return np.maximum.reduceat(self.stretches(symbols, begins), begins[:-1])

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -40, 40)))


def fit_svm(features: np.ndarray, signs: np.ndarray, cost: float = 300.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss and balanced classes, by Newton steps on its support vectors."""
    x = np.column_stack([features, np.ones(len(features), features.dtype)])
    per_class = {s: cost / max(1, (signs == s).sum()) for s in (-1, 1)}
    c = np.where(signs > 0, per_class[1], per_class[-1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w, support = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        gram, right = ridge.copy(), np.zeros(x.shape[1])
        for rows in np.array_split(np.flatnonzero(support), 1 + len(x) // 2048):
            xs = x[rows].astype(np.float64)
            gram += 2 * (xs * c[rows, None]).T @ xs
            right += 2 * xs.T @ (c[rows] * signs[rows])
        w = np.linalg.solve(gram, right)
        now = signs * (x @ w) < 1
        if (now == support).all():
            break
        support = now
    return w[:-1], float(w[-1])


def _words(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]{3,}", text.lower()))


def _evidence(a: int, p: int, b: int, q: int) -> float:
    """Log-likelihood ratio of a of p toxic documents holding a word against b of q clean ones; 0 if it speaks for clean."""
    if a * q <= b * p:
        return 0.0
    e1, e2 = p * (a + b) / (p + q), q * (a + b) / (p + q)
    return 2 * (a * np.log(a / e1) + (b * np.log(b / e2) if b else 0.0))


def landmarks(toxic: list[str], clean: list[str], n: int, least: float = 12.0) -> tuple[list[str], list[str], list[str]]:
    """(telling, sure, common): words that tell toxic documents from clean ones, at most three in four of n; those of them
    that no clean document holds; and the commonest words of clean documents."""
    a, b = Counter(w for t in toxic for w in _words(t)), Counter(w for t in clean for w in _words(t))
    weight = {w: _evidence(k, len(toxic), b[w], len(clean)) for w, k in a.items()}
    telling = sorted((w for w, e in weight.items() if e >= least), key=lambda w: (-weight[w], w))[: n * 3 // 4]
    common = [w for w, _ in sorted(b.items(), key=lambda x: (-x[1], x[0])) if w not in weight or weight[w] < least][: n - len(telling)]
    return telling, [w for w in telling if not b[w]], common


def disguised(words: list[str]) -> list[str]:
    """The words with marks put between their letters: between all, and at one place or two."""
    out = []
    for k, w in enumerate(words):
        mark, at = "-.*_"[k % 4], 1 + k % (len(w) - 1)
        out += [mark.join(w), w[:at] + mark + w[at:], w[:at] + mark + mark + w[at:], " ".join(w)]
    return [f"  {w}  " for w in out if w]


def train(toxic: list[str], clean: list[str], n_landmarks: int = 384, rounds: int = 6, stands_for: tuple[float, float] = (1.0, 1.0)) -> Machine:
    """A machine from whole documents of either label; a fifth of each is kept back to set the probabilities.

    stands_for: how many labelled documents each toxic and each clean one was drawn from.
    """
    held = [toxic[::5], clean[::5]]
    toxic, clean = [t for i, t in enumerate(toxic) if i % 5] or toxic, [t for i, t in enumerate(clean) if i % 5] or clean
    telling, sure, common = landmarks(toxic, clean, n_landmarks)
    strings = telling + common
    profiles = [profile(codes([s])[0]) for s in strings]
    known = np.unique(np.concatenate([p[0] for p in profiles]))
    phi = np.zeros((len(known), len(strings)), np.float32)
    for j, (numbers, weights) in enumerate(profiles):
        phi[np.searchsorted(known, numbers), j] = weights / np.linalg.norm(weights)
    values, vectors = np.linalg.eigh((phi.T @ phi).astype(np.float64))
    some = values > 1e-6 * values[-1]
    to_features = vectors[:, some] / np.sqrt(values[some])
    row_of = np.full(_SYMBOLS**LENGTH, -1, np.int32)
    row_of[known] = np.arange(len(known))

    def folded(beta: np.ndarray, bias: float) -> Machine:
        weights = np.zeros(_SYMBOLS**LENGTH, np.float32)
        weights[known] = phi @ beta
        return Machine(weights, bias)

    def nystroem(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Features of the stretches that begin at starts, from their similarities to each landmark."""
        at = starts[:, None] + np.arange(WINDOW)
        out = np.zeros((len(starts), len(strings)))
        for weight, number in _subsequences(symbols):
            row = row_of[number[np.minimum(at, len(number) - 1)]]
            which, place = np.nonzero((row >= 0) & (at < len(number)))
            for low in range(0, len(which), 100_000):
                i, k = which[low : low + 100_000], place[low : low + 100_000]
                _add_rows(out, i, weight * phi[row[i, k]])
        return (out @ to_features).astype(np.float32)

    sides = [(sign, *codes(p)) for sign, texts in ((-1, clean), (1, toxic), (1, disguised(sure))) for p in parts(texts, _PART)]
    machine = folded(np.where(np.arange(len(strings)) < len(telling), 1.0, -1.0), 0.0)
    # one stretch of each clean document, whatever it holds, so that the bias is that of ordinary text
    seen = [(nystroem(symbols, (begins[:-1] + begins[1:]) // 2), -1) for sign, symbols, begins in sides if sign < 0]
    for _ in range(rounds):
        fresh = []
        for sign, symbols, begins in sides:
            value = machine.stretches(symbols, begins)
            best = np.array([a + int(np.argmax(value[a:b])) for a, b in zip(begins[:-1], begins[1:], strict=True)], np.int64)
            fresh.append((nystroem(symbols, best), sign))
        # the mistakes on clean documents accumulate; what is to blame in toxic ones is picked anew
        seen = [s for s in seen if s[1] < 0] + fresh
        x = np.concatenate([s[0] for s in seen])
        y = np.concatenate([np.full(len(s[0]), s[1]) for s in seen])
        w, bias = fit_svm(x, y)
        machine = folded(to_features @ w, bias)
    margins = np.concatenate([machine.margins(p) for h in held for p in parts(h, _PART)])
    labels = np.concatenate([np.ones(len(held[0])), np.zeros(len(held[1]))])
    machine.slope, machine.offset = _platt(margins, labels, np.where(labels > 0, *stands_for))
    return machine


def _add_rows(out: np.ndarray, which: np.ndarray, rows: np.ndarray) -> None:
    """out[which] += rows; which is sorted."""
    if len(which):
        first = np.flatnonzero(np.diff(which, prepend=-1))
        out[which[first]] += np.add.reduceat(rows, first, axis=0)


def _platt(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit with targets short of 0 and 1, by Newton steps that are halved until the loss falls."""
    pos, neg = max(1.0, labels.sum()), max(1.0, (1 - labels).sum())
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, p = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    share = weights / weights.sum()

    def loss(p: np.ndarray) -> float:
        z = x @ p
        return float(share @ (np.logaddexp(0, z) - target * z) + 5e-5 * ((p[0] - 1) ** 2 + p[1] ** 2))

    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -40, 40)))
        gradient = x.T @ (share * (s - target)) + 1e-4 * np.array([p[0] - 1, p[1]])
        curve = (x * (share * s * (1 - s))[:, None]).T @ x + 1e-4 * np.eye(2)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-6 and loss(p - size * step) > loss(p):
            size /= 2
        p = p - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(p[0], 1e-3)), float(p[1])


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_chars: int = 20_000) -> Machine | float:
    """A machine from labelled rows outside fold 0, at most sample a class; where a class is missing, the share of toxic labels."""
    known = labels.select(labels["doc_id"].alias("l_id"), labels["toxic"].cast("int").alias("toxic")).filter("toxic IN (0, 1)").filter(fold(F.col("l_id")) != 0)
    counted = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counted) < 2:
        return float(counted.get(1, 0) > 0)
    order = [F.xxhash64("l_id"), F.col("l_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(sample).unionByName(known.filter("toxic = 0").orderBy(*order).limit(sample))
    text = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text")).filter(F.length("text").between(1, sample_chars))
    rows = text.join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    toxic, clean = ([r["text"] for r in rows if r["toxic"] == k] for k in (1, 0))
    stands_for = tuple(counted[k] / min(sample, counted[k]) for k in (1, 0))
    return train(toxic, clean, stands_for=stands_for) if toxic and clean else float(bool(toxic))


def score(docs: DataFrame, model: Machine | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1; label 1 likelier), predicted (1 if score >= 0.5, else 0).

    A document's score is that of its worst stretch. Whole texts are read; a null text is
    an empty one and is scored as a stretch of blanks. Null ids, repeated rows and other
    columns (not read) do no harm; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            at = 0
            for part in parts([t or "" for t in batch.column(1).to_pylist()], _PART):
                found = machine.scores(part) if isinstance(machine, Machine) else np.full(len(part), machine)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(found, pa.float64())], ["doc_id", "score"])
                at += len(part)

    out = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(giving_back(run), f"doc_id {id_type}, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_clean(docs: DataFrame, model: Machine | float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the machine does not reject; all columns ride along in the same pass.

    Null and empty texts are scored as blanks, null ids and repeated rows do no harm, and
    an empty table stays one.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at_text).to_pylist()]
            found = [machine.scores(p) if isinstance(machine, Machine) else np.full(len(p), machine) for p in parts(texts, _PART)]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) < 0.5))

    return docs.mapInArrow(giving_back(run), docs.schema)


def op7(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (null ids are not), score and predicted of every row; rows without text, repeated rows and other columns as in score()."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
