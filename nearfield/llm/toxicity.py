"""Toxicity (operator 8): gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words, and beginnings of words (so that inflected forms count), that stand in many more toxic
than other documents. Features of a whole text: densities and counts of lexicon words, how near second-person words are,
capitals, punctuation, and words disguised by digits or signs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import training_rows

SECOND = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra os".split()
)
_SIGNS = "\"'.,;:!?()[]{}<>«»„“”‘’…*_~#%&$|+=/\\-"
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": "", "'": ""})
_DISGUISED = re.compile(r"[^\W\d_][0-9@$!*.\-_']+[^\W\d_]|^[0-9@$]+[^\W\d_]{2}")
_NEAR = 5
_PREFIXES = range(3, 9)
_CODE = {"word": 1, "stem": 2, "second": 4, "caps": 8, "disguised": 16, "undone": 32}
_WEIGHT_SHIFT = 8


def bare(word: str) -> str:
    """Lower case, without signs at either end."""
    return word.lower().strip(_SIGNS)


@dataclass
class Lexicon:
    """Weights (log odds of document frequencies) of words and of beginnings of words."""

    words: dict[str, float]
    stems: dict[str, float]


def learn_lexicon(texts: list[str], labels: list[int], min_docs: int = 8, min_weight: float = 2.0) -> Lexicon:
    """Terms in at least ``min_docs`` toxic texts whose log odds are at least ``min_weight``; stems only where they
    gather several words. Terms that no toxic text has are never counted, so memory follows the toxic texts."""
    toxic, other = [t for t, y in zip(texts, labels, strict=True) if y], [t for t, y in zip(texts, labels, strict=True) if not y]

    def terms(text: str) -> set[str]:
        words = {bare(w) for w in text.split()} - {""}
        return words | {f"{w[:k]}*" for w in words for k in _PREFIXES if len(w) > k}

    hits: Counter[str] = Counter()
    for t in toxic:
        hits.update(terms(t))
    hits = Counter({w: n for w, n in hits.items() if n >= min_docs})
    misses: Counter[str] = Counter()
    for t in other:
        misses.update(terms(t) & hits.keys())
    weight = {w: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((misses[w] + 0.5) / (len(other) + 1)) for w, n in hits.items()}
    found = {w: x for w, x in weight.items() if x >= min_weight}
    return Lexicon({w: x for w, x in found.items() if w[-1] != "*"}, {w[:-1]: x for w, x in found.items() if w[-1] == "*"})


class Codes(dict):
    """What there is to know of a word, as bits with the lexicon weight (in tenths) above them; memoised, bounded."""

    def __init__(self, lexicon: Lexicon, size: int = 500_000):
        super().__init__()
        self.lexicon, self.size = lexicon, size

    def _look_up(self, word: str) -> tuple[int, float]:
        if (x := self.lexicon.words.get(word)) is not None:
            return _CODE["word"], x
        x = max((s for k in _PREFIXES if len(word) >= k and (s := self.lexicon.stems.get(word[:k]))), default=0.0)
        return (_CODE["stem"], x) if x else (0, 0.0)

    def __missing__(self, raw: str) -> int:
        word = bare(raw)
        code, weight = self._look_up(word)
        if word in SECOND:
            code |= _CODE["second"]
        if len(word) > 1 and raw.isupper():
            code |= _CODE["caps"]
        if _DISGUISED.search(word):
            code |= _CODE["disguised"]
            if not weight:
                kind, weight = self._look_up(bare(word.translate(_PLAIN)))
                code |= kind | (_CODE["undone"] if kind else 0)
        code |= min(255, round(10 * weight)) << _WEIGHT_SHIFT
        if len(self) >= self.size:
            self.clear()
        if len(raw) <= 40:
            self[raw] = code
        return code


FEATURES = 16
_PUNCTUATION = np.frombuffer(b".,;:()[]{}<>*_~#%&$|+=/\\-\"'", np.uint8)


def features(text: str | None, codes: Codes) -> np.ndarray:
    """The dense features of a whole text (null: empty)."""
    text = text or ""
    words = text.split()
    c = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
    n = max(1, len(words))
    weight = (c >> _WEIGHT_SHIFT) / 10
    word, stem = (c & 1) > 0, (c & 2) > 0
    hits, second = np.flatnonzero(word | stem), np.flatnonzero(c & 4)
    near = 0
    if len(hits) and len(second):
        after = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(second[np.minimum(after, len(second) - 1)] - hits), np.abs(hits - second[np.maximum(after - 1, 0)]))
        near = int((gap <= _NEAR).sum())
    by = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    letters, size = max(1, int(by[65:91].sum() + by[97:123].sum())), max(1, int(by.sum()))
    strong = weight >= 3
    return np.array(
        [
            math.log1p(len(words)), word.sum(), 100 * word.sum() / n, stem.sum(), 100 * stem.sum() / n, weight.sum(), 100 * weight.sum() / n, weight.max(initial=0),
            (strong & (word | stem)).sum(), 100 * len(second) / n, near / max(1, len(hits)), by[65:91].sum() / letters, ((c & 8) > 0).sum() / n,
            100 * (by[33] + by[63]) / size, 100 * by[_PUNCTUATION].sum() / size, 100 * (((c & 16) > 0).sum() + 4 * ((c & 32) > 0).sum()) / n,
        ]
    )


class Boosted:
    """Logistic gradient boosting of small trees over binned features."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.1, leaf: int = 15, bins: int = 64, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.leaf, self.bins, self.ridge = trees, depth, rate, leaf, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1], method="inverted_cdf")) for col in x.T]
        b = self._binned(x)
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start, self.grown = math.log(p / (1 - p)), []
        margin = np.full(len(y), self.start)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-margin))
            tree = self._grow(b, q - y, q * (1 - q))
            self.grown.append(tree)
            margin += self.rate * self._walk(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T, strict=True)], axis=1).astype(np.int16)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """Nodes in heap order: (feature, bin, value); feature -1 is a leaf."""
        nodes: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
        todo = [(0, np.arange(len(g)))]
        while todo:
            k, rows = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes[k] = (-1, 0, float(-gs / (hs + self.ridge)))
            if 2 * k + 2 >= len(nodes) or len(rows) < 2 * self.leaf:
                continue
            best, gain = None, 1e-6
            for f in range(b.shape[1]):
                col = b[rows, f]
                size = len(self.cuts[f]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(col, w, size))[:-1] for w in (g[rows], h[rows], None))
                ok = (nl >= self.leaf) & (len(rows) - nl >= self.leaf)
                if ok.any():
                    score = np.where(ok, gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge), -1)
                    at = int(score.argmax())
                    if score[at] > gain:
                        best, gain = (f, at), float(score[at])
            if best:
                nodes[k] = (best[0], best[1], 0.0)
                left = b[rows, best[0]] <= best[1]
                todo += [(2 * k + 1, rows[left]), (2 * k + 2, rows[~left])]
        return nodes

    def _walk(self, tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(v) for v in zip(*tree, strict=True))
        at = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.start)
        for tree in self.grown:
            out += self.rate * self._walk(tree, b)
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and probabilities, each block smoothed by one pseudo-row at the mean."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    mean = float(y.mean())
    return np.array([b[2] / b[1] for b in blocks]), np.maximum.accumulate([(b[0] + mean) / (b[1] + 1) for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    boosted: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.boosted is None:
            return np.full(len(x), self.knots[1][0])
        return np.clip(np.interp(self.boosted.margin(x), *self.knots), 0, 1)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Lexicons are learned crosswise (each half's features come from the other half's), so that trees see lexicon
    densities as unseen texts have them; the calibration uses margins from outside the folds fitted on. Without both
    labels in every fold the score is the labels' mean (0 for none)."""
    y = np.array(labels, np.float64)
    if not len(y) or min(y.sum(), len(y) - y.sum()) < 12:
        return Model(Lexicon({}, {}), None, (np.zeros(1), np.array([float(y.mean()) if len(y) else 0.0])))
    half, third = np.arange(len(y)) % 2, np.arange(len(y)) // 2 % 3
    x = np.zeros((len(y), FEATURES))
    for k in (0, 1):
        own = np.flatnonzero(half != k)
        codes = Codes(learn_lexicon([texts[i] for i in own], [labels[i] for i in own], min_docs=max(3, min(8, int(y.sum()) // 40))))
        for i in np.flatnonzero(half == k):
            x[i] = features(texts[i], codes)
    outside = np.zeros(len(y))
    for k in range(3):
        outside[third == k] = Boosted().fit(x[third != k], y[third != k]).margin(x[third == k])
    return Model(learn_lexicon(texts, labels, min_docs=max(3, min(8, int(y.sum()) // 40))), Boosted().fit(x, y), isotonic(outside, y))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_chars: int = 20_000) -> Model:
    """Fit on the driver, on at most ``max_rows`` labelled texts of at most ``max_chars`` characters (a bounded sample by
    hash of doc_id); rows whose ``crc32(doc_id) mod 3`` is 1 are never learned from."""
    rows = sorted(training_rows(docs, labels, "toxic", max_rows, max_chars).collect())
    return fit([r.text for r in rows], [int(r.label) for r in rows])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): one row for each row of ``docs``, over the whole text. Null texts count as empty, null doc_ids
    and repeated rows stay, an empty table gives no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(model.lexicon)
        for batch in batches:
            x = [features(t.as_py(), codes) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(np.array(x).reshape(-1, FEATURES)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op8_toxicity_gbt(spark, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scores(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
