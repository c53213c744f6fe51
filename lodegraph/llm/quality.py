"""Quality rules: fixed rules first, then gradient-boosted trees over document statistics.

Statistics are exact and taken from whole texts. The trees are grown in numpy on binned
features with the logistic loss, on a bounded sample of labelled documents (``TRAIN_ROWS``).
Features named in ``MONOTONE`` may only lower the score as they rise: a split that would break
the order is not considered, and the children of a kept split are bounded by the middle of
their two values. All trees are flattened into four node arrays, so scoring a batch walks
every tree one level at a time with array lookups.

Defined cases: a null or empty text has no words and fails the base rules; rows that repeat
are each scored; a null doc_id stays null; without labelled documents of both kinds the verdict
is that of the base rules; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import prepare, texts, with_carry

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Most labelled documents that the trees are fitted on.
TRAIN_ROWS = 8000
TREES, DEPTH, RATE, BINS, L2, MIN_CHILD = 40, 3, 0.3, 64, 1.0, 5.0
#: Documents whose chance of good quality is below this go.
THRESHOLD = 0.25
FEATURES = ["symbol_share", "pipe_share", "repeat_share", "dup_line_share", "word_length", "letter_share", "digit_share", "upper_share", "words_per_line", "distinct_share"]
MONOTONE = {"symbol_share": -1, "pipe_share": -1, "repeat_share": -1, "dup_line_share": -1}
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

CLASS = np.zeros(256, np.uint8)  # bit 0 white space, 1 continuation byte, 2 symbol, 3 letter, 4 digit, 5 upper, 6 pipe, 7 line end
for _bit, _set in enumerate((SPACES, bytes(range(0x80, 0xC0)), SYMBOLS, bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]), b"0123456789", bytes(range(65, 91)), b"|", b"\n")):
    for _c in _set:
        CLASS[_c] |= 1 << _bit


def repeated_words(words: list[bytes], window: int = WINDOW) -> tuple[int, int]:
    """Words that lie in a window found twice or more, the first included; and distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    n, v = len(ids), max(1, len(seen))
    if n <= window:
        return 0, len(seen)
    code = ids[: n - window + 1]
    width = v
    for i in range(1, window):
        nxt = ids[i : n - window + 1 + i]
        if width > (1 << 62) // v:
            code = np.unique(code, return_inverse=True)[1]
            width = len(code)
        code = code * v + nxt
        width *= v
    order = np.argsort(code, kind="stable")
    same = np.diff(code[order]) == 0
    if not same.any():
        return 0, len(seen)
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1]))), len(seen)


def statistics(text: bytes) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the features."""
    words = text.split()
    counts = np.bincount(CLASS[np.frombuffer(text, np.uint8)], minlength=256) if text else np.zeros(256, np.int64)
    of = lambda bit: int(counts[(np.arange(256) >> bit) & 1 == 1].sum())
    space, joint, symbols, letters, digits, upper, pipes, ends = (of(b) for b in range(8))
    chars = len(text) - joint
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat, distinct = repeated_words(words)
    n = len(words)
    word_chars = chars - space
    body = max(1, word_chars)
    features = [symbols / body, pipes / body, repeat / max(1, n), dup / max(1, len(lines)), word_chars / max(1, n), letters / body, digits / body, upper / body, n / max(1, len(lines)), distinct / max(1, n) ** 0.9]
    return n, word_chars, symbols, dup, repeat, features


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


@dataclass
class Forest:
    """All trees in flat arrays: a leaf has itself as both children."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of good quality of each row of features."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            low = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, names: list[str] = FEATURES, monotone: dict[str, int] = MONOTONE, trees: int = TREES) -> Forest | None:
    """Boosted trees for labels 0 and 1, or None if one of them is absent."""
    if not len(y) or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    signs = np.array([monotone.get(n, 0) for n in names])
    rate = y.mean()
    bias = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        at = len(value)
        feature.append(0)
        threshold.append(np.inf)
        left.append(at)
        right.append(at)
        value.append(v)
        return at

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(min(max(-g / (h + L2), low), high))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)

        def grow(rows: np.ndarray, depth: int, low: float, high: float, grad=grad, hess=hess) -> int:
            g, h = grad[rows].sum(), hess[rows].sum()
            own = weight(g, h, low, high)
            at = leaf(own * RATE)
            best = None
            if depth < DEPTH:
                loss = lambda g, h, w: g * w + 0.5 * (h + L2) * w * w
                for f in range(x.shape[1]):
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, grad[rows], len(cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[rows], len(cuts[f]) + 1))[:-1]
                    wl, wr = np.clip(-gl / (hl + L2), low, high), np.clip(-(g - gl) / (h - hl + L2), low, high)
                    gain = loss(g, h, own) - loss(gl, hl, wl) - loss(g - gl, h - hl, wr)
                    ok = (hl * 4 >= MIN_CHILD / 4) & ((h - hl) * 4 >= MIN_CHILD / 4) & ((wr - wl) * signs[f] >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    if len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k, wl[k], wr[k])
            if best is None:
                margin[rows] += own * RATE
                return at
            _, f, k, wl, wr = best
            mid = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(signs[f])]
            goes = binned[rows, f] <= k
            feature[at], threshold[at] = f, cuts[f][k]
            left[at] = grow(rows[goes], depth + 1, *bounds[0])
            right[at] = grow(rows[~goes], depth + 1, *bounds[1])
            return at

        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), bias)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _measured(forest: Forest | None, with_features: bool, with_carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(1)]
            if not stats:
                continue
            cols = list(zip(*stats, strict=True))
            failed = np.array([base_failed(s[0], s[4]) for s in stats])
            out = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(failed)]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            if with_features:
                out.append(pa.array(cols[5], pa.list_(pa.float64())))
                names.append("features")
            else:
                score = forest.score(np.array(cols[5])) if forest else np.ones(len(stats))
                out += [pa.array(~failed & (score >= THRESHOLD)), pa.array(score)]
                names += ["kept", "score"]
            if with_carry:
                out.append(batch.column(2))
                names.append("carry")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAIN_ROWS) -> Forest | None:
    """Fit on at most max_rows labelled documents, those of the smallest hashed id.

    A document with several labels counts with the smallest of them, one with several texts with
    the smallest of those, so that the fit depends on the tables alone.
    """
    prepare(docs.sparkSession)
    chosen = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    measured = rows.select("doc_id", "text", F.col("quality").cast("int").alias("carry")).mapInArrow(_measured(None, True, True), COLUMNS + ", features array<double>, carry int")
    got = measured.filter("not base_failed").select("doc_id", "features", "carry").collect()  # one row for each chosen id: max_rows at most
    got.sort(key=lambda r: r["doc_id"])
    return fit(np.array([r["features"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["carry"] for r in got], float))


def apply_rules(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """The statistics of each row, base_failed, kept and score; carry is an SQL expression whose value travels along."""
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *([F.expr(carry).alias("carry")] if carry else []))
    return base.mapInArrow(_measured(forest, False, bool(carry)), with_carry(COLUMNS + ", kept boolean, score double", base))
