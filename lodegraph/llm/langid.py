"""Language identification with a byte convolutional network.

Network: byte embeddings, convolutions of several even widths, ReLU, maximum over the window,
softmax. It is trained in numpy with Adam on windows of a bounded sample of labelled documents
(``TRAIN_ROWS``). For prediction the embedding and each pair of taps fold into one table of
65,536 byte pairs, so a convolution of width 2k is k table rows added. Every text is cut into
fixed-length windows from its first byte to its last, the windows of a batch are scored
together, and a document's score is the mean of its windows' probabilities by bytes.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without labelled
documents every other text is ``und`` too; repeated rows are each predicted; a null doc_id is
never held out and stays null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import prepare, with_carry

#: Most labelled documents that the network is trained on, and windows taken of each.
TRAIN_ROWS, TRAIN_WINDOWS = 3000, 2
LENGTH, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 4, 6)
EPOCHS, BATCH, RATE, SEED = 6, 64, 3e-3, 7
#: Windows scored at once.
CHUNK = 512
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Trained weights: the embedding, taps by width, biases, and the softmax layer."""

    classes: list[str]
    embed: np.ndarray
    taps: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, a table of byte pairs for each two taps; the first holds the bias."""
        made = []
        for w in WIDTHS:
            each = np.einsum("be,wef->wbf", self.embed, self.taps[w]).astype(np.float32)
            pairs = [(each[i][:, None, :] + each[i + 1][None, :, :]).reshape(65536, FILTERS) for i in range(0, w, 2)]
            pairs[0] = pairs[0] + self.bias[w].astype(np.float32)
            made.append(pairs)
        return made


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text as rows of bytes, the last filled with zeros, and their lengths."""
    n = max(1, -(-len(text) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    sizes = np.full(n, LENGTH)
    sizes[-1] = len(text) - (n - 1) * LENGTH
    return out.reshape(n, LENGTH), sizes


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def score(net: Network, tables: list[list[np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Class probabilities of windows."""
    parts = []
    for at in range(0, len(x), CHUNK):
        w = x[at : at + CHUNK].astype(np.uint16)
        pairs = (w[:, :-1] << 8) | w[:, 1:]
        pooled = []
        for width, pair_tables in zip(WIDTHS, tables, strict=True):
            n = LENGTH - width + 1
            total = np.take(pair_tables[0], pairs[:, :n], axis=0)
            for i in range(1, width // 2):
                total += np.take(pair_tables[i], pairs[:, 2 * i : 2 * i + n], axis=0)
            pooled.append(np.maximum(total.max(axis=1), 0))
        parts.append(_softmax(np.concatenate(pooled, axis=1) @ net.out + net.out_bias))
    return np.concatenate(parts) if parts else np.zeros((0, len(net.classes)))


def sample(text: bytes, seed: int) -> list[bytes]:
    """TRAIN_WINDOWS windows from anywhere in a text, short last windows left out if there are others."""
    x, sizes = windows(text)
    full = np.flatnonzero(sizes >= min(LENGTH // 2, sizes.max()))
    return [x[i].tobytes() for i in np.random.default_rng(seed).permutation(full)[:TRAIN_WINDOWS]]


def train(examples: list[bytes], langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """Fit the network on windows; None without a label."""
    classes = sorted(set(langs))
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    xs, ys = [np.frombuffer(t, np.uint8) for t in examples], [classes.index(c) for c in langs]
    x, y = np.array(xs), np.array(ys)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))), "out_bias": np.zeros(len(classes))}
    for w in WIDTHS:
        p[f"taps{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS))
        p[f"bias{w}"] = np.zeros(FILTERS)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            b = x[rows]
            # the forward pass, with the place of each filter's maximum
            e = p["embed"][b]
            pooled, places = [], []
            for w in WIDTHS:
                n = LENGTH - w + 1
                z = sum(e[:, i : i + n] @ p[f"taps{w}"][i] for i in range(w)) + p[f"bias{w}"]
                place = z.argmax(axis=1)
                places.append(place)
                pooled.append(np.maximum(np.take_along_axis(z, place[:, None, :], 1)[:, 0], 0))
            h = np.concatenate(pooled, axis=1)
            prob = _softmax(h @ p["out"] + p["out_bias"])
            # the backward pass: only the places of the maxima carry a gradient
            d = prob
            d[np.arange(len(rows)), y[rows]] -= 1
            d /= len(rows)
            g = {"out": h.T @ d, "out_bias": d.sum(axis=0), "embed": np.zeros_like(p["embed"])}
            dh = (d @ p["out"].T) * (h > 0)
            for k, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
                dz = dh[:, k * FILTERS : (k + 1) * FILTERS]
                g[f"bias{w}"] = dz.sum(axis=0)
                g[f"taps{w}"] = np.zeros_like(p[f"taps{w}"])
                for i in range(w):
                    codes = np.take_along_axis(b, place + i, 1)
                    g[f"taps{w}"][i] = np.einsum("nfe,nf->ef", p["embed"][codes], dz)
                    np.add.at(g["embed"], codes, dz[:, :, None] * p[f"taps{w}"][i].T[None])
            step += 1
            for name, a in g.items():
                m[name] = 0.9 * m[name] + 0.1 * a
                v[name] = 0.999 * v[name] + 0.001 * a * a
                p[name] -= RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return Network(classes, p["embed"], {w: p[f"taps{w}"] for w in WIDTHS}, {w: p[f"bias{w}"] for w in WIDTHS}, p["out"], p["out_bias"])


def _predicted(net: Network | None, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            texts = [t.as_py() for t in batch.column(2)]
            known = [i for i, t in enumerate(texts) if net and t and LETTER.search(t)]
            todo: list[tuple[int, np.ndarray, np.ndarray]] = []
            held = 0

            def flush(todo, langs=langs, scores=scores) -> None:
                prob = score(net, tables, np.concatenate([x for _, x, _ in todo]))
                at = 0
                for i, x, sizes in todo:
                    mean = np.average(prob[at : at + len(x)], axis=0, weights=sizes)
                    at += len(x)
                    k = int(mean.argmax())
                    langs[i], scores[i] = net.classes[k], min(1.0, float(mean[k]))

            for i in known:
                x, sizes = windows(texts[i].encode("utf-8", "replace"))
                todo.append((i, x, sizes))
                held += len(x)
                if held >= CHUNK:
                    flush(todo)
                    todo, held = [], 0
            if todo:
                flush(todo)
            out = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            names = ["doc_id", "held_out", "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays(out + ([batch.column(3)] if carry else []), names=names + (["carry"] if carry else []))

    return run


def held_out(id_col: str):
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = TRAIN_ROWS) -> Network | None:
    """Train on at most max_rows labelled documents that are not held out, those of the smallest hashed id; of an id in several rows the smallest text."""
    prepare(docs.sparkSession)
    rows = docs.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = rows.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h")).distinct().orderBy("h", "id").limit(max_rows).select("id")
    picked = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    picked = picked.groupBy("id").agg(F.min(F.struct("text", "lang")).alias("one")).select("id", "one.lang", "one.text")
    got = picked.mapInArrow(_sampled, "id long, lang string, window binary").collect()  # TRAIN_WINDOWS of one row for each chosen id: 2 * max_rows at most
    got.sort(key=lambda r: (r["id"], r["lang"], bytes(r["window"])))
    return train([bytes(r["window"]) for r in got], [r["lang"] for r in got])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(i, lang, w) for i, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if LETTER.search(text) for w in sample(text.encode("utf-8", "replace"), i % (1 << 32))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["id", "lang", "window"])


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; carry is an SQL expression whose value travels along."""
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), *([F.expr(carry).alias("carry")] if carry else []))
    return base.mapInArrow(_predicted(net, bool(carry)), with_carry("doc_id long, held_out boolean, lang_pred string, score double", base))
