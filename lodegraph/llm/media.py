"""Media columns: local image descriptors that find cropped or edited copies.

Describing: Harris corners at several scales; the direction from a corner to the centroid of
its neighbourhood turns a fixed pattern of pixel pairs, and each pair's comparison is one of
126 bits; the pairs are close together, so that bits depend little on each other. Matching: the
bits are cut into three tables of 42; images whose descriptors agree in
a table entry share a node (the node machinery of the n-gram join: equal nodes once, large nodes
in blocks, each pair in the first node it shares). Verifying: mutual best matches by Hamming
distance vote for one similarity transform, and a pair is linked if enough of them agree.

Images with equal pixels are one class from the start, so copies are never paired.

Images are grey, as raw rows of bytes. The test tables hold no pictures; ``pictures`` draws one
for each embedding (a function of its values alone) and, for every fifth vec_id, a cropped and
relit copy, so that the query has known copies to find.

Defined cases: a null or empty picture, one whose bytes do not fill whole rows, or one without
corners, is its own group; a very large picture has corners in each of its cells, at all scales; rows that
repeat are members of one class; a null embedding is drawn as an empty picture; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import prepare, stored
from lodegraph.llm.ngram_join import linked, ranked, shared_nodes, told

SIDE, RADIUS, MARGIN = 64, 7, 9
TABLES, TABLE_BITS = 3, 42
BITS = TABLES * TABLE_BITS
#: Each scale is STEP times the former, as long as the shorter side keeps LEAST_SIDE pixels; in each cell of CELL pixels squared the KEYPOINTS strongest corners count.
STEP, LEAST_SIDE, CELL, KEYPOINTS = 0.5**0.5, 32, 64, 16
MAX_DISTANCE, MIN_AGREE, TOLERANCE = 14, 5, 2.5
BLOCK = 64


def _pairs(seed: int = 128, spread: float = 3.0) -> np.ndarray:
    """The pixel pairs: a place within the radius and one near it, drawn once from a fixed seed."""
    rng = np.random.default_rng(seed)
    first = rng.uniform(-RADIUS + 2, RADIUS - 2, (BITS, 2))
    return np.clip(np.stack([first, first + rng.normal(0, spread, (BITS, 2))], axis=1), -RADIUS, RADIUS)


PATTERN = _pairs()
WEIGHTS = np.int64(1) << np.arange(TABLE_BITS, dtype=np.int64)
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
DISC = (_X**2 + _Y**2 <= RADIUS**2).astype(float)


def draw(values: np.ndarray) -> np.ndarray:
    """A picture that is a function of the values: rectangles over a rough ground."""
    seed = int.from_bytes(hashlib.blake2b(np.asarray(values, "<f4").tobytes(), digest_size=8).digest(), "little")
    rng = np.random.default_rng(seed)
    image = 110 + _blur(rng.normal(0, 25, (SIDE, SIDE)))
    for y, x, h, w, shade in zip(*rng.integers(0, SIDE - 8, (2, 18)), *rng.integers(5, 18, (2, 18)), rng.integers(-70, 70, 18), strict=True):
        image[y : y + h, x : x + w] += shade
    return np.clip(image, 0, 255).astype(np.uint8)


def edited(image: np.ndarray, key: int) -> np.ndarray:
    """A copy with borders cut off and another brightness and contrast."""
    rng = np.random.default_rng(key & (1 << 63) - 1)
    top, left, bottom, right = rng.integers(0, 9, 4)
    part = image[top : SIDE - bottom, left : SIDE - right].astype(float)
    return np.clip(part * rng.uniform(0.8, 1.0) + rng.uniform(0, 20), 0, 255).astype(np.uint8)


def _blur(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="edge")
    return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)) / 9


def _resized(image: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return image
    h, w = (max(1, int(n * scale)) for n in image.shape)
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(y.astype(int), 0, image.shape[0] - 2), np.clip(x.astype(int), 0, image.shape[1] - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda i, j: image[np.ix_(y0 + i, x0 + j)]
    return (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints (x, y, scale, angle) and their descriptors, a number for each table."""
    points, words = [], []
    side = min(image.shape)
    for scale in (STEP**k for k in range(64) if k == 0 or side * STEP**k >= LEAST_SIDE - 1e-6):
        a = _blur(_resized(image.astype(float), scale))
        h, w = a.shape
        if min(h, w) <= 2 * MARGIN + 2:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
        score = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        p = np.pad(score, 1, constant_values=-np.inf)
        peak = score >= np.max([p[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        peak[:MARGIN], peak[-MARGIN:], peak[:, :MARGIN], peak[:, -MARGIN:] = False, False, False, False
        ys, xs = np.nonzero(peak & (score > 1))
        cell = ys // CELL * (w // CELL + 1) + xs // CELL
        best = np.lexsort((xs, ys, -score[ys, xs], cell))
        in_order = cell[best]
        rank = np.arange(len(best)) - np.searchsorted(in_order, in_order)
        best = best[rank < KEYPOINTS]
        ys, xs = ys[best], xs[best]
        if not len(ys):
            continue
        patch = a[ys[:, None, None] + _Y, xs[:, None, None] + _X] * DISC
        angle = np.arctan2((patch * _Y).sum((1, 2)), (patch * _X).sum((1, 2)))
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.rint(c * PATTERN[:, :, 0] - s * PATTERN[:, :, 1]).astype(int) + xs[:, None, None]
        py = np.rint(s * PATTERN[:, :, 0] + c * PATTERN[:, :, 1]).astype(int) + ys[:, None, None]
        v = a[np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)]
        words.append((v[:, :, 0] < v[:, :, 1]).reshape(-1, TABLES, TABLE_BITS) @ WEIGHTS)
        points.append(np.stack([xs / scale, ys / scale, np.full(len(xs), scale), angle], axis=1))
    if not points:
        return np.zeros((0, 4)), np.zeros((0, TABLES), np.int64)
    return np.concatenate(points), np.concatenate(words)


def agreeing(a_points: np.ndarray, a_words: np.ndarray, b_points: np.ndarray, b_words: np.ndarray) -> int:
    """The most mutual matches that one similarity transform explains."""
    if not len(a_words) or not len(b_words):
        return 0
    distance = np.bitwise_count(a_words[:, None, :] ^ b_words[None, :, :]).sum(axis=2)
    to_b, to_a = distance.argmin(axis=1), distance.argmin(axis=0)
    i = np.flatnonzero((to_a[to_b] == np.arange(len(a_words))) & (distance.min(axis=1) <= MAX_DISTANCE))
    if len(i) < MIN_AGREE:
        return len(i)
    p, q = a_points[i], b_points[to_b[i]]
    # each match is a hypothesis: its scale and angle change, and the shift that carries its point over
    size, turn = p[:, 2] / q[:, 2], q[:, 3] - p[:, 3]
    c, s = size * np.cos(turn), size * np.sin(turn)
    x = c[:, None] * p[None, :, 0] - s[:, None] * p[None, :, 1]
    y = s[:, None] * p[None, :, 0] + c[:, None] * p[None, :, 1]
    at = np.arange(len(i))
    dx = x - x[at, at][:, None] + q[:, 0][:, None] - q[None, :, 0]
    dy = y - y[at, at][:, None] + q[:, 1][:, None] - q[None, :, 1]
    return int((dx * dx + dy * dy <= TOLERANCE**2).sum(axis=1).max())


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, pixels, widths = [], [], []
        for i, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            image = draw(values.values.to_numpy(zero_copy_only=False)) if values.is_valid else np.zeros((0, 0), np.uint8)
            made = [(0, image)] + ([(1, edited(image, i))] if values.is_valid and i is not None and i % 5 == 0 else [])
            for k, m in made:
                ids.append(None if i is None else 2 * i + k)
                pixels.append(m.tobytes())
                widths.append(m.shape[1])
        yield pa.RecordBatch.from_pydict({"media_id": pa.array(ids, pa.int64()), "pixels": pa.array(pixels, pa.binary()), "width": pa.array(widths, pa.int32())})


def pictures(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(media_id, pixels, width): 2 * vec_id is a vector's picture, 2 * vec_id + 1 an edited copy."""
    prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    return rows.mapInArrow(_drawn, "media_id long, pixels binary, width int")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, points, words = [], [], []
        for pixels, width in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not pixels or not width or width < 0 or len(pixels) % width:
                cls.append(None)
                points.append(None)
                words.append(None)
                continue
            p, w = describe(np.frombuffer(pixels, np.uint8).reshape(-1, width))
            cls.append(hashlib.blake2b(width.to_bytes(4, "little") + pixels, digest_size=16).digest())
            points.append(p.astype("<f4").tobytes())
            words.append(w.reshape(-1))
        yield pa.RecordBatch.from_pydict({"media_id": batch.column(0), "cls": pa.array(cls, pa.binary()), "points": pa.array(points, pa.binary()), "words": pa.array(words, pa.list_(pa.int64()))})


def _keys(words: np.ndarray) -> np.ndarray:
    """Table entries as single numbers: the table above the descriptor's bits; sorted."""
    return np.unique(words + (np.arange(TABLES, dtype=np.int64) << TABLE_BITS))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, rows = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        cls, side = [r[0] for r in rows], np.array([r[1] for r in rows])
        points, words = [np.frombuffer(r[2], "<f4").reshape(-1, 4) for r in rows], [r[3].reshape(-1, TABLES) for r in rows]
        entries = [_keys(w) for w in words]
        flat, owner = np.concatenate(entries), np.repeat(np.arange(len(rows)), [len(e) for e in entries])
        this = (key[0] << TABLE_BITS) + key[1]
        two = key[2] != key[3]
        counts, edges = np.zeros(len(rows), np.int64), []
        for a in range(len(rows)):
            # a pair that shares an earlier entry counts there
            met = np.bincount(owner[np.isin(flat, entries[a][entries[a] < this])], minlength=len(rows)) > 0
            for b in np.flatnonzero(~met & ((side != side[a]) if two else True) & (np.arange(len(rows)) > a)).tolist():
                if agreeing(points[a], words[a], points[b], words[b]) >= MIN_AGREE:
                    counts[[a, b]] += 1
                    edges.append((a, b))
        if edges:
            parent = list(range(len(rows)))

            def root(x: int) -> int:
                while parent[x] != x:
                    x = parent[x]
                return x

            tree = []
            for a, b in edges:
                if root(a) != root(b):
                    parent[root(a)] = root(b)
                    tree.append((a, b))
            have = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([cls[i] for i in have] + [cls[a] for a, _ in tree], pa.binary()), "b": pa.array([None] * len(have) + [cls[b] for _, b in tree], pa.binary()),
                "links": pa.array([*counts[have].tolist(), *[0] * len(tree)], pa.int64()),
            })

    for batch in batches:
        for tree, node, i, j, cls, side, points, words in zip(*(batch.column(k) for k in range(8)), strict=True):
            now = (tree.as_py(), node.as_py(), i.as_py(), j.as_py())
            if now != key:
                yield from close()
                key, rows = now, []
            rows.append((cls.as_py(), side.as_py(), points.as_py(), words.values.to_numpy()))
    yield from close()


def copies(media: DataFrame) -> DataFrame:
    """One row for each row of media: media_id, class_id (the smallest media_id of its group), copy_of, n_links."""
    prepare(media.sparkSession)
    described = stored(media.select("media_id", "pixels", "width").mapInArrow(_described, "media_id long, cls binary, points binary, words array<long>"), "described")
    classes = stored(described.filter("cls is not null").groupBy("cls").agg(F.min("media_id").alias("rep"), F.count("*").alias("rows"), F.first("points").alias("points"), F.first("words").alias("words")), "images")
    entries = classes.select("cls", F.posexplode("words").alias("at", "node")).select("cls", F.pmod("at", F.lit(TABLES)).alias("tree"), "node").distinct().withColumn("weight", F.lit(1))
    dealt = shared_nodes(entries, BLOCK)
    described_class = classes.select("cls", ranked(F.col("rep"), F.col("cls")).alias("key"), "points", "words")
    rows = dealt.join(described_class, "cls").select("tree", "node", "i", "j", "key", "side", "points", "words")
    keys = ["tree", "node", "i", "j"]
    found = stored(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_matched, "a binary, b binary, links long"), "matches")
    known = classes.select("cls", "rep", "rows").join(linked(found), "cls", "left")
    known = known.select("cls", "rows", F.col("rep").alias("copy_of"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return told(described.select(F.col("media_id").alias("doc_id"), "cls"), stored(known, "known")).withColumnRenamed("doc_id", "media_id")
