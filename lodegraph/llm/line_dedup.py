"""Line dedup with two Bloom filters.

1. One pass over the documents writes *batches* to the shared folder: the 16-byte digests of up
   to ``FLUSH`` keys of a task, sorted, with the doc_id of each.
2. Each batch sends the distinct 8-byte heads of its digests to hash ranges, with a bit for heads
   that it holds more than once. A range folds what it gets into a *once-seen* and a
   *twice-seen* Bloom filter of its own (a bit set in the once-filter sets the twice-filter), then
   looks its heads up again: those with all bits in the twice-filter go back to their batch as
   suspects. There are as many ranges as keep ``RANGE_KEYS`` heads in each on average, so the
   filters have the same size and the same share of false suspects at any size of the input, and
   nothing is sent to the driver or to every executor.
3. Only suspects, as (digest, doc_id), shuffle for the exact grouping by digest. Those of two or
   more documents keep their lines in the smallest doc_id only.

Equal 128-bit BLAKE2b digests stand for equal keys.

Hot keys: a batch sends a head once however many of its documents hold it, so a line of a third
of all documents is one head for each batch in its range; the exact grouping is counted within
tasks first, and its result is joined as a plain table, so that a hot digest may be split.

Defined cases: a null or empty text is one empty line; a very long text is split whole, and its
keys go to as many batches as they fill; a null doc_id counts as one document after all others;
rows that repeat a doc_id are one document (of equal lines in it none is dropped if it is the
smallest); an empty table gives no rows. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import prepare, stored, texts, with_carry

MIN_KEY_CHARS = 10
#: Keys in a batch, and distinct heads in a range on average.
FLUSH, RANGE_KEYS = 1 << 17, 1 << 18
#: Bits of a filter for each head that a range may expect; two of them are set.
BITS_PER_KEY = 16
#: Ends that are stripped, as bytes.
SPACE = b" \t\n\x0b\x0c\r"
#: In place of a null doc_id: after all others.
LAST = (1 << 63) - 1
BATCH = "batch long, n long, digests binary, docs binary"


def key_of(line: bytes, min_chars: int = MIN_KEY_CHARS) -> bytes | None:
    """The line's key, or None if it is too short. bytes.lower() changes A-Z only."""
    key = line.strip(SPACE).lower()
    n = len(key)
    if n < min_chars or (n < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    keys = {key_of(x, min_chars) for x in text.split(b"\n")}
    keys.discard(None)
    return keys


def digest_of(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _heads(digests: bytes) -> np.ndarray:
    """The first 8 bytes of each digest as a number, in the order of the digests."""
    return np.frombuffer(digests, ">u8")[::2].astype(np.uint64)


def _batches(min_chars: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        digests: list[bytes] = []
        docs: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal at, digests, docs
            values, ids = np.array(digests, "S16"), np.array(docs, "<i8")
            order = np.argsort(values, kind="stable")
            at += 1
            # S16 drops zero bytes at the end, tobytes() puts them back
            row = {"batch": pa.array([at - 1], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "digests": pa.array([values[order].tobytes()], pa.binary()), "docs": pa.array([ids[order].tobytes()], pa.binary())}
            digests, docs = [], []
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = _keys(text.as_py(), min_chars)
                digests += map(digest_of, found)
                docs += [LAST if i is None else i] * len(found)
                while len(docs) >= flush:
                    rest = digests[flush:], docs[flush:]
                    del digests[flush:], docs[flush:]
                    yield close()
                    digests, docs = rest
        if docs:
            yield close()

    return run


def _sent(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, digests in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                heads, counts = np.unique(_heads(digests.as_py()), return_counts=True)
                to = ((heads >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(to) > 0])) if len(to) else np.zeros(0, np.int64)
                ends = [*cuts[1:].tolist(), len(to)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(to[cuts].astype(np.int64)), "batch": pa.array([name] * len(cuts), pa.int64()),
                    "heads": pa.array([heads[x:y].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary()),
                    "again": pa.array([np.packbits(counts[x:y] > 1).tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary()),
                })

    return run


def _bits(heads: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions of each head in a filter of size bits (a power of two); the heads of a range share their highest bits."""
    mixed = heads * np.uint64(0x9E3779B97F4A7C15)
    return (heads & np.uint64(size - 1)).astype(np.int64), ((mixed >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)


def _suspected(size: int):
    """Fold the blocks of each range into its two filters, then give the suspects back to their batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []

        def close() -> Iterator[pa.RecordBatch]:
            once, twice = np.zeros(size, bool), np.zeros(size, bool)
            for _, heads, again in blocks:
                a, b = _bits(heads, size)
                both = np.unique(np.concatenate([a, b]))
                twice[both[once[both]]] = True
                once[both] = True
                twice[a[again]] = True
                twice[b[again]] = True
            names, out = [], []
            for name, heads, _ in blocks:
                a, b = _bits(heads, size)
                hit = heads[twice[a] & twice[b]]
                if len(hit):
                    names.append(name)
                    out.append(hit.tobytes())
            if names:
                yield pa.RecordBatch.from_pydict({"batch": pa.array(names, pa.int64()), "heads": pa.array(out, pa.binary())})

        for batch in batches:
            for part, name, heads, again in zip(*(batch.column(k) for k in range(4)), strict=True):
                if part.as_py() != now:
                    if blocks:
                        yield from close()
                    now, blocks = part.as_py(), []
                values = np.frombuffer(heads.as_py(), np.uint64)
                blocks.append((name.as_py(), values, np.unpackbits(np.frombuffer(again.as_py(), np.uint8), count=len(values)).astype(bool)))
        if blocks:
            yield from close()

    return run


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, doc_id) of a batch's suspects."""
    for batch in batches:
        for digests, docs, parts in zip(*(batch.column(k) for k in range(3)), strict=True):
            data, ids = digests.as_py(), np.frombuffer(docs.as_py(), "<i8")
            hit = np.flatnonzero(np.isin(_heads(data), np.frombuffer(b"".join(parts.as_py()), np.uint64)))
            yield pa.RecordBatch.from_pydict({"digest": pa.array([data[16 * j:16 * j + 16] for j in hit.tolist()], pa.binary()), "doc_id": pa.array(ids[hit], pa.int64())})


def suspects(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, flush: int = FLUSH, range_keys: int = RANGE_KEYS) -> DataFrame:
    """(digest, doc_id) of all keys that pass the filters, as a stored table; docs has doc_id and text as bytes."""
    batches = stored(docs.mapInArrow(_batches(min_chars, flush), BATCH), "batches")
    total = batches.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // range_keys))
    size = 1 << max(10, min(total, range_keys) * BITS_PER_KEY - 1).bit_length()
    blocks = batches.select("batch", "digests").mapInArrow(_sent(ranges), "part long, batch long, heads binary, again binary")
    back = blocks.repartition("part").sortWithinPartitions("part").mapInArrow(_suspected(size), "batch long, heads binary")
    found = back.groupBy("batch").agg(F.collect_list("heads").alias("heads"))  # at most FLUSH heads a batch
    return stored(batches.join(found, "batch").select("digests", "docs", "heads").mapInArrow(_picked, "digest binary, doc_id long"), "suspects")


def _kept(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                lines = text.as_py().split(b"\n")
                stay = lines
                if drop:
                    drop = set(drop)
                    stay = [x for x in lines if (k := key_of(x, min_chars)) is None or digest_of(k) not in drop]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_lines": pa.array(n_lines, pa.int64()),
                "n_dropped": pa.array(n_dropped, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
                "carry": batch.column(3),
            })

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str = "cast(null as int)", min_chars: int = MIN_KEY_CHARS, flush: int = FLUSH, range_keys: int = RANGE_KEYS) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, kept (bytes of the remaining text) and carry.

    carry is an SQL expression over docs whose value travels with the row, such as a struct of all other columns.
    """
    spark = docs.sparkSession
    prepare(spark)
    found = suspects(texts(docs, id_col, text_col), min_chars, flush, range_keys)
    repeated = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    repeated = stored(repeated, "repeated")  # a plain table again, so that the join may split a hot key
    drops = found.join(repeated, "digest").filter("doc_id > first").groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set("digest").alias("drop"))
    full = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), F.expr(carry).alias("carry"))
    joined = full.join(drops.hint("shuffle_hash"), F.coalesce("doc_id", F.lit(LAST)) == F.col("drop_id"), "left").select("doc_id", "text", "drop", "carry")
    return joined.mapInArrow(_kept(min_chars), with_carry("doc_id long, n_lines long, n_dropped long, kept binary", joined))


def digest(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the remaining text, in partitions of even size: the rows are small."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")).hint("rebalance")


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same result in plain Python, for tests."""
    first: dict[bytes, int] = {}
    holders: dict[bytes, set[int]] = {}
    for i, text in rows:
        for key in _keys((text or "").encode(), MIN_KEY_CHARS):
            i2 = LAST if i is None else i
            first[key] = min(first.get(key, i2), i2)
            holders.setdefault(key, set()).add(i2)
    out = []
    for i, text in rows:
        lines = (text or "").encode().split(b"\n")
        i2 = LAST if i is None else i
        stay = [x for x in lines if (k := key_of(x)) is None or len(holders[k]) < 2 or first[k] == i2]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256(b"\n".join(stay)).hexdigest()))
    return out
