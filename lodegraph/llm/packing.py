"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Each task tokenises its documents and packs them in groups of ``GROUP_TOKENS`` tokens; no row
is shuffled and no group grows with the input. Within a group every document is first cut
into pieces of at most ``PIECE`` tokens. The differencing starts from one partial partition
for each piece and always merges the two partial partitions of largest spread, the fullest
bin of one with the emptiest of the other, until one is left. If its largest bin exceeds the
window, the window count rises and the differencing runs anew.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each for
itself; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodegraph.llm.common import prepare, texts

WINDOW = 4096
PIECE = 512
#: Tokens that are packed together: some 256 windows.
GROUP_TOKENS = 1 << 20
#: Words whose ids are remembered in a task.
MEMO = 600_000
END_ID = np.array([2], "<u4").tobytes()

# The tokenizer's split, written for Latin-1 text. Letters, then numbers, then
# the white space that belongs to no token.
LETTERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = r"\t-\r \x85\xa0"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


class WordTokenizer(dict):
    """Ids of a lower-casing word BPE, as little-endian unsigned 32-bit bytes, with a memo of words.

    Latin-1 texts without markers of special tokens are split here, and each new word goes to
    the tokenizer's model once; all other texts go to the tokenizer whole. Both ways give equal ids. A
    worker keeps one tokenizer for all its tasks.
    """

    kept: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: A Latin-1 character's bytes as the model's characters.
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def encoded(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        return self.setdefault(word, np.array([t.id for t in self.model.tokenize(word.translate(self.letters))], "<u4").tobytes())

    def ids(self, text: str) -> bytes:
        if "<|" in text:
            return self.encoded(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.encoded(text)
        return b"".join(map(self.__getitem__, SPLIT.findall(text.lower())))


def differencing(sizes: np.ndarray, bins: int) -> list[list[int]]:
    """Multiway Karmarkar-Karp: indices of sizes in each of the bins, fullest first.

    A partial partition is a vector of loads, ascending, less its smallest, with a node of the
    merge tree for each bin. Only non-zero loads are stored: they stand at the end.
    """
    if not len(sizes):
        return [[] for _ in range(bins)]
    children: list[tuple[int, int]] = []
    leaves = len(sizes)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size, i, np.array([size], np.int64), np.array([i], np.int64)))
    heapq.heapify(heap)
    at = leaves
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        if len(a) + len(b) <= bins:  # opposing ends never meet: every bin stays as it is
            loads, nodes = np.concatenate([a, b]), np.concatenate([a_nodes, b_nodes])
        else:
            loads, nodes = np.zeros(bins, np.int64), np.full(bins, -1, np.int64)
            loads[bins - len(a):] = a
            nodes[bins - len(a):] = a_nodes
            other = np.full(bins, -1, np.int64)
            other[: len(b)] = b_nodes[::-1]
            loads[: len(b)] += b[::-1]
            both = np.flatnonzero((nodes >= 0) & (other >= 0))
            children.extend(zip(nodes[both].tolist(), other[both].tolist(), strict=True))
            nodes = np.maximum(nodes, other)
            nodes[both] = leaves + len(children) - len(both) + np.arange(len(both))
        order = np.argsort(loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        if len(loads) == bins:
            loads = loads - loads[0]
            keep = nodes >= 0
            loads, nodes = loads[keep], nodes[keep]
        heapq.heappush(heap, (-int(loads[-1]), at, loads, nodes))
        at += 1
    out = []
    for node in heap[0][3][::-1].tolist():
        items, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < leaves:
                items.append(x)
            else:
                todo.extend(children[x - leaves])
        out.append(items)
    return out + [[] for _ in range(bins - len(out))]


def pack(sizes: np.ndarray, window: int = WINDOW) -> list[list[int]]:
    """Near-equal windows: the fewest for which the differencing keeps within the window."""
    total = int(sizes.sum())
    bins = max(1, -(-total // window))
    while True:
        out = differencing(sizes, bins)
        most = max(int(sizes[x].sum()) if x else 0 for x in out)
        if most <= window:
            return [x for x in out if x]
        bins += max(1, (most - window) * bins // (4 * window))


def cut(n: int, window: int, piece: int) -> list[int]:
    """Lengths of a document's pieces: whole windows, then pieces of at most piece tokens."""
    out = [window] * (n // window)
    rest = n % window
    if rest:
        parts = -(-rest // piece)
        out += [rest * (i + 1) // parts - rest * i // parts for i in range(parts)]
    return out


def _packed(path: str, window: int, piece: int, group_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = WordTokenizer.of(path)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []  # doc_id, start, length, crc, doc_tokens
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal sequence, rows, held
            lengths = np.array([x[2] for x in rows], np.int64)
            place = [(0, 0)] * len(rows)
            small = np.flatnonzero(lengths < window)
            for j in np.flatnonzero(lengths == window).tolist():
                place[j] = (sequence, 0)
                sequence += 1
            for items in pack(lengths[small], window) if len(small) else []:
                at = 0
                for j in sorted(small[items].tolist()):
                    place[j] = (sequence, at)
                    at += int(lengths[j])
                sequence += 1
            columns = [*zip(*rows, strict=True), *zip(*place, strict=True)]
            rows, held = [], 0
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(tokenizer.ids(text.as_py().decode("utf-8", "replace")) + END_ID, "<u4")
                start = 0
                for n in cut(len(ids), window, piece):
                    rows.append((i, start, n, zlib.crc32(ids[start:start + n]), len(ids)))
                    start += n
                held += len(ids)
                if held >= group_tokens:
                    yield close()
        if rows:
            yield close()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece: int = PIECE, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    prepare(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_packed(tokenizer_path, window, piece, group_tokens), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
