"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

1. Every text becomes a set of hashed word n-grams (a text of fewer words: one n-gram of them
   all). Texts with equal sets form a *class*; from here on each class counts once.
2. The forest has ``TREES`` prefix tries. A class's label in a trie is ``DEEPEST`` MinHash values:
   the first ``ROOT`` as one number, the root of a subtrie, the others side by side in a second
   one, so that sorting labels makes the prefix trie: labels under a node stand together. Labels
   are sorted over the cluster by range, with the class as the last key, so that neither a crowded
   root nor equal labels land in one task. One walk over each sorted part takes the number of
   labels under every node; labels that are alone in their root's subtrie match nothing and go.
3. Each class starts from its longest prefixes and shortens them one value at a time until a pair
   at the threshold shares a prefix in some trie with the chance ``RECALL``: the chance of a miss
   is the product of (1 - threshold**length) over the tries. The step to the least crowded node
   comes first (nodes below ``CROWD`` labels count as equal, so that a single partner does not
   steer the choice), the longest prefix first among equals. Where boilerplate crowds some tries a
   class keeps long prefixes there and takes shorter ones in the others.
4. Under a root the shortest length chosen by any label is taken for all, which only adds
   candidates: labels with an equal prefix of that length share a node. Nodes with the same classes
   are kept once, nodes are cut into blocks of about ``BLOCK`` classes or ``BLOCK_GRAMS`` n-grams,
   and each pair of blocks is a group of rows of its own, so that no group grows with the input.
   A pair counts in the first trie whose node it shares, so it counts once. Pairs within a group
   are compared by vectors and never become rows: a group returns a number of links for each class
   and a spanning forest.
5. Groups of linked classes are the connected components of those forests: up to ``FEW_EDGES``
   edges, which are counted, meet in the driver; more go by large-star and small-star rounds,
   written to the shared folder after each, with the same result.

Defined cases: texts that are null or hold no word are their own group with no link; a very long
text is one set of all its n-grams; rows that repeat a doc_id are rows of their own, whatever
their texts; a null doc_id is a member like any other and the last choice for a class id; of
equal texts the smallest doc_id stands for all; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import drop, prepare, stored

WORDS, THRESHOLD = 5, 0.8
TREES, ROOT, DEEPEST, RECALL = 24, 3, 7, 0.99999
#: Labels under a node up to which it is not crowded.
CROWD = 64
BLOCK, BLOCK_GRAMS = 256, 1 << 22
#: Sorted labels that a task looks at together.
CHUNK = 1 << 18
#: Classes of many rows that may go to every executor: rows of the table over this is what makes a class large.
LARGE_CLASSES, LARGE_LEAST = 10_000, 64
SEED = 20240229
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The bits of a tail below the prefix of each length. The lowest six hold the size of the set, as a power of two.
BELOW = {4: 48, 5: 32, 6: 16, 7: 6}
#: Edges up to which the components are found in the driver: about 50 bytes each. A round writes three tables, and each file starts processes of its own.
FEW_EDGES = 50_000
#: Most rounds of the components; each at least halves what is left.
ROUNDS = 40


def misses(threshold: float = THRESHOLD) -> np.ndarray:
    """By length of a prefix, the logarithm of the chance that a pair at the threshold does not share it."""
    return np.log1p(-(threshold ** np.arange(DEEPEST + 1.0))[1:]) if threshold < 1 else np.full(DEEPEST, -np.inf)


def lengths(crowds: np.ndarray, threshold: float = THRESHOLD, recall: float = RECALL) -> np.ndarray:
    """The prefix length of a class in each trie. crowds: for each trie, the labels under its nodes of ROOT to DEEPEST values."""
    miss = misses(threshold)
    out = np.full(len(crowds), DEEPEST)
    left = miss[DEEPEST - 1] * len(crowds) - np.log1p(-recall)  # above 0: the target is not met
    cost = np.maximum(crowds, CROWD)
    steps = [(int(cost[t, -2]), 1 - DEEPEST, t) for t in range(len(crowds))]
    heapq.heapify(steps)
    while left > 0 and steps:
        _, less, t = heapq.heappop(steps)
        left += miss[-less - 1] - miss[-less]
        out[t] = -less
        if -less > ROOT:
            heapq.heappush(steps, (int(cost[t, -less - 1 - ROOT]), less + 1, t))
    return out


def grams(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's lower-case word n-grams."""
    each = text.lower().split()
    if not each:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        out = (out ^ h[i : i + n]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def class_id(g: np.ndarray) -> bytes | None:
    return hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None


def labels(sets: list[np.ndarray], trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set and each trie, the root and the tail of its label. The lowest five bits of a root name the trie."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 31, (trees, DEEPEST), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, (trees, DEEPEST), dtype=np.uint32)
    sizes = np.array([len(s) for s in sets])
    flat = (np.concatenate(sets) >> np.uint64(17)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    root, tail = np.zeros((len(sets), trees), np.uint64), np.zeros((len(sets), trees), np.uint64)
    work = np.empty_like(flat)
    for t in range(trees):
        for d in range(DEEPEST):
            np.multiply(flat, a[t, d], out=work)
            work += b[t, d]
            least = np.minimum.reduceat(work, starts).astype(np.uint64)
            if d < ROOT:
                root[:, t] = (root[:, t] ^ (least + np.uint64(1))) * MIX
                root[:, t] ^= root[:, t] >> np.uint64(31)
            else:
                width = 16 if d < DEEPEST - 1 else 10
                tail[:, t] = (tail[:, t] << np.uint64(width)) | (((least + np.uint64(1)) * MIX) >> np.uint64(64 - width))
        root[:, t] = (root[:, t] << np.uint64(5)) | np.uint64(t)
    weight = np.ceil(np.log2(sizes)).astype(np.uint64)
    return root.view(np.int64), ((tail << np.uint64(6)) | weight[:, None]).view(np.int64)


def _signed(words: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t.as_py() or "", words) for t in batch.column(1)]
            full = [i for i, s in enumerate(sets) if len(s)]
            roots: list = [None] * len(sets)
            tails: list = [None] * len(sets)
            for at in range(0, len(full), 64):
                part = full[at : at + 64]
                for i, root, tail in zip(part, *labels([sets[i] for i in part], trees), strict=True):
                    roots[i], tails[i] = root, tail
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "text_hash": batch.column(2), "cls": pa.array([class_id(s) for s in sets], pa.binary()),
                "roots": pa.array(roots, pa.list_(pa.int64())), "tails": pa.array(tails, pa.list_(pa.int64())),
            })

    return run


def crowds_of(root: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """For sorted labels, how many there are under each one's nodes of ROOT to DEEPEST values."""
    out = np.zeros((len(root), DEEPEST - ROOT + 1), np.int64)
    new = np.concatenate([[True], root[1:] != root[:-1]])
    for depth in range(ROOT, DEEPEST + 1):
        if depth > ROOT:
            part = tail.view(np.uint64) >> np.uint64(BELOW[depth])
            new = new | np.concatenate([[True], part[1:] != part[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(root)]]))
        out[:, depth - ROOT] = np.repeat(size, size)
    return out


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk sorted labels: those that are not alone under their root, with the crowds of their nodes as powers of two.

    A subtrie that touches an end of what is looked at may go on beyond it: all its labels stay,
    and their crowds are at least those seen here.
    """

    def walked(table: pa.Table, open_end: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        root = table.column(0).to_numpy()
        cut = int(np.searchsorted(root, root[-1])) if open_end else len(root)
        cut = cut or len(root)  # one subtrie fills it all: its labels go on as they are
        root, tail = root[:cut], table.column(1).to_numpy()[:cut]
        crowd = crowds_of(root, tail)
        stay = np.flatnonzero((crowd[:, 0] > 1) | (root == root[0]) | (root == root[-1]))
        powers = np.ceil(np.log2(crowd[stay])).astype(np.int64)
        packed = (powers << (6 * np.arange(crowd.shape[1]))).sum(axis=1)
        out = table.slice(0, cut).take(pa.array(stay)).append_column("crowd", pa.array(packed, pa.int64()))
        return out, table.slice(cut)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            out, rest = walked(pa.Table.from_batches(held).combine_chunks(), True)
            yield from out.to_batches(max_chunksize=CHUNK)
            held, n = rest.combine_chunks().to_batches(), rest.num_rows
    if n:
        out, _ = walked(pa.Table.from_batches(held).combine_chunks(), False)
        yield from out.to_batches(max_chunksize=CHUNK)


def _shortened(trees: int, threshold: float, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        shifts = 6 * np.arange(DEEPEST - ROOT + 1)
        for batch in batches:
            kinds, roots, tails, depths = [], [], [], []
            for cls, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                root, tail, packed = (found.values.field(k).to_numpy() for k in range(3))
                powers = (packed[:, None] >> shifts) & 63
                tree = root & 31
                full = np.zeros((trees, len(shifts)), np.int64)
                full[tree] = np.maximum(powers, int(CROWD).bit_length() - 1)
                key = full.tobytes()  # few shapes: most classes are not crowded anywhere
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[key] = lengths(np.int64(1) << full, threshold, recall)
                kinds += [cls] * len(root)
                roots.append(root)
                tails.append(tail)
                depths.append(known[key][tree])
            if kinds:
                yield pa.RecordBatch.from_pydict({"cls": pa.array(kinds, pa.binary()), "root": pa.array(np.concatenate(roots)), "tail": pa.array(np.concatenate(tails)), "depth": pa.array(np.concatenate(depths).astype(np.int32))})

    return run


def forest_nodes(classes: DataFrame, trees: int = TREES, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(tree, node, cls, weight) of all labels that may share a node, from classes (cls, roots, tails); weight is the size of the set, rounded up to a power of two."""
    each = classes.select("cls", F.explode(F.arrays_zip("roots", "tails")).alias("l")).select(F.col("l.roots").alias("root"), F.col("l.tails").alias("tail"), "cls")
    in_order = each.repartitionByRange("root", "tail", "cls").sortWithinPartitions("root", "tail")
    near = in_order.mapInArrow(_tries, "root long, tail long, cls binary, crowd long")
    by_class = near.groupBy("cls").agg(F.collect_list(F.struct("root", "tail", "crowd")).alias("found"))  # a label for each trie at most
    chosen = stored(by_class.mapInArrow(_shortened(trees, threshold, recall), "cls binary, root long, tail long, depth int"), "prefixes")
    least = stored(chosen.groupBy("root").agg(F.min("depth").alias("depth"), F.count("*").alias("n")).filter("n > 1").select("root", "depth"), "least")
    part = F.expr("case depth " + " ".join(f"when {k} then shiftrightunsigned(tail, {v})" for k, v in BELOW.items()) + " else 0L end")
    return chosen.drop("depth").join(least, "root").select((F.col("root").bitwiseAND(31)).cast("int").alias("tree"), F.xxhash64("root", "depth", part).alias("node"), "cls", F.expr("shiftleft(1L, cast(tail & 63 as int))").alias("weight"))


def _payload(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t.as_py() or "", words) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"cls": pa.array([class_id(s) for s in sets], pa.binary()), "grams": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def pair_links(sets: list[np.ndarray], nodes: np.ndarray, tree: int, left: np.ndarray, two: bool, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each member of a group, and a spanning forest of them.

    two: pairs are between members that left marks and the others; else all pairs count.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    vocabulary, codes = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(len(vocabulary), np.int32)
    counts = np.zeros(n, np.int64)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i in range(n):
        if two and not left[i]:
            continue
        later = ~left if two else np.arange(n) > i
        ok = later & (np.minimum(sizes, sizes[i]) >= threshold * np.maximum(sizes, sizes[i]))
        if tree:
            ok &= ~(nodes[:, :tree] == nodes[i, :tree]).any(axis=1)
        if not ok.any():
            continue
        mine = codes[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[codes], starts)
        mark[mine] = 0
        hit = np.flatnonzero(ok & (shared >= threshold * (sizes + sizes[i] - shared) - 1e-9))
        counts[i] += len(hit)
        counts[hit] += 1
        for j in hit.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((i, j))
    return counts, edges


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            nodes = np.array([r[4] for r in rows])
            counts, edges = pair_links(sets, nodes, key[0], np.array([r[2] for r in rows], bool), key[2] != key[3], threshold)
            have = np.flatnonzero(counts)
            if len(have):
                a = [rows[i][1] for i in have] + [rows[i][1] for i, _ in edges]
                b = [None] * len(have) + [rows[j][1] for _, j in edges]
                links = counts[have].tolist() + [0] * len(edges)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "links": pa.array(links, pa.int64())})

        for batch in batches:
            for tree, node, i, j, key_of, side, gram_bytes, nodes in zip(*(batch.column(k) for k in range(8)), strict=True):
                now = (tree.as_py(), node.as_py(), i.as_py(), j.as_py())
                if now != key:
                    yield from close()
                    key, rows = now, []
                rows.append((None, key_of.as_py(), side.as_py(), gram_bytes.as_py(), nodes.values.to_numpy()))
        yield from close()

    return run


def ranked(rep: Column, cls: Column) -> Column:
    """A class's key in byte order of its smallest id, none last: the smallest key of a group names the group's smallest id."""
    order = F.unhex(F.lpad(F.hex(F.coalesce(rep, F.lit(0)).bitwiseXOR(F.lit("-9223372036854775808").cast("long"))), 16, "0"))
    return F.concat(F.when(rep.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), order, cls)


def rep_of(key: Column) -> Column:
    number = F.conv(F.hex(F.substring(key, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", number.cast("long"))


def cls_of(key: Column) -> Column:
    return F.substring(key, 10, 16)


def _united(edges: pa.Table) -> pa.Table:
    """(node, root) of the components of edges (hi, lo)."""
    hi, lo = edges["hi"].to_pylist(), edges["lo"].to_pylist()
    up = {x: x for x in (*hi, *lo)}

    def top(x: bytes) -> bytes:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(hi, lo, strict=True):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return pa.table({"node": pa.array(list(up), pa.binary()), "root": pa.array([top(x) for x in up], pa.binary())})


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b): root is the smallest node of the component."""
    edges = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo")
    if edges.count() <= few:
        return edges.sparkSession.createDataFrame(_united(edges.toArrow()), "node binary, root binary")
    pairs = stored(edges.distinct(), "edges")
    for _ in range(ROUNDS):
        # large star: every larger neighbour of a node points at the smallest of its neighbourhood
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        stars = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = both.filter("v > u").join(stars, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stored(large, "large-star")
        drop(stars)
        # small star: every smaller neighbour, and the node, point at the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("x"), "m"), F.struct(F.col("hi").alias("x"), "m"))).alias("s")).select(F.col("s.x").alias("hi"), F.col("s.m").alias("lo")).filter("hi <> lo").distinct()
        small = stored(small, "small-star")
        drop(large)
        state = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        settled = state(small) == state(pairs)
        drop(pairs)
        pairs = small
        if settled:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = small.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def shared_nodes(entries: DataFrame, block: int = BLOCK, block_weight: int = BLOCK_GRAMS) -> DataFrame:
    """Who shares which node, dealt to block pairs: (tree, node, i, j, cls, side) of entries (tree, node, cls, weight).

    Nodes of one class go, nodes with equal members are kept once (as the first of them), and a
    node is cut into as many blocks as keep about block classes, and block_weight in all, in each.
    """
    held = entries.groupBy("tree", "node").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")).filter("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.least(F.ceil(F.col("w") / block_weight), F.col("n"))).cast("int")
    nodes = held.groupBy("n", "x", "y", blocks.alias("blocks")).agg(F.min(F.struct("tree", "node")).alias("first")).select(F.col("first.tree").alias("tree"), F.col("first.node").alias("node"), "blocks")
    members = stored(entries.join(nodes, ["tree", "node"]).select("tree", "node", "cls", "blocks"), "members")
    own = F.pmod(F.xxhash64("cls", F.lit(2)), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("tree", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", (F.col("own") <= F.col("other")).alias("side"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, copy_of, n_links.

    class_id is the smallest doc_id of the linked group, copy_of that of the rows with the same
    n-grams, and n_links the number of other n-gram sets at the threshold or above.
    """
    if not 1 <= trees <= 32:
        raise ValueError("a forest has 1 to 32 tries")
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = stored(base.mapInArrow(_signed(words, trees), "doc_id long, text_hash long, cls binary, roots array<long>, tails array<long>"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = signed.filter("cls is not null").groupBy("cls").agg(first.alias("first"), F.count("*").alias("rows"), F.first("roots").alias("roots"), F.first("tails").alias("tails"))
    classes = stored(classes.select("cls", "first.doc_id", "first.text_hash", "rows", "roots", "tails").withColumnRenamed("doc_id", "rep"), "classes")
    entries = stored(forest_nodes(classes, trees, threshold, recall), "labels")
    dealt = shared_nodes(entries, block)

    # the n-grams of the classes that share a node, from a text of theirs; a row is known by its id and its text's hash
    shared = stored(classes.join(dealt.select("cls").distinct(), "cls", "left_semi").select("cls", "rep", "text_hash"), "shared")
    wanted = shared.select("rep", F.col("text_hash").alias("rep_hash"))
    chosen = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("text")
    payload = chosen.mapInArrow(_payload(words), "cls binary, grams binary").filter("cls is not null").dropDuplicates(["cls"])
    place = entries.join(shared.select("cls", "rep"), "cls").groupBy("cls").agg(F.max("rep").alias("rep"), F.map_from_entries(F.collect_list(F.struct("tree", "node"))).alias("at"))  # a node for each trie at most
    nodes = F.array(*(F.coalesce(F.try_element_at("at", F.lit(t)), F.xxhash64("cls", F.lit(t))) for t in range(trees)))  # none: a number of its own
    payload = payload.join(place.select("cls", ranked(F.col("rep"), F.col("cls")).alias("key"), nodes.alias("nodes")), "cls")

    rows = dealt.join(payload, "cls").select("tree", "node", "i", "j", "key", "side", "grams", "nodes")
    keys = ["tree", "node", "i", "j"]
    found = stored(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verified(threshold), "a binary, b binary, links long"), "links")

    known = classes.select("cls", "rep", "rows").join(linked(found), "cls", "left")
    known = known.select("cls", "rows", F.col("rep").alias("copy_of"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return told(signed.select("doc_id", "cls"), stored(known, "known"))


def linked(found: DataFrame) -> DataFrame:
    """(cls, class_id, n_links) of linked classes, from numbers of links (a, links) and edges (a, b) of ranked keys.

    The root of a component is its smallest key and names the class id, so that no row of a large
    group need meet its root in a join.
    """
    links = found.filter("b is null").groupBy(cls_of(F.col("a")).alias("cls")).agg(F.sum("links").alias("n_links"))
    roots = components(found.filter("b is not null").select("a", "b"))
    return roots.select(cls_of(F.col("node")).alias("cls"), rep_of(F.col("root")).alias("class_id")).join(links, "cls", "left")


def told(signed: DataFrame, known: DataFrame) -> DataFrame:
    """Each row with what is known of its class. Classes of many rows go to the rows, so that no task gets all rows of one."""
    total = signed.count()
    most = max(LARGE_LEAST, -(-total // LARGE_CLASSES))
    large = known.filter(F.col("rows") >= most).drop("rows")  # LARGE_CLASSES rows at most, as they hold that many rows each
    lone = F.struct(F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    seen = signed.join(F.broadcast(large.select(F.col("cls").alias("big"), F.struct("copy_of", "class_id", "n_links").alias("big_k"))), F.col("cls") == F.col("big"), "left")
    told = seen.filter("cls is null or big is not null").select("doc_id", F.when(F.col("cls").isNull(), lone).otherwise(F.col("big_k")).alias("k"))
    others = seen.filter("cls is not null and big is null").select("doc_id", "cls").join(known.filter(F.col("rows") < most).select("cls", F.struct("copy_of", "class_id", "n_links").alias("k")), "cls")
    return told.union(others.select("doc_id", "k")).select("doc_id", "k.class_id", "k.copy_of", F.col("k.n_links").cast("long").alias("n_links"))


def brute_force(rows: list[tuple[int, str | None]], words: int = WORDS, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """The same rows by comparing all pairs, for tests."""
    sets: dict[bytes, set] = {}
    of: list[tuple[int, bytes | None]] = []
    for i, text in rows:
        g = grams(text or "", words)
        of.append((i, class_id(g)))
        if len(g):
            sets[class_id(g)] = set(g.tolist())
    keys = list(sets)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(keys, 0)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    rep: dict = {}
    group: dict = {}
    for i, k in of:
        if k:
            rep[k] = min(rep.get(k, i), i)
            group[root(k)] = min(group.get(root(k), i), i)
    return [(i, group[root(k)], rep[k], links[k]) if k else (i, i, i, 0) for i, k in of]
