"""N-gram join, bundles, media copies and the pipeline."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodegraph.llm import common, licenses, line_dedup, media, ngram_join, quality, secrets, warc
from lodegraph.llm.common import texts


def test_groups_equal_brute_force(docs, rows):
    known = [(r[0], r[1]) for r in rows if r[0] is not None]
    got = sorted(tuple(r) for r in ngram_join.near_groups(docs.filter("doc_id is not null")).collect())
    assert got == sorted(ngram_join.brute_force(known))


@pytest.mark.parametrize("block", [2, 256])
def test_large_group_of_near_copies_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 200)]
    made = []
    for i in range(40):
        t = list(base)
        for j in rng.integers(0, 200, i % 5):
            t[j] = f"x{i}"
        made.append((i, " ".join(t)))
    made += [(100 + i, " ".join(f"y{k}" for k in rng.integers(0, 10_000, 50))) for i in range(20)]
    got = sorted(tuple(r) for r in ngram_join.near_groups(spark.createDataFrame(made, "doc_id long, text string"), block=block).collect())
    assert got == sorted(ngram_join.brute_force(made))


def test_prefixes_shorten_until_the_recall_and_no_further():
    rng = np.random.default_rng(3)
    miss = ngram_join.misses()
    target = np.log1p(-ngram_join.RECALL)
    for k in range(40):
        crowds = np.sort(rng.integers(1, 10 ** rng.integers(1, 5), (ngram_join.TREES, 5)), axis=1)[:, ::-1]
        crowds = crowds if k else np.ones_like(crowds)
        chosen = ngram_join.lengths(crowds)
        total = miss[chosen - 1].sum()
        assert total <= target + 1e-9 and chosen.min() >= ngram_join.ROOT
        # the last step was needed
        assert any(total - miss[d - 1] + miss[d] > target for d in chosen if d < ngram_join.DEEPEST)
    crowded = np.ones((ngram_join.TREES, 5), int)
    crowded[:8] = 5000, 3000, 1000, 500, 300
    chosen = ngram_join.lengths(crowded)
    assert chosen[:8].min() > chosen[8:].max()  # boilerplate: long prefixes where it is crowded


def test_labels_under_nodes():
    rng = np.random.default_rng(4)
    root = np.sort(rng.integers(0, 6, 400))
    tail = rng.integers(0, 3, 400).astype(np.int64) << 48 | rng.integers(0, 2, 400).astype(np.int64) << 32 | rng.integers(0, 2, 400).astype(np.int64) << 6
    order = np.lexsort((tail, root))
    root, tail = root[order], tail[order]
    got = ngram_join.crowds_of(root, tail)
    for d in range(ngram_join.ROOT, ngram_join.DEEPEST + 1):
        prefix = [(r, int(t) >> ngram_join.BELOW[d] if d > ngram_join.ROOT else 0) for r, t in zip(root, tail, strict=True)]
        assert got[:, d - ngram_join.ROOT].tolist() == [prefix.count(p) for p in prefix]


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_recall_at_the_threshold_beside_boilerplate(spark, monkeypatch, chunk):
    """Planted pairs at 0.80 to 0.85, a third of the texts with the same boilerplate: all links are found."""
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    common = [f"b{k}" for k in range(60)]
    made, planted = [], 0
    for i in range(150):
        own = [f"w{i}x{k}" for k in range(int(rng.integers(60, 200)))]
        text = common + own if i % 3 == 0 else own
        copy = list(text)
        for _ in range(100):
            copy[int(rng.integers(60 if i % 3 == 0 else 0, len(copy)))] = f"c{rng.integers(1 << 30)}"
            a, b = set(ngram_join.grams(" ".join(text)).tolist()), set(ngram_join.grams(" ".join(copy)).tolist())
            j = len(a & b) / len(a | b)
            if j < 0.85:
                break
        planted += 0.8 <= j < 0.85
        made += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    assert planted >= 50
    got = sorted(tuple(r) for r in ngram_join.near_groups(spark.createDataFrame(made, "doc_id long, text string").repartition(5)).collect())
    assert got == sorted(ngram_join.brute_force(made))


def test_many_texts_under_one_id(spark):
    made = [(1, " ".join(f"{i // 2}w{k}" for k in range(30)) + (" end" if i % 2 else "")) for i in range(30)] + [(1, "same words of a copy here")] * 100
    got = sorted(tuple(r) for r in ngram_join.near_groups(spark.createDataFrame(made, "doc_id long, text string").repartition(5)).collect())
    assert got == [(1, 1, 1, 0)] * 100 + [(1, 1, 1, 1)] * 30


def test_join_cases(spark, no_docs):
    assert ngram_join.near_groups(no_docs).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (7, None), (8, ""), (9, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in ngram_join.near_groups(df).collect()}
    assert got == {None: (5, 5, 0), 5: (5, 5, 0), 7: (7, 7, 0), 8: (8, 8, 0), 9: (9, 9, 0)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([0, i]), bytes([0, i + 1])) for i in range(60)] + [(bytes([9, 1]), bytes([9, 2]))], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in ngram_join.components(edges).collect()}
    assert len(got) == 63 and {v for k, v in got.items() if k[0] == 0} == {bytes([0, 0])} and got[bytes([9, 2])] == bytes([9, 1])


@pytest.mark.parametrize("n", [0, 40, 120, 300])
def test_few_edges_write_no_table_and_give_what_the_rounds_give(spark, n):
    """Each file that an executor writes starts processes, and the rounds wrote twelve tables and more for any edge."""
    ends = np.random.default_rng(n).integers(0, 150, (n, 2)).tolist()
    edges = spark.createDataFrame([(bytes([1, a]), bytes([1, b])) for a, b in ends], "a binary, b binary")
    rows = lambda df: sorted((bytes(r.node), bytes(r.root)) for r in df.collect())
    before = list(common.WRITTEN)
    got = rows(ngram_join.components(edges))
    assert common.WRITTEN == before
    assert got == rows(ngram_join.components(edges, few=-1))


# Bundles


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 200
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/ 3\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 60), (8, "u", "é" * 60), (None, "u", big), (9, "u", "z\r\n\r\nWARC/1.1" * 40)]
    return spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int"), rows


def test_bundles_round_trip(pages, spark):
    df, rows = pages
    folder, index = warc.write_bundles(df.repartition(2), frame_bytes=300, bundle_bytes=600)
    got = {r.page_id: r for r in warc.read_bundles(folder, index).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert {i: got[i].refers_to for i in got if got[i].record_type == "revisit"} == {2: 1, None: 1, 8: 7}
    assert dict(warc.fetch(folder, index, [2, 7])) == {2: rows[0][2].encode(), 7: rows[6][2].encode()}
    files, _ = warc._store(folder)
    for r in index.groupBy("bundle").agg(F.max("frame").alias("last")).collect():
        with files.open_input_file(r.bundle) as f:
            table = warc.read_seek_table(f.read())
        assert len(table) == r.last + 1
        bundle = warc.Bundle(files, r.bundle)
        assert [len(bundle.frame(k)) for k in range(len(table))] == [raw for _, raw in table]
        bundle.close()
    assert not {"frame_start", "frame_length"} & set(index.columns)  # the seek table alone says where a frame is


def test_bundles_of_no_pages(spark):
    folder, index = warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_bundles(folder, index).count() == 0


# Media


def test_edited_copies_are_found(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16)], 1) for i in range(60)] + [(60, None, 1), (61, [0.5] * 16, 1), (62, [0.5] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls int")
    got = {r.media_id: r for r in media.copies(media.pictures(df)).collect()}
    edited = [i for i in range(0, 60, 5)]
    assert np.mean([got[2 * i + 1].class_id == 2 * i for i in edited]) >= 0.9
    assert all(got[2 * i].class_id == 2 * i for i in range(60))
    assert got[120].class_id == 120 and got[124].class_id == got[124].copy_of == 122


def test_descriptors_survive_turning():
    image = media.draw(np.arange(8))
    turned = np.ascontiguousarray(np.rot90(image))
    assert media.agreeing(*media.describe(image), *media.describe(turned)) >= media.MIN_AGREE
    other = media.draw(np.arange(9))
    assert media.agreeing(*media.describe(image), *media.describe(other)) < media.MIN_AGREE


def resized(image, scale):
    return np.clip(media._resized(media._blur(image.astype(float)), scale), 0, 255).astype(np.uint8)


#: The kinds of edits, and the least share of copies that must be found.
EDITS = {
    "light": (lambda im, r: np.clip(im * 0.8 + 20, 0, 255).astype(np.uint8), 0.95),
    "crop of 10 %": (lambda im, r: im[3:-3, 3:-3], 0.95),
    "crop of 45 %": (lambda im, r: im[8:56, 8:56], 0.9),
    "quarter turn": (lambda im, r: np.rot90(im), 0.9),
    "noise": (lambda im, r: np.clip(im + r.normal(0, 3, im.shape), 0, 255).astype(np.uint8), 0.9),
}


def test_recall_by_kind_of_edit(spark):
    rng = np.random.default_rng(8)
    rows, of = [], {}
    for i in range(40):
        image = media.draw(rng.normal(size=16))
        rows.append((100 * i, image.tobytes(), image.shape[1]))
        for k, (name, (edit, _)) in enumerate(EDITS.items()):
            copy = np.ascontiguousarray(edit(image, rng))
            rows.append((100 * i + k + 1, copy.tobytes(), copy.shape[1]))
            of[100 * i + k + 1] = name
    got = {r.media_id: r.class_id for r in media.copies(spark.createDataFrame(rows, "media_id long, pixels binary, width int").repartition(4)).collect()}
    for name, (_, least) in EDITS.items():
        share = np.mean([got[m] == m // 100 * 100 for m, n in of.items() if n == name])
        assert share >= least, (name, share)
    assert all(got[100 * i] == 100 * i for i in range(40))  # different pictures stay apart


def test_links_against_all_pairs(spark):
    """Of the pairs that the verifier takes, at least nine in ten are met by the tables; no other pair is linked."""
    rng = np.random.default_rng(9)
    images = []
    for i in range(25):
        image = media.draw(rng.normal(size=16))
        images += [image, image[2:, 3:], np.clip(image * 0.9 + rng.normal(0, 2, image.shape), 0, 255).astype(np.uint8)]
    described = [media.describe(im) for im in images]
    pairs = {(a, b) for a in range(len(images)) for b in range(a) if media.agreeing(*described[b], *described[a]) >= media.MIN_AGREE}
    links = dict.fromkeys(range(len(images)), 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    df = spark.createDataFrame([(i, np.ascontiguousarray(im).tobytes(), im.shape[1]) for i, im in enumerate(images)], "media_id long, pixels binary, width int")
    got = {r.media_id: r.n_links for r in media.copies(df).collect()}
    assert sum(got.values()) >= 0.9 * sum(links.values()) and all(got[i] <= links[i] for i in links)


def test_media_malformed(spark):
    rows = [(1, bytes(range(10)), 3), (2, bytes(range(9)), 3), (3, bytes(range(9)), -3), (4, bytes(5), None), (None, bytes(range(9)), 3), (5, bytes(40_000), 20_000)]
    got = [(r.media_id, r.class_id, r.n_links) for r in media.copies(spark.createDataFrame(rows, "media_id long, pixels binary, width int")).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (None, 2, 0), (5, 5, 0)], key=str)


def test_media_cases(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert media.copies(media.pictures(none)).count() == 0
    flat = spark.createDataFrame([(1, bytes(4096), 64), (2, None, None), (3, b"", 0)], "media_id long, pixels binary, width int")
    assert sorted((r.media_id, r.class_id) for r in media.copies(flat).collect()) == [(1, 1), (2, 2), (3, 3)]


# The pipeline


def test_stages_equal_brute_force(spark):
    """Each stage on the smallest tables against plain Python on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, sf).cache()
    assert kept.columns == docs.columns
    stats = {r.doc_id: quality.statistics((r.text or "").encode()) for r in docs.collect()}
    forest = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {i for i, s in stats.items() if not quality.base_failed(s[0], s[4]) and (forest is None or forest.score(np.array([s[5]]))[0] >= quality.THRESHOLD)}
    assert {r.doc_id for r in kept.collect()} == want

    deduped = corpus_pipeline.dedup_lines(spark, kept, sf).cache()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    brute = {i: h for i, _, _, h in line_dedup.brute_force(rows)}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in deduped.collect()} == brute and deduped.columns == docs.columns

    unique = corpus_pipeline.near_duplicates(spark, deduped, sf).cache()
    groups = ngram_join.brute_force([(r.doc_id, r.text) for r in deduped.collect()])
    assert {r.doc_id for r in unique.collect()} == {i for i, c, _, _ in groups if i == c}

    clean = corpus_pipeline.redact_secrets(spark, unique, sf).cache()
    before = {r.doc_id: r.text for r in unique.collect()}
    for r in clean.collect():
        out, at = "", 0
        for a, _, b in secrets.brute_force(before[r.doc_id]):
            if a >= at:
                out += before[r.doc_id][at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == out + before[r.doc_id][at:] and r.n_chars == len(r.text)

    packed = corpus_pipeline.pack_windows(spark, clean, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}


def test_pipeline_with_awkward_rows(spark, docs, no_docs, tmp_path):
    sf = "/root/testdata/sf0.001"
    for frame in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf)
            assert out.columns == frame.columns
            frame = out
        corpus_pipeline.STAGES[-1][1](spark, frame, sf).count()
    assert texts(no_docs).count() == 0 and licenses.TEMPLATES


def test_near_duplicates_counts_rows_and_not_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(20))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (3, text("c")), (3, text("d")), (None, text("e")), (None, text("f")), (None, text("a")), (4, text("c")), (4, text("g")), (None, None), (None, None)]
    want = sorted([(1, text("a")), (1, text("b")), (3, text("c")), (3, text("d")), (None, text("e")), (None, text("f")), (4, text("g")), (None, None), (None, None)], key=str)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = corpus_pipeline.near_duplicates(spark, frame, "")
    assert sorted(map(tuple, out.collect()), key=str) == want and out.columns == frame.columns
    unique = spark.createDataFrame([(1, text("a")), (None, text("a")), (None, text("b"))], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, unique, "").collect()), key=str) == sorted([(1, text("a")), (None, text("b"))], key=str)


def test_ranked_keys(spark):
    ids = [None, 0, -1, 1, 5, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(i, bytes([k] * 16)) for k, i in enumerate(ids)], "rep long, cls binary").select("rep", "cls", ngram_join.ranked(F.col("rep"), F.col("cls")).alias("key"))
    got = df.select("rep", "cls", "key", ngram_join.rep_of(F.col("key")).alias("r"), ngram_join.cls_of(F.col("key")).alias("c")).collect()
    assert all(r.rep == r.r and r.cls == r.c for r in got)
    assert [r.rep for r in sorted(got, key=lambda r: bytes(r.key))] == [*sorted(i for i in ids if i is not None), None]
