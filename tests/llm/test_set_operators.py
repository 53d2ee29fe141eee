"""Fingerprints, search, packing, media, fixity and quality against brute force."""

import bisect
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from dyadflow.llm import avi, packing, quality, simhash, topk, warc
from dyadflow.llm.components import components

SF = "/root/testdata/sf0.001"
ODD = [(-1, None), (-2, ""), (-3, "one"), (-4, "One "), (-5, " \t"), (-6, "a b"), (-7, "é É x y <|endoftext|>  z"), (-7, "a b")]


def documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs.union(spark.createDataFrame(ODD, "doc_id long, text string"))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark):
    docs = documents(spark)
    prints, first = {}, {}
    for r in docs.collect():
        words = (r.text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        prints.setdefault(r.doc_id, []).append(fp)
        first[fp] = min(first.get(fp, r.doc_id), r.doc_id)
    root = roots(sorted(first), lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for fp, doc in first.items():
        low[root[fp]] = min(low.get(root[fp], doc), doc)
    rows = simhash.report(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        fp = int(r.fingerprint, 16)
        assert fp in prints[r.doc_id] and r.component_id == low[root[fp]]


@pytest.mark.parametrize("hot_key", [0, 3, 48])
def test_links_connect_all_close_pairs(spark, hot_key):
    rng = random.Random(5)
    found = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            found.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    found = {signed(f) for f in found}
    mask = (1 << 64) - 1
    want = roots(sorted(found), lambda a, b: ((a ^ b) & mask).bit_count() <= 2)
    classes = spark.createDataFrame([(f,) for f in found], "fp long")
    got = {r.id: r.root for r in components(simhash.links(classes, hot_key)).collect()}
    assert {f: got.get(f, f) for f in found} == want


def test_distinct_documents(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(500)}" for _ in range(300)] for _ in range(12)]
    rows = []
    for n, words in enumerate(base):
        rows += [(10 * n, " ".join(words)), (10 * n + 1, " ".join(words)), (10 * n + 2, " ".join([*words[:150], "new", *words[151:]]))]
    rows += [(500, ""), (501, None), (502, " \t"), (503, "x"), (504, "y"), (0, " ".join(base[0])), (None, "z z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(7))
    kept = simhash.distinct_documents(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # null and empty are one text
    assert ids == sorted([(False, 10 * n) for n in range(12)] + [(False, i) for i in (500, 502, 503, 504)] + [(True, 0)])
    assert simhash.distinct_documents(df.limit(0)).count() == 0


def test_distinct_documents_in_families(spark):
    """Related texts that share a common part: all pairs at 0.8 and more, and no others, are copies."""
    rng = random.Random(11)
    rows, word = [], lambda: f"w{rng.randrange(10**9)}"
    for family, own in ((0, 40), (1, 30)):
        common = [word() for _ in range(200 - own)]
        for n in range(150):
            text = common + [word() for _ in range(own)]
            rows.append((1000 * family + n, " ".join(text)))
            if n < 20:  # a copy with words added, in the whole between 0.8 and 0.87
                more = [word() for _ in range(30 + n % 20)]
                rows.append((1000 * family + 500 + n, " ".join(text + more)))
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}

    def copies(a, b):
        shared = len(sets[a] & sets[b])
        return 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared)

    want = set(roots(sorted(sets), copies).values())
    assert 300 <= len(want) < 340
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.distinct_documents(df).collect()} == want


def test_pairs_that_fall_short_are_not_named(spark, monkeypatch):
    """A group just below 0.8 whose members share rare shingles: few pairs beyond the links are named."""
    rng = random.Random(17)
    common = [f"c{rng.randrange(10**9)}" for _ in range(150)]
    rows = []
    for n in range(120):
        text = list(common)
        for at in rng.sample(range(15), 4):  # few places and words, so that members share what is rare
            text[10 * at + 2] = f"e{rng.randrange(2)}"
        rows.append((n, " ".join(text)))
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}

    def copies(a, b):
        shared = len(sets[a] & sets[b])
        return 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared)

    within = sum(copies(a, b) for a in sets for b in sets if a < b)
    assert within < 120 * 119 / 2 / 4
    named, written = [], simhash.stage

    def counted(df, name, *more):
        out = written(df, name, *more)
        if name == "exact_pairs":
            named.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stage", counted)
    monkeypatch.setattr(simhash, "candidates", lambda classes, numbers: classes.selectExpr("id a", "id b").limit(0))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(roots(sorted(sets), copies).values())
    assert {r.doc_id for r in simhash.distinct_documents(df).collect()} == want
    assert within <= named[0] < 2 * within


def test_prefix_join_needs_no_early_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "candidates", lambda classes, numbers: classes.selectExpr("id a", "id b").limit(0))
    test_distinct_documents_in_families(spark)
    test_distinct_documents(spark)


def test_repeated_lines_do_not_outweigh_texts(spark):
    rng = random.Random(13)
    line = " ".join(f"junk{n}" for n in range(12))
    rows = []
    for n in range(12):
        body = " ".join(f"w{rng.randrange(10**9)}" for _ in range(600))
        rows.append((n, f"{body} " + " ".join([line] * 60)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.distinct_documents(df).collect()) == list(range(12))


def brute_top(rows, every, k):
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = [np.floor(np.asarray(v, float) * 256).astype(np.int64) for _, v in rows]
    out = []
    for a, (i, _) in enumerate(rows):
        if i is None or i % every:
            continue
        scores = []
        for b, (j, _) in enumerate(rows):
            n = min(len(q[a]), len(q[b]))
            if a != b:
                scores.append((-int(q[a][:n] @ q[b][:n]), j is None, j or 0, j))
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    rows = [(int(i) % 30, [float(x) for x in rng.integers(-2, 3, int(rng.integers(0, 7))) / 256]) for i in range(120)]
    rows += [(None, [1.0, 2.0]), (50, None), (0, [float("nan")]), (50, [1.0, None]), (100, [1e6, -1e6])] + [(100, [0.5] * 3)] * 20
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.report(df).collect()), key=lambda r: tuple((x is None, x or 0) for x in r))
    assert got == brute_top(rows, 50, 5)
    assert topk.report(df.limit(0)).collect() == []


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = documents(spark).union(spark.createDataFrame([(-9, "the " * 4094), (-10, "a  b\n\n c\t")], "doc_id long, text string"))
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(coder.encode(r.text or "", add_special_tokens=False).ids + [0])
    for r in rows:
        crcs = [zlib.crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) for t in texts[r.doc_id]]
        assert r.ids_crc32 in crcs
    total = sum(len(t) for own in texts.values() for t in own)
    assert sum(r.length for r in rows) == total
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    assert len(places) <= -(-total // 2048) + 1
    assert sorted(r.length for r in rows if r.doc_id == -9) == [2048, 2048]
    assert packing.pack(docs.limit(0)).count() == 0


def one_by_one(lengths, capacity):
    """Sequences that best-fit decreasing needs, piece by piece."""
    free = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, n)
        gap = free.pop(at) if at < len(free) else capacity
        bisect.insort(free, gap - n)
    return len(free)


def test_successor_sweep(spark):
    rng = random.Random(3)
    for turn in range(4):
        docs = [(0, i, 0, rng.randint(1, 30), 0) for i in range(40)]
        slots = [(1, i, 1, rng.randint(1, 40), 0) for i in range(25 + 10 * turn)]
        line = spark.createDataFrame(docs + slots, "kind int, item long, turn int, size long, free long")
        # the longest pieces that can all be served, then the smallest free slot for each, shortest first
        sizes = sorted(s[3] for s in slots)
        won = []
        for n in sorted((d[3] for d in docs), reverse=True):
            trial = sorted([*won, n], reverse=True)
            if all(sum(s >= x for s in sizes) >= k for k, x in enumerate(trial, 1)):
                won = trial
        free, want = list(sizes), []
        for n in reversed(won):
            want.append((n, free.pop(bisect.bisect_left(free, n))))
        for ranges in (1, 5):
            rows = packing.match(line, ranges).collect()
            slot = {r.place: r.size for r in rows if r.kind == 1}
            got = [(r.size, slot[r.place]) for r in rows if r.kind == 0]
            assert len({r.place for r in rows if r.kind == 0}) == len(got)
            assert sorted(got) == sorted(want)


@pytest.mark.parametrize("range_rows", [10**6, 150])
def test_best_fit_rounds(spark, range_rows):
    rng = random.Random(5)
    lengths = [100] * 30 + [1] * 150 + [rng.randint(1, 100) for _ in range(300)]
    lengths += [33] * 90 if range_rows > 150 else []
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    rows = packing.best_fit(items, 100, range_rows).collect()
    assert sorted(r.item for r in rows) == list(range(len(lengths)))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, lengths[r.item]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 100
    assert len(places) <= 1.01 * one_by_one(lengths, 100) + 1
    assert packing.best_fit(items.limit(0), 100).collect() == []
    assert packing.cuts(5000) == [0, 904, 2952] and packing.cuts(4096) == [0, 2048]


def test_media(spark):
    docs = documents(spark).union(spark.createDataFrame([(-8, "x" * 576), (-9, "é" * 300)], "doc_id long, text string"))
    texts = {}
    for r in docs.collect():
        raw = (r.text or "").encode()
        texts.setdefault(r.doc_id, []).append((len(raw), raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))))
    for r in avi.report(docs).collect():
        want = [(n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for n, p in texts[r.doc_id]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want
    assert avi.report(docs.limit(0)).count() == 0


def test_media_frames_and_shots():
    media = avi.encode(bytes(range(256)) * 9)
    frames, micros = avi.frames_of(media)
    assert len(frames) == 4 and micros == 40_000
    info, coded = avi._split(frames[0])
    paired, _ = avi.coefficients(frames[0])
    assert (avi._scan(info, coded) == paired).all()  # the general decoder agrees
    flat = np.zeros((1, 1, 64), np.int32)
    flat[0, 0, 0] = 80
    assert (avi.pixels(flat, np.ones(64, np.int32)) == 138).all()
    shares = np.zeros((20, 16))
    shares[:10, 3] = shares[10:, 9] = 1
    assert avi.starts(shares) == [0, 10]
    assert avi.starts(shares[[0, 0, 0, 0, 0, 10]]) == [0, 5] and avi.starts(shares[[0, 10]]) == [0, 1]
    single = np.eye(16)[[1] * 5 + [2] + [3] * 5]
    assert avi.starts(single) == [0, 5, 6]  # a shot of one frame
    with pytest.raises(ValueError):
        avi.frames_of(b"not a file")


def test_media_parts_and_record_lists():
    first, second = avi.encode(bytes(range(256)) * 9), avi.encode(b"z" * 1152)
    later = [avi._chunk(b"00dc", f) for f in avi.frames_of(second)[0]]
    record = avi._chunk(b"LIST", b"rec " + later[0])
    whole = first + avi._chunk(b"RIFF", b"AVIX" + avi._chunk(b"LIST", b"movi" + record + later[1]))
    wanted = avi.frames_of(first)[0] + avi.frames_of(second)[0]
    assert avi.frames_of(whole)[0] == wanted
    assert avi.inspect(whole)["payload"] == bytes(range(256)) * 9 + b"z" * 1152
    bare = bytearray(first)
    bare[bare.rindex(b"idx1") : bare.rindex(b"idx1") + 4] = b"JUNK"  # no index: the chunks give the order
    assert avi.frames_of(bytes(bare))[0] == avi.frames_of(first)[0]


def test_clips(spark):
    df = spark.createDataFrame([(1, bytearray(avi.encode(b"a" * 576 * 3))), (2, None)], "doc_id long, media binary")
    assert [tuple(r)[:5] for r in avi.clips(df).collect()] == [(1, 0, 0, 120, 3)]


def test_fixity(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(110, None, None), (None, "u", ""), (13, "u", ""), (57, "u", "h"), (57, "u", "h")], pages.schema)
    both = pages.union(odd)
    turn = F.col("page_id") % 97
    rows = warc.report(both, turn == 13, turn == 57).collect()
    assert len(rows) == both.count()
    want = {13: "changed", 57: "missing"}
    assert all(r.status == want.get(r.page_id % 97 if r.page_id is not None else None, "intact") for r in rows)
    own = sorted((r.archive, r.offset, r.length) for r in rows)
    assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:], strict=False))
    assert warc.report(both.limit(0), turn == 13, turn == 57).count() == 0


def test_extra_records_are_found(spark):
    ours = spark.createDataFrame([(0, 0, 5, "a"), (0, 5, 5, "b")], "archive long, offset long, length long, sha256 string")
    theirs = ours.union(spark.createDataFrame([(0, 900_000, 5, "c"), (3, 0, 1, "d")], ours.schema))
    assert sorted(map(tuple, warc.audit(ours, theirs).collect())) == [(0, 900_000, "extra"), (3, 0, "extra")]


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.report(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)
    odd = spark.createDataFrame(ODD + [(None, "x")], "doc_id long, text string")
    scored = quality.report(odd, labels.limit(0)).collect()
    assert len(scored) == len(ODD) + 1 and {r.score for r in scored} == {0.5}
    assert quality.report(odd.limit(0), labels).count() == 0
    assert quality.pooled([(0, 2, 2), (1, 2, 0), (2, 1, 1)]) == [(0, 0.5), (1, 0.5), (2, 1.0)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for _, function in corpus_pipeline.STAGES[:-1]:
        seen = function(spark, seen, SF)
        assert seen.columns == docs.columns
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)
