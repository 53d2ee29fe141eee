"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

``fingerprints`` sums the bits of shingle hashes of each whole text. Rows with equal fingerprints are
one class from then on, so copies never meet each other in a join.

``links`` is exact for a small distance k: a fingerprint is cut into k + 2 blocks, two fingerprints
within k agree in two blocks at least, and every pair of blocks is a join key; the pairs that meet are
kept if they differ in k bits at most. Keys shared by many fingerprints are not joined with
themselves: every member names the points within one bit of it among the bits outside the shared
blocks, and two members that name the same point differ in two bits at most (and those that do differ
in two or one name a common point), so members of a point are linked in a line to its smallest.
That part is for k = 2.

``distinct_documents`` is for similarities where k would be a tenth of all bits, and is exact: a prefix
join on the rarest shingles names every pair whose shingle sets can agree to ``SIMILARITY``, and whole
sets are compared for each pair that links, whatever its fingerprints. Before that, fingerprints of
512 bits connect what is close (neighbours within blocks of sampled bits, compared like the others),
so that the join need not list the pairs of a large group: only pairs across what is connected already
are named, and of these only pairs that the parities of their sets allow (each shingle flips one of
``PARITY_WORDS`` words' bits, so as many bits as two sets differ in, as many shingles at least).
Shingles count by their 64-bit hashes, equal sets by a 128-bit hash of the set.

Null and empty texts have fingerprint zero and are linked like any other. Empty tables give none.
Repeated rows are rows of the same class. Other columns play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.llm.components import components
from dyadflow.llm.rows import boxed
from dyadflow.session import ship_package
from dyadflow.staging import release, stage

SEED = 42
DISTANCE = 2
PARTS = DISTANCE + 2
HOT_KEY = 48  # members of a key from which points are named instead of pairs

WIDE_WORDS = 8  # 64-bit words of a wide fingerprint
BLOCK_BITS = 24
KEY_BITS = 57  # a block's bits and those that sort its members
FIRST_BLOCKS = 4  # of the blocks; what these connect is not compared again
BLOCKS = 16  # to connect large groups early; what they miss is found by the prefix join
#: Of 512 bits, similarity 0.8 differs in 78 on average, with a deviation of 8: neighbours above are
#: left to the prefix join.
WIDE_DISTANCE = 110
SIMILARITY = (4, 5)  # a fraction, so that sizes are compared as whole numbers
COUNTERS = (1 << 20, 1 << 24)  # of shingles by hash: as many as rows, within these; any number is right
COUNTER_SLICE = 4_096
PARITY_WORDS = 16  # of a set's parities; they tell apart what differs in some 700 shingles and fewer
SEEN = 1 << 18  # sets a task remembers, to name the prefix of repeated ones once


def _counts(hashes, words: int):
    """How often each bit is set over all hashes; further words are the hashes mixed anew."""
    import numpy as np

    bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
    out = np.zeros(64 * words, dtype=np.int64)
    mixed = hashes
    for word in range(words):
        if word:
            mixed = hashes ^ np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        columns = mixed.astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            seen = np.bincount(columns[:, byte], minlength=256)
            out[64 * word + 8 * byte : 64 * word + 8 * byte + 8] = seen @ bits
    return out


def shingle_hashes(text: bytes | None, shingle: int) -> Iterator:
    """Arrays of XXH64 values of a text's shingles, repeats included; nothing without words."""
    import numpy as np
    import xxhash

    tokens = (text or b"").lower().split()  # both of ASCII only, as bytes
    if not tokens:
        return
    joined = iter([b" ".join(tokens)])
    if len(tokens) >= shingle:
        joined = map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    while batch := list(itertools.islice(joined, 65_536)):
        yield np.fromiter((digest(s, SEED) for s in batch), dtype=np.uint64, count=len(batch))


def fingerprint(text: bytes | None, shingle: int, words: int = 1) -> bytes:
    """Little-endian fingerprint of ``64 * words`` bits: a bit is 1 if set in over half the hashes."""
    import numpy as np

    counts, total = np.zeros(64 * words, dtype=np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        counts, total = counts + _counts(hashes, words), total + len(hashes)
    return np.packbits(counts * 2 > total, bitorder="little").tobytes()


def fingerprints(df: DataFrame, key: list[str], text: str, shingle: int, words: int = 1) -> DataFrame:
    """Columns of ``key`` and ``fp``: a long for one word, else an array of longs."""
    ship_package(df.sparkSession)
    kind = "bigint" if words == 1 else "array<bigint>"
    source = df.select(*key, F.encode(text, "UTF-8").alias("_text"))
    kept = source.schema[: len(key)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"fp {kind}"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle, words) for t in batch.column(len(key))]
            flat = np.frombuffer(b"".join(prints), dtype="<i8")
            fp = pa.array(flat)
            if words > 1:
                ends = np.arange(len(prints) + 1, dtype=np.int32) * words
                fp = pa.ListArray.from_arrays(pa.array(ends), fp)
            names = [*batch.schema.names[: len(key)], "fp"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], fp], names=names)

    return source.mapInArrow(run, schema)


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _bits_apart(a: str, b: str) -> Column:
    """In how many bits two arrays of longs differ."""
    return F.aggregate(F.zip_with(a, b, _distance), F.lit(0), lambda total, d: total + d)


def _shared_bits(parts: int) -> list[int]:
    """For every two of ``parts`` blocks, the mask of their bits (as a signed 64-bit number)."""
    edges = [64 * i // parts for i in range(parts + 1)]
    blocks = [sum(1 << bit for bit in range(a, b)) for a, b in itertools.pairwise(edges)]
    masks = [a | b for a, b in itertools.combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(classes: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Distinct ``fp`` → pairs (a, b) of fingerprints within ``DISTANCE``, enough to connect all such.

    All pairs of keys with up to ``hot_key`` members; a star for every point of larger ones.
    """
    masks = _shared_bits(PARTS)
    keyed = classes.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "bits"),
    )
    met = keyed.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stage(keyed.join(met, ["part", "bits"]), "blocks")
    cold = shared.where(F.col("members") <= hot_key)
    pairs = (
        cold.select("part", "bits", F.col("fp").alias("a"))
        .join(cold.select("part", "bits", F.col("fp").alias("b")), ["part", "bits"])
        .where((F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= DISTANCE))
        .select("a", "b")
    )
    # points: the member itself, and the member with one bit outside the shared blocks flipped
    ones = [1 << bit if bit < 63 else -(1 << 63) for bit in range(64)]
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(o).cast("bigint") for o in ones])
    mask = F.get(F.array(*[F.lit(m).cast("bigint") for m in masks]), F.col("part"))
    named = (
        shared.where(F.col("members") > hot_key)
        .select("part", "fp", mask.alias("mask"), F.explode(flips).alias("flip"))
        .where(F.col("flip").bitwiseAND(F.col("mask")) == 0)
        .select("part", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    )
    centre = named.groupBy("part", "point").agg(
        F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    stars = (
        named.join(centre, ["part", "point"])
        .select("a", F.col("fp").alias("b"))
        .where((F.col("a") != F.col("b")) & (_distance(F.col("a"), F.col("b")) <= DISTANCE))
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3
) -> DataFrame:
    """One row per input row: key, fp, and component_id, the smallest key reachable over links."""
    prints = stage(fingerprints(df, [key], text, shingle), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    roots = components(links(classes)).withColumnRenamed("id", "fp")
    rooted = classes.join(roots, "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(rooted.join(lowest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp")


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = near_duplicates(df, key, text)
    return found.select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _block_keys(classes: DataFrame, numbers: range) -> DataFrame:
    """(id, root, fp) → (id, root, key) for each block: its number, then ``KEY_BITS`` sampled bits."""
    import random

    draw = random.Random(SEED)  # the same bits on every run
    chosen = [draw.sample(range(64 * WIDE_WORDS), KEY_BITS) for _ in range(BLOCKS)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weights = np.uint64(1) << np.arange(KEY_BITS, dtype=np.uint64)[::-1]
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                words = part.column(2).flatten().to_numpy().astype("<i8").reshape(-1, WIDE_WORDS)
                set_bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                keys = np.empty((part.num_rows, len(numbers)), dtype=np.uint64)
                for place, number in enumerate(numbers):
                    own = set_bits[:, chosen[number]].astype(np.uint64) @ weights
                    keys[:, place] = own | np.uint64(number << KEY_BITS)
                ids, roots = (np.repeat(part.column(i).to_numpy(), len(numbers)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(roots), pa.array(keys.ravel().view(np.int64))],
                    names=["id", "root", "key"],
                )

    return classes.select("id", "root", "fp").mapInArrow(run, "id bigint, root bigint, key bigint")


def candidates(classes: DataFrame, numbers: range) -> DataFrame:
    """(id, root, wide fp) → pairs (a, b) up to ``WIDE_DISTANCE``, to connect large groups early.

    Members of a block are sorted by further bits, so that the closest stand side by side, and every
    member is compared with the one before it, unless both have one root. Rows are range-sorted, so a
    block of any size spreads over tasks; a neighbour across a border is not compared here.
    """
    keyed = _block_keys(classes, numbers).repartitionByRange("key", "id").sortWithinPartitions("key", "id")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, roots, keys = (batch.column(i).to_numpy() for i in range(3))
            blocks = keys >> np.int64(KEY_BITS - BLOCK_BITS)
            if last is not None:
                ids, roots, blocks = (np.concatenate([[x], y]) for x, y in zip(last, (ids, roots, blocks), strict=True))
            last = ids[-1], roots[-1], blocks[-1]
            met = (blocks[1:] == blocks[:-1]) & (roots[1:] != roots[:-1])
            a, b = ids[1:][met], ids[:-1][met]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
            )

    pairs = keyed.mapInArrow(run, "a bigint, b bigint").distinct()
    left = classes.select(F.col("id").alias("a"), F.col("fp").alias("fa"))
    right = classes.select(F.col("id").alias("b"), F.col("fp").alias("fb"))
    return pairs.join(left, "a").join(right, "b").where(_bits_apart("fa", "fb") <= WIDE_DISTANCE).select("a", "b")


def _shingle_set(text: bytes | None, shingle: int):
    import numpy as np

    return np.unique(np.concatenate([*shingle_hashes(text, shingle), np.zeros(0, np.uint64)]))


def _set_hash(shingles) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    import xxhash

    whole = xxhash.xxh3_128_intdigest(shingles.tobytes(), SEED)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(whole >> 64), signed(whole & ((1 << 64) - 1))


def _parities(shingles):
    """Little-endian bits: whether a set has an odd number of shingles with the bit's number as top bits."""
    import numpy as np

    size = 64 * PARITY_WORDS
    places = (shingles >> np.uint64(65 - size.bit_length())).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=size) & 1, bitorder="little").tobytes()


def _prints(df: DataFrame, key: str, text: str, shingle: int, counters: int) -> DataFrame:
    """(key, _content, h1, h2, fp, parity) of each row: a hash, the wide fingerprint and the parities of
    its set of shingles; no hash without words. Rows with a ``slice`` hold each task's counts of shingles
    by ``counters``.
    """
    ship_package(df.sparkSession)
    content = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    source = df.select(F.col(key).alias("_key"), content.alias("_content"), F.encode(text, "UTF-8").alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()
    names = ["_key", "_content", "h1", "h2", "fp", "parity", "slice", "counts"]

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        counts, none = np.zeros(counters, dtype=np.uint32), None
        for batch in batches:
            none = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, prints, parities, places = [], [], [], []
                for t in part.column(2):
                    own = _shingle_set(t.as_py(), shingle)
                    bits = _counts(own, WIDE_WORDS) * 2 > len(own)
                    prints.append(np.packbits(bits, bitorder="little").tobytes())
                    parities.append(_parities(own))
                    ids.append(_set_hash(own) if len(own) else (None, None))
                    places.append(own % np.uint64(counters))
                np.add.at(counts, np.concatenate(places).astype(np.int64), 1)
                fp, parity = (
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(own) + 1, dtype=np.int32) * words),
                        pa.array(np.frombuffer(b"".join(own), dtype="<i8")),
                    )
                    for own, words in ((prints, WIDE_WORDS), (parities, PARITY_WORDS))
                )
                h1, h2 = zip(*ids, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), fp,
                     parity, pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())],
                    names=names,
                )
        slices = [n for n, part in enumerate(counts.reshape(-1, COUNTER_SLICE)) if part.any()]
        if not slices:
            return
        packed = [zlib.compress(counts.reshape(-1, COUNTER_SLICE)[n].astype("<u4").tobytes(), 1) for n in slices]
        size = len(slices)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(size, none), pa.nulls(size, pa.string()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()),
             *[pa.nulls(size, pa.list_(pa.int64()))] * 2, pa.array(slices, pa.int32()), pa.array(packed, pa.binary())],
            names=names,
        )

    return source.mapInArrow(
        run,
        f"_key {kind}, _content string, h1 bigint, h2 bigint, fp array<bigint>, parity array<bigint>, "
        "slice int, counts binary",
    )


def _levels(counted: DataFrame, counters: int) -> bytes:
    """Each counter's frequency as one byte on a log scale, packed: 16 megabytes at most for any input."""
    import zlib

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for n, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                own = np.frombuffer(zlib.decompress(packed), dtype="<u4").astype(np.int64)
                sums[n] = sums.get(n, 0) + own
        if sums:
            levels = [np.minimum(6 * np.log2(s + 1), 255).astype(np.uint8).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["slice", "levels"]
            )

    dealt = counted.select("slice", "counts").repartition("slice")
    out = bytearray(counters)
    for row in dealt.mapInArrow(run, "slice int, levels binary").collect():
        out[row["slice"] * COUNTER_SLICE : (row["slice"] + 1) * COUNTER_SLICE] = row["levels"]
    return zlib.compress(bytes(out))


def _prefixes(df: DataFrame, text: str, levels: bytes, counters: int, shingle: int) -> DataFrame:
    """Rows → (shingle, h1, h2, size, place): of each set of ``size`` shingles, rarest first, as many as a
    set that agrees with it to ``SIMILARITY`` cannot miss altogether. Repeated sets may come repeated.
    """
    part, whole = SIMILARITY
    ship_package(df.sparkSession)

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        level = np.frombuffer(zlib.decompress(levels), dtype=np.uint8)
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                firsts, sizes, ids = [], [], []
                for t in batch.slice(at, 256).column(0):
                    own = _shingle_set(t.as_py(), shingle)
                    size = len(own)
                    if not size or (known := _set_hash(own)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(known)
                    order = np.lexsort((own, level[own % np.uint64(counters)]))
                    firsts.append(own[order[: size + (-part * size // whole) + 1]])  # size - ceil(0.8 size) + 1
                    sizes.append(size)
                    ids.append(known)
                if not ids:
                    continue
                counts = [len(f) for f in firsts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(firsts).view(np.int64)),
                        *(pa.array(np.repeat(np.array(h, dtype=np.int64), counts)) for h in zip(*ids, strict=True)),
                        pa.array(np.repeat(np.array(sizes, dtype=np.int32), counts)),
                        pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in counts])),
                    ],
                    names=["shingle", "h1", "h2", "size", "place"],
                )

    coded = df.select(F.encode(text, "UTF-8").alias("text"))
    return coded.mapInArrow(run, "shingle bigint, h1 bigint, h2 bigint, size int, place int")


def _repeated(prefixes: DataFrame) -> DataFrame:
    """``_prefixes`` without repeated rows, and without shingles that only one set has.

    One shuffle, sorted, and a pass that holds one row: what goes is never written.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, matched, names = None, False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate([[h], c]) for h, c in zip(held, columns, strict=True)]
            shingle, h1, h2 = columns[:3]
            new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            columns = [c[new] for c in columns]
            same = columns[0][1:] == columns[0][:-1]
            keep = np.concatenate([[matched], same]) | np.concatenate([same, [False]])
            held, matched = [c[-1] for c in columns], bool(keep[-1])
            keep[-1] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[keep]).cast(f.type) for c, f in zip(columns, batch.schema, strict=True)], names=names
                )
            kinds = [f.type for f in batch.schema]
        if matched:
            yield pa.RecordBatch.from_arrays(
                [pa.array([h.item()], k) for h, k in zip(held, kinds, strict=True)], names=names
            )

    dealt = prefixes.repartition("shingle").sortWithinPartitions("shingle", "h1", "h2")
    return dealt.mapInArrow(run, "shingle bigint, h1 bigint, h2 bigint, size int, place int")


def prefix_pairs(prefixes: DataFrame, roots: DataFrame) -> DataFrame:
    """``_prefixes`` and (h1, h2, id, root, parity) → every pair (a, b) of different roots that can
    reach ``SIMILARITY``.

    Of two similar sets, the first shingle they share is in the prefix of the larger one and in a
    shorter prefix of the smaller one, and as many shingles follow it in both as must be shared. Two sets
    differ in as many shingles at least as their parities in bits, which leaves out most pairs of a group
    whose members fall short of ``SIMILARITY``. Pairs
    of roots are found before their members, so rows of one root never meet each other. Sets meet by
    shingle and band of sizes: similar ones are in one band or in neighbouring ones.
    """
    part, whole = SIMILARITY
    both = part + whole  # shared >= part / both * (size of one + size of the other)
    repeated = stage(_repeated(prefixes), "repeated")
    shared = stage(
        repeated.join(roots.select("h1", "h2", "id", "root", "parity"), ["h1", "h2"]).drop("h1", "h2"), "shared"
    )
    release(repeated)
    across = shared.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    # a band is as wide as the sizes of similar sets may differ, with a margin for rounding
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(whole / part + 1e-6))).cast("int")
    rows = stage(
        shared.join(across.where("low < high").select("shingle"), "shingle")
        .withColumn("tail", F.col("size") - F.col("place")).withColumn("band", band),
        "across",
    )
    release(shared)
    # the smaller of two sets shares 2 part / both of its own shingles at least; the larger is in its band or the next
    small = rows.where(F.col("tail") * both >= F.col("size") * 2 * part).withColumn(
        "band", F.explode(F.array("band", F.col("band") + 1))
    )

    def grouped(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("shingle", "band", F.col("root").alias(f"r{name}")).agg(
            F.max("tail").alias(f"t{name}"), F.min("size").alias(f"l{name}"), F.max("size").alias(f"h{name}")
        )

    def reach(a: str, b: str, size_a: str, size_b: str) -> Column:
        return F.least(a, b) * both >= (F.col(size_a) + F.col(size_b)) * part

    root_pairs = (
        grouped(small, "a").join(grouped(rows, "b"), ["shingle", "band"])
        .where((F.col("ra") != F.col("rb")) & (F.col("la") <= F.col("hb")) & reach("ta", "tb", "la", "lb"))
        .select("shingle", "band", "ra", "rb")
    )
    side = lambda frame, n: frame.select(
        "shingle", "band", F.col("root").alias(f"r{n}"), F.col("id").alias(n),
        F.col("size").alias(f"s{n}"), F.col("tail").alias(f"t{n}"), F.col("parity").alias(f"p{n}"),
    )
    ordered = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    sizes = F.col("sa") + F.col("sb")
    allowed = (sizes - _bits_apart("pa", "pb")) * both >= sizes * (2 * part)
    found = stage(
        root_pairs.join(side(small, "a"), ["shingle", "band", "ra"]).join(side(rows, "b"), ["shingle", "band", "rb"])
        .where(ordered & reach("ta", "tb", "sa", "sb") & allowed)
        .select("a", "b").distinct(),
        "exact_pairs",
    )
    release(rows)
    return found


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, text) → (id, shingles): distinct hashes of the whole text's shingles."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [_shingle_set(t.as_py(), shingle) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(np.concatenate(sets).astype(np.uint64).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "shingles"])

    coded = texts.select("id", F.encode("text", "UTF-8").alias("text"))
    return coded.mapInArrow(run, "id bigint, shingles array<bigint>")


def similar(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``SIMILARITY`` and more.

    ``texts`` has (id, text) of every id that the pairs name. Written; what it was made from can go.
    """
    sets = stage(_shingle_sets(texts, shingle).dropDuplicates(["id"]), "shingles")
    part, whole = SIMILARITY
    shared = F.size(F.array_intersect("sa", "sb"))
    found = stage(
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        .where(shared * (part + whole) >= (F.size("sa") + F.size("sb")) * part)
        .select("a", "b"),
        "similar",
    )
    release(sets)
    return found


def distinct_documents(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of ``df`` without near-copies: of each component the row with the smallest key stays.

    Copies are texts whose sets of shingles agree to 0.8 and more. Texts of equal sets are one class
    before any comparison; a component is what links between classes connect, and every link is
    verified by whole sets. Rows whose texts hold no word are kept apart by the text itself only.
    Rows that repeat key and text are one document. A null key counts as the largest.

    Texts are read from ``df`` again where they are compared, and no copy of them is written; what is
    written on the way is removed as soon as its successor is there.
    """
    content = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    least, most = COUNTERS
    counters = min(max(least, 1 << max(df.count() - 1, 1).bit_length()), most)
    wide = stage(_prints(df, key, text, shingle, counters), "wide")
    prints = wide.where("slice IS NULL")
    order = F.struct(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key")).alias("k"), "_content")
    classes = stage(
        prints.where("h1 IS NOT NULL").groupBy("h1", "h2")
        .agg(F.min(order).alias("low"), F.first("fp").alias("fp"), F.first("parity").alias("parity"))
        .withColumn("id", F.monotonically_increasing_id()),  # as written; two sets never share one
        "wide_classes",
    )
    empty = stage(
        prints.where("h1 IS NULL").groupBy("_content").agg(F.min(order).alias("low")).select("low"), "empty"
    )
    levels = _levels(wide.where("slice IS NOT NULL"), counters)
    release(wide)
    told_of = df.select(F.col(key).alias("_own"), F.col(text).alias("text"), content.alias("_content"))

    def rooted(linked: DataFrame) -> DataFrame:
        labels = components(linked)
        out = stage(classes.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
        release(labels)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        lows = classes.join(asked, "id").select(
            "id", F.col("low.k.key").alias("_low"), F.col("low._content").alias("_sha")
        )
        texts = told_of.join(lows, F.col("_own").eqNullSafe(F.col("_low")) & (F.col("_content") == F.col("_sha")))
        out = similar(pairs, texts.select("id", "text"), shingle)
        release(pairs)
        return out

    first = stage(candidates(classes.withColumn("root", F.col("id")), range(FIRST_BLOCKS)), "first")
    linked = verified(first)
    early = rooted(linked)
    later = stage(candidates(early, range(FIRST_BLOCKS, BLOCKS)), "later")
    release(early)
    linked = linked.unionByName(verified(later))
    known = rooted(linked)
    exact = prefix_pairs(_prefixes(df, text, levels, counters, shingle), known)
    release(known)
    last = rooted(linked.unionByName(verified(exact)))
    # texts without words have no set; each keeps its own class
    stay = last.groupBy("root").agg(F.min("low").alias("low")).select("low")
    kept = stage(
        stay.unionByName(empty).select(
            F.col("low.k.key").alias("_key"), F.col("low._content").alias("_content")
        ),
        "kept",
    )
    release(last, classes, empty)
    rows = df.select(F.col(key).alias("_key"), content.alias("_content"), boxed(df).alias("_row"))
    matched = rows.join(
        kept, rows["_key"].eqNullSafe(kept["_key"]) & (rows["_content"] == kept["_content"]), "left_semi"
    )
    # rows that repeat key and text are one
    return matched.groupBy("_key", "_content").agg(F.first("_row").alias("_row")).select("_row.*")
