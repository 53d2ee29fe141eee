"""Prefix trie of conversations, built as burst tries.

A turn is known by a hash of role and text. Conversations are cut into spans of ``SPAN`` turns, and a
span hangs below a head: the hash of everything before it, so that spans of one head continue one
prefix. Equal spans of a head are one suffix with a count and the smallest conversation. All suffixes
of a head form its container. A container with more than ``LIMIT`` turns bursts: what all its suffixes
share becomes a path of nodes, the next turn's id names a new head for each, and the rest goes into the
container there, until no container is too large. The remaining ones are dealt out by head, sorted, and
swept into nodes, each within one task. Sums over subtrees go back up through the heads, one step for
each round of bursts, and from the deepest spans to the first.

A path shared by any number of conversations is one step, so rounds grow with the places where large
containers branch. Steps over spans grow with the longest conversation over ``SPAN``.

Turns are ordered by ``turn`` (null first), equal ones by their hash; null role and text are empty, rows
without a conversation id belong to none and are left out. Repeated rows are turns of their own. An empty
table has no nodes. Other columns play no part. The conversations that end at a node are hashed in order
of their ids: chunks of ids are joined before the shuffle, and one task streams a node's chunks, since a
SHA-256 has one thread; it holds one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.llm.ranges import prefix_sum, range_sorted
from dyadflow.session import ship_package
from dyadflow.staging import stage

SPAN = 1_024  # turns of a suffix
LIMIT = 1 << 12  # turns of a container, unless it is one suffix
GROUP = 20  # conversations that share the first turns of one
SHARED = 4  # a conversation takes fewer than that from its group's first
CHUNK_IDS = 1 << 13  # conversation ids joined before they are hashed

ROOT = "unhex(sha2('', 256))"
NO_ENDS = "sha2('', 256)"
#: What a container gives: its nodes (``kind`` 0), and one row of what lies below its head (``kind`` 1).
SWEPT = (
    "kind int, head binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
NODE = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, id, words): a hash of role and text for each turn, and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the length of the role keeps role and text apart
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return df.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        F.unhex(F.sha2(whole, 256)).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, id, words) of the rebuilt conversations, depth from 1, and (conv_id, length) of each.

    A conversation takes its first turns from the first of its group of ``GROUP`` ids: as many as the
    CRC-32 of its id says, if there are so many, and goes on with its own turns after that number.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("id")]
    ranged = range_sorted(_turns(df), ["conv_id", *order], "turns")
    placed = stage(
        prefix_sum(ranged, ["conv_id"], order, F.lit(1), "place").select("conv_id", "place", "id", "words"), "placed"
    )
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    asked = sizes.select(
        "conv_id", "size", F.expr(f"conv_id - conv_id % {GROUP}").alias("origin"),
        F.expr(f"crc32(CAST(conv_id AS STRING)) % {SHARED}").alias("asked"),
    )
    origins = sizes.select(F.col("conv_id").alias("origin"), F.col("size").alias("there"))
    info = stage(
        asked.join(origins, "origin", "left")
        .withColumn("taken", F.expr("least(asked, coalesce(there, 0))"))
        .withColumn("length", F.expr("taken + greatest(size - asked, 0)"))
        .select("conv_id", "origin", "asked", "taken", "length"),
        "conversations",
    )
    borrowed = (
        info.where("taken > 0").select("conv_id", "origin", "taken")
        .join(placed.where(F.col("place") < SHARED - 1).withColumnRenamed("conv_id", "origin"), "origin")
        .where("place < taken").select("conv_id", F.expr("place + 1").alias("depth"), "id", "words")
    )
    # rows move only where fewer turns were taken than asked for; the rest needs no join
    moved = info.where("taken < asked").select("conv_id", F.expr("asked - taken").alias("short"))
    kept = placed.where(F.expr(f"place >= crc32(CAST(conv_id AS STRING)) % {SHARED}"))
    own = kept.join(moved, "conv_id", "left").select(
        "conv_id", F.expr("place + 1 - coalesce(short, 0)").alias("depth"), "id", "words"
    )
    return borrowed.unionByName(own), info.select("conv_id", "length")


def _hash(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _path(turns: Column) -> Column:
    """The ids of an array of turns, one after another."""
    return F.aggregate(turns, F.lit(b""), lambda whole, t: F.concat(whole, t["id"]))


def spans(turns: DataFrame, lengths: DataFrame, span: int) -> DataFrame:
    """(conv_id, part, head, key, turns, last): each conversation's spans below their heads.

    ``key`` is the head of what follows; an empty span marks a conversation that ends where one begins.
    """
    cut = turns.groupBy("conv_id", F.expr(f"(depth - 1) div {span}").alias("part")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("depth", "id", "words"))),
            lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")),
        ).alias("turns")
    )
    closing = lengths.select("conv_id", F.expr(f"length div {span}").alias("part"), F.lit(True).alias("last"))
    none = F.expr("array()").cast("array<struct<id:binary,words:bigint>>")
    # every span but the last is full, so the rows with a span include all but empty last ones
    all_spans = stage(
        cut.join(closing, ["conv_id", "part"], "full").select(
            "conv_id", "part", F.coalesce("turns", none).alias("turns"), F.coalesce("last", F.lit(False)).alias("last")
        ),
        "spans",
    )
    first = all_spans.where("part = 0").select("*", F.expr(ROOT).alias("head"))
    later = all_spans.where("part > 0")
    if not later.limit(1).count():
        return first.withColumn("key", _key())
    chained = _heads(all_spans.join(later.select("conv_id").distinct(), "conv_id", "left_semi"))
    heads = chained.select("conv_id", F.expr("part + 1").alias("part"), F.col("key").alias("head"))
    return first.unionByName(later.join(heads, ["conv_id", "part"])).withColumn("key", _key())


def _key() -> Column:
    return F.when(F.size("turns") == 0, F.col("head")).otherwise(_hash(F.col("head"), _path(F.col("turns"))))


def _heads(parts: DataFrame) -> DataFrame:
    """(conv_id, part, key) along each conversation: the hash of all turns up to a span's end."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        empty = hashlib.sha256(b"").digest()
        conversation, key = None, empty
        for batch in batches:
            keys = []
            for number, path in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if number != conversation:
                    conversation, key = number, empty
                if path:
                    key = hashlib.sha256(key + path).digest()
                keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary())], names=["conv_id", "part", "key"]
            )

    rows = parts.select("conv_id", "part", _path(F.col("turns")).alias("path"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, "conv_id bigint, part bigint, key binary")


def ends(cut: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 over the comma-joined ids, ascending, of the conversations that end at a key."""
    ending = cut.where("last").select("key", "conv_id")
    # a key that ends many conversations is spread over ranges of ids
    ranged = ending.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def chunks(batches):
        import pyarrow as pa

        key, ids, first = None, [], 0
        kinds = [pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            out = []
            for own, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (own != key or len(ids) >= CHUNK_IDS):
                    out.append((key, first, ",".join(ids).encode()))
                    ids = []
                if not ids:
                    key, first = own, number
                ids.append(str(number))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "first", "ids"]
                )
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], kinds[0]), pa.array([first], kinds[1]), pa.array([",".join(ids).encode()], kinds[2])],
                names=["key", "first", "ids"],
            )

    def digests(batches):
        import hashlib

        import pyarrow as pa

        key, state = None, None
        for batch in batches:
            keys, hashes = [], []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own == key:
                    state.update(b"," + ids)
                    continue
                if state is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = own, hashlib.sha256(ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])

    packed = ranged.mapInArrow(chunks, "key binary, first bigint, ids binary")
    dealt = packed.repartition("key").sortWithinPartitions("key", "first")
    return dealt.mapInArrow(digests, "key binary, ends string")


def _sweep():
    """Containers in order of head, suffixes sorted: nodes by comparing each suffix with the one before it."""

    def container(head, depth, suffixes):
        # a node: depth, low, n, words, children, leaves, saved, ends, parent's place; the head is the first
        nodes = [[depth, None, 0, 0, 0, 0, 0, None, None]]
        path, before = [0], []
        for turns, low, n, closing, children, leaves, saved in suffixes:
            shared = 0
            while shared < min(len(before), len(turns)) and before[shared][0] == turns[shared][0]:
                shared += 1
            del path[shared + 1 :]
            for _, words in turns[shared:]:
                nodes.append([depth + len(path), None, 0, words, 0, 0, 0, None, path[-1]])
                path.append(len(nodes) - 1)
            for place in path:
                node = nodes[place]
                node[1] = low if node[1] is None else min(node[1], low)
                node[2] += n
            last = nodes[path[-1]]
            last[4], last[5], last[6] = last[4] + children, last[5] + leaves, last[6] + saved
            last[7] = closing or last[7]
            before = turns
        for node in reversed(nodes[1:]):  # children come after their parents
            if not node[4]:
                node[5] = 1
            node[6] += (node[2] - 1) * node[3]
            parent = nodes[node[8]]
            parent[4] += 1
            parent[5] += node[5]
            parent[6] += node[6]
        for node in nodes[1:]:
            yield (0, head, node[0], node[1], nodes[node[8]][1], node[2], node[4], node[5], node[6], node[7])
        top = nodes[0]
        yield (1, head, depth, top[1], None, top[2], top[4], top[5], top[6], top[7])

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.binary(), *[pa.int64()] * 7, pa.string()]
        names = [part.split()[0] for part in SWEPT.split(", ")]

        def table(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )

        head, depth, held, rows = None, 0, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                columns = (c.to_pylist() for c in batch.slice(at, 1_024).columns)
                for own, own_depth, turns, *rest in zip(*columns, strict=True):
                    if own != head and held:
                        rows += container(head, depth, held)
                        held = []
                        if len(rows) > 10_000:
                            yield table(rows)
                            rows = []
                    head, depth = own, own_depth
                    held.append(([(t["id"], t["words"]) for t in turns], *rest))
        if held:
            rows += container(head, depth, held)
        if rows:
            yield table(rows)

    return run


SUFFIX_COLUMNS = ["head", "depth", "turns", "low", "n", "ends", "children", "leaves", "saved"]


def _shared(low: Column, high: Column) -> Column:
    """How many turns two arrays begin with alike; between the smallest and the largest suffix, what all share."""
    differs = F.transform(
        F.zip_with(low, high, lambda a, b: F.coalesce(a["id"] != b["id"], F.lit(True))), lambda d: d.cast("int")
    )
    at = F.array_position(differs, 1)
    return F.when(at == 0, F.size(low)).otherwise((at - 1).cast("int"))


def grow(suffixes: DataFrame, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """(``SUFFIX_COLUMNS``) → the nodes below the heads, and what lies below each head (``kind`` 1 of ``SWEPT``)."""
    rounds, small, left = [], [], suffixes
    while True:
        sizes = left.groupBy("head").agg(F.sum(F.size("turns")).alias("size"), F.count(F.lit(1)).alias("members"))
        over = stage(sizes.where((F.col("size") > limit) & (F.col("members") > 1)).select("head"), "oversized")
        if not over.limit(1).count():
            small.append(left)
            break
        small.append(left.join(over, "head", "left_anti"))
        bursting = stage(left.join(over, "head", "left_semi"), "bursting")
        stems = stage(
            bursting.groupBy("head").agg(
                F.min("turns").alias("first"), F.max("turns").alias("last"), F.first("depth").alias("depth"),
                F.min("low").alias("low"), F.sum("n").alias("n"),
            )
            .withColumn("shared", _shared(F.col("first"), F.col("last")))
            .select("head", "depth", "low", "n", "shared", F.slice("first", 1, F.col("shared")).alias("stem")),
            "stems",
        )
        parted = bursting.drop("depth").join(stems.select("head", "depth", "shared"), "head")
        whole = F.col("shared") == F.size("turns")
        # suffixes that end with the stem: one at most, as equal ones are one
        closing = parted.where(whole).select("head", "ends", "children", "leaves", "saved")
        grown = stage(
            parted.where(~whole).select(
                F.col("head").alias("above"),
                _hash(F.col("head"), _path(F.slice("turns", 1, F.col("shared") + 1))).alias("head"),
                (F.col("depth") + F.col("shared") + 1).alias("depth"),
                F.expr("slice(turns, shared + 2, size(turns))").alias("turns"),
                F.expr("turns[shared].words").alias("words"),
                "low", "n", "ends", "children", "leaves", "saved",
            ),
            "grown",
        )
        rounds.append((stems, closing, grown))
        left = grown.select(*SUFFIX_COLUMNS)
    containers = small[0]
    for more in small[1:]:
        containers = containers.unionByName(more)
    ordered = containers.select(*SUFFIX_COLUMNS).repartition("head").sortWithinPartitions("head", "turns")
    ship_package(suffixes.sparkSession)
    swept = stage(ordered.mapInArrow(_sweep(), SWEPT), "swept")
    nodes, below = [swept.where("kind = 0").select(*NODE)], swept.where("kind = 1")
    for stems, closing, grown in reversed(rounds):
        heads = grown.groupBy("above", "head").agg(F.first("words").alias("words"))
        known = below.select(
            "head", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
        )
        tops = stage(
            heads.join(known, "head").select(
                "above", "depth", "conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
                F.expr("saved_tokens + (n_convs - 1) * words").alias("saved_tokens"), "ends_sha256",
            ),
            "tops",
        )
        sums = tops.groupBy(F.col("above").alias("head")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
        )
        at_end = stage(
            stems.join(sums, "head", "left").join(closing, "head", "left").select(
                "head", "depth", "low", "n", "shared", "stem", F.col("ends").alias("ends_sha256"),
                F.expr("coalesce(n_children, 0) + coalesce(children, 0)").alias("n_children"),
                F.expr("coalesce(n_leaves, 0) + coalesce(leaves, 0)").alias("n_leaves"),
                F.expr("coalesce(saved_tokens, 0) + coalesce(saved, 0)").alias("saved_tokens"),
            ),
            "stem_ends",
        )
        # the stem's nodes from its end upward; the words from a node to the end are saved below it
        upward = Window.partitionBy("head").orderBy(F.desc("place"))
        stem_nodes = (
            at_end.where("shared > 0").select("*", F.posexplode("stem").alias("place", "turn"))
            .withColumn("saved", F.col("saved_tokens") + (F.col("n") - 1) * F.sum(F.col("turn.words")).over(upward))
            .withColumn("is_end", F.col("place") == F.col("shared") - 1)
            .select(
                "head", "place", (F.col("depth") + F.col("place") + 1).alias("depth"), F.col("low").alias("conv_id"),
                F.col("low").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.when(F.col("is_end"), F.col("n_children")).otherwise(1).alias("n_children"),
                F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                F.when(F.col("is_end"), F.col("ends_sha256")).alias("ends_sha256"),
            )
        )
        above = stems.select(F.col("head").alias("above"), F.col("low").alias("parent_conv_id"))
        nodes += [stem_nodes.select(*NODE), tops.join(above, "above").select(*NODE)]
        upper = stem_nodes.where("place = 0").select("head", F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
        heads_below = at_end.join(upper, "head", "left").select(
            F.lit(1).alias("kind"), "head", "depth", F.col("low").alias("conv_id"),
            F.lit(None).cast("bigint").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.expr("CASE WHEN shared > 0 THEN 1 ELSE n_children END").alias("n_children"),
            F.coalesce("l", "n_leaves").alias("n_leaves"), F.coalesce("s", "saved_tokens").alias("saved_tokens"),
            F.when(F.col("shared") == 0, F.col("ends_sha256")).alias("ends_sha256"),
        )
        below = stage(below.unionByName(heads_below), "below")
    return nodes, below


def nodes(df: DataFrame, span: int = SPAN, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations of ``df`` (conv_id, turn, role, text)."""
    ship_package(df.sparkSession)
    turns, lengths = rebuilt(df)
    cut = stage(spans(turns, lengths, span), "cut")
    deepest = cut.agg(F.max("part")).first()[0] or 0
    merged = (
        cut.groupBy("part", "head", "key")
        .agg(F.first("turns").alias("turns"), F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("n"))
        .join(ends(cut), "key", "left")
    )
    merged = stage(merged, "suffixes")
    out, below = [], None
    for part in range(deepest, -1, -1):
        own = merged.where(F.col("part") == part).withColumn("depth", F.lit(part * span).cast("bigint"))
        if below is None:
            hung = own.select("*", *(F.lit(0).cast("bigint").alias(c) for c in ("children", "leaves", "saved")))
        else:
            # where a span is full, what follows hangs below it; an empty span's key is its own head
            under = below.select(
                F.col("head").alias("key"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"),
                F.col("saved_tokens").alias("saved"),
            )
            hung = own.join(under, "key", "left").fillna(0, ["children", "leaves", "saved"])
        grown, below = grow(stage(hung.select(*SUFFIX_COLUMNS), "hung"), limit)
        below = below.where(F.col("depth") == part * span)
        out += grown
    root = below.select(
        F.lit(0).cast("bigint").alias("depth"), "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"),
        "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", "ends_sha256",
    )
    for more in out:
        root = root.unionByName(more)
    return root.withColumn("ends_sha256", F.coalesce("ends_sha256", F.expr(NO_ENDS)))


def report(df: DataFrame) -> DataFrame:
    return nodes(df).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
