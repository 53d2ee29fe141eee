"""Exact top-k by inner product over a bit-sliced index.

Vectors become whole numbers, floor(256 x). A block of rows keeps, for every attribute, its numbers minus
the block's least as bit slices: slice i is a bitmap over the rows. For a batch of queries the scores of
all rows of a block are added up as bit slices: groups of four attributes have their sixteen subset sums
ready, each bit of the query numbers picks one sum a group, and bitmap adders add them. The best rows are
then selected from the most significant slice downward, and rows that tie at the boundary are taken by
id. Blocks and query batches have a fixed size and meet in a stated grid, block by batch group.

Vectors that are null or hold a null or a number that is not finite take no part; an empty table gives no
rows. A shorter vector counts as filled up with zeros. Repeated rows are rows of their own: a query skips
only its own row. A null id sorts last among ties. Numbers beyond 2**52 after scaling raise an error.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.session import ship_package
from dyadflow.staging import stage

SCALE = 256
BLOCK_ROWS = 8_192
BATCH_GROUP = 16  # query batches, one for each block, that meet a block in one task
GROUP = 4  # attributes whose subset sums are kept


def _add(a: list, b: list) -> list:
    """Sum of two numbers given as bit slices, lowest first; slices broadcast."""
    out, carry = [], None
    for i in range(max(len(a), len(b))):
        if i >= len(a) or i >= len(b):
            x = a[i] if i < len(a) else b[i]
            if carry is None:
                out.append(x)
            else:
                out.append(x ^ carry)
                carry = x & carry
            continue
        x, y = a[i], b[i]
        either = x ^ y
        if carry is None:
            out.append(either)
            carry = x & y
        else:
            out.append(either ^ carry)
            carry = (x & y) | (either & carry)
    return out if carry is None else [*out, carry]


class Block:
    """Bit slices of the rows of a block, sorted by id."""

    def __init__(self, ids, known, queries, vectors: list):
        order = np.lexsort((ids, ~known))
        width = max((len(v) for v in vectors), default=0)
        numbers = np.zeros((len(vectors), width))
        for row, source in enumerate(order):
            own = np.floor(np.asarray(vectors[source], dtype=float) * SCALE)
            numbers[row, : len(own)] = own
        if numbers.size and np.abs(numbers).max() >= 2.0**52:
            raise OverflowError("a vector component is too large for exact scores")
        self.ids, self.known = ids[order], known[order]
        values = numbers.astype(np.int64)
        self.least = values.min(axis=0) if len(values) else np.zeros(width, np.int64)
        shifted = values - self.least
        bits = int(shifted.max()).bit_length() if shifted.size else 0
        words = -(-len(values) // 64)
        packed = np.zeros((width, bits, words * 8), dtype=np.uint8)
        for i in range(bits):
            plane = np.packbits((shifted >> i & 1).astype(np.uint8).T, axis=1, bitorder="little")
            packed[:, i, : plane.shape[1]] = plane
        self.planes = packed.view("<u8")
        at = np.flatnonzero(queries[order])
        self.query_rows, self.query_numbers = at, values[at]

    def tables(self, width: int) -> list[list[list]]:
        """For each group of attributes, the slices of every subset's sum."""
        words = self.planes.shape[2]
        own = [list(p) for p in self.planes] + [[] for _ in range(width - len(self.planes))]
        zero = np.zeros(words, dtype=np.uint64)
        out = []
        for first in range(0, width, GROUP):
            sums: list[list] = [[]]
            for slices in own[first : first + GROUP]:
                sums += [_add(s, slices) for s in sums]
            most = max(map(len, sums))
            padded = [s + [zero] * (most - len(s)) for s in sums]
            out.append([np.stack([s[i] for s in padded]) for i in range(most)])
        return out

    def best(self, numbers, own_rows, k: int):
        """Top ``k`` rows for query ``numbers``: (query index, row, score) arrays; own row -1: none."""
        many, words = len(numbers), self.planes.shape[2]
        width = max(numbers.shape[1], len(self.planes))
        width += -width % GROUP
        queries = np.zeros((many, width), dtype=np.int64)
        queries[:, : numbers.shape[1]] = numbers
        least = np.zeros(width, dtype=np.int64)
        least[: len(self.least)] = self.least
        size = int(np.abs(queries).max(initial=0)).bit_length() + 1
        raised = queries + (1 << (size - 1))  # not negative; taken off again below
        tables = self.tables(width)
        places = 1 << np.arange(GROUP)
        score: list = []
        for bit in range(size):
            chosen = (raised >> bit & 1).reshape(many, -1, GROUP) @ places
            total: list = []
            for number, table in enumerate(tables):
                total = _add(total, [slices[chosen[:, number]] for slices in table])
            zero = np.zeros((many, words), dtype=np.uint64)
            score = _add(score, [zero] * bit + total)
        # what raising added is a multiple of the rows' plain sums: add their complement instead
        plain: list = []
        for slices in self.planes:
            plain = _add(plain, list(slices))
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        zero = np.zeros(words, dtype=np.uint64)
        score = _add(score, [zero] * (size - 1) + [~s for s in plain])
        constant = (1 << (size - 1)) * ((1 << len(plain)) - 1)
        rows = np.zeros(words * 64, dtype=np.uint8)
        rows[: len(self.ids)] = 1
        left = np.tile(np.packbits(rows, bitorder="little").view("<u8"), (many, 1))
        skip = np.flatnonzero(own_rows >= 0)
        gone = own_rows[skip]
        left[skip, gone >> 6] &= ones ^ (np.uint64(1) << (gone & 63).astype(np.uint64))
        taken = np.zeros_like(left)
        wanted = np.full(many, k, dtype=np.int64)
        for plane in reversed(score):
            with_bit = left & plane
            count = np.bitwise_count(with_bit).sum(axis=1, dtype=np.int64)
            enough = (count >= wanted)[:, None]
            taken |= np.where(enough, np.uint64(0), with_bit)
            wanted -= np.where(enough[:, 0], 0, count)
            left = np.where(enough, with_bit, left & ~plane)
        query, row = [], []
        spread = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
        for q in range(many):
            picked = np.concatenate([spread(taken[q]), spread(left[q])[: wanted[q]]])
            query.append(np.full(len(picked), q))
            row.append(picked)
        query, row = np.concatenate(query), np.concatenate(row)
        exact = [0] * len(row)
        shift = (row & 63).astype(np.uint64)
        for i, plane in enumerate(score):
            bits = np.broadcast_to(plane, (many, words))[query, row >> 6] >> shift & np.uint64(1)
            exact = [e + (int(b) << i) for e, b in zip(exact, bits, strict=True)]
        base = [int(x) for x in (queries.astype(object) @ least.astype(object))] if many else []
        return query, row, [e - constant + base[q] for e, q in zip(exact, query, strict=True)]


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))


def build_index(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Written index (block, rows, queries): a pickled ``Block``, and its query rows and numbers."""
    ship_package(df.sparkSession)
    numbers = F.col(vector).cast("array<double>")
    rows = df.select(
        F.col(key).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
        numbers.alias("vector"),
    ).where(_usable(F.col("vector")))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept)
        known = table.column("id").is_valid().to_numpy()
        ids = table.column("id").fill_null(0).to_numpy()
        block = Block(ids, known, table.column("is_query").to_numpy(), table.column("vector").to_pylist())
        asked = (block.query_rows, block.ids[block.query_rows], block.known[block.query_rows], block.query_numbers)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([pickle.dumps(block)]), pa.array([pickle.dumps(asked)])],
            names=["block", "rows", "queries"],
        )

    # dealt in turn, so a block holds BLOCK_ROWS at most (and a little for each task that deals)
    dealt = rows.repartition(blocks)
    return stage(dealt.mapInArrow(run, "block int, rows binary, queries binary"), "index")


def search(index: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for every query row of the index."""
    numbers = [r["block"] for r in index.select("block").collect()]  # a number for each block
    batches = index.select(
        F.col("block").alias("batch"), "queries", F.floor(F.col("block") / BATCH_GROUP).alias("group"),
        F.explode(F.array(*[F.lit(n) for n in numbers]).cast("array<int>")).alias("block"),
    )
    groups = sorted({n // BATCH_GROUP for n in numbers})
    blocks = index.select(
        "block", "rows", F.explode(F.array(*[F.lit(g) for g in groups]).cast("array<bigint>")).alias("group")
    )
    kind = "batch int, row int, query_id bigint, vec_id bigint, score bigint"

    def meet(left, right):
        import pyarrow as pa

        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            block = pickle.loads(left.column("rows")[0].as_py())
            own_number = left.column("block")[0].as_py()
            for batch, packed in zip(right.column("batch").to_pylist(), right.column("queries"), strict=True):
                rows, ids, known, numbers = pickle.loads(packed.as_py())
                if not len(rows):
                    continue
                own = rows if batch == own_number else np.full(len(rows), -1)
                query, row, scores = block.best(numbers, own, k)
                out[0] += [batch] * len(query)
                out[1] += rows[query].tolist()
                out[2] += [int(ids[q]) if known[q] else None for q in query]
                out[3] += [int(block.ids[r]) if block.known[r] else None for r in row]
                out[4] += scores
        names = ["batch", "row", "query_id", "vec_id", "score"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(names, out, types, strict=True)})

    by = ["block", "group"]
    found = blocks.groupBy(*by).cogroup(batches.groupBy(*by)).applyInArrow(meet, kind)
    order = Window.partitionBy("batch", "row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def report(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``."""
    index = build_index(df, F.col(key) % every == 0, key, vector)
    if index.isEmpty():
        kind = "query_id bigint, rank int, vec_id bigint, score bigint"
        return df.sparkSession.createDataFrame([], kind)
    return search(index, k)
