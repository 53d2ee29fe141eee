"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents are tokenised once, cut only if longer than a sequence, and their pieces written without the
tokens, range-sorted by length and ranked within it, so that a row of (length, first rank, how many)
stands for all pieces of a length, and one of (size, first sequence, how many) for gaps of one size. Rounds
go over a written table of such rows, the longest pieces first, a band of lengths after the other. A round
sorts pieces and gaps together by size and sweeps them: each piece that wins takes the smallest gap that
fits, conflicts over a gap are settled by rank, longer pieces first, so that losers are the shorter ones.
Gaps are updated by what they took, and the next round follows with the pieces left. Sequences are opened
only for pieces longer than every gap, as many as their tokens fill. Every round places the longest piece
left at least, and usually one or more for every gap that some piece fits.

A round has at most one row for each length, and adds at most a few rows of gaps for each, so a sweep and
the runs of places that come to the driver are bounded by capacity and rounds, not by the documents. Sweeps
go by ranges from ``range_rows`` rows on.

A null text is empty: a document of one end token. Empty tables give no rows; repeated rows are packed
each; other columns play no part.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.llm.ranges import prefix_sum, range_sorted
from dyadflow.session import ship_package
from dyadflow.staging import stage

CAPACITY = 2_048
END = 0
#: A band holds pieces longer than its upper end divided by this. Bears on the number of rounds.
BAND = 2
#: A band's last pieces, fewer than one in so many, are left to the next band. Bears on the number of rounds.
HANDED_ON = 10
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The vocabulary's special token, and its word pattern for texts in which white space
#: stands alone. There the full pattern's two rules for runs of white space come to one.
SPECIAL = {"<|endoftext|>": 50_256}
SINGLE_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_RUN = re.compile(r"\s\s")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Tokenizer:
    """Ids of the byte-level vocabulary at ``path`` (a file of ranks)."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        make = lambda name, pattern: tiktoken.Encoding(
            name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
        self.plain = make("single-spaced", SINGLE_SPACED)
        self.full = make("full", public_tokenizers.PATTERN)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of the whole text and the end token, as little-endian unsigned 32-bit numbers."""
        if not text:
            return np.array([END], dtype="<u4")
        coder = self.full if _RUN.search(text) else self.plain
        found = coder.encode_to_numpy(text, allowed_special="all")
        return np.append(found, END).astype("<u4")


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of a document: full ones, and the rest in front."""
    if length <= capacity:
        return [0]
    first = length % capacity or capacity
    return [0, *range(first, length, capacity)]


def pieces(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every row; ``with_ids`` adds the tokens as ``ids``."""
    ship_package(df.sparkSession)
    path = vocabulary or vocabulary_path()
    source = df.select(key, text)
    kind = source.schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches):
        import pyarrow as pa

        coder = Tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                owner, rows, tokens = [], [], []
                for number, cell in enumerate(part.column(1)):
                    ids = coder.ids(cell.as_py())
                    starts = cuts(len(ids), capacity)
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        own = ids[a:b]
                        owner.append(number)
                        rows.append((piece, a, b - a, zlib.crc32(own.tobytes())))
                        tokens.append(own)
                numbers, starts_, lengths, sums = zip(*rows, strict=True)
                columns = [
                    part.column(0).take(pa.array(owner)), pa.array(numbers, pa.int32()),
                    pa.array(starts_, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(tokens, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema + (", ids array<bigint>" if with_ids else ""))


#: Rows a range of a sweep holds. Bears on the layout only.
RANGE_ROWS = 1_000_000

LINE = ("kind", "item", "turn", "size", "free", "many")
SWEPT = "kind int, item bigint, turn int, size bigint, free bigint, many bigint, won bigint, place bigint"
#: What a round writes. Kind 0: ``many`` pieces of length ``size`` left, from rank ``first`` on. Kind 1: ``many``
#: sequences from ``first`` on with a gap of ``size``. Kind 2: ``many`` pieces of length ``size`` from rank
#: ``first`` on, ``each`` to a sequence, from ``sequence_id`` on at ``offset``.
ROUND = "kind int, size bigint, first bigint, many bigint, each bigint, sequence_id bigint, offset bigint"
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _sweep(table, before: tuple[int, int, int] = (0, 0, 0), later: int = _MOST):
    """One range of pieces and slots in descending size: who gets a slot, and which.

    ``before`` holds pieces, slots and the peak of the excess before the range, ``later`` the least
    spare slots behind it. Returns the sorted columns, with how many pieces of a row win and the first
    place, and what the range adds to either.
    """
    kind, item, turn, size, free, many = (table.column(n).to_numpy().astype(np.int64) for n in LINE)
    pieces_before, slots_before, peak = before
    order = np.lexsort((turn, item, -kind, -size))
    kind, item, turn, size, free, many = (a[order] for a in (kind, item, turn, size, free, many))
    doc = kind == 0
    own, offered = many * doc, many * ~doc
    slots = slots_before + np.cumsum(offered) - offered  # slots before each row
    number = pieces_before + np.cumsum(own) - own  # pieces before each row
    excess = np.where(doc, number + many - slots, _LEAST)
    highest = np.maximum.accumulate(np.append(max(peak, 0), excess))[:-1]
    won = np.where(doc, np.clip(highest + slots - number, 0, many), 0)
    rank = number - highest
    spare = np.where(won > 0, slots - (rank + won - 1), _MOST)
    least = np.minimum.accumulate(np.append(spare, later)[::-1])[::-1][:-1]
    place = np.where(doc, rank - 1 + np.where(won > 0, least, 0), slots)
    return (kind, item, turn, size, free, many, won, place), int(excess.max()), int(spare.min())


def _swept(columns):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
    names = [*LINE, "won", "place"]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def match(line: DataFrame, ranges: int = 1, losers: bool = False) -> DataFrame:
    """Sweep pieces and slots: ``SWEPT``, pieces that lose left out unless ``losers``.

    ``line`` holds (kind, item, turn, size, free, many): kind 0 ``many`` pieces of ``size``, kind 1 as many
    slots; one each if there is no ``many``. A row takes the places from ``place`` on, a piece and a slot of
    one place belong together. Where slots run short the longer pieces have them; of the pieces that win,
    in ascending order, each has the smallest slot that fits and that no shorter one holds. Both follow
    from running counts and extremes over the sorted line: a piece of rank r with S slots as large as
    itself wins unless r + 1 - S tops all before, and takes slot r - 1 + min(S' - r') over itself and the
    shorter winners. With several ranges every range is swept by a task of its own and hands one row of
    counts on to the next.
    """
    import pyarrow as pa

    if "many" not in line.columns:
        line = line.withColumn("many", F.lit(1).cast("bigint"))
    before: dict[int, tuple[int, int, int]] = {}
    later: dict[int, int] = {}
    if ranges > 1:
        order = [F.desc("size"), F.desc("kind"), "item", "turn"]
        placed = line.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id())
        line = stage(placed, "line")  # borders come from a sample: all passes must see the same

        def summary(table):
            own = table.column("_part")[0].as_py()
            (kind, _, _, _, _, many, _, _), peak, _ = _sweep(table)
            docs = int(many[kind == 0].sum())
            return pa.table(
                {"part": pa.array([own], pa.int32()), "docs": pa.array([docs], pa.int64()),
                 "slots": pa.array([int(many.sum()) - docs], pa.int64()),
                 "peak": pa.array([peak if docs else None], pa.int64())}
            )

        found = line.groupBy("_part").applyInArrow(summary, "part int, docs bigint, slots bigint, peak bigint")
        docs = slots = peak = 0
        for r in sorted(found.collect(), key=lambda r: r.part):  # one row for each range
            before[r.part] = (docs, slots, peak)
            if r.peak is not None:
                peak = max(peak, r.peak + docs - slots)
            docs, slots = docs + r.docs, slots + r.slots

        def fewest(table):
            own = table.column("_part")[0].as_py()
            _, _, spare = _sweep(table, before[own])
            return pa.table({"part": pa.array([own], pa.int32()), "spare": pa.array([spare], pa.int64())})

        least = _MOST
        rows = line.groupBy("_part").applyInArrow(fewest, "part int, spare bigint").collect()
        for r in sorted(rows, key=lambda r: -r.part):
            later[r.part] = least
            least = min(least, r.spare)
    else:
        line = line.withColumn("_part", F.lit(0))

    def sweep(table):
        own = table.column("_part")[0].as_py()
        columns, _, _ = _sweep(table, before.get(own, (0, 0, 0)), later.get(own, _MOST))
        keep = (columns[0] == 1) | (columns[6] > 0) | losers
        return _swept([c[keep] for c in columns])

    return line.groupBy("_part").applyInArrow(sweep, SWEPT)


def _filled(columns, capacity: int):
    """``ROUND`` rows from a swept line: winners put into their slots, losers and gaps as they are left."""
    import pyarrow as pa

    winners, slots, out, gaps = [], [], [], []
    for kind, item, turn, size, free, many, won, place in zip(*(c.tolist() for c in columns), strict=True):
        if kind == 1:
            slots.append((place, item, turn, free, many))
            continue
        if won:
            winners.append((place, size, item, won))
        if many > won:
            out.append((0, size, item + won, many - won, 0, 0, 0))
    winners.sort(reverse=True)
    for start, first, turns, gap, many in sorted(slots):
        end, fresh, part, used = start + many, 0, None, 0  # sequences before ``fresh`` are done with
        while winners and winners[-1][0] < end:
            place, length, rank, left = winners.pop()
            if left > end - place:
                winners.append((end, length, rank + end - place, left - (end - place)))
                left = end - place
            at = place - start
            while left:
                own, turn = divmod(at, turns)
                if part is not None and part != own:
                    gaps.append((gap - used, first + part, 1))
                    part, used = None, 0
                if part is None:
                    gaps.append((gap, first + fresh, own - fresh))
                whole = turn == 0 and left >= turns
                number, each = (left // turns, turns) if whole else (1, min(turns - turn, left))
                out.append((2, length, rank, number * each, each, first + own, capacity - gap + used))
                if whole:
                    gaps.append((gap - turns * length, first + own, number))
                else:
                    part, used = own, used + each * length
                fresh = own + number
                at, rank, left = at + number * each, rank + number * each, left - number * each
        if part is not None:
            gaps.append((gap - used, first + part, 1))
        gaps.append((gap, first + fresh, many // max(turns, 1) - fresh))
    merged: list[list[int]] = []
    for size, first, many in sorted(g for g in gaps if g[0] and g[2]):
        if merged and merged[-1][0] == size and merged[-1][1] + merged[-1][2] == first:
            merged[-1][2] += many
        else:
            merged.append([size, first, many])
    out += [(1, *g, 0, 0, 0) for g in merged]
    names = [c.split()[0] for c in ROUND.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 6]
    rows = zip(*out, strict=True) if out else [[]] * len(names)
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, rows, kinds, strict=True)})


def _round(state: DataFrame, top: int, lower: int, ranges: int, capacity: int) -> DataFrame:
    """``ROUND`` after one round over the pieces and gaps above ``lower``; the others stay as they are."""
    import pyarrow as pa

    # a gap offers a slot of its whole size, or several that hold the longest piece each
    turns = f"CASE WHEN kind = 0 THEN 1 ELSE CAST(greatest(floor(size / {top}), 1) AS INT) END"
    line = state.where(f"size > {lower}").selectExpr(
        "kind", "first AS item", f"{turns} AS turn", f"CASE WHEN {turns} = 1 THEN size ELSE {top}L END AS size",
        "size AS free", f"many * {turns} AS many",
    )
    idle = state.where(f"size <= {lower}").selectExpr("*", "0L AS each", "0L AS sequence_id", "0L AS offset")

    def run(batches):
        got = list(batches)
        if got:
            table = pa.Table.from_batches(got)
            if "place" in table.column_names:
                columns = [table.column(n).to_numpy() for n in [*LINE, "won", "place"]]
            else:
                columns = _sweep(table)[0]
            yield from _filled(columns, capacity).to_batches()

    swept = line if ranges == 1 else match(line, ranges, losers=True)
    return swept.coalesce(1).mapInArrow(run, ROUND).unionByName(idle).coalesce(1)


def _sums(state: DataFrame, lower: int):
    """Of pieces and gaps above ``lower``: longest piece, widest gap, pieces, rows."""
    sums = [F.expr(f"{s} FILTER (WHERE kind = {k})") for s, k in (("max(size)", 0), ("max(size)", 1), ("sum(many)", 0))]
    return state.where(f"size > {lower}").agg(*sums, F.count(F.lit(1))).first()


def rounds(counts: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows of kind 2 (``ROUND``) for all pieces, from ``counts`` (length, count)."""
    spark = counts.sparkSession
    lasting, opened, upper = [], 0, capacity
    state = counts.selectExpr("0 AS kind", "length AS size", "0L AS first", "count AS many").coalesce(1)
    state = stage(state, "left")
    while upper:
        lower, started = upper // BAND, None
        while True:
            top, widest, many, lines = _sums(state, lower)
            started = many if started is None else started
            if not many or (lower and many * HANDED_ON < started):
                break
            if widest is None or widest < top:  # the pieces that fit nowhere open sequences
                over = state.where(f"kind = 0 AND size > {max(widest or 0, lower)}")
                fresh = -(-over.agg(F.sum(F.col("size") * F.col("many"))).first()[0] // capacity)
                more = spark.range(0, 1, 1, 1).selectExpr(
                    "1 AS kind", f"{capacity}L AS size", f"{opened}L AS first", f"{fresh}L AS many"
                )
                state, opened = state.unionByName(more), opened + fresh
                lines += 1
            done = stage(_round(state, top, lower, -(-lines // range_rows), capacity), "round")
            lasting.append(done.where("kind = 2"))
            state = done.where("kind < 2").select("kind", "size", "first", "many")
        upper = lower
    if not lasting:
        return spark.createDataFrame([], ROUND)
    return functools.reduce(DataFrame.unionByName, lasting)


def _place(ranked: DataFrame, runs: list) -> DataFrame:
    """Append sequence_id and offset to rows with ``length`` and ``rank``, which goes."""
    columns = np.array([tuple(r)[1:] for r in runs], dtype=np.int64).reshape(-1, 6)
    length, first, many, each, sequence, offset = columns[np.lexsort((columns[:, 1], columns[:, 0]))].T
    starts = np.cumsum(many) - many  # a piece's number: its rank, and all pieces of smaller lengths
    lengths, at_first = np.unique(length, return_index=True)
    below = starts[at_first]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            number = below[np.searchsorted(lengths, own)] + rank
            found = np.searchsorted(starts, number, side="right") - 1
            turn = rank - first[found]
            placed = [sequence[found] + turn // each[found], offset[found] + turn % each[found] * own]
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in keep], *map(pa.array, placed)], names=[*keep, "sequence_id", "offset"]
            )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(run, ", ".join([*kinds, "sequence_id bigint", "offset bigint"]))


def best_fit(items: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``items`` with sequence_id and offset: ranks within lengths, rounds, places; see the module.

    ``length`` is 1 to ``capacity``; the other columns order the pieces of one length.
    """
    order = ["length", *[c for c in items.columns if c != "length"]]
    ranged = range_sorted(items, order, "sorted")
    runs = rounds(ranged.groupBy("length").count(), capacity, range_rows).collect()
    ranked = prefix_sum(ranged, ["length"], order[1:], F.lit(1), "rank")
    return _place(ranked.select(*items.columns, F.col("rank").cast("bigint").alias("rank")), runs)


def pack(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    vocabulary: str | None = None, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stage(pieces(df, key, text, capacity, vocabulary), "pieces")  # sorting reads them twice
    return best_fit(cut, capacity, range_rows)
