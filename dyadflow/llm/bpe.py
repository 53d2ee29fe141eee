"""Byte-pair encoding and decoding of whole texts: speculate, verify, merge exactly what fails.

A text falls into chunks at white space, and merges never cross a word, so the distinct chunks of a
batch are coded once. Every distinct word is first cut greedily into the longest tokens that match.
A sequence of tokens is what the merges would give exactly when every two neighbours are compatible,
that is when no merge across their border comes before the merges that built them, and when each token
encodes to itself. All distinct neighbours of a batch are checked at once: both are taken apart along
the border, the later merge first, and each pair of parts is looked up among the merges. Words with a
pair that fails are merged step by step, and only these.

That rests on a vocabulary in which a merge comes after those of its parts and each token has one
merge; any other is coded by exact merging alone. Byte-level vocabularies with an end-of-word mark are
read, with or without white space folded away; other pipelines raise an error.

A null text is empty: no ids, decoded to an empty text. White space alone gives no ids. Repeated rows
are coded each. Empty tables give none. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.session import ship_package

VOCABULARY = "word_bpe_49k.json"
CHUNKS_KEPT = 200_000  # distinct chunks a task remembers; beyond that it starts anew
LONGEST_KEPT = 64  # characters of a chunk worth remembering
OPENING = 4  # letters that tell how long the tokens are that start with them
SCANNED = 32  # symbols of a word whose merges are found by scanning it; longer ones keep a heap
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python, not to the vocabulary's rules
_ASCII_SPACE = re.compile(r"[ \t\n\r\f\v]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> str:
    """The letter for each byte: printable Latin-1 stands for itself, the rest for code points from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in set(own) else chr(next(spare)) for b in range(256))


class Merges:
    """The merge table of a vocabulary file, and what greedy matching and its check need of it."""

    def __init__(self, model: dict):
        import numpy as np

        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        size = max(vocab.values()) + 1
        self.rank_of: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.proper = True
        for rank, (a, b) in enumerate(model["merges"]):
            x, y, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank_of.setdefault((x, y), (rank, whole))
            self.proper &= self.rank[whole] < 0
            self.rank[whole], self.left[whole], self.right[whole] = rank, x, y
        made = self.rank >= 0
        self.proper &= bool((self.rank[self.left[made]] < self.rank[made]).all())
        self.proper &= bool((self.rank[self.right[made]] < self.rank[made]).all())
        self.ranks = {pair: rank for pair, (rank, _) in self.rank_of.items()}
        self.whole = {rank: whole for rank, whole in self.rank_of.values()}
        self.never = len(model["merges"])
        keys = np.array([x * size + y for x, y in self.rank_of], dtype=np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.key_rank = np.array([r for r, _ in self.rank_of.values()], dtype=np.int64)[order]
        self.symbols = {t: i for t, i in vocab.items() if len(t.removesuffix(self.end)) == 1}
        sound = self._sound()
        # tokens that end a word, without the mark, and those that do not
        self.final = {t.removesuffix(self.end): i for t, i in vocab.items() if t.endswith(self.end) and sound[i]}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.end) and sound[i]}
        self.longest = max(map(len, vocab))
        # how far a token goes that starts with these letters; no longer ones need be tried
        self.reach: dict[str, int] = {}
        for token in self.inner:
            start = token[:OPENING]
            self.reach[start] = max(len(token), self.reach.get(start, 0))

    def _sound(self):
        """Whether each token encodes to itself: both parts do, and their border holds until they merge."""
        import numpy as np

        made = np.flatnonzero(self.rank >= 0)
        held = self.compatible(self.left[made], self.right[made], self.rank[made])
        sound = np.ones(self.size, dtype=bool)
        for token, fine in zip(made[np.argsort(self.rank[made])], held[np.argsort(self.rank[made])], strict=True):
            sound[token] = fine and sound[self.left[token]] and sound[self.right[token]]
        return sound

    def compatible(self, a, b, until=None):
        """For arrays of neighbours, whether no merge across the border comes first.

        ``until`` limits this to merges below that rank. A merge that ties with one to its left comes later,
        with one to its right first.
        """
        import numpy as np

        never = np.iinfo(np.int64).max
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(x), never) if until is None else until.astype(np.int64)
        x_gone, y_gone = limit.copy(), np.where(limit == never, never, limit - 1)
        fine, live = np.ones(len(x), dtype=bool), np.arange(len(x))
        while len(live):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.key_rank[at], never)
            bad = (rank < x_gone) & (rank <= y_gone) & (rank != never)
            fine[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go_on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go_on], x[go_on], y[go_on], rx[go_on], ry[go_on]
            apart = rx > ry
            x_gone, y_gone = np.where(apart, rx, x_gone[go_on]), np.where(apart, y_gone[go_on], ry)
            x, y = np.where(apart, self.right[x], x), np.where(apart, y, self.left[y])
        return fine

    def greedy(self, word: str) -> list[int]:
        """The longest token at each place; nothing if a symbol is missing from the vocabulary."""
        whole = self.final.get(word)
        if whole is not None:
            return [whole]
        out, at, size = [], 0, len(word)
        inner, final, reach = self.inner.get, self.final.get, self.reach.get
        while at < size:
            if at + self.longest >= size:
                token = final(word[at:])
                if token is not None:
                    out.append(token)
                    return out
            # tokens shorter than an opening have an entry of their own, if any
            end = min(at + reach(word[at : at + OPENING], OPENING - 1), size - 1)
            while end > at:
                token = inner(word[at:end])
                if token is not None:
                    break
                end -= 1
            else:
                return []
            out.append(token)
            at = end
        return out

    def exact(self, word: str) -> list[int]:
        """The merges themselves, lowest rank first and leftmost among equals."""
        letters = [*word[:-1], word[-1] + self.end]
        ids = [self.symbols[s] for s in letters if s in self.symbols]  # unknown symbols are dropped
        if len(ids) <= SCANNED:
            return self._scanned(ids)
        size = len(ids)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        look = self.rank_of.get
        heap = [(found[0], i, found[1]) for i in range(size - 1) if (found := look((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, whole = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= size or look((ids[i], ids[j])) != (rank, whole):
                continue  # a part has merged otherwise since
            ids[i], ids[j] = whole, -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
                if found := look((whole, ids[after[i]])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if before[i] >= 0 and (found := look((ids[before[i]], whole))):
                heapq.heappush(heap, (found[0], before[i], found[1]))
        return [i for i in ids if i >= 0]

    def _scanned(self, ids: list[int]) -> list[int]:
        """``exact`` of a short word's symbols: the lowest rank is looked for anew after each merge."""
        look, never = self.ranks.get, self.never
        ranks = [look(pair, never) for pair in itertools.pairwise(ids)]
        while ranks and (rank := min(ranks)) != never:
            at = ranks.index(rank)  # leftmost among equals
            ids[at] = self.whole[rank]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = look((ids[at - 1], ids[at]), never)
            if at < len(ranks):
                ranks[at] = look((ids[at], ids[at + 1]), never)
        return ids

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, written in byte letters."""
        import numpy as np

        if not self.proper:
            return [self.exact(w) for w in words]
        guessed = [self.greedy(w) for w in words]
        sizes = np.array([len(g) for g in guessed])
        flat = np.fromiter((i for g in guessed for i in g), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = owner[1:] == owner[:-1]
        pairs, place = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        broken = ~self.compatible(pairs // self.size, pairs % self.size)[place]
        for number in {*owner[1:][inside][broken].tolist(), *np.flatnonzero(sizes == 0).tolist()}:
            guessed[number] = self.exact(words[number])
        return guessed


class Coder:
    """Encodes and decodes by the vocabulary file at ``path``."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        model = own["model"]
        split = own["pre_tokenizer"]["pretokenizers"]
        plain = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") and own["decoder"] is None
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and [s["type"] for s in split] == ["Split", "ByteLevel"] and not split[1]["add_prefix_space"]
            and [n["type"] for n in own["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in own["added_tokens"])
        )
        if not plain:
            raise ValueError(f"not a lower-casing byte-level vocabulary with an end-of-word mark: {path}")
        self.merges = Merges(model)
        library = Tokenizer.from_file(path)  # its rules for letters and cases, not its model
        self.normal, self.splitter = library.normalizer, library.pre_tokenizer
        # the pattern's classes as they are for ASCII, lower case
        classes = split[0]["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self.ascii_words = re.compile(classes, re.ASCII)
        # letters alone are one word, where all that is tried before starts with an apostrophe
        before, found, _ = f"|{classes}|".partition("|[a-z]+|")
        self.whole_words = bool(found) and all(part[:1] == "'" for part in before[1:].split("|") if before)
        self.letters = dict(enumerate(byte_letters()))
        self.special = {t["content"]: t["id"] for t in own["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        size = 1 + max(*model["vocab"].values(), *self.special.values())
        names = [b""] * size
        for token, number in {**model["vocab"], **self.special}.items():
            names[number] = token.encode()
        self.names = names
        self.u4 = np.dtype("<u4")
        self.chunks: dict[str, bytes] = {}

    def _words(self, chunk: str) -> list[str]:
        if chunk.isascii():
            lower = chunk.lower()
            if self.whole_words and lower.isalpha():
                return [lower]
            found = self.ascii_words.findall(lower)
            return [w if w.isprintable() else w.translate(self.letters) for w in found]
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normal.normalize_str(chunk))]

    def _split(self, text: str) -> list[str]:
        return _ASCII_SPACE.split(text) if _SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        import numpy as np

        if len(self.chunks) > CHUNKS_KEPT:
            self.chunks = {}
        parted = [self._split(t) if t else [] for t in texts]
        known = self.chunks
        fresh = [c for c in set().union(*parted) if c not in known]
        parts: list[list[str | int]] = []
        for chunk in fresh:
            if "<" in chunk and self.specials.search(chunk):
                pieces = self.specials.split(chunk)
                parts.append([p for piece in pieces if piece for p in (
                    [self.special[piece]] if piece in self.special else self._words(piece))])
            else:
                parts.append(self._words(chunk))
        words = list({p for own in parts for p in own if isinstance(p, str)})
        coded: dict[str | int, bytes] = {}
        if words:
            ids = self.merges.encode(words)
            flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=self.u4).tobytes()
            ends = list(itertools.accumulate((4 * len(i) for i in ids), initial=0))
            coded = {w: flat[a:b] for w, a, b in zip(words, ends, ends[1:], strict=False)}
        coded |= {number: number.to_bytes(4, "little") for number in self.special.values()}
        passing = {}
        for chunk, own in zip(fresh, parts, strict=True):
            target = known if len(chunk) <= LONGEST_KEPT else passing
            target[chunk] = coded[own[0]] if len(own) == 1 else b"".join(map(coded.__getitem__, own))
        if not passing:
            return [b"".join(map(known.__getitem__, own)) for own in parted]
        return [b"".join(known[c] if c in known else passing[c] for c in own) for own in parted]

    def decode(self, ids: bytes) -> bytes:
        """The tokens of the ids with a space between them, as UTF-8: a vocabulary without a decoder."""
        import numpy as np

        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, self.u4).tolist()))


def _batches(batch, texts_column: int, at_once: int = 1 << 22):
    """Slices of a batch with about ``at_once`` bytes of text, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(texts_column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for number, size in enumerate(sizes.tolist()):
        if held and held + size > at_once:
            yield batch.slice(start, number - start)
            start, held = number, 0
        held += size + 1
    if start < batch.num_rows:
        yield batch.slice(start)


def _kind(df: DataFrame, key: str) -> str:
    return df.select(key).schema[0].dataType.simpleString()


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids) of each row; special tokens in a text count as such, none are added."""
    ship_package(df.sparkSession)
    path = vocabulary or vocabulary_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        coder = Coder(path)
        for batch in batches:
            for part in _batches(batch, 1):
                ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in coder.encode(part.column(1).to_pylist())]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {_kind(df, key)}, ids array<int>")


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(key, text) of rows with ids; null ids give an empty text, ids beyond the vocabulary an error."""
    ship_package(df.sparkSession)
    path = vocabulary or vocabulary_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        coder = Coder(path)
        for batch in batches:
            texts = [coder.decode(np.array(i or [], dtype="<u4").tobytes()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=[key, "text"]
            )

    return df.select(key, F.col(ids).cast("array<bigint>")).mapInArrow(run, f"`{key}` {_kind(df, key)}, text string")


def report(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again."""
    ship_package(df.sparkSession)
    path = vocabulary or vocabulary_path()

    def run(batches):
        import pyarrow as pa

        coder = Coder(path)
        for batch in batches:
            for part in _batches(batch, 1):
                ids = coder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                        pa.array([hashlib.sha256(coder.decode(i)).hexdigest() for i in ids]),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(key, text).mapInArrow(
        run, f"`{key}` {_kind(df, key)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
