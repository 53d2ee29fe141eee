"""Media columns: AVI files of motion-JPEG frames, their intra frames, and shots.

``store`` writes any bytes losslessly as a grey 24 x 24 motion-JPEG: 576 payload bytes a frame. The unit
is the quantised coefficient: JPEG codes a coefficient of 8 bits as its category and 8 more bits, and
every byte names one of the 256 values of that category. Both Huffman tables hold that one category, every
block is a restart interval, so a block is 64 pairs of a code byte and a payload byte.

``read_back`` parses the RIFF chunks and the index, decodes the frames (any baseline grey or colour JPEG
with one scan; of colours, the luminance), and detects shots: a frame starts one when its histogram
differs from the frame's before by more than mean and ``SIGMAS`` deviations of the differences in the
``WINDOW`` frames before it, and by ``LEAST`` at least. At the first frame of a shot the differences at the end
of the shots before count, and where there are none yet the limit is ``ALONE``. Further ``AVIX`` parts and
``rec `` lists are read in order. ``clips`` lists the shots as timed rows.

Null texts count as empty and give a frame of padding; null media give null results; empty tables give no
rows; equal bytes give equal results; other columns play no part. Files that are not AVI raise an error.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.session import ship_package

SIDE = 24
FRAME = SIDE * SIDE
FRAME_MS = 40
BINS = 16
WINDOW = 8
SIGMAS = 3.0
LEAST = 0.15
ALONE = 0.5  # the limit before any difference within a shot is known
ROWS = 64  # documents of an Arrow batch that carries media


@functools.cache
def zigzag() -> np.ndarray:
    """Place in an 8 x 8 block (row by row) of each coefficient in coded order."""
    diagonal = lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0])
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=diagonal)
    return np.array([8 * y + x for y, x in cells])


@functools.cache
def inverse_dct() -> np.ndarray:
    """Matrix from coefficients in coded order to pixels."""
    n = np.arange(8)
    wave = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) * np.where(n == 0, 2**-0.5, 1) / 2
    return np.kron(wave, wave)[:, zigzag()].T.astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@functools.cache
def _jpeg_head() -> bytes:
    table = bytes([0] * 7 + [1] + [0] * 8 + [8])  # one code of 8 bits, for 8 further bits
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, bytes([0] + [1] * 64)),
            _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + table + b"\x10" + table),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def padded(payload: bytes) -> bytes:
    return payload + b"\xff" * (-len(payload) % FRAME or (0 if payload else FRAME))


def encode(payload: bytes) -> bytes:
    """AVI of ``payload``, whose length is a multiple of ``FRAME``."""
    blocks = FRAME // 64
    cells = np.zeros((len(payload) // FRAME, blocks, 130), dtype=np.uint8)
    cells[:, :, 1:128:2] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, blocks, 64)
    cells[:, :, 128] = 0xFF
    cells[:, :, 129] = 0xD0 + np.arange(blocks) % 8
    cells[:, -1, 129] = 0xD9
    frames, head = [], _jpeg_head()
    stuffed = (cells[:, :, 1:128:2] == 0xFF).any(axis=(1, 2))
    for own, full in zip(cells, stuffed, strict=True):
        if not full:
            frames.append(head + own.tobytes())
            continue
        coded = [b[:128].tobytes().replace(b"\xff", b"\xff\0") + b[128:].tobytes() for b in own]
        frames.append(head + b"".join(coded))
    movi = [b"movi"]
    index, at = [], 4
    for frame in frames:
        movi.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movi[-1])
    most = max(map(len, frames))
    header = struct.pack("<14I", FRAME_MS * 1000, 0, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack(
        "<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MS, 1000, 0, len(frames), most,
        0xFFFFFFFF, 0, 0, 0, SIDE, SIDE,
    )
    bitmap = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", FRAME, 0, 0, 0, 0)
    lists = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap))
    body = b"".join(
        [
            b"AVI ", _chunk(b"LIST", b"hdrl" + _chunk(b"avih", header) + lists),
            _chunk(b"LIST", b"".join(movi)), _chunk(b"idx1", b"".join(index)),
        ]
    )
    return _chunk(b"RIFF", body)


def _in_order(media: bytes, at: int, end: int) -> list[bytes]:
    """Coded frames of a list of chunks, those within ``rec `` lists too."""
    found = []
    while at + 8 <= end:
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"LIST" and media[at + 8 : at + 12] == b"rec ":
            at += 12
            continue
        if name[2:] in (b"dc", b"db"):
            found.append(media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return found


def frames_of(media: bytes) -> tuple[list[bytes], int]:
    """Coded frames in order, and microseconds a frame.

    The index orders the frames of the first part; without one, and in further parts, the chunks do.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micros, lists, index, at = FRAME_MS * 1000, [], None, 12
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"RIFF" and media[at + 8 : at + 12] == b"AVIX":
            at += 12
            continue
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            lists.append((at + 8, at + 8 + size))
        elif name == b"LIST" and media[at + 12 : at + 16] == b"avih":
            (micros,) = struct.unpack_from("<I", media, at + 20)
        elif name == b"idx1":
            index = np.frombuffer(media, dtype="<u4", count=size // 16 * 4, offset=at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if not lists:
        raise ValueError("no frames in this AVI file")
    frames = []
    if index is not None:
        base = lists.pop(0)[0]
        video = [(o, n) for c, _, o, n in index.tolist() if c >> 16 & 0xFFFF in (0x6364, 0x6264)]
        if video and video[0][0] >= base:  # some writers count from the start of the file
            base = 0
        frames = [media[base + o + 8 : base + o + 8 + n] for o, n in video]
    for start, end in lists:
        frames += _in_order(media, start + 4, end)
    return frames, micros


@functools.lru_cache(maxsize=64)
def _parse(head: bytes) -> dict:
    """Tables of a JPEG header that ends before the coded data."""
    info: dict = {"quant": {}, "codes": {}, "restart": 0}
    at = 2
    while at + 4 <= len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                kind = ">u2" if wide else "u1"
                info["quant"][body[0] & 15] = np.frombuffer(body, kind, 64, 1).astype(np.int32)
                body = body[65 + 64 * bool(wide) :]
        elif marker == 0xC4:
            while body:
                counts, table, code, place = body[1:17], {}, 0, 17
                for bits, many in enumerate(counts, 1):
                    for _ in range(many):
                        table[bits, code] = body[place]
                        code, place = code + 1, place + 1
                    code <<= 1
                info["codes"][body[0]] = table
                body = body[place:]
        elif marker in (0xC0, 0xC1):
            info["height"], info["width"], parts = struct.unpack_from(">HHB", body, 1)
            info["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)]
        elif marker == 0xDD:
            (info["restart"],) = struct.unpack(">H", body)
        elif marker == 0xDA:
            info["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline JPEG frames can be decoded")
        at += 2 + size
    one = {(8, 0): 8}
    info["paired"] = (
        info["restart"] == 1 and len(info["parts"]) == 1 and info["codes"].get(0) == one
        and info["codes"].get(16) == one
    )
    return info


def _split(frame: bytes) -> tuple[dict, bytes]:
    """Tables and coded data of a frame."""
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return _parse(frame[:at]), frame[at:]


def _scan(info: dict, coded: bytes) -> np.ndarray:
    """Coefficients of the first component's blocks, block by block in coded order."""
    across = max(h for _, h, _, _ in info["parts"])
    down = max(v for _, _, v, _ in info["parts"])
    single = len(info["parts"]) == 1
    wide, high = (8, 8) if single else (8 * across, 8 * down)
    columns, rows = -(-info["width"] // wide), -(-info["height"] // high)
    first = info["parts"][0]
    many = (1, 1) if single else (first[1], first[2])
    out = np.zeros((rows * many[1], columns * many[0], 64), dtype=np.int32)
    intervals, start, at = [], 0, 0
    while (at := coded.find(b"\xff", at)) >= 0 and at + 1 < len(coded):
        if coded[at + 1] == 0:
            at += 2
            continue
        intervals.append(coded[start:at].replace(b"\xff\0", b"\xff"))
        start = at = at + 2
        if coded[at - 1] == 0xD9:
            break
    unit, total = 0, rows * columns
    for data in intervals:
        bits, place = int.from_bytes(data, "big"), 0
        end = 8 * len(data)

        def take(n: int) -> int:
            nonlocal place
            place += n
            return bits >> (end - place) & ((1 << n) - 1) if place <= end else 0

        def symbol(table: dict) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("damaged JPEG frame")

        def value(n: int) -> int:
            raw = take(n)
            return raw if not n or raw >> (n - 1) else raw - (1 << n) + 1

        previous = {p[0]: 0 for p in info["parts"]}
        for _ in range(min(info["restart"] or total, total - unit)):
            for name, h, v, _ in info["parts"]:
                dc, ac = info["scan"][name]
                for sub in range(1 if single else h * v):
                    block = np.zeros(64, dtype=np.int32)
                    previous[name] += value(symbol(info["codes"][dc]))
                    block[0] = previous[name]
                    k = 1
                    while k < 64:
                        run, size = divmod(symbol(info["codes"][16 + ac]), 16)
                        if not size:
                            if run < 15:
                                break
                            k += 16
                            continue
                        k += run
                        block[k] = value(size)
                        k += 1
                    if name == first[0]:
                        y, x = unit // columns * many[1] + sub // h, unit % columns * many[0] + sub % h
                        out[(unit // columns, unit % columns) if single else (y, x)] = block
            unit += 1
    return out


def coefficients(frame: bytes) -> tuple[np.ndarray, dict]:
    """(block rows, block columns, 64) coefficients of the luminance, and the header's tables."""
    info, coded = _split(frame)
    if not info["paired"]:
        return _scan(info, coded), info
    data = np.frombuffer(coded.replace(b"\xff\0", b"\xff"), dtype=np.uint8).reshape(-1, 130)
    signed = data[:, 1:128:2].astype(np.int32)
    signed -= 255 * (signed < 128)
    return signed.reshape(-(-info["height"] // 8), -(-info["width"] // 8), 64), info


def pixels(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Luminance (…, 64) of blocks, 0 to 255."""
    light = (blocks * quant).astype(np.float32).reshape(-1, 64) @ inverse_dct()
    return np.clip(np.rint(light) + 128, 0, 255).astype(np.uint8).reshape(blocks.shape)


def starts(histograms: np.ndarray) -> list[int]:
    """Frames that start a shot, from rows of shares."""
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    cuts, since, before = [0], 0, change[:0]
    for t, d in enumerate(change.tolist()):
        if t > since:
            before = change[max(since, t - WINDOW) : t]
        limit = before.mean() + SIGMAS * before.std() if len(before) else ALONE
        if d > max(limit, LEAST):
            cuts.append(t + 1)
            since = t + 1
    return cuts


def inspect(media: bytes) -> dict:
    """Payload and shots of an AVI: payload, frames, clips of (start_ms, end_ms, frames, luminance)."""
    coded, micros = frames_of(media)
    payload, shares, light = [], [], []
    for at in range(0, len(coded), 1_024):
        found = [coefficients(f) for f in coded[at : at + 1_024]]
        same = len({id(info) for _, info in found}) == 1
        for group in [found] if same else [[f] for f in found]:
            blocks = np.stack([b for b, _ in group])
            info = group[0][1]
            payload.append((blocks & 0xFF if not info["paired"] else np.where(blocks < 0, blocks + 255, blocks)).astype(np.uint8).tobytes())
            lit = pixels(blocks, info["quant"][info["parts"][0][3]]).reshape(len(group), -1)
            bins = (lit // (256 // BINS)).astype(np.int64) + BINS * np.arange(len(group))[:, None]
            shares.append(np.bincount(bins.ravel(), minlength=BINS * len(group)).reshape(-1, BINS) / lit.shape[1])
            light.append(lit.mean(axis=1, dtype=np.float64))
    total = len(coded)
    luminance = np.concatenate(light) if light else np.zeros(0)
    cuts = starts(np.vstack(shares)) if shares else []
    clips = [
        (a * micros // 1000, b * micros // 1000, b - a, round(float(luminance[a:b].mean()), 3))
        for a, b in zip(cuts, [*cuts[1:], total], strict=True)
    ]
    return {"payload": b"".join(payload), "frames": total, "clips": clips}


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media) of every row: its text's bytes, padded, as an AVI file."""
    ship_package(df.sparkSession)
    source = df.select(key, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("raw"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                raw = part.column(1).to_pylist()
                media = pa.array([encode(padded(r)) for r in raw], pa.binary())
                sizes = pa.array([len(r) for r in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, media], names=[key, "n_bytes", "media"])

    return source.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, media binary")


RESULT = (
    "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, clips array<struct<start_ms:bigint,end_ms:bigint,frames:bigint,luminance:double>>"
)


def read_back(df: DataFrame, key: str = "doc_id", media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep…, digests of payload and file, clips) of every file."""
    ship_package(df.sparkSession)
    source = df.select(key, *keep, media)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches):
        import pyarrow as pa

        clip = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int64()), ("luminance", pa.float64())]))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), clip]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
        for batch in batches:
            rows = []
            for cell in batch.column(batch.num_columns - 1):
                file = cell.as_py()
                if file is None:
                    rows.append([None] * 6)
                    continue
                seen = inspect(file)
                own = seen["payload"]
                shots = [dict(zip(("start_ms", "end_ms", "frames", "luminance"), c, strict=True)) for c in seen["clips"]]
                rows.append(
                    [len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(file),
                     hashlib.sha256(file).hexdigest(), shots]
                )
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *names]
            )

    return source.mapInArrow(run, f"{kinds}, {RESULT}")


def clips(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Timed rows: key, clip (from 0), start_ms, end_ms, frames, luminance."""
    seen = read_back(df, key, media)
    return seen.select(key, F.posexplode("clips").alias("clip", "_c")).select(key, "clip", "_c.*")


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text stored and read back, with its digests and shots."""
    seen = read_back(store(df, key, text), key, keep=("n_bytes",))
    shots = F.array_join(
        F.transform("clips", lambda c: F.concat_ws(":", c["start_ms"], c["end_ms"], c["luminance"])), ","
    )
    return seen.select(*[c for c in seen.columns if c != "clips"], shots.alias("feature"))
