"""Media columns in Matroska: writing, parsing to packet tables, and reading samples back.

`mux` stores a payload as one track of 8-bit PCM at 8 kHz: frames of FRAME samples, up to LACE of
them laced into a SimpleBlock (fixed lacing for equal sizes, else EBML lacing), CLUSTER frames to
a cluster, and a cue for each cluster. `packets` parses any such file, Xiph lacing and
unknown-size clusters included, to a table of packets: track, timestamp, byte range, keyframe.
`samples` cuts the packets' byte ranges from the stored bytes; nothing else of the file is used.

Defined cases: a null text is the empty text; an empty text is 64 zero bytes; equal texts give
equal media; repeated rows give a row each; an empty table gives an empty result; a file that
ends within an element raises ValueError, as do laced sizes below 0; a null medium has no packets and null
digests; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, FRAME, LACE, CLUSTER = 8000, 1024, 8, 64

# Element ids of the published Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_ID, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

SCALE_NS = 1_000_000


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    cluster: int


class Cue(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int


def _vint(n: int, width: int = 0) -> bytes:
    """A size: a marker bit tells the width; all ones are kept for 'unknown'."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag bits and the head of the lace."""
    if len(frames) == 1:
        return 0, b""
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1])
    head = bytes([len(frames) - 1]) + _vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = 1
        while abs(b - a) >= (1 << 7 * width - 1) - 1:
            width += 1
        head += _vint_signed(b - a, width)
    return 0x06, head


def _vint_signed(n: int, width: int) -> bytes:
    return (n + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


_HEAD = _element(
    EBML,
    _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(MAX_ID_LENGTH, 4) + _uint(MAX_SIZE_LENGTH, 8)
    + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
)
_SETUP = _element(INFO, _uint(TIMESTAMP_SCALE, SCALE_NS) + _element(MUXING_APP, b"tessera") + _element(WRITING_APP, b"tessera")) + _element(
    TRACKS,
    _element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT")
        + _element(AUDIO, _element(SAMPLING_FREQUENCY, np.array(RATE, ">f8").tobytes()) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file whose only track holds the payload's bytes as samples."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    body, cues = [_SETUP], []
    at = len(_SETUP)
    for c in range(0, len(frames), CLUSTER):
        own = frames[c : c + CLUSTER]
        start = c * FRAME * 1000 // RATE
        blocks = []
        for i in range(0, len(own), LACE):
            laced = own[i : i + LACE]
            lacing, head = _lace(laced)
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + (i * FRAME * 1000 // RATE).to_bytes(2, "big", signed=True) + bytes([0x80 | lacing]) + head + b"".join(laced)))
        cluster = _element(CLUSTER_ID, _uint(TIMESTAMP, start) + b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEAD + _element(SEGMENT, b"".join(body) + _element(CUES, b"".join(cues)))


def _read_vint(b: bytes, at: int, *, keep_marker: bool = False) -> tuple[int | None, int]:
    """A value and where it ends; None is an unknown size."""
    if at >= len(b) or not b[at]:
        raise ValueError(f"no element head at byte {at}")
    width = 9 - b[at].bit_length()
    if at + width > len(b):
        raise ValueError(f"the file ends in an element head at byte {at}")
    n = int.from_bytes(b[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(b: bytes, at: int, end: int, *, until: tuple[int, ...] = ()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the bodies of elements from `at` on. An element of unknown size ends where
    the enclosing one does, or, being a cluster, before the next top-level element."""
    while at < end:
        kind, body = _read_vint(b, at, keep_marker=True)
        if kind in until:
            return
        size, body = _read_vint(b, body)
        if size is None:
            to = end
            if kind == CLUSTER_ID:
                to = body
                for _, _, to in elements(b, body, end, until=(CLUSTER_ID, CUES, TRACKS, INFO)):  # noqa: B007
                    pass
        else:
            to = body + size
        if to > end:
            raise ValueError(f"the element at byte {at} goes past byte {end}")
        yield kind, body, to
        at = to


def _number(b: bytes, at: int, end: int) -> int:
    return int.from_bytes(b[at:end], "big")


def _unlaced(b: bytes, at: int, end: int, lacing: int) -> list[int]:
    """Where the frames start, and the end of the last."""
    if not lacing:
        return [at, end]
    # The block alone, so that nothing after its end is taken for a size.
    first, b = at, b[at:end]
    n, at, end = b[0] + 1, 1, len(b)
    sizes: list[int] = []
    if lacing == 1:  # Xiph: bytes of 255 go on
        for _ in range(n - 1):
            size = 0
            while b[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + b[at])
            at += 1
    elif lacing == 3:  # EBML: the first size, then differences
        for i in range(n - 1):
            before = at
            x, at = _read_vint(b, at)
            if x is None:
                x = (1 << 7 * (at - before)) - 1
            sizes.append(x if not i else sizes[-1] + x - ((1 << 7 * (at - before) - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError("frames of fixed lacing don't share the block evenly")
        sizes = [(end - at) // n] * (n - 1)
    if any(s < 0 for s in sizes):
        raise ValueError("a laced frame has a size below 0")
    starts = [at]
    for s in sizes:
        starts.append(starts[-1] + s)
    if starts[-1] > end:
        raise ValueError("laced frames go past the block")
    return [first + x for x in (*starts, end)]


#: What reading a file that isn't well-formed may run into.
_BROKEN = (ValueError, IndexError, KeyError, StopIteration, TypeError, OverflowError, ArithmeticError)


def packets(b: bytes, *, frame_ns: int | None = None) -> tuple[list[Packet], list[Cue]]:
    """The packet table and the cues of a file. Laced frames after the first are frame_ns apart, by default by their size at the track's rate.
    A file that isn't well-formed, or has numbers that no table can hold, is a ValueError."""
    try:
        table, cues = _packets(b, frame_ns)
    except _BROKEN as e:
        raise ValueError(str(e) if isinstance(e, ValueError) else f"not a well-formed file: {type(e).__name__} {e}".rstrip()) from e
    if any(p.track >= 1 << 31 or abs(p.timestamp_ns) >= 1 << 62 for p in table):
        raise ValueError("a track's number or a timestamp is too large")
    return table, cues


def _packets(b: bytes, frame_ns: int | None) -> tuple[list[Packet], list[Cue]]:
    out: list[Packet] = []
    cues: list[Cue] = []
    for kind, start, end in elements(b, 0, len(b)):
        if kind != SEGMENT:
            continue
        scale, rate = SCALE_NS, {}
        for top, s, e in elements(b, start, end):
            if top == INFO:
                scale = next((_number(b, x, y) for k, x, y in elements(b, s, e) if k == TIMESTAMP_SCALE), scale)
            elif top == TRACKS:
                for kind, x, y in elements(b, s, e):
                    if kind != TRACK_ENTRY:
                        continue
                    entry = {k: (i, j) for k, i, j in elements(b, x, y)}
                    audio = {k: b[i:j] for k, i, j in elements(b, *entry[AUDIO])} if AUDIO in entry else {}
                    if (f := audio.get(SAMPLING_FREQUENCY)) is not None:
                        width = int.from_bytes(audio.get(CHANNELS, b"\1"), "big") * int.from_bytes(audio.get(BIT_DEPTH, b"\x08"), "big") // 8
                        rate[_number(b, *entry[TRACK_NUMBER])] = float(np.frombuffer(f, f">f{len(f)}")[0]) * width
            elif top == CLUSTER_ID:
                base = 0
                for k, x, y in elements(b, s, e, until=(CLUSTER_ID, CUES, TRACKS, INFO)):
                    if k == TIMESTAMP:
                        base = _number(b, x, y)
                        continue
                    if k == BLOCK_GROUP:
                        x, y = next((i, j) for g, i, j in elements(b, x, y) if g == BLOCK)
                    elif k != SIMPLE_BLOCK:
                        continue
                    track, at = _read_vint(b, x)
                    if at + 3 > y:
                        raise ValueError(f"the block at byte {x} ends in its head")
                    time = (base + int.from_bytes(b[at : at + 2], "big", signed=True)) * scale
                    flags = b[at + 2]
                    starts = _unlaced(b, at + 3, y, flags >> 1 & 3)
                    for i, j in zip(starts, starts[1:], strict=False):
                        out.append(Packet(track, time, i, j - i, bool(flags & 0x80) or k == BLOCK_GROUP, s))
                        time += frame_ns if frame_ns is not None else round((j - i) * 1e9 / rate[track]) if rate.get(track) else 0
            elif top == CUES:
                for kind, x, y in elements(b, s, e):
                    if kind != CUE_POINT:
                        continue
                    parts = list(elements(b, x, y))
                    time = next(_number(b, i, j) for k, i, j in parts if k == CUE_TIME) * scale
                    # A point may name a place for each of several tracks.
                    for k, i, j in parts:
                        if k == CUE_TRACK_POSITIONS:
                            at = {own: (p, q) for own, p, q in elements(b, i, j)}
                            cues.append(Cue(_number(b, *at[CUE_TRACK]), time, start + _number(b, *at[CUE_CLUSTER_POSITION])))
    return out, cues


def samples(b: bytes, table: list[Packet], track: int = 1) -> bytes:
    return b"".join([b[p.offset : p.offset + p.size] for p in table if p.track == track])


def feature(payload: bytes, table: list[Packet], cues: list[Cue]) -> str:
    """Packets, clusters cued, duration in ms, mean, mean square and crossings of the mean, and the spread over eight bins."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    ends = table[-1].timestamp_ns + table[-1].size * 1_000_000_000 // RATE
    sign = x * len(x) >= int(x.sum())
    bins = np.bincount(x >> 5, minlength=8)
    return f"packets={len(table)};cues={len(cues)};ms={ends // 1_000_000};mean={int(x.sum()) * 1000 // len(x)};square={int((x * x).sum()) // len(x)};turns={int((sign[1:] != sign[:-1]).sum())};bins={','.join(map(str, bins))}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 or 64 * (not raw))


def to_media(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, media): each text as a Matroska file."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [padded(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([n for n, _ in made], pa.int64()), pa.array([mux(p) for _, p in made], pa.binary())], names=[key, "n_bytes", "media"])

    return documents.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def packet_table(media: DataFrame, *, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each packet: key, track, timestamp_ns, byte_offset, byte_size, keyframe, cluster_offset, cued. Media that can't be read have none; read_media() tells why."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in zip(b.column("k").to_pylist(), b.column("m").to_pylist(), strict=True):
                if m is None:
                    continue
                try:
                    table, cues = packets(m)
                    # A cue names the cluster element; a packet knows where the cluster's body starts.
                    cued = {next(elements(m, c.offset, len(m)))[1] for c in cues}
                except _BROKEN:
                    continue
                cols = list(zip(*table, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(table), b.column("k").type), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.int64()), pa.array([c in cued for c in cols[5]], pa.bool_())],
                    names=[key, "track", "timestamp_ns", "byte_offset", "byte_size", "keyframe", "cluster_offset", "cued"],
                )

    return media.select(F.col(key).alias("k"), F.col(column).alias("m")).mapInArrow(run, f"`{key}` {kind}, track int, timestamp_ns long, byte_offset long, byte_size long, keyframe boolean, cluster_offset long, cued boolean")


def read_media(media: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Digests of what is read back from media: payload size and hash, checksum of its end, the stored form's size and hash, the feature; of media that can't be read the stored form's alone, and the error."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for m in b.column("media").to_pylist():
                if m is None:
                    out.append((None,) * 7)
                    continue
                stored = (len(m), hashlib.sha256(m).hexdigest())
                try:
                    table, cues = packets(m)
                    p = samples(m, table)
                    read = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), *stored, feature(p, table, cues), None)
                except _BROKEN as e:
                    read = (None, None, None, *stored, None, str(e) or type(e).__name__)
                out.append(read)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    return media.select(F.col(key).alias("k"), "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
