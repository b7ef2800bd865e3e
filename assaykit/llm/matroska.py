"""Media columns: Matroska files as rows, parsed to packet tables without a media library.

`packets`, `tracks`, `cues` and `elements` turn a binary column of whole files into tables: variable-length EBML elements
are walked by identifier and size, clusters give their blocks' times, laced blocks are split to frames (Xiph, fixed and
EBML lacing), and every packet has its track, time and byte range in the file. `window` starts at the cluster that the
cues name, so it reads no cluster before. `store` writes texts as files with one track of 8-bit samples, `samples` reads a
track's bytes back from its byte ranges. A file is parsed in the task that holds its row; no row meets another.

Sizes may be unknown (all ones) for segments and clusters, which then end where an element of an upper level begins.
Elements that aren't known are stepped over. A CRC-32 element is checked against the rest of its parent. Track settings
that strip a header from frames are honoured by `samples`; other content encodings leave the bytes as they are stored.

Edge cases: a null or empty file, or one without an EBML header, has no rows in any table but one in `samples` and `window`,
which names the error; a file that breaks off keeps the packets before the break; blocks whose laces don't fit are left out and named; ids that
repeat or are null give rows each. Times of laced frames after the first are null where neither the track's frame time
nor the block's duration is known. Names in `keep` that clash with the results give way to them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import in_python, lean
from .text import pieces, raw, with_columns

# Fixed values of the format: element identifiers.
EBML, DOC_TYPE, SEGMENT = 0x1A45DFA3, 0x4282, 0x18538067
SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
CHAPTERS, TAGS, ATTACHMENTS = 0x1043A770, 0x1254C367, 0x1941A469
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, LANGUAGE = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x22B59C
FLAG_LACING, DEFAULT_DURATION = 0x9C, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, VIDEO, WIDTH, HEIGHT = 0xE1, 0xB5, 0x9F, 0x6264, 0xE0, 0xB0, 0xBA
ENCODINGS, ENCODING, COMPRESSION, COMP_ALGO, COMP_SETTINGS = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
CRC32, VOID = 0xBF, 0xEC

#: Elements that hold others.
MASTERS = {EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, VIDEO, ENCODINGS, ENCODING, COMPRESSION, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
#: Elements right below a segment: an open cluster ends where one of them begins.
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}
LACINGS = ("none", "xiph", "fixed", "ebml")
MS = 1_000_000

#: The form that `store` writes: 8-bit samples, frames of FRAME samples, LACE frames in a block, BLOCKS blocks in a cluster.
RATE, FRAME, LACE, BLOCKS = 8000, 400, 8, 32
CODEC, PAD = "A_PCM/INT/LIT", 64


class Broken(ValueError):
    """The file ends, or holds what can't be, at the offset that is named."""


def read_vint(data: bytes, at: int, end: int, marked: bool, longest: int = 8) -> tuple[int, int]:
    """A variable-length number and the offset behind it; `marked` keeps the length marker, as identifiers do. All ones: -1."""
    first = data[at] if at < end else 0
    n = 9 - first.bit_length()
    if not first or n > longest or at + n > end:
        raise Broken(f"no number at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if marked:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def unsigned(data: bytes) -> int:
    return int.from_bytes(data, "big")


def floating(data: bytes) -> float:
    return struct.unpack(">f" if len(data) == 4 else ">d", data)[0] if len(data) in (4, 8) else 0.0


@dataclass(slots=True)
class Element:
    id: int
    start: int
    body: int
    end: int
    open: bool = False


def children(data: bytes, at: int, end: int, stop: frozenset | set = frozenset()) -> Iterator[Element]:
    """Elements from `at` on, until `end` or one of the identifiers in stop. One that reaches beyond `end` is cut there, as `open` says, and the last."""
    while at < end:
        kind, behind = read_vint(data, at, end, True, 4)
        if kind in stop:
            return
        size, body = read_vint(data, behind, end, False)
        if size < 0 and kind not in (SEGMENT, CLUSTER):
            raise Broken(f"unknown size at {at}")
        cut = size < 0 or body + size > end
        found = Element(kind, at, body, end if cut else body + size, cut)
        yield found
        if cut and kind == CLUSTER and size < 0:
            found.end = open_end(data, body, end)
        at = found.end


def open_end(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends."""
    for e in children(data, at, end, TOP | {SEGMENT, EBML}):
        at = e.end
    return at


def laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose body begins at `at`."""
    if not kind:
        return [(at, end - at)]
    if at >= end:
        raise Broken(f"no lace at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise Broken(f"uneven lace at {at}")
        sizes = [(end - at) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Broken(f"no lace at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
            sizes.append(size)
    else:
        for k in range(n - 1):
            before, length = at, 9 - data[at].bit_length() if at < end and data[at] else 0
            value, at = read_vint(data, at, end, False)
            if value < 0:
                value = (1 << 7 * length) - 1
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * length - 1) - 1))
            if sizes[-1] < 0:
                raise Broken(f"negative lace at {before}")
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken(f"laces beyond their block at {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


@dataclass
class File:
    """What one file holds. Packets: (track, timestamp_ns, duration_ns, keyframe, discardable, lacing, frame, cluster_offset, block_offset, offset, size)."""

    doc_type: str | None = None
    scale: int = MS
    duration_ns: int | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int, int | None]] = field(default_factory=list)
    clusters: int = 0
    packets: list[tuple] = field(default_factory=list)
    checked: int = 0
    errors: list[str] = field(default_factory=list)
    segment: int = 0


PACKET = ("track", "timestamp_ns", "duration_ns", "keyframe", "discardable", "lacing", "frame", "cluster_offset", "block_offset", "offset", "size")
PACKET_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
PACKET_DDL = "track long, timestamp_ns long, duration_ns long, keyframe boolean, discardable boolean, lacing string, frame int, cluster_offset long, block_offset long, offset long, size long"


def _checked(data: bytes, e: Element, into: File) -> None:
    """Compare the CRC-32 that an element begins with with the rest of it."""
    if e.end - e.body >= 6 and data[e.body] == CRC32 and data[e.body + 1] == 0x84 and not e.open:
        into.checked += 1
        if int.from_bytes(data[e.body + 2 : e.body + 6], "little") != zlib.crc32(memoryview(data)[e.body + 6 : e.end]):
            into.errors.append(f"wrong checksum at {e.body}")


def _fields(data: bytes, e: Element) -> dict[int, bytes]:
    return {c.id: data[c.body : c.end] for c in children(data, e.body, e.end)}


def _track(data: bytes, e: Element, into: File) -> None:
    own = _fields(data, e)
    number = unsigned(own.get(TRACK_NUMBER, b""))
    strip = None
    for inner in children(data, e.body, e.end):
        if inner.id in (AUDIO, VIDEO):
            own |= _fields(data, inner)
        elif inner.id == ENCODINGS:
            for coding in children(data, inner.body, inner.end):
                for compression in children(data, coding.body, coding.end):
                    if compression.id == COMPRESSION:
                        found = _fields(data, compression)
                        if unsigned(found.get(COMP_ALGO, b"")) == 3:
                            strip = found.get(COMP_SETTINGS, b"")
    into.tracks[number] = {
        "type": {1: "video", 2: "audio", 17: "subtitle"}.get(unsigned(own.get(TRACK_TYPE, b"")), "other"),
        "codec": own.get(CODEC_ID, b"").decode("ascii", "replace").rstrip("\0"), "language": own.get(LANGUAGE, b"eng").decode("ascii", "replace").rstrip("\0"),
        "frame_ns": unsigned(own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else None, "rate": floating(own[SAMPLING]) if SAMPLING in own else None,
        "channels": unsigned(own[CHANNELS]) if CHANNELS in own else None, "bits": unsigned(own[BIT_DEPTH]) if BIT_DEPTH in own else None,
        "width": unsigned(own[WIDTH]) if WIDTH in own else None, "height": unsigned(own[HEIGHT]) if HEIGHT in own else None, "strip": strip,
    }


def _cues(data: bytes, e: Element, into: File) -> None:
    for point in children(data, e.body, e.end):
        if point.id != CUE_POINT:
            continue
        time = 0
        for c in children(data, point.body, point.end):
            if c.id == CUE_TIME:
                time = unsigned(data[c.body : c.end])
            elif c.id == CUE_POSITIONS:
                own = _fields(data, c)
                relative = own.get(CUE_RELATIVE)
                into.cues.append((unsigned(own.get(CUE_TRACK, b"")), time * into.scale, into.segment + unsigned(own.get(CUE_CLUSTER, b"")), unsigned(relative) if relative is not None else None))


def _block(data: bytes, e: Element, cluster: int, time: int, into: File, simple: bool, key: bool, lasts: int | None) -> None:
    track, at = read_vint(data, e.body, e.end, False)
    if at + 3 > e.end:
        raise Broken(f"short block at {e.start}")
    own = struct.unpack_from(">h", data, at)[0]
    flags = data[at + 2]
    kind = flags >> 1 & 3
    frames = laces(data, at + 3, e.end, kind)
    step = into.tracks.get(track, {}).get("frame_ns")
    if step is None and lasts is not None:
        step = lasts * into.scale // len(frames)
    begin = (time + own) * into.scale
    for k, (offset, size) in enumerate(frames):
        into.packets.append((
            track, begin + k * step if step is not None else begin if not k else None, step, bool(flags & 128) if simple else key, simple and bool(flags & 1), LACINGS[kind], k, cluster, e.start, offset, size,
        ))


def _cluster(data: bytes, e: Element, into: File) -> None:
    """The packets of one cluster; blocks that break are named, and the next ones follow."""
    into.clusters += 1
    time = 0
    for c in children(data, e.body, e.end, TOP | {SEGMENT, EBML} if e.open else frozenset()):
        try:
            if c.open:
                raise Broken(f"cut off at {c.start}")
            if c.id == TIMESTAMP:
                time = unsigned(data[c.body : c.end])
            elif c.id == SIMPLE_BLOCK:
                _block(data, c, e.start, time, into, True, False, None)
            elif c.id == BLOCK_GROUP:
                held = list(children(data, c.body, c.end))
                lasts = next((unsigned(data[x.body : x.end]) for x in held if x.id == BLOCK_DURATION), None)
                for x in held:
                    if x.id == BLOCK:
                        _block(data, x, e.start, time, into, False, all(y.id != REFERENCE for y in held), lasts)
        except Broken as broken:
            into.errors.append(str(broken))


def parse(data: bytes, into: File | None = None, clusters: bool = True) -> File:
    """All of a file, or without `clusters` what stands outside of them."""
    out = into or File()
    try:
        top = children(data, 0, len(data))
        head = next(top, None)
        if head is None or head.id != EBML:
            raise Broken("no EBML header")
        out.doc_type = _fields(data, head).get(DOC_TYPE, b"matroska").decode("ascii", "replace").rstrip("\0")
        for segment in top:
            if segment.id != SEGMENT:
                continue
            out.segment = segment.body
            for e in children(data, segment.body, segment.end, {EBML}):
                if e.id != CLUSTER or clusters:
                    _checked(data, e, out)
                if e.id == INFO:
                    own = _fields(data, e)
                    out.scale = unsigned(own.get(TIMESTAMP_SCALE, b"")) or MS
                    out.duration_ns = int(floating(own[DURATION]) * out.scale) if DURATION in own else None
                elif e.id == TRACKS:
                    for t in children(data, e.body, e.end):
                        if t.id == TRACK_ENTRY:
                            _track(data, t, out)
                elif e.id == CUES:
                    _cues(data, e, out)
                elif e.id == CLUSTER and clusters:
                    _cluster(data, e, out)
            if segment.open and segment.end == len(data) and len(data) > segment.body and not _unknown(data, segment):
                out.errors.append(f"cut off at {len(data)}")
    except (Broken, struct.error) as broken:
        out.errors.append(str(broken))
    return out


def _unknown(data: bytes, e: Element) -> bool:
    return read_vint(data, read_vint(data, e.start, len(data), True, 4)[1], len(data), False)[0] < 0


def between(data: bytes, start_ns: int, end_ns: int, track: int) -> tuple[File, int]:
    """The packets of a track from start_ns on and before end_ns, and the offset of the cluster where reading began, as the cues name it."""
    out = parse(data, clusters=False)
    if not out.tracks:
        return out, 0
    before = [position for t, time, position, _ in out.cues if t == track and time <= start_ns]
    at = max(before, default=out.segment)
    try:
        for e in children(data, at, len(data), {EBML}):
            if e.id == CLUSTER:
                seen = len(out.packets)
                _cluster(data, e, out)
                times = [p[1] for p in out.packets[seen:] if p[0] == track and p[1] is not None]
                if times and min(times) >= end_ns:
                    break
    except Broken as broken:
        out.errors.append(str(broken))
    out.packets = [p for p in out.packets if p[0] == track and p[1] is not None and start_ns <= p[1] < end_ns]
    return out, at


def joined(data: bytes, found: File, track: int) -> bytes:
    """The bytes of a track, from the byte ranges of its packets."""
    strip = found.tracks.get(track, {}).get("strip") or b""
    return b"".join([x for p in found.packets if p[0] == track for x in (strip, data[p[9] : p[9] + p[10]])])


# Writing.


def vint(n: int, length: int = 0) -> bytes:
    """A size in its shortest form, or in `length` bytes; the value of all ones is left for unknown sizes."""
    length = length or max(1, -(-(n + 1).bit_length() // 7))
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"))


def guarded(kind: int, *parts: bytes) -> bytes:
    """An element that begins with the CRC-32 of the rest."""
    body = b"".join(parts)
    return element(kind, element(CRC32, zlib.crc32(body).to_bytes(4, "little")), body)


def block(track: int, time: int, frames: list[bytes], kind: str = "none", flags: int = 128, simple: bool = True) -> bytes:
    """A block of one or more frames; `time` counts from its cluster's."""
    head = vint(track) + struct.pack(">h", time) + bytes([flags | LACINGS.index(kind) << 1])
    if kind != "none":
        head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "ebml" and len(sizes) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            length = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
            head += vint(b - a + (1 << 7 * length - 1) - 1, length)
    return element(SIMPLE_BLOCK if simple else BLOCK, head, *frames)


def audio_track(frame_ns: int = FRAME * 1000 * MS // RATE, rate: float = RATE, number_: int = 1) -> bytes:
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", rate)), number(CHANNELS, 1), number(BIT_DEPTH, 8))
    return element(TRACK_ENTRY, number(TRACK_NUMBER, number_), number(TRACK_UID, number_), number(TRACK_TYPE, 2), number(FLAG_LACING, 1), number(DEFAULT_DURATION, frame_ns), element(CODEC_ID, CODEC.encode()), audio)


HEAD = element(EBML, element(DOC_TYPE, b"matroska"), number(0x4287, 4), number(0x4285, 2))
TRACK = guarded(TRACKS, audio_track())


def written(payload: bytes) -> bytes:
    """A file whose only track holds the payload as 8-bit samples: fixed laces, EBML laces where the last frame is shorter, a cue for each cluster."""
    step = FRAME * 1000 // RATE
    info = guarded(INFO, number(TIMESTAMP_SCALE, MS), element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)), element(MUXING_APP, b"rows"), element(WRITING_APP, b"rows"))
    parts, at, cues = [info, TRACK], len(info) + len(TRACK), []
    for first in range(0, len(payload), FRAME * LACE * BLOCKS):
        begin, blocks = first // FRAME * step, []
        for k in range(first, min(len(payload), first + FRAME * LACE * BLOCKS), FRAME * LACE):
            frames = [payload[s : s + FRAME] for s in range(k, min(len(payload), k + FRAME * LACE), FRAME)]
            kind = "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == FRAME else "ebml"
            blocks.append(block(1, k // FRAME * step - begin, frames, kind))
        cluster = guarded(CLUSTER, number(TIMESTAMP, begin), *blocks)
        cues.append(element(CUE_POINT, number(CUE_TIME, begin), element(CUE_POSITIONS, number(CUE_TRACK, 1), number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(guarded(CUES, *cues))
    return HEAD + element(SEGMENT, *parts)


def padded(text: bytes) -> bytes:
    """The bytes with zeros behind, up to a positive multiple of PAD."""
    return text + bytes(-len(text) % PAD or (PAD if not text else 0))


# Tables.


def _typed(docs: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), more])


def store(docs: DataFrame, text="text", keep=("doc_id",)) -> DataFrame:
    """The columns of keep with n_bytes (of the text in UTF-8) and media, the file that holds it."""
    keep = [c for c in keep if c not in ("n_bytes", "media")]

    @lean
    def run(batches):
        for b in pieces(batches, text):
            texts = raw(b, text)
            yield with_columns(b, keep, {"n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array([written(padded(t)) for t in texts], pa.binary())})

    return docs.select(*dict.fromkeys([*keep, text])).transform(in_python, run, _typed(docs, keep, "n_bytes long, media binary"))


def exploded(files: DataFrame, keep, names, types, ddl: str, rows, media="media") -> DataFrame:
    """A table of the rows that each file gives, with the columns of keep."""
    keep = [c for c in keep if c not in names]

    @lean
    def run(batches):
        for b in pieces(batches, media):
            at, found = [], []
            for i, data in enumerate(b.column(media).to_pylist()):
                own = rows(data or b"")
                at += [i] * len(own)
                found += own
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            own = b.select(keep).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keep, *names])

    return files.select(*dict.fromkeys([*keep, media])).transform(in_python, run, _typed(files, keep, ddl))


def packets(files: DataFrame, keep=("doc_id",), media="media") -> DataFrame:
    """The columns of keep with the columns of PACKET, a row for each frame, in the order of the file."""
    return exploded(files, keep, PACKET, PACKET_TYPES, PACKET_DDL, lambda data: parse(data).packets, media)


def tracks(files: DataFrame, keep=("doc_id",), media="media") -> DataFrame:
    """A row for each track: number, kind, codec, language, frame time, and what audio and video have."""
    names = ("track", "type", "codec", "language", "frame_ns", "rate", "channels", "bits", "width", "height")
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    ddl = "track long, type string, codec string, language string, frame_ns long, rate double, channels long, bits long, width long, height long"
    return exploded(files, keep, names, types, ddl, lambda data: [(n, *(t[c] for c in names[1:])) for n, t in sorted(parse(data, clusters=False).tracks.items())], media)


def cues(files: DataFrame, keep=("doc_id",), media="media") -> DataFrame:
    """A row for each cue: track, timestamp_ns, cluster_offset in the file, and block_offset inside the cluster if it is given."""
    names, types = ("track", "timestamp_ns", "cluster_offset", "relative"), (pa.int64(),) * 4
    return exploded(files, keep, names, types, "track long, timestamp_ns long, cluster_offset long, relative long", lambda data: parse(data, clusters=False).cues, media)


def _walk(data: bytes, at: int, end: int, level: int) -> Iterator[tuple]:
    for e in children(data, at, end, TOP | {SEGMENT, EBML} if level == 2 else frozenset()):
        yield (f"{e.id:X}", level, e.start, e.body, e.end - e.body)
        if e.id in MASTERS:
            yield from _walk(data, e.body, e.end, level + 1)


def elements(files: DataFrame, keep=("doc_id",), media="media") -> DataFrame:
    """A row for each element: id in hexadecimal, level, start, where its body begins and the body's size; a file that breaks keeps the rows before."""

    def rows(data: bytes) -> list[tuple]:
        out: list[tuple] = []
        try:
            out.extend(_walk(data, 0, len(data), 0))
        except Broken:
            pass
        return out

    names, types = ("element", "level", "start", "body", "size"), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return exploded(files, keep, names, types, "element string, level int, start long, body long, size long", rows, media)


def window(files: DataFrame, start_ns: int, end_ns: int, track: int = 1, keep=("doc_id",), media="media") -> DataFrame:
    """A row for each file: the track's bytes of the packets from start_ns on and before end_ns, their number, and where reading began."""

    def rows(data: bytes) -> list[tuple]:
        found, at = between(data, start_ns, end_ns, track)
        return [(joined(data, found, track), len(found.packets), at)]

    return exploded(files, keep, ("payload", "n_packets", "from_offset"), (pa.binary(), pa.int64(), pa.int64()), "payload binary, n_packets long, from_offset long", rows, media)


def samples(files: DataFrame, track: int = 1, keep=("doc_id",), media="media") -> DataFrame:
    """A row for each file: the track's bytes read from the packets' byte ranges, what the packet table holds (`feature`), and errors, comma-joined, or null."""

    def rows(data: bytes) -> list[tuple]:
        found = parse(data)
        payload = joined(data, found, track)
        return [(payload, feature(found, payload, track), ", ".join(found.errors) or None)]

    return exploded(files, keep, ("payload", "feature", "error"), (pa.binary(), pa.string(), pa.string()), "payload binary, feature string, error string", rows, media)


def feature(found: File, payload: bytes, track: int) -> str:
    """Counts of the packet table, its last time, and the samples' sum, peak and changes of sign around 128."""
    own = [p for p in found.packets if p[0] == track]
    values = np.frombuffer(payload, np.uint8)
    above = values >= 128
    named = {
        "packets": len(own), "blocks": len({p[8] for p in own}), "laced": sum(p[5] != "none" for p in own), "clusters": found.clusters, "cues": len(found.cues), "checked": found.checked,
        "last_ms": max((p[1] // MS for p in own if p[1] is not None), default=0), "sum": int(values.sum(dtype=np.int64)), "peak": int(values.max()) if len(values) else 0,
        "crossings": int((above[1:] != above[:-1]).sum()),
    }
    return ";".join(f"{k}={v}" for k, v in named.items())


def digests(files: DataFrame, id_col="doc_id") -> DataFrame:
    """Digest columns of stored files: of what is read back from them, and of the files."""
    read = samples(files, keep=(id_col, "n_bytes", "media"))
    return read.select(
        id_col, "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{PAD}, {PAD})")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
