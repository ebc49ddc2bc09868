"""MPEG audio columns: store bytes in audio frames, and parse any MPEG audio stream.

``encode`` makes a Layer III stream whose frames decode to silence and carry the payload as ancillary data: an ID3v2
tag, a frame with a variable-bitrate table, then frames of three, two or one payload units of 192 bytes at three bit
rates, each with its checksum.  ``parse`` reads streams of any layer: it skips tags, finds the first of two headers that
agree, resynchronises after damage, reads Xing, Info and VBRI tables, verifies checksums and gives the exact duration
and the offset of every frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bazaarium.llm.tables import id_and_text, slices, written

UNIT = 192

# Fixed values of the format: kbit/s by bit-rate index from 1, by (MPEG-1 or not, layer).
KBPS = {
    (True, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
# Fixed values of the format: samples a second by version bits and rate index; version bits 1 are reserved.
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


@dataclass(frozen=True)
class Header:
    """One frame header."""

    version: int
    layer: int
    checked: bool
    kbps: int
    rate: int
    padding: int
    mono: bool
    #: Subbands that have two channels of their own; in joint stereo the others share their allocation.
    bound: int = 32

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 3 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.kbps * 1000 // self.rate + self.padding) * 4
        return self.samples // 8 * self.kbps * 1000 // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information of a Layer III frame."""
        if self.version == 3:
            return 17 if self.mono else 32
        return 9 if self.mono else 17

    @property
    def kind(self) -> tuple:
        """What all frames of a stream share."""
        return self.version, self.layer, self.rate


def header(raw: bytes) -> Header | None:
    """The header in four bytes, or None if they are none."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    index, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    mode = raw[3] >> 6
    bound = 0 if mode == 3 else 4 * (raw[3] >> 4 & 3) + 4 if mode == 1 else 32
    return Header(version, layer, not raw[1] & 1, KBPS[version == 3, layer][index - 1], RATES[version][rate], raw[2] >> 1 & 1, mode == 3, bound)


def _crc_table() -> np.ndarray:
    """CRC-16 with polynomial 0x8005, high bit first, byte by byte."""
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = (t << 1 ^ np.where(t & 0x8000, 0x8005, 0)) & 0xFFFF
    return t


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = (crc << 8 ^ _CRC[crc >> 8 ^ column]) & 0xFFFF
    return crc


# Fixed values of the format: subbands of Layer II by the bits of their allocation, as (bits, subbands) in order.
ALLOCATIONS = {
    "a": [(4, 11), (3, 12), (2, 4)],
    "b": [(4, 11), (3, 12), (2, 7)],
    "c": [(4, 2), (3, 6)],
    "d": [(4, 2), (3, 10)],
    "low": [(4, 4), (3, 7), (2, 19)],
}


def _allocation(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a Layer II frame."""
    each = h.kbps if h.mono else h.kbps // 2
    if h.version != 3:
        table = "low"
    elif each < 56:
        table = "d" if h.rate == 32000 else "c"
    else:
        table = "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for bits, n in ALLOCATIONS[table] for _ in range(n)]


def protected_bits(h: Header, body: bytes) -> int:
    """Bits after the checksum that it covers; ``body`` is what follows the checksum.

    Layer III: the side information.  Layer I: the allocation.  Layer II: the allocation, and two bits for each channel of a
    subband to which it gives any.
    """
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (32 if h.mono else 32 + h.bound)
    number, size = int.from_bytes(body, "big"), 8 * len(body)
    at = chosen = 0
    for subband, bits in enumerate(_allocation(h)):
        shared = not h.mono and subband >= h.bound
        for _ in range(1 if h.mono or shared else 2):
            at += bits
            if at > size:
                return size + 1
            if number >> (size - at) & ((1 << bits) - 1):
                chosen += 2 if shared else 1
    return at + 2 * chosen


def crc16_bits(head: bytes, body: bytes, n: int) -> int:
    """CRC-16 of two header bytes and the first ``n`` bits of the body."""
    crc = int(crc16(np.frombuffer(head + body[: n // 8], np.uint8)[None, :])[0])
    for i in range(n // 8 * 8, n):
        bit = body[i // 8] >> (7 - i % 8) & 1
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ bit) & 1 else 0)) & 0xFFFF
    return crc


@dataclass
class Stream:
    """What ``parse`` finds.  ``runs`` lists (offset, frames, bytes a frame, header) of equal neighbours."""

    tags: dict[str, str] = field(default_factory=dict)
    runs: list[tuple[int, int, int, Header]] = field(default_factory=list)
    skipped: int = 0
    checks: int = 0
    failures: int = 0
    table: dict = field(default_factory=dict)

    @property
    def frames(self) -> int:
        return sum(r[1] for r in self.runs)

    @property
    def samples(self) -> int:
        return sum(r[1] * r[3].samples for r in self.runs)

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        return sum((Fraction(n * h.samples, h.rate) for _, n, _, h in self.runs), Fraction(0))

    def offsets(self) -> np.ndarray:
        """Where each frame begins."""
        return np.concatenate([at + size * np.arange(n) for at, n, size, _ in self.runs]) if self.runs else np.zeros(0, np.int64)


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _tag_text(raw: bytes) -> str:
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(kind, "replace").strip("\x00")


def _id3(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Read the ID3v2 tag at ``at``; where it ends."""
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end = at + 10 + size
    at += 10
    while at + 10 <= min(end, len(data)) and data[at]:
        name, raw = data[at : at + 4], data[at + 4 : at + 8]
        n = _syncsafe(raw) if major >= 4 else int.from_bytes(raw, "big")
        body = data[at + 10 : at + 10 + n]
        if name[:1] == b"T":
            tags.setdefault(name.decode("latin-1"), _tag_text(body))
        at += 10 + n
    return end + 10 * bool(flags & 0x10)


def _vbr_table(frame: bytes, h: Header) -> dict:
    """The Xing, Info or VBRI table in a stream's first frame, or nothing."""
    at = 4 + 2 * h.checked + h.side
    for place in (at, 4 + h.side):
        name = frame[place : place + 4]
        if name in (b"Xing", b"Info"):
            flags = int.from_bytes(frame[place + 4 : place + 8], "big")
            out, at = {"kind": name.decode()}, place + 8
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key] = int.from_bytes(frame[at : at + 4], "big")
                    at += 4
            if flags & 4:
                out["toc"] = list(frame[at : at + 100])
            return out
    if frame[36:40] == b"VBRI":
        n, scale, width = (int.from_bytes(frame[at : at + 2], "big") for at in (54, 56, 58))
        steps = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "toc": steps}
    return {}


def _wrong(rows: np.ndarray, h: Header) -> int:
    """Frames (rows of bytes) whose checksum is not that of what it covers; those too short for it count too."""
    if h.layer == 3:
        if h.size < 6 + h.side:
            return len(rows)
        said = rows[:, 4].astype(np.uint32) << 8 | rows[:, 5]
        return int((crc16(np.hstack([rows[:, 2:4], rows[:, 6 : 6 + h.side]])) != said).sum())
    wrong = 0
    for frame in map(bytes, rows):
        # The allocation of Layer II and its choices fit in 60 bytes.
        body = frame[6:70]
        n = protected_bits(h, body)
        wrong += n > 8 * len(body) or crc16_bits(frame[2:4], body, n) != int.from_bytes(frame[4:6], "big")
    return wrong


def parse(data: bytes) -> Stream:
    """Parse a stream.  Bytes that are neither frame nor tag are skipped and counted; a cut last frame is skipped too.

    The letters of a tag inside a frame are that frame's: a tag is read only where the walk over frames, tags and
    skipped bytes arrives at it.
    """
    out, at, end, raw = Stream(), 0, len(data), np.frombuffer(data, np.uint8)
    #: Where an ID3v1 tag stands if there is one.
    last = end - 128 if end >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    kind = None
    while at < end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _id3(data, at, out.tags)
            continue
        if at == last:
            for key, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
                out.tags.setdefault(key, data[at + a : at + b].decode("latin-1").strip("\x00 "))
            break
        h = header(data[at : at + 4])
        fits = h is not None and at + h.size <= end and kind in (None, h.kind)
        if fits and at + h.size not in (last, end) and data[at + h.size : at + h.size + 3] != b"ID3":
            after = header(data[at + h.size : at + h.size + 4])
            fits = after is not None and after.kind == h.kind
        if not fits:
            to = data.find(b"\xff", at + 1, end)
            to = to if to >= 0 else end
            to = last if at < last < to else to
            out.skipped += to - at
            at = to
            continue
        if kind is None:
            kind = h.kind
            if h.layer == 3 and (table := _vbr_table(data[at : at + h.size], h)):
                out.table = table
                at += h.size
                continue
        n = (end - at) // h.size
        same = (raw[at : at + n * h.size].reshape(n, h.size)[:, :4] == raw[at : at + 4]).all(axis=1)
        n = int(np.argmin(same)) if not same.all() else n
        if h.checked:
            out.checks += n
            out.failures += _wrong(raw[at : at + n * h.size].reshape(n, h.size), h)
        out.runs.append((at, n, h.size, h))
        at += n * h.size
    return out


def _frame_head(kbps: int) -> bytes:
    """Header, checksum and empty side information of an MPEG-1 Layer III mono frame at 48 kHz."""
    head = bytes([0xFF, 0xFA, (KBPS[True, 3].index(kbps) + 1) << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    crc = int(crc16(np.frombuffer(head[2:] + side, np.uint8)[None, :])[0])
    return head + crc.to_bytes(2, "big") + side


#: Payload units in a frame: bit rate and frame size.
_FRAMES = {1: (80, 240), 2: (160, 480), 3: (224, 672)}
_HEADS = {n: np.frombuffer(_frame_head(kbps), np.uint8) for n, (kbps, _) in _FRAMES.items()}
_UNITS_OF = {size: n for n, (_, size) in _FRAMES.items()}
_HEAD = 23


def _frames(payload: np.ndarray, units: int) -> np.ndarray:
    out = np.zeros((len(payload) // (units * UNIT), _FRAMES[units][1]), np.uint8)
    out[:, :_HEAD] = _HEADS[units]
    out[:, _HEAD : _HEAD + units * UNIT] = payload.reshape(len(out), units * UNIT)
    return out.reshape(-1)


def encode(payload: bytes, note: str = "") -> bytes:
    """A stream that carries ``payload``, a positive multiple of UNIT bytes; ``note`` goes into its tag."""
    raw = np.frombuffer(payload, np.uint8)
    whole, rest = divmod(len(raw) // UNIT, 3)
    parts = [_frames(raw[: whole * 3 * UNIT], 3)] + ([_frames(raw[whole * 3 * UNIT :], rest)] if rest else [])
    body = b"".join(p.tobytes() for p in parts)
    frames, table_size = whole + bool(rest), _FRAMES[1][1]
    total = table_size + len(body)
    starts = table_size + np.minimum(np.arange(100) * frames // 100, frames) * _FRAMES[3][1]
    table = np.zeros(table_size, np.uint8)
    table[:_HEAD] = _HEADS[1]
    said = b"Xing" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(np.minimum(255, starts * 256 // total).astype(np.uint8))
    table[_HEAD : _HEAD + len(said)] = np.frombuffer(said, np.uint8)
    body_text = b"\x00" + note.encode("latin-1", "replace")
    tag = b"TXXX" + len(body_text).to_bytes(4, "big") + b"\x00\x00" + body_text
    size = bytes(len(tag) >> s & 0x7F for s in (21, 14, 7, 0))
    return b"ID3\x03\x00\x00" + size + tag + table.tobytes() + body


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The payload that ``encode`` put into the frames."""
    raw = np.frombuffer(data, np.uint8)
    return b"".join(raw[at : at + n * size].reshape(n, size)[:, _HEAD : _HEAD + _UNITS_OF[size] * UNIT].tobytes() for at, n, size, _ in stream.runs)


def padded(text: str) -> tuple[int, bytes]:
    """UTF-8 of a text: its length, and with spaces up to a positive multiple of UNIT."""
    raw = text.encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def feature(s: Stream, data: bytes) -> str:
    """One line on a stream: kind, frames, samples, bit rates, checks, table, and digests of seek offsets and frames."""
    if not s.runs:
        return "no audio"
    h, rates = s.runs[0][3], [r[3].kbps for r in s.runs]
    seek, audio = zlib.crc32(s.offsets().astype("<u4").tobytes()), 0
    for at, n, size, _ in s.runs:
        audio = zlib.crc32(memoryview(data)[at : at + n * size], audio)
    said = s.table.get("kind", "none")
    agrees = s.table.get("frames") == s.frames if s.table else False
    return f"mpeg{VERSIONS[h.version]}-layer{h.layer} {h.rate}Hz {'mono' if h.mono else 'stereo'} frames={s.frames} samples={s.samples} kbps={min(rates)}-{max(rates)} crc={s.checks - s.failures}/{s.checks} skipped={s.skipped} table={said}:{str(agrees).lower()} seek={seek:08x} audio={audio:08x}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as an audio stream.  A null text is empty, so its payload is all padding."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [padded(t) for t in part.column("text").to_pylist()]
                media = pa.array([encode(p, f"n_bytes={n}") for n, p in made], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(make, "doc_id long, n_bytes long, media binary")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, samples long, sample_rate long, duration_s double, seek_offsets array<long>"


def features(stored: DataFrame) -> DataFrame:
    """Parse stored streams (doc_id, n_bytes, media): payload digests, duration, and the offsets of all frames.

    The duration is exactly ``samples`` / ``sample_rate`` seconds, ``duration_s`` its nearest double.  A null or empty stream has no
    payload, no frames, a null rate and the feature ``no audio``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        long, text = pa.int64(), pa.string()
        kinds = [long, long, long, text, long, long, text, text, long, long, long, pa.float64()]
        for batch in batches:
            for part in slices(batch, "media"):
                rows, seeks = [], []
                for doc_id, n, media in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                    media = media or b""
                    stream = parse(media)
                    payload = payload_of(media, stream)
                    seeks.append(stream.offsets())
                    rate = stream.runs[0][3].rate if stream.runs else None
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream, media), stream.frames, stream.samples, rate, float(stream.duration)))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                offsets = pa.ListArray.from_arrays(np.cumsum([0, *map(len, seeks)]).astype(np.int32), pa.array(np.concatenate(seeks), long))
                yield pa.RecordBatch.from_arrays([*columns, offsets], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, SCHEMA)


def audio_column(docs: DataFrame) -> DataFrame:
    """Store every text as audio in the shared folder, read the streams back and describe them; one row per document."""
    return features(written(store(docs), "audio"))
