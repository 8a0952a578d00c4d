"""Media columns: payloads as 8-bit samples in Ogg, and a reader that trusts nothing.

The writer multiplexes two logical streams: the samples, and one with the samples' description. The reader verifies every
page's checksum and sequence number, reassembles packets from lacing values, demultiplexes by serial number and derives
timestamps from granule positions.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_frame, per_row

RATE = 8000
FRAME = 192
PACKET = 4096
SAMPLES, NOTES = 0x53414D50, 0x4E4F5445
#: Data bytes of a page before a new one is begun.
PAGE = 60_000

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7, most significant bit first, no inversion.

    It is the mirror image of the common reflected CRC-32 over mirrored bytes, which zlib computes at C speed.
    """
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(_MIRROR), "little")


def payload(data: bytes, frame: int = FRAME) -> bytes:
    """``data`` padded with spaces to a positive multiple of ``frame``."""
    return data.ljust(max(1, -(-len(data) // frame)) * frame, b" ")


class _Stream:
    def __init__(self, serial: int) -> None:
        self.serial, self.number, self.begun = serial, 0, False
        self.lacing, self.parts, self.size, self.granule, self.continued = bytearray(), [], 0, -1, False

    def page(self, last: bool = False) -> bytes:
        flags = self.continued | (not self.begun) << 1 | last << 2
        head = _HEAD.pack(b"OggS", 0, flags, self.granule, self.serial, self.number, 0, len(self.lacing)) + bytes(self.lacing)
        body = head + b"".join(self.parts)
        self.begun, self.number = True, self.number + 1
        self.continued = bool(self.lacing) and self.lacing[-1] == 255
        self.lacing, self.parts, self.size, self.granule = bytearray(), [], 0, -1
        return body[:22] + struct.pack("<I", checksum(body)) + body[26:]

    def add(self, packet: bytes, granule: int) -> list[bytes]:
        """Pages that fill up; a packet may run over several."""
        out, at, left = [], 0, len(packet) // 255 + 1
        while left:
            if len(self.lacing) == 255 or self.size >= PAGE:
                out.append(self.page())
            n = min(left, 255 - len(self.lacing))
            piece = packet[at : at + 255 * n]
            full, rest = divmod(len(piece), 255)
            self.lacing += b"\xff" * full
            if n == left:
                self.lacing.append(rest)
                self.granule = granule
            self.parts.append(piece)
            self.size += len(piece)
            at, left = at + len(piece), left - n
        return out


def encode(data: bytes, n_bytes: int) -> bytes:
    """Ogg with ``data`` as samples and a second stream that tells the unpadded length."""
    samples, notes = _Stream(SAMPLES), _Stream(NOTES)
    samples.add(b"\x01rawpcm8\0" + struct.pack("<IHH", RATE, 1, 8), 0)
    notes.add(b"\x01note\0", 0)
    out = [samples.page(), notes.page()]
    notes.add(struct.pack("<Q", n_bytes), 0)
    out.append(notes.page(last=True))
    for at in range(0, len(data), PACKET):
        out += samples.add(data[at : at + PACKET], min(at + PACKET, len(data)))
    out.append(samples.page(last=True))
    return b"".join(out)


@dataclass
class Track:
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of each packet, or None for packets that do not end a page.
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)


class OggError(ValueError):
    pass


def demux(media: bytes) -> dict[int, Track]:
    """The logical streams by serial number. Damaged pages, gaps and unfinished packets raise :class:`OggError`."""
    tracks: dict[int, Track] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27 or media[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + segments]
        start = at + 27 + segments
        end = start + sum(lacing)
        if version or len(lacing) < segments or end > len(media):
            raise OggError(f"page at byte {at} is cut short")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"checksum of page at byte {at}")
        if flags & 2:
            if serial in tracks:
                raise OggError(f"stream {serial} begins twice")
            tracks[serial] = Track()
        if serial not in tracks:
            raise OggError(f"stream {serial} has no first page")
        track = tracks[serial]
        if number != track.pages or track.ended or bool(flags & 1) != bool(track.open):
            raise OggError(f"page {number} of stream {serial} is out of place")
        track.pages += 1
        done = lacing.translate(None, b"\xff")
        begin, piece = start, start
        for v in lacing:
            piece += v
            if v < 255:
                track.packets.append(b"".join([*track.open, media[begin:piece]]))
                track.granules.append(None)
                track.open, begin = [], piece
        if piece > begin or (lacing and lacing[-1] == 255):
            track.open.append(media[begin:piece])
        if done:
            track.granules[-1] = granule
        track.ended = bool(flags & 4)
        at = end
    for serial, track in tracks.items():
        if track.open or not track.ended:
            raise OggError(f"stream {serial} does not end")
    return tracks


def decode(media: bytes) -> tuple[bytes, int, dict]:
    """(payload, unpadded length, facts); anything but what :func:`encode` writes raises :class:`OggError`."""
    try:
        return _decoded(demux(media))
    except (struct.error, IndexError, StopIteration) as e:
        raise OggError(f"streams differ from what was written: {e}") from e


def _decoded(tracks: dict[int, Track]) -> tuple[bytes, int, dict]:
    if set(tracks) != {SAMPLES, NOTES}:
        raise OggError("streams differ from what was written")
    sound = tracks[SAMPLES]
    head = sound.packets[0]
    rate, channels, bits = struct.unpack("<IHH", head[9:])
    if head[:9] != b"\x01rawpcm8\0" or (channels, bits) != (1, 8):
        raise OggError("not 8-bit mono samples")
    data = b"".join(sound.packets[1:])
    last = next(g for g in reversed(sound.granules) if g is not None)
    if last != len(data):
        raise OggError(f"granule position {last} after {len(data)} samples")
    (n_bytes,) = struct.unpack("<Q", tracks[NOTES].packets[1])
    stamps = [round(g * 1000 / rate) for g in sound.granules if g is not None]
    return data, n_bytes, {"rate": rate, "packets": len(sound.packets) - 1, "pages": sum(t.pages for t in tracks.values()), "stamps_ms": stamps}


def features(data: bytes, facts: dict) -> str:
    """Duration, level and spread of the samples, zero crossings about the middle, pages and packets."""
    x = np.frombuffer(data, np.uint8)
    total, n = int(x.sum(dtype=np.int64)), len(x)
    square = int(np.dot(x.astype(np.float32), x.astype(np.float32)).round()) if n < 256 else int(np.bincount(x, minlength=256) @ (np.arange(256, dtype=np.int64) ** 2))
    mean = total / n
    spread = math.sqrt(max(0.0, square / n - mean * mean))
    high = x >= 96
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    return f"ms={facts['stamps_ms'][-1]};mean={mean:.3f};std={spread:.3f};crossings={crossings};packets={facts['packets']};pages={facts['pages']}"


def _store(doc_id, text):
    return doc_id, len(text), encode(payload(text), len(text))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) for every row: its text, null as empty, as an Ogg file.

    Equal texts give equal files, repeated rows repeat, and an empty table gives an empty result.
    """
    return per_row(doc_frame(docs, id_col, text_col), _store, "doc_id long, n_bytes long, media binary")


def _read(doc_id, n_bytes, media):
    if media is None:
        return doc_id, n_bytes, None, None, None, None, None, "no media", None
    whole = len(media), hashlib.sha256(media).hexdigest()
    try:
        data, told, facts = decode(media)
        if n_bytes is not None and told != n_bytes:
            raise OggError(f"{told} bytes noted, {n_bytes} expected")
    except OggError as e:
        return doc_id, n_bytes, None, None, None, *whole, f"damaged: {e}", None
    return doc_id, told, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), *whole, features(data, facts), float(facts["stamps_ms"][-1])


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of what :func:`store_media` stored, from the stored bytes alone; ``media`` has doc_id, n_bytes and media.

    A null cell has the feature ``no media`` and a damaged one ``damaged:`` with the reason; what cannot be told of either
    is null, and no such cell stops a job. A null n_bytes is read from the file. An empty table gives an empty result.
    """
    return per_row(media.select("doc_id", "n_bytes", F.col("media")), _read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_ms double")
