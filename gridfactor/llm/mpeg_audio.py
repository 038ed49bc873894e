"""Media columns: MPEG audio streams that carry payload bytes, and a reader of MPEG-1/2/2.5 audio streams.

The writer makes a stream of MPEG-1 Layer III frames (mono, 48 kHz, 224 kbit/s, 672 bytes, CRC-protected,
silent: all side information is zero).  The main data of each frame is ancillary and holds 576 payload
bytes.  An ID3v2 tag and a frame with a variable-bitrate ("Info") table of 100 seek points come first.

The reader finds the first frame after any tags and resynchronises behind damage: a header counts if the
next one, at the distance that its bitrate says, has the same version, layer and sample rate (or the
stream ends there).  It reads ID3v2.2 to 2.4 and ID3v1 tags (a frame's own bytes at an ID3v1 tag's place are no tag), and the tables Xing, Info and VBRI, whose frame
and byte counts it compares with the stream.  It verifies the CRC-16 of Layer I and Layer III frames; those
of Layer II, which cover bits that only a decoder's allocation tables tell, are counted as unverified.  It
yields the exact duration as samples and the sample rate, and each frame's byte offset for seeks.  Free
bitrates aren't read.

Nulls: a null text is an empty payload; a null stream has null features, and one without frames has no
sample rate and no duration.  A stream without the writer's tag has null n_bytes.  Empty payloads get one
frame of 576 filling bytes.  Ids are not stored, so equal texts have equal media.  Empty tables give no
rows; repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

UNIT = 576
FRAME = 672
HEAD = bytes([0xFF, 0xFA, 0xC4, 0xC0])  # MPEG-1, Layer III, CRC; 224 kbit/s, 48 kHz, no padding; mono
SIDE = bytes(17)
ROOM = FRAME - 4 - 2 - len(SIDE)

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, Hz by index, samples a frame.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
VERSIONS = {0: 2.5, 2: 2, 3: 1}
#: Text encodings of ID3v2 frames.
ENCODINGS = {b"\x00": "latin-1", b"\x01": "utf-16", b"\x02": "utf-16-be", b"\x03": "utf-8"}


def crc16(data: bytes) -> int:
    """The CRC of MPEG audio frames: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ CRC_TABLE[crc >> 8 ^ byte]
    return crc


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        crc = k << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
        out.append(crc)
    return out


CRC_TABLE = _crc_table()
_PREFIX = HEAD + struct.pack(">H", crc16(HEAD[2:] + SIDE)) + SIDE


def padded(data: bytes) -> bytes:
    """The bytes with 255s up to a positive multiple of 576."""
    n = max(1, -(-len(data) // UNIT)) * UNIT
    return data + b"\xff" * (n - len(data))


def _tag(n_bytes: int) -> bytes:
    """An ID3v2.4 tag that says how many bytes of the payload are real."""
    text = b"\x03payload_bytes\x00" + str(n_bytes).encode()
    body = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _syncsafe(len(body)) + body


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(data: bytes) -> bytes:
    """An MPEG audio stream with the padded bytes in its frames."""
    payload = np.frombuffer(padded(data), np.uint8).reshape(-1, UNIT)
    frames = np.zeros((len(payload), FRAME), np.uint8)
    frames[:, : len(_PREFIX)] = np.frombuffer(_PREFIX, np.uint8)
    frames[:, len(_PREFIX) : len(_PREFIX) + UNIT] = payload
    total = (len(frames) + 1) * FRAME
    seek = bytes(min(255, 256 * FRAME * (1 + k * len(frames) // 100) // total) for k in range(100))
    table = (_PREFIX + b"Info" + struct.pack(">III", 7, len(frames), total) + seek).ljust(FRAME, b"\x00")
    return _tag(len(data)) + table + frames.tobytes()


def header(data: bytes, at: int) -> tuple | None:
    """version, layer, protected, bit/s, Hz, bytes, samples, mono of a frame header; None if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] < 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = VERSIONS.get(b1 >> 3 & 3), 4 - (b1 >> 1 & 3)
    if version is None or layer == 4 or b2 >> 4 in (0, 15) or b2 >> 2 & 3 == 3:
        return None
    family = 1 if version == 1 else 2
    bits, hertz, samples = KBITS[family, layer][b2 >> 4] * 1000, HERTZ[version][b2 >> 2 & 3], SAMPLES[family, layer]
    pad = b2 >> 1 & 1
    size = (12 * bits // hertz + pad) * 4 if layer == 1 else samples // 8 * bits // hertz + pad
    return version, layer, not b1 & 1, bits, hertz, size, samples, b3 >> 6 == 3


def tag_bytes(data: bytes, at: int = 0) -> int:
    """Bytes of an ID3v2 tag at a place, 0 if there is none."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(x > 127 for x in data[at + 6 : at + 10]):
        return 0
    a, b, c, d = data[at + 6 : at + 10]
    return 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if data[at + 5] & 0x10 else 0)


def old_tag(data: bytes) -> int:
    """Where an ID3v1 tag would begin, the stream's length if there is none; only scan() tells whether a frame holds these bytes."""
    return len(data) - (128 if len(data) >= 128 and data[-128:-125] == b"TAG" else 0)


def tags(data: bytes) -> dict[str, str]:
    """The text frames of an ID3v2 tag at the stream's start, user texts by their description; else title, artist and so on of an ID3v1 tag."""
    out, end = {}, tag_bytes(data)
    old = end and data[3] == 2  # version 2.2: names of three letters, sizes of three bytes
    at, name_size, size_of = 10, 3 if old else 4, 3 if old else 4
    if end and data[3] >= 3 and data[5] & 0x40:  # an extended header
        n = sum(x << (7 if data[3] == 4 else 8) * k for k, x in enumerate(reversed(data[10:14])))
        at += n if data[3] == 4 else n + 4
    while at + name_size + size_of <= end and data[at] >= 48:
        n = sum(x << (7 if data[3] == 4 else 8) * k for k, x in enumerate(reversed(data[at + name_size : at + name_size + size_of])))
        name, at = data[at : at + name_size].decode("latin-1"), at + name_size + size_of + (0 if old else 2)
        body = data[at : at + n]
        if name[0] == "T" and body[:1] in ENCODINGS:
            parts = body[1:].decode(ENCODINGS[body[:1]], "replace").split("\0")
            user = name in ("TXXX", "TXX")
            out[parts[0].lstrip("\ufeff") if user else name] = (parts[min(1, len(parts) - 1)] if user else parts[0]).lstrip("\ufeff")
        at += n
    if not end and old_tag(data) < len(data) and scan(data)["old_tag"]:
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            out[key] = data[-128 + a : -128 + b].split(b"\0")[0].decode("latin-1").rstrip()
    return out


def crc_of(data: bytes, at: int, h: tuple) -> bool | None:
    """Whether a protected frame's CRC is right; None for Layer II."""
    version, layer, _, _, _, _, _, mono = h
    start = at + 6
    if layer == 3:
        covered = data[start : start + ((17 if mono else 32) if version == 1 else (9 if mono else 17))]
    elif layer == 1:
        mode, bound = data[at + 3] >> 6, 4 * (data[at + 3] >> 4 & 3) + 4
        bits = 128 if mono else 4 * (2 * bound + 32 - bound) if mode == 1 else 256  # joint stereo shares the subbands from the bound
        covered = data[start : start + bits // 8]
    else:
        return None
    return crc16(data[at + 2 : at + 4] + covered) == data[at + 4] << 8 | data[at + 5]


def scan(data: bytes) -> dict:
    """Everything about a stream: frames' offsets, samples, Hz, CRCs, the variable-bitrate table, skipped bytes."""
    at, first, offsets, samples, bad, checked, unverified, skipped, table, bits = tag_bytes(data), None, [], 0, 0, 0, 0, 0, None, set()
    end, tag = len(data), old_tag(data)
    while at < (stop := tag if at <= tag else end):  # behind the tag's place only by a frame that holds it
        h = header(data, at)
        fits = h is not None and at + h[5] <= end and (first is None or (h[0], h[1], h[4]) == (first[0], first[1], first[4]))
        if fits and at + h[5] not in (tag, end):
            after = header(data, at + h[5])
            fits = after is not None and (after[0], after[1], after[4]) == (h[0], h[1], h[4])
        if not fits:
            nxt = data.find(b"\xff", at + 1, stop)
            skipped += (nxt if nxt >= 0 else stop) - at
            at = nxt if nxt >= 0 else stop
            continue
        if h[2]:
            right = crc_of(data, at, h)
            checked += right is not None
            bad += right is False
            unverified += right is None
        if first is None:
            first = h
            table = _table(data, at, h)
            if table is not None:
                at += h[5]
                continue
        offsets.append(at)
        bits.add(h[3])
        samples += h[6]
        at += h[5]
    return {"header": first, "offsets": offsets, "samples": samples, "bad_crc": bad, "crc": checked, "unverified": unverified, "skipped": skipped, "table": table, "vbr": len(bits) > 1, "old_tag": at == tag < end}


def _table(data: bytes, frame: int, h: tuple) -> dict | None:
    """The variable-bitrate table in a Layer III frame: its kind, frames, bytes and seek points (byte offsets from the table's frame on)."""
    if h[1] != 3:
        return None
    stop = frame + h[5]
    at = frame + 4 + 2 * h[2] + ((17 if h[7] else 32) if h[0] == 1 else (9 if h[7] else 17))
    kind = data[at : at + 4]
    if kind in (b"Xing", b"Info") and at + 8 <= stop:
        out: dict = {"kind": kind.decode(), "seek": None}
        flags, at = struct.unpack_from(">I", data, at + 4)[0], at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and at + 4 <= stop:
                out[name] = struct.unpack_from(">I", data, at)[0]
                at += 4
        if flags & 4 and at + 100 <= stop:
            out["seek"] = [x * out["bytes"] // 256 for x in data[at : at + 100]] if "bytes" in out else None
        return out
    at = frame + 36  # VBRI comes 32 bytes behind the header, whatever the channels
    if data[at : at + 4] == b"VBRI" and at + 26 <= stop:
        n_bytes, frames, entries, scale, width, _ = struct.unpack_from(">IIHHHH", data, at + 10)
        steps = [int.from_bytes(data[at + 26 + k * width : at + 26 + (k + 1) * width], "big") * scale for k in range(entries)] if at + 26 + entries * width <= stop else []
        return {"kind": "VBRI", "frames": frames, "bytes": n_bytes, "seek": [sum(steps[:k]) for k in range(len(steps))] or None}
    return None


def decode(data: bytes, found: dict) -> bytes:
    """The padded payload from the frames that scan() found in a stream of encode()."""
    start = len(_PREFIX)
    return b"".join(data[at + start : at + start + UNIT] for at in found["offsets"])  # of other streams: what lies there


ENCODED = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
READ = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    + [("n_samples", pa.int64()), ("sample_rate", pa.int32()), ("duration_s", pa.float64()), ("seek_offsets", pa.list_(pa.int64()))]
)


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):  # small batches: media are large
            part = batch.slice(k, 64)
            media = [encode(x or b"") for x in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(media, pa.binary())], schema=ENCODED)


def _read(doc_id: int | None, data: bytes | None) -> tuple:
    if data is None:
        return (doc_id, *[None] * (len(READ) - 1))
    found = scan(data)
    payload = decode(data, found)
    version, layer, _, _, hertz, *_ = found["header"] or (0, 0, None, None, None)
    table = found["table"] or {}
    whole = table.get("frames") == len(found["offsets"]) and table.get("bytes") == len(data) - tag_bytes(data)
    feature = f"MPEG-{version:g} layer {layer}; {hertz} Hz; frames {len(found['offsets'])}; samples {found['samples']}; crc {found['crc'] - found['bad_crc']}/{found['crc']}; skipped {found['skipped']}; table {'whole' if whole else 'wrong' if table else 'none'}; {'vbr' if found['vbr'] else 'cbr'}"
    n_bytes = tags(data).get("payload_bytes", "")
    sums = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest()
    return (doc_id, int(n_bytes) if n_bytes.isdecimal() else None, len(payload), *sums, feature if found["header"] else "no frames", found["samples"], hertz, found["samples"] / hertz if hertz else None, found["offsets"])


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_read(doc_id, media.as_py()) for doc_id, media in zip(batch["doc_id"].to_pylist(), batch["media"])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ)], schema=READ)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `media`, the MPEG audio stream of each text's bytes."""
    return docs.selectExpr(f"{id_col} AS doc_id", f"CAST({text_col} AS BINARY) AS text").mapInArrow(_encode_batches, "doc_id long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read streams back: sizes, digests, a feature string, exact duration and the byte offset of each frame."""
    return media.mapInArrow(_read_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_samples long, sample_rate int, duration_s double, seek_offsets array<long>")


def op3_mpeg_audio(docs: DataFrame) -> DataFrame:
    """The digest columns, the exact duration, and the frames' seek offsets as a list in text."""
    found = media_features(stored(media_column(docs)))
    seek = F.array_join(F.transform("seek_offsets", lambda x: x.cast("string")), ",").alias("seek_offsets")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_samples", "sample_rate", "duration_s", seek)
