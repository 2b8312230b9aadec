"""Media columns: MPEG audio streams written and read byte by byte.

A payload travels losslessly in the ancillary data of silent MPEG-1 Layer III frames. The reader
resynchronises on frame headers, parses tags and the variable-bitrate table, verifies checksums and
gives exact durations and frame offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import take

# Fixed values of the format, ISO/IEC 11172-3: kbit/s of Layer III by index, and sample rates by index.
KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
SIDE = 17  # bytes of side information of one channel
HEAD = 4 + 2 + SIDE
RATE = 2  # 32 kHz


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The frame checksum: polynomial x^16 + x^15 + x^2 + 1, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def frame_length(kbits_index: int, rate_index: int = RATE, padding: int = 0) -> int:
    return 144_000 * KBITS[kbits_index] // RATES[rate_index] + padding


def _head(kbits_index: int) -> bytes:
    """Header (MPEG-1, Layer III, protected, one channel), checksum and empty side information."""
    header = bytes((0xFF, 0xFA, kbits_index << 4 | RATE << 2, 0xC0))
    side = bytes(SIDE)
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


HEADS = [_head(i) if i else b"" for i in range(len(KBITS))]
ROOM = [frame_length(i) - HEAD if i else 0 for i in range(len(KBITS))]


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _id3v2(payload_bytes: int) -> bytes:
    body = b"\x03payload_bytes\x00" + str(payload_bytes).encode()
    frame = b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _syncsafe(len(frame)) + frame


def encode(payload: bytes) -> bytes:
    """A playable stream that holds the payload: ID3v2 tag, frame with the bitrate table, frames, ID3v1 tag.

    Frames run at 320 kbit/s; the last is of the smallest bitrate that takes what is left.
    """
    most = len(KBITS) - 1
    full, rest = divmod(len(payload), ROOM[most])
    out = []
    for i in range(full):
        out += (HEADS[most], payload[i * ROOM[most] : (i + 1) * ROOM[most]])
    sizes_full = frame_length(most)
    last = 0
    if rest:
        k = next(i for i in range(1, len(KBITS)) if ROOM[i] >= rest)
        out += (HEADS[k], payload[full * ROOM[most] :], bytes(ROOM[k] - rest))
        last = frame_length(k)
    frames = full + bool(rest)
    k = next(i for i in range(1, len(KBITS)) if ROOM[i] >= 120)
    total = frame_length(k) + full * sizes_full + last
    toc = bytes(min(255, (frame_length(k) + min(full, i * frames // 100) * sizes_full) * 256 // max(1, total)) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, frames, total) + toc
    info = HEADS[k] + table + bytes(ROOM[k] - len(table))
    return b"".join((_id3v2(len(payload)), info, *out, b"TAG" + b"payload".ljust(30, b"\0") + bytes(95)))


def _frame_at(data: bytes, at: int, end: int) -> tuple[int, int, int, int, bool] | None:
    """(length, sample rate, kbit/s, start of main data, checksum verified) if a whole, valid frame begins here."""
    if at + 4 > end or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    b2, b3 = data[at + 2], data[at + 3]
    kbits, rate = b2 >> 4, b2 >> 2 & 3
    if kbits in (0, 15) or rate == 3:
        return None
    side = 17 if b3 >> 6 == 3 else 32
    protected = not data[at + 1] & 1
    length = frame_length(kbits, rate, b2 >> 1 & 1)
    body = at + 4 + 2 * protected
    if at + length > end or body + side > at + length:
        return None
    if protected:
        said, cover = data[at + 4 : at + 6], data[at + 2 : at + 4] + data[body : body + side]
        ours = HEADS[kbits] if kbits < len(HEADS) else b""
        if data[at : at + HEAD] != ours and said != struct.pack(">H", crc16(cover)):
            return None
    return length, RATES[rate], KBITS[kbits], body + side, protected


def decode(media: bytes) -> dict:
    """Parse a stream: payload, frames, duration (exact, in seconds), offsets, tags, skipped bytes, crc_ok.

    Bytes that are no valid frame (damage, garbage between frames) are skipped to the next header whose
    checksum holds and whose successor, if any, is a frame too; `skipped` counts them. The payload is what
    the frames' main data hold, cut to the length in the tag if there is one.
    """
    at, end, size, tags = 0, len(media), None, []
    if media[:3] == b"ID3" and end >= 10:
        n = sum((b & 127) << s for b, s in zip(media[6:10], (21, 14, 7, 0), strict=True))
        body, at = media[10 : 10 + n], 10 + n
        tags.append(f"ID3v2.{media[3]}")
        mark = b"payload_bytes\x00"
        if mark in body:
            digits = body.split(mark, 1)[1].split(b"\0")[0]
            size = int(digits) if digits.isdigit() else None
    if end >= 128 and media[end - 128 : end - 125] == b"TAG":
        tags.append("ID3v1")
        end -= 128
    offsets, parts, skipped, samples, table, bits = [], [], 0, Fraction(0), None, set()
    synced = True
    while at < end:
        frame = _frame_at(media, at, end)
        if frame and not (synced and frame[4]) and at + frame[0] < end and not _frame_at(media, at + frame[0], end):
            frame = None
        if not frame:
            synced, start = False, at
            at = media.find(b"\xff", at + 1, end)
            at = end if at < 0 else at
            skipped += at - start
            continue
        synced, (length, rate, kbits, main, _) = True, frame
        if table is None and not offsets and media[main : main + 4] in (b"Xing", b"Info"):
            flags, frames, total = struct.unpack(">III", media[main + 4 : main + 16])
            table = {"frames": frames, "bytes": total, "toc": media[main + 16 : main + 116] if flags & 4 else b""}
        else:
            offsets.append(at)
            parts.append(media[main : at + length])
            samples += Fraction(SAMPLES, rate)
            bits.add(kbits)
        at += length
    payload = b"".join(parts)
    whole = table is None or table["frames"] == len(offsets)
    if size is not None:
        whole = whole and size <= len(payload)
        payload = payload[:size]
    return {"payload": payload, "frames": len(offsets), "duration": samples, "offsets": offsets, "tags": tags, "skipped": skipped, "ok": whole and not skipped, "table": table, "kbits": sorted(bits)}


def pad(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length and its bytes padded by zeros to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def encode_text(text: Column | str) -> Column:
    """The MPEG audio stream (BINARY) that stores a text; null is stored as the empty text."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: encode(pad(t)[1]))

    return run(text)


PARSED = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "duration_s double, duration_samples long, frames long, seek array<long>, intact boolean"
)


def parse_media(media: Column) -> Column:
    """Everything read back from stored streams, as a STRUCT; a null stream gives null fields."""

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 11
        got = decode(data)
        body = got["payload"]
        seek = got["offsets"]
        crc = zlib.crc32(struct.pack(f"<{len(seek)}Q", *seek))
        # At whatever rates the frames run, the samples are counted at 32 kHz where that is exact.
        feature = f"frames={got['frames']};duration={got['duration']}s;kbits={'/'.join(map(str, got['kbits']))};tags={'+'.join(got['tags'])};skipped={got['skipped']};seek_crc32={crc}"
        return (
            len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature,
            float(got["duration"]), got["frames"] * SAMPLES, got["frames"], seek, got["ok"],
        )

    names = [f.split()[0] for f in PARSED.split(", ")]

    @F.pandas_udf(PARSED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([one(x) for x in part], columns=names).astype(object)

    return run(media)


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8, unpadded) and media (BINARY) for each row of docs.

    Null texts are empty ones; both store 64 zero bytes. Repeated rows and null keys each give their row, extra
    columns are ignored, an empty table gives an empty result. One row is one stream; no shuffle.
    """
    rows = take(docs, key, text)
    return rows.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), encode_text(F.col(text)).alias("media"))


def read_media(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes and the fields of PARSED, read back from the stored bytes of store_texts()."""
    got = stored.select(key, "n_bytes", parse_media(F.col("media")).alias("r"))
    return got.select(key, "n_bytes", "r.*")
