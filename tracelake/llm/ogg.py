"""Media columns: payloads in Ogg containers.

``to_media`` writes each payload as 8-bit samples into an Ogg file of two multiplexed logical streams (the
samples, and a note about them); ``from_media`` verifies every page's checksum and number, takes the
streams apart, puts packets together from lacing values and reads times off granule positions.

The payload of a text is its UTF-8 bytes and zero bytes up to a positive multiple of 64; null and empty
texts give 64 zero bytes. Equal payloads give equal files. A very long text is a file of many pages. A damaged file
has a null payload and says what is wrong in ``error``; the other rows are not affected. Repeated rows each give a row. An
empty table gives one. Input columns named like a result give way to it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import _text as T

RATE = 8000
#: Samples of one packet: two seconds.
PACKET = 16_000
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, highest bit first, from zero) by way of the mirrored one in zlib."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    page = head + body
    return page[:22] + checksum(page).to_bytes(4, "little") + page[26:]


def _lacing(sizes: list[int]) -> bytes:
    return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)


def write(payload: bytes, note: bytes = b"") -> bytes:
    """An Ogg file with the payload's samples in one logical stream and the note in another."""
    serial = zlib.crc32(payload)
    other = serial ^ 0x5A5A5A5A
    head = b"PCM8" + struct.pack("<II", RATE, 1)
    pages = [_page(FIRST, 0, serial, 0, _lacing([len(head)]), head), _page(FIRST, 0, other, 0, _lacing([4]), b"NOTE")]
    sizes = [min(PACKET, len(payload) - k) for k in range(0, len(payload), PACKET)]
    lacing = _lacing(sizes)
    at, ended, fresh = 0, 0, True
    for number, k in enumerate(range(0, len(lacing), 255), 1):
        part = lacing[k : k + 255]
        size = sum(part)
        whole = sum(n < 255 for n in part)
        ended += whole
        kind = (0 if fresh else CONTINUED) | (LAST if k + 255 >= len(lacing) else 0)
        granule = min(ended * PACKET, len(payload)) if whole else -1
        pages.append(_page(kind, granule, serial, number, part, payload[at : at + size]))
        at, fresh = at + size, part[-1] < 255
        if number == 1:
            pages.append(_page(LAST, 0, other, 1, _lacing([len(note)]), note))
    return b"".join(pages)


def read(media: bytes) -> dict[bytes, dict]:
    """The logical streams of a file by the first four bytes of their first packet: packets, pages, and the sample
    position at the end of each page that ends a packet."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        mark, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(media, at) if len(media) - at >= 27 else (b"",) * 8
        if mark != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc or len(lacing) != n or end > len(media):
            raise ValueError(f"page at byte {at} is damaged")
        s = streams.setdefault(serial, {"packets": [], "part": [], "pages": 0, "granules": [], "ended": False})
        if number != s["pages"] or bool(kind & FIRST) != (number == 0) or bool(kind & CONTINUED) != bool(s["part"]) or s["ended"]:
            raise ValueError(f"page at byte {at} is out of order")
        a = b = body
        for size in lacing:
            b += size
            if size < 255:
                s["packets"].append(b"".join([*s["part"], media[a:b]]))
                s["part"], a = [], b
        if b > a:
            s["part"].append(media[a:b])
        s["pages"] += 1
        s["ended"] = bool(kind & LAST)
        if granule >= 0:
            s["granules"].append(granule)
        at = end
    if any(s["part"] or not s["ended"] or not s["packets"] for s in streams.values()):
        raise ValueError("a stream stops in a packet, without one or without its last page")
    return {s["packets"][0][:4]: s for s in streams.values()}


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def features(stream: dict) -> str:
    """Length in milliseconds from the last granule position, packets, pages, and the samples' mean and swing."""
    samples = np.frombuffer(b"".join(stream["packets"][1:]), np.uint8)
    rate = struct.unpack_from("<I", stream["packets"][0], 4)[0]
    mean = int(samples.sum(dtype=np.int64)) * 1000 // max(1, len(samples))
    swing = int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64)) * 1000 // max(1, len(samples) - 1)
    return f"ms={stream['granules'][-1] * 1000 // rate} packets={len(stream['packets']) - 1} pages={stream['pages']} mean={mean} swing={swing}"


def _row(media: bytes) -> tuple[bytes | None, int | None, str | None, str | None]:
    """(payload, milliseconds, feature, error) of a file."""
    try:
        s = read(media)[b"PCM8"]
        return b"".join(s["packets"][1:]), s["granules"][-1] * 1000 // RATE, features(s), None
    except KeyError:
        return None, None, None, "there is no stream of samples"
    except (ValueError, IndexError, struct.error) as e:
        return None, None, None, str(e)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media) of every row: its text's payload as an Ogg file."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.column(batch, "text")
            for i, j in T.slices(off):
                raw, rows = buf[off[i] : off[j]].tobytes(), (off[i : j + 1] - off[i]).tolist()
                media = [write(payload_of(raw[a:b]), b"bytes=%d" % (b - a)) for a, b in zip(rows, rows[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def from_media(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored`` with payload (read back), duration_ms, feature and error, in place of its columns of these names. A null
    file gives nulls, a damaged one nulls and the error."""
    more = [StructField("payload", BinaryType()), StructField("duration_ms", LongType()), StructField("feature", StringType()), StructField("error", StringType())]
    taken = {f.name for f in more}
    kept = [k for k, c in enumerate(stored.columns) if c.lower() not in taken]
    schema = StructType([*[stored.schema[k] for k in kept], *more])
    at = stored.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, ms, feature, error = [], [], [], []
            for media in batch.column(at):
                row = (None, None, None, None) if media.as_py() is None else _row(media.as_py())
                for column, value in zip((payload, ms, feature, error), row):
                    column.append(value)
            more = [pa.array(payload, pa.binary()), pa.array(ms, pa.int64()), pa.array(feature, pa.string()), pa.array(error, pa.string())]
            names = [*[batch.schema.names[k] for k in kept], "payload", "duration_ms", "feature", "error"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *more], names)

    return stored.mapInArrow(run, schema)
