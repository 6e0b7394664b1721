"""AVI motion-JPEG columns: bytes kept as frames, read back through the RIFF index, and cut into shots.

A byte is one sample: an 8 x 8 block of constant grey. Its frame is a baseline JPEG whose DC step is 8, so the
block's DC value is the byte less 128 and nothing is lost. The Huffman table gives category s (the number of extra bits)
a code of 9 - s bits and an end-of-block of one bit, so each block takes 10 bits and whole frames are coded and
decoded as bit matrices. A frame has WIDTH samples a row and up to HEIGHT rows; a smaller payload has one lower frame.
The true number of samples stands in a RIFF chunk of its own, since the last frame is padded with 0.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import chunks

WIDTH, HEIGHT, FPS = 64, 64, 25
CODE, BITS, BACK, SPREAD, FLOOR, CHECKED = 9, 16, 8, 3.0, 0.05, 256


def _codes(lengths: dict[int, int]) -> dict[int, str]:
    """Canonical Huffman codes, shortest first, as strings of bits."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], code, last = format(code, f"0{n}b"), code + 1, n
    return out


LENGTHS = {s: CODE - s for s in range(9)}


def _bits_of(difference: int) -> str:
    s = abs(difference).bit_length()
    extra = difference if difference > 0 else difference + (1 << s) - 1
    return _codes(LENGTHS)[s] + (format(extra, f"0{s}b") if s else "") + "0"


#: 10 bits of each difference of neighbours from -255 to 255, and the difference of each 10 bits.
CODED = np.array([int(_bits_of(d), 2) for d in range(-255, 256)], np.uint16)
DECODED = np.zeros(1024, np.int16)
DECODED[CODED] = np.arange(-255, 256)


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, mark, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes([kind, *(sum(n == i for n in lengths.values()) for i in range(1, 17)), *order])


def frame(samples: np.ndarray) -> bytes:
    """A grey baseline JPEG of a matrix of samples."""
    rows, columns = samples.shape
    flat = samples.reshape(-1).astype(np.int16)
    coded = CODED[np.diff(flat, prepend=np.int16(128)) + 255]
    bits = ((coded[:, None] >> np.arange(9, -1, -1, dtype=np.uint16)) & 1).astype(np.uint8).reshape(-1)
    raw = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    head = _segment(0xDB, b"\x00" + b"\x08" + b"\x01" * 63) + _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, columns * 8, 1, 1, 0x11, 0))
    head += _segment(0xC4, _table(0x00, LENGTHS)) + _segment(0xC4, _table(0x10, {0: 1})) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    return b"\xff\xd8" + head + raw + b"\xff\xd9"


def unframe(raw: bytes) -> np.ndarray:
    """The samples of a frame; only frames of constant blocks under the tables above are known."""
    at, shape, step, tables = 2, None, 0, {}
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    while True:
        mark, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            step = body[1]
        elif mark == 0xC0:
            _, high, wide, parts = struct.unpack_from(">BHHB", body)
            shape = (high // 8, wide // 8)
            if parts != 1:
                raise ValueError("only grey frames")
        elif mark == 0xC4:
            tables[body[0]] = body
        elif mark == 0xDA:
            break
    if shape is None or step != 8 or tables.get(0) != _table(0x00, LENGTHS) or tables.get(16) != _table(0x10, {0: 1}):
        raise ValueError("not a frame of constant blocks")
    coded = np.frombuffer(raw[at : raw.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff"), np.uint8)
    n = shape[0] * shape[1]
    bits = np.unpackbits(coded)[: n * 10].reshape(n, 10)
    value = bits @ (1 << np.arange(9, -1, -1, dtype=np.uint16))
    return (np.cumsum(DECODED[value], dtype=np.int64) + 128).astype(np.uint8).reshape(shape)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI of the payload, whose length is a positive multiple of WIDTH."""
    rows = min(HEIGHT, len(payload) // WIDTH)
    size = rows * WIDTH
    whole = np.frombuffer(payload + b"\x00" * (-len(payload) % size), np.uint8).reshape(-1, rows, WIDTH)
    frames = [frame(f) for f in whole]
    wide, high = WIDTH * 8, rows * 8
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, max(map(len, frames)), wide, high, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), max(map(len, frames)), 0, 0, 0, 0, wide, high)
    form = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movie.append(_chunk(b"00dc", f))
        at += len(movie[-1])
    body = b"AVI " + header + _chunk(b"smpl", struct.pack("<Q", len(payload))) + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def image(frame_bytes: bytes) -> np.ndarray:
    """The brightness of a frame: of to_avi()'s frames one sample a block, of others every pixel."""
    try:
        return unframe(frame_bytes)
    except ValueError:
        found = jpeg.decode(frame_bytes)
        return found if found.ndim == 2 else found[:, :, 0]


def open_avi(avi: bytes) -> tuple[list[bytes], float, int | None]:
    """The frames' bytes by way of the index, the seconds of a frame, and the number of samples if the file says it."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, found = 12, {}
    while at + 8 <= len(avi):
        name, size = struct.unpack_from("<4sI", avi, at)
        key = name + avi[at + 8 : at + 12] if name == b"LIST" else name
        found[key] = (at + 8, size)
        at += 8 + size + size % 2
    if not {b"LISTmovi", b"LISThdrl", b"idx1"} <= found.keys():
        raise ValueError("an AVI file without header, frames or index")
    movie, (index, size) = found[b"LISTmovi"][0], found[b"idx1"]
    seconds = struct.unpack_from("<I", avi, found[b"LISThdrl"][0] + 12)[0] / 1e6
    frames, base = [], None
    for name, _, offset, length in struct.iter_unpack("<4sIII", avi[index : index + size // 16 * 16]):
        if name[2:] in (b"dc", b"db"):
            if base is None:  # places count from the list of frames, in some files from the file's start
                base = movie if avi[movie + offset : movie + offset + 4] == name else 0
            frames.append(avi[base + offset + 8 : base + offset + 8 + length])
    n = struct.unpack_from("<Q", avi, found[b"smpl"][0])[0] if b"smpl" in found else None
    return frames, seconds, n


def intra(frame_bytes: bytes) -> np.ndarray:
    """The samples of a frame of write_avi(). Of CHECKED frames, told by their digest, one is also read by the decoder of any
    baseline frame, which takes a hundred times as long; the job fails if the two differ."""
    samples = unframe(frame_bytes)
    if zlib.crc32(frame_bytes) % CHECKED == 0 and (jpeg.decode(frame_bytes) != np.kron(samples, np.ones((8, 8), np.uint8))).any():
        raise ValueError("two ways to read a frame differ")
    return samples


def read_avi(avi: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """Payload, frames and seconds a frame of a file of write_avi()."""
    found, seconds, n = open_avi(avi)
    frames = [intra(f) for f in found]
    return b"".join(f.tobytes() for f in frames)[:n], frames, seconds


def shots(frames: Iterable[np.ndarray]) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot. A shot begins where the histogram's change is over the mean of the
    last BACK changes in the shot by SPREAD deviations and by FLOOR at least."""
    histograms = [np.bincount(f.reshape(-1) >> 4, minlength=BITS) / f.size for f in frames]
    if not histograms:
        return []
    starts, recent = [0], []
    for i in range(1, len(histograms)):
        change = float(np.abs(histograms[i] - histograms[i - 1]).sum() / 2)
        if recent and change > np.mean(recent) + max(FLOOR, SPREAD * np.std(recent)):
            starts.append(i)
            recent = []
        else:
            recent = [*recent[-BACK + 1 :], change]
    return list(zip(starts, [*starts[1:], len(histograms)], strict=True))


def to_avi(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and avi: the text in UTF-8, padded with bytes 0 to a positive multiple of WIDTH. Null text is empty.

    A stored byte takes 10 bits, so a text of over 1.7 GB has no file that fits a value, and fails the job.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, avi binary"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches, "text"):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            made = [write_avi(r + b"\x00" * ((-len(r)) % WIDTH or (0 if r else WIDTH))) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "avi"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def read_media(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digests of the payload read back, of the file, and clips (array of start and end in seconds)."""
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<start:double,end:double>>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
        for batch in chunks(batches, "avi"):
            out = []
            for avi in batch.column("avi").to_pylist():
                payload, frames, seconds = read_avi(avi)
                clips = [{"start": round(a * seconds, 6), "end": round(b * seconds, 6)} for a, b in shots(frames)]
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), clips))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=names)

    return rows.select("doc_id", "n_bytes", "avi").mapInArrow(run, schema)


def clip_rows(media: DataFrame) -> DataFrame:
    """A row per shot: doc_id, clip (from 0), start and end in seconds."""
    return media.select("doc_id", F.posexplode("clips").alias("clip", "_c")).select("doc_id", "clip", "_c.start", "_c.end")


def shots_of(rows: DataFrame) -> DataFrame:
    """The same from any motion-JPEG files: rows has doc_id and avi. A null or empty file gives no row, a damaged one fails the job.

    A file is one value, and so is read in one task; of its frames, one is held at a time beside the histograms.
    """
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, clip int, start double, end double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches, "avi"):
            places, out = [], []
            for i, avi in enumerate(batch.column("avi").to_pylist()):
                if avi:
                    frames, seconds, _ = open_avi(avi)
                    for k, (a, b) in enumerate(shots(map(image, frames))):
                        places.append(i)
                        out.append((k, round(a * seconds, 6), round(b * seconds, 6)))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(places, pa.int64())), *columns], names=["doc_id", "clip", "start", "end"])

    return rows.select("doc_id", "avi").mapInArrow(run, schema)


def features(docs: DataFrame) -> DataFrame:
    """The digests of read_media() over to_avi(), and feature: number of shots, then their end times in seconds."""
    media = read_media(to_avi(docs))
    ends = F.array_join(F.transform("clips", lambda c: F.format_string("%.2f", c["end"])), ",")
    return media.select(*[c for c in media.columns if c != "clips"], F.concat(F.size("clips").cast("string"), F.lit(":"), ends).alias("feature"))
