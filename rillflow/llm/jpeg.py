"""Baseline JPEG frames into arrays: any Huffman and quantisation tables, sampling factors and restart intervals. Small helper
of the media operator; frames of its own are read by a shorter way there."""

from __future__ import annotations

import functools
import struct

import numpy as np

# fixed values: the order in which a block's coefficients are coded
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
# fixed values: the standard's example Huffman tables, which AVI frames may leave out (codes of 1 to 16 bits, then symbols in hex)
DEFAULT = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), "000102030405060708090a0b"),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), "000102030405060708090a0b"),
    0x10: (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a53545556575859"
        "5a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2"
        "e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758"
        "595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da"
        "e2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}
_k = np.arange(8)
BASIS = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k == 0, np.sqrt(0.5), 1)[:, None] / 2


@functools.lru_cache(64)
def lookup(counts: tuple[int, ...], symbols: bytes) -> list[int]:
    """For each 16 bits, 256 * (bits of the code that they begin with) + its symbol; 0 where there is none."""
    out, code, at = [0] * (1 << 16), 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            first = code << (16 - n)
            out[first : first + (1 << (16 - n))] = [n << 8 | symbols[at]] * (1 << (16 - n))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _coefficients(data: bytes, order: list[tuple[np.ndarray, list[int], list[int], int]], start: int) -> None:
    """Reads blocks of one restart interval: order gives, block by block, where to (a row), its tables and its component."""
    data += b"\xff" * 8
    at, dc = start, {}
    for row, first, rest, part in order:
        k = 0
        while k < 64:
            window = int.from_bytes(data[at >> 3 : (at >> 3) + 8]) << (at & 7) & 0xFFFFFFFFFFFFFFFF
            found = (first if k == 0 else rest)[window >> 48]
            if not found:
                raise ValueError("a code that no Huffman table has")
            n, symbol = found >> 8, found & 255
            size = symbol & 15
            value = (window >> (64 - n - size)) & ((1 << size) - 1)
            if size and not value >> (size - 1):
                value -= (1 << size) - 1
            at += n + size
            if k == 0:
                dc[part] = dc.get(part, 0) + value
                row[0], k = dc[part], 1
            elif symbol == 0:
                break
            else:
                k += symbol >> 4
                if size:
                    if k > 63:
                        raise ValueError("a block of more than 64 coefficients")
                    row[k] = value
                k += 1
        if at > 8 * (len(data) - 8):
            raise ValueError("the frame ends within a block")


def decode(jpeg: bytes) -> np.ndarray:
    """Grey: a matrix of samples; colour: rows x columns x 3 of YCbCr. Frames that aren't baseline raise ValueError."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, steps, parts, every, shape = 2, {}, [], 0, None
    tables = {k: lookup(c, bytes.fromhex(s)) for k, (c, s) in DEFAULT.items()}
    while True:
        while jpeg[at] == 0xFF and jpeg[at + 1] == 0xFF:
            at += 1
        mark, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                steps[body[i] & 15] = np.array(struct.unpack_from(">64H" if wide else ">64B", body, i + 1), float)
                i += 129 if wide else 65
        elif mark == 0xC4:
            i = 0
            while i < len(body):
                counts = tuple(body[i + 1 : i + 17])
                tables[body[i]] = lookup(counts, body[i + 17 : i + 17 + sum(counts)])
                i += 17 + sum(counts)
        elif mark in (0xC0, 0xC1):
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            shape = (high, wide)
            if bits != 8:
                raise ValueError("only 8-bit samples")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark != 0xCC:
            raise ValueError("not a baseline frame")
        elif mark == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            break
    if shape is None or len(parts) not in (1, 3) or body[0] != len(parts):
        raise ValueError("only grey and three-part frames of one scan")
    scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # one part alone is coded block by block
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    down, across = -(-shape[0] // (8 * most_v)), -(-shape[1] // (8 * most_h))
    planes = [np.zeros((down * v, across * h, 64)) for _, h, v, _ in parts]
    end = jpeg.rindex(b"\xff\xd9") if b"\xff\xd9" in jpeg[at:] else len(jpeg)
    runs, begin = [], at  # between restart marks
    for i in range(at, end - 1):
        if jpeg[i] == 0xFF and 0xD0 <= jpeg[i + 1] <= 0xD7:
            runs.append(jpeg[begin:i])
            begin = i + 2
    runs.append(jpeg[begin:end])
    every = every or down * across
    if len(runs) < -(-down * across // every):
        raise ValueError("restart intervals are missing")
    for n, raw in enumerate(runs):
        order = []
        for unit in range(n * every, min((n + 1) * every, down * across)):
            y, x = divmod(unit, across)
            for part, ((name, h, v, _), plane) in enumerate(zip(parts, planes, strict=True)):
                first, rest = tables[scan[name] >> 4], tables[0x10 | scan[name] & 15]
                order += [(plane[y * v + j, x * h + i], first, rest, part) for j in range(v) for i in range(h)]
        _coefficients(raw.replace(b"\xff\x00", b"\xff"), order, 0)
    out = []
    for (_, h, v, q), plane in zip(parts, planes, strict=True):
        blocks = np.zeros_like(plane)
        blocks[..., ZIGZAG] = plane * steps[q]
        samples = BASIS.T @ blocks.reshape(*plane.shape[:2], 8, 8) @ BASIS
        flat = samples.transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, plane.shape[1] * 8)
        whole = np.clip(np.rint(flat + 128), 0, 255).astype(np.uint8)
        out.append(np.kron(whole, np.ones((most_v // v, most_h // h), np.uint8))[: shape[0], : shape[1]])
    return out[0] if len(out) == 1 else np.stack(out, 2)
