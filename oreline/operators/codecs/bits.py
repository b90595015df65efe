"""Numbers and bits as bytes: LEB128, fixed-width packing, masks, checksums."""

from __future__ import annotations

import numpy as np


class Corrupt(ValueError):
    """Bytes that no encoder wrote."""


def put_uvar(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_uvar(data: bytes, at: int) -> tuple[int, int]:
    """The number at ``at`` and where it ends; only its shortest form is taken."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Corrupt("number is cut short or too long")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            if b == 0 and shift:
                raise Corrupt("number isn't in its shortest form")
            return value, at
        shift += 7


def pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits each, lowest bit first."""
    if not width:
        return b""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if len(data) != (count * width + 7) // 8:
        raise Corrupt("packed values have another length")
    if not width:
        return np.zeros(count, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")
    if bits[count * width :].any():
        raise Corrupt("padding isn't zero")
    bits = bits[: count * width].reshape(count, width).astype(np.uint64)
    return (bits << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def mask_positions(mask: bytes, n: int) -> np.ndarray:
    """Which of the first n bits are set, lowest first."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask, dtype=np.uint8), bitorder="little")[:n])


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def common_prefix(data: bytes, a: int, b: int, most: int) -> int:
    """How far the bytes from a and from b agree, up to ``most``."""
    n = 0
    while n < most and data[a + n : a + n + 16] == data[b + n : b + n + 16] and n + 16 <= most:
        n += 16
    while n < most and data[a + n] == data[b + n]:
        n += 1
    return n
