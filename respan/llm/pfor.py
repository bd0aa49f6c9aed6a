"""Patched frame-of-reference blocks of token ids (numpy, whole chunks at a time).

A block holds :data:`BLOCK` ids: its minimum is subtracted, the rest is packed at the width
that holds the :data:`PERCENTILE` of the block, and the high bits of the larger values stand
in an exception list.  Bytes of a block, little-endian:

    minimum u32 | width u8 | exceptions u8 | 32 x width packed | positions u8 each | high bits u32 each

Packed words: id number ``8 * row + lane`` takes bits ``row * width ..`` of its lane, a run of
``width`` 32-bit words; words of the eight lanes alternate.
"""

from __future__ import annotations

import numpy as np

BLOCK, LANES = 256, 8
ROWS = BLOCK // LANES
#: Share of a block's values that the packed width must hold; the others are exceptions (25 at most).
PERCENTILE = 0.9
HEAD = 6


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 256) values below 2 ** width as (blocks, 32 * width) bytes."""
    rows = low.reshape(len(low), ROWS, LANES)
    words = np.zeros((len(low), width, LANES), np.uint32)
    for r in range(ROWS):
        at, shift = divmod(r * width, 32)
        words[:, at] |= rows[:, r] << np.uint32(shift)
        if shift + width > 32:
            words[:, at + 1] |= rows[:, r] >> np.uint32(32 - shift)
    return words.reshape(len(low), -1).view(np.uint8)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(packed).view("<u4").reshape(len(packed), width, LANES)
    out = np.empty((len(packed), ROWS, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for r in range(ROWS):
        at, shift = divmod(r * width, 32)
        v = words[:, at] >> np.uint32(shift)
        if shift + width > 32:
            v = v | words[:, at + 1] << np.uint32(32 - shift)
        out[:, r] = v & mask
    return out.reshape(len(packed), BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of whole blocks of 32-bit ids, and the start of each block in them.

    An incomplete last block is filled up with its last id (the reader knows the count)."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    short = -len(ids) % BLOCK
    if short:
        ids = np.concatenate([ids, np.full(short, ids[-1], ids.dtype)])
    v = ids.astype(np.uint32).reshape(-1, BLOCK)
    base = v.min(axis=1)
    v = v - base[:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = _bit_length(np.partition(v, rank, axis=1)[:, rank])
    high = (v.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    low = v & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    block, slot = np.nonzero(high)
    many = np.bincount(block, minlength=len(v))
    size = HEAD + ROWS * width + 5 * many
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], np.uint8)
    heads = np.zeros((len(v), HEAD), np.uint8)
    heads[:, :4] = base.astype("<u4").view(np.uint8).reshape(-1, 4)
    heads[:, 4], heads[:, 5] = width, many
    out[start[:-1, None] + np.arange(HEAD)] = heads
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        out[start[mine, None] + np.arange(HEAD, HEAD + ROWS * w)] = _pack(low[mine], w)
    first = np.concatenate([[0], np.cumsum(many)])[block]
    number = np.arange(len(block)) - first
    tail = (start[:-1] + HEAD + ROWS * width)[block]
    out[tail + number] = slot
    at = (tail + many[block] + 4 * number)[:, None] + np.arange(4)
    out[at] = high[block, slot].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), start[:-1]


def decode_blocks(data: bytes, start: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``start`` in ``data`` (all 256 of each)."""
    raw = np.frombuffer(data, np.uint8)
    heads = raw[start[:, None] + np.arange(HEAD)]
    base = np.ascontiguousarray(heads[:, :4]).view("<u4")[:, 0]
    width, many = heads[:, 4].astype(np.int64), heads[:, 5].astype(np.int64)
    out = np.zeros((len(start), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        out[mine] = _unpack(raw[start[mine, None] + np.arange(HEAD, HEAD + ROWS * w)], w)
    block = np.repeat(np.arange(len(start)), many)
    number = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
    tail = (start + HEAD + ROWS * width)[block]
    slot = raw[tail + number]
    at = (tail + many[block] + 4 * number)[:, None] + np.arange(4)
    high = np.ascontiguousarray(raw[at]).view("<u4").reshape(-1)
    out[block, slot] |= (high.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    return (out + base[:, None]).reshape(-1)
