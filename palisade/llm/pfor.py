"""Patched frame-of-reference blocks for streams of token ids, and their files.

A block holds up to ``BLOCK`` ids. Its minimum is subtracted; the differences
are packed with the bits that a percentile of them needs; higher bits of the
rest stand in an exception list (positions and high parts). A file is

    "PFOR1" pad | blocks | documents | index | footer

``documents`` has, per document, id, null flag and number of ids; ``index`` has
the byte offset of each block's start, so any run of ids can be read alone; the
footer gives the parts' offsets and counts.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFOR1\0\0\0"
BLOCK = 4096
PERCENTILE = 90
_HEAD = struct.Struct("<HBBIH")  # ids, width, bits of the exceptions' high part, minimum, exceptions
_FOOT = struct.Struct("<qqqqqq")  # documents at, index at, documents, blocks, ids, block size


def _pack(values: np.ndarray, width: int) -> bytes:
    """``values`` (rows of equal length, uint32) to ``width`` bits each, low bit first."""
    if not width:
        return b""
    bits = (values[..., None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def _unpack(raw, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    b = np.frombuffer(raw, np.uint8, (n * width + 7) // 8)
    at = np.arange(n, dtype=np.int64) * width
    # a value of up to 32 bits lies within 5 bytes
    wide = np.zeros(len(b) + 8, np.uint8)
    wide[: len(b)] = b
    low = at >> 3
    out = np.zeros(n, np.uint64)
    for k in range((width + 14) // 8):
        out |= wide[low + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One block of 1 to ``BLOCK`` unsigned 32-bit ids."""
    low = int(ids.min())
    d = ids - np.uint32(low)
    k = min(len(d) - 1, len(d) * percentile // 100)
    width = int(np.partition(d, k)[k]).bit_length()
    top = int(d.max()).bit_length()
    if top == width:
        where = np.empty(0, np.uint16)
        high = np.empty(0, np.uint32)
    else:
        where = np.flatnonzero(d >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
        high = d[where] >> np.uint32(width)
    mask = np.uint32((1 << width) - 1)
    return b"".join(
        (
            _HEAD.pack(len(d), width, top - width, low, len(where)),
            _pack(d & mask, width),
            where.astype("<u2").tobytes(),
            _pack(high, top - width),
        )
    )


def decode_block(raw, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at ``at`` and where the next one begins."""
    n, width, extra, low, m = _HEAD.unpack_from(raw, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    d = _unpack(raw[at : at + size], n, width)
    at += size
    if m:
        where = np.frombuffer(raw, "<u2", m, at)
        at += 2 * m
        size = (m * extra + 7) // 8
        d[where] |= _unpack(raw[at : at + size], m, extra) << np.uint32(width)
        at += size
    return d + np.uint32(low), at


class Writer:
    """Streams documents into one file; only ids of an open block and the
    indexes are held."""

    def __init__(self, out):
        self._out, self._at = out, len(MAGIC)
        out.write(MAGIC)
        self._held: list[bytes] = []
        self._held_n = 0
        self._starts: list[int] = []
        self._ids: list[int] = []
        self._null: list[int] = []
        self._lens: list[int] = []
        self.n_ids = 0

    def _emit(self, ids: np.ndarray) -> None:
        parts = []
        for i in range(0, len(ids), BLOCK):
            raw = encode_block(ids[i : i + BLOCK])
            self._starts.append(self._at)
            self._at += len(raw)
            parts.append(raw)
        self._out.write(b"".join(parts))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit integers."""
        self._ids.append(doc_id or 0)
        self._null.append(doc_id is None)
        self._lens.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self._held.append(ids)
        self._held_n += len(ids) // 4
        if self._held_n >= 32 * BLOCK:
            whole = np.frombuffer(b"".join(self._held), "<u4")
            full = len(whole) // BLOCK * BLOCK
            self._emit(whole[:full])
            self._held, self._held_n = [whole[full:].tobytes()], len(whole) - full

    @property
    def n_docs(self) -> int:
        return len(self._ids)

    @property
    def n_bytes(self) -> int:
        return self._at

    def close(self) -> None:
        self._emit(np.frombuffer(b"".join(self._held), "<u4"))
        docs_at = self._at
        body = np.array(self._ids, "<i8").tobytes() + np.array(self._null, "u1").tobytes() + np.array(self._lens, "<i8").tobytes()
        index = np.array(self._starts, "<i8").tobytes()
        self._out.write(body + index + _FOOT.pack(docs_at, docs_at + len(body), self.n_docs, len(self._starts), self.n_ids, BLOCK))
        self._out.close()


class Reader:
    """Reads a file through a random-access handle, a run of blocks at a time."""

    def __init__(self, f):
        self._f = f
        size = f.size()
        self._docs_at, self._index_at, self.n_docs, self.n_blocks, self.n_ids, self.block = _FOOT.unpack(self._read(size - _FOOT.size, _FOOT.size))
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        n = self.n_docs
        body = self._read(self._docs_at, self._index_at - self._docs_at)
        self.doc_ids = np.frombuffer(body, "<i8", n)
        self.null = np.frombuffer(body, "u1", n, 8 * n)
        self.lens = np.frombuffer(body, "<i8", n, 9 * n)
        self.starts = np.frombuffer(self._read(self._index_at, 8 * self.n_blocks), "<i8")

    def _read(self, at: int, n: int) -> bytes:
        self._f.seek(at)
        return self._f.read(n)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file's stream, by the block index."""
        if not n:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        end = self.starts[last + 1] if last + 1 < self.n_blocks else self._docs_at
        raw = self._read(int(self.starts[first]), int(end - self.starts[first]))
        out, at = [], 0
        while at < len(raw):
            d, at = decode_block(raw, at)
            out.append(d)
        return np.concatenate(out)[start - first * self.block :][:n]

    def documents(self, run: int = 1 << 20):
        """(index of the document, its start in the file, its ids), in order,
        reading about ``run`` ids at a time."""
        begin = np.concatenate(([0], np.cumsum(self.lens)))
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + run, "right")) - 1)
            ids = self.ids(int(begin[i]), int(begin[j] - begin[i]))
            for k in range(i, j):
                yield k, int(begin[k]), ids[begin[k] - begin[i] : begin[k + 1] - begin[i]]
            i = j
