"""Token ids in patched frame-of-reference blocks.

A document's ids are cut into blocks of BLOCK. A block keeps its minimum, the distances from it packed at the width that holds
``percentile`` of them, and an exception list (place, value) for the others. Starts of the blocks are indexed, so any block can be read alone.

Layout of a payload (little endian): b"PFR1", block size u16, tokens u32, blocks u32, start of each block u32 (from the end of the index);
block: minimum u32, width u8, exceptions u8, packed distances (bit i of every value at place i, size * width / 8 bytes), places u8, values u32.

Defined results: null text gives a null payload, null block_starts and null n_tokens; empty text gives a payload of no blocks. Special tokens' names in a
text are ordinary text. Null doc_id and repeated rows: row by row. Only doc_id and text are read; empty input gives no rows.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import remote, slim

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, PERCENTILE, TOGETHER = 128, 90, 400_000
SCHEMA = "doc_id long, n_tokens int, block_starts array<int>, payload binary"
_encoders: dict = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, list[int]]:
    """(payload, starts of its blocks)."""
    return pack_many([ids], block, percentile)[0]


def pack_many(every: list[np.ndarray], block: int = BLOCK, percentile: float = PERCENTILE) -> list[tuple[bytes, list[int]]]:
    """The same for several texts, whose blocks are worked out together."""
    sizes = np.array([len(x) for x in every], np.int64)
    counts = -(-sizes // block)
    ends = np.cumsum(counts)
    blocks = int(counts.sum())
    grid = np.zeros(blocks * block, np.uint32)
    for ids, n, e, c in zip(every, sizes.tolist(), ends.tolist(), counts.tolist()):
        if n:
            at = (e - c) * block
            grid[at : at + n] = ids
            grid[at + n : e * block] = ids[-1]
    grid = grid.reshape(blocks, block)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    far = grid - low[:, None]
    rank = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    at = np.partition(far, rank, axis=1)[:, rank]
    width = np.where(at > 0, np.floor(np.log2(np.maximum(at, 1))).astype(np.int64) + 1, 0)
    outside = far >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    inside = np.where(outside, 0, far).astype(np.uint32)
    packed: list = [b""] * blocks
    for w in np.unique(width).tolist():
        some = np.flatnonzero(width == w) if w else np.zeros(0, np.int64)
        for k in range(0, len(some), 4_096):  # a byte for each bit meanwhile
            rows = some[k : k + 4_096]
            bits = np.stack([(inside[rows] >> np.uint32(j)).astype(np.uint8) & 1 for j in range(w)], axis=1)
            raw, size = np.packbits(bits, axis=2, bitorder="little").tobytes(), w * block // 8
            for j, r in enumerate(rows.tolist()):
                packed[r] = raw[j * size : j * size + size]
    row, place = np.nonzero(outside)
    value, place = far[row, place].astype("<u4").tobytes(), place.astype(np.uint8).tobytes()
    edge = np.searchsorted(row, np.arange(blocks + 1))
    heads = np.zeros(blocks, np.dtype([("low", "<u4"), ("width", "u1"), ("odd", "u1")]))
    heads["low"], heads["width"], heads["odd"] = low, width, np.diff(edge)
    heads, edge = heads.tobytes(), edge.tolist()
    parts = [heads[6 * i : 6 * i + 6] + x + place[a:z] + value[4 * a : 4 * z] for i, (x, a, z) in enumerate(zip(packed, edge, edge[1:]))]
    out = []
    for n, c, e in zip(sizes.tolist(), counts.tolist(), ends.tolist()):
        own = parts[e - c : e]
        starts = np.cumsum([0, *map(len, own)])[:-1]
        out.append((b"".join([b"PFR1", struct.pack("<HII", block, n, c), starts.astype("<u4").tobytes(), *own]), starts.tolist()))
    return out


def unpack_block(payload: bytes, k: int) -> np.ndarray:
    """The ids of block k alone (the last block may be filled up with its last id)."""
    block, _, blocks = struct.unpack_from("<HII", payload, 4)
    at = 14 + 4 * blocks + struct.unpack_from("<I", payload, 14 + 4 * k)[0]
    low, width, odd = struct.unpack_from("<IBB", payload, at)
    at += 6
    out = np.zeros(block, np.uint32)
    size = block // 8
    for i in range(width):
        out |= np.unpackbits(np.frombuffer(payload, np.uint8, size, at + i * size), bitorder="little").astype(np.uint32) << np.uint32(i)
    at += width * size
    out[np.frombuffer(payload, np.uint8, odd, at)] = np.frombuffer(payload, "<u4", odd, at + odd)
    return out + np.uint32(low)


def unpack(payload: bytes) -> np.ndarray:
    _, n, blocks = struct.unpack_from("<HII", payload, 4)
    return np.concatenate([unpack_block(payload, k) for k in range(blocks)])[:n] if blocks else np.zeros(0, np.uint32)


def encode(batches, path: str, block: int, percentile: float):
    enc = encoder(path)

    def made(ids, held):
        done = iter(pack_many([x for x in held if x is not None], block, percentile))
        rows = [(i, None, None, None) if x is None else (i, len(x), *reversed(next(done))) for i, x in zip(ids, held)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()))], ["doc_id", "n_tokens", "block_starts", "payload"])

    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        for k in range(0, len(ids), 200):
            own, held, size = [], [], 0
            for i, t in zip(ids[k : k + 200], texts.slice(k, 200).to_pylist()):
                x = None if t is None else np.array(enc.encode_ordinary(t), np.uint32)
                if held and size + (0 if x is None else len(x)) > TOGETHER:
                    yield made(own, held)
                    own, held, size = [], [], 0
                own.append(i)
                held.append(x)
                size += 0 if x is None else len(x)
            if held:
                yield made(own, held)


def decode(batches, path: str):
    enc = encoder(path)
    for b in batches:
        texts = [None if p is None else enc.decode(unpack(p).tolist()) for p in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def to_binary(docs: DataFrame, path: str = VOCABULARY, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """doc_id, n_tokens, block_starts, payload for every row; ``path`` is a vocabulary file that every executor can read."""
    if block % 8 or not 8 <= block <= 256:
        raise ValueError("block must be a multiple of 8, 256 at most")
    return slim(docs, "doc_id", "text").mapInArrow(remote(__name__, "encode", path=path, block=block, percentile=percentile), SCHEMA)


def to_text(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text from ``to_binary``'s rows."""
    return slim(encoded, "doc_id", "payload").mapInArrow(remote(__name__, "decode", path=path), "doc_id long, text string")
