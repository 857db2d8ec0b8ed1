"""Array kernels of one byte stream: slots, normalization, n-grams, sketches.

A stream is cut in slots of eight bytes: opcode, registers (low nibble destination, high
nibble source), two bytes of offset, four of immediate. A trailing partial slot is dropped.
"""

from __future__ import annotations

import ctypes
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from itertools import starmap

import numpy as np

try:  # the interpreter's own: messages are short, and it is called without a detour
    from _sha2 import sha256 as _sha256
except ImportError:
    from hashlib import sha256 as _sha256

SLOT = 8
#: The opcodes of the wide load and of the move that can be a no-op.
WIDE_LOAD, MOVE = 0x18, 0xB7
NGRAM, HASHES = 3, 128
EMPTY = 2**64 - 1


@dataclass(frozen=True)
class NormalizeConfig:
    """`min_text_len` is accepted for compatibility; nothing reads it."""

    strip_nops: bool = True
    collapse_lddw: bool = True
    remap_registers: bool = True
    min_text_len: int = 8


@dataclass(frozen=True)
class Normalized:
    original_len: int
    normalized: bytes
    removed_instructions: int
    register_remap: tuple[tuple[int, int], ...]

    @property
    def compression_ratio(self) -> float:
        return len(self.normalized) / self.original_len if self.original_len else 1.0

    def lookup(self, register: int) -> int:
        return dict(self.register_remap).get(register, register)


def slots(text: bytes) -> np.ndarray:
    n = len(text) // SLOT
    return np.frombuffer(text, np.uint8, n * SLOT).reshape(n, SLOT)


def wide_leads(opcodes: np.ndarray) -> np.ndarray:
    """Which slots open a wide load: every other one of each run of wide-load opcodes.

    The slot after an opener belongs to it, whatever it holds.
    """
    wide = opcodes == WIDE_LOAD
    at = np.arange(len(opcodes))
    last_other = np.maximum.accumulate(np.where(wide, -1, at))
    return wide & ((at - last_other) % 2 == 1)


def normalize(text: bytes, config: NormalizeConfig = NormalizeConfig()) -> Normalized:
    s = slots(text).copy()
    n = len(s)
    taken = np.zeros(n, bool)
    lead = np.zeros(n, bool)
    if config.collapse_lddw and n:
        lead = wide_leads(s[:, 0])
        taken[1:] = lead[:-1]
        lead[-1] = False  # nothing follows: it stays as it is
        s[lead, 2:] = 0
    drop = np.zeros(n, bool)
    if config.strip_nops:
        drop = (s[:, 0] == MOVE) & (s[:, 1] == 0) & (s[:, 4:] == 0).all(axis=1) & ~taken
    s = s[~taken & ~drop]
    remap: tuple[tuple[int, int], ...] = ()
    if config.remap_registers and len(s):
        dst, src = s[:, 1] & 15, s[:, 1] >> 4
        events = np.stack([dst, src], axis=1).ravel()
        seen = events[np.stack([np.ones(len(s), bool), src != 0], axis=1).ravel()]
        registers, first = np.unique(seen, return_index=True)
        order = registers[np.argsort(first)]
        to = np.arange(16, dtype=np.uint8)
        to[order] = np.arange(len(order), dtype=np.uint8)
        s[:, 1] = to[dst] | (np.where(src == 0, 0, to[src]) << 4)
        remap = tuple((int(r), i) for i, r in enumerate(order))
    return Normalized(len(text), s.tobytes(), int(drop.sum()), remap)


def tokens(text: bytes) -> np.ndarray:
    """Packed tokens: opcode << 16 | destination << 8 | source."""
    s = slots(text).astype(np.uint64)
    if not len(s):
        return np.empty(0, np.uint64)
    return s[:, 0] << np.uint64(16) | (s[:, 1] & np.uint64(15)) << np.uint64(8) | s[:, 1] >> np.uint64(4)


def check_n(n: int) -> None:
    if not 1 <= n <= 4:
        raise ValueError(f"n-grams of 1 to 4 tokens fit in 64 bits, not {n}")


def ngrams(text: bytes, n: int = NGRAM) -> np.ndarray:
    """Distinct n-grams, ascending: tokens OR-ed at 21 bits from each other, high bits lost."""
    check_n(n)
    t = tokens(text)
    m = len(t) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    key = t[:m].copy()
    for i in range(1, n):
        key |= t[i : i + m] << np.uint64(21 * i)
    return np.unique(key)


#: What SHA-256 starts from (FIPS 180-4).
_START = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
#: Hashes from which `_block_hashes` is worth its tables.
MANY = 2048


def _block_hashes(raw: bytes, k: int, compress: Callable) -> np.ndarray:
    """`_hashes`, by `compress`, which takes a state on by one block: a feature and a seed fit in one block, so
    that no hash object is made for them, and states and blocks are tables."""
    n = len(raw) // 8
    states, blocks = np.empty((n, 28), np.uint32), np.zeros((n, 16), ">u4")  # 112 bytes: a SHA256_CTX, its state first
    blocks[:, :2] = np.frombuffer(raw, ">u4").reshape(n, 2)
    blocks[:, 3], blocks[:, 15] = 1 << 31, 96  # the message's end, and its bits
    held = [(ctypes.c_char * t.nbytes).from_buffer(t) for t in (states, blocks)]
    pairs = list(zip(*([ctypes.byref(h, at) for at in range(0, len(h), len(h) // n)] for h in held), strict=True))
    out = np.empty((k, n, 2), np.uint32)
    for i in range(k):
        blocks[:, 2] = int.from_bytes(i.to_bytes(4, "little"), "big")
        states[:, :8] = _START
        deque(starmap(compress, pairs), maxlen=0)
        out[i] = states[:, :2]
    return np.ascontiguousarray(out.astype(">u4").view("<u8")[:, :, 0].T)


def _compressor() -> Callable | None:
    """OpenSSL's compression of one block, in the library that hashlib is linked to, which uses the processor's
    own instructions; none where it can't be had or doesn't give SHA-256."""
    try:
        import _hashlib

        compress = ctypes.PyDLL(_hashlib.__file__).SHA256_Transform
    except (ImportError, AttributeError, OSError):
        return None
    compress.restype = None
    some = np.array([1, EMPTY - 5], "<u8").tobytes()
    return compress if (_block_hashes(some, 3, compress) == _hashes(some, 3)).all() else None


def _hashes(raw: bytes, k: int) -> np.ndarray:
    """Hashes (features, k) of features as bytes, under each of k seeds."""
    if len(raw) // 8 * k >= MANY and _compress:
        return _block_hashes(raw, k, _compress)
    seeds = [i.to_bytes(4, "little") for i in range(k)]
    some = [raw[i : i + 8] for i in range(0, len(raw), 8)]
    digests = b"".join([_sha256(f + seed).digest() for f in some for seed in seeds])
    return np.frombuffer(digests, "<u8").reshape(-1, k, 4)[:, :, 0]


_compress = _compressor()


def minhash(features: np.ndarray, k: int = HASHES) -> np.ndarray:
    """Least unsigned hash of the features under each of k seeds; all ones for no feature."""
    return minhashes([features], k)[0]


def leaders(features: np.ndarray, k: int = HASHES) -> np.ndarray:
    """The feature that attains each minimum of `minhash`; none for no feature."""
    if not len(features):
        return np.empty(0, np.uint64)
    least, out = np.full(k, EMPTY, np.uint64), np.repeat(features[:1], k)
    for at in range(0, len(features), 256):
        some = features[at : at + 256]
        hashes = _hashes(some.astype("<u8").tobytes(), k)
        first = hashes.argmin(axis=0)
        value = hashes[first, np.arange(k)]
        out = np.where(value < least, some[first], out)
        least = np.minimum(least, value)
    return out


def minhashes(sets: list[np.ndarray], k: int = HASHES) -> np.ndarray:
    """`minhash` of each of several sets, in which a feature that they share is hashed once."""
    out = np.full((len(sets), k), EMPTY, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not k or not len(owner):
        return out
    features, which = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(which, kind="stable")
    owner, ends = owner[order], np.searchsorted(which[order], np.arange(0, len(features) + 256, 256))
    raw = features.astype("<u8").tobytes()
    for block, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
        hashes = _hashes(raw[8 * 256 * block : 8 * 256 * (block + 1)], k)
        some, at = owner[lo:hi], which[order[lo:hi]] - 256 * block
        by = np.argsort(some, kind="stable")
        mine, first = np.unique(some[by], return_index=True)
        out[mine] = np.minimum(out[mine], np.minimum.reduceat(hashes[at[by]], first, axis=0))
    return out


def simhash(features: np.ndarray) -> int:
    """Bit b is set iff more features' hashes have it than lack it."""
    return int(simhashes([features])[0])


def simhashes(sets: list[np.ndarray]) -> np.ndarray:
    """`simhash` of each of several sets, in which a feature that they share is hashed once."""
    features, which = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
    raw = features.astype("<u8").tobytes()
    digests = b"".join([_sha256(raw[i : i + 8]).digest()[:8] for i in range(0, len(raw), 8)])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(sets), 64), bool)
    at = 0
    for i, some in enumerate(sets):
        out[i] = 2 * bits[which[at : at + len(some)]].sum(axis=0) > len(some)
        at += len(some)
    return np.packbits(out, axis=1, bitorder="little").view("<u8")[:, 0]
