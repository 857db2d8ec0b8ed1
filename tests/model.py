"""A slow, independent model of one byte stream, in plain Python."""

from __future__ import annotations

import hashlib

M = 2**64


def le(x: int, n: int) -> bytes:
    return x.to_bytes(n, "little")


def first8(data: bytes) -> int:
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "little")


def normalize(text: bytes, strip=True, collapse=True, remap=True):
    out, removed, names, i = [], 0, {}, 0
    count = len(text) // 8
    while i < count:
        s = bytearray(text[8 * i : 8 * i + 8])
        step = 1
        if strip and s[0] == 0xB7 and s[1] == 0 and s[4:8] == bytes(4):
            removed += 1
            i += 1
            continue
        if collapse and s[0] == 0x18 and i + 1 < count:
            s[2:] = bytes(6)
            step = 2
        if remap:
            dst, src = s[1] & 15, s[1] >> 4
            new = names.setdefault(dst, len(names))
            s[1] = new | ((names.setdefault(src, len(names)) if src else 0) << 4)
        out.append(bytes(s))
        i += step
    return b"".join(out), removed, tuple(names.items())


def ngrams(text: bytes, n=3) -> set[int]:
    t = [text[8 * i] << 16 | (text[8 * i + 1] & 15) << 8 | text[8 * i + 1] >> 4 for i in range(len(text) // 8)]
    out = set()
    for i in range(len(t) - n + 1):
        key = 0
        for j in range(n):
            key |= t[i + j] << 21 * j
        out.add(key % M)
    return out


def minhash(features, k) -> list[int]:
    return [min((first8(le(x, 8) + le(i, 4)) for x in features), default=M - 1) for i in range(k)]


def simhash(features) -> int:
    hashes = [first8(le(x, 8)) for x in features]
    return sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) > 0)


def fnv(words) -> int:
    h = 0xCBF29CE484222325
    for w in words:
        h = (h ^ w) * 0x100000001B3 % M
    return h


def estimate(a, b) -> float:
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a) if len(a) == len(b) and a else 0.0


def components(nodes, links) -> dict:
    """Every node's least companion."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sample(seed: int) -> bytes:
    """32 slots; seeds equal modulo 32 give one program."""
    return b"".join(bytes([(seed + i) % 256 % 0x20, i % 16 | (i % 16) << 4, 0, 0, 0, 0, 0, 0]) for i in range(32))


def elf(text: bytes, kind=1, flags=6, start=512, wide=True, order="<", second: bytes | None = None) -> bytes:
    """A small ELF file whose section table is a null entry and one or two others."""
    import struct

    count = 2 + (second is not None)
    head = 64 if wide else 52
    size = 64 if wide else 40
    sections = [(0, 0, 0, 0), (kind, flags, start, len(text))] + ([(1, 6, start + len(text), len(second))] if second is not None else [])
    out = bytearray(max(start, 256 + count * size))
    out[:6] = b"\x7fELF" + bytes([2 if wide else 1, 1 if order == "<" else 2])
    if wide:
        struct.pack_into(f"{order}QQQ", out, 24, 0x400000, 0, 256)
        struct.pack_into(f"{order}HHHHHH", out, 52, head, 0, 0, size, count, 0)
    else:
        struct.pack_into(f"{order}III", out, 24, 0x400000, 0, 256)
        struct.pack_into(f"{order}HHHHHH", out, 40, head, 0, 0, size, count, 0)
    for i, (k, f, at, n) in enumerate(sections):
        base = 256 + i * size
        struct.pack_into(f"{order}II", out, base, 0, k)
        struct.pack_into(f"{order}QQQQ" if wide else f"{order}IIII", out, base + 8, f, 0, at, n)
    return bytes(out) + text + (second or b"")
