"""URL filters (operator 7): a bit-parallel wildcard automaton.

All rules become one non-deterministic automaton whose states are bits, packed into 64-bit
words: one bit for the start of a rule and one for each of its characters. A step of all rules
over one character c is  D = ((D << 1) & B[c]) | (D & L[c])  with a mask B of each character's
states and a mask L of the wildcards' self-loops. A batch of URLs is stepped together, longest first, so that finished
ones drop out.

Two rule sets run through it. Host rules (verdict, host, path) fit a host and its subdomains
if the path starts with theirs; the longest one decides. Globs over the whole canonical URL
(`**` any run, `*` a run without a slash, `?` one character) block what no host rule decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
GLOBS = ("*://*spam-farm**", "*://*-pills**", "*://*casino-**", "*://*adult-**", "*://*free-bets**", "*://*ads-track**", "**/ads/**", "**.exe")

_LOWER = {c: c + 32 for c in range(65, 91)}


class WildcardAutomaton:
    """Matches ASCII globs against whole strings: `**` any run, `*` one without `/`, `?` one character."""

    def __init__(self, globs: Sequence[str]) -> None:
        self.globs = tuple(globs)
        bits, loops, wide, starts, ends = 0, [], [], [], []
        cells: list[tuple[int, str]] = []
        for glob in globs:
            if not glob.isascii():
                raise ValueError(f"glob isn't ASCII: {glob!r}")
            starts.append(bits)
            for k, c in enumerate(glob):
                if c == "*":
                    loops.append(bits)
                    if glob[k - 1 : k + 1] == "**":
                        wide.append(bits)
                else:
                    bits += 1
                    cells.append((bits, c))
            ends.append(bits)
            bits += 1
        self.words = -(-bits // 64) or 1
        self.start = self._mask(starts)
        self.loop = np.tile(self._mask(loops), (129, 1))
        self.loop[ord("/")] = self._mask(wide)
        # Row 128 stands for every character beyond ASCII.
        self.step = np.zeros((129, self.words), np.uint64)
        for at, c in cells:
            self.step[slice(None) if c == "?" else ord(c), at // 64] |= np.uint64(1 << at % 64)
        self.ends = np.array(ends, int)

    def _mask(self, at: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in at:
            out[b // 64] |= np.uint64(1 << b % 64)
        return out

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean, texts x globs."""
        codes = [np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), 128) for t in texts]
        size = np.array([len(c) for c in codes], int)
        order = np.argsort(-size, kind="stable")
        state = np.tile(self.start, (len(texts), 1))
        flat = np.concatenate([codes[i] for i in order]) if len(texts) else np.empty(0, np.uint32)
        size = size[order]
        at = np.cumsum(size) - size
        for j in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -j, "left"))  # those longer than j
            d = state[:n]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            c = flat[at[:n] + j]
            state[:n] = (moved & self.step[c]) | (d & self.loop[c])
        out = np.zeros((len(texts), len(self.globs)), bool)
        out[order] = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def regex_of(glob: str) -> str:
    """The regular expression that matches the same whole strings."""
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return "(?s)" + "".join({"**": ".*", "*": "[^/]*", "?": "."}.get(p) or re.escape(p) for p in parts)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host_end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[host_end:]
    path_end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:host_end].translate(_LOWER), tail[:path_end]


def canonical(url: str | None) -> str:
    """The URL without its fragment, A-Z lower-cased."""
    return (url or "").partition("#")[0].translate(_LOWER)


class UrlFilter:
    def __init__(self, host_rules: Sequence[tuple[str, str, str]], globs: Sequence[str]) -> None:
        self.rules = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
        # A zero character parts host and path, so that a rule's host can't match inside a path.
        self.hosts = WildcardAutomaton([f"**.{h}\0{p}**" for _, h, p in self.rules])
        self.urls = WildcardAutomaton(globs)

    def judge(self, urls: Sequence[str | None]) -> list[tuple[str, str, str | None, str, str | None]]:
        """(host, path, rule, verdict, glob) of each URL."""
        parts = [split_url(u) for u in urls]
        by_host = self.hosts.match([".{}\0{}".format(*(x.replace("\0", "\x01") for x in p)) for p in parts])
        by_glob = self.urls.match([canonical(u) for u in urls])
        out = []
        for (host, path), h, g in zip(parts, by_host, by_glob, strict=True):
            rule = self.rules[int(h.argmax())] if h.any() else None
            glob = self.urls.globs[int(g.argmax())] if g.any() else None
            out.append((host, path, rule and rule[1] + rule[2], rule[0] if rule else "block" if glob else "allow", glob))
        return out


def _judged(batches: Iterator[pa.RecordBatch], host_rules, globs) -> Iterator[pa.RecordBatch]:
    urls = UrlFilter(host_rules, globs)
    for part in slices(batches, 4096):
        rows = urls.judge(part.column("url").to_pylist())
        columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(5)]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), *columns], ["page_id", "host", "path", "rule", "verdict", "glob"])


def judge_urls(pages: DataFrame, host_rules: Sequence[tuple[str, str, str]] = HOST_RULES, globs: Sequence[str] = GLOBS) -> DataFrame:
    """(page_id, host, path, rule, verdict, glob) for every row of `pages` (page_id, url, any others).

    Null and empty URLs and such without `://` have an empty host and path and fit no host
    rule. Repeated rows are judged alike; an empty table gives no rows. A host rule's path
    starts with a slash. `glob` is the first glob that the canonical URL matches, or null.
    """
    of = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, glob string"
    return pages.select("page_id", "url").mapInArrow(partial(_judged, host_rules=tuple(host_rules), globs=tuple(globs)), of)
