"""Token ids of texts, put together from units that are proven to be encoded apart.

A text splits before white space that follows anything else, and between a Latin letter and a
comma or full stop. No pre-token of a byte-level vocabulary spans such a place, and no merge of
a piece vocabulary does if none of its pieces does, which is looked up when it is loaded. So a
text's ids are those of its units in order, and frequent units are encoded once a worker.
Texts with white space or marks that the libraries may judge otherwise are one unit each.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from functools import cache
from typing import Any

import numpy as np

#: Units a worker remembers, and the longest remembered one; only memory and speed depend on them.
UNIT_CACHE, UNIT_LENGTH = 300_000, 40

_LETTER, _SPACE = "A-Za-zÀ-ÖØ-öø-ÿ", " \t\n\x0b\x0c"
_UNITS = re.compile(rf"[{_SPACE}]*(?:[{_LETTER}]++(?=[,.])|[^{_SPACE}]+)|[{_SPACE}]+").findall
#: White space of some library besides _SPACE, invisible marks, and the mark that pieces use for a blank.
_ODD = re.compile("[\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f-\u2064\u3000\ufeff\u2581]").search
_WORD = re.compile(rf" [{_LETTER}]+").fullmatch
#: Places where units part, inside a piece (its blank mark read as a blank).
_PARTS = re.compile(rf"[^{_SPACE}][{_SPACE}]| [\t\n\x0b\x0c]|[{_LETTER}][,.]").search


def units(text: str) -> list[str]:
    return [text] if _ODD(text) else _UNITS(text)


class Tokens:
    """What the vocabularies share: `size`, the bytes of each id, and `whole`, whether texts must
    not be split. `encode` gives the ids of units."""

    size: np.ndarray
    bytes_of: list[bytes]
    whole = False

    def encode(self, some: Sequence[str]) -> list[list[int]]:
        raise NotImplementedError

    def units(self, text: str) -> list[str]:
        return [text] if self.whole and text else units(text)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for
    themselves, the others follow from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens(Tokens):
    """A byte-level vocabulary (.json). With `plain`, the strings of special tokens are plain text."""

    def __init__(self, path: str, plain: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        byte_of = _byte_letters()
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes_of = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = special[i].encode() if i in special else bytes(byte_of[c] for c in token)
        self.size = np.array([len(b) for b in self.bytes_of])
        # Special tokens hold no place where units part, or no text is split.
        self.whole = any(_PARTS(t) or t != t.strip() for t in special.values())
        # A blank and letters are one pre-token: these need no search for more.
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def encode(self, some: Sequence[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(some)
        word = [i for i, u in enumerate(some) if _WORD(u)]
        for at in range(0, len(word), 4096):
            part = word[at : at + 4096]
            ids = self.words.encode_batch_fast(["".join(some[i] for i in part)], add_special_tokens=False)[0].ids
            # Words end where tokens end: cut by the bytes of the tokens before.
            ends = np.cumsum(self.size[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(some[i].encode()) for i in part])) + 1
            for i, a, b in zip(part, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                out[i] = ids[a:b]
        rest = [i for i, u in enumerate(some) if not _WORD(u)]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([some[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class PieceTokens(Tokens):
    """A piece vocabulary (.model) that puts a blank before a text. Units carry that blank."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i).replace("▁", " ") for i in range(n)]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.encode() for i, p in enumerate(pieces)]
        self.size = np.array([len(b) for b in self.bytes_of])
        blank = self.model.piece_to_id("▁")
        self.blank = [] if self.model.is_unknown(blank) else [blank]
        # Without a piece for each byte, unknown characters would have no bytes.
        self.whole = any(_PARTS(p) for p in pieces) or not self.blank or not any(map(self.model.is_byte, range(n)))

    def encode(self, some: Sequence[str]) -> list[list[int]]:
        """A unit that starts with neither white space nor a mark that _PARTS has gets a blank before it."""
        # The model adds a blank itself: units with one go without, others are cut after it, or
        # after a letter that no piece joins to them.
        given = [u[1:] if u[0] == " " else "a" + u if u[0] in ",." else u for u in some]
        found = self.model.encode(given, num_threads=1)
        return [self.blank if u == " " else ids if u[0] == " " or ids[:1] != self.blank and u[0] not in ",." else ids[1:] for u, ids in zip(some, found, strict=True)]


@cache
def vocabulary(path: str, plain: bool = False) -> Tokens:
    """One a worker process: later tasks find the vocabulary loaded."""
    return PieceTokens(path) if path.endswith(".model") else ByteTokens(path, plain)


class Remembered:
    """What is learnt of units, for frequent ones once: `learn` maps units to values."""

    def __init__(self, learn: Callable[[list[str]], list[Any]], limit: int = UNIT_CACHE) -> None:
        self.learn, self.limit = learn, limit
        self.known: dict[str, Any] = {}

    def of(self, split: list[list[str]]) -> list[list[Any]]:
        """The values of each list of units."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        new = list(set().union(*split).difference(known))
        if new:
            known.update(zip(new, self.learn(new), strict=True))
        found = [list(map(known.__getitem__, us)) for us in split]
        for u in new:
            if len(u) > UNIT_LENGTH:
                del known[u]
        return found
