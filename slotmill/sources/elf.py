"""The executable section of an ELF file."""

from __future__ import annotations

import os
import struct

#: Fixed values of the format: section type with program data, flag of executable sections.
PROGBITS, EXECUTABLE = 1, 4


#: Bytes of a file that are read at a time where less is asked for.
BLOCK = 65_536


class FileBytes:
    """An open file that is sliced like the bytes of it, of which only what is asked for is read."""

    def __init__(self, descriptor: int) -> None:
        self.descriptor, self.size, self.read = descriptor, os.fstat(descriptor).st_size, 0
        self.start, self.block = 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice | int) -> bytes | int:
        if isinstance(part, int):
            return self[part : part + 1][0]
        start, stop, _ = part.indices(self.size)
        if not self.start <= start <= stop <= self.start + len(self.block):
            if stop - start >= BLOCK:
                return self._pread(start, stop - start)
            self.start, self.block = start, self._pread(start, BLOCK)
        return self.block[start - self.start : stop - self.start]

    def _pread(self, start: int, n: int) -> bytes:
        parts: list[bytes] = []
        while n > 0 and (some := os.pread(self.descriptor, n, start)):
            parts.append(some)
            start, n = start + len(some), n - len(some)
        data = b"".join(parts)
        self.read += len(data)
        return data


Source = bytes | FileBytes


def _unpacked(form: str, data: Source, at: int) -> tuple:
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


class LoadError(ValueError):
    """Why a file has no instructions; the text is what users see."""


def text_section(data: Source) -> bytes:
    """Bytes of the first executable section with program data; the file's machine and
    section names don't matter. Either word size and byte order."""
    if len(data) < 16 or data[:4] != b"\x7fELF":
        raise LoadError("not a valid elf: bad magic")
    if data[4] not in (1, 2) or data[5] not in (1, 2):
        raise LoadError("not a valid elf: unknown class or byte order")
    wide, order = data[4] == 2, "<>"[data[5] - 1]
    try:
        if wide:
            (table,) = _unpacked(f"{order}Q", data, 40)
            size, count = _unpacked(f"{order}HH", data, 58)
        else:
            (table,) = _unpacked(f"{order}I", data, 32)
            size, count = _unpacked(f"{order}HH", data, 46)
        if not count and table:  # too many for the header: the first section's size counts them
            (count,) = _unpacked(f"{order}{'Q' if wide else 'I'}", data, table + (32 if wide else 20))
        for i in range(count):
            at = table + i * size
            kind = _unpacked(f"{order}I", data, at + 4)[0]
            if wide:
                flags, _, start, length = _unpacked(f"{order}QQQQ", data, at + 8)
            else:
                flags, _, start, length = _unpacked(f"{order}IIII", data, at + 8)
            if kind == PROGBITS and flags & EXECUTABLE:
                if start + length > len(data):
                    raise LoadError("not a valid elf: text section exceeds file bounds")
                return data[start : start + length]
    except struct.error as e:
        raise LoadError(f"not a valid elf: {e}") from None
    raise LoadError("no executable text section found")


def entry_offset(data: Source) -> int:
    """The entry address in the header; kept with the program, read by nothing."""
    wide, order = data[4] == 2, "<>"[data[5] - 1]
    return _unpacked(f"{order}{'Q' if wide else 'I'}", data, 24)[0]
