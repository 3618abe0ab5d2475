"""Text of legacy word-processor files: the compound file around them, their table of pieces, and a scan where that is damaged."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

# Fixed values of the formats: the compound file's signature, sector numbers that are no
# sectors, bits and places in the document's header.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
END_OF_CHAIN, LEAST_SPECIAL = 0xFFFFFFFE, 0xFFFFFFFA
TABLE_BIT, EIGHT_BIT = 0x0200, 0x40000000
FLAGS_AT, CLX_AT, HEADER_BYTES = 0x0A, 0x01A2, 0x0200
#: Characters in a row that a scan of a damaged document takes for text.
LEAST_RUN = 4
_RUN = re.compile(rb"(?:[\x20-\x7e\t\n\r]\x00|[\x00-\xff]\x04){%d,}" % LEAST_RUN, re.S)


class CompoundFile:
    """Streams of a compound file held in memory, by name; broken chains raise ValueError."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != SIGNATURE or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise ValueError("odd sector sizes")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        directory, self.cutoff, mini_fat, _, more, _ = struct.unpack_from("<I4xIIIII", data, 48)
        tables = [s for s in struct.unpack_from("<109I", data, 76) if s < LEAST_SPECIAL]
        seen = set()
        while more < LEAST_SPECIAL:  # further sectors that list the table's sectors
            if more in seen:
                raise ValueError("a chain that doesn't end")
            seen.add(more)
            entries = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            tables += [s for s in entries[:-1] if s < LEAST_SPECIAL]
            more = entries[-1]
        self.fat = [e for s in tables for e in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.mini_fat = [e for s in self._chain(mini_fat, self.fat) for e in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.entries = {}
        listing = b"".join(self._sector(s) for s in self._chain(directory, self.fat))
        self.mini = b""
        for at in range(0, len(listing) - 127, 128):
            length, kind = struct.unpack_from("<HB", listing, at + 64)
            start, size = struct.unpack_from("<IQ", listing, at + 116)
            name = listing[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                self.mini = b"".join(self._sector(s) for s in self._chain(start, self.fat))[: size & 0xFFFFFFFF]
            elif kind == 2:
                self.entries.setdefault(name, (start, size & 0xFFFFFFFF))

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.size
        found = self.data[at : at + self.size]
        if not found:
            raise ValueError("a sector beyond the end")
        return found.ljust(self.size, b"\0")

    def _chain(self, start: int, table: list[int]) -> Iterator[int]:
        for _ in range(len(table) + 1):
            if start == END_OF_CHAIN or start >= LEAST_SPECIAL:
                return
            if start >= len(table):
                raise ValueError("a chain that leaves the table")
            yield start
            start = table[start]
        raise ValueError("a chain that doesn't end")

    def stream(self, name: str) -> bytes:
        """A stream's bytes; KeyError without one."""
        start, size = self.entries[name]
        if size >= self.cutoff:
            return b"".join(self._sector(s) for s in self._chain(start, self.fat))[:size]
        return b"".join(self.mini[s * self.mini_size : (s + 1) * self.mini_size] for s in self._chain(start, self.mini_fat))[:size]


def _pieces(clx: bytes) -> bytes | None:
    """The table of pieces in a document's complex part; what stands before it (blocks of formats) is passed over."""
    at = 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + int.from_bytes(clx[at + 1 : at + 3], "little")
    if at >= len(clx) or clx[at] != 2:
        return None
    return clx[at + 5 : at + 5 + int.from_bytes(clx[at + 1 : at + 5], "little")]


def piece_text(document: bytes, table: bytes) -> str | None:
    """Text of a document by its table of pieces, each of 8 or 16 bits a character; None if there is none."""
    if len(document) < CLX_AT + 8:
        return None
    start, length = struct.unpack_from("<II", document, CLX_AT)
    if not length or start + length > len(table):
        return None
    pieces = _pieces(table[start : start + length])
    n = (len(pieces) - 4) // 12 if pieces else 0
    if n <= 0:
        return None
    bounds = struct.unpack_from(f"<{n + 1}I", pieces)
    places = [place for (place,) in struct.iter_unpack("<2xI2x", pieces[4 * (n + 1) : 12 * n + 4])]
    out = []
    for begin, end, place in zip(bounds, bounds[1:], places):
        if end > begin and place & EIGHT_BIT:
            at = (place ^ EIGHT_BIT) // 2
            out.append(document[at : at + end - begin].decode("cp1252", "ignore"))
        elif end > begin:
            out.append(document[place : place + 2 * (end - begin)].decode("utf-16-le", "ignore"))
    return _readable("".join(out)) or None


def _readable(text: str) -> str:
    """Paragraph marks as line feeds, cell marks as tabs, no other control characters."""
    text = re.sub(r"\r\n?", "\n", text).replace("\x07", "\t")
    return re.sub(r"[\x00-\x08\x0b-\x1f]", "", text).strip()


def scanned_text(data: bytes) -> str:
    """Runs of ASCII and Cyrillic characters of 16 bits each, at any byte, one a line: what can be had of a damaged document."""
    return _readable("\n".join(m[0].decode("utf-16-le") for m in _RUN.finditer(data)))


def legacy_text(content: bytes | None) -> str:
    """Text of a legacy word-processor file; of one whose table of pieces can't be read a scan; '' of what is no such file."""
    try:
        file = CompoundFile(content or b"")
    except (ValueError, struct.error):
        return ""
    try:
        document = file.stream("WordDocument")
    except (KeyError, ValueError):
        return ""
    text = None
    if len(document) >= HEADER_BYTES:
        flags = int.from_bytes(document[FLAGS_AT : FLAGS_AT + 2], "little")
        try:
            text = piece_text(document, file.stream("1Table" if flags & TABLE_BIT else "0Table"))
        except (KeyError, ValueError, struct.error):
            text = None
    return text or scanned_text(document)
