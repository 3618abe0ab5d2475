"""Legacy word-processor files, built here byte by byte."""

import random
import struct

import pytest

from sparkloom.sources import office
from sparkloom.sources.files import file_texts


def compound(streams, cutoff=4096):
    """A compound file of 512-byte sectors with these streams, small ones in the mini stream."""
    sectors, fat = [], []

    def put(data):
        if not data:
            return office.END_OF_CHAIN
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), office.END_OF_CHAIN])
        return first

    mini, mini_fat, entries = b"", [], []
    for name, data in streams.items():
        if len(data) < cutoff:
            first = len(mini) // 64
            parts = -(-len(data) // 64)
            mini += data.ljust(64 * parts, b"\0")
            mini_fat += [*range(first + 1, first + parts), office.END_OF_CHAIN] if parts else []
            entries.append((name, 2, first if parts else office.END_OF_CHAIN, len(data)))
        else:
            entries.append((name, 2, put(data), len(data)))
    entries.insert(0, ("Root Entry", 5, put(mini), len(mini)))
    mini_start = put(b"".join(struct.pack("<I", x) for x in mini_fat).ljust(-(-4 * len(mini_fat) // 512) * 512, b"\xff"))
    listing = b""
    for name, kind, start, size in entries:
        written = name.encode("utf-16-le")
        listing += written.ljust(64, b"\0") + struct.pack("<HB", len(written) + 2, kind).ljust(52, b"\0") + struct.pack("<IQ", start, size)
    directory = put(listing)
    table = len(sectors)
    count = -(-(len(fat) + 1) // 128)
    count = -(-(len(fat) + count) // 128)
    fat += [0xFFFFFFFD] * count
    listed = b"".join(struct.pack("<I", x) for x in fat).ljust(512 * count, b"\xff")
    sectors += [listed[i : i + 512] for i in range(0, len(listed), 512)]
    head = office.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, count, directory, 0, cutoff, mini_start, 1, office.END_OF_CHAIN, 0)
    head += b"".join(struct.pack("<I", x) for x in [*range(table, table + count)]).ljust(436, b"\xff")
    return head + b"".join(sectors)


def document(pieces, table="1Table", formats=b"\1\3\0abc", pad=0):
    """A file whose text is these (text, bits) pieces."""
    body, bounds, places, at = b"", [0], [], 0x400
    for text, bits in pieces:
        data = text.encode("cp1252" if bits == 8 else "utf-16-le")
        if bits == 16 and (at + len(body)) % 2:
            body += b"\0"
        place = at + len(body)
        places.append((place * 2) | office.EIGHT_BIT if bits == 8 else place)
        body += data
        bounds.append(bounds[-1] + len(text))
    plc = b"".join(struct.pack("<I", x) for x in bounds) + b"".join(struct.pack("<HIH", 0, p, 0) for p in places)
    clx = formats + b"\2" + struct.pack("<I", len(plc)) + plc
    header = bytearray(0x400)
    header[0:2] = b"\xec\xa5"
    header[0x0A:0x0C] = struct.pack("<H", office.TABLE_BIT if table == "1Table" else 0)
    header[0x1A2:0x1AA] = struct.pack("<II", 7, len(clx))
    return {"WordDocument": bytes(header) + body + bytes(pad), table: b"\0" * 7 + clx}


@pytest.mark.parametrize("table", ["0Table", "1Table"])
@pytest.mark.parametrize("pad", [0, 10_000])
def test_pieces_of_both_widths(table, pad):
    data = compound(document([("First paragraph\rcaf\xe9 \x13", 8), ("Второй абзац\r", 16), ("cell\x07", 8), ("日本", 16)], table, pad=pad))
    assert office.legacy_text(data) == "First paragraph\ncafé Второй абзац\ncell\t日本"


def test_damaged_and_other_files(spark):
    streams = document([("A sentence that is long enough to be found again\r", 16), ("short", 8)])
    whole = compound(streams)
    cut = dict(streams) | {"1Table": b"\0" * 9}
    assert office.legacy_text(compound(cut)) == "A sentence that is long enough to be found again"
    assert office.legacy_text(compound({"WordDocument": streams["WordDocument"]})) == "A sentence that is long enough to be found again"
    for bad in (None, b"", b"text", office.SIGNATURE, office.SIGNATURE + bytes(600), compound({"Other": b"x"}), compound({"WordDocument": b"\xec\xa5"})):
        assert office.legacy_text(bad) == ""
    rng = random.Random(2)
    for _ in range(300):  # nothing in a damaged file ends the task
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 8)):
            data[rng.randrange(len(data))] = rng.choice((0, 255, rng.randrange(256)))
        office.legacy_text(bytes(data[: rng.choice((len(data), rng.randrange(len(data))))]))
    rows = spark.createDataFrame([("/a/x.DOC", whole), ("/a/y.doc", b"no"), ("/a/z.doc", None)], "path string, content binary")
    assert {r.path: r.text for r in file_texts(rows).collect()} == {"/a/x.DOC": "A sentence that is long enough to be found again\nshort", "/a/y.doc": "", "/a/z.doc": ""}
