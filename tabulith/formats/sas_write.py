"""The bytes of new SAS data files, in every layout that is read: integers of 4 or 8 bytes, either byte
order, plain, mixed, run-length and copy-compressed pages, dictionary entries after the records.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tabulith.formats import sas as S


@dataclass
class Layout:
    wide: bool = True
    order: str = "<"
    compression: str = ""  # "", rle or rdc
    page: int = 1 << 16
    header: int = 1024
    aligned: bool = True  # 4 more bytes before the header's numbers
    release: str = "9.0401M6"
    encoding: int = 20
    creator: str = "DATASTEP"
    late_formats: bool = False  # formats and labels on a page after the records

    @property
    def int_size(self) -> int:
        return 8 if self.wide else 4

    @property
    def head(self) -> int:
        return 32 if self.wide else 16

    def int(self, n: int) -> bytes:
        return (n % (1 << 8 * self.int_size)).to_bytes(self.int_size, "little" if self.order == "<" else "big")

    def pack(self, fmt: str, *x) -> bytes:
        return struct.pack(self.order + fmt, *x)


SIGN = {what: n for n, what in S.SIGNATURES.items()}


def place(columns: list[S.Column]) -> int:
    """Gives numbers, then texts, their place in a record; returns its length."""
    at = 0
    for c in sorted(columns, key=lambda c: not c.numeric):
        c.offset, at = at, at + c.length
    return -(-at // 8) * 8 if any(c.numeric for c in columns) else at


def texts(columns: list[S.Column], y: Layout) -> tuple[list[bytes], list[list[tuple[int, int, int]]]]:
    """Blocks of text, and where each column's name, format and label lie in them."""
    packed = {"": b"", "rle": S.RLE, "rdc": S.RDC}[y.compression]
    first = y.pack("H", 0).ljust(12, b"\0") + packed.ljust(8) + b" " * (16 if y.compression == "rle" else 8) + y.creator.encode().ljust(16)
    blocks, where = [bytearray(first.ljust(64))], []
    for c in columns:
        got = []
        for word in (c.name, c.format, c.label):
            raw = word.encode("utf-8" if y.encoding == 20 else S.ENCODINGS[y.encoding])
            if len(blocks[-1]) + len(raw) > min(30_000, y.page // 2):
                blocks.append(bytearray(y.pack("H", 0).ljust(8, b"\0")))
            got.append((len(blocks) - 1, len(blocks[-1]), len(raw)))
            blocks[-1] += raw.ljust(-(-len(raw) // 4) * 4)
        where.append(got)
    return [bytes(b) for b in blocks], where


def subheaders(columns: list[S.Column], rows: int, row_length: int, mix_rows: int, y: Layout) -> tuple[list[bytes], list[bytes]]:
    """The dictionary's entries, and those of formats and labels."""
    i, n = y.int_size, len(columns)
    row = bytearray(808 if y.wide else 480)
    for k, x in {0: SIGN["row"], 5: row_length, 6: rows, 9: n, 10: 0, 15: mix_rows}.items():
        row[k * i : k * i + i] = y.int(x)
    lcs, lcp = (682, 706) if y.wide else (354, 378)
    row[lcs : lcs + 2], row[lcp : lcp + 2] = y.pack("H", 0), y.pack("H", len(y.creator))
    blocks, where = texts(columns, y)
    out = [bytes(row), y.int(SIGN["size"]) + y.int(n) + y.int(0)]
    out += [y.int(SIGN["text"]) + y.pack("H", len(b)) + b[2:] for b in blocks]
    some = max(1, (y.page // 2 - 64) // (i + 8))
    for k in range(0, n, some):
        names = b"".join(y.pack("4H", *where[j][0], 0) for j in range(k, min(n, k + some)))
        out.append(y.int(SIGN["name"]) + b"\0" * 8 + names + b"\0" * 12)
    for k in range(0, n, some):
        places = b"".join(y.int(c.offset) + y.pack("IHBB", c.length, 4, 1 if c.numeric else 2, 0) for c in columns[k : k + some])
        out.append(y.int(SIGN["attribute"]) + b"\0" * 8 + places + b"\0" * 12)
    shown = [(y.int(SIGN["format"]) + b"\0" * (2 * i + 22) + y.pack("6H", *w[1], *w[2])).ljust(64 if y.wide else 52, b"\0") for w in where]
    return out, shown


def page_of(kind: int, entries: list[tuple[bytes, int, int]], y: Layout, blocks: int | None = None, rows: bytes = b"") -> bytes:
    """A page of entries (bytes, compression, type), which lie at its end, and of records after the pointers."""
    out = bytearray(y.page)
    out[y.head : y.head + 8] = y.pack("4H", kind, len(entries) if blocks is None else blocks, len(entries), 0)
    at, end = y.head + 8, y.page
    for raw, packed, what in entries:
        end -= -(-len(raw) // 8) * 8
        out[end : end + len(raw)] = raw
        out[at : at + 3 * y.int_size] = (y.int(end) + y.int(len(raw)) + bytes([packed, what])).ljust(3 * y.int_size, b"\0")
        at += 3 * y.int_size
    if rows:
        at += 4 if at % 8 == 4 and not S.stat_transfer(y.release) else 0
        out[at : at + len(rows)] = rows
        at += len(rows)
    if at > end:
        raise S.SasError("a page is too small for its entries")
    return bytes(out)


def entry_pages(entries: list[tuple[bytes, int, int]], y: Layout, kind: int) -> Iterator[bytes]:
    """Entries over as many pages as they need."""
    held, room = [], 0
    for e in entries:
        size = -(-len(e[0]) // 8) * 8 + 3 * y.int_size
        if held and room + size > y.page - y.head - 16:
            yield page_of(kind, held, y)
            held, room = [], 0
        held.append(e)
        room += size
    if held:
        yield page_of(kind, held, y)


def record_pages(records: np.ndarray, y: Layout) -> Iterator[bytes]:
    """Records (byte rows) on pages of their own."""
    n, size = records.shape
    if y.compression:
        made = []
        for r in records:
            raw = r.tobytes()
            packed = (rle if y.compression == "rle" else rdc)(raw)
            made.append((packed, 4, 1) if len(packed) < size else (raw, 0, 1))
        yield from entry_pages(made, y, S.META)
        return
    each = (y.page - y.head - 8) // size
    for k in range(0, n, each):
        rows = records[k : k + each]
        yield page_of(S.DATA, [], y, len(rows), rows.tobytes())


def file_head(columns: list[S.Column], rows: int, row_length: int, pages: int, y: Layout, name: str = "DATA", mixed: bytes = b"") -> tuple[bytes, bytes]:
    """Header with metadata pages, and the pages that come after the records. `pages`: of records.
    `mixed`: records that share the last metadata page, which makes it a mixed one."""
    mix_rows = len(mixed) // row_length if row_length else 0
    entries, shown = subheaders(columns, rows, row_length, mix_rows, y)
    late = [(e, 0, 0) for e in shown] if y.late_formats else []
    meta = list(entry_pages([(e, 0, 0) for e in entries + ([] if late else shown)], y, S.META))
    if mixed:
        entry = [(e, 0, 0) for e in ([] if late else shown)[-1:] or entries[-1:]]
        early = [(e, 0, 0) for e in entries + ([] if late else shown)][:-1]
        meta = [*entry_pages(early, y, S.META), page_of(S.MIX, entry, y, 1 + mix_rows, mixed)]
    after = list(entry_pages(late, y, S.AMD))
    a1 = 4 if y.aligned else 0
    a2 = a1 + (4 if y.wide else 0)
    head = bytearray(y.header)
    head[:32] = S.MAGIC
    head[32], head[35], head[37], head[39], head[70] = 0x33 if y.wide else 0x22, 0x33 if y.aligned else 0x22, 1 if y.order == "<" else 0, 0x31, y.encoding
    for at, raw in ((92, name.encode().ljust(64)), (156, b"DATA".ljust(8)), (196 + a1, y.pack("3I", y.header, y.page, len(meta) + pages + len(after))), (216 + a2, y.release.encode()), (224 + a2, b"Linux".ljust(16)), (256 + a2, b"x86_64".ljust(16))):
        head[at : at + len(raw)] = raw
    return bytes(head) + b"".join(meta), b"".join(after)


def number_bytes(x: np.ndarray, length: int, order: str) -> np.ndarray:
    """Doubles cut to their leading bytes, as byte rows."""
    raw = np.ascontiguousarray(x.astype("<f8")).view(np.uint8).reshape(-1, 8)[:, 8 - length :]
    return raw if order == "<" else raw[:, ::-1]


def missing(tag: str = ".") -> float:
    """The number that stands for a missing value."""
    byte = 0xFE if tag == "." else 0xD2 if tag == "._" else 0xFF ^ ord(tag[1].upper())
    return np.array([0xFFFF << 48 | byte << 40], np.uint64).view(np.float64)[0]


def missing_of(tags: list[str | None]) -> np.ndarray:
    known = {t: missing(t or ".") for t in set(tags)}
    return np.array([known[t] for t in tags], np.float64)


def rle(raw: bytes) -> bytes:
    """Run-length commands for a record."""
    out, at, n, start = bytearray(), 0, len(raw), 0

    def literals(piece: bytes) -> None:
        for k in range(0, len(piece), 79):
            part = piece[k : k + 79]
            m = len(part)
            if m >= 64:
                out.extend([0x00, m - 64])
            else:
                out.append(0x80 + (m - 1 >> 4 << 4) + (m - 1 & 15))
            out.extend(part)

    while at < n:
        end = at + 1
        while end < n and raw[end] == raw[at] and end - at < 2000:
            end += 1
        size = end - at
        if size < 4:
            at = end
            continue
        literals(raw[start:at])
        code = {0x40: 0x50, 0x20: 0x60, 0x00: 0x70}.get(raw[at])
        if code is not None and size >= 17:
            out.extend([code + (size - 17 >> 8), size - 17 & 255])
        elif code is not None:
            out.append(code + 0x80 + size - 2)
        elif size <= 18:
            out.extend([0xC0 + size - 3, raw[at]])
        else:
            size = min(size, 273)
            end = at + size
            out.extend([0x40, size - 18, raw[at]])
        at = start = end
    literals(raw[start:])
    return bytes(out)


def rdc(raw: bytes) -> bytes:
    """Literals, runs and copies of earlier bytes, sixteen to a control word."""
    out, bits, held, at, n = bytearray(), [], bytearray(), 0, len(raw)
    seen: dict[bytes, int] = {}

    def put(bit: int, piece: bytes) -> None:
        bits.append(bit)
        held.extend(piece)
        if len(bits) == 16:
            flush()

    def flush() -> None:
        word = sum(b << 15 - k for k, b in enumerate(bits))
        out.extend([word >> 8, word & 255])
        out.extend(held)
        bits.clear()
        held.clear()

    while at < n:
        end = at + 1
        while end < n and raw[end] == raw[at] and end - at < 4114:
            end += 1
        size = end - at
        if size >= 19:
            size -= 19
            put(1, bytes([0x10 | size & 15, size >> 4, raw[at]]))
        elif size >= 3:
            put(1, bytes([size - 3, raw[at]]))
        else:
            back, end = at - seen.get(raw[at : at + 3], at), at + 1
            if 3 <= back <= 4098:
                size = 3
                while at + size < n and size < 271 and raw[at + size] == raw[at + size - back]:
                    size += 1
                b = back - 3
                if size >= 16:
                    put(1, bytes([0x20 | b & 15, b >> 4, size - 16]))
                else:
                    put(1, bytes([size << 4 | b & 15, b >> 4]))
                end = at + size
            else:
                put(0, raw[at : at + 1])
        for k in range(at, min(end, n - 2)):
            seen[raw[k : k + 3]] = k
        at = end
    if bits:
        flush()
    return bytes(out)
