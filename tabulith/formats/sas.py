"""SAS data files (.sas7bdat): header, pages, dictionary and records, on numpy; no Spark in here.

A file is a header and pages of one size. Dictionary entries are subheaders on metadata pages;
records lie back to back on data pages and on the rest of mixed pages, or, in compressed files, as
one subheader each. Compressed records keep no state, so any range of pages can be read alone.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from tabulith.formats.text import decoded

# The first bytes of a file.
MAGIC = bytes.fromhex("000000000000000000000000c2ea8160b31411cfbd92080009c7318c181f1011")
# Subheader signatures as signed integers of the file's width.
SIGNATURES = {0xF7F7F7F7: "row", 0xF6F6F6F6: "size", -3: "text", -1: "name", -4: "attribute", -1026: "format", -1024: "counts", -2: "list"}
# Kinds of page, by the bits that tell.
KIND_BITS, META, DATA, MIX, AMD = 0x0F00, 0x0000, 0x0100, 0x0200, 0x0400
#: Pages of these bits hold neither records nor a dictionary.
OTHER_BITS = 0xC000 | 0x1000
RLE, RDC = b"SASYZCRL", b"SASYZCR2"
MISSING_BITS = 0x7FF0000000000000
# Encodings by number, in Python's names.
ENCODINGS = {
    20: "utf-8", 28: "ascii", 29: "latin-1", 30: "iso8859-2", 31: "iso8859-3", 32: "iso8859-4", 33: "iso8859-5", 34: "iso8859-6", 35: "iso8859-7",
    36: "iso8859-8", 37: "iso8859-9", 39: "iso8859-11", 40: "iso8859-15", 41: "cp437", 42: "cp850", 43: "cp852", 44: "cp857", 45: "cp858",
    46: "cp862", 47: "cp864", 48: "cp865", 49: "cp866", 50: "cp869", 51: "cp874", 55: "cp720", 56: "cp737", 57: "cp775", 58: "cp860", 59: "cp863",
    60: "cp1250", 61: "cp1251", 62: "cp1252", 63: "cp1253", 64: "cp1254", 65: "cp1255", 66: "cp1256", 67: "cp1257", 68: "cp1258", 69: "mac_roman",
    70: "mac_arabic", 72: "mac_greek", 75: "mac_turkish", 118: "cp950", 123: "big5hkscs", 125: "gb18030", 126: "cp936", 134: "euc_jp", 136: "cp949",
    137: "cp932", 138: "cp932", 140: "euc_kr", 141: "cp949", 142: "cp949", 163: "mac_iceland", 167: "iso2022_jp", 168: "iso2022_kr", 205: "gb18030",
    227: "iso8859-14", 242: "iso8859-13", 245: "mac_croatian", 246: "mac_cyrillic", 247: "mac_romanian", 248: "shift_jisx0213",
}


class SasError(ValueError):
    """The file breaks the format's rules, or a request does not fit it."""


@dataclass
class Column:
    name: str
    offset: int
    length: int
    numeric: bool
    format: str = ""
    label: str = ""


@dataclass
class Run:
    """Pages in a row that hold equally many records, from one place in the page on."""

    row: int
    page: int
    pages: int
    each: int
    offset: int


@dataclass
class Dictionary:
    order: str  # < or >
    wide: bool  # integers of 8 bytes
    header: int
    page: int
    pages: int
    encoding_byte: int
    name: str = ""
    file_type: str = ""
    release: str = ""
    server: str = ""
    os: str = ""
    creator: str = ""
    compression: str = ""  # "", rle or rdc
    rows: int = -1
    row_length: int = -1
    mix_rows: int = -1
    columns: list[Column] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)

    @property
    def encoding(self) -> str:
        return ENCODINGS.get(self.encoding_byte, "cp1252")

    @property
    def int_size(self) -> int:
        return 8 if self.wide else 4

    @property
    def page_head(self) -> int:
        """Where the kind of a page stands; its pointers or records begin 8 bytes later."""
        return 32 if self.wide else 16


def read_header(f) -> Dictionary:
    head = f.read(288)
    if len(head) < 288 or head[:32] != MAGIC:
        raise SasError("not a SAS data file")
    wide, order = head[32] == 0x33, "<" if head[37] == 1 else ">"
    a1 = 4 if head[35] == 0x33 else 0
    a2 = a1 + (4 if wide else 0)
    size, page, pages = struct.unpack_from(order + "3I", head, 196 + a1)
    if page < 64 or size < 288:
        raise SasError("the header gives no usable page size")
    head += f.read(max(0, size - 288))
    d = Dictionary(order, wide, size, page, pages, head[70])
    say = lambda at, n: decoded(head[at : at + n].split(b"\0", 1)[0], "cp1252").strip()
    d.name, d.file_type, d.release, d.server = say(92, 64), say(156, 8), say(216 + a2, 8), say(224 + a2, 16)
    d.os = say(272 + a2, 16) or say(256 + a2, 16)
    return d


def signature(raw: bytes, d: Dictionary) -> str | None:
    """What a subheader describes, None for records."""
    raw = raw[: d.int_size]
    if raw[:4] in (b"\xf7" * 4, b"\xf6" * 4):
        return "row" if raw[0] == 0xF7 else "size"
    n = int.from_bytes(raw, "little" if d.order == "<" else "big", signed=True)
    return SIGNATURES.get(n)


def page_kind(raw: bytes, d: Dictionary) -> tuple[int, int, int]:
    """Kind, blocks and subheaders of a page."""
    kind, blocks, subheaders = struct.unpack_from(d.order + "3H", raw, d.page_head)
    return -1 if kind & OTHER_BITS else kind & KIND_BITS, blocks, subheaders


def pointers(raw: bytes, d: Dictionary, count: int) -> Iterator[tuple[int, int, int, int]]:
    """Offset, length, compression and type of the subheaders that are there."""
    i = d.int_size
    fmt = struct.Struct(d.order + ("2Q2B" if d.wide else "2I2B"))
    for k in range(count):
        at = d.page_head + 8 + 3 * i * k
        if at + fmt.size > len(raw):
            raise SasError("a page's pointers run over its end")
        offset, length, packed, kind = fmt.unpack_from(raw, at)
        if length and packed != 1:
            if offset + length > len(raw):
                raise SasError("a subheader runs over the end of its page")
            yield offset, length, packed, kind


class Builder:
    """Gathers a dictionary from subheaders."""

    def __init__(self, d: Dictionary):
        self.d, self.texts, self.names, self.attributes, self.formats = d, [], [], [], []
        self.count = self.parts = -1
        self.lcp = 0

    def take(self, raw: bytes, kind: str) -> None:
        d, i = self.d, self.d.int_size
        one = lambda k: int.from_bytes(raw[k * i : k * i + i], "little" if d.order == "<" else "big")
        if kind == "row":
            d.row_length, d.rows, d.mix_rows = one(5), one(6), one(15)
            self.parts = one(9) + one(10)
            at = 706 if d.wide else 378
            if len(raw) >= at + 2:
                (self.lcp,) = struct.unpack_from(d.order + "H", raw, at)
        elif kind == "size":
            self.count = one(1)
        elif kind == "text":
            body = raw[i:]
            d.compression = "rle" if RLE in body else "rdc" if RDC in body else d.compression
            if not self.texts:
                self.creator(body)
            self.texts.append(body)
        elif kind in ("name", "attribute"):
            step = 8 if kind == "name" else i + 8
            for at in range(i + 8, len(raw) - 12 - i + 1, step):
                if kind == "name":
                    self.names.append(struct.unpack_from(d.order + "3H", raw, at))
                else:
                    offset = int.from_bytes(raw[at : at + i], "little" if d.order == "<" else "big")
                    self.attributes.append((offset, struct.unpack_from(d.order + "I", raw, at + i)[0], raw[at + i + 6] == 1))
        elif kind == "format":
            self.formats.append(struct.unpack_from(d.order + "6H", raw, 3 * i + 22))

    def creator(self, body: bytes) -> None:
        """The procedure that made the file: its place depends on the compression's name before it; copy-compressed files give none."""
        packed = body[12:20].strip(b" \0")
        at = 28 if not packed else 36 if packed == RLE else len(body)
        self.d.creator = decoded(body[at : at + self.lcp].strip(b" \0"), "cp1252").strip()

    def say(self, block: int, offset: int, length: int) -> str:
        if not self.texts:
            return ""
        raw = self.texts[min(block, len(self.texts) - 1)][offset : offset + length]
        return decoded(raw.strip(b" \t\r\n").rstrip(bytes(range(32))), self.d.encoding)

    def columns(self) -> int:
        return self.count if self.count >= 0 else self.parts if self.parts > 0 else max(len(self.names), len(self.attributes), len(self.formats))

    def complete(self) -> bool:
        """Whether every column has a name, a place, a format entry, and their texts are known."""
        n = self.columns()
        if self.d.rows < 0 or self.count < 0 or min(len(self.names), len(self.attributes), len(self.formats)) < n:
            return False
        return all(x[0] < len(self.texts) for x in self.names) and all(max(x[0], x[3]) < len(self.texts) for x in self.formats)

    def finish(self) -> None:
        d = self.d
        if d.rows < 0 or d.row_length < 0:
            raise SasError("the file has no row size entry")
        if d.mix_rows < 0:
            d.mix_rows = d.rows
        for k in range(self.columns()):
            name = self.say(*self.names[k]) if k < len(self.names) else ""
            offset, length, numeric = self.attributes[k] if k < len(self.attributes) else (0, 0, True)
            fmt, label = (self.say(*self.formats[k][:3]), self.say(*self.formats[k][3:])) if k < len(self.formats) else ("", "")
            d.columns.append(Column(name, offset, length, numeric, fmt, label))


def read_dictionary(f) -> Dictionary:
    """The dictionary; pages are read until it is complete, since late pages may add to it."""
    f.seek(0)
    d = read_header(f)
    b = Builder(d)
    peek = d.page_head + 8
    for k in range(d.pages):
        f.seek(d.header + k * d.page)
        head = f.read(peek)
        if len(head) < peek:
            break
        kind, _, count = page_kind(head, d)
        if kind not in (META, MIX, AMD):
            continue
        raw = head + f.read(d.page - peek)
        for offset, length, _, _ in pointers(raw, d, count):
            what = signature(raw[offset : offset + d.int_size], d)
            if what:
                b.take(raw[offset : offset + length], what)
        if b.complete():
            break
    b.finish()
    return d


# ---- records --------------------------------------------------------------------------------


def stat_transfer(release: str) -> bool:
    """Files of that program need not pad mixed pages."""
    return bool(re.fullmatch(r"[89]\.0000M0.*", release))


def mixed_start(raw: bytes, d: Dictionary, subheaders: int) -> int:
    """Where the records of a mixed page begin: after the pointers, at a multiple of 8."""
    at = d.page_head + 8 + subheaders * 3 * d.int_size
    if at % 8 == 4 and (not stat_transfer(d.release) or raw[at : at + 4] in (b"\0" * 4, b" " * 4)):
        at += 4
    return at


def records_on(raw: bytes, d: Dictionary) -> list[tuple[int, int]]:
    """Offset and length of the records of a page, whatever its kind."""
    kind, blocks, count = page_kind(raw, d)
    size = d.row_length
    if kind == DATA:
        first, n = d.page_head + 8, blocks
    elif kind in (META, MIX, AMD):
        found = []
        if d.compression:
            for offset, length, packed, what in pointers(raw, d, count):
                if packed in (0, 4) and what == 1 and length <= size and not signature(raw[offset : offset + d.int_size], d):
                    found.append((offset, length))
        if found or kind != MIX:
            return found
        first, n = mixed_start(raw, d, count), min(d.rows, d.mix_rows)
    else:
        return []
    n = min(n, (d.page - first) // size) if size else 0
    return [(first + k * size, size) for k in range(n)]


def index(f, d: Dictionary) -> None:
    """Fills d.runs: which pages hold which records. Plain files need the head of each page only."""
    if d.runs:
        return
    row, peek = 0, d.page if d.compression else min(d.page, d.page_head + 12 + 24 * 64)
    for k in range(d.pages):
        if row >= d.rows:
            break
        f.seek(d.header + k * d.page)
        raw = f.read(peek)
        if len(raw) < d.page_head + 8:
            break
        kind, blocks, count = page_kind(raw, d)
        first = d.page_head + 8
        if d.compression:
            n = len(records_on(raw, d))
        elif kind == DATA:
            n = min(blocks, (d.page - first) // d.row_length) if d.row_length else 0
        elif kind == MIX:
            if len(raw) < first + count * 3 * d.int_size + 8:
                raw += f.read(d.page - len(raw))
            first = mixed_start(raw, d, count)
            n = min(d.rows, d.mix_rows, (d.page - first) // d.row_length) if d.row_length else 0
        else:
            n = 0
        n = min(n, d.rows - row)
        last = d.runs[-1] if d.runs else None
        if last and last.each == n and last.offset == first and last.page + last.pages == k:
            last.pages += 1
        elif n:
            d.runs.append(Run(row, k, 1, n, first))
        row += n


def plain_records(f, d: Dictionary, runs: list[Run], start: int, stop: int, batch: int) -> Iterator[np.ndarray]:
    """Records start..stop of a plain file, as byte rows, about `batch` at a time."""
    for run in runs:
        first, end = max(start, run.row), min(stop, run.row + run.each * run.pages)
        if first >= end:
            continue
        at, step = (first - run.row) // run.each, max(1, batch // run.each)
        last = (end - 1 - run.row) // run.each + 1
        for k in range(at, last, step):
            n = min(step, last - k)
            f.seek(d.header + (run.page + k) * d.page)
            raw = f.read(n * d.page)
            if len(raw) < n * d.page:
                raise SasError("the file ends inside a page")
            pages = np.frombuffer(raw, np.uint8).reshape(n, d.page)
            rows = pages[:, run.offset : run.offset + run.each * d.row_length].reshape(n * run.each, d.row_length)
            base = run.row + k * run.each
            yield rows[max(0, first - base) : min(len(rows), end - base)]


def packed_records(f, d: Dictionary, first: int, last: int, skip: int, take: int | None, batch: int) -> Iterator[np.ndarray]:
    """Records of the pages first..last of a compressed file, without the first `skip`, at most `take`."""
    unpack = unrle if d.compression == "rle" else unrdc
    held, step = [], max(1, (4 << 20) // d.page)
    for k in range(first, last, step):
        f.seek(d.header + k * d.page)
        block = f.read(min(step, last - k) * d.page)
        for at in range(0, len(block) - d.page + 1, d.page):
            raw = block[at : at + d.page]
            for offset, length in records_on(raw, d):
                if skip:
                    skip -= 1
                    continue
                if take is not None:
                    if not take:
                        break
                    take -= 1
                piece = raw[offset : offset + length]
                held.append(unpack(piece, d.row_length) if length < d.row_length else piece)
                if len(held) >= batch:
                    yield np.frombuffer(b"".join(held), np.uint8).reshape(len(held), d.row_length)
                    held = []
    if held:
        yield np.frombuffer(b"".join(held), np.uint8).reshape(len(held), d.row_length)


# Commands of the run-length form, by their upper four bits. What is written (None: bytes of
# the input, -1: the next byte, again and again), the least count, and what the lower four bits are worth
# where another byte of the count follows (0: none follows).
RLE_COMMANDS = {
    0x0: (None, 64, 256), 0x1: (None, 4160, 256), 0x2: (None, 96, 0), 0x4: (-1, 18, 16), 0x5: (0x40, 17, 256), 0x6: (0x20, 17, 256), 0x7: (0x00, 17, 256),
    0x8: (None, 1, 0), 0x9: (None, 17, 0), 0xA: (None, 33, 0), 0xB: (None, 49, 0), 0xC: (-1, 3, 0), 0xD: (0x40, 2, 0), 0xE: (0x20, 2, 0), 0xF: (0x00, 2, 0),
}


def unrle(raw: bytes, size: int) -> bytes:
    """A record of run-length commands; what they leave is filled with zeros."""
    out, have, at, end = [], 0, 0, len(raw)
    while at < end and have < size:
        code = raw[at]
        at += 1
        known = RLE_COMMANDS.get(code >> 4)
        if known is None:
            raise SasError(f"unknown run-length command {code >> 4}")
        fill, count, worth = known
        if worth:
            if at >= end:
                break
            count += (code & 15) * worth + raw[at]
            at += 1
        else:
            count += code & 15
        if fill is None:
            piece = raw[at : at + count]
            if len(piece) < count:
                raise SasError("a run-length record ends early")
            at += count
        elif fill < 0:
            if at >= end:
                break
            piece = raw[at : at + 1] * count
            at += 1
        else:
            piece = bytes([fill]) * count
        out.append(piece)
        have += count
    return b"".join(out)[:size].ljust(size, b"\0")


def unrdc(raw: bytes, size: int) -> bytes:
    """A record of literals, runs and copies of what came before, told apart by control bits."""
    out, at, end = bytearray(), 0, len(raw)
    control = left = 0
    while at < end and len(out) < size:
        if not left:
            if at + 1 >= end:
                break
            control, left, at = raw[at] << 8 | raw[at + 1], 16, at + 2
            if at >= end:
                break
        left -= 1
        code = raw[at]
        at += 1
        if not control >> left & 1:
            out.append(code)
            continue
        kind, low = code >> 4, code & 15
        need = 1 if kind in (0,) or kind > 2 else 2
        if at + need > end:
            break
        if kind == 0:
            out += raw[at : at + 1] * (low + 3)
        elif kind == 1:
            out += raw[at + 1 : at + 2] * (low + 16 * raw[at] + 19)
        else:
            back = low + 3 + 16 * raw[at]
            count = raw[at + 1] + 16 if kind == 2 else kind
            if back > len(out):
                raise SasError("a copy reaches back before the record")
            piece = bytes(out[-back:][:count])
            out += (piece * (count // len(piece) + 1))[:count]
        at += need
    return bytes(out[:size]).ljust(size, b"\0")


def numbers(rows: np.ndarray, c: Column, order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, validity and the bits of a numeric column; short ones keep the leading bytes of a double."""
    n, size = len(rows), min(8, c.length)
    full = np.zeros((n, 8), np.uint8)
    if c.offset + c.length <= rows.shape[1] and size:
        part = rows[:, c.offset : c.offset + size]
        full[:, 8 - size :] = part if order == "<" else part[:, ::-1]
    else:
        full[:, 6:] = 0xFF  # a column beyond the record is missing
    bits = full.view("<u8").ravel()
    return bits.view("<f8"), (bits & np.uint64(0x7FFFFFFFFFFFFFFF)) < np.uint64(MISSING_BITS), bits


#: Missing tags by the byte that tells: as a letter's code or its place, both with all bits turned.
TAGS = np.array([None] * 256, object)
for _k in range(26):
    TAGS[0xFF ^ (0x41 + _k)] = TAGS[0xFF ^ (2 + _k)] = "." + chr(0x41 + _k)
for _b in (0xD2, 0xFF ^ 0x5F, 0xFF):
    TAGS[_b] = "._"


def tags(bits: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """.A to .Z and ._, None for values and for "."."""
    return np.where(valid, None, TAGS[(bits >> np.uint64(40) & np.uint64(0xFF)).astype(np.int64)])
