"""SPSS system files (.sav, .zsav): dictionary, case decoding, and the bytes of new files, on numpy.

A case is a row of 8-byte cells. Plain files hold the cells themselves, so any range of cases can
be sought; compressed ones hold one code per cell and have no index, so they are read in order.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabulith.formats.text import WESTERN, fixed

# The numbers that stand for system missing, lowest and highest, as bits.
SYSMIS, LOWEST, HIGHEST = 0xFFEFFFFFFFFFFFFF, 0xFFEFFFFFFFFFFFFE, 0x7FEFFFFFFFFFFFFF
# Codes of compressed cells. Others are the number code - bias.
PAD, END, LITERAL, BLANKS, MISSING = 0, 252, 253, 254, 255
# Print formats that are dates, datetimes and times.
TEMPORAL = {20: "date", 23: "date", 24: "date", 38: "date", 39: "date", 22: "datetime", 41: "datetime", 21: "time", 25: "time"}
# Bytes of a segment of a very long string, and its share of the declared width.
SEGMENT, SEGMENT_SHARE = 255, 252
EPOCH = 12_219_379_200
#: A text with one of these cannot be written in Windows-1252.
NOT_WESTERN = "[^" + "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in WESTERN if c.encode("cp1252", "ignore")) + "]"


class SpssError(ValueError):
    pass


@dataclass
class Variable:
    short: bytes
    width: int  # 0: a number
    cell: int  # its first cell in a case
    print_format: int
    name: str = ""
    label: str = ""
    cells: int = 1
    pieces: list[tuple[int, int]] = field(default_factory=list)  # byte ranges in a case
    labels: dict = field(default_factory=dict)
    discrete: list = field(default_factory=list)
    span: tuple[float, float] | None = None

    @property
    def kind(self) -> str:
        return "string" if self.width else TEMPORAL.get(self.print_format >> 16 & 255, "number")


@dataclass
class Dictionary:
    order: str = "<"
    compression: int = 0
    rows: int = -1
    bias: float = 100.0
    cells: int = 0
    label: str = ""
    encoding: str = "cp1252"
    data_at: int = 0
    variables: list[Variable] = field(default_factory=list)


def bits(x: float) -> int:
    return struct.unpack("<Q", struct.pack("<d", x))[0]


def text(raw: bytes, encoding: str) -> str:
    return raw.rstrip(b" \0").decode(encoding, "replace")


def known_encoding(name: str, fallback: str) -> str:
    import codecs

    for n in (name, name.lower().replace("windows-", "cp")):
        try:
            return codecs.lookup(n).name
        except LookupError:
            continue
    return fallback


def read_dictionary(f) -> Dictionary:
    d = Dictionary()
    head = f.read(176)
    if len(head) < 176 or head[:4] not in (b"$FL2", b"$FL3"):
        raise SpssError("not an SPSS system file")
    d.order = "<" if head[64:68] in (b"\2\0\0\0", b"\3\0\0\0") else ">"
    o = d.order
    _, _, d.compression, _, d.rows = struct.unpack(o + "5i", head[64:84])
    d.bias = struct.unpack(o + "d", head[84:92])[0]

    def ints(n: int) -> tuple[int, ...]:
        raw = f.read(4 * n)
        if len(raw) < 4 * n:
            raise SpssError("the dictionary ends early")
        return struct.unpack(f"{o}{n}i", raw)

    at_cell: list[Variable | None] = []  # a variable at its first cell
    labels: dict[int, bytes] = {}
    sets: list[tuple[list[tuple[bytes, bytes]], tuple[int, ...]]] = []
    extras: dict[int, bytes] = {}
    pending: list[tuple[bytes, bytes]] = []
    while True:
        (kind,) = ints(1)
        if kind == 2:
            width, has_label, n_missing, shown, _ = ints(5)
            short = f.read(8)
            if has_label:
                (size,) = ints(1)
                labels[len(at_cell)] = f.read(-(-size // 4) * 4)[:size]
            raw = [f.read(8) for _ in range(abs(n_missing))]
            if width < 0:
                at_cell.append(None)
                continue
            v = Variable(short.rstrip(), width, len(at_cell), shown)
            if width:
                v.discrete = raw
            else:
                numbers = [struct.unpack(o + "d", x)[0] for x in raw]
                if n_missing < 0:
                    v.span, numbers = (numbers[0], numbers[1]), numbers[2:]
                v.discrete = numbers
            v.cells = max(1, -(-width // 8))
            at_cell.append(v)
        elif kind == 3:
            pending = []
            for _ in range(ints(1)[0]):
                key, size = f.read(8), f.read(1)[0]
                pending.append((key, f.read(-(-(size + 1) // 8) * 8 - 1)[:size]))
        elif kind == 4:
            sets.append((pending, ints(ints(1)[0])))
        elif kind == 6:
            f.read(80 * ints(1)[0])
        elif kind == 7:
            sub, size, count = ints(3)
            extras[sub] = f.read(size * count)
        elif kind == 999:
            f.read(4)
            break
        else:
            raise SpssError(f"unknown record {kind}")
    d.data_at, d.cells = f.tell(), len(at_cell)

    if 3 in extras and len(extras[3]) >= 32:
        page = struct.unpack(o + "8i", extras[3][:32])[7]
        d.encoding = "utf-8" if page == 65001 else known_encoding(f"cp{page}", d.encoding)
    if 20 in extras:
        d.encoding = known_encoding(extras[20].decode("ascii", "replace").strip(" \0"), d.encoding)
    enc = d.encoding
    d.label = text(head[109:173], enc)
    first = [v for v in at_cell if v is not None]
    for v in first:
        v.name, v.label = text(v.short, enc).upper(), text(labels.get(v.cell, b""), enc)
        if v.width:
            v.discrete = [text(x, enc) for x in v.discrete]
    for pairs, owners in sets:
        for k in owners:
            v = at_cell[k - 1] if 0 < k <= len(at_cell) else None
            if v is not None:
                v.labels |= {text(key, enc) if v.width else struct.unpack(o + "d", key)[0]: text(w, enc) for key, w in pairs if w.strip(b" \0")}
    by_short = {v.name: v for v in first}
    wide = dict(pair.split("=", 1) for pair in text(extras.get(14, b""), enc).replace("\0", "").split("\t") if "=" in pair)
    d.variables = join_segments(first, {k.upper(): int(w) for k, w in wide.items()})
    for pair in text(extras.get(13, b""), enc).split("\t"):
        short, _, long = pair.partition("=")
        if long and short.upper() in by_short:
            by_short[short.upper()].name = long
    by_name = {v.name: v for v in d.variables}
    for name, key, word in long_entries(extras.get(21, b""), o, enc, True):
        if name in by_name and word:
            by_name[name].labels[key] = word
    for name, key, _ in long_entries(extras.get(22, b""), o, enc, False):
        if name in by_name:
            by_name[name].discrete.append(key)
    return d


def join_segments(first: list[Variable], wide: dict[str, int]) -> list[Variable]:
    """Variables of a very long string become one; every variable gets its byte ranges."""
    out, k = [], 0
    while k < len(first):
        v = first[k]
        width = wide.get(v.name, 0)
        parts = -(-width // SEGMENT_SHARE) if width > SEGMENT else 1
        if parts > 1:
            for p in first[k : k + parts]:
                size = min(SEGMENT, width - sum(n for _, n in v.pieces), p.cells * 8)
                v.pieces.append((p.cell * 8, max(0, size)))
            v.width = width
        else:
            v.pieces = [(v.cell * 8, v.width or 8)]
        out.append(v)
        k += parts
    return out


def long_entries(raw: bytes, order: str, enc: str, labelled: bool) -> Iterator[tuple[str, str, str]]:
    """(variable, value, label) of the records on long strings."""
    f = io.BytesIO(raw)

    def sized() -> bytes:
        return f.read(struct.unpack(order + "i", f.read(4))[0])

    while f.tell() < len(raw):
        name = text(sized(), enc)
        if labelled:
            _, count = struct.unpack(order + "2i", f.read(8))
            for _ in range(count):
                key = text(sized(), enc)
                yield name, key, text(sized(), enc)
        else:
            count, size = f.read(1)[0], struct.unpack(order + "i", f.read(4))[0]
            for _ in range(count):
                yield name, text(f.read(size), enc), ""


# ---- cases ----------------------------------------------------------------------------------


def inflated(f, d: Dictionary) -> Iterator[bytes]:
    """The code stream of a compressed file, in pieces."""
    f.seek(d.data_at)
    if d.compression == 1:
        while piece := f.read(1 << 22):
            yield piece
        return
    _, trailer, _ = struct.unpack(d.order + "3q", f.read(24))
    f.seek(trailer)
    _, _, _, count = struct.unpack(d.order + "2q2i", f.read(24))
    entries = [struct.unpack(d.order + "2q2i", f.read(24)) for _ in range(count)]
    for _, at, _, size in entries:
        f.seek(at)
        yield zlib.decompress(f.read(size))


def cells_of(f, d: Dictionary) -> Iterator[np.ndarray]:
    """Cells of a compressed file, each an integer that stands for its eight bytes as they are in the file."""
    numbers = (np.arange(256) - d.bias).astype(d.order + "f8").view(np.uint64)
    numbers[BLANKS] = np.frombuffer(b" " * 8, np.uint64)[0]
    numbers[MISSING] = np.frombuffer(struct.pack(d.order + "Q", SYSMIS), np.uint64)[0]
    rest, end = b"", False
    for piece in inflated(f, d):
        raw, starts, p = rest + piece, [], 0
        while p + 8 <= len(raw):
            size = 8 + 8 * raw.count(b"\xfd", p, p + 8)
            if p + size > len(raw):
                break
            starts.append(p)
            p += size
        rest = raw[p:]
        if not starts:
            continue
        data, at = np.frombuffer(raw, np.uint8), np.array(starts)
        codes = data[at[:, None] + np.arange(8)]
        lit = codes == LITERAL
        source = at[:, None] + 8 * np.cumsum(lit, axis=1)
        out = numbers[codes]
        out[lit] = np.ascontiguousarray(data[source[lit][:, None] + np.arange(8)]).view(np.uint64).ravel()
        codes, out = codes.ravel(), out.ravel()
        stop = np.flatnonzero(codes == END)
        if len(stop):
            codes, out, end = codes[: stop[0]], out[: stop[0]], True
        yield out[codes != PAD]
        if end:
            return


def cases(f, d: Dictionary, start: int, stop: int | None, batch: int) -> Iterator[np.ndarray]:
    """Cases start..stop (None: all) as byte rows, at most `batch` at a time."""
    width = d.cells * 8
    if not width:
        return
    if d.compression == 0:
        f.seek(d.data_at + start * width)
        while stop is None or start < stop:
            raw = f.read(width * (batch if stop is None else min(batch, stop - start)))
            n = len(raw) // width
            if not n:
                return
            yield np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
            start += n
        return
    held, have, at = [], 0, 0
    for cells in cells_of(f, d):
        held.append(cells)
        have += len(cells)
        if have < d.cells:
            continue
        flat = np.concatenate(held)
        n = have // d.cells
        rows = flat[: n * d.cells].view(np.uint8).reshape(n, width)
        held, have = [flat[n * d.cells :]], have - n * d.cells
        lo, hi = max(0, start - at), n if stop is None else min(n, stop - at)
        for k in range(lo, hi, batch):
            yield rows[k : min(hi, k + batch)]
        at += n
        if stop is not None and at >= stop:
            return


def decode(d: Dictionary, v: Variable, rows: np.ndarray) -> tuple[np.ndarray | pa.Array, np.ndarray, np.ndarray]:
    """Values (texts as an Arrow array), which of them are there, and which are declared missing."""
    if v.width:
        raw = np.concatenate([rows[:, a : a + n] for a, n in v.pieces], axis=1)
        words = fixed(raw, d.encoding, "drop" if d.encoding == "utf-8" else "keep")
        blank = pc.equal(words, "").to_numpy(zero_copy_only=False)
        declared = np.zeros(len(rows), bool)
        if v.discrete:
            declared = pc.is_in(words, value_set=pa.array(v.discrete, pa.string())).to_numpy(zero_copy_only=False)
        return words, ~declared & ~blank, declared & ~blank
    at = v.pieces[0][0]
    x = np.ascontiguousarray(rows[:, at : at + 8]).view(d.order + "f8").ravel().astype("<f8")
    pattern = x.view(np.uint64)
    there = ~np.isnan(x) & (pattern != SYSMIS) & (pattern != LOWEST) & (pattern != HIGHEST)
    declared = np.isin(pattern, np.array([bits(m) for m in v.discrete], np.uint64))
    if v.span:
        declared |= (x >= v.span[0]) & (x <= v.span[1])
    return x, there & ~declared, there & declared


# ---- new files ------------------------------------------------------------------------------


def short_names(names: list[str]) -> list[str]:
    """Unique names of at most 8 ASCII letters and digits, in upper case."""
    out: list[str] = []
    for n in names:
        base = "".join(c for c in n.upper() if c.isascii() and (c.isalnum() or c in "_@#$."))[:8].rstrip(".") or "V"
        base = base if base[0].isalpha() or base[0] == "@" else ("V" + base)[:8]
        made, k = base, 0
        while made in out:
            k += 1
            made = base[: 8 - len(str(k))] + str(k)
        out.append(made)
    return out


def head(variables: list[Variable], rows: int, utf8: bool, made: str = "01 Jan 70", clock: str = "00:00:00") -> bytes:
    """Everything before the cases; labels are in variable.labels."""
    enc = "utf-8" if utf8 else "cp1252"
    cells = sum(v.cells for v in variables)
    out = [b"$FL2", b"@(#) SPSS DATA FILE".ljust(60), struct.pack("<5id", 2, cells, 0, 0, rows, 100.0), made.encode(), clock.encode(), b" " * 64, b"\0" * 3]
    for v in variables:
        label = v.label.encode(enc)[:252]
        out.append(struct.pack("<6i8s", 2, v.width, bool(label), 0, v.print_format, v.print_format, v.short.ljust(8)))
        if label:
            out.append(struct.pack("<i", len(label)) + label.ljust(-(-len(label) // 4) * 4))
        out += [struct.pack("<6i8s", 2, -1, 0, 0, 0, 0, b" " * 8)] * (v.cells - 1)
    for v in variables:
        if v.labels:
            out.append(struct.pack("<2i", 3, len(v.labels)))
            for key, word in sorted(v.labels.items()):
                w = word.encode(enc)[:120]
                out.append(struct.pack("<dB", float(key), len(w)) + w.ljust(-(-(len(w) + 1) // 8) * 8 - 1))
            out.append(struct.pack("<3i", 4, 1, v.cell + 1))
    out.append(struct.pack("<12i", 7, 3, 4, 8, 1, 0, 0, -1, 1, 1, 2, 65001 if utf8 else 1252))
    out.append(struct.pack("<4i3Q", 7, 4, 8, 3, SYSMIS, HIGHEST, LOWEST))
    if any(v.name != v.short.decode() for v in variables):
        names = "\t".join(f"{v.short.decode()}={v.name}" for v in variables).encode(enc)
        out.append(struct.pack("<4i", 7, 13, 1, len(names)) + names)
    if utf8:
        out.append(struct.pack("<4i", 7, 20, 1, 5) + b"UTF-8")
    return b"".join([*out, struct.pack("<2i", 999, 0)])


def encode(variables: list[Variable], columns: list[pa.Array], utf8: bool) -> bytes:
    n = len(columns[0]) if columns else 0
    out = np.full((n, sum(v.cells for v in variables) * 8), 32, np.uint8)
    for v, a in zip(variables, columns, strict=True):
        at = v.cell * 8
        if v.width:
            raw = [w.encode("utf-8" if utf8 else "cp1252") if w else b"" for w in a.to_pylist()]
            if max(map(len, raw), default=0) > v.width:
                raise SpssError(f"{v.name}: a text is longer than it was when widths were taken")
            words = np.array([w.ljust(v.cells * 8) for w in raw], f"S{v.cells * 8}")
            out[:, at : at + v.cells * 8] = words.view(np.uint8).reshape(n, v.cells * 8)
        else:
            y = a.fill_null(0).to_numpy(zero_copy_only=False).astype("<f8").view(np.uint64).copy()
            y[~a.is_valid().to_numpy(zero_copy_only=False)] = SYSMIS
            out[:, at : at + 8] = y.view(np.uint8).reshape(n, 8)
    return out.tobytes()
