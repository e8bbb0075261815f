"""Stata .dta codec (reads releases 102-119, either byte order; writes 118 and 119) on numpy; no Spark in here."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabulith.formats.text import decoded, fixed

# Fixed values of the file format.
STRL, DOUBLE, FLOAT, LONG, INT, BYTE = 32768, 65526, 65527, 65528, 65529, 65530
KIND = {BYTE: "i1", INT: "i2", LONG: "i4", FLOAT: "f4", DOUBLE: "f8"}
#: Largest value that is not missing, and the code of ".".
LIMIT = {BYTE: (100, 101), INT: (32740, 32741), LONG: (2147483620, 2147483621)}
LEAST = {BYTE: -127, INT: -32767, LONG: -2147483647}
FLOAT_MISSING, FLOAT_STEP = 0x7F000000, 0x800
DOUBLE_MISSING, DOUBLE_STEP = 0x7FE0000000000000, 0x0000010000000000
EPOCH_DAYS = 3653  # 1960-01-01 to 1970-01-01
TAGS = np.array([None, *("." + chr(97 + k) for k in range(26))], object)


class StataError(ValueError):
    """The file or the frame breaks the format's rules."""


@dataclass
class Variable:
    name: str
    type: int
    format: str = ""
    label: str = ""
    label_set: str = ""

    @property
    def width(self) -> int:
        return 8 if self.type == STRL else np.dtype(KIND[self.type]).itemsize if self.type in KIND else self.type


@dataclass
class Dictionary:
    release: int
    order: str  # < or >
    rows: int
    variables: list[Variable]
    label: str = ""
    timestamp: str = ""
    data_at: int = 0
    strls_at: int = 0
    labels_at: int = 0
    label_sets: dict[str, dict[int, str]] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return sum(v.width for v in self.variables)


def text(raw: bytes, encoding: str = "utf-8") -> str:
    return decoded(raw.split(b"\0", 1)[0], encoding)


def layout(release: int) -> tuple[int, int, int, int, int]:
    """Bytes of a variable name, a format, a variable label, the data label and a label set's name, by release."""
    name = 9 if release < 110 else 33 if release < 118 else 129
    fmt = 7 if release < 105 else 12 if release < 114 else 49 if release < 118 else 57
    label = 32 if release < 108 else 81 if release < 118 else 321
    return name, fmt, label, label, 33 if release < 118 else 129


def read_dictionary(f) -> Dictionary:
    """Reads everything but the data and the long strings from an open file."""
    f.seek(0)
    start = f.read(11)
    if start == b"<stata_dta>":
        return read_tagged(f)
    if len(start) >= 10 and 102 <= start[0] <= 115 and start[0] not in (106, 107, 109, 112) and start[1] <= 2:
        return read_untagged(f, start)
    raise StataError("not a Stata file of a known release")


def read_untagged(f, start: bytes) -> Dictionary:
    """Releases 102 to 115: fields of fixed width, one after the other."""
    release, o = start[0], ">" if start[1] == 1 else "<"
    enc = "cp1252"
    name_w, fmt_w, label_w, data_label_w, _ = layout(release)
    f.seek(4)

    def take(n: int) -> bytes:
        raw = f.read(n)
        if len(raw) < n:
            raise StataError("the dictionary ends early")
        return raw

    (k,) = struct.unpack(o + "H", take(2))
    (n,) = struct.unpack(o + ("H" if release == 102 else "I"), take(2 if release == 102 else 4))
    label = text(take(data_label_w), enc)
    stamp = text(take(18), enc) if release >= 105 else ""
    codes = take(k)
    cut = lambda w: [text(take(w), enc) for _ in range(k)]
    names = cut(name_w)
    take(2 * (k + 1))  # the order of sorting
    formats, sets, labels = cut(fmt_w), cut(name_w), cut(label_w)
    if release >= 105:  # expansion fields
        fmt = o + ("BH" if release < 110 else "BI")
        while True:
            kind, size = struct.unpack(fmt, take(struct.calcsize(fmt)))
            if not kind and not size:
                break
            if kind != 1:
                raise StataError("an expansion field of unknown kind")
            take(size)
    out = Dictionary(release, o, n, [Variable(a, old_type(c, release), b, d, e) for a, c, b, d, e in zip(names, codes, formats, labels, sets, strict=True)], label, stamp)
    out.data_at = f.tell()
    out.strls_at = out.labels_at = out.data_at + n * out.width
    f.seek(out.labels_at)
    raw = f.read()
    at = 0
    while at + 4 < len(raw):
        if release < 105:  # the index of a text is its value
            (size,) = struct.unpack_from(o + "H", raw, at)
            name, body = text(raw[at + 2 : at + 14], enc), raw[at + 16 : at + 16 + size]
            words = {i: text(body[8 * i : 8 * i + 8], enc) for i in range(size // 8)}
            out.label_sets[name] = {i: w for i, w in words.items() if w}
            at += 16 + size
        else:
            (size,) = struct.unpack_from(o + "I", raw, at)
            name_at = at + 4
            at = name_at + 33 + 3
            if size < 8 or at + size > len(raw):
                break
            out.label_sets[text(raw[name_at : name_at + 33], enc)] = label_table(raw[at : at + size], o, enc)
            at += size
    return out


def old_type(code: int, release: int) -> int:
    """A type code of one byte as one of later releases."""
    if release >= 111:
        return {251: BYTE, 252: INT, 253: LONG, 254: FLOAT, 255: DOUBLE}.get(code, code)
    if code > 127:
        return code - 127
    kinds = {ord("b"): BYTE, ord("i"): INT, ord("l"): LONG, ord("f"): FLOAT, ord("d"): DOUBLE}
    if code not in kinds:
        raise StataError(f"unknown type code {code}")
    return kinds[code]


def label_table(raw: bytes, o: str, enc: str) -> dict[int, str]:
    """Number of entries, bytes of text, places, values, text."""
    count, size = struct.unpack_from(o + "2I", raw)
    if size > len(raw) - 8 or count > (len(raw) - 8 - size) // 8:
        raise StataError("a label table runs over its end")
    off, val = np.frombuffer(raw, o + "u4", count, 8), np.frombuffer(raw, o + "i4", count, 8 + 4 * count)
    body = raw[8 + 8 * count : 8 + 8 * count + size]
    words = {int(v): text(body[p:], enc) for v, p in zip(val, off, strict=True) if p < size}
    return {v: w for v, w in words.items() if w}


def read_tagged(f) -> Dictionary:
    """Releases 117 to 119: sections between tags, whose places are in a map."""
    f.seek(0)
    head = f.read(2048)
    m = re.match(rb"<stata_dta><header><release>(\d{3})</release><byteorder>(MSF|LSF)</byteorder><K>", head)
    if not m:
        raise StataError("the header is not as the format has it")
    release, o = int(m[1]), "<" if m[2] == b"LSF" else ">"
    if release not in (117, 118, 119):
        raise StataError(f"unsupported release {release}")
    enc = "utf-8" if release >= 118 else "cp1252"
    at = m.end()

    def take(fmt: str) -> int:
        nonlocal at
        (v,) = struct.unpack_from(o + fmt, head, at)
        at += struct.calcsize(fmt)
        return v

    def skip(tag: bytes) -> None:
        nonlocal at
        if head[at : at + len(tag)] != tag:
            raise StataError(f"expected {tag!r}")
        at += len(tag)

    k = take("I" if release == 119 else "H")
    skip(b"</K><N>")
    n = take("Q" if release >= 118 else "I")
    skip(b"</N><label>")
    size = take("H" if release >= 118 else "B")
    label = text(head[at : at + size], enc)
    at += size
    skip(b"</label><timestamp>")
    size = take("B")
    stamp = text(head[at : at + size], enc)
    at += size
    skip(b"</timestamp></header><map>")
    offsets = struct.unpack_from(o + "14Q", head, at)

    def section(j: int, tag: str) -> bytes:
        f.seek(offsets[j])
        raw = f.read(offsets[j + 1] - offsets[j])
        if not raw.startswith(f"<{tag}>".encode()):
            raise StataError(f"the map does not point to {tag}")
        return raw[len(tag) + 2 : -(len(tag) + 3)]

    name_w, fmt_w, label_w, _, set_w = layout(release)
    types = np.frombuffer(section(2, "variable_types"), o + "u2")
    cut = lambda raw, w: [text(raw[i * w : (i + 1) * w], enc) for i in range(k)]
    names, formats = cut(section(3, "varnames"), name_w), cut(section(5, "formats"), fmt_w)
    sets, labels = cut(section(6, "value_label_names"), name_w), cut(section(7, "variable_labels"), label_w)
    out = Dictionary(release, o, n, [Variable(*v) for v in zip(names, map(int, types), formats, labels, sets, strict=True)], label, stamp)
    out.data_at, out.strls_at, out.labels_at = offsets[9] + 6, offsets[10] + 7, offsets[11]
    raw = section(11, "value_labels")
    at = 0
    while raw[at : at + 5] == b"<lbl>":
        (size,) = struct.unpack_from(o + "I", raw, at + 5)
        name = text(raw[at + 9 : at + 9 + set_w], enc)
        at += 9 + set_w + 3
        out.label_sets[name] = label_table(raw[at : at + size], o, enc)
        at += size + 6
    return out


def cell(d: Dictionary, name: str) -> tuple[Variable, int]:
    """A variable and its place in a record."""
    at = 0
    for v in d.variables:
        if v.name == name:
            return v, at
        at += v.width
    raise StataError(f"unknown column {name}")


def keys_of(rows: np.ndarray, at: int) -> np.ndarray:
    """The references of long strings, as they are in the file."""
    return np.ascontiguousarray(rows[:, at : at + 8]).view("V8").ravel()


def read_strls(f, d: Dictionary, wanted: set[bytes], piece: int = 4 << 20) -> dict[bytes, bytes | None]:
    """The long strings of the wanted references; None for binary ones. The section is read in
    pieces and what is not wanted is passed over. Its numbers are shortened in references: the
    variable's to 2 bytes and the observation's to 6 in release 118, to 3 and 5 in 119.
    """
    short = {117: 4, 118: 2, 119: 3}[d.release]
    fmt = struct.Struct(d.order + ("IQBI" if d.release >= 118 else "IIBI"))
    o_size = 8 if d.release >= 118 else 4
    out: dict[bytes, bytes | None] = {}
    at, buffer, base = d.strls_at, b"", d.strls_at
    while len(out) < len(wanted) and at + 3 + fmt.size <= d.labels_at:
        if at + 3 + fmt.size > base + len(buffer):
            f.seek(at)
            buffer, base = f.read(min(piece, d.labels_at - at)), at
        p = at - base
        if buffer[p : p + 3] != b"GSO":
            break
        raw = buffer[p + 3 : p + 3 + 4 + o_size]
        v, o = raw[:4], raw[4:]
        key = v[:short] + o[: 8 - short] if d.order == "<" else v[4 - short :] + o[o_size - (8 - short) :]
        _, _, kind, size = fmt.unpack_from(buffer, p + 3)
        at += 3 + fmt.size
        if key in wanted:
            p = at - base
            if p + size <= len(buffer):
                body = buffer[p : p + size]
            else:
                f.seek(at)
                body = f.read(size)
            out[key] = body.rstrip(b"\0") if kind == 130 else None
        at += size
    return out


def decode(d: Dictionary, rows: np.ndarray, name: str) -> tuple[np.ndarray | pa.Array, np.ndarray, np.ndarray | None]:
    """Values, validity and missing tags of a numeric variable of byte rows; strings as an Arrow array."""
    v, at = cell(d, name)
    if v.type not in KIND:
        return fixed(rows[:, at : at + v.width], "utf-8" if d.release >= 118 else "cp1252"), np.ones(len(rows), bool), None
    rec = np.ascontiguousarray(rows[:, at : at + v.width]).view(d.order + KIND[v.type]).ravel()
    tagged = d.release >= 113
    if v.type in LIMIT:
        low = LIMIT[v.type][1] if tagged else int(np.iinfo(KIND[v.type]).max)
        bad = rec >= low
        tag = np.where(bad, rec.astype(np.int64) - low, 0)
    else:
        bits = rec.view(d.order + ("u4" if v.type == FLOAT else "u8")).astype(np.uint64)
        base, step, sign = (FLOAT_MISSING, FLOAT_STEP, 31) if v.type == FLOAT else (DOUBLE_MISSING, DOUBLE_STEP, 63)
        nan = np.isnan(rec)
        bad = (bits >= np.uint64(base)) & (bits >> np.uint64(sign) == 0) | nan
        tag = np.where(bad & (bits >= np.uint64(base)), (bits - np.uint64(base)) // np.uint64(step), 0).astype(np.int64)
    tag = np.where((tag >= 0) & (tag <= 26) & tagged, tag, 0)
    return rec.astype(KIND[v.type]), ~bad, TAGS[tag]


# ---- writing --------------------------------------------------------------------------------


def encode(variables: list[Variable], columns: list[pa.Array], first: int = 0, tags: dict[int, pa.Array] | None = None) -> tuple[bytes, bytes]:
    """Little-endian records of a batch, and the long strings they refer to. `tags` says of the nulls
    of a variable, by its place, which of .a to .z they are.

    References count observations from the batch's first, `first`, which is its place in the part;
    moved() adds where the part begins in the file.
    """
    rows = len(columns[0]) if columns else 0
    out = np.zeros(rows, np.dtype([(f"f{i}", "<u8" if v.type == STRL else "<" + KIND[v.type] if v.type in KIND else f"S{v.width}") for i, v in enumerate(variables)]))
    short = 3 if len(variables) > 32767 else 2
    long: list[tuple[int, int, bytes]] = []
    for i, (v, a) in enumerate(zip(variables, columns, strict=True)):
        valid = a.is_valid().to_numpy(zero_copy_only=False)
        if v.type in KIND:
            a = a.cast(pa.int8()) if pa.types.is_boolean(a.type) else a
            x = a.fill_null(0).to_numpy(zero_copy_only=False)
            out[f"f{i}"] = numeric(v, x, valid, tag_numbers(tags[i]) if tags and i in tags else None)
        elif v.type == STRL:
            refs = np.zeros(rows, np.uint64)
            for k, word in enumerate(a.to_pylist()):
                if word:
                    refs[k] = (i + 1) | (first + k + 1) << 8 * short
                    long.append((first + k + 1, i + 1, word.encode("utf-8") + b"\0"))
            out[f"f{i}"] = refs
        else:
            words = [w.encode("utf-8") if w else b"" for w in a.to_pylist()]
            if max(map(len, words), default=0) > v.width:
                raise StataError(f"{v.name}: a text is longer than it was when widths were taken")
            out[f"f{i}"] = words
    return out.tobytes(), b"".join(GSO.pack(b"GSO", v, o, 130, len(raw)) + raw for o, v, raw in sorted(long))


GSO = struct.Struct("<3sIQBI")


def tag_numbers(tags: pa.Array) -> np.ndarray:
    """0 for ".", 1 to 26 for .a to .z."""
    known = pa.array(["." + chr(96 + k) for k in range(27)])
    return pc.fill_null(pc.index_in(tags, value_set=known), 0).to_numpy(zero_copy_only=False)


def numeric(v: Variable, x: np.ndarray, valid: np.ndarray, tag: np.ndarray | None = None) -> np.ndarray:
    """Storage values with the code of "." or of a tag where there is none; what does not fit is an error."""
    tag = np.zeros(len(x), np.int64) if tag is None else tag
    if v.type in LIMIT:
        y = np.where(valid, x, 0).astype(np.int64)
        if len(y) and (y.max() > LIMIT[v.type][0] or y.min() < LEAST[v.type]):
            raise StataError(f"numeric out of range in {v.name}")
        return np.where(valid, y, LIMIT[v.type][1] + tag)
    wide = v.type == DOUBLE
    code, step, bits = (DOUBLE_MISSING, DOUBLE_STEP, "u8") if wide else (FLOAT_MISSING, FLOAT_STEP, "u4")
    missing = (code + step * tag.astype("u8")).astype(bits).view(KIND[v.type])
    with np.errstate(over="ignore"):
        y = np.where(valid, x, 0).astype(KIND[v.type])
    there = valid & ~np.isnan(y)
    if (there & (np.abs(y) >= np.array([code], bits).view(KIND[v.type])[0])).any():
        raise StataError(f"numeric out of range in {v.name}")
    return np.where(there, y, missing)


def moved(raw: bytes, variables: list[Variable], base: int) -> bytes:
    """Records whose references begin `base` observations later."""
    at, width = 0, sum(v.width for v in variables)
    rows = np.frombuffer(raw, np.uint8).reshape(-1, width).copy()
    for v in variables:
        if v.type == STRL:
            refs = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8").ravel()
            refs = np.where(refs > 0, refs + np.uint64(base << (24 if len(variables) > 32767 else 16)), refs)
            rows[:, at : at + 8] = refs.astype("<u8").view(np.uint8).reshape(-1, 8)
        at += v.width
    return rows.tobytes()


def moved_entries(raw: bytes, base: int) -> bytes:
    """Long strings whose observations begin `base` later."""
    out, at = [], 0
    while at < len(raw):
        tag, v, o, kind, size = GSO.unpack_from(raw, at)
        out += [GSO.pack(tag, v, o + base, kind, size), raw[at + GSO.size : at + GSO.size + size]]
        at += GSO.size + size
    return b"".join(out)


def frame(variables: list[Variable], rows: int, label_sets: dict[str, dict[int, str]] | None = None, label: str = "", strl_bytes: int = 0) -> tuple[bytes, bytes, bytes]:
    """What stands before the records of a file of release 118 (119 beyond 32,767 variables), between them
    and the long strings, and at the end. The first part is as long whatever the number of rows."""
    release = 119 if len(variables) > 32767 else 118
    fix = lambda s, w: s.encode("utf-8")[: w - 1].ljust(w, b"\0")
    lab = label.encode("utf-8")[:320]
    head = b"<stata_dta><header><release>%d</release><byteorder>LSF</byteorder><K>" % release
    head += struct.pack("<I" if release == 119 else "<H", len(variables)) + b"</K><N>" + struct.pack("<Q", rows) + b"</N><label>"
    head += struct.pack("<H", len(lab)) + lab + b"</label><timestamp>\0</timestamp></header>"
    sections = [
        (b"variable_types", b"".join(struct.pack("<H", v.type) for v in variables)),
        (b"varnames", b"".join(fix(v.name, 129) for v in variables)),
        (b"sortlist", b"\0" * ((4 if release == 119 else 2) * (len(variables) + 1))),
        (b"formats", b"".join(fix(v.format, 57) for v in variables)),
        (b"value_label_names", b"".join(fix(v.label_set, 129) for v in variables)),
        (b"variable_labels", b"".join(fix(v.label, 321) for v in variables)),
        (b"characteristics", b""),
    ]
    map_at = len(head)
    at = map_at + 5 + 14 * 8 + 6
    offsets, body = [0, map_at], b""
    for tag, content in sections:
        offsets.append(at)
        piece = b"<" + tag + b">" + content + b"</" + tag + b">"
        body += piece
        at += len(piece)
    width = sum(v.width for v in variables)
    tables = b""
    for name, entries in sorted((label_sets or {}).items()):
        words, off, vals = b"", [], []
        for value, word in sorted(entries.items()):
            if not LEAST[LONG] <= value <= LIMIT[LONG][1] + 26:
                raise StataError(f"label value out of range in {name}")
            off.append(len(words))
            vals.append(value)
            words += word.encode("utf-8") + b"\0"
        table = struct.pack(f"<2I{len(off)}I{len(vals)}i", len(off), len(words), *off, *vals) + words
        tables += b"<lbl>" + struct.pack("<I", len(table)) + fix(name, 129) + b"\0\0\0" + table + b"</lbl>"
    tail = b"</strls><value_labels>" + tables + b"</value_labels></stata_dta>"
    offsets += [at, at + 6 + width * rows + 7]
    offsets.append(offsets[-1] + len(b"<strls></strls>") + strl_bytes)
    offsets.append(offsets[-1] + len(b"<value_labels></value_labels>") + len(tables))
    offsets.append(offsets[-1] + len(b"</stata_dta>"))
    return head + b"<map>" + struct.pack("<14Q", *offsets) + b"</map>" + body + b"<data>", b"</data><strls>", tail


# Words that cannot name a variable.
RESERVED = frozenset(
    "aggregate array boolean break byte case catch class colvector complex const continue default delegate delete do double else eltypedef end enum "
    "explicit export external float for friend function global goto if inline int local long null pragma protected quad rowvector short typedef typename "
    "virtual _all _n _skip _b _pi in _pred _coef _rc using _cons _se with strl".split()
)


def stata_names(names: list[str]) -> list[str]:
    """Valid, distinct variable names of at most 32 characters, kept as they are where possible."""
    out: list[str] = []
    for name in names:
        word = name.lower()
        if word in RESERVED or re.fullmatch(r"str\+?\d+", word) or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name, re.A):
            name = re.sub(r"[^A-Za-z0-9_]", "_", name) or "_"
            if name.lower() in RESERVED or re.fullmatch(r"str\d+|\d.*", name.lower()):
                name = "_" + name
        name = name[:32]
        made, k = name, 0
        while made in out:
            made = f"_{k}{name}"[:32]
            k += 1
        out.append(made)
    if len({x.lower() for x in out}) != len(out):
        raise StataError("names differ in case alone")
    return out
