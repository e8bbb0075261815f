"""Text in fixed-width fields as Arrow arrays, a whole column at a time."""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa

#: Windows-1252 with its five undefined bytes as control characters.
WESTERN = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))


def decoded(raw: bytes, encoding: str) -> str:
    if encoding == "cp1252":
        return codecs.charmap_decode(raw, "strict", WESTERN)[0]
    return raw.decode(encoding, "replace")


def as_text(raw: pa.Array, encoding: str, ascii_only: bool = False) -> pa.Array:
    """Binary values as strings; where bytes alone do not do, each distinct value is decoded once."""
    if ascii_only or encoding in ("utf-8", "ascii"):
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            pass
    d = raw.dictionary_encode()
    return pa.array([decoded(x.as_py(), encoding) for x in d.dictionary], pa.string()).take(d.indices)


def fixed(rows: np.ndarray, encoding: str, nul: str = "cut") -> pa.Array:
    """Fields (records x bytes) without blanks and NULs at the end.

    nul: "cut" ends a field at its first NUL and trims after that, "trim_cut" trims first,
    "drop" takes NULs out, "keep" leaves those inside.
    """
    n, width = rows.shape
    if not n or not width:
        return pa.array([""] * n, pa.string())
    place = np.arange(width)
    solid = (rows != 32) & (rows != 0)
    first = None
    if nul in ("cut", "trim_cut") and not rows.all():
        zero = rows == 0
        first = np.where(zero.any(1), zero.argmax(1), width)
        if nul == "cut":
            solid &= place < first[:, None]
    ends = np.where(solid.any(1), width - solid[:, ::-1].argmax(1), 0)
    if first is not None and nul == "trim_cut":
        ends = np.minimum(ends, first)
    keep = place < ends[:, None]
    if nul == "drop":
        keep &= rows != 0
        ends = keep.sum(1)
    flat = np.ascontiguousarray(rows[keep])
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(ends, out=offsets[1:])
    raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return as_text(raw, encoding, not len(flat) or int(flat.max()) < 128)


def blank_as_null(words: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.if_else(pc.equal(words, ""), pa.scalar(None, pa.string()), words)


def plain(x) -> str:
    """The shortest decimal text, never in scientific notation."""
    return str(x) if isinstance(x, (int, np.integer)) else np.format_float_positional(float(x), unique=True, trim="-")


def labelled(values: np.ndarray, valid: np.ndarray, words: dict) -> pa.Array:
    """The label of each number, else its own text: every distinct number is looked up once."""
    keys, back = np.unique(values, return_inverse=True)
    say = pa.array([words.get(k.item(), words.get(int(k)) if np.isfinite(k) and k == int(k) else None) or plain(k) for k in keys], pa.string())
    return say.take(pa.array(back.ravel(), mask=~valid))
