"""SPSS files whose bytes are laid down here, against rows written by hand."""

import struct
import zlib

import pytest

from tabulith.sources import sav, scan

SYSMIS = struct.pack("<Q", 0xFFEFFFFFFFFFFFFF)


def made(order, compression, cells, records):
    """A file with N (discrete missings 7 and 8, range 90..99), S (A8), L (A300, two segments)."""
    p = lambda fmt, *x: struct.pack(order + fmt, *x)
    var = lambda width, label, missing, shown, name: p("6i", 2, width, label, missing, shown, shown) + name.ljust(8)
    more = lambda n: var(-1, 0, 0, 0, b"") * n
    out = b"$FL2" + b"x".ljust(60) + p("5id", 2, 71, compression, 0, len(cells), 100.0) + b" " * 84
    out += var(0, 1, -3, 5 << 16, b"N") + p("i", 5) + b"count\0\0\0" + p("3d", 90.0, 99.0, 7.0)
    out += var(8, 0, 1, 1 << 16, b"S") + b"gone    "
    out += var(255, 0, 0, 1 << 16, b"L") + more(31) + var(48, 0, 0, 1 << 16, b"L0") + more(5)
    out += var(0, 0, 0, 20 << 16, b"D")
    out += p("2i", 3, 2) + p("dB", 1.0, 3) + b"one\0\0\0\0" + p("dB", 7.0, 2) + b"na" + b"\0" * 5 + p("3i", 4, 1, 1)
    for sub, data in ((13, b"N=number\tS=s\tL=longer\tD=day"), (14, b"L=00300\0\t"), (20, b"UTF-8")):
        out += p("4i", 7, sub, 1, len(data)) + data
    return out + p("2i", 999, 0) + records(out_len=len(out) + 8)


ROWS = [(1.0, "ab", "x" * 255 + "y" * 45, 0), (2.5, "gone", "", 1), (7.0, "é", "z", 2), (95.0, "", "q" * 256, None), (None, "b", "w", 3)]
WANT = [(1.0, None, "ab", None, "x" * 255 + "y" * 45, 0), (2.5, None, None, "gone", None, 1), (None, "na", "é", None, "z", 2), (None, "MISSING", None, None, "q" * 256, None), (None, None, "b", None, "w", 3)]


def cells(order):
    out = []
    for n, s, long, day in ROWS:
        num = lambda x: struct.pack(order + "Q", 0xFFEFFFFFFFFFFFFF) if x is None else struct.pack(order + "d", x)
        raw = long.encode().ljust(300)
        body = raw[:255].ljust(256) + raw[255:].ljust(48)
        out.append([num(n), s.encode().ljust(8), *(body[k : k + 8] for k in range(0, 304, 8)), num(None if day is None else 12_219_379_200.0 + 86_400 * day)])
    return out


def codes(order, rows):
    """One code per cell, in groups of eight, literals after each group."""
    flat, out = [c for r in rows for c in r], b""
    for at in range(0, len(flat) + 1, 8):
        group, lits = flat[at : at + 8], b""
        head = bytearray()
        for c in group:
            x = struct.unpack(order + "d", c)[0]
            if c == b" " * 8:
                head.append(254)
            elif c == struct.pack(order + "Q", 0xFFEFFFFFFFFFFFFF):
                head.append(255)
            elif x == x and x in range(-99, 152):
                head.append(int(x) + 100)
            else:
                head.append(253)
                lits += c
        if len(group) < 8:
            head.append(252)
        out += bytes(head).ljust(8, b"\0") + lits
    return out


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("compression", [0, 1, 2])
def test_bytes(spark, tmp_path, order, compression):
    rows = cells(order)

    def records(out_len):
        if compression == 0:
            return b"".join(c for r in rows for c in r)
        raw = codes(order, rows)
        if compression == 1:
            return raw
        cut = [raw[k : k + 100] for k in range(0, len(raw), 100)]  # groups cross the blocks
        packed, entries, at, raw_at = b"", b"", out_len + 24, out_len
        for c in cut:
            z = zlib.compress(c)
            entries += struct.pack(order + "2q2i", raw_at, at, len(c), len(z))
            packed, at, raw_at = packed + z, at + len(z), raw_at + len(c)
        return struct.pack(order + "3q", out_len, at, 24 + len(entries)) + packed + struct.pack(order + "2q2i", -100, 0, 100, len(cut)) + entries

    path = f"{tmp_path}/t.{'zsav' if compression == 2 else 'sav'}"
    with open(path, "wb") as f:
        f.write(made(order, compression, rows, records))
    df = scan.scan(spark, path, indicators="_null", partitions=2, batch_rows=2)
    assert df.columns == ["number", "number_null", "s", "s_null", "longer", "day"]
    got = [(*r[:5], None if r[5] is None else r[5].toordinal() - 719163) for r in df.collect()]
    assert got == WANT
    assert df.schema["number"].metadata["label"] == "count"
    some = scan.scan(spark, path, columns=["day", "number"], labels=True, offset=1, limit=3)
    assert some.columns == ["day", "number"] and [r.number for r in some.collect()] == ["2.5", None, None]
    assert scan.scan(spark, path, limit=0).count() == 0 and scan.scan(spark, path, offset=99).count() == 0
    with pytest.raises(Exception, match="unknown column"):
        scan.scan(spark, path, columns=["absent"]).count()


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "ünï", 1.5, True), (2, None, None, None), (3, "a longer text", -2.0, False)], "id int, a_rather_long_name string, x double, flag boolean")
    sav.write_sav(df, f"{tmp_path}/t.sav", order_by=["id"])
    assert [tuple(r) for r in scan.scan(spark, f"{tmp_path}/t.sav").collect()] == [(1.0, "ünï", 1.5, 1.0), (2.0, None, None, None), (3.0, "a longer text", -2.0, 0.0)]
    with pytest.raises(ValueError, match="255"):
        sav.write_sav(spark.createDataFrame([("x" * 256,)], "s string"), f"{tmp_path}/u.sav")
