"""SAS files of every layout, laid down byte by byte, against rows written by hand."""

import datetime
import io
import itertools
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.formats import sas as S
from tabulith.formats import sas_write as W
from tabulith.sources import sas7bdat, scan

COLUMNS = [("id", 8, True, "", ""), ("short", 3, True, "", "cut"), ("word", 9, False, "$9.", "a word"), ("day", 8, True, "DATE9.", ""), ("at", 8, True, "DATETIME22.3", ""), ("clock", 8, True, "TIME8.", ""), ("pad", 40, False, "", "")]
ROWS = [
    (1.0, 2.0, "ab", 0.0, 0.0, 3600.0, "x" * 40),
    (2.5, W.missing(".A"), "é", 3653.0, 315619200.5, 0.0, ""),
    (W.missing(), W.missing("._"), "", 200000.0, 1.0, W.missing(), "@" * 30),
    (-1e300, W.missing(".Z"), "in\0side", W.missing(), W.missing(".B"), 86399.25, " lead"),
]
DAY, EPOCH = datetime.date, datetime.datetime(1960, 1, 1)
WANT = [
    (1.0, 2.0, "ab", DAY(1960, 1, 1), EPOCH, 3_600_000_000, "x" * 40),
    (2.5, None, "é", DAY(1970, 1, 1), EPOCH + datetime.timedelta(seconds=315619200.5), 0, None),
    (None, None, None, DAY(1960, 1, 3), EPOCH + datetime.timedelta(seconds=1), None, "@" * 30),
    (-1e300, None, "in", None, None, 86_399_250_000, " lead"),
]
TAGS = [(None, None, None), (None, ".A", None), (None, "._", None), (None, ".Z", ".B")]
LAYOUTS = [(wide, order, packed) for wide, order, packed in itertools.product((True, False), "<>", ("", "rle", "rdc"))]


def file_of(rows, y, mix=0):
    columns = [S.Column(n, 0, w, num, f, lab) for n, w, num, f, lab in COLUMNS]
    size = W.place(columns)
    raw = np.zeros((len(rows), size), np.uint8)
    for c, values in zip(columns, zip(*rows)):
        at = slice(c.offset, c.offset + c.length)
        if c.numeric:
            raw[:, at] = W.number_bytes(np.array(values, float), c.length, y.order)
        else:
            raw[:, at] = np.array([v.encode().ljust(c.length) for v in values], f"S{c.length}").view(np.uint8).reshape(-1, c.length)
    pages = b"".join(W.record_pages(raw[mix:], y)) if len(raw) > mix else b""
    head, after = W.file_head(columns, len(rows), size, len(pages) // y.page, y, mixed=raw[:mix].tobytes())
    return head + pages + after


@pytest.mark.parametrize("wide, order, packed", LAYOUTS)
def test_layouts(spark, tmp_path, wide, order, packed):
    path = f"{tmp_path}/t.sas7bdat"
    y = W.Layout(wide, order, packed, page=4096, aligned=wide, late_formats=order == ">")
    open(path, "wb").write(file_of(ROWS * 50, y))
    df = scan.scan(spark, path, partitions=3)
    assert [tuple(r) for r in df.collect()] == WANT * 50
    assert df.schema["word"].metadata == {"label": "a word", "format": "$9."}
    assert [r.id for r in scan.scan(spark, path, columns=["id"], offset=5, limit=9, partitions=2).collect()] == [w[0] for w in WANT * 4][5:14]
    got = json.loads(scan.metadata_json(path))
    assert (got["row_count"], got["column_count"], got["compression"], got["file_encoding"], got["creator_proc"]) == (200, 7, {"": "None", "rle": "Rle", "rdc": "Rdc"}[packed], "UTF-8", None if packed == "rdc" else "DATASTEP")


@pytest.mark.parametrize("wide, release, aligned", list(itertools.product((True, False), ("9.0401M6", "9.0000M0"), (True, False))))
def test_mixed_page(spark, tmp_path, wide, release, aligned):
    """Without padding the first bytes tell, so they must not be zero."""
    path = f"{tmp_path}/t.sas7bdat"
    first = (0.1, *ROWS[0][1:])
    for mix in (4, 3):
        open(path, "wb").write(file_of([first, *ROWS[1:]], W.Layout(wide, page=4096, release=release, aligned=aligned), mix))
        assert [tuple(r) for r in scan.scan(spark, path).collect()] == [(0.1, *WANT[0][1:]), *WANT[1:]]


def test_indicators(spark, tmp_path):
    path = f"{tmp_path}/t.sas7bdat"
    open(path, "wb").write(file_of(ROWS, W.Layout(page=4096)))
    got = scan.scan(spark, path, indicators="_null").select("id_null", "short_null", "at_null").collect()
    assert [tuple(r) for r in got] == TAGS
    some = scan.scan(spark, path, columns=["id", "short", "word"], indicators="_n", indicator_columns=["short", "word"])
    assert some.columns == ["id", "short", "short_n", "word"]
    assert [r.short for r in scan.scan(spark, path, columns=["short"], indicators="_n", indicator_mode="merged").collect()] == ["2.0", ".A", "._", ".Z"]
    assert [tuple(r.short) for r in scan.scan(spark, path, columns=["short"], indicators="_n", indicator_mode="struct").collect()] == [(2.0, None), (None, ".A"), (None, "._"), (None, ".Z")]


def test_both_tag_schemes():
    bits = np.array([0xFFFF << 48 | b << 40 for b in (0xFE, 0xFD, 0xE4, 0xFF, 0xBE, 0xA5, 0xD1, 0xD2, 0xA0)], np.uint64)
    assert S.tags(bits, np.zeros(9, bool)).tolist() == [None, ".A", ".Z", "._", ".A", ".Z", None, "._", "._"]


@pytest.mark.parametrize("order", "<>")
def test_short_numbers(order):
    raw = struct.pack(order + "2d", 1.0, 2.0)
    for length in range(3, 9):
        rows = np.stack([np.frombuffer(raw[k : k + 8], np.uint8)[8 - length :] if order == "<" else np.frombuffer(raw[k : k + 8], np.uint8)[:length] for k in (0, 8)])
        x, ok, _ = S.numbers(rows, S.Column("x", 0, length, True), order)
        assert x.tolist() == [1.0, 2.0] and ok.all()
    assert not S.numbers(np.zeros((1, 4), np.uint8), S.Column("x", 2, 4, True), order)[1].any()


def test_run_length_commands():
    for raw, want in (
        (b"\x82abc\xf0", b"abc\0\0"), (b"\x00\x01" + b"q" * 65, b"q" * 65), (b"\x20" + b"r" * 96, b"r" * 96), (b"\x40\x01z", b"z" * 19), (b"\x50\x00", b"@" * 17),
        (b"\x61\x02", b" " * 275), (b"\x70\x00", b"\0" * 17), (b"\x91" + b"s" * 18, b"s" * 18), (b"\xa0" + b"t" * 33, b"t" * 33), (b"\xb0" + b"u" * 49, b"u" * 49),
        (b"\xc1v", b"vvvv"), (b"\xd0", b"@@"), (b"\xe2", b"    "), (b"\x10\x00" + b"w" * 4160, b"w" * 4160),
    ):
        assert S.unrle(raw, len(want)) == want
        assert S.unrle(raw, len(want) + 3) == want + b"\0\0\0"
    with pytest.raises(S.SasError):
        S.unrle(b"\x30", 3)


def test_copy_commands():
    assert S.unrdc(b"\x00\x00abc", 3) == b"abc"
    assert S.unrdc(b"\x80\x00\x02x", 5) == b"xxxxx"
    assert S.unrdc(b"\x80\x00\x11\x01y", 36) == b"y" * 36
    assert S.unrdc(b"\x10\x00abc\x40\x00", 7) == b"abcabca"
    assert S.unrdc(b"\x10\x00abc\x20\x00\x02", 21) == b"abc" * 7
    with pytest.raises(S.SasError):
        S.unrdc(b"\x80\x00\x40\x00", 9)


def test_packing_is_lossless():
    rng = np.random.default_rng(3)
    for n in (1, 2, 16, 17, 63, 64, 79, 80, 300, 5000):
        for top in (1, 2, 5, 256):
            raw = rng.integers(0, top, n).astype(np.uint8).tobytes()
            for body in (raw, raw + b" " * 700 + raw[: n // 2], b"\0" * 2500 + raw, raw * 3):
                assert S.unrle(W.rle(body), len(body)) == body
                assert S.unrdc(W.rdc(body), len(body)) == body


def test_errors_and_edges(spark, tmp_path):
    path = f"{tmp_path}/t.sas7bdat"
    open(path, "wb").write(file_of(ROWS, W.Layout(page=4096)))
    with pytest.raises(Exception, match="unknown column"):
        scan.scan(spark, path, columns=["nothing"])
    assert scan.scan(spark, path, limit=0).count() == 0 and scan.scan(spark, path, limit=0).columns == [c[0] for c in COLUMNS]
    assert scan.scan(spark, path, offset=99).count() == 0
    assert scan.scan(spark, path).count() == 4
    assert scan.scan(spark, path, columns=["word"], empty_as_null=False).collect()[2].word == ""
    assert scan.raw_column(path, "short", 0, 2) == ["000040", "beffff"]
    for bad, why in ((b"", "not a SAS"), (b"\1" * 400, "not a SAS")):
        open(path, "wb").write(bad)
        with pytest.raises(Exception, match=why):
            scan.scan(spark, path)
    late = S.Column("x", 0, 8, True)
    head, _ = W.file_head([late], 0, 8, 0, W.Layout(page=4096))
    with pytest.raises(S.SasError, match="row size"):
        S.read_dictionary(io.BytesIO(head[:1024] + b"\0" * 4096))


def test_filters_go_down(spark, tmp_path):
    path = f"{tmp_path}/t.sas7bdat"
    df = spark.range(1000).select(F.col("id").cast("double").alias("id"), F.concat(F.lit("w"), F.col("id") % 7).alias("word"), F.when(F.col("id") % 3 > 0, F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int"))).alias("day"))
    sas7bdat.write_sas7bdat(df, path, W.Layout(page=8192, compression="rle"), order_by=["id"])
    rows = df.collect()
    whole = scan.scan(spark, path)
    for cond in ("id < 10", "word = 'w3' AND id >= 500", "day IS NULL", "day > DATE'2001-06-01'", "word IN ('w1', 'w2') AND NOT (id = 8)", "word LIKE 'w5%'", "990 <= id", "id % 10 = 3 AND id < 55"):
        assert sorted(whole.where(cond).collect(), key=str) == sorted(df.where(cond).collect(), key=str), cond
        made = scan.pruned(spark, path, lambda d: d.where(cond).select("word", "id"))  # noqa: B023
        assert sorted(made.collect()) == sorted(df.where(cond).select("word", "id").collect()), cond
    assert whole.count() == 1000
    for tests, want in (
        ([("id", "<", 7), ("word", "in", ["w1", "w2", None])], [1, 2]), ([("day", "=", datetime.date(2000, 1, 2))], [1]), ([("day", "is null", None), ("id", "<=", 3)], [0, 3]),
        ([("word", "starts with", "w6"), ("id", ">", 990)], [993 + 7 * 0] if 993 % 7 == 6 else [r.id for r in rows if r.id > 990 and r.word == "w6"]),
    ):
        assert sorted(r.id for r in scan.scan(spark, path, filters=tests).collect()) == want
    options = {"path": path, "filters": json.dumps([["id", ">=", 990.0]]), "partitions": "1"}
    reader = sas7bdat.SasSource(options).reader(None)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10  # the reader itself drops the others


def test_numbers_of_pages_and_columns(spark, tmp_path):
    """Dictionaries over several pages: many columns, long labels."""
    path = f"{tmp_path}/t.sas7bdat"
    df = spark.range(30).selectExpr("id", *(f"id * {k} AS c{k}" for k in range(600)))
    labels = {f"c{k}": "label " * 20 + str(k) for k in range(600)}
    for y in (W.Layout(page=8192), W.Layout(False, ">", "rdc", page=16384, late_formats=True)):
        sas7bdat.write_sas7bdat(df, path, y, variable_labels=labels, order_by=["id"])
        got = scan.scan(spark, path)
        assert got.columns == df.columns and got.schema["c599"].metadata["label"] == labels["c599"]
        assert [tuple(map(int, r)) for r in got.collect()] == [tuple(r) for r in df.collect()]
