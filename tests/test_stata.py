"""Stata files of every release whose bytes are laid down here, against rows written by hand, and files of pandas."""

import datetime
import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.formats import stata as S
from tabulith.sources import dta, scan

D = datetime.date
#: name, kind, display format, label set
VARIABLES = [("b", "byte", "%8.0g", "set"), ("i", "int", "%8.0g", ""), ("l", "long", "%12.0g", ""), ("f", "float", "%9.0g", ""), ("d", "double", "%10.0g", ""), ("s", "str5", "%5s", ""), ("day", "long", "%td", "")]
WIDTH = {"byte": "b", "int": "h", "long": "i", "float": "I", "double": "Q"}
DOT = {"byte": 101, "int": 32741, "long": 2147483621, "float": 0x7F000000, "double": 0x7FE0000000000000}
STEP = {"byte": 1, "int": 1, "long": 1, "float": 0x800, "double": 0x10000000000}
OLD_DOT = {**DOT, "byte": 127, "int": 32767, "long": 2147483647}


def number(kind, x, order, tagged):
    if x is None or isinstance(x, str):
        x = (DOT if tagged else OLD_DOT)[kind] + STEP[kind] * (ord(x[1]) - 96 if x else 0)
        return struct.pack(order + WIDTH[kind], x)
    return struct.pack(order + {"float": "f", "double": "d"}.get(kind, WIDTH[kind]), x)


def records(rows, order, release):
    out = b""
    for row in rows:
        for (_, kind, _, _), x in zip(VARIABLES, row):
            out += x.encode("cp1252" if release < 118 else "utf-8").ljust(int(kind[3:]), b"\0") if kind.startswith("str") else number(kind, x, order, release >= 113)
    return out


def table(order, words):
    text, off = b"", []
    for _, w in words:
        off.append(len(text))
        text += w + b"\0"
    return struct.pack(f"{order}2I{len(words)}I{len(words)}i", len(words), len(text), *off, *(k for k, _ in words)) + text


def old_file(release, order, rows):
    k = len(VARIABLES)
    name, fmt = (9 if release < 110 else 33), (7 if release < 105 else 12 if release < 114 else 49)
    label = 32 if release < 108 else 81
    early = {"byte": b"b", "int": b"i", "long": b"l", "float": b"f", "double": b"d"}
    late = {"byte": 251, "int": 252, "long": 253, "float": 254, "double": 255}
    out = bytes([release, 1 if order == ">" else 2, 1, 0]) + struct.pack(order + "H", k) + struct.pack(order + ("H" if release == 102 else "I"), len(rows))
    out += b"a label".ljust(label, b"\0") + (b"01 Jan 2000 10:00".ljust(18, b"\0") if release >= 105 else b"")
    for _, kind, _, _ in VARIABLES:
        if kind.startswith("str"):
            out += bytes([int(kind[3:]) + (0 if release >= 111 else 127)])
        else:
            out += bytes([late[kind]]) if release >= 111 else early[kind]
    out += b"".join(v[0].encode().ljust(name, b"\0") for v in VARIABLES) + b"\0" * 2 * (k + 1)
    out += b"".join(v[2].encode().ljust(fmt, b"\0") for v in VARIABLES) + b"".join(v[3].encode().ljust(name, b"\0") for v in VARIABLES)
    out += b"".join(f"about {v[0]}".encode().ljust(label, b"\0") for v in VARIABLES)
    if release >= 105:
        size = order + ("H" if release < 110 else "I")
        out += b"\1" + struct.pack(size, 5) + b"hello" + b"\0" + struct.pack(size, 0)
    out += records(rows, order, release)
    if release < 105:
        return out + struct.pack(order + "H", 24) + b"set".ljust(12, b"\0") + b"\0\0" + b"".join(w.ljust(8, b"\0") for w in (b"", b"one", b""))
    made = table(order, [(1, "é".encode("cp1252") + b"n"), (2147483622, b"away")])
    return out + struct.pack(order + "I", len(made)) + b"set".ljust(33, b"\0") + b"\0" * 3 + made


def new_file(release, order, rows, strls=b"", types=None, raw=None):
    """Releases 117 to 119 with a map that is right."""
    variables = types or [(n, {"byte": 65530, "int": 65529, "long": 65528, "float": 65527, "double": 65526}.get(k) or int(k[3:]), f, s) for n, k, f, s in VARIABLES]
    wide = release >= 118
    name, fmt, label = (129, 57, 321) if wide else (33, 49, 81)
    pack = lambda f, *x: struct.pack(order + f, *x)
    head = b"<stata_dta><header><release>%d</release><byteorder>%s</byteorder><K>" % (release, b"LSF" if order == "<" else b"MSF")
    head += pack("I" if release == 119 else "H", len(variables)) + b"</K><N>" + pack("Q" if wide else "I", len(rows)) + b"</N><label>"
    head += pack("H" if wide else "B", 7) + b"a label" + b"</label><timestamp>" + bytes([17]) + b"01 Jan 2000 10:00</timestamp></header>"
    made = table(order, [(1, ("é" if wide else "é").encode("utf-8" if wide else "cp1252") + b"n"), (2147483622, b"away")])
    sections = [
        ("variable_types", b"".join(pack("H", v[1]) for v in variables)), ("varnames", b"".join(v[0].encode().ljust(name, b"\0") for v in variables)),
        ("sortlist", b"\0" * (4 if release == 119 else 2) * (len(variables) + 1)), ("formats", b"".join(v[2].encode().ljust(fmt, b"\0") for v in variables)),
        ("value_label_names", b"".join(v[3].encode().ljust(name, b"\0") for v in variables)), ("variable_labels", b"".join(f"about {v[0]}".encode().ljust(label, b"\0") for v in variables)),
        ("characteristics", b""), ("data", records(rows, order, release) if raw is None else raw), ("strls", strls),
        ("value_labels", b"<lbl>" + pack("I", len(made)) + b"set".ljust(name, b"\0") + b"\0" * 3 + made + b"</lbl>"),
    ]
    at, offsets, body = len(head) + 5 + 112 + 6, [0, len(head)], b""
    for tag, content in sections:
        offsets.append(at + len(body))
        body += f"<{tag}>".encode() + content + f"</{tag}>".encode()
    offsets += [at + len(body), at + len(body) + 12]
    return head + b"<map>" + pack("14Q", *offsets) + b"</map>" + body + b"</stata_dta>"


def rows_of(release):
    rows = [(1, 32740, 2147483620, 1.5, 8.5e307, "é" if release < 118 else "éa", 0), (-127, -32767, -2147483647, -0.25, -1e-300, "abcde", 3653)]
    return [*rows, (".a", ".b", ".c", ".d", ".z", "  x", 59), ("", "", "", "", "", "", "")] if release >= 113 else [*rows, (126, 32766, 2147483646, 2.0, 3.0, "y", 59), ("", "", "", "", "", "", "")]


OLD = [(r, o) for r in (102, 103, 104, 105, 108, 110, 111, 113, 114, 115) for o in "<>"]
NEW = [(r, o) for r in (117, 118, 119) for o in "<>"]


@pytest.mark.parametrize("release, order", OLD + NEW)
def test_releases(spark, tmp_path, release, order):
    path, rows = f"{tmp_path}/t.dta", rows_of(release)
    open(path, "wb").write(old_file(release, order, rows) if release < 117 else new_file(release, order, rows))
    got = [tuple(r) for r in scan.scan(spark, path, indicators="_n", partitions=3).collect()]
    days = [D(1960, 1, 1), D(1970, 1, 1), D(1960, 2, 29), None]
    for k, (row, day) in enumerate(zip(rows, days)):
        values, tags = got[k][0:10:2], got[k][1:10:2]
        for x, value, tag in zip(row, values, tags):
            assert (value, tag) == ((None, {".a": "away"}.get(x, x) if row[0] == ".a" and x == row[0] else x or None) if isinstance(x, str) else (x, None))
        assert got[k][10] == (row[5] or None) and got[k][11] == day
    meta = json.loads(scan.metadata_json(path))
    assert (meta["version"], meta["row_count"], meta["data_label"], meta["timestamp"]) == (release, 4, "a label", "01 Jan 2000 10:00" if release >= 105 else None)
    assert [v["label"] for v in meta["variables"]] == ["about " + v[0] for v in VARIABLES]
    assert meta["variables"][0]["value_labels"] == ({"1": "one"} if release < 105 else {"1": "én", "MISSING_a": "away"})
    said = [r.b for r in scan.scan(spark, path, columns=["b"], labels=True).collect()]
    assert said[:2] == ["one" if release < 105 else "én", "-127"] and said[3] is None


def gso(release, order, v, o, text, kind=130):
    raw = text if isinstance(text, bytes) else text.encode() + b"\0"
    return b"GSO" + struct.pack(order + ("IQBI" if release >= 118 else "IIBI"), v, o, kind, len(raw)) + raw


def reference(release, order, v, o):
    if release == 117:
        return struct.pack(order + "II", v, o)
    k = 2 if release == 118 else 3
    side = "little" if order == "<" else "big"
    return v.to_bytes(k, side) + o.to_bytes(8 - k, side)


@pytest.mark.parametrize("release, order", NEW)
def test_long_strings(spark, tmp_path, release, order):
    path = f"{tmp_path}/t.dta"
    big = 70_000 if release == 119 else 300
    strls = gso(release, order, 1, 1, "first " * 900) + gso(release, order, 1, big, "trail  ") + gso(release, order, 2, 4, b"\0\1\2", 129)
    refs = [reference(release, order, *x) for x in ((1, 1), (1, big), (0, 0), (2, 4))]
    open(path, "wb").write(new_file(release, order, refs, strls, [("t", 32768, "%9s", "")], b"".join(refs)))
    assert [r.t for r in scan.scan(spark, path, partitions=2).collect()] == ["first " * 900, "trail  ", None, None]
    assert [r.t for r in scan.scan(spark, path, empty_as_null=False).collect()][2:] == ["", ""]
    open(path, "wb").write(new_file(release, order, refs, strls[:-30], [("t", 32768, "%9s", "")], b"".join([*refs[:3], reference(release, order, 9, 9)])))
    with pytest.raises(Exception, match="not there"):
        scan.scan(spark, path).collect()


@pytest.mark.parametrize("version", [114, 117, 118, 119])
@pytest.mark.parametrize("order", "<>")
def test_files_of_pandas(spark, tmp_path, version, order):
    path = f"{tmp_path}/p.dta"
    df = pd.DataFrame({"n": np.array([1, 2, -5], np.int16), "x": [1.5, np.nan, 1e300], "s": ["a", "é", ""], "day": pd.to_datetime(["1960-01-01", "2000-02-29", "1999-12-31"]), "kind": pd.Categorical(["u", "w", "u"])})
    long = {}
    if version >= 117 and order == "<":  # with ">" pandas writes references that it cannot read itself
        df["words"], long = ["y" * 3000, "", "z" * 2500], {"convert_strl": ["words"]}
    df.to_stata(path, write_index=False, version=version, byteorder=order, convert_dates={"day": "td"}, **long)
    got = scan.scan(spark, path, labels=True).collect()
    assert [r.n for r in got] == [1, 2, -5] and [r.x for r in got] == [1.5, None, 1e300] and [r.s for r in got] == ["a", "é", None]
    assert [r.day for r in got] == [D(1960, 1, 1), D(2000, 2, 29), D(1999, 12, 31)] and [r.kind for r in got] == ["u", "w", "u"]
    if long:
        assert [r.words for r in got] == ["y" * 3000, None, "z" * 2500]


def test_periods(spark, tmp_path):
    path = f"{tmp_path}/t.dta"
    types = [(f"p{u}", 65526, "%t" + u, "") for u in "dwmqhy"] + [("c", 65526, "%tcHH:MM:SS", ""), ("cd", 65526, "%tcCCYY-NN-DD", ""), ("cb", 65529, "%tc", "")]
    rows = [(0, 0, 0, 0, 0, 1960, 0, 0, 5), (-1, 53, 13, -1, 3, 2024, 86_400_001, 86_400_000, 6), (1e12, 1e12, 1e12, 1e12, 1e12, 1e12, -1, -1, 7)]
    raw = b"".join(struct.pack("<8dh", *r) for r in rows)
    open(path, "wb").write(new_file(118, "<", rows, b"", types, raw))
    got = [tuple(r) for r in scan.scan(spark, path).collect()]
    first = D(1960, 1, 1)
    assert got[0][:7] == (first, first, first, first, first, first, 0)
    assert got[1][:7] == (D(1959, 12, 31), D(1961, 1, 8), D(1961, 2, 1), D(1959, 10, 1), D(1961, 7, 1), D(2024, 1, 1), 1000)
    assert got[2][:7] == (None, None, None, None, None, None, 86_399_999_000)
    assert [r[7] for r in got] == [datetime.datetime(1960, 1, 1), datetime.datetime(1960, 1, 2), datetime.datetime(1959, 12, 31, 23, 59, 59, 999000)] and [r[8] for r in got] == [5, 6, 7]
    assert tuple(scan.scan(spark, path, compat=True).collect()[1])[1:3] == (D(1960, 2, 23), D(1960, 1, 14))


def test_write_read(spark, tmp_path):
    path = f"{tmp_path}/t.dta"
    rows = [(1, "a" * 3000, "end ", "plain", True, 1.0, None), (2, "pre\0suf", "x", "é", None, None, 2.5), (3, None, "", "", False, -0.0, 1e307)]
    schema = "k int, words string, blank string, s string, flag boolean, f float, d double"
    df = spark.createDataFrame(rows * 40, schema).withColumn("row", F.monotonically_increasing_id())
    df = df.withMetadata("k", {"label": "from the schema", "value_labels": json.dumps({"1": "one"})})
    kinds = dta.write_dta(df.repartition(5), path, value_labels={"k": {1: "given"}, "flag": {0: "no"}}, variable_labels={"k": "given", "d": "a double"}, order_by=["row"])
    assert [v.type for v in kinds][1:4] == [S.STRL, S.STRL, 5]
    got = scan.scan(spark, path, empty_as_null=False, partitions=4)
    assert got.schema["k"].metadata["label"] == "from the schema" and json.loads(got.schema["k"].metadata["value_labels"]) == {"1": "one"} and got.schema["d"].metadata["label"] == "a double"
    assert [tuple(r)[:7] for r in got.collect()] == [(k, a or "", b or "", c or "", None if x is None else int(x), f, d) for k, a, b, c, x, f, d in rows * 40]
    back = pd.read_stata(path, convert_categoricals=False)
    assert back["words"].tolist() == [r[1] or "" for r in rows * 40] and back["blank"].tolist() == [r[2] for r in rows * 40]


def test_out_of_range(spark, tmp_path):
    for x, kind in ((1e308, "double"), (float("inf"), "double"), (-1e308, "double"), (3e38, "float")):
        with pytest.raises(Exception, match="out of range"):
            dta.write_dta(spark.createDataFrame([(x,)], f"x {kind}"), f"{tmp_path}/t.dta")
    dta.write_dta(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"), f"{tmp_path}/t.dta")
    assert {r.x for r in scan.scan(spark, f"{tmp_path}/t.dta").collect()} == {None, 1.0}
    with pytest.raises(S.StataError, match="label value"):
        dta.write_dta(spark.createDataFrame([(1,)], "x int"), f"{tmp_path}/t.dta", value_labels={"x": {2**31: "big"}})


def test_batches(tmp_path, spark):
    path = f"{tmp_path}/t.dta"
    schema = T.StructType.fromDDL("id bigint, grp string")
    parts = [pa.record_batch({"id": pa.array(a, pa.int64()), "grp": pa.array(b)}) for a, b in (([1, 2, 3], ["a", "bb", "ccc"]), ([4, None, 6], ["d", "ee", None]))]
    want = [(1, "a"), (2, "bb"), (3, "ccc"), (4, "d"), (None, "ee"), (6, None)]
    for rows in (6, None):
        assert dta.write_batches(path, dta.batch_schema(schema, {"grp": 3}), iter(parts), rows) == 6
        assert [tuple(r) for r in scan.scan(spark, path).collect()] == want and len(pd.read_stata(path)) == 6
    for rows in (5, 7):
        with pytest.raises(S.StataError, match="declared|written"):
            dta.write_batches(path, dta.batch_schema(schema, {"grp": 3}), iter(parts), rows)
    with pytest.raises(S.StataError, match="long strings"):
        dta.batch_schema(schema)
    with pytest.raises(S.StataError, match="long strings"):
        dta.write_batches(path, [S.Variable("x", S.STRL)], [])


def test_scan_options(spark, tmp_path):
    path = f"{tmp_path}/t.dta"
    open(path, "wb").write(new_file(118, "<", rows_of(118)))
    whole = scan.scan(spark, path)
    assert whole.where("i > 0 AND s IS NOT NULL").count() == 1 and whole.where("day = DATE'1970-01-01'").collect()[0].b == -127
    made = scan.pruned(spark, path, lambda df: df.where("b > 0 AND 9000000000 > l").groupBy("s").agg(F.max("d").alias("m")))
    assert [tuple(r) for r in made.collect()] == [("éa", 8.5e307)]
    read = made._jdf.queryExecution().executedPlan().toString().split("BatchScan")[1].split("\n")[0]
    assert all(f"{c}#" not in read for c in ("i", "f", "day"))
    some = scan.ReadBuilder(spark, path).columns(["b", "s"]).informative_nulls("merged", ["b"]).offset(1).limit(2).threads(2).batch_rows(1).empty_as_null(False).cast({"s": "string", "none": "int"})
    assert [tuple(r) for r in some.finish().collect()] == [("-127", "abcde"), (".a" if False else "away", "  x")]
    df, took = some.finish_profiled()
    assert df.count() == 2 and took["total_ms"] >= took["read_ms"] > 0
    assert sum(b.num_rows for b in scan.batch_iter(spark, path, columns=["b"], n_rows=3, batch_size=2)) == 3
    assert scan.to_arrow(whole).read_all().num_rows == 4 and scan.to_arrow(whole.limit(0)).read_all().num_rows == 0
    scan.dump_parquet(spark, path, f"{tmp_path}/p", 2, 3)
    assert spark.read.parquet(f"{tmp_path}/p").columns == ["b", "i"] and spark.read.parquet(f"{tmp_path}/p").count() == 3
    assert scan.schema(spark, path).names == [v[0] for v in VARIABLES] and scan.raw_column(path, "i", 1, 1) == ["0180"]
    with pytest.raises(ValueError, match="extension"):
        scan.scan(spark, "x.csv")
    with pytest.raises(Exception, match="is a column of the file"):
        types = [("a", 65530, "", ""), ("a_n", 65530, "", "")]
        open(path, "wb").write(new_file(118, "<", [0], b"", types, b"\1\2"))
        scan.scan(spark, path, indicators="_n")
