"""The SAS program beside a CSV file."""

import datetime

from tabulith.sources import sas_script


def test_program(spark):
    rows = [(1, "it's", datetime.date(1970, 1, 1), datetime.datetime(1970, 1, 1)), (2, None, None, None)]
    df = spark.createDataFrame(rows, "`1 num` int, str string, day date, at timestamp_ntz")
    got = sas_script.sas_csv(df).collect()
    assert [tuple(r) for r in got] == [(1, "it's", 3653, 315619200), (2, None, None, None)]
    text = sas_script.sas_program(df, "/data/x'y.csv", {"str": "it's a text"}, {"1 num": {2: "two", 1: "one"}, "str": {"b": "bee"}}, "mine")
    assert text.split("\n") == [
        "proc format;", "  value _1_num_f 1='one' 2='two';", "  value $str_f 'b'='bee';", "run;", "data mine;",
        "  infile '/data/x''y.csv' dsd firstobs=2 truncover lrecl=1048576;", "  length str $4;", "  format _1_num _1_num_f.;", "  format str $str_f.;", "  label str='it''s a text';",
        "  format day yymmdd10.;", "  format at datetime20.;", "  input _1_num str $ day at;", "run;", "",
    ]
