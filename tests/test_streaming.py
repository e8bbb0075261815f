"""Files that arrive in a folder are read once each, and micro-batches become files."""

from tabulith.sources import dta, scan
from tabulith.streaming import folder


def test_stream(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    (tmp_path / "src").mkdir()

    def put(name, *rows):
        dta.write_dta(spark.createDataFrame([(float(r), f"w{r}") for r in rows], "k double, w string").coalesce(1), f"{src}/{name}.dta")

    def run():
        q = folder.write_folder(folder.stream_folder(spark, src, "dta", columns=["w", "k"]).where("k <> 2"), out, "dta", f"{tmp_path}/state")
        q.awaitTermination()
        return sorted(tuple(r) for r in folder.scan_folder(spark, out, "dta").collect())

    put("b", 1, 2)
    assert run() == [("w1", 1.0)]
    put("a", 3)
    put("c", 4, 5)
    assert run() == [("w1", 1.0), ("w3", 3.0), ("w4", 4.0), ("w5", 5.0)]
    assert run() == [("w1", 1.0), ("w3", 3.0), ("w4", 4.0), ("w5", 5.0)]
    assert folder.scan_folder(spark, src, "dta").count() == 5
