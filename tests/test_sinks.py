import numpy as np

from larder.sources import files


def test_vectors_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(20)] + [(99, None)], "id long, v array<double>").repartition(3)
    where = files.write_vectors(df, "id", "v", str(tmp_path / "npy")).collect()
    held = {p.name: np.load(p) for p in (tmp_path / "npy").glob("*.npy")}
    assert sorted(r.id for r in where) == list(range(20)) and all(held[r.file][r.row].tolist() == [float(r.id), 0.5] for r in where)
    assert sum(map(len, held.values())) == 20 and not list((tmp_path / "npy").glob("*.tmp"))
    assert files.write_vectors(df.limit(0), "id", "v", str(tmp_path / "none")).count() == 0
    files.write_text_report({"a": spark.createDataFrame([(1, "x\ty"), (2, None)], "n int, s string")}, str(tmp_path / "report"))
    lines = [line for p in sorted((tmp_path / "report" / "a").glob("*.csv")) for line in p.read_text().splitlines()]
    assert set(lines) == {"n\ts", '1\t"x\ty"', "2\t"}
