"""Result files: written whole or not at all, at whatever step the writer is cut off."""

import pytest

from msgrisk import files
from msgrisk.sinks import results
from msgrisk.sources import datasets

ROW = "sheet string, position long, content string, rating double"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, ROW)


def read(spark, folder, model="m"):
    got = datasets.read_model_output(spark, folder, model).orderBy("sheet", "position").collect()
    out = {}
    for r in got:
        out.setdefault(r["sheet"], []).append((r["content"], r["rating"]))
    return out


OLD = [("客 服", 2, 'b "x"\ny', 2.0), ("客 服", 1, "a,", 1.0), ("a_b[1]", 5, "c", None)]
NEW = [("客 服", 1, "new", 5.0), ("other", 1, "o", 4.0)]
OLD_READ = {"客 服": [("a,", 1.0), ('b "x"\ny', 2.0)], "a_b[1]": [("c", None)]}
NEW_READ = {"客 服": [("new", 5.0)], "other": [("o", 4.0)], "a_b[1]": [("c", None)]}


def test_round_trip_replaces_and_keeps(spark, tmp_path):
    folder = str(tmp_path / "out")
    results.write_results(rows_of(spark, OLD), folder, "m")
    assert read(spark, folder) == OLD_READ
    assert (tmp_path / "out" / "dataset-客 服_m_test.csv").is_file()
    results.write_results(rows_of(spark, OLD), folder, "n")
    results.write_results(rows_of(spark, NEW), folder, "m")
    assert read(spark, folder) == NEW_READ and read(spark, folder, "n") == OLD_READ
    (tmp_path / "out" / "dataset-hand_m_test.csv").write_text("content,rating\nh,1\n")
    assert read(spark, folder) == NEW_READ | {"hand": [("h", 1.0)]}
    assert not [n for n in files.names(spark, folder) if n.startswith("_staged")]


def test_large_results_are_folders_of_parts(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [("big", i, f"row {i}", float(i % 5)) for i in range(500, 0, -1)] + [("small", 1, "s", 1.0)]
    results.write_results(rows_of(spark, rows), folder, "m", rows_per_part=100)
    assert len(files.names(spark, f"{folder}/dataset-big_m_test.csv")) >= 4
    got = read(spark, folder)
    assert got["big"] == [(f"row {i}", float(i % 5)) for i in range(1, 501)] and got["small"] == [("s", 1.0)]
    results.write_results(rows_of(spark, [("big", 1, "one", 1.0)]), folder, "m")
    assert read(spark, folder) == {"big": [("one", 1.0)], "small": [("s", 1.0)]}


@pytest.mark.parametrize("step", range(8))
def test_a_writer_cut_off_at_any_step(spark, tmp_path, monkeypatch, step):
    """Whichever change to the file system is the first that does not happen."""
    folder = str(tmp_path / "out")
    results.write_results(rows_of(spark, OLD), folder, "m")
    calls = []

    def lossy(real):
        def call(*args):
            if len(calls) >= step:
                raise OSError("cut off")
            calls.append(args)
            return real(*args)

        return call

    with monkeypatch.context() as lost:
        for name in ("move", "remove", "write_text"):
            lost.setattr(files, name, lossy(getattr(files, name)))
        with pytest.raises(OSError):
            results.write_results(rows_of(spark, NEW), folder, "m")
    seen = read(spark, folder)
    assert seen in (OLD_READ, NEW_READ)
    results.write_results(rows_of(spark, [("last", 1, "l", 3.0)]), folder, "m")
    assert read(spark, folder) == seen | {"last": [("l", 3.0)]}
    assert not [n for n in files.names(spark, folder) if n.startswith("_staged")]


def test_sheets_need_a_name(spark, tmp_path):
    for name in (None, "a/b"):
        with pytest.raises(Exception, match="no name of a sheet"):
            results.write_results(rows_of(spark, [(name, 1, "c", 1.0)]), str(tmp_path / "out"), "m")
