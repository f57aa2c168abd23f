import hashlib
import json
import re
import unicodedata

import pytest

from conftest import rows
from ostinato.sources import io


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
    return str(path)


def test_pieces(spark, tmp_path):
    cafe = unicodedata.normalize("NFD", "Café")
    path = put(tmp_path / "m.json", {cafe: {"ps": "3", "composer": "X", "duration": 12.5, "only_end": 7, "YT_chapters": ["a", "b"]},
                                     "b": {"ps": 4, "composer": "Y", "duration": True, "youtube_link": "u"},
                                     "c": {"composer": "Z", "duration": "12.5", "start": "x", "end": 3}})
    got = {r["id"]: r for r in io.read_pieces(spark, path).collect()}
    a, b = got["Café"], got["b"]
    assert (a["ps"], a["duration"], a["only_end"], a["yt_chapters"]) == ("3", 12.5, 7.0, ["a", "b"])
    assert (b["ps"], b["duration"], b["youtube_link"], b["yt_chapters"]) == ("4", None, "u", None)
    assert (got["c"]["composer"], got["c"]["duration"], got["c"]["start"], got["c"]["end"]) == ("Z", None, None, 3.0)
    collide = put(tmp_path / "c.json", {cafe: {"ps": "1"}, "Café": {"ps": "2"}})
    with pytest.raises(ValueError, match="collide"):
        io.read_pieces(spark, collide)
    for bad in ("{}", "[]"):
        with pytest.raises(Exception, match="nonempty"):
            io.read_pieces(spark, put(tmp_path / "e.json", bad)).collect()


def test_split_and_manifest(spark, tmp_path):
    pieces = spark.createDataFrame([("a",), ("b",)], "id string")
    path = put(tmp_path / "s.json", {"seed": 42, "metadata_sha256": "x", "parts": {"train": ["a"], "val": ["b"], "test": []}})
    assert rows(io.read_split(spark, path, pieces), "id") == [("a", "train"), ("b", "val")]
    with pytest.raises(ValueError, match="unknown"):
        io.read_split(spark, path, pieces.filter("id = 'a'"))
    path = put(tmp_path / "f.json", {"split_sha256": "s", "records": [{"id": "a", "label": 3, "status": "included", "cqt_sha256": "c", "rhythm_sha256": "r"}]})
    assert rows(io.read_manifest(spark, path)) == [("s", "a", 3, "included", "c", "r")]


def test_files(spark, tmp_path):
    for name in ("a b+c.bin", "café.bin", "index.npz", "other.txt"):
        put(tmp_path / name, "xyz")
    got = rows(io.scan_files(spark, str(tmp_path), ".bin").select("id", "bytes"), "id")
    assert got == [("a b+c", 3), ("café", 3)]
    assert io.scan_files(spark, str(tmp_path), ".npz").count() == 0
    hashes = {r["sha256"] for r in io.with_sha256(spark, str(tmp_path), ".bin").collect()}
    assert hashes == {hashlib.sha256(b"xyz").hexdigest()}
    with pytest.raises(ValueError, match="large"):
        io.refuse_large(io.scan_files(spark, str(tmp_path), ".bin"), limit=2)
    put(tmp_path / unicodedata.normalize("NFD", "café.bin"), "q")
    with pytest.raises(ValueError, match="collide"):
        io.scan_files(spark, str(tmp_path), ".bin")


def test_frames_and_windows(spark, tmp_path):
    good = spark.createDataFrame([("a", 0, [1.0, 2.0])], "id string, frame long, values array<float>")
    io.write_new(good, str(tmp_path / "f"))
    assert io.read_frames(spark, str(tmp_path / "f"), 2).count() == 1
    with pytest.raises(Exception, match="bad frame of a"):
        io.read_frames(spark, str(tmp_path / "f"), 3).collect()
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_new(good, str(tmp_path / "f"))
    io.write_new(spark.createDataFrame([("a", 0, [float("nan"), 2.0])], good.schema), str(tmp_path / "g"))
    with pytest.raises(Exception, match="bad frame"):
        io.read_frames(spark, str(tmp_path / "g"), 2).collect()
    w = spark.createDataFrame([("a", 1, [1.0]), ("a", 0, [2.0])], "id string, win long, values array<double>")
    i = spark.createDataFrame([("a", 3, 2)], "id string, y int, length long")
    io.write_windows(w, str(tmp_path / "w"), i, str(tmp_path / "i"))
    windows, index = io.read_windows(spark, str(tmp_path / "w"), str(tmp_path / "i"))
    assert rows(windows, "win") == rows(w, "win") and rows(index) == rows(i)


def test_features(spark, tmp_path):
    df = spark.createDataFrame([("a", 3, [1.0, 2.0])], "id string, grade int, features array<double>")
    io.write_features(df, str(tmp_path / "x"), ["u", "v"], {"metadata_sha256": "m"})
    got, names, provenance = io.read_features(spark, str(tmp_path / "x"))
    assert names == ["u", "v"] and provenance == {"metadata_sha256": "m"}
    assert io.wide_features(got, names).first().asDict() == dict(id="a", grade=3, u=1.0, v=2.0)
    io.write_features(df, str(tmp_path / "y"), ["u"], {})
    with pytest.raises(Exception, match="bad feature row"):
        io.read_features(spark, str(tmp_path / "y"))[0].collect()


def test_runs(spark, tmp_path):
    val = {"n": 3, "kendall_tau_c": .5, "spearman": None, "mae": 1.0, "mse": 2.0, "acc_pm1": .7}
    put(tmp_path / "o/one/artifacts/metrics.json", {"validation": val, "test_evaluated": False})
    put(tmp_path / "o/one/artifacts/config.json", {"model": "M", "split_sha256": "s", "training": {"seed": 7}})
    put(tmp_path / "o/one/artifacts/predictions_val.json", [{"id": "a", "true_grade": 1, "score": 1.5}])
    put(tmp_path / "o/two/metrics.json", {"validation": val, "test_evaluated": True})
    put(tmp_path / "o/three/config.json", {"model": "M"})
    got = {r["run"]: r for r in io.scan_runs(spark, str(tmp_path / "o")).collect()}
    assert set(got) == {"one/artifacts", "two"}
    one, two = got["one/artifacts"], got["two"]
    assert (one["status"], one["model"], one["seed"], one["kendall_tau_c"], one["spearman"], one["n_validation"]) == ("complete", "M", 7, .5, None, 3)
    assert (two["status"], two["model"], two["test_evaluated"], two["split_sha256"]) == ("partial", "unknown", True, None)
    assert rows(io.read_predictions(spark, str(tmp_path / "o"))) == [("artifacts", "val", "a", 1, 1.5)]
    io.write_registry_csv(io.scan_runs(spark, str(tmp_path / "o")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    put(tmp_path / "r1/history.jsonl", "\n".join(json.dumps({"epoch": e, "train_mse": 1.0, "validation": {"kendall_tau_c": t, "mse": 2.0}}) for e, t in ((1, .1), (2, None))))
    assert rows(io.read_history(spark, str(tmp_path / "r1/history.jsonl")), "epoch") == [("r1", 1, 1.0, .1, 2.0), ("r1", 2, 1.0, None, 2.0)]


def test_norm(spark, tmp_path):
    norm = spark.createDataFrame([(c, 0.0, 1.0, 5) for c in range(97)], "channel int, mean double, std double, n_valid long")
    io.save_norm(norm, str(tmp_path / "n"), {"split_sha256": "s", "train_ids_sha256": "t"})
    assert io.load_norm(spark, str(tmp_path / "n"), {"split_sha256": "s"}).count() == 97
    with pytest.raises(ValueError, match="split_sha256"):
        io.load_norm(spark, str(tmp_path / "n"), {"split_sha256": "other"})
    with pytest.raises(ValueError, match="channels"):
        io.load_norm(spark, str(tmp_path / "n"), {}, channels=88)


def test_links_and_large_files_are_refused(spark, tmp_path):
    put(tmp_path / "in/a.bin", "xyz")
    (tmp_path / "in/b.bin").symlink_to(tmp_path / "in/a.bin")
    with pytest.raises(Exception, match="symbolic links"):
        io.scan_files(spark, str(tmp_path / "in"), ".bin").collect()
    assert io.scan_files(spark, str(tmp_path / "in"), ".bin", links=True).count() == 2
    io.write_new(spark.createDataFrame([("a", 0, [1.0])], "id string, frame long, values array<float>"), str(tmp_path / "f"))
    with pytest.raises(Exception, match="unexpectedly large"):
        io.read_frames(spark, str(tmp_path / "f"), 1, limit=10).collect()


def test_run_scan_reads_no_predictions(spark, tmp_path):
    for run in ("one", "two"):
        put(tmp_path / "o" / run / "metrics.json", {"validation": {"n": 3}})
        put(tmp_path / "o" / run / "config.json", {"model": "M"})
    put(tmp_path / "o/one/predictions_val.json", "x" * 1000)
    got = io.scan_runs(spark, str(tmp_path / "o"))
    assert rows(got.select("run", "status"), "run") == [("one", "complete"), ("two", "partial")]
    schemas = sorted(re.findall("ReadSchema: struct<([^>]*)>", got._jdf.queryExecution().executedPlan().toString()))
    assert schemas in (["content:binary,path:string", "path:string"], ["path:string", "path:string,content:binary"])    # the listing that sees the predictions reads no content
    put(tmp_path / "o" / unicodedata.normalize("NFD", "é") / "metrics.json", {"validation": {}})
    put(tmp_path / "o" / "é" / "metrics.json", {"validation": {}})
    with pytest.raises(Exception, match="collide in NFC"):
        io.scan_runs(spark, str(tmp_path / "o")).collect()
    (tmp_path / "p/r").mkdir(parents=True)
    (tmp_path / "p/r/metrics.json").symlink_to(tmp_path / "o/one/metrics.json")
    with pytest.raises(Exception, match="symbolic links"):
        io.scan_runs(spark, str(tmp_path / "p")).collect()


def test_broken_records_become_rows(spark, tmp_path):
    from pyspark.sql import types as T
    path = put(tmp_path / "r.json", '{"id": "a", "x": 1.5}\n{"id": "b", "x": "no"}\nnot json\n{"id": "c"}\n')
    read = io.read_records(spark, path, T.StructType.fromDDL("id string, x double"))
    assert [r["id"] for r in read.filter("error is not null").select("id").collect()] == ["b", None]       # seen without asking for x
    got = rows(read.select("id", "x", "error"))
    assert sorted(got, key=str) == sorted([("a", 1.5, None), ("b", None, '{"id": "b", "x": "no"}'), (None, None, "not json"), ("c", None, None)], key=str)


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    windows = spark.createDataFrame([(i % 7, i // 7, float(i)) for i in range(70)], "id long, win long, x double")
    index = spark.createDataFrame([(i, 10) for i in range(7)], "id long, length long")
    io.write_window_table(windows, "w_test", str(tmp_path), index, buckets=4)
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got, lengths = io.open_window_table(other, "w_test", str(tmp_path), windows.schema, index.schema, buckets=4)
    joined = got.join(lengths, "id").groupBy("id", "length").count()
    assert rows(joined, "id") == [(i, 10, 10) for i in range(7)]
    assert "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString() and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_window_table(windows, "w_test", str(tmp_path), index, buckets=4)
    for name in ("w_test", "w_test_index"):
        spark.sql(f"drop table {name}")


def test_norm_with_nulls(spark, tmp_path):
    norm = spark.createDataFrame([(c, 0.0 if c else None, 1.0, 5) for c in range(97)], "channel int, mean double, std double, n_valid long")
    io.save_norm(norm, str(tmp_path / "n"), {})
    with pytest.raises(ValueError, match="values"):
        io.load_norm(spark, str(tmp_path / "n"), {})
