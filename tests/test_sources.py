import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import sequence
from larkspan.sources import sinks, tables


def test_arrays_and_their_numbers(spark, tmp_path):
    np.save(tmp_path / "12s.npy", np.arange(6, dtype=np.int16).reshape(2, 3))
    np.save(tmp_path / "3phns.npy", np.array([1.5]))
    got = {r["path"].rsplit("/", 1)[-1]: (r["shape"], r["x"]) for r in tables.read_npy(spark, str(tmp_path)).collect()}
    assert got == {"12s.npy": ([2, 3], [0, 1, 2, 3, 4, 5]), "3phns.npy": ([1], [1.5])}
    assert [r["number"] for r in tables.file_numbers(spark, str(tmp_path)).collect()] == [12]


def test_pickled_arrays_are_refused(spark, tmp_path):
    np.save(tmp_path / "1.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle"):
        tables.read_npy(spark, str(tmp_path)).collect()


def test_manifest_joins_signals_and_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" 1 2.5\n-3\n")
    (tmp_path / "a.phn").write_text("0 5 aa\n5 9 r\n")
    manifest = spark.createDataFrame([(1, "a.txt", "x/a.phn"), (2, "b.txt", "b.phn")], "utt long, signal_path string, label_path string")
    signals = tables.read_text_arrays(spark, str(tmp_path / "a.txt")).withColumnRenamed("x", "s")
    (row,) = tables.with_files(manifest, signals, tables.read_labels(spark, str(tmp_path))).collect()
    assert (row["utt"], row["s"], [tuple(x) for x in row["labels"]]) == (1, [1.0, 2.5, -3.0], [(0, 5, "aa"), (5, 9, "r")])


def test_settings_are_literals_and_references(tmp_path):
    (tmp_path / "c.ini").write_text("[A]\nrate = 16000\nnames = ['aa', 'r']\nrun = __import__('os')\n[B]\ninner = [A]\n")
    got = tables.settings(str(tmp_path / "c.ini"))
    assert got["A"] == {"rate": 16000, "names": ["aa", "r"], "run": "__import__('os')"} and got["B"]["inner"] is got["A"]


def test_a_run_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    for run, n in (("a", 3), ("b", 2), ("a", 1)):
        sinks.write_run(spark.range(n), path, run)
    assert sorted((r["run"], r["id"]) for r in spark.read.parquet(path).collect()) == [("a", 0), ("b", 0), ("b", 1)]


def test_mixture_counts(spark, tmp_path):
    rows = spark.createDataFrame([("x", 0, 3), ("x", 1, 4), ("y", 0, 5)], "label string, comp int, n long")
    sinks.write_mixture_counts(rows, str(tmp_path / "m"))
    assert sorted((r["label"], r["value"]) for r in spark.read.text(str(tmp_path / "m")).collect()) == [("x", "2 7 3 4"), ("y", "1 5 5")]


def test_wav_round_trip(spark, tmp_path):
    s = [0.0, 0.5, -1.0, 2.0]
    raw = spark.createDataFrame([(1, s), (2, None)], "utt long, s array<double>").select("utt", sinks.wav_bytes(F.col("s"), 8000).alias("wav")).orderBy("utt").collect()
    assert raw[1]["wav"] is None
    (tmp_path / "1.wav").write_bytes(bytes(raw[0]["wav"]))
    with wave.open(io.BytesIO(bytes(raw[0]["wav"]))) as w:
        assert (w.getnchannels(), w.getframerate(), w.getnframes()) == (1, 8000, 4)
    assert np.allclose(tables.read_wav(spark, str(tmp_path)).first()["s"], [0, 0.5, -1, 1], atol=1e-4)


def frames(spark, values):
    return spark.createDataFrame([(1, i, "a", float(v)) for i, v in enumerate(values)], "utt long, frame long, phn string, value double")


def test_no_peak_gives_minus_one_and_ties_the_first(spark):
    assert [tuple(r) for r in sequence.largest_peak(frames(spark, [1, 2, 3])).collect()] == [(1, -1, None)]
    assert [tuple(r) for r in sequence.largest_peak(frames(spark, [0, 4, 1, 4, 0])).collect()] == [(1, 1, 4.0)]


def test_registration_keeps_within_the_interval(spark):
    spans = spark.createDataFrame([(1, 1, 3), (1, 2, 2)], "utt long, start long, end long")
    got = sequence.registered(spans, frames(spark, [9, 1, 2, 9]), 4).orderBy("dt").collect()
    assert [(r["dt"], r["value"]) for r in got] == [(0, 1.0), (1, 2.0), (2, 2.0), (3, 2.0)]


def test_smoothing_treats_what_lies_beyond_the_ends_as_nothing(spark):
    got = sequence.smooth(frames(spark, [4, 8]), (0.25, 0.5, 0.25)).orderBy("frame").collect()
    assert [r["smoothed"] for r in got] == [4.0, 5.0]
