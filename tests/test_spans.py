"""Arrays read by spans and files hashed in pieces, against numpy and hashlib on whole files."""

import hashlib
import io as streams

import numpy as np
import pytest

from evalquarry.sources import io, spans


def tables(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.path.rsplit("/", 1)[1], r.name), {})[r.row] = r.values
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


@pytest.fixture
def files(tmp_path):
    g = np.random.default_rng(5)
    flat, ints = g.normal(size=(1003, 7)), g.integers(-9, 9, (250, 3), dtype=np.int16)
    np.save(tmp_path / "flat.npy", flat.astype("<f4"))
    np.save(tmp_path / "columns.npy", np.asfortranarray(flat))
    np.save(tmp_path / "big endian.npy", ints.astype(">i4"))
    np.save(tmp_path / "vector.npy", np.arange(5.0))
    np.save(tmp_path / "number.npy", np.float64(3.5))
    np.save(tmp_path / "empty.npy", np.zeros((0, 4)))
    np.savez(tmp_path / "stored.npz", a=flat, b=ints, c=np.asfortranarray(ints), truth=ints > 0)
    np.savez_compressed(tmp_path / "packed.npz", a=flat, b=ints)
    return tmp_path


def test_arrays_by_spans_are_numpys(spark, files):
    got = tables(spans.arrays(spark, f"file://{files}/*.np[yz]", span=1000))
    want = {}
    for f in files.iterdir():
        a = np.load(f)
        for name in getattr(a, "files", [None]):
            table = np.atleast_2d(a if name is None else a[name]).astype(float)
            if len(table):
                want[f.name, name] = table.tolist()
    assert got == want
    assert tables(io.read_arrays(spark, f"file://{files}")) == want


def test_files_that_only_spark_reaches(spark, files, monkeypatch):
    (files / "none.jsonl").write_bytes(b"")
    plain = tables(io.read_arrays(spark, f"file://{files}/*.np[yz]")), sorted(io.manifest(spark, f"file://{files}").collect())
    monkeypatch.setattr(spans, "_reached", lambda path: False)
    assert (tables(io.read_arrays(spark, f"file://{files}/*.np[yz]")), sorted(io.manifest(spark, f"file://{files}").collect())) == plain


def test_a_large_array_is_read_by_several_tasks(spark, files):
    read = spans.arrays(spark, f"file://{files}/flat.npy", span=1000)
    from pyspark.sql import functions as F

    assert read.select(F.spark_partition_id()).distinct().count() > 1
    with open(files / "flat.npy", "rb") as f:
        cuts = list(spans.spans_of(f, "flat.npy", 1000))
    assert len(cuts) == 29 and sum(c[-1] for c in cuts) == 1003


@pytest.mark.parametrize("array", [np.zeros((2, 2, 2)), np.zeros((2, 2), dtype=complex), np.array(["a"])])
def test_what_is_no_table_of_numbers_is_an_error(array):
    held = streams.BytesIO()
    np.save(held, array)
    held.seek(0)
    with pytest.raises(ValueError, match="no table of real numbers"):
        list(spans.spans_of(held, "x.npy", 1000))


def test_an_array_cut_short_is_an_error(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((50, 4)))
    (tmp_path / "a.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="ends 8 bytes early"):
        spans.arrays(spark, f"file://{tmp_path}/a.npy").collect()


LOG = '{"a":1}\n\n  \t\n{"text":"Å…\x0b"}\r\n \r\nlast'.encode()


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_a_manifest_in_pieces(spark, tmp_path, piece):
    sub = tmp_path / "a b"
    sub.mkdir()
    (sub / "log.jsonl").write_bytes(LOG)
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "other.bin").write_bytes(bytes(range(256)))
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256, r.records) for r in spans.manifest(spark, f"file://{tmp_path}", piece).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {"log.jsonl": (len(LOG), digest(LOG), 3), "empty.jsonl": (0, digest(b""), 0), "other.bin": (256, digest(bytes(range(256))), None)}
