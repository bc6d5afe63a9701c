import hashlib
import os

from pyspark.sql import functions as F

from tapeloom.functions import identity
from tapeloom.sources import fingerprints

SAMPLE = 65536


def test_fingerprints_by_ranges_equal_the_column_form(spark, tmp_path):
    sizes = [0, 1, 10, SAMPLE - 1, SAMPLE, SAMPLE + 1, SAMPLE + 7, 3 * SAMPLE + 5, 20 * SAMPLE + 3]
    for n in sizes:
        (tmp_path / f"f {n}.bin").write_bytes(os.urandom(n))
    # Plain paths and URIs; an input column named like a result is replaced.
    files = spark.createDataFrame([((tmp_path / f"f {n}.bin").as_uri() if n % 2 else str(tmp_path / f"f {n}.bin"), "x") for n in sizes], "path string, Size string")
    got = fingerprints.sampled_files(files)
    kept = {os.path.basename(r.path).replace("%20", " "): r for r in got.collect()}
    column = {}
    for n in sizes:
        path = tmp_path / f"f {n}.bin"
        d = spark.createDataFrame([(bytearray(path.read_bytes()), n, path.stat().st_mtime_ns)], "c binary, n long, m long")
        column[path.name] = d.select(identity.sampled_fingerprint(F.col("c"), F.col("n"), F.col("m"))).first()[0]
    assert {k: r.fingerprint for k, r in kept.items()} == column
    assert all(r.problem is None and r.bytes_read <= 9 * SAMPLE and r.samples <= 9 for r in kept.values())
    whole = fingerprints.digested_files(files.select("path")).collect()
    assert {r.content_sha256 for r in whole} == {hashlib.sha256((tmp_path / f"f {n}.bin").read_bytes()).hexdigest() for n in sizes}


def test_a_file_beyond_any_column_is_fingerprinted_by_nine_samples(spark, tmp_path):
    path = tmp_path / "large"
    with path.open("wb") as f:
        f.truncate(6 * 1024**3)  # without blocks on the disk
        f.seek(5 * 1024**3)
        f.write(b"x")
    d = spark.createDataFrame([(str(path), 5), (str(tmp_path / "none"), 5), (None, 5), (str(tmp_path), 5)], "path string, at long")
    rows = {r.path: r for r in fingerprints.sampled_files(d, modified="at").collect()}
    got = rows[str(path)]
    assert (got.size, got.samples, got.bytes_read, got.problem) == (6 * 1024**3, 9, 9 * SAMPLE, None)
    last = got.size - SAMPLE
    want = hashlib.sha256(f"{got.size}:5".encode())
    for i in range(9):
        want.update(f"{last * i // 8}:".encode() + bytes(SAMPLE))
    assert got.fingerprint == want.hexdigest()
    assert all(r.fingerprint is None and r.problem for p, r in rows.items() if p != str(path))
    refused = {r.path: r.problem for r in fingerprints.digested_files(d).collect()}
    assert refused[str(path)] == fingerprints.TOO_LARGE and refused[str(tmp_path)] == "not a file"
