"""Hash trees and manifests against hashlib."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from airtrace.operators import hashtree, labeling
from airtrace.sources import manifest, records


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def root(hashes, fan):
    while len(hashes) > 1:
        hashes = [sha("".join(hashes[i : i + fan])) for i in range(0, len(hashes), fan)]
    return hashes[0]


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_roots_equal_plain_trees(spark, fan):
    sizes = {"a": 1, "b": 2, "c": 27, "d": 28, None: 5}
    leaves = [(g, i, sha(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(leaves)
    df = spark.createDataFrame(leaves, "g string, at long, hash string").repartition(5)
    got = {r["g"]: (r["n"], r["root"]) for r in hashtree.tree_roots(df.where("g is not null"), ["g"], fan).collect()}
    assert got == {g: (n, root([sha(f"{g}{i}") for i in range(n)], fan)) for g, n in sizes.items() if g}
    one = hashtree.tree_roots(df.where("g = 'd'").select("at", "hash"), [], fan).first()
    assert (one["n"], one["root"]) == got["d"]


def test_folders_and_packs_do_not_depend_on_row_order(spark):
    files = [("x", f"f{i:03d}", f"text {i}" if i % 5 else None) for i in range(300)] + [("y", "only", "one")]
    df = spark.createDataFrame(files, "folder string, file string, content string")
    first = {tuple(r) for r in records.folder_integrity(df, 7).collect()}
    assert first == {tuple(r) for r in records.folder_integrity(df.orderBy(F.rand(3)), 7).collect()}
    changed = records.folder_integrity(df.withColumn("content", F.when(F.col("file") == "f007", "other").otherwise(F.col("content"))), 7).collect()
    assert {r["folder"] for r in changed if tuple(r) not in first} == {"x"}
    queue = spark.range(1, 1001).select(F.col("id").alias("position"), F.concat(F.lit("i"), "id").alias("id"), F.lit(False).alias("is_control"))
    got = labeling.pack_hash(queue, 10).first()
    assert (got["n"], got["pack_sha256"]) == (1000, root([sha(f"{i}:i{i}:false") for i in range(1, 1001)], 10)[:16])


def test_files_are_hashed_by_ranges_and_recorded(spark, tmp_path):
    rng = random.Random(2)
    contents = {"a.bin": rng.randbytes(3_000_000), "b.bin": b"", "c.txt": b"short", "d e.bin": rng.randbytes(1_000_000)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    with open(tmp_path / "huge.bin", "wb") as f:
        f.truncate((2 << 30) + 12345)  # sparse: more than one binary value can hold
    got = {r["file"]: r for r in manifest.file_manifest(spark, str(tmp_path), 1_000_000, 2).where("file <> 'huge.bin'").collect()}
    for name, data in contents.items():
        if not data:  # Spark's reader lists no empty files
            continue
        r = got[name.replace(" ", "%20")] if name.replace(" ", "%20") in got else got[name]
        ranges = [data[i : i + 1_000_000] for i in range(0, max(len(data), 1), 1_000_000)]
        assert (r["sha256"], r["size_bytes"], r["fingerprint"]) == (sha(data), len(data), root([sha(x) for x in ranges], 2))
    huge = manifest.file_ranges(spark, str(tmp_path / "huge.bin"), 1 << 30).orderBy("at").collect()
    assert [(r["offset"], r["length"]) for r in huge] == [(0, 1 << 30), (1 << 30, 1 << 30), (2 << 30, 12345)]
    tail = manifest.hash_ranges(manifest.file_ranges(spark, str(tmp_path / "huge.bin"), 1 << 30).where("at = 2")).first()
    assert tail["hash"] == sha(bytes(12345))
    target = os.path.join(str(tmp_path), "log")
    assert manifest.read_manifest(spark, target).count() == 0
    for i in range(2):
        manifest.append_manifest(spark.createDataFrame([("file", "s", str(i))], "kind string, source string, path string"), target)
    assert sorted(r["path"] for r in manifest.read_manifest(spark, target).collect()) == ["0", "1"]


def test_drift_is_told_without_jobs(spark, tmp_path):
    df = spark.range(1).selectExpr("id as b", "'x' as a")
    meta = spark.createDataFrame([("s", f.name, f.dataType.simpleString()) for f in df.schema.fields], "source string, name string, type string")
    assert manifest.frame_fingerprint(df) == manifest.fingerprints(meta).first()["fingerprint"] == sha("a:string;b:bigint")
    target = str(tmp_path / "m")
    assert manifest.check_drift(df, "s", target) == manifest.check_drift(df.select("a", "b"), "s", target)
    with pytest.raises(manifest.SchemaDriftError):
        manifest.check_drift(df.withColumn("c", F.lit(1)), "s", target)
    manifest.check_drift(df.withColumn("c", F.lit(1)), "s", target, allow_new_schema=True)


def test_content_manifest_equals_hashlib(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = {r["file"]: (r["sha256"], r["size_bytes"]) for r in entry.queries()["content_manifest"](spark, sf).collect()}
    files = [f for f in os.listdir(sf) if f.endswith(".parquet")]
    assert got == {f: (sha(data := open(f"{sf}/{f}", "rb").read()), len(data)) for f in files}


def test_readers_read_files(spark, tmp_path):
    from airtrace.sources import layers

    for name, text in (("RUN-1", '{"event_id": "e1", "basin": "B"}'), ("RUN-2", '{"basin": "C"}'), ("RUN-3", "{broken"), ("RUN-4", "[1]")):
        (tmp_path / "store" / name).mkdir(parents=True)
        (tmp_path / "store" / name / "provenance.json").write_text(text)
    got = {r["bundle_name"]: r["event_id"] for r in records.read_records(spark, str(tmp_path / "store")).collect()}
    assert got == {"RUN-1": "e1", "RUN-2": "RUN-2"}
    (tmp_path / "labels.csv").write_text("id,pass1_morphology,pass2_final\n1,plume_like,real_plume\n2,,\n")
    assert layers.load_labels(spark, str(tmp_path / "labels.csv")).count() == 2
    for bad in ("id,pass1_morphology\n1,plume_like\n", "id,pass1_morphology,pass2_final\n1,smoke,artifact\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError):
            layers.load_labels(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "cal.json").write_text('{"entries": [{"satellite": "A", "sza": 1.0, "vza": 0.0, "c1": 1, "c2": 2, "c3": 3}, {"satellite": "A", "sza": 2.0, "vza": 5.0, "c1": 1, "c2": 2, "c3": 3}]}')
    with pytest.raises(ValueError):
        layers.load_calibration(spark, str(tmp_path / "cal.json"))
