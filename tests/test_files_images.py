"""Sources, sinks and image jobs on files written here."""

import hashlib
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskeel import constants as K
from corpuskeel.operators import images as I
from corpuskeel.operators.checks import ContractViolation
from corpuskeel.plans.pictures import png_bytes
from corpuskeel.sources import archive as Z
from corpuskeel.sources import files as S


def formula(width, height):
    y, x, c = np.mgrid[0:height, 0:width, 0:3]
    return ((17 * x + 29 * y + 53 * c + 3 * x * y) % 256).astype(np.uint8)


def pixel_frame(spark, images):
    rows = [(k, v.shape[1], v.shape[0], bytearray(v.tobytes())) for k, v in images.items()]
    return spark.createDataFrame(rows, "id string, width int, height int, rgb binary")


def test_png_scan_gives_rgb_and_keeps_bad_files(spark, tmp_path):
    image = formula(37, 43)
    (tmp_path / "good.png").write_bytes(png_bytes(image.tobytes(), 37, 43))
    (tmp_path / "bad.png").write_bytes(b"not a picture")
    scan = S.image_scan(spark, str(tmp_path), max_pixels=10_000)
    assert {(r.name, r.status, r.reason) for r in scan.collect()} == {("good.png", K.STATUS_PASS, None), ("bad.png", K.STATUS_REJECT, "source_decode_failure")}
    pixels = I.pixels_of_images(scan.filter(F.col("status") == K.STATUS_PASS), F.col("name"))
    got = pixels.select(I.pixel_digest().alias("d")).first().d
    want = hashlib.sha256(b"b5-rgb8-srgb-v1\0" + (37).to_bytes(4, "big") + (43).to_bytes(4, "big") + image.tobytes()).hexdigest()
    assert got == want


def test_archive_members_problems_and_staging(spark, tmp_path):
    for name, extra in (("a.zip", "../evil.txt"), ("b.zip", None)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("x.txt", b"hello")
            z.writestr("y.txt", b"y" * 3_000_000, zipfile.ZIP_DEFLATED)
            if extra:
                z.writestr(extra, b"no")
                z.writestr("empty.txt", b"")
    raw = bytearray((tmp_path / "b.zip").read_bytes())
    raw[raw.index(b"hello")] ^= 1
    (tmp_path / "b.zip").write_bytes(raw)
    members = Z.archive_members(spark, f"{tmp_path}/*.zip", ranges=3, content=True).cache()
    got = {(r.archive, r.member): r.problem for r in members.collect()}
    assert got == {
        ("a.zip", "x.txt"): None, ("a.zip", "y.txt"): None, ("a.zip", "../evil.txt"): "unsafe_path", ("a.zip", "empty.txt"): "size_out_of_bounds",
        ("b.zip", "x.txt"): "crc_mismatch", ("b.zip", "y.txt"): None,
    }
    digest = hashlib.sha256(b"hello").hexdigest()
    chosen = spark.createDataFrame([("a.zip", "x.txt", digest)], "archive string, member string, sha256 string")
    assert Z.stage_preview(members, chosen).first().n_bytes == 5
    assert Z.stage_members(members, chosen).first().verified
    with pytest.raises(Exception, match="selected member absent"):
        Z.stage_preview(members, spark.createDataFrame([("b.zip", "x.txt", digest)], "archive string, member string, sha256 string")).collect()


def test_pins_write_once_and_readers(spark, tmp_path):
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    (tmp_path / "in" / "b.bin").write_bytes(b"x" * 50)
    pins = [("a.bin", 3, hashlib.sha256(b"abd").hexdigest()), ("b.bin", 50, "0"), ("c.bin", 1, "0")]
    report = S.pinned_files(spark, folder, spark.createDataFrame(pins, "name string, bytes long, sha256 string"), max_bytes=10)
    assert {r.name: r.status for r in report.collect()} == {"a.bin": "digest_mismatch", "b.bin": "too_large", "c.bin": "missing"}
    out = str(tmp_path / "out")
    assert S.write_once(spark.range(3), out) and not S.write_once(spark.range(9), out) and spark.read.parquet(out).count() == 3
    with pytest.raises(ContractViolation):
        S.projected_scan(spark, out, ["nope"])
    with pytest.raises(ContractViolation):
        S.projected_scan(spark, out, ["id"], expected_rows=4)
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": "x"\n')
    with pytest.raises(Exception):
        S.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "inv.csv").write_text("source,id\nx,1\n")
    with pytest.raises(ContractViolation):
        S.read_inventory(spark, str(tmp_path / "inv.csv"), S.RAW_INVENTORY)
    with pytest.raises(ContractViolation):
        S.read_metrics(spark, str(tmp_path / "x.txt"), "a int")


def test_table_digest_sees_values_and_repeats_but_not_order(spark):
    rows = [(i % 7, str(i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, b string")
    one = S.table_digest(df).first().tree_sha256
    assert one == S.table_digest(df.repartition(9).select("b", "a")).first().tree_sha256
    assert one != S.table_digest(df.union(df.limit(1))).first().tree_sha256
    assert one != S.table_digest(df.withColumn("a", F.when(F.col("a") == 3, None).otherwise(F.col("a")))).first().tree_sha256


def test_large_files_are_compared_with_their_pins(spark, tmp_path):
    import zlib

    from corpuskeel.plans import RUNNERS

    folder = tmp_path / "tables"
    (folder / "parts.parquet").mkdir(parents=True)
    names = [f"t{i}.parquet" for i in range(12)] + [f"parts.parquet/part-{i}.parquet" for i in range(2)]
    for i, name in enumerate(names):
        (folder / name).write_bytes(bytes([i]) * ((1 << 20) + i))
    kinds = {1: "size_mismatch", 2: "digest_mismatch", 3: "unpinned"}
    wanted = {n: kinds.get(zlib.crc32(n.encode()) % 6, "ok") for n in names} | {"absent.parquet": "missing"}
    assert set(wanted.values()) == {"ok", "missing", *kinds.values()}
    assert {r.name: r.status for r in RUNNERS["io2_pinned_files"](spark, str(folder)).collect()} == wanted
    digests = {n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in names}
    for loaded in (0, 1 << 30):
        assert {r.name: r.sha256 for r in S.file_digests(spark, str(folder), recursive=True, loaded=loaded).collect()} == digests


def test_bound_tables_refuse_and_scopes_clean_up(spark, tmp_path):
    from corpuskeel.session import cut, scratch_scope

    root = str(tmp_path)
    spark.range(40).repartition(3).write.parquet(f"{root}/t")
    spark.range(5).coalesce(1).write.parquet(f"{root}/t2")
    pins = S.file_digests(spark, root, glob="*.parquet", recursive=True).cache()
    assert pins.count() == 4
    assert S.bound_table(spark, root, "t", pins).count() == 40 and S.bound_table(spark, root, "t2", pins, max_bytes=1 << 20).count() == 5
    for wrong in (pins.limit(0), pins.withColumn("bytes", F.col("bytes") + 1), pins.withColumn("sha256", F.lit("0"))):
        with pytest.raises(ContractViolation, match="input pin mismatch"):
            S.bound_table(spark, root, "t", wrong)
    with pytest.raises(ContractViolation, match="input pin mismatch"):
        S.bound_table(spark, root, "t", pins, max_bytes=1)
    import os

    def gone(path):
        return not os.path.exists(path.removeprefix("file:"))

    with scratch_scope(spark) as outer:
        kept = cut(spark.range(3), "outer")
        with pytest.raises(ZeroDivisionError), scratch_scope(spark) as inner:
            assert cut(spark.range(4), "inner").count() == 4
            raise ZeroDivisionError
        assert len(inner) == 1 and gone(inner[0]) and kept.count() == 3 and not gone(outer[0])
    assert all(gone(path) for path in outer)
    assert cut(spark.range(2), "free").count() == 2


def test_assets_with_spaces_and_in_blocks(spark, tmp_path):
    (tmp_path / "a dir").mkdir()
    bodies = {"a dir/x y.bin": b"x", "z.bin": b"z" * 9_000_000}
    (tmp_path / "empty.bin").write_bytes(b"")
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    wanted = {n: (len(b), hashlib.sha256(b).hexdigest(), hashlib.md5(b).hexdigest()) for n, b in bodies.items()}
    for loaded in (-1, 1 << 30):
        scan = S.asset_scan(spark, str(tmp_path), loaded=loaded)
        got = {r.path.split(f"{tmp_path}/")[-1]: (r.bytes, r.sha256, r.md5) for r in scan.collect()}
        assert got == wanted


def test_small_files_share_tasks(spark, tmp_path):
    """Tasks follow the bytes of small files, not their number; the setting is back afterwards."""
    from corpuskeel.plans import RUNNERS

    pages = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"))
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    for query in ("io13_run_inventory", "io6_asset_pages"):
        out = RUNNERS[query](spark, str(tmp_path))
        assert out.count() == 600 and len(out.inputFiles()) <= 16
    assert spark.conf.get(name) == before


def test_staging_writes_one_file_per_archive(spark, tmp_path):
    """Small archives share partitions, and a staged archive is one file however many tasks there are."""
    for a in range(6):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w") as archive:
            for m in range(20):
                archive.writestr(f"{m}.txt", f"{a}:{m}")
    members = Z.archive_members(spark, f"{tmp_path}/*.zip", ranges=2, content=True)
    assert members.rdd.getNumPartitions() == 2 and members.count() == 120
    staged = Z.stage_members(members, members.select("archive", "member", "sha256").repartition(16))
    assert staged.filter("verified").count() == 120 and len(staged.inputFiles()) == 6


def odd_documents(tmp_path):
    """Tables of one letter, empty, blank, null and plain texts, and DuckDB over them."""
    import duckdb

    db = duckdb.connect()
    texts = ["plain text", "", " \n", None, "Other words", "plain  TEXT", ""] * 20
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [(i, t, "en" if i % 3 else "de", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)])
    db.execute("CREATE TABLE labels AS SELECT doc_id, CAST(doc_id % 4 = 0 AND length(text) > 0 AS INTEGER) AS quality, 0 AS toxic FROM documents WHERE doc_id % 2 = 0")
    db.execute("CREATE TABLE benchmark AS SELECT CAST(range AS BIGINT) AS item_id, 'words ' || (range % 3) AS text FROM range(5)")
    for name in ("documents", "labels", "benchmark"):
        db.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return db


def assert_as_sql(spark, db, tmp_path, name):
    from corpuskeel.plans import ORACLES, RUNNERS

    got = RUNNERS[name](spark, str(tmp_path))
    want = db.execute(ORACLES[name])
    places = [[d[0] for d in want.description].index(c) for c in got.columns]
    rows = sorted(([row[i] for i in places] for row in want.fetchall()), key=str)
    assert rows and sorted(([*row] for row in got.collect()), key=str) == rows


def test_archive_members_of_empty_and_null_documents(spark, tmp_path):
    assert_as_sql(spark, odd_documents(tmp_path), tmp_path, "io8_archive_members")


@pytest.mark.parametrize("name", ["io8_archive_contract", "io12_stage_preview", "io12_stage_members"])
def test_archive_contract_and_staging_of_empty_documents(spark, tmp_path, name):
    db = odd_documents(tmp_path)
    # Staged documents have a text, which may be empty.
    db.execute("UPDATE labels SET quality = CAST(doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 3 < 2) AS INTEGER)")
    db.execute(f"COPY labels TO '{tmp_path}/labels.parquet' (FORMAT parquet)")
    assert_as_sql(spark, db, tmp_path, name)


def test_images_are_listed_folder_by_folder(spark, tmp_path, monkeypatch):
    """No scan lists more files than the limit by much, an empty folder does no harm, and all images are there."""
    listed, scan = [], S.image_scan

    def counted(*args, **options):
        out = scan(*args, **options)
        listed.append(out.count())
        return out

    monkeypatch.setattr(S, "image_scan", counted)
    monkeypatch.setattr(S, "LISTED_FILES", 20)
    db = odd_documents(tmp_path)
    db.execute("DELETE FROM documents WHERE text IS NULL")
    db.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    assert_as_sql(spark, db, tmp_path, "io7_image_scan")
    assert len(listed) == 7 and sum(listed) == 120 and max(listed) < 40
    # A few files in many folders leave some without any.
    monkeypatch.setattr(S, "LISTED_FILES", 1)
    db.execute(f"COPY (SELECT * FROM documents LIMIT 6) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    db.execute("DELETE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents LIMIT 6)")
    assert_as_sql(spark, db, tmp_path, "io7_image_scan")
