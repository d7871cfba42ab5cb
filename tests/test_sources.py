from fleetloom import session
from fleetloom.functions import durable
from fleetloom.operators import inventory
from fleetloom.sources import files, readers, schemas
from tests.conftest import at, tuples


def test_every_schema_is_proper(spark):
    ddls = {n: v for n, v in vars(schemas).items() if n.isupper() and isinstance(v, str)}
    assert len(ddls) > 35
    for ddl in ddls.values():
        assert spark.createDataFrame([], ddl).columns


def test_read_snapshot_keeps_the_declared_schema(spark, tmp_path, table):
    df = table(schemas.SERVER_STORAGE, [dict(hostname="h", total_size_mb=5)])
    df.drop("logical_name").write.parquet(str(tmp_path / "a"))
    df.write.parquet(str(tmp_path / "b"))
    got = readers.read_snapshot(spark, [str(tmp_path / "a"), str(tmp_path / "b")], schemas.SERVER_STORAGE)
    assert got.columns == df.columns and got.count() == 2


def test_zone_less_files_read_as_timestamps(spark, tmp_path, table):
    df = table(schemas.CPU_RINGBUFFER, [dict(hostname="h", event_time=at("2024-01-01 10:00"))])
    df.withColumn("event_time", df.event_time.cast("timestamp_ntz")).write.parquet(str(tmp_path / "t"))
    got = readers.read_snapshot(spark, str(tmp_path / "t"), schemas.CPU_RINGBUFFER)
    assert tuples(got, "event_time") == [(at("2024-01-01 10:00"),)]


def test_file_listing_feeds_the_backup_choice(spark, tmp_path):
    for name in ("db_1_Full_15.BAK", "db_2_Full_15.BAK", "db_3_Dif_15.BAK"):
        (tmp_path / name).write_bytes(b"x" * 10)
    listing = readers.file_listing(spark, str(tmp_path))
    got = inventory.latest_full_backup(listing)
    assert tuples(got, "filename", "length") == [("db_2_Full_15.BAK", 10)]
    assert got.first()["folder"].endswith(str(tmp_path))


def test_jdbc_source_builds_a_reader():
    assert callable(readers.jdbc_source("jdbc:x", "select 1", "id", (0, 10)))


def test_durable_uses_the_named_folder(spark, tmp_path, short):
    before = spark.conf.get(durable.SETTING, None)
    spark.conf.set(durable.SETTING, str(tmp_path / "shared")) if spark.conf.isModifiable(durable.SETTING) else None
    df = short("a INT", [(1,), (2,)])
    got = durable.durable(df)
    assert tuples(got) == [(1,), (2,)] and got.schema == df.schema
    assert got.inputFiles()[0].startswith(("file:", "/"))
    if before is None and spark.conf.isModifiable(durable.SETTING):
        spark.conf.unset(durable.SETTING)


def test_shuffles_are_sized(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert session.size_shuffles(spark, 1 << 20) == 200
    assert session.size_shuffles(spark, 10 << 40) == 81920
    assert spark.conf.get("spark.sql.shuffle.partitions") == "81920"
    assert session.size_shuffles(spark, 100 << 40) == 819_200
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert files.exists(spark, str(tmp_path / "a")) and not files.exists(spark, str(tmp_path / "b"))
    assert files.folder_names(spark, str(tmp_path)) == ["a"] and files.folder_names(spark, str(tmp_path / "b")) == []
    files.remove(spark, str(tmp_path / "a"))
    assert files.folder_names(spark, str(tmp_path)) == []


def test_file_listing_has_depths_and_folders(spark, tmp_path):
    for name in ("a.bak", "x/b.bak", "x/y/c.bak", "x/y/d.txt", "z w/e.bak"):
        (tmp_path / "top" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "top" / name).write_text("12345")
    got = readers.file_listing(spark, f"{tmp_path}/top/", "*.bak")
    rows = {(r.filename, r.depth, r.isfile, r.folder.split("/top", 1)[1], r.length) for r in got.collect()}
    assert rows == {
        ("a.bak", 1, 1, "", 5), ("b.bak", 2, 1, "/x", 5), ("c.bak", 3, 1, "/x/y", 5), ("e.bak", 2, 1, "/z w", 5),
        ("x", 1, 0, "", None), ("y", 2, 0, "/x", None), ("z w", 1, 0, "", None)}
    assert {r.filename for r in readers.file_listing(spark, f"{tmp_path}/top", "*", max_depth=1).collect()} == {"a.bak", "x", "z w"}
