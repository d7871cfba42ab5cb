from pyspark.sql import functions as F

from fleetloom.functions import decode, text, times
from tests.conftest import at, tuples


def test_seconds_between_counts_boundaries(short):
    df = short("a TIMESTAMP, b TIMESTAMP", [(at("2024-01-01 00:00:00.900"), at("2024-01-01 00:00:01.100")),
                                            (at("2024-01-01 00:00:00.100"), at("2024-01-01 00:00:00.900"))])
    assert [r[0] for r in df.select(times.seconds_between(F.col("a"), F.col("b"))).collect()] == [1, 0]


def test_nearest_minute_goes_up_at_the_half(short):
    df = short("t TIMESTAMP", [(at("2024-01-01 23:59:29.997"),), (at("2024-01-01 23:59:30.000"),)])
    assert [r[0] for r in df.select(times.nearest_minute(F.col("t"))).collect()] == [
        at("2024-01-01 23:59:00"), at("2024-01-02 00:00:00")]


def test_as_of_default_is_the_clock(spark):
    assert spark.range(1).select(times.as_of_time(None).alias("t")).schema["t"].dataType.simpleString() == "timestamp"


def test_zone_casts_round_trip(short):
    df = short("t TIMESTAMP, n INT", [(at("2024-03-10 02:30:00"), 1)])
    naive = times.without_zones(df)
    assert naive.schema["t"].dataType.simpleString() == "timestamp_ntz"
    assert tuples(times.with_timestamps(naive)) == [(at("2024-03-10 02:30:00"), 1)]


def test_host_and_instance(short):
    df = short("i STRING", [("srv01\\prod",), ("srv02",), (None,)])
    got = df.select(text.host_name(F.col("i")), text.instance_name(F.col("i")))
    assert tuples(got) == [(None, None), ("srv01", "prod"), ("srv02", "Default")]


def test_instance_name_is_cut_on_demand_only(short):
    df = short("i STRING", [("h\\" + "x" * 60,)])
    assert df.select(text.instance_name(F.col("i"))).first()[0] == "x" * 60
    assert df.select(text.instance_name(F.col("i"), length=50)).first()[0] == "x" * 50


def test_file_and_folder(short):
    df = short("p STRING", [("\\\\bk\\db\\f.bak",), ("plain.bak",), ("\\\\bk\\db\\",), (None,)])
    assert tuples(df.select("p", text.folder_name(F.col("p")), text.file_name(F.col("p")))) == [
        (None, None, None),
        ("\\\\bk\\db\\", "\\\\bk\\db", None),
        ("\\\\bk\\db\\f.bak", "\\\\bk\\db", "f.bak"),
        ("plain.bak", "plain.bak", None),
    ]


def test_decode_unknown_and_null(short):
    df = short("c INT", [(1,), (4,), (13,), (None,)])
    assert tuples(df.select("c", decode.decode(F.col("c"), decode.CATALOG_TYPE))) == [
        (None, "Unknown"), (1, "Folder"), (13, "PowerBI Report"), (4, "Unknown")]
    assert tuples(df.select(decode.decode(F.col("c"), decode.ISOLATION_LEVEL, None))) == [
        (None,), (None,), ("ReadUncommitted",), ("Serializable",)]


def test_xml_escape_and_one_line(short):
    df = short("t STRING", [('a<b & "c">\r\n',)])
    assert df.select(text.xml_escape(F.col("t"))).first()[0] == "a&lt;b &amp; &quot;c&quot;&gt;\r\n"
    assert df.select(text.one_line(F.col("t"))).first()[0] == 'a<b & "c">  '
