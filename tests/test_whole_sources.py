"""Sources in which an operator once did less than its whole job."""


def test_encoding_after_the_head(spark, tmp_path):
    from sparkfacet.sources import csv

    for k, (last, raw) in enumerate([("ñ €", "ñ €".encode("cp1252")), ("ñ €", "ñ €".encode()), ("ñ\x81", b"\xf1\x81")]):
        (tmp_path / f"{k}.csv").write_bytes(b"a;b\n" + b"x;1\n" * 500 + raw + b";2\n")
        rows = csv.read_csv(spark, f"{tmp_path}/{k}.csv").collect()
        assert len(rows) == 501 and rows[-1].a == last


def test_stream_of_a_folder(spark, tmp_path):
    """events.parquet as a folder of files in mixed order gives what the single file gives, in one part or in many."""
    from pyspark.sql import functions as F
    from sparkfacet.plans import assist, catalog  # noqa: F401
    from sparkfacet.sources.adapters import table
    from sparkfacet.streaming import windows

    sf = "/root/testdata/sf0.001"
    run = catalog.QUERIES["stream_windows"]
    want = sorted(map(tuple, run(spark, sf).collect()))
    events = table(spark, sf, "events")
    events.orderBy(F.xxhash64("event_id")).repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    assert want and sorted(map(tuple, run(spark, str(tmp_path)).collect())) == want
    typed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    parts = windows.run_table(typed, "1 hour", "1 day", f"{tmp_path}/out", chunk=events.count() // 3)
    assert sorted(map(tuple, parts.collect())) == want
