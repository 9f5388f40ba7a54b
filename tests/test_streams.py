import random

from pyspark.sql import functions as F

from veilframe.streaming import operators as O


def run(query_df, name):
    q = query_df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return query_df.sparkSession.sql(f"select * from {name}").collect()


def test_chunks_find_matches_on_borders(spark, tmp_path):
    text = "x" * 1010 + " mail someone@example.com " + "y" * 1500
    rows = [("s", i, text[i * 1020 : i * 1020 + 1020], i == 2) for i in range(3)]
    spark.createDataFrame(rows, "stream_id string, seq bigint, chunk string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id string, seq bigint, chunk string, last boolean").parquet(str(tmp_path / "in"))
    got = run(O.scan_chunks(stream, 1024, 128), "chunks")
    assert [(r.sub_category, r.match_text, r.span_start) for r in got] == [("Email Address", "someone@example.com", 1016)]


def admitted(times, most, window):
    held, out = [], []
    for t in times:
        held = [x for x in held if x > t - window]
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out


def test_admission_stream_and_batch_agree_with_a_loop(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), f"r{i}", t) for i, t in enumerate(sorted(rnd.sample(range(100_000), 300)))]
    df = spark.createDataFrame(rows, "client_id string, id string, at_us bigint")
    want = {}
    for c in "abc":
        mine = [r for r in rows if r[0] == c]
        want |= {r[1]: ok for r, ok in zip(mine, admitted([r[2] for r in mine], 3, 2000))}
    got = {r.id: r.admitted for r in O.sliding_admission_batch(df, 3, 2000).collect()}
    assert got == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    at = {(r.client_id, r.at_us): r.admitted for r in run(O.sliding_admission(stream, 3, 2000), "admission")}
    assert at == {(c, t): want[i] for c, i, t in rows}


def test_repeats_are_stored_once(spark):
    rows = [("h", "1", 0), ("h", "2", 30), ("h", "3", 70), ("h", "4", 129), ("h", "5", 130), ("g", "6", 10)]
    df = spark.createDataFrame(rows, "input_hash string, id string, at_us bigint")
    assert {r.id for r in O.stored_once(df, 60).collect()} == {"1", "3", "5", "6"}


def test_fixed_windows(spark):
    df = spark.createDataFrame([("c", str(i), i * 10) for i in range(10)], "client_id string, id string, at_us bigint")
    assert [r.id for r in O.fixed_window_admission(df, 2, 50).where("admitted").orderBy("at_us").collect()] == ["0", "1", "5", "6"]


def test_audit_chain_breaks_where_a_row_is_changed(spark):
    df = spark.createDataFrame([("p", str(i), i, "scan") for i in range(6)] + [("q", "x", 1, "scan")], "source string, id string, at_us bigint, action string")
    chain = O.audit_chain(df, b"k")
    assert O.broken_links(chain).count() == 0
    forged = chain.withColumn("signature", F.when(F.col("id") == "3", "00").otherwise(F.col("signature")))
    assert [r.id for r in O.broken_links(forged).collect()] == ["4"]


def test_windowed_counts_stream(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,i) as ts, 'click' as event_type, 1.0d as value from range(5) t(i)")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run(O.windowed_counts(stream), "windows")
    assert [r.n for r in sorted(got, key=lambda r: r.w.start)][:3] == [1, 1, 1]
