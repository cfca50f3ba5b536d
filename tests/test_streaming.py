from tracewright.streaming import live


def run(spark, df, mode="append"):
    name = f"out{abs(hash(df))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def test_windows_equal_batch(spark, sf_dir):
    got = run(spark, live.error_rates(stream(spark, sf_dir)))
    want = {(r.start, r.end): (r.rate, r.events) for r in live.error_rates(spark.read.parquet(f"{sf_dir}/events.parquet")).collect()}
    assert got and all(want[r.start, r.end] == (r.rate, r.events) for r in got)
    sessions = run(spark, live.activity_sessions(stream(spark, sf_dir)))
    total = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert 0 < sum(r.events for r in sessions) <= total


def test_cusum_state(spark, sf_dir):
    got = {r.user_id: r for r in run(spark, live.online_cusum(stream(spark, sf_dir), 0.25, 0.125, 1.5), "update")}
    rows = sorted(spark.read.parquet(f"{sf_dir}/events.parquet").collect(), key=lambda r: (r.user_id, r.ts, r.event_id))
    for user in list(got)[:3]:
        hi = lo = 0.0
        alarms = 0
        for r in rows:
            if r.user_id == user:
                x = float(r.event_type == "error")
                hi, lo = max(0.0, hi + x - 0.375), max(0.0, lo + 0.125 - x)
                if max(hi, lo) > 1.5:
                    alarms, hi, lo = alarms + 1, 0.0, 0.0
        assert (got[user].alarms, round(got[user].s_hi, 9), round(got[user].s_lo, 9)) == (alarms, round(hi, 9), round(lo, 9))


def test_contents_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("x")
    (tmp_path / "b.jsonl").write_text("x")
    (tmp_path / "c.jsonl").write_text("y")
    assert len(run(spark, live.new_contents(spark, str(tmp_path)))) == 2
