"""Registered queries take whole tables."""

from pyspark.sql import functions as F

from tracewright.plans import catalog


def test_agent_queries_take_all_events(spark, sf_dir):
    e = catalog.read(spark, sf_dir, "events")
    sizes = e.groupBy(F.col("user_id").cast("string").alias("session_key")).agg(F.count("*").alias("n"))
    want = {r.session_key: r.n for r in sizes.collect()}
    assert sum(r.turns for r in catalog.QUERIES["hmm_states"](spark, sf_dir).collect()) == sum(want.values())
    ends = catalog.QUERIES["rolling_changepoints"](spark, sf_dir).groupBy("session_key").agg(F.max("end").alias("n")).collect()
    assert ends and all(r.n == want[r.session_key] for r in ends)
    tested = max(r.sessions for r in catalog.QUERIES["granger_pairs"](spark, sf_dir).collect())
    assert 0 < tested <= sum(n >= 10 for n in want.values())
    entropies = catalog.QUERIES["rolling_tool_entropy"](spark, sf_dir).groupBy("session_key").agg(F.count("*").alias("n")).collect()
    assert {r.session_key: r.n for r in entropies} == want


def test_sequence_queries_take_whole_sessions(spark, sf_dir):
    log = catalog._log(spark, sf_dir)
    sizes = {r.session_key: r["count"] for r in log.groupBy("session_key").count().collect()}
    assert max(sizes.values()) > 12
    assert {r.session_key: len(r.s) for r in catalog._strings(spark, sf_dir).collect()} == sizes
    paths = {}
    for r in sorted(log.collect(), key=lambda r: r.pos):
        paths.setdefault(r.session_key, []).append(r.symbol)

    def holds(path, pattern):
        rest = iter(path)
        return all(x in rest for x in pattern)

    found = catalog.QUERIES["prefixspan_patterns"](spark, sf_dir).collect()
    assert found and all(r.support == sum(holds(p, r.pattern.split(">")) for p in paths.values()) for r in found)
    seen = catalog._times(spark, sf_dir).agg(F.count_if("event").alias("n"), F.max("duration").alias("last")).first()
    assert seen.n == sum("error" in p for p in paths.values()) and seen.last > 12


def test_similar_documents_from_cosine_two_fifths(spark, sf_dir):
    low = catalog.QUERIES["similar_documents"](spark, sf_dir).agg(F.min("cosine")).first()[0]
    assert 0.4 < low < 0.5


def test_no_query_reads_a_part_of_a_table():
    """Neither plans nor SQL cut sessions, dates, values, keys or languages."""
    import inspect

    from tracewright.plans import corpus

    source = inspect.getsource(catalog) + inspect.getsource(corpus)
    for cut in ("pos <= 1", "pos <= 5 ", "lang = 'en'", "2024-01-", "event_id % 10", "o_orderkey % 2", "value > 90"):
        assert cut not in source.replace("pos <= 5) as first_n", "")
