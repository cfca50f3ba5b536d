"""Fisher's combination over any number of sessions."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.plans import catalog, numeric


def below(k, mean):
    logs = [i * math.log(mean) - math.lgamma(i + 1) - mean for i in range(k)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def test_poisson_sum_is_exact(spark):
    cases = [(k, f * k) for k in (1, 2, 15, 16, 17, 18, 199, 200, 201, 1000, 20_000) for f in (1e-3, 0.5, 0.9, 1.0, 1.02, 1.1, 2.0)] + [(1, 690.0), (900, 1e-300), (30, 3.5), (400, 17.2)]
    rows = spark.createDataFrame(cases, "k bigint, mean double")
    for r in rows.withColumn("p", numeric.poisson_below(F.col("k"), F.col("mean"))).collect():
        assert r.p == pytest.approx(below(r.k, r.mean), rel=1e-9, abs=1e-300), (r.k, r.mean)


def test_fisher_combine_equals_sql_on_large_groups(spark, sf_dir, tmp_path):
    con = duckdb.connect()
    sizes = [(150, 1000), (700, 840), (700, 870), (700, 900), (3000, 925), (3000, 935), (3000, 945), (5000, 940), (5000, 950), (5000, 960)]
    users = " union all ".join(f"select {u} as user_id, {n} as n, {top} as top" for u, (n, top) in enumerate(sizes))
    con.sql(f"""create view events as select i as event_id, timestamp '2024-01-01' as ts, user_id::bigint as user_id, ['a', 'b'][1 + i % 2] as event_type,
        case when i % 97 = 0 then null when i % 89 = 0 then 0.125 + i % 8 else i * 617 % top / 100.0 end::double as value, '' as props from (select *, unnest(range(n)) as i from ({users}))
        union all select 1, timestamp '2024-01-01', 77, 'a', null, ''""")
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = con.sql(catalog.ORACLES["fisher_combine"])
    got = catalog.QUERIES["fisher_combine"](spark, str(tmp_path)).select(want.columns)
    rows = sorted(want.fetchall())
    assert sorted(map(tuple, got.collect())) == rows
    assert sum(0 < r[3] < 1 for r in rows if r[2] > 200) >= 2
