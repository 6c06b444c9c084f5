import pytest

from basalt.plans.queries import ORACLES, QUERIES, token_bucket
from basalt.streaming.pipelines import spend
from conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


def test_entry_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_ingest_lag_leaves_out_what_validation_stops(spark, duck):
    from basalt.operators import admission
    from basalt.plans.queries import INGEST_LAG_SQL, WIDE, _batches, ingest_lag_histogram

    batches = admission.admit(_batches(spark, SF), WIDE).collect()
    bad = [r for r in batches if r.code == "invalid_event"]
    want = sum(len(r.events) for r in batches if r.accepted) + sum(r.event_index for r in bad)
    got = {r["le"]: r["count"] for r in ingest_lag_histogram(spark, SF).collect()}
    assert got == {k: pytest.approx(v, rel=1e-12) for k, v in duck.execute(INGEST_LAG_SQL).fetchall()}
    assert got["_count"] == got["+Inf"] == want and 0 < want < sum(len(r.events) for r in batches)


def test_disorder_is_reported(spark, tmp_path):
    from pyspark.sql import functions as F

    from basalt.sources.codec import delivery, partition_of, publish

    rows = [("a", 0, 1, 5), ("a", 0, 2, 3), ("a", 0, 3, 3), ("a", 0, 4, 9), ("a", 1, 0, 1), ("b", 1, 7, 2), (None, 0, 1, 2), (None, 0, 2, 1)]
    df = spark.createDataFrame(rows, "key string, partition int, offset long, sequence long")
    got = {r.key: tuple(r)[1:] for r in delivery(df).collect()}
    assert got == {"a": (5, 2, 1, 1), "b": (1, 1, 0, 0), None: (2, 1, 1, 0)}
    sent = spark.range(40).select(F.concat(F.lit("agent-"), F.col("id").cast("string")).cast("binary").alias("key"))
    publish(sent, str(tmp_path / "records"))
    back = spark.read.parquet(str(tmp_path / "records")).select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int").alias("file"), partition_of(F.col("key")).alias("partition"))
    assert back.filter("file <> partition").count() == 0 and back.count() == 40


def test_token_bucket_as_brute_force(spark, duck):
    got = {r["request_id"]: r["allowed"] for r in token_bucket(spark, SF).collect()}
    from basalt.plans.workload import RECORDS

    rows = duck.execute(f"WITH r AS ({RECORDS}) SELECT agent_id, n, epoch_us(observed_time) / 1e6 FROM r WHERE copy = 0 ORDER BY 1, 3, 2").fetchall()
    # by its own words: three at first, one more a day, three at most
    own, held = {}, {}
    for agent, n, at in rows:
        tokens, last = held.get(agent, (3.0, at))
        tokens = min(3.0, tokens + (at - last) / 86400)
        own[n] = tokens >= 1
        held[agent] = (tokens - own[n], at)
    assert got == own
    want, state = {}, {}
    for agent, n, at in rows:
        tokens, last = state.get(agent, (3, None))
        tokens, want[n], last = spend(tokens, last, at, 1 / 86400, 3)
        state[agent] = (tokens, last)
    assert got == want
    assert {True, False} <= set(got.values())
