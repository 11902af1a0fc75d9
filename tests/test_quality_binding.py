"""Invariants of the bound driver data (port of the reference's seed-data checks): every source
table is populated, no orphan foreign keys, every enum value in its domain, payments only for
finalised orders, exactly one reviewed party per rating. The one expected finding is several
ratings per (order, rater): the binding derives one rating per qualifying order line."""

from loomstat.operators import quality as Q


def _by_rule(df):
    return {r["rule"]: r["violations"] for r in df.collect()}


def test_sources_populated(market):
    rows = Q.row_counts(market, {t: 1 for t in Q.SOURCE_TABLES}).collect()
    assert len(rows) == len(Q.SOURCE_TABLES) and all(r["passed"] for r in rows)


def test_no_orphans_enums_or_lifecycle_violations(market):
    assert all(v == 0 for v in _by_rule(Q.referential_integrity(market)).values())
    assert all(v == 0 for v in _by_rule(Q.enum_domains(market)).values())
    assert all(v == 0 for v in _by_rule(Q.lifecycle_invariants(market)).values())
    rc = _by_rule(Q.row_constraints(market))
    assert rc.pop("avaliacoes.unique(pedido_id,avaliador_id)") > 0
    assert all(v == 0 for v in rc.values())


def test_schema_profile_covers_every_column(market):
    prof = Q.column_profile(market, "pedidos").collect()
    assert {r["column_name"] for r in prof} == set(market.pedidos.columns)
    by = {r["column_name"]: r for r in prof}
    assert by["deleted_at"]["null_count"] == market.pedidos.count()


def test_referential_integrity_scans_a_child_once(market):
    """One grouping for all foreign keys instead of joins, and orphans are counted row by row."""
    from pyspark.sql import functions as F

    from loomstat.sources.binding import bind

    m = bind(market.spark, market.sf_dir, market.as_of)
    bad = m.propostas.limit(7).withColumn("oficina_id", F.lit(-99)).withColumn("pedido_id", F.lit(None).cast("long"))
    m.__dict__["propostas"] = m.propostas.unionByName(bad)
    checked = Q.referential_integrity(m)
    assert "LeftAnti" not in checked._jdf.queryExecution().optimizedPlan().toString()
    lost = {k: v for k, v in _by_rule(checked).items() if v}
    assert lost == {"propostas.oficina_id -> oficinas.id": 7}


def test_referential_integrity_shuffles_values_once(market):
    plan = Q.referential_integrity(market)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [parent") == 2  # by value, and the sums of the parents
    assert "Aggregate [fk" not in plan


def test_distinct_counts_of_odd_columns(spark):
    """Extreme, negative, equal and missing values of every counted type; lists and fractions count as text."""
    import datetime as dt
    from decimal import Decimal

    big = 2**63 - 1
    rows = [(big, -1, Decimal("-0.01"), dt.date(1, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), "a", 0.5, ["x"], True, None),
            (-big - 1, -64, Decimal("0.00"), dt.date(9999, 12, 31), dt.datetime(1970, 1, 1), "", 0.25, ["x", "y"], None, None),
            (0, -65, Decimal("99999999999999.99"), None, dt.datetime(1970, 1, 1, 0, 0, 0, 63), None, 0.25, None, False, None),
            (63, 63, Decimal("-99999999999999.99"), dt.date(1, 1, 1), dt.datetime(1970, 1, 1, 0, 0, 0, 64), "A", None, [], True, None),
            (64, 64, None, dt.date(1970, 1, 1), None, "a", None, None, None, None), (64, None, Decimal("0.00"), None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a long, `b.c` int, d decimal(16,2), e date, f timestamp, g string, h double, i array<string>, j boolean, k long")
    want = {i: len({str(r[i]) for r in rows if r[i] is not None}) for i in range(10)}
    want.pop(9)
    for key in (None, "a", "b.c", "g"):
        got = {r["i"]: r["n_distinct"] for r in Q.distinct_counts(df.repartition(5), key).collect()}
        assert got == want, key
    empty = {r["i"]: r["n_distinct"] for r in Q.distinct_counts(df.limit(0), "a").collect()}
    assert all(n == 0 for n in empty.values())


def test_profile_moves_words_and_no_bucket_key(spark, tmp_path):
    """The order key is counted within its buckets; 10,000 neighbouring numbers are some 160 rows a task, not 10,000."""
    from pyspark.sql import functions as F

    from conftest import SF_SMALL
    from loomstat.sources.binding import PublishedMarketplace

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    own = PublishedMarketplace(spark, SF_SMALL, "2001-08-02 00:00:00", str(tmp_path))
    for table in ("pedidos", "propostas", "pagamentos"):
        key = Q.ORDER_KEYS[table]
        alone = Q.distinct_counts(getattr(own, table).select(key), key)
        assert "Exchange hashpartitioning" not in plan(alone)
        assert alone.first()["n_distinct"] == getattr(own, table).select(key).distinct().count()
    near = spark.range(0, 10_000, 1, 2).select("id", F.lit("x").alias("t"))
    assert "bit_or" in plan(Q.distinct_counts(near)) and Q.distinct_counts(near).orderBy("i").first()["n_distinct"] == 10_000
