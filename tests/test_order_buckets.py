"""Tables that belong to an order are derived and joined within the buckets of the order key."""

import pytest

from conftest import SF_SMALL
from loomstat.operators import staging as S
from loomstat.sources.binding import Marketplace, PublishedMarketplace, bind

AS_OF = "2001-08-02 00:00:00"


@pytest.fixture(scope="module")
def m(spark, tmp_path_factory):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    yield PublishedMarketplace(spark, SF_SMALL, AS_OF, str(tmp_path_factory.mktemp("sources")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pedidos", "propostas", "producao", "avaliacoes", "pagamentos"])
def test_no_shuffle_by_order_after_the_buckets(spark, m, name):
    m.by_order("orders"), m.by_order("lineitem")
    assert "Exchange hashpartitioning" not in _plan(Marketplace.__dict__[name].func(m))
    whole = getattr(bind(spark, SF_SMALL, AS_OF), name)
    got = getattr(m, name)
    assert got.schema.simpleString() == whole.schema.simpleString() and got.count() == whole.count() > 0
    assert got.exceptAll(whole).count() == 0


def test_bids_meet_their_orders_without_a_shuffle(m):
    assert "Exchange hashpartitioning" not in _plan(S.stg_propostas(m))


def test_buckets_follow_the_bytes(spark, monkeypatch):
    from loomstat.sources import binding

    for size, buckets in ((0, 1), (1 << 20, 1), (20 << 20, 20), (64 << 20, 32), (330 << 20, 42), (4000 << 20, 500)):
        monkeypatch.setattr(binding, "table_bytes", lambda *_, n=size: n)
        assert PublishedMarketplace(spark, SF_SMALL, AS_OF, "/none").buckets == buckets


def test_orders_meet_their_ratings_and_numbers_in_the_buckets(m, monkeypatch):
    from loomstat.functions import ranks
    from loomstat.operators import intermediate as I

    keys, real = [], ranks.grouped_row_number
    monkeypatch.setattr(ranks, "grouped_row_number", lambda df, *a: keys.append(df) or real(df, *a))
    made = _plan(I.int_match_pairs(m))
    assert "Exchange hashpartitioning" not in _plan(keys[0])  # orders and ratings
    assert "hashpartitioning(pedido_id" not in made  # orders and numbers: the numbers alone move


def test_only_keys_of_orders_visit_brands_and_workshops(spark, m):
    """Payments and bids meet their orders in the buckets, and so does what the keys bring back; wide rows stay there."""
    from loomstat.operators import intermediate as I

    made = I.int_pedidos_enriched(m)
    plan = _plan(made)
    assert not [k for k in ("pedido_id", "_pg_pedido", "_pr_pedido") if f"Exchange hashpartitioning({k}#" in plan]
    assert plan.count("Exchange hashpartitioning(_w_empresa#") == plan.count("Exchange hashpartitioning(_w_pedido#") == 1
    whole = I.int_pedidos_enriched(bind(spark, SF_SMALL, AS_OF))
    assert made.exceptAll(whole).count() == whole.exceptAll(made).count() == 0 < made.count()


def test_lines_meet_parts_once(spark, m):
    """Workshops and certificates read the written types of a supplier; without a broadcast lines move by part once."""
    from pyspark.sql import functions as F

    shops, certs = (Marketplace.__dict__[t].func(m) for t in ("oficinas", "certificacoes"))
    for made in (shops, certs):
        assert "l_partkey" not in _plan(made)
    types = Marketplace.__dict__["_supplier_types"].func(m)
    assert _plan(types).count("Exchange hashpartitioning(l_partkey") == 1
    line, part = m.raw("lineitem"), m.raw("part").select("p_partkey", "p_type")
    both = line.join(part, line.l_partkey == part.p_partkey, "left")
    qty = both.groupBy("l_suppkey").agg(F.round(F.sum("l_quantity") / 80).cast("int").alias("q"), F.array_sort(F.collect_set("p_type")).alias("t"))
    want = m.raw("supplier").join(qty, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "q", "t")
    got = shops.select("id", "capacidade_mensal", "especialidades")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()
    dates = both.where("p_partkey IS NOT NULL").groupBy("l_suppkey", "p_type").agg(F.min("l_shipdate"), F.max("l_shipdate"))
    got = certs.select("oficina_id", F.ltrim("nome"), "created_at", "updated_at")
    assert got.exceptAll(dates).count() == dates.exceptAll(got).count() == 0 < got.count()


def test_parts_unknown_or_without_a_type(spark, tmp_path):
    """A line without its part counts for the quantity only; a part without a type is a certificate without a name."""
    parts = spark.createDataFrame([(1, "X A"), (2, None)], "p_partkey long, p_type string")
    lines = spark.createDataFrame([(1, 1, 9, 1, 100.0), (2, 2, 9, 1, 200.0), (3, 77, 9, 1, 300.0), (4, None, 9, 1, 200.0), (5, 77, 8, 1, 80.0)],
                                  "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double") \
        .selectExpr("*", "1.0D l_extendedprice", "0.0D l_discount", "0.0D l_tax", "'N' l_returnflag", "'O' l_linestatus", "timestamp '1997-01-01' l_shipdate")
    own = PublishedMarketplace(spark, SF_SMALL, AS_OF, str(tmp_path))
    own._raw.update(part=parts, lineitem=lines)
    got = {r["l_suppkey"]: (r["total_qty"], r["types"]) for r in own._supplier_lines.collect()}
    assert got == {9: (800.0, ["X A"]), 8: (80.0, [])}
    assert sorted((r["id"], r["oficina_id"]) for r in own.certificacoes.collect()) == [("9", 9), ("9-X A", 9)]
