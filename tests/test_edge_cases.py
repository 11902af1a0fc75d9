"""Edge cases the driver data never reaches (FIXTURES.md part D), on a fixture marketplace
built from in-test rows with the bound source-table schemas."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from loomstat.operators import intermediate as I
from loomstat.operators import marts as M
from loomstat.operators import quality as Q
from loomstat.operators import staging as S
from loomstat.sources.binding import SOURCE_TABLES, Marketplace

D = decimal.Decimal
AS_OF = dt.datetime(2001, 8, 2)


@pytest.fixture(scope="module")
def make_market(spark, market):
    from pyspark.sql import types as T

    schemas = {t: T.StructType([T.StructField(f.name, f.dataType, True) for f in getattr(market, t).schema.fields])
               for t in SOURCE_TABLES}

    def build(**tables):
        m = Marketplace(spark, "/nonexistent", str(AS_OF))
        for t in SOURCE_TABLES:
            rows = tables.get(t, [])
            names = [f.name for f in schemas[t].fields]
            full = [tuple(r.get(n) for n in names) for r in rows]
            m.__dict__[t] = spark.createDataFrame(full, schemas[t])
        return m

    return build


def brand(i, **kw):
    base = dict(id=i, nome_fantasia=f"B{i}", cnpj=str(i), email=f" B{i}@X.COM ", telefone="(47) 9999-0000",
                estado=" sc ", cidade=" Blumenau ", porte="micro", segmento="moda", ativo=True, verificado=True,
                created_at=dt.datetime(2001, 1, 10))
    base.update(kw)
    return base


def order(i, **kw):
    base = dict(id=i, codigo=f"C{i}", empresa_id=1, titulo=" t ", quantidade_total=10, status="publicado",
                created_at=dt.datetime(2001, 3, 1), updated_at=dt.datetime(2001, 3, 1))
    base.update(kw)
    return base


def test_orders_null_and_zero_paths(make_market):
    m = make_market(empresas=[brand(1)], pedidos=[
        order(1, valor_estimado=None, valor_final=D("100.00"), quantidade_total=10),
        order(2, valor_estimado=D("0.00"), valor_final=None, quantidade_total=0, status="disputa"),
        order(3, valor_estimado=D("200.00"), valor_final=None, quantidade_total=4, status="rascunho",
              prazo_entrega=dt.date(2001, 5, 1), data_entrega_real=dt.date(2001, 5, 3)),
        order(4, valor_estimado=D("80.00"), valor_final=D("100.00"), status="algo_novo",
              prazo_entrega=dt.date(2001, 5, 1), data_entrega_real=dt.date(2001, 4, 30)),
        order(5, deleted_at=dt.datetime(2001, 4, 1)),
    ])
    rows = {r["pedido_id"]: r for r in S.stg_pedidos(m).collect()}
    assert set(rows) == {1, 2, 3, 4}  # soft-deleted order filtered
    assert rows[1]["pct_variacao_valor"] is None and rows[1]["preco_por_peca"] == 10.0
    assert rows[1]["valor_estimado"] == D("0.00")
    assert rows[2]["pct_variacao_valor"] is None and rows[2]["preco_por_peca"] is None
    assert rows[2]["status_ordem"] == -2 and rows[3]["status_ordem"] == 1 and rows[4]["status_ordem"] == 0
    assert rows[3]["preco_por_peca"] == 50.0  # falls back to the estimate
    assert rows[3]["entregue_no_prazo"] is False and rows[3]["dias_atraso_entrega"] == 2
    assert rows[4]["entregue_no_prazo"] is True and rows[4]["pct_variacao_valor"] == 25.0
    assert rows[1]["entregue_no_prazo"] is None and rows[1]["horas_para_publicar"] is None


def test_brand_cleaning_and_status(make_market):
    m = make_market(empresas=[brand(1), brand(2, ativo=False, verificado=False), brand(3, verificado=False),
                              brand(4, deleted_at=dt.datetime(2001, 2, 1))])
    rows = {r["empresa_id"]: r for r in S.stg_empresas(m).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1]["email"] == "b1@x.com" and rows[1]["telefone_limpo"] == "4799990000" and rows[1]["estado"] == "SC"
    assert rows[2]["status_cadastro"] == "inativo" and rows[3]["status_cadastro"] == "pendente_verificacao"
    assert rows[1]["volume_mensal_pecas"] == 0


def test_rating_sentiment_and_fallbacks(make_market):
    def rating(i, g, **kw):
        r = dict(id=str(i), pedido_id=1, avaliador_id=1, avaliado_oficina_id=7, nota_geral=g, publica=True,
                 created_at=dt.datetime(2001, 3, 2))
        r.update(kw)
        return r

    m = make_market(avaliacoes=[rating(1, 5), rating(2, 4), rating(3, 3), rating(4, 2, nota_qualidade=5)])
    rows = {r["avaliacao_id"]: r for r in S.stg_avaliacoes(m).collect()}
    assert [rows[k]["sentimento"] for k in "1234"] == ["positivo", "negativo", "neutro", "negativo"]
    assert rows["4"]["nota_qualidade"] == 5 and rows["4"]["nota_pontualidade"] == 2
    assert rows["4"]["nota_media_dimensoes"] == 2.6
    alt = {r["avaliacao_id"]: r["sentimento"] for r in S.stg_avaliacoes(m, positive_from=4).collect()}
    assert alt["2"] == "positivo"


def test_certificate_validity_boundaries(make_market):
    today = AS_OF.date()

    def cert(i, days):
        return dict(id=str(i), oficina_id=7, tipo="abvtex", nome="x", data_emissao=dt.date(2000, 1, 1),
                    data_validade=None if days is None else today + dt.timedelta(days=days), ativo=True)

    m = make_market(certificacoes=[cert(1, -1), cert(2, 0), cert(3, 89), cert(4, 90), cert(5, None)])
    rows = {r["certificacao_id"]: r["status_validade"] for r in S.stg_certificacoes(m).collect()}
    assert rows == {"1": "expirado", "2": "expirando", "3": "expirando", "4": "valido", "5": "sem_validade"}


def test_workshop_without_activity(make_market):
    shop = dict(id=7, nome_fantasia="W", cnpj="7", email="w@x", estado="SC", tier="ouro", ativo=True,
                verificado=True, especialidades=[], maquinario=None, created_at=dt.datetime(2000, 1, 1))
    m = make_market(oficinas=[shop])
    r = I.int_oficina_performance(m).first()
    assert r["total_pedidos"] == 0 and r["taxa_conclusao_pct"] is None
    assert r["win_rate_pct"] is None and r["nota_qualidade_media"] is None and r["ativo_recente"] is None
    assert r["num_especialidades"] is None  # ARRAY_LENGTH of an empty array is NULL
    q = I.int_oficina_performance(m, reference_quirks=True).first()
    assert q["total_pedidos"] == 1 and q["win_rate_pct"] == 0.0  # the reference's COUNT(*) over a left join
    assert M.marts_oficina_scoring(m).count() == 0  # unrated: filtered out when I2 keeps NULLs


def test_funnel_without_earlier_stages(make_market):
    m = make_market(
        empresas=[brand(1), brand(2)],
        pedidos=[order(1, empresa_id=1, status="finalizado", oficina_id=7, data_publicacao=None,
                       created_at=dt.datetime(2001, 2, 1)),
                 order(2, empresa_id=1, status="finalizado", oficina_id=7, data_publicacao=None,
                       created_at=dt.datetime(2001, 1, 5))])
    rows = {r["empresa_id"]: r for r in I.int_funnel_stages(m).collect()}
    assert rows[2]["stage_num"] == 1 and rows[2]["current_stage"] == "registered"
    assert rows[1]["stage_num"] == 5 and rows[1]["dt_first_publish"] is None
    assert rows[1]["dias_signup_para_ativacao"] is None and rows[1]["dias_match_para_conversao"] == 0
    act = {r["empresa_id"]: r for r in I.int_empresa_activity(m).collect()}
    assert act[2]["lifecycle_stage"] == "nunca_pediu" and act[2]["total_pedidos"] == 0
    assert act[1]["pedidos_repetidos"] == 1 and act[1]["e_cliente_recorrente"] is True


def test_enriched_orders_with_odd_keys(make_market):
    """Orders with the same id, without an id or without a workshop appear as often as a plain join has them; a brand is required."""
    shop = dict(id=7, nome_fantasia="W", cnpj="7", email="w@x", estado="PR", tier="ouro", ativo=True, verificado=True,
                created_at=dt.datetime(2000, 1, 1))
    m = make_market(
        empresas=[brand(1), brand(2), brand(3), brand(3, nome_fantasia="B3b")], oficinas=[shop],
        pedidos=[order(1, oficina_id=7), order(1, empresa_id=2), order(1, empresa_id=2), order(2, oficina_id=8), order(3, empresa_id=99),
                 order(4, empresa_id=None), order(5, empresa_id=3, oficina_id=7), order(None, empresa_id=2, oficina_id=7), order(None)])
    got = sorted(((r["pedido_id"], r["empresa_nome"], r["oficina_nome"]) for r in I.int_pedidos_enriched(m).collect()), key=str)
    assert got == sorted([(1, "B1", "W"), (1, "B2", None), (1, "B2", None), (2, "B1", None), (5, "B3", "W"), (5, "B3b", "W"),
                          (None, "B2", "W"), (None, "B1", None)], key=str)


def test_geography_one_sided_states(make_market):
    shop = dict(id=7, nome_fantasia="W", cnpj="7", email="w@x", estado="PR", tier="ouro", ativo=True,
                verificado=True, created_at=dt.datetime(2000, 1, 1))
    m = make_market(empresas=[brand(1)], oficinas=[shop])
    rows = {r["estado"]: r["balanco_mercado"] for r in M.marts_geographic_analysis(m).collect()}
    assert rows == {"SC": "sem_oferta", "PR": "sem_demanda"}


def test_quality_rules_count_exact_violations(make_market):
    m = make_market(empresas=[brand(1)], pedidos=[order(1), order(2, empresa_id=99), order(3, prioridade=9)],
                    usuarios=[dict(id=1, email="a", nome="a", role="empresa_owner", empresa_id=None, ativo=True),
                              dict(id=2, email="a", nome="b", role="admin", ativo=True)])
    fk = {r["rule"]: r["violations"] for r in Q.referential_integrity(m).collect()}
    assert fk["pedidos.empresa_id -> empresas.id"] == 1
    rc = {r["rule"]: r["violations"] for r in Q.row_constraints(m).collect()}
    assert rc["usuarios.role_entity"] == 1 and rc["pedidos.prioridade_1_5"] == 1 and rc["usuarios.unique(email)"] == 1
    en = {r["rule"]: r["violations"] for r in Q.enum_domains(m).collect()}
    assert all(v == 0 for v in en.values())
    assert F is not None


def _shop(i, estado="SC"):
    return dict(id=i, nome_fantasia=f"W{i}", cnpj=str(i), email="w@x", estado=estado, tier="ouro", ativo=True,
                verificado=True, created_at=dt.datetime(2000, 1, 1))


def test_fan_out_of_payments_and_ratings(make_market):
    pay = dict(pedido_id=1, empresa_id=1, oficina_id=7, valor_bruto=D("100.00"), taxa_plataforma=D("6.00"),
               valor_liquido=D("94.00"), percentual_taxa=D("6.00"), metodo="pix", status="pago",
               data_pagamento=dt.datetime(2001, 4, 1), created_at=dt.datetime(2001, 3, 20))

    def rating(rid, g):
        return dict(id=rid, pedido_id=1, avaliador_id=1, avaliado_oficina_id=7, nota_geral=g, nota_qualidade=g,
                    nota_pontualidade=g, publica=True, created_at=dt.datetime(2001, 4, 2))

    m = make_market(empresas=[brand(1)], oficinas=[_shop(7)],
                    pedidos=[order(1, status="finalizado", oficina_id=7, valor_final=D("100.00")),
                             order(2, status="finalizado", oficina_id=7, valor_final=D("50.00"),
                                   created_at=dt.datetime(2001, 3, 1))],  # same instant as order 1
                    pagamentos=[dict(pay, id=1), dict(pay, id=2)],
                    avaliacoes=[rating("r1", 5), rating("r2", 3)])
    enriched = I.int_pedidos_enriched(m).where(F.col("pedido_id") == 1).count()
    assert enriched == 2  # two paid payments multiply the order row, as the reference's left join does
    pairs = sorted((r["pedido_id"], r["numero_match_no_par"]) for r in I.int_match_pairs(m).collect())
    assert pairs == [(1, 1), (1, 2), (2, 3)]  # rating fan-out; equal timestamps ordered by order id


def test_rfm_quintiles_with_few_brands(make_market):
    m = make_market(empresas=[brand(1), brand(2), brand(3)],
                    pedidos=[order(i, empresa_id=i, status="finalizado", valor_final=D(str(100 * i)),
                                   created_at=dt.datetime(2001, i, 1)) for i in (1, 2, 3)])
    rows = {r["empresa_id"]: r for r in M.marts_empresa_clv(m).collect()}
    assert sorted(r["m_score"] for r in rows.values()) == [1, 2, 3]  # NTILE(5) over 3 rows
    assert rows[3]["r_score"] == 3 and rows[1]["r_score"] == 1  # most recent brand ranks last by recency desc


def test_single_purchase_and_flat_clv(spark):
    from loomstat.operators import clv as V

    tx = spark.createDataFrame([(1, dt.date(2001, 1, 1), D("10.00")), (2, dt.date(2001, 1, 1), D("5.00")),
                                (2, dt.date(2001, 2, 1), D("7.00"))],
                               "empresa_id long, order_date date, valor_final decimal(12,2)")
    rfm = {r["empresa_id"]: r for r in V.rfm_summary(tx).collect()}
    assert rfm[1]["frequency"] == 0.0 and rfm[1]["monetary_value"] == 0.0 and rfm[1]["T"] == 31.0
    assert rfm[2]["frequency"] == 1.0 and rfm[2]["monetary_value"] == 7.0 and rfm[2]["recency"] == 31.0
    flat = spark.createDataFrame([(i, 50.0) for i in range(6)], "empresa_id long, clv_12m_predicted double")
    labels = {r["clv_segment"] for r in V.segment_by_clv(flat).collect()}
    assert labels == {"low_value"}  # all edges equal: one bin, the lowest label
