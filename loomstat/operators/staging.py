"""Staging models. Each is a single projection (plus the named join) over
one source table; all are narrow transformations that Catalyst fuses into the
scan's whole-stage-codegen span, with the soft-delete filter (F1) pushed down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.scalar import (array_length_pg, as_of_date, as_of_ts, date_diff_days, days_between,
                                       digits_only, dow_sunday0, dround, hours_between, null_safe_flag, pct,
                                       ratio, to_int_rounded)
from loomstat.operators.model import built
from loomstat.sources.binding import Marketplace

# Fixed values (enumerations of the source model, in the reference's order).
EVENT_CATEGORIES = [
    ("navegacao", ["page_view", "login", "logout"]),
    ("cadastro", ["signup_started", "signup_completed"]),
    ("pedido", ["pedido_created", "pedido_published"]),
    ("proposta", ["proposta_sent", "proposta_viewed", "proposta_aceita"]),
    ("comunicacao", ["mensagem_sent"]),
    ("financeiro", ["pagamento_initiated"]),
    ("qualidade", ["avaliacao_submitted"]),
    ("descoberta", ["search_performed", "oficina_viewed"]),
]
ORDER_STATUS_RANK = [
    ("rascunho", 1), ("publicado", 2), ("em_negociacao", 3), ("confirmado", 4), ("em_producao", 5),
    ("controle_qualidade", 6), ("entregue", 7), ("finalizado", 8), ("cancelado", -1), ("disputa", -2),
]
CERT_PRESTIGE = [("disney", 5), ("nbcu", 5), ("abvtex", 4), ("gots", 4), ("oeko_tex", 4),
                 ("iso9001", 3), ("bsci", 3), ("wrap", 3)]  # any other type: 2


def _registration_status() -> F.Column:
    return (F.when(F.col("deleted_at").isNotNull(), "deletado")
            .when(~F.col("ativo"), "inativo")
            .when(~F.col("verificado"), "pendente_verificacao")
            .otherwise("ativo"))


@built
def stg_empresas(m: Marketplace) -> DataFrame:
    """P1."""
    e = m.empresas
    return e.where(F.col("deleted_at").isNull()).select(
        F.col("id").alias("empresa_id"), "razao_social", "nome_fantasia", "cnpj",
        F.lower(F.trim("email")).alias("email"),
        digits_only(F.col("telefone")).alias("telefone_limpo"),
        "website", "logo_url",
        F.trim("endereco").alias("endereco"),
        F.trim("cidade").alias("cidade"),
        F.upper(F.trim("estado")).alias("estado"),
        digits_only(F.col("cep")).alias("cep_limpo"),
        "porte",
        F.trim("segmento").alias("segmento"),
        F.coalesce(F.col("volume_mensal"), F.lit(0)).alias("volume_mensal_pecas"),
        "descricao", "ativo", "verificado", "data_verificacao",
        _registration_status().alias("status_cadastro"),
        F.col("created_at").alias("dt_cadastro"),
        F.col("updated_at").alias("dt_atualizacao"),
        F.col("deleted_at").alias("dt_exclusao"),
        F.col("deleted_at").isNull().alias("nao_deletado"),
    )


@built
def stg_oficinas(m: Marketplace) -> DataFrame:
    """P2."""
    o = m.oficinas
    q, p, c = (F.coalesce(F.col(n), F.lit(0).cast("decimal(4,2)"))
               for n in ("score_qualidade", "score_pontualidade", "score_comunicacao"))
    return o.where(F.col("deleted_at").isNull()).select(
        F.col("id").alias("oficina_id"), "razao_social", "nome_fantasia", "cnpj",
        F.lower(F.trim("email")).alias("email"),
        digits_only(F.col("telefone")).alias("telefone_limpo"),
        "responsavel",
        F.trim("endereco").alias("endereco"),
        F.trim("cidade").alias("cidade"),
        F.upper(F.trim("estado")).alias("estado"),
        digits_only(F.col("cep")).alias("cep_limpo"),
        F.coalesce(F.col("num_costureiras"), F.lit(0)).alias("num_costureiras"),
        F.coalesce(F.col("capacidade_mensal"), F.lit(0)).alias("capacidade_mensal_pecas"),
        "especialidades", "maquinario",
        array_length_pg(F.col("especialidades")).alias("num_especialidades"),
        array_length_pg(F.col("maquinario")).alias("num_tipos_maquinario"),
        "tier",
        q.alias("score_qualidade"), p.alias("score_pontualidade"), c.alias("score_comunicacao"),
        F.coalesce(F.col("total_avaliacoes"), F.lit(0)).alias("total_avaliacoes"),
        dround((q + p + c).cast("double") / F.lit(3.0), 2).alias("score_medio"),
        "ativo", "verificado", "data_verificacao",
        _registration_status().alias("status_cadastro"),
        F.col("created_at").alias("dt_cadastro"),
        F.col("updated_at").alias("dt_atualizacao"),
        F.col("deleted_at").alias("dt_exclusao"),
    )


@built
def stg_usuarios(m: Marketplace, as_of: str | None = None) -> DataFrame:
    """P3."""
    u = m.usuarios
    role = F.col("role")
    now = as_of_ts(as_of or m.as_of)
    last = F.col("ultimo_login")
    return u.where(F.col("deleted_at").isNull()).select(
        F.col("id").alias("usuario_id"),
        F.lower(F.trim("email")).alias("email"),
        F.trim("nome").alias("nome"),
        digits_only(F.col("telefone")).alias("telefone_limpo"),
        "role", "empresa_id", "oficina_id",
        F.when(role.isin("empresa_owner", "empresa_user"), "empresa")
        .when(role.isin("oficina_owner", "oficina_user"), "oficina").otherwise("admin").alias("tipo_entidade"),
        role.isin("empresa_owner", "oficina_owner").alias("is_owner"),
        "ultimo_login",
        F.coalesce(F.col("login_count"), F.lit(0)).alias("login_count"),
        "ativo",
        to_int_rounded(F.when(last.isNotNull(), days_between(now, last))).alias("dias_desde_ultimo_login"),
        (last >= now - F.expr("INTERVAL 30 DAYS")).alias("ativo_ultimos_30d"),
        F.col("created_at").alias("dt_cadastro"),
        F.col("updated_at").alias("dt_atualizacao"),
        F.col("deleted_at").alias("dt_exclusao"),
    )


@built
def stg_pedidos(m: Marketplace) -> DataFrame:
    """P4. Derived columns test the *raw* money columns before they are coalesced
    (one ``select``: a same-named output column never shadows the input)."""
    p = m.pedidos
    ve, vf, qty = F.col("valor_estimado"), F.col("valor_final"), F.col("quantidade_total")
    status = F.col("status")
    rank = F.lit(0)
    for name, r in reversed(ORDER_STATUS_RANK):
        rank = F.when(status == name, F.lit(r)).otherwise(rank)
    return p.where(F.col("deleted_at").isNull()).select(
        F.col("id").alias("pedido_id"), "codigo", "empresa_id", "oficina_id", "categoria_id",
        F.trim("titulo").alias("titulo"), "descricao",
        "quantidade_total",
        F.coalesce(F.col("unidade"), F.lit("peças")).alias("unidade"),
        F.round(F.coalesce(ve, F.lit(0).cast("decimal(12,2)")), 2).alias("valor_estimado"),
        F.round(F.coalesce(vf, F.lit(0).cast("decimal(12,2)")), 2).alias("valor_final"),
        "moeda",
        F.when((ve > 0) & vf.isNotNull(), dround(ratio(vf - ve, ve) * F.lit(100.0), 2)).alias("pct_variacao_valor"),
        F.when((qty > 0) & vf.isNotNull(), dround(ratio(vf, qty), 4))
        .when((qty > 0) & ve.isNotNull(), dround(ratio(ve, qty), 4)).alias("preco_por_peca"),
        "data_publicacao", "data_limite_propostas", "prazo_entrega", "data_entrega_real",
        F.when(F.col("data_entrega_real").isNotNull() & F.col("prazo_entrega").isNotNull(),
               date_diff_days(F.col("data_entrega_real"), F.col("prazo_entrega"))).alias("dias_atraso_entrega"),
        null_safe_flag(F.col("data_entrega_real") <= F.col("prazo_entrega"),
                       F.col("data_entrega_real"), F.col("prazo_entrega")).alias("entregue_no_prazo"),
        F.when(F.col("data_publicacao").isNotNull(),
               dround(hours_between(F.col("data_publicacao"), F.col("created_at")), 2)).alias("horas_para_publicar"),
        "status", "prioridade",
        rank.alias("status_ordem"),
        F.col("oficina_id").isNotNull().alias("foi_matched"),
        (status == "finalizado").alias("foi_finalizado"),
        (status == "cancelado").alias("foi_cancelado"),
        F.col("created_at").alias("dt_criacao"),
        F.col("updated_at").alias("dt_atualizacao"),
        F.col("deleted_at").alias("dt_exclusao"),
        F.date_trunc("month", "created_at").alias("mes_criacao"),
        F.date_trunc("week", "created_at").alias("semana_criacao"),
        F.year("created_at").alias("ano_criacao"),
        F.month("created_at").alias("mes_num_criacao"),
    )


def _live_orders(m: Marketplace) -> DataFrame:
    return m.pedidos.where(F.col("deleted_at").isNull()).select(
        F.col("id").alias("_p_id"), F.col("valor_estimado").alias("_p_ve"),
        F.col("quantidade_total").alias("_p_qty"), F.col("data_publicacao").alias("_p_pub"))


@built
def stg_pedido_items(m: Marketplace) -> DataFrame:
    """P5 (inner join to live orders)."""
    it = m.pedido_items.join(_live_orders(m).select("_p_id"), F.col("pedido_id") == F.col("_p_id"))
    unit = F.coalesce(F.col("valor_unitario"), F.lit(0).cast("decimal(10,2)"))
    return it.select(
        F.col("id").alias("item_id"), "pedido_id",
        F.trim("descricao").alias("descricao"), "quantidade",
        F.upper(F.trim(F.coalesce(F.col("tamanho"), F.lit("UNI")))).alias("tamanho"),
        F.trim("cor").alias("cor"), F.trim("material").alias("material"),
        F.round(unit, 2).alias("valor_unitario"),
        F.round(F.col("quantidade") * unit, 2).alias("valor_total_item"),
        "observacoes",
        F.col("created_at").alias("dt_criacao"),
    )


@built
def stg_propostas(m: Marketplace) -> DataFrame:
    """P6 (inner join to live orders)."""
    pr = m.propostas.join(_live_orders(m), F.col("pedido_id") == F.col("_p_id"))
    vp, st = F.col("valor_proposto"), F.col("status")
    return pr.select(
        F.col("id").alias("proposta_id"), "pedido_id", "oficina_id",
        F.round(vp, 2).alias("valor_proposto"),
        "prazo_proposto", "descricao", "condicoes", "status", "data_resposta", "motivo_recusa",
        F.when(F.col("data_resposta").isNotNull(),
               dround(hours_between(F.col("data_resposta"), F.col("created_at")), 2)).alias("horas_ate_resposta"),
        F.when(F.col("_p_pub").isNotNull(),
               dround(hours_between(F.col("created_at"), F.col("_p_pub")), 2)).alias("horas_apos_publicacao"),
        (st == "aceita").alias("foi_aceita"),
        (st == "recusada").alias("foi_recusada"),
        st.isin("expirada", "retirada").alias("nao_respondida"),
        F.when(F.col("_p_ve") > 0, dround(ratio(vp - F.col("_p_ve"), F.col("_p_ve")) * F.lit(100.0), 2))
        .alias("pct_vs_estimado"),
        F.when(F.col("_p_qty") > 0, dround(ratio(vp, F.col("_p_qty")), 4)).alias("preco_por_peca_proposto"),
        F.col("created_at").alias("dt_envio"),
        F.col("updated_at").alias("dt_atualizacao"),
    )


@built
def stg_producao(m: Marketplace) -> DataFrame:
    """P7."""
    pr = m.producao
    made = F.col("quantidade_produzida")
    return pr.select(
        F.col("id").alias("producao_id"), "pedido_id", "oficina_id", "status",
        F.round(F.col("percentual_concluido"), 2).alias("pct_concluido"),
        F.coalesce(made, F.lit(0)).alias("qtd_produzida"),
        F.coalesce(F.col("quantidade_aprovada"), F.lit(0)).alias("qtd_aprovada"),
        F.coalesce(F.col("quantidade_rejeitada"), F.lit(0)).alias("qtd_rejeitada"),
        F.when(made > 0, pct(F.col("quantidade_aprovada"), made)).alias("taxa_aprovacao_pct"),
        F.when(made > 0, pct(F.col("quantidade_rejeitada"), made)).alias("taxa_rejeicao_pct"),
        "data_inicio", "data_previsao", "data_conclusao",
        to_int_rounded(F.when(F.col("data_conclusao").isNotNull() & F.col("data_inicio").isNotNull(),
                              days_between(F.col("data_conclusao"), F.col("data_inicio")))).alias("dias_producao"),
        null_safe_flag(F.to_date("data_conclusao") <= F.col("data_previsao"),
                       F.col("data_conclusao"), F.col("data_previsao")).alias("concluido_no_prazo"),
        "observacoes_qualidade",
        F.col("created_at").alias("dt_inicio_registro"),
        F.col("updated_at").alias("dt_atualizacao"),
    )


@built
def stg_avaliacoes(m: Marketplace, positive_from: int = 5) -> DataFrame:
    """P8. ``positive_from`` = 5 reproduces the reference, where a grade of 4 is 'negativo'."""
    a = m.avaliacoes
    g = F.col("nota_geral")
    dims = [F.coalesce(F.col(n), g) for n in
            ("nota_qualidade", "nota_pontualidade", "nota_comunicacao", "nota_custo_beneficio")]
    total = g + dims[0] + dims[1] + dims[2] + dims[3]
    return a.select(
        F.col("id").alias("avaliacao_id"), "pedido_id", "avaliador_id",
        "avaliado_empresa_id", "avaliado_oficina_id",
        F.when(F.col("avaliado_oficina_id").isNotNull(), "empresa_avalia_oficina")
        .when(F.col("avaliado_empresa_id").isNotNull(), "oficina_avalia_empresa").alias("direcao_avaliacao"),
        g.alias("nota_geral"),
        dims[0].alias("nota_qualidade"), dims[1].alias("nota_pontualidade"),
        dims[2].alias("nota_comunicacao"), dims[3].alias("nota_custo_beneficio"),
        dround(total.cast("double") / F.lit(5.0), 2).alias("nota_media_dimensoes"),
        dround(g.cast("double") * F.lit(2.0), 2).alias("nota_geral_10"),
        F.when(g >= positive_from, "positivo").when(g == 3, "neutro").otherwise("negativo").alias("sentimento"),
        "comentario",
        F.col("comentario").isNotNull().alias("tem_comentario"),
        "publica",
        F.col("created_at").alias("dt_avaliacao"),
    )


@built
def stg_certificacoes(m: Marketplace, as_of: str | None = None) -> DataFrame:
    """P9."""
    c = m.certificacoes
    today = as_of_date(as_of or m.as_of)
    val = F.col("data_validade")
    prestige = F.lit(2)
    for name, p in reversed(CERT_PRESTIGE):
        prestige = F.when(F.col("tipo") == name, F.lit(p)).otherwise(prestige)
    return c.where(F.col("ativo")).select(
        F.col("id").alias("certificacao_id"), "oficina_id", "tipo",
        F.trim("nome").alias("nome"), "entidade_emissora", "numero_certificado",
        "data_emissao", "data_validade", "ativo",
        F.when(val.isNull(), "sem_validade").when(val < today, "expirado")
        .when(val < F.date_add(today, 90), "expirando").otherwise("valido").alias("status_validade"),
        F.when(val.isNotNull(), date_diff_days(val, today)).alias("dias_para_expirar"),
        F.when(val.isNotNull(), date_diff_days(val, F.col("data_emissao"))).alias("duracao_validade_dias"),
        "verificado", "data_verificacao",
        prestige.alias("prestigio_certificacao"),
        "created_at", "updated_at",
    )


@built
def stg_pagamentos(m: Marketplace, as_of: str | None = None) -> DataFrame:
    """P10."""
    pg = m.pagamentos
    today = as_of_date(as_of or m.as_of)
    st = F.col("status")
    paid_or_created = F.coalesce(F.col("data_pagamento"), F.col("created_at"))
    return pg.select(
        F.col("id").alias("pagamento_id"), "pedido_id", "empresa_id", "oficina_id",
        F.round("valor_bruto", 2).alias("valor_bruto"),
        F.round("taxa_plataforma", 2).alias("taxa_plataforma"),
        F.round("valor_liquido", 2).alias("valor_liquido"),
        F.round("percentual_taxa", 4).alias("pct_taxa"),
        "metodo", "status", "referencia_externa", "data_vencimento", "data_pagamento",
        to_int_rounded(F.when(F.col("data_pagamento").isNotNull(),
                              days_between(F.col("data_pagamento"), F.col("created_at")))).alias("dias_para_pagamento"),
        F.when(st == "pago", F.lit(False)).when(F.col("data_vencimento").isNull(), F.lit(None).cast("boolean"))
        .when(F.col("data_vencimento") < today, F.lit(True)).otherwise(F.lit(False)).alias("em_atraso"),
        (st == "pago").alias("foi_pago"),
        (st == "estornado").alias("foi_estornado"),
        st.isin("falha", "estornado").alias("nao_efetivado"),
        F.col("created_at").alias("dt_criacao"),
        F.col("updated_at").alias("dt_atualizacao"),
        F.date_trunc("month", paid_or_created).alias("mes_pagamento"),
        F.year(paid_or_created).alias("ano_pagamento"),
    )


@built
def stg_eventos_plataforma(m: Marketplace) -> DataFrame:
    """P11."""
    e = m.eventos_plataforma
    tipo = F.col("tipo")
    cat = F.lit("outros")
    for name, members in reversed(EVENT_CATEGORIES):
        cat = F.when(tipo.isin(*members), F.lit(name)).otherwise(cat)
    ts = F.col("created_at")
    return e.select(
        F.col("id").alias("evento_id"), "usuario_id", "session_id", "tipo",
        F.trim("pagina").alias("pagina"), "referrer", "entidade_tipo", "entidade_id", "metadata",
        F.col("ip_address").cast("string").alias("ip_address"),
        "user_agent",
        F.coalesce(F.col("dispositivo"), F.lit("desconhecido")).alias("dispositivo"),
        cat.alias("categoria_evento"),
        ts.alias("dt_evento"),
        F.date_trunc("hour", ts).alias("hora_evento"),
        F.date_trunc("day", ts).alias("dia_evento"),
        F.date_trunc("week", ts).alias("semana_evento"),
        F.hour(ts).alias("hora_do_dia"),
        dow_sunday0(ts).alias("dia_semana"),
    )
