"""Q1–Q6: data-quality jobs. Each returns one row per rule with its violation count;
every rule is a distributed count (anti joins, one-pass conditional sums,
``groupBy().having``), nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.sources.binding import ORDER_KEYS, Marketplace

# Enumerations of the source model (order as declared).
ENUMS = {
    "user_role": ["admin", "empresa_owner", "empresa_user", "oficina_owner", "oficina_user"],
    "empresa_size": ["micro", "pequena", "media", "grande"],
    "oficina_tier": ["bronze", "prata", "ouro", "diamante"],
    "pedido_status": ["rascunho", "publicado", "em_negociacao", "confirmado", "em_producao", "controle_qualidade",
                      "entregue", "finalizado", "cancelado", "disputa"],
    "proposta_status": ["enviada", "em_analise", "aceita", "recusada", "expirada", "retirada"],
    "producao_status": ["aguardando_material", "em_corte", "em_costura", "em_acabamento", "controle_qualidade",
                        "embalagem", "expedido"],
    "pagamento_status": ["pendente", "processando", "aprovado", "pago", "estornado", "falha"],
    "pagamento_metodo": ["pix", "boleto", "transferencia", "cartao_credito"],
    "certificacao_tipo": ["abvtex", "nbcu", "disney", "bsci", "wrap", "iso9001", "oeko_tex", "gots", "outras"],
    "evento_tipo": ["page_view", "signup_started", "signup_completed", "login", "profile_updated", "search_performed",
                    "oficina_viewed", "pedido_created", "pedido_published", "proposta_sent", "proposta_viewed",
                    "proposta_aceita", "mensagem_sent", "pagamento_initiated", "avaliacao_submitted",
                    "certificacao_uploaded", "relatorio_viewed", "export_data", "logout"],
}


def _rule_rows(spark, rows: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union one-row count frames ``(rule, violations)``."""
    frames = [df.select(F.lit(rule).alias("rule"), F.col("violations").cast("bigint")) for rule, df in rows]
    return reduce(lambda a, b: a.unionByName(b), frames)


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations"))


SOURCE_TABLES = ["categorias_produto", "empresas", "oficinas", "usuarios", "pedidos", "pedido_items", "propostas",
                 "producao", "avaliacoes", "certificacoes", "pagamentos", "eventos_plataforma", "mensagens", "notificacoes"]


def expected_counts(m: Marketplace) -> DataFrame:
    """Rows that each source table has to have, counted on the raw input without the binding."""
    li, o = m.raw("lineitem"), m.raw("orders")
    lines = li.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    per_part = li.select("l_suppkey", "l_partkey").distinct().join(m.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
    matched = o.where(F.col("o_orderstatus") != "O").join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    frames = {
        "categorias_produto": m.raw("region").select("r_regionkey").unionAll(m.raw("nation").select("n_nationkey")),
        "empresas": m.raw("customer"), "oficinas": m.raw("supplier"),
        "usuarios": m.raw("customer").select("c_custkey").unionAll(m.raw("supplier").select("s_suppkey")),
        "pedidos": o, "pedido_items": li, "propostas": lines.select("l_orderkey", "l_suppkey").distinct(), "producao": lines,
        "avaliacoes": lines.where(F.col("l_returnflag").isin("A", "R")),
        "certificacoes": per_part.select("l_suppkey", "p_type").distinct(),
        "mensagens": m.raw("conversations").where(F.col("role").isin("user", "assistant")).join(
            matched.select(F.col("o_orderkey").alias("conv_id")), "conv_id", "left_semi"),
        "notificacoes": matched.select("o_orderkey").unionAll(matched.where(F.col("o_orderstatus") == "F").select("o_orderkey")),
        "pagamentos": o.where(F.col("o_orderstatus") == "F"), "eventos_plataforma": m.raw("events"),
    }
    return reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count(F.lit(1)).alias("expected")).select(F.lit(t).alias("table_name"), "expected") for t, df in frames.items()])


def row_counts(m: Marketplace, expected: dict[str, int] | None = None) -> DataFrame:
    """Q1: actual row count per source table vs expected (``expected_counts`` unless given); passes when actual >= expected."""
    rows = [getattr(m, t).agg(F.count(F.lit(1)).alias("actual")).select(F.lit(t).alias("table_name"), "actual")
            for t in SOURCE_TABLES]
    counts = reduce(lambda a, b: a.unionByName(b), rows)
    if expected is None:
        e = expected_counts(m)
    else:
        e = m.spark.createDataFrame([(t, int(expected.get(t, 0))) for t in SOURCE_TABLES], "table_name string, expected bigint")
    return counts.join(e, "table_name").withColumn("passed", F.col("actual") >= F.col("expected"))


# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("categorias_produto", "parent_id", "categorias_produto", "id"),
    ("usuarios", "empresa_id", "empresas", "id"),
    ("usuarios", "oficina_id", "oficinas", "id"),
    ("pedidos", "empresa_id", "empresas", "id"),
    ("pedidos", "oficina_id", "oficinas", "id"),
    ("pedidos", "categoria_id", "categorias_produto", "id"),
    ("pedido_items", "pedido_id", "pedidos", "id"),
    ("propostas", "pedido_id", "pedidos", "id"),
    ("propostas", "oficina_id", "oficinas", "id"),
    ("producao", "pedido_id", "pedidos", "id"),
    ("producao", "oficina_id", "oficinas", "id"),
    ("avaliacoes", "pedido_id", "pedidos", "id"),
    ("avaliacoes", "avaliador_id", "usuarios", "id"),
    ("avaliacoes", "avaliado_empresa_id", "empresas", "id"),
    ("avaliacoes", "avaliado_oficina_id", "oficinas", "id"),
    ("certificacoes", "oficina_id", "oficinas", "id"),
    ("pagamentos", "pedido_id", "pedidos", "id"),
    ("pagamentos", "empresa_id", "empresas", "id"),
    ("pagamentos", "oficina_id", "oficinas", "id"),
    ("eventos_plataforma", "usuario_id", "usuarios", "id"),
    ("mensagens", "remetente_id", "usuarios", "id"),
    ("mensagens", "destinatario_id", "usuarios", "id"),
    ("mensagens", "pedido_id", "pedidos", "id"),
    ("notificacoes", "usuario_id", "usuarios", "id"),
]


def referential_integrity(m: Marketplace) -> DataFrame:
    """Orphan count per foreign key (non-NULL child keys without a parent).

    Every child table is scanned once for all its keys: a row becomes one (parent, key, value) row per foreign key. Every parent
    table is scanned once. One grouping by (parent, value) of both, the only shuffle of values, counts the rows of each key and
    shows the values without a parent row; equal values are counted in the task that read them, so no value is hot."""
    tables = sorted({(p, c) for _, _, p, c in FOREIGN_KEYS})
    children, by_child, rules = [], {}, []
    for child, ccol, parent, pcol in FOREIGN_KEYS:
        at = tables.index((parent, pcol))
        slot = sum(r[0] == at for r in rules)  # the place of the key among those of its parent
        rules.append((at, slot, f"{child}.{ccol} -> {parent}.{pcol}"))
        by_child.setdefault(child, []).append(F.struct(F.lit(at).alias("parent"), F.lit(slot).alias("slot"), F.col(ccol).cast("string").alias("value")))
    for child, keys in by_child.items():
        children.append(getattr(m, child).select(F.inline(F.array(*keys))).where(F.col("value").isNotNull()))
    parents = [getattr(m, parent).select(F.lit(at).alias("parent"), F.lit(None).cast("int").alias("slot"), F.col(pcol).cast("string").alias("value"))
               for at, (parent, pcol) in enumerate(tables)]
    both = reduce(lambda a, b: a.unionByName(b), children + parents)
    slots = range(max(r[1] for r in rules) + 1)
    met = both.groupBy("parent", "value").agg(F.count_if(F.col("slot").isNull()).alias("there"),
                                              *[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in slots])
    lost = met.where("there = 0").groupBy("parent").agg(F.array(*[F.sum(f"n{i}") for i in slots]).alias("n"))
    named = m.spark.createDataFrame(rules, "parent int, slot int, rule string")
    return named.join(lost, "parent", "left").select("rule", F.coalesce(F.get("n", "slot"), F.lit(0)).cast("bigint").alias("violations"))


def row_constraints(m: Marketplace) -> DataFrame:
    """Q3: row constraints in one pass per table, plus uniqueness of declared keys."""
    u, p, a = m.usuarios, m.pedidos, m.avaliacoes
    role = F.col("role")
    ok_user = ((role.isin("empresa_owner", "empresa_user") & F.col("empresa_id").isNotNull() & F.col("oficina_id").isNull())
               | (role.isin("oficina_owner", "oficina_user") & F.col("oficina_id").isNotNull()
                  & F.col("empresa_id").isNull())
               | ((role == "admin") & F.col("empresa_id").isNull() & F.col("oficina_id").isNull()))

    def viol(df, cond):
        return df.agg(F.count(F.when(~F.coalesce(cond, F.lit(True)), 1)).alias("violations"))

    grades = ["nota_geral", "nota_qualidade", "nota_pontualidade", "nota_comunicacao", "nota_custo_beneficio"]
    rows = [
        ("usuarios.role_entity", viol(u, ok_user)),
        ("pedidos.prioridade_1_5", viol(p, F.col("prioridade").between(1, 5))),
        ("avaliacoes.notas_1_5", viol(a, reduce(lambda x, y: x & y, [F.coalesce(F.col(g).between(1, 5), F.lit(True))
                                                                    for g in grades]))),
        ("mensagens.not_to_self", viol(m.mensagens, F.col("remetente_id") != F.col("destinatario_id"))),
        ("avaliacoes.one_reviewed_party", viol(a, (F.col("avaliado_empresa_id").isNotNull()
                                                   != F.col("avaliado_oficina_id").isNotNull()))),
    ]
    uniques = [("propostas", ["pedido_id", "oficina_id"]), ("avaliacoes", ["pedido_id", "avaliador_id"]),
               ("empresas", ["cnpj"]), ("oficinas", ["cnpj"]), ("usuarios", ["email"]), ("pedidos", ["codigo"]),
               ("categorias_produto", ["nome"]), ("categorias_produto", ["slug"])]
    for t, keys in uniques:
        dup = getattr(m, t).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        rows.append((f"{t}.unique({','.join(keys)})", dup.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
                                                             .alias("violations"))))
    return _rule_rows(m.spark, rows)


ENUM_COLUMNS = [("usuarios", "role", "user_role"), ("empresas", "porte", "empresa_size"),
                ("oficinas", "tier", "oficina_tier"), ("pedidos", "status", "pedido_status"),
                ("propostas", "status", "proposta_status"), ("producao", "status", "producao_status"),
                ("pagamentos", "status", "pagamento_status"), ("pagamentos", "metodo", "pagamento_metodo"),
                ("certificacoes", "tipo", "certificacao_tipo"), ("eventos_plataforma", "tipo", "evento_tipo")]


def enum_domains(m: Marketplace) -> DataFrame:
    """Q4: values outside their enumeration (NULL is not a violation)."""
    rows = []
    for t, c, enum in ENUM_COLUMNS:
        df = getattr(m, t)
        rows.append((f"{t}.{c} in {enum}", df.agg(F.count(F.when(~F.col(c).isin(*ENUMS[enum]), 1)).alias("violations"))))
    return _rule_rows(m.spark, rows)


def lifecycle_invariants(m: Marketplace) -> DataFrame:
    """Q5: payments only for finalised orders; events by existing users; bids on existing (order, workshop)."""
    pg, p = m.pagamentos, m.pedidos
    not_final = pg.join(p.select(F.col("id").alias("_pid"), F.col("status").alias("_pstatus")),
                        pg.pedido_id == F.col("_pid"), "left") \
        .where(F.col("_pstatus").isNull() | (F.col("_pstatus") != "finalizado"))
    ev = m.eventos_plataforma.where(F.col("usuario_id").isNotNull())
    ev_orphans = ev.join(m.usuarios.select(F.col("id").alias("usuario_id")), "usuario_id", "left_anti")
    a = m.avaliacoes
    both = a.where(F.col("avaliado_empresa_id").isNotNull() == F.col("avaliado_oficina_id").isNotNull())
    bids = m.propostas.select("pedido_id", "oficina_id")
    bad_bids = (bids.join(p.select(F.col("id").alias("pedido_id")), "pedido_id", "left_anti")
                .unionByName(bids.join(m.oficinas.select(F.col("id").alias("oficina_id")), "oficina_id", "left_anti")))
    return _rule_rows(m.spark, [
        ("pagamentos.only_finalised_orders", _count(not_final)),
        ("avaliacoes.exactly_one_reviewed_party", _count(both)),
        ("eventos.user_exists", _count(ev_orphans)),
        ("propostas.valid_pair", _count(bad_bids)),
    ])


def _whole_number(f: T.StructField) -> F.Column | None:
    """The column as a whole number that stands for exactly one value of it, or None where there is none."""
    c, t = F.col(f"`{f.name}`"), f.dataType
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(t, T.DecimalType) and t.precision <= 18 and t.scale >= 0:
        return (c * F.lit(10 ** t.scale).cast("decimal(19,0)")).cast("long")
    return None


def distinct_counts(df: DataFrame, key: str | None = None) -> DataFrame:
    """(i, n_distinct): exact number of distinct values of the i-th column (no row for a column without values).

    Whole numbers, dates, times and money are counted as bits: 64 neighbouring numbers are one row, joined by ``bit_or`` in
    the task that read them and again after the shuffle. Other columns are counted as text in two levels, by (column, value)
    and then by column. ``key``, the column by which the table is bucketed, is counted within its buckets."""
    fields = list(enumerate(df.schema.fields))
    numbers, texts, counts = [], [], []
    for i, f in fields:
        number = None if f.name == key else _whole_number(f)
        if f.name == key:
            c = F.col(f"`{key}`")
            counts.append(df.select(c.alias("v")).distinct().agg(F.count("v").alias("n_distinct")).select(F.lit(i).alias("i"), "n_distinct"))
        elif number is not None:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))
            numbers.append(F.struct(F.lit(i).alias("i"), F.shiftright(number, 6).alias("word"), bit.alias("bit")))
        else:
            texts.append(F.struct(F.lit(i).alias("i"), F.col(f"`{f.name}`").cast("string").alias("v")))
    if numbers:
        words = df.select(F.inline(F.array(*numbers))).where(F.col("word").isNotNull()).groupBy("i", "word").agg(F.bit_or("bit").alias("bits"))
        counts.append(words.groupBy("i").agg(F.sum(F.bit_count("bits")).alias("n_distinct")))
    if texts:
        values = df.select(F.inline(F.array(*texts))).where(F.col("v").isNotNull()).distinct()
        counts.append(values.groupBy("i").agg(F.count(F.lit(1)).alias("n_distinct")))
    return reduce(lambda a, b: a.unionByName(b), counts)


def column_profile(m: Marketplace, table: str) -> DataFrame:
    """Q6: per column type, null count, distinct count, min and max (as strings). Nulls and bounds come from one wide
    aggregate; distinct values are counted exactly by ``distinct_counts``, so a frequent value is one row per task and no
    column's values meet in one task."""
    df = getattr(m, table)
    fields = df.schema.fields
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        comparable = f.dataType.typeName() not in ("array", "map", "struct", "binary")
        aggs.append(F.struct(
            F.lit(i).alias("i"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
            F.count(F.when(c.isNull(), 1)).alias("null_count"),
            (F.min(c).cast("string") if comparable else F.lit(None).cast("string")).alias("min_value"),
            (F.max(c).cast("string") if comparable else F.lit(None).cast("string")).alias("max_value")))
    wide = df.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")  # a row a column
    return wide.join(distinct_counts(df, ORDER_KEYS.get(table)), "i", "left").select(
        F.lit(table).alias("table_name"), "column_name", "data_type", "null_count", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        "min_value", "max_value")


def schema_profile(m: Marketplace) -> DataFrame:
    """Q6 over every source table."""
    return reduce(lambda a, b: a.unionByName(b), [column_profile(m, t) for t in SOURCE_TABLES])
