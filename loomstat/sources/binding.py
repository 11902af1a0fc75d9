"""Binding of the driver's TPC-H-like tables to the marketplace source model.

The marketplace model has 12 source tables (brands, workshops, users, orders,
order items, bids, production, ratings, certificates, payments, events and a
two-level category tree). The driver only ships TPC-H-like tables, so each
source table is *derived* from them by a fixed, documented rule. The rules are
repeated, independently, in the SQL oracle (``loomstat.plans.oracle``).

Scale notes: every lineitem-derived relation is one scan plus one hash
aggregation keyed by ``l_orderkey`` (map-side partial aggregation); the
per-order line summary is computed once and reused by orders, bids and
payments. No relation is collected or broadcast unless AQE finds it small.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.sources.io import STORED, scan, table_bytes

# Fixed values of the binding (part of the contract with the oracle SQL).
EVENT_SHIFT_DAYS = 8219            # events (January 2024) are moved to July 2001, inside the order history
WORKSHOP_SIGNUP_BASE = "1994-06-01"
PAYMENT_METHODS = ("pix", "boleto", "transferencia", "cartao_credito")  # chosen by o_orderkey % 4
MONTHS_OF_CAPACITY = 80            # workshop capacity = total quantity supplied / 80 months

MONEY = "decimal(12,2)"


def _add_hours(ts, hours):
    return F.timestamp_micros(F.unix_micros(ts) + hours.cast("bigint") * F.lit(3_600_000_000))


def _add_days_ts(ts, days):
    return F.timestamp_micros(F.unix_micros(ts) + days.cast("bigint") * F.lit(86_400_000_000))


def _typed_lines(li: DataFrame) -> DataFrame:
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("ext"),
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )


@dataclass
class Marketplace:
    """Lazily derived source tables. Nothing is computed until an action runs."""

    spark: SparkSession
    sf_dir: str
    as_of: str
    _raw: dict = field(default_factory=dict)
    models: dict = field(default_factory=dict)  # written models by name

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = scan(self.spark, self.sf_dir, name)
        return self._raw[name]

    def by_order(self, name: str) -> DataFrame:
        """``orders`` or ``lineitem`` for work by order key."""
        return self.raw(name)

    def in_buckets(self, name: str) -> bool:
        """Whether a source table lies in the buckets of the order key."""
        return False

    # ---------------------------------------------------------------- helpers
    @cached_property
    def _lines(self) -> DataFrame:
        return _typed_lines(self.raw("lineitem"))

    @cached_property
    def _lines_by_order(self) -> DataFrame:
        return _typed_lines(self.by_order("lineitem"))

    @cached_property
    def _order_lines(self) -> DataFrame:
        """One row per order: matched supplier, quantity, estimate, largest tax, last ship."""
        return self._lines_by_order.groupBy("l_orderkey").agg(
            F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).getField("l_suppkey").alias("first_supp"),
            F.sum("l_quantity").alias("qty"),
            F.sum("ext").alias("est"),
            F.max("l_tax").alias("max_tax"),
            F.max("l_shipdate").alias("last_ship"),
        )

    @cached_property
    def _states(self) -> DataFrame:
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            "n_nationkey", "n_name", "r_name")

    # ---------------------------------------------------------------- tables
    @cached_property
    def categorias_produto(self) -> DataFrame:
        """Two-level tree: regions (level 1, id 100 + key) above nations (level 2)."""
        regions = self.raw("region").select(
            (F.col("r_regionkey") + 100).cast("bigint").alias("id"), F.col("r_name").alias("nome"),
            F.lower("r_name").alias("slug"), F.lit(None).cast("bigint").alias("parent_id"),
            F.lit(1).cast("smallint").alias("nivel"), F.lit(True).alias("ativo"))
        nations = self.raw("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("nome"),
            F.lower("n_name").alias("slug"), (F.col("n_regionkey") + 100).cast("bigint").alias("parent_id"),
            F.lit(2).cast("smallint").alias("nivel"), F.lit(True).alias("ativo"))
        return regions.unionByName(nations)

    @cached_property
    def empresas(self) -> DataFrame:
        c = self.raw("customer")
        first_order = self.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
        bal = F.col("c_acctbal")
        return (
            c.join(self._states, c.c_nationkey == F.col("n_nationkey"), "left")
            .join(first_order, c.c_custkey == F.col("o_custkey"), "left")
            .select(
                F.col("c_custkey").alias("id"),
                F.col("c_name").alias("razao_social"),
                F.col("c_name").alias("nome_fantasia"),
                F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("cnpj"),
                F.concat(F.lit(" "), F.col("c_name"), F.lit("@Brand.Example ")).alias("email"),
                F.concat(F.lit("("), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(") 9"),
                         F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")).alias("telefone"),
                F.lit(None).cast("string").alias("website"),
                F.lit(None).cast("string").alias("logo_url"),
                F.lit(None).cast("string").alias("endereco"),
                F.concat(F.lit(" "), F.col("r_name")).alias("cidade"),
                F.lower(F.col("n_name")).alias("estado"),
                F.concat(F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"), F.lit("-"),
                         F.lpad(F.col("c_nationkey").cast("string"), 3, "0")).alias("cep"),
                F.when(bal < 0, "micro").when(bal < 3000, "pequena").when(bal < 7000, "media")
                .otherwise("grande").alias("porte"),
                F.col("c_mktsegment").alias("segmento"),
                F.when(bal >= 0, F.round(bal).cast("int")).alias("volume_mensal"),
                F.lit(None).cast("string").alias("descricao"),
                (bal >= 0).alias("ativo"),
                ((F.col("c_custkey") % 3) != 0).alias("verificado"),
                F.lit(None).cast("timestamp").alias("data_verificacao"),
                F.col("first_order").alias("created_at"),
                F.col("first_order").alias("updated_at"),
                F.lit(None).cast("timestamp").alias("deleted_at"),
            )
        )

    @cached_property
    def _supplier_types(self) -> DataFrame:
        """One row per supplier and type of part; lines without a part count apart. Lines meet parts here only."""
        li = self._lines.join(self.raw("part").select("p_partkey", "p_type"),
                              F.col("l_partkey") == F.col("p_partkey"), "left")
        return li.groupBy("l_suppkey", "p_type", F.col("p_partkey").isNotNull().alias("has_part")).agg(
            F.sum("l_quantity").alias("qty"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))

    @cached_property
    def _supplier_lines(self) -> DataFrame:
        return self._supplier_types.groupBy("l_suppkey").agg(
            F.sum("qty").alias("total_qty"),
            F.array_sort(F.collect_set("p_type")).alias("types"),
        )

    @cached_property
    def oficinas(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        bal = F.col("s_acctbal")

        def score(mult, null_mod):
            v = (F.lit(4) + (k * mult % 61).cast("decimal(4,0)") / F.lit(10)).cast("decimal(4,2)")
            return F.when(k % 10 != null_mod, v)

        machines = F.array(F.lit("reta"), F.lit("overloque"), F.lit("galoneira"))
        return (
            s.join(self._states, s.s_nationkey == F.col("n_nationkey"), "left")
            .join(self._supplier_lines, k == F.col("l_suppkey"), "left")
            .select(
                k.alias("id"),
                F.col("s_name").alias("razao_social"),
                F.col("s_name").alias("nome_fantasia"),
                F.lpad(k.cast("string"), 14, "7").alias("cnpj"),
                F.concat(F.col("s_name"), F.lit("@Workshop.Example")).alias("email"),
                F.concat(F.lit("+55 47 "), F.lpad((k % 100000).cast("string"), 5, "0")).alias("telefone"),
                F.col("s_name").alias("responsavel"),
                F.lit(None).cast("string").alias("logo_url"),
                F.lit(None).cast("string").alias("endereco"),
                F.col("r_name").alias("cidade"),
                F.col("n_name").alias("estado"),
                F.lpad((k % 100000).cast("string"), 8, "0").alias("cep"),
                ((k % 30) + 1).cast("int").alias("num_costureiras"),
                F.round(F.col("total_qty") / F.lit(MONTHS_OF_CAPACITY)).cast("int").alias("capacidade_mensal"),
                F.col("types").alias("especialidades"),
                F.slice(machines, 1, (k % 4).cast("int")).alias("maquinario"),
                F.when(bal < 2500, "bronze").when(bal < 5000, "prata").when(bal < 7500, "ouro")
                .otherwise("diamante").alias("tier"),
                score(1, 0).alias("score_qualidade"),
                score(7, 1).alias("score_pontualidade"),
                score(13, 2).alias("score_comunicacao"),
                F.lit(None).cast("int").alias("total_avaliacoes"),
                (bal > -500).alias("ativo"),
                ((k % 2) == 0).alias("verificado"),
                F.lit(None).cast("timestamp").alias("data_verificacao"),
                _add_days_ts(F.to_timestamp(F.lit(WORKSHOP_SIGNUP_BASE)), k % 180).alias("created_at"),
                _add_days_ts(F.to_timestamp(F.lit(WORKSHOP_SIGNUP_BASE)), k % 180).alias("updated_at"),
                F.lit(None).cast("timestamp").alias("deleted_at"),
            )
        )

    @cached_property
    def eventos_plataforma(self) -> DataFrame:
        e = self.raw("events")
        ts = _add_days_ts(F.col("ts"), F.lit(-EVENT_SHIFT_DAYS))
        et = F.col("event_type")
        return e.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("usuario_id"),
            F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMddHH")).alias("session_id"),
            F.when(et == "view", "page_view").when(et == "click", "oficina_viewed")
            .when(et == "signup", "signup_completed").when(et == "purchase", "pagamento_initiated")
            .otherwise("export_data").alias("tipo"),
            F.concat(F.lit(" /"), et, F.lit(" ")).alias("pagina"),
            F.lit(None).cast("string").alias("referrer"),
            F.lit(None).cast("string").alias("entidade_tipo"),
            F.lit(None).cast("bigint").alias("entidade_id"),
            F.col("props").alias("metadata"),
            F.lit(None).cast("string").alias("ip_address"),
            F.lit(None).cast("string").alias("user_agent"),
            F.when(F.col("value") >= 5, F.when(F.col("user_id") % 3 == 0, "mobile")
                   .when(F.col("user_id") % 3 == 1, "desktop").otherwise("tablet")).alias("dispositivo"),
            ts.alias("created_at"),
        )

    @cached_property
    def usuarios(self) -> DataFrame:
        """One owner per brand (id = customer key) and per workshop (id = -supplier key - 1)."""
        ev = self.eventos_plataforma.groupBy("usuario_id").agg(
            F.max("created_at").alias("last_login"), F.count(F.lit(1)).alias("n_logins"))
        brands = self.empresas.join(ev, F.col("id") == F.col("usuario_id"), "left").select(
            F.col("id").alias("id"),
            F.lower(F.concat(F.lit("owner"), F.col("id").cast("string"), F.lit("@brand.example"))).alias("email"),
            F.col("nome_fantasia").alias("nome"),
            F.col("telefone"),
            F.lit("empresa_owner").alias("role"),
            F.col("id").alias("empresa_id"),
            F.lit(None).cast("bigint").alias("oficina_id"),
            F.col("last_login").alias("ultimo_login"),
            F.col("n_logins").cast("int").alias("login_count"),
            F.lit(True).alias("ativo"),
            F.col("created_at"), F.col("created_at").alias("updated_at"),
            F.lit(None).cast("timestamp").alias("deleted_at"),
        )
        shops = self.oficinas.select(
            (-F.col("id") - 1).alias("id"),
            F.concat(F.lit("owner"), F.col("id").cast("string"), F.lit("@workshop.example")).alias("email"),
            F.col("nome_fantasia").alias("nome"),
            F.col("telefone"),
            F.lit("oficina_owner").alias("role"),
            F.lit(None).cast("bigint").alias("empresa_id"),
            F.col("id").alias("oficina_id"),
            F.lit(None).cast("timestamp").alias("ultimo_login"),
            F.lit(None).cast("int").alias("login_count"),
            F.lit(True).alias("ativo"),
            F.col("created_at"), F.col("created_at").alias("updated_at"),
            F.lit(None).cast("timestamp").alias("deleted_at"),
        )
        return brands.unionByName(shops)

    @cached_property
    def pedidos(self) -> DataFrame:
        o = self.by_order("orders").join(self._order_lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
        status = (F.when(st == "F", "finalizado").when(st == "O", "publicado")
                  .when(pr == "5-LOW", "cancelado").otherwise("em_producao"))
        pub = F.when(~((st == "O") & (pr == "1-URGENT")), _add_hours(F.col("o_orderdate"), F.col("o_orderkey") % 48))
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("PED-"), F.year("o_orderdate").cast("string"), F.lit("-"),
                     F.format_string("%07d", F.col("o_orderkey"))).alias("codigo"),
            F.col("o_custkey").alias("empresa_id"),
            F.when(st != "O", F.col("first_supp")).alias("oficina_id"),
            F.concat(F.lit(" Pedido "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("titulo"),
            F.lit(None).cast("string").alias("descricao"),
            (F.col("o_orderkey") % 25).alias("categoria_id"),
            F.coalesce(F.col("qty"), F.lit(0.0)).cast("int").alias("quantidade_total"),
            F.lit(None).cast("string").alias("unidade"),
            F.col("est").cast(MONEY).alias("valor_estimado"),
            F.when(st != "O", F.col("o_totalprice").cast(MONEY)).alias("valor_final"),
            F.lit("BRL").alias("moeda"),
            pub.alias("data_publicacao"),
            _add_days_ts(pub, F.lit(7)).alias("data_limite_propostas"),
            F.date_add(F.to_date("o_orderdate"), 60).alias("prazo_entrega"),
            F.when(st == "F", F.to_date("last_ship")).alias("data_entrega_real"),
            status.alias("status"),
            F.substring(pr, 1, 1).cast("smallint").alias("prioridade"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
            F.lit(None).cast("timestamp").alias("deleted_at"),
            # carried for the payment binding only (not a source column of the model)
            F.col("max_tax").alias("_max_tax"),
            F.col("last_ship").alias("_last_ship"),
        )

    @cached_property
    def pedido_items(self) -> DataFrame:
        li = self._lines.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
        size = F.col("p_size")
        return li.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("l_orderkey").alias("pedido_id"),
            F.concat(F.lit(" "), F.col("p_name")).alias("descricao"),
            F.col("l_quantity").cast("int").alias("quantidade"),
            F.when(size <= 10, " p").when(size <= 20, "m ").when(size <= 30, "g").when(size <= 40, "gg")
            .alias("tamanho"),
            F.col("p_brand").alias("cor"),
            F.col("p_type").alias("material"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("valor_unitario"),
            F.lit(None).cast("string").alias("observacoes"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def propostas(self) -> DataFrame:
        bids = self._lines_by_order.groupBy("l_orderkey", "l_suppkey").agg(
            F.sum(F.col("ext") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).alias("valor"),
            F.min("l_linenumber").alias("first_line"),
            F.max("l_shipdate").alias("last_ship"),
        )
        p = self.pedidos.select(F.col("id").alias("p_id"), F.col("oficina_id").alias("p_oficina"),
                                F.col("created_at").alias("p_created"), "status")
        b = bids.join(p, F.col("l_orderkey") == F.col("p_id"))
        status = (F.when(F.col("l_suppkey") == F.col("p_oficina"), "aceita")
                  .when(F.col("status") == "publicado", "enviada").otherwise("recusada"))
        created = _add_hours(F.col("p_created"), F.col("first_line") * 6)
        return b.select(
            F.concat_ws("-", "l_orderkey", "l_suppkey").alias("id"),
            F.col("l_orderkey").alias("pedido_id"),
            F.col("l_suppkey").alias("oficina_id"),
            F.col("valor").cast(MONEY).alias("valor_proposto"),
            F.to_date("last_ship").alias("prazo_proposto"),
            F.lit(None).cast("string").alias("descricao"),
            F.lit(None).cast("string").alias("condicoes"),
            status.alias("status"),
            F.when(status != "enviada", _add_hours(created, F.col("l_suppkey") % 72)).alias("data_resposta"),
            F.when(status == "recusada", "preco").alias("motivo_recusa"),
            created.alias("created_at"),
            created.alias("updated_at"),
        )

    @cached_property
    def producao(self) -> DataFrame:
        o = self.by_order("orders").select("o_orderkey", "o_orderdate")
        li = self._lines_by_order.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        qty = F.col("l_quantity").cast("int")
        rejected = F.col("l_returnflag") == "R"
        done = F.col("l_linestatus") == "F"
        return li.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("l_orderkey").alias("pedido_id"),
            F.col("l_suppkey").alias("oficina_id"),
            F.when(done, "expedido").otherwise("em_costura").alias("status"),
            F.when(done, F.lit(100)).otherwise(F.lit(50)).cast("decimal(5,2)").alias("percentual_concluido"),
            qty.alias("quantidade_produzida"),
            F.when(rejected, F.lit(0)).otherwise(qty).alias("quantidade_aprovada"),
            F.when(rejected, qty).otherwise(F.lit(0)).alias("quantidade_rejeitada"),
            F.col("o_orderdate").alias("data_inicio"),
            F.date_add(F.to_date("o_orderdate"), 60).alias("data_previsao"),
            F.when(done, F.col("l_shipdate")).alias("data_conclusao"),
            F.lit(None).cast("string").alias("observacoes_qualidade"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
        )

    @cached_property
    def avaliacoes(self) -> DataFrame:
        o = self.by_order("orders").select("o_orderkey", "o_custkey")
        li = (self._lines_by_order.where(F.col("l_returnflag").isin("A", "R"))
              .join(o, F.col("l_orderkey") == F.col("o_orderkey")))
        tax = F.round(F.col("l_tax") * 100).cast("int")
        disc = F.round(F.col("l_discount") * 100).cast("int")
        taxed = F.col("l_tax") != 0
        return li.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("l_orderkey").alias("pedido_id"),
            F.col("o_custkey").alias("avaliador_id"),
            F.lit(None).cast("bigint").alias("avaliado_empresa_id"),
            F.col("l_suppkey").alias("avaliado_oficina_id"),
            (F.lit(1) + disc % 5).cast("smallint").alias("nota_geral"),
            F.when(taxed, F.lit(1) + tax % 5).cast("smallint").alias("nota_qualidade"),
            (F.lit(1) + F.col("l_quantity").cast("int") % 5).cast("smallint").alias("nota_pontualidade"),
            F.when(taxed, F.lit(1) + (tax + F.col("l_linenumber")) % 5).cast("smallint").alias("nota_comunicacao"),
            F.when(F.col("l_linenumber") % 2 == 1, F.lit(1) + F.col("l_linenumber") % 5)
            .cast("smallint").alias("nota_custo_beneficio"),
            F.when(F.col("l_returnflag") == "R", "devolvido").alias("comentario"),
            F.lit(True).alias("publica"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def certificacoes(self) -> DataFrame:
        g = self._supplier_types.where("has_part")
        word = F.split(F.col("p_type"), " ").getItem(0)
        tipo = (F.when(word == "STANDARD", "abvtex").when(word == "ECONOMY", "bsci")
                .when(word == "MEDIUM", "iso9001").when(word == "SMALL", "nbcu")
                .when(word == "LARGE", "disney").when(word == "PROMO", "outras").otherwise("gots"))
        return g.select(
            F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("p_type")).alias("id"),
            F.col("l_suppkey").alias("oficina_id"),
            tipo.alias("tipo"),
            F.concat(F.lit(" "), F.col("p_type")).alias("nome"),
            F.lit(None).cast("string").alias("entidade_emissora"),
            F.lit(None).cast("string").alias("numero_certificado"),
            F.to_date("first_ship").alias("data_emissao"),
            F.when(word != "PROMO", F.date_add(F.to_date("last_ship"), 30)).alias("data_validade"),
            F.lit(True).alias("ativo"),
            F.lit(True).alias("verificado"),
            F.lit(None).cast("timestamp").alias("data_verificacao"),
            F.col("first_ship").alias("created_at"),
            F.col("last_ship").alias("updated_at"),
        )

    @cached_property
    def pagamentos(self) -> DataFrame:
        p = self.pedidos.where(F.col("status") == "finalizado")
        k = F.col("id")
        rate = ((F.lit(6) + F.coalesce(F.round(F.col("_max_tax") * 100).cast("int"), F.lit(0)))
                .cast("decimal(4,0)") * F.lit(0.01).cast("decimal(2,2)"))
        fee = (F.col("valor_final") * rate).cast(MONEY)
        status = F.when(k % 20 == 7, "estornado").when(k % 20 == 13, "pendente").otherwise("pago")
        method = F.element_at(F.array(*[F.lit(m) for m in PAYMENT_METHODS]), (k % 4 + 1).cast("int"))
        created = F.coalesce(F.col("_last_ship"), F.col("created_at"))
        return p.select(
            k.alias("id"),
            k.alias("pedido_id"),
            F.col("empresa_id"),
            F.col("oficina_id"),
            F.col("valor_final").alias("valor_bruto"),
            fee.alias("taxa_plataforma"),
            (F.col("valor_final") - fee).cast(MONEY).alias("valor_liquido"),
            (rate * 100).cast("decimal(5,2)").alias("percentual_taxa"),
            method.alias("metodo"),
            status.alias("status"),
            F.lit(None).cast("string").alias("referencia_externa"),
            F.date_add(F.to_date("_last_ship"), 30).alias("data_vencimento"),
            F.when(status == "pago", _add_days_ts(F.col("_last_ship"), k % 20)).alias("data_pagamento"),
            created.alias("created_at"),
            created.alias("updated_at"),
        )

    @cached_property
    def mensagens(self) -> DataFrame:
        """A conversation belongs to the order with its number: user turns are the brand's messages to the matched
        workshop, assistant turns the answers. Every other message has been read, an hour later."""
        c = self.raw("conversations").where(F.col("role").isin("user", "assistant"))
        p = self.pedidos.where(F.col("oficina_id").isNotNull()).select(
            F.col("id").alias("pedido_id"), F.col("empresa_id").alias("_brand"), (-F.col("oficina_id") - 1).alias("_shop"), F.col("created_at").alias("_t"))
        sent = F.timestamp_micros(F.unix_micros("_t") + F.col("turn") * 3_600_000_000)
        asks, read = F.col("role") == "user", F.col("turn") % 2 == 0
        return c.join(p, c.conv_id == p.pedido_id).select(
            F.concat_ws("-", "conv_id", "turn").alias("id"),
            F.when(asks, F.col("_brand")).otherwise(F.col("_shop")).alias("remetente_id"),
            F.when(asks, F.col("_shop")).otherwise(F.col("_brand")).alias("destinatario_id"),
            "pedido_id", F.col("text").alias("conteudo"), read.alias("lida"),
            F.when(read, F.timestamp_micros(F.unix_micros(sent) + 3_600_000_000)).alias("data_leitura"), sent.alias("created_at"))

    @cached_property
    def notificacoes(self) -> DataFrame:
        """The brand hears of each matched order, the workshop of each payment."""
        def note(df: DataFrame, kind: str, user, entity: str, title: str, channel: str) -> DataFrame:
            read = F.col("id") % 3 != 0
            return df.select(
                F.concat_ws("-", F.lit(kind), F.col("id").cast("string")).alias("id"), user.alias("usuario_id"), F.lit(title).alias("titulo"),
                F.concat_ws(" ", F.lit(title), F.col("id").cast("string")).alias("conteudo"), F.lit(kind).alias("tipo"), F.lit(channel).alias("canal"),
                F.lit(entity).alias("entidade_tipo"), F.col("id").alias("entidade_id"), read.alias("lida"),
                F.when(read, _add_days_ts(F.col("created_at"), F.lit(1))).alias("data_leitura"), "created_at")

        matched = note(self.pedidos.where(F.col("oficina_id").isNotNull()), "pedido_update", F.col("empresa_id"), "pedido", "Pedido atualizado", "plataforma")
        paid = note(self.pagamentos.where(F.col("oficina_id").isNotNull()), "pagamento", -F.col("oficina_id") - 1, "pagamento", "Pagamento registrado", "email")
        return matched.unionByName(paid)


def bind(spark: SparkSession, sf_dir: str, as_of: str) -> Marketplace:
    """The source tables of ``sf_dir``; ``as_of`` is the job's "now"."""
    return Marketplace(spark, sf_dir, as_of)


# Source tables in foreign-key order (parents before children).
SOURCE_TABLES = ["categorias_produto", "empresas", "oficinas", "eventos_plataforma", "usuarios", "pedidos",
                 "pedido_items", "propostas", "producao", "avaliacoes", "certificacoes", "pagamentos", "mensagens", "notificacoes"]


#: Written tables that are bucketed by the key of an order: what meets by order meets without a shuffle.
ORDER_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "pedidos": "id", "propostas": "pedido_id", "producao": "pedido_id",
              "avaliacoes": "pedido_id", "pagamentos": "pedido_id"}
BUCKET_BYTES = 8 << 20  # of lineitem
FEW_BUCKETS, FEW_BYTES = 32, 1 << 20  # small inputs: up to so many buckets of at least so many bytes


class PublishedMarketplace(Marketplace):
    """Source tables that are written once each, when a query first asks for one, and read from there after.

    A table derives from its parents as written (payments from the written orders, and so on). Only the tables that
    queries need are ever written. A table is handed out after its write has committed.

    Orders and lines are shuffled by order key once, into buckets whose number follows the bytes of lineitem; the tables
    that belong to an order are derived within the buckets and written as the same buckets (``ORDER_KEYS``)."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str, path: str):
        super().__init__(spark, sf_dir, as_of)
        self.published_path = path
        self._written: dict[str, DataFrame] = {}

    @cached_property
    def buckets(self) -> int:
        size = table_bytes(self.spark, self.sf_dir, "lineitem")
        return max(1, min(FEW_BUCKETS, -(-size // FEW_BYTES)), -(-size // BUCKET_BYTES))

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        path, key = f"{self.published_path}/{name}", ORDER_KEYS.get(name)
        w = df.write.mode("overwrite").options(**STORED)
        if key is None:
            w.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        table = f"loomstat_{self.published_path.rsplit('/', 1)[-1]}_{name}".replace("-", "_")  # buckets are known to the catalog only
        w.bucketBy(self.buckets, key).sortBy(key).option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def by_order(self, name: str) -> DataFrame:
        if name not in self._written:
            self._written[name] = self._store(name, self.raw(name).repartition(self.buckets, ORDER_KEYS[name]))
        return self._written[name]

    def in_buckets(self, name: str) -> bool:
        return name in ORDER_KEYS

    def table(self, name: str) -> DataFrame:
        if name not in self._written:
            self._written[name] = self._store(name, Marketplace.__dict__[name].func(self))
        return self._written[name]

    @property
    def _supplier_types(self) -> DataFrame:
        """Written once for workshops and certificates: beyond a broadcast of parts, lines move by part once."""
        if "supplier_types" not in self._written:
            self._written["supplier_types"] = self._store("supplier_types", Marketplace.__dict__["_supplier_types"].func(self))
        return self._written["supplier_types"]

    def path_of(self, name: str) -> str:
        """Folder of a written source table."""
        self.table(name)
        return f"{self.published_path}/{name}"

    def sibling(self) -> PublishedMarketplace:
        """The same written source tables without any written model."""
        other = PublishedMarketplace(self.spark, self.sf_dir, self.as_of, self.published_path)
        other._written = self._written
        return other

    def publish_all(self) -> PublishedMarketplace:
        for name in SOURCE_TABLES:
            self.table(name)
        return self


for _name in SOURCE_TABLES:
    setattr(PublishedMarketplace, _name, property(lambda self, n=_name: self.table(n)))
