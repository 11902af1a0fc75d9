"""Build the models in dependency order and publish them.

Each model declares the models it reads; the order is derived (topological sort), not
written by hand. Every model is registered as a temporary view; with ``out_dir`` it is
also written as Parquet (marts with a month column partitioned by it), and the models
after it and the reports read the written table. The run stops at the first error.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomstat.operators import intermediate as I
from loomstat.operators import marts as M
from loomstat.operators import staging as S
from loomstat.sources import io
from loomstat.sources.binding import Marketplace


@dataclass(frozen=True)
class Model:
    name: str
    build: Callable[[Marketplace], DataFrame]
    deps: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()  # source tables that it reads itself
    month: str | None = None  # time column whose months are published one by one


MODELS = [
    Model("stg_empresas", S.stg_empresas, reads=("empresas",)), Model("stg_oficinas", S.stg_oficinas, reads=("oficinas",)),
    Model("stg_usuarios", S.stg_usuarios, reads=("usuarios",)), Model("stg_pedidos", S.stg_pedidos, reads=("pedidos",), month="dt_criacao"),
    Model("stg_pedido_items", S.stg_pedido_items, reads=("pedido_items",)), Model("stg_propostas", S.stg_propostas, reads=("propostas",)),
    Model("stg_producao", S.stg_producao, reads=("producao",)), Model("stg_avaliacoes", S.stg_avaliacoes, reads=("avaliacoes",)),
    Model("stg_certificacoes", S.stg_certificacoes, reads=("certificacoes",)), Model("stg_pagamentos", S.stg_pagamentos, reads=("pagamentos",)),
    Model("stg_eventos_plataforma", S.stg_eventos_plataforma, reads=("eventos_plataforma",)),
    Model("int_pedidos_enriched", I.int_pedidos_enriched,
          ("stg_pedidos", "stg_empresas", "stg_oficinas", "stg_pagamentos", "stg_propostas"),
          reads=("categorias_produto",), month="dt_criacao"),
    Model("int_oficina_performance", I.int_oficina_performance,
          ("stg_oficinas", "stg_pedidos", "stg_propostas", "stg_producao", "stg_avaliacoes", "stg_certificacoes")),
    Model("int_empresa_activity", I.int_empresa_activity,
          ("stg_empresas", "stg_pedidos", "stg_usuarios", "stg_eventos_plataforma")),
    Model("int_funnel_stages", I.int_funnel_stages, ("int_empresa_activity", "stg_pedidos")),
    Model("int_match_pairs", I.int_match_pairs, ("stg_pedidos", "stg_empresas", "stg_oficinas", "stg_avaliacoes"), month="dt_match"),
    Model("int_daily_platform_snapshot", I.int_daily_platform_snapshot,
          ("stg_pedidos", "stg_usuarios", "stg_pagamentos", "stg_propostas", "stg_eventos_plataforma"), month="dia"),
    Model("marts_platform_kpis", M.marts_platform_kpis, ("int_daily_platform_snapshot", "stg_pedidos", "stg_propostas"),
          ("mes",), month="mes"),
    Model("marts_customer_journey", M.marts_customer_journey, ("int_funnel_stages",)),
    Model("marts_cohort_analysis", M.marts_cohort_analysis, ("stg_empresas", "stg_pedidos")),
    Model("marts_oficina_scoring", M.marts_oficina_scoring, ("int_oficina_performance",)),
    Model("marts_empresa_clv", M.marts_empresa_clv, ("stg_pedidos", "stg_empresas")),
    Model("marts_match_quality", M.marts_match_quality, ("int_match_pairs",)),
    Model("marts_revenue_analytics", M.marts_revenue_analytics, ("stg_pagamentos", "stg_usuarios"), ("mes",), month="mes"),
    Model("marts_geographic_analysis", M.marts_geographic_analysis,
          ("stg_empresas", "stg_pedidos", "stg_oficinas", "stg_certificacoes")),
    Model("v_platform_summary", M.v_platform_summary, reads=("empresas", "oficinas", "pedidos", "pagamentos")),
]
BY_NAME = {m.name: m for m in MODELS}


def build_order(only: list[str] | None = None) -> list[str]:
    """Topological order of the requested models and everything they depend on."""
    order: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if state.get(name) == 2:
            return
        if state.get(name) == 1:
            raise ValueError(f"dependency cycle at {name}")
        state[name] = 1
        for d in BY_NAME[name].deps:
            visit(d)
        state[name] = 2
        order.append(name)

    for name in (only or [m.name for m in MODELS]):
        visit(name)
    return order


class QualityGate(RuntimeError):
    """The loaded source tables miss rows or hold orphans."""


def check_load(m: Marketplace) -> None:
    """Q1 and Q2 as a gate: raise if a source table has fewer rows than its input asks for, or a foreign key dangles."""
    from loomstat.operators import quality as Q

    short = Q.row_counts(m).where("NOT passed").select("table_name").collect()  # at most a row a table
    orphans = Q.referential_integrity(m).where("violations > 0").select("rule").collect()  # at most a row a key
    if short or orphans:
        raise QualityGate(f"incomplete tables {[r[0] for r in short]}, orphans {[r[0] for r in orphans]}")


def write_model(m: Marketplace, name: str, path: str) -> DataFrame:
    """Build one model, write it (partitioned by month where it says so) and let later models read the written table."""
    model = BY_NAME[name]
    df = model.build(m)
    io.publish(df, path, list(model.partition_by))
    # a month is read back from its folder name; the columns keep their order
    m.models[name] = m.spark.read.schema(df.schema).parquet(path).select(*df.columns)
    return m.models[name]


def run_all(m: Marketplace, out_dir: str | None = None, only: list[str] | None = None, gate: bool = True,
            keep: int = 2) -> list[tuple[str, str]]:
    """Build models in dependency order and register them as views. With ``out_dir`` the load is checked (Q1, Q2), every
    model is written to a new run folder and read from there by the models after it, and only when all are written the
    pointer file moves to the run; readers of the old run are not disturbed. Runs before the last ``keep`` are removed.
    Stops at the first error and re-raises it with the model's name."""
    import uuid

    if out_dir and gate:
        check_load(m)
    run = f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
    done = []
    for name in build_order(only):
        try:
            df = write_model(m, name, f"{out_dir.rstrip('/')}/runs/{run}/{name}") if out_dir else BY_NAME[name].build(m)
            df.createOrReplaceTempView(name)
        except Exception as exc:  # stop on the first failing model
            raise RuntimeError(f"model {name} failed: {exc}") from exc
        done.append((name, "published" if out_dir else "view"))
    if out_dir:
        _point(m.spark, out_dir.rstrip("/"), run, keep)
    return done


def _point(spark: SparkSession, out_dir: str, run: str, keep: int) -> None:
    """Move the pointer ``current`` to ``run`` (written aside, then renamed) and remove old runs."""
    jvm = spark._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{p}")
    fs = path("runs").getFileSystem(spark._jsc.hadoopConfiguration())
    aside = path(f"current-{run}")
    out = fs.create(aside, True)
    out.write(run.encode())
    out.close()
    fs.delete(path("current"), False)
    fs.rename(aside, path("current"))
    runs = sorted(f.getPath().getName() for f in fs.listStatus(path("runs")))
    for old in runs[:-keep]:
        fs.delete(path(f"runs/{old}"), True)


def published(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A model of the run that the pointer names."""
    run = spark.read.text(f"{out_dir.rstrip('/')}/current").first()[0]
    return spark.read.parquet(f"{out_dir.rstrip('/')}/runs/{run}/{name}")
