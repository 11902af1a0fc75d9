"""Optimal one-to-one assignment of open orders and available workshops.

The total of the rounded compatibility scores (G1) is maximised; as many pairs are made as the smaller side allows.

Scores are integers in units of 0.0001. The workshop-only part enters rounded to a unit, and every bonus (geo, capacity) is
a whole number of units, so ``score(order, workshop) = b(workshop) + bonus(profile, class)`` holds exactly. An order counts
only through its profile (state, quantity); a workshop through its class (state, capacity range) and b, where the ranges
are cut at the capacities at which the band of some quantity changes. Orders of a profile and workshops of a class with the
same b are interchangeable, so the assignment is a transportation problem between groups:

* with no more workshops than orders every workshop is used, the sum of b is fixed, and classes are shipped to profiles;
* with more workshops, profiles are shipped to groups (class, b).

Spark groups the rows, ``transport`` solves the reduced problem, Spark expands the flows to members: orders are numbered
inside their profile by id, workshops inside their group by descending b, then id, and slots join both sides on equal keys.
No order x workshop product is formed.

The reduced problem is bounded by states x distinct quantities and states x capacity ranges (at most four and one for each
distinct quantity) x distinct b, whatever the number of orders and workshops. It is brought to the driver; more than
``MOST_GROUPS`` groups on a side raise an error instead. ``transport`` keeps one vector of prices; the value of a group
for all partners is computed when the search visits it, so no matrix is held. Its prices prove the total:
``Solution.bound``, the dual value, equals the primal total.

Ties: any optimum has the same total; the one returned depends on the groups' order (state, quantity, capacity) only.
Missing states count as no affinity, missing capacities as zero, missing or zero quantities as 100 pieces (as in G1/G2).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.ranks import grouped_row_number
from loomstat.operators.matching import WEIGHTS, workshop_terms

UNITS = 10_000
MOST_GROUPS = 2_000_000
# Bonus units of the geo levels (same state, same region, other) and of the capacity bands.
GEO = (2000, 1600, 1000)
CAPACITY = {"none": 0, "tiny": 600, "small": 1050, "best": 1500, "full": 1050, "over": 300}


def capacity_units(quantity: np.ndarray, capacity: int) -> np.ndarray:
    """Bonus units of a capacity for quantities, by whole-number comparisons that equal the bands of ``capacity_score``."""
    if capacity <= 0:
        return np.full(len(quantity), CAPACITY["none"])
    q = quantity
    return np.select([10 * q <= capacity, 10 * q <= 3 * capacity, 10 * q <= 7 * capacity, q <= capacity],
                     [CAPACITY["tiny"], CAPACITY["small"], CAPACITY["best"], CAPACITY["full"]], CAPACITY["over"])


def capacity_edges(quantities: np.ndarray) -> np.ndarray:
    """Capacities at which the band of some quantity changes; inside [edge, next edge) all bands are constant."""
    q = np.unique(quantities.astype(np.int64))
    return np.unique(np.r_[1, q, -(-10 * q // 7), -(-10 * q // 3), 10 * q])


# ---------------------------------------------------------------- reduced problem


@dataclass
class Solution:
    """Flows (row, column) -> units, the total value, and the dual value that bounds any total from above."""

    flows: dict[tuple[int, int], int]
    total: int
    bound: int
    visits: int = field(default=0, compare=False)


def transport(supply: np.ndarray, capacity: np.ndarray, value: Callable[[int], np.ndarray]) -> Solution:
    """Ship every row's supply to columns with enough joint capacity at the largest total value.

    Shortest augmenting paths with prices: rows enter one after another; a search runs over reduced costs
    ``u[row] + price[column] - value`` (never negative, zero where something flows) until it meets a column with room, then
    prices move by what the search learnt and as much as the path allows is shipped."""
    if supply.sum() > capacity.sum():
        raise ValueError("more supply than capacity")
    free, price = capacity.astype(np.int64).copy(), np.zeros(len(capacity), np.int64)
    u = np.zeros(len(supply), np.int64)
    users: list[dict[int, int]] = [{} for _ in range(len(capacity))]  # column -> row -> units
    far, visits = np.iinfo(np.int64).max // 4, 0
    for start in range(len(supply)):
        left = int(supply[start])
        if left:
            u[start] = int((value(start) - price).max())
        while left:
            dist, prev = np.full(len(capacity), far), np.full(len(capacity), -1)
            done = np.zeros(len(capacity), bool)
            seen, via, waiting = {start: 0}, {}, [start]
            while True:
                for row in waiting:
                    visits += 1
                    cost = seen[row] + u[row] + price - value(row)
                    better = (cost < dist) & ~done
                    dist[better] = cost[better]
                    prev[better] = row
                open_ = np.where(done, far, dist)
                least = int(open_.min())
                at_least = np.flatnonzero(open_ == least)
                with_room = at_least[free[at_least] > 0]
                if len(with_room):
                    end = int(with_room[0])
                    break
                waiting = []
                for col in at_least:  # all full columns at this distance
                    done[col] = True
                    for row in users[col]:
                        if row not in seen:
                            seen[row], via[row] = least, int(col)
                            waiting.append(row)
            for row, d in seen.items():
                u[row] -= least - d
            price[done] += least - dist[done]
            path, units, col = [], min(left, int(free[end])), end
            while True:
                row = int(prev[col])
                path.append((row, col))
                if row == start:
                    break
                col = via[row]
                units = min(units, users[col][row])
            for k, (row, col) in enumerate(path):
                users[col][row] = users[col].get(row, 0) + units
                if k + 1 < len(path):
                    back = users[via[row]]
                    back[row] -= units
                    if not back[row]:
                        del back[row]
            free[end] -= units
            left -= units
    flows = {(row, col): n for col, held in enumerate(users) for row, n in held.items()}
    by_row: dict[int, list[tuple[int, int]]] = {}
    for (row, col), n in flows.items():
        by_row.setdefault(row, []).append((col, n))
    total = 0
    for row, held in by_row.items():
        v = value(row)
        total += sum(int(v[col]) * n for col, n in held)
    return Solution(flows, total, int((u * supply).sum() + (price * capacity).sum()), visits)


class Bonus:
    """Bonus units between profiles (state, quantity) and classes (state, capacity), as vectors over one side."""

    def __init__(self, region: dict[str, str]):
        self.region = region

    def geo(self, state: str, others: np.ndarray, regions: np.ndarray) -> np.ndarray:
        """Units of one state for others; empty is missing."""
        mine = self.region.get(state)
        same_region = (regions == mine) if mine is not None else np.zeros(len(others), bool)
        return np.where((others == "") | (state == ""), GEO[2], np.where(others == state, GEO[0], np.where(same_region, GEO[1], GEO[2])))

    def regions(self, states: np.ndarray) -> np.ndarray:
        return np.array([self.region.get(s, "\0none") for s in states], object)

    def of_class(self, profiles: pd.DataFrame) -> Callable[[str, int], np.ndarray]:
        """(state, capacity) of a class -> units for every profile."""
        states, quantity = profiles["state"].to_numpy(object), profiles["quantity"].to_numpy(np.int64)
        regions, by_state, by_capacity = self.regions(states), {}, {}
        distinct, place = np.unique(quantity, return_inverse=True)

        def units(state: str, capacity: int) -> np.ndarray:
            if state not in by_state:
                by_state[state] = self.geo(state, states, regions)
            if capacity not in by_capacity:
                by_capacity[capacity] = capacity_units(distinct, capacity)
            return by_state[state] + by_capacity[capacity][place]

        return units

    def of_profile(self, classes: pd.DataFrame) -> Callable[[str, int], np.ndarray]:
        """(state, quantity) of a profile -> units for every class."""
        states, capacity = classes["state"].to_numpy(object), classes["capacity"].to_numpy(np.int64)
        regions, by_state = self.regions(states), {}
        distinct, place = np.unique(capacity, return_inverse=True)

        def units(state: str, quantity: int) -> np.ndarray:
            if state not in by_state:
                by_state[state] = self.geo(state, states, regions)
            q = np.array([quantity])
            return by_state[state] + np.array([capacity_units(q, int(c))[0] for c in distinct], np.int64)[place]

        return units


def solve(profiles: pd.DataFrame, workshops: pd.DataFrame, region: dict[str, str]) -> tuple[pd.DataFrame, Solution]:
    """Flows (state, quantity, w_state, capacity, b, n) from profiles (state, quantity, n) and workshop groups
    (state, capacity, b, n). Where all workshops are used, the flow of a class is dealt to its groups by descending b."""
    bonus = Bonus(region)
    out = []
    if workshops["n"].sum() <= profiles["n"].sum():
        classes = workshops.groupby(["state", "capacity"], as_index=False)["n"].sum()
        vector = bonus.of_class(profiles)
        keys = list(zip(classes["state"], classes["capacity"], strict=True))
        got = transport(classes["n"].to_numpy(), profiles["n"].to_numpy(), lambda i: vector(*keys[i]))
        members = {k: [[b, n] for b, n in zip(g["b"], g["n"], strict=True)]
                   for k, g in workshops.sort_values("b", ascending=False).groupby(["state", "capacity"])}
        for (i, j), n in sorted(got.flows.items()):
            while n:
                b, held = members[keys[i]][0]
                take = min(n, held)
                out.append((*profiles.iloc[j][["state", "quantity"]], *keys[i], b, take))
                n -= take
                members[keys[i]][0][1] -= take
                if held == take:
                    members[keys[i]].pop(0)
        fixed = int((workshops["b"] * workshops["n"]).sum())
        got = Solution(got.flows, got.total + fixed, got.bound + fixed, got.visits)
    else:
        vector, b = bonus.of_profile(workshops), workshops["b"].to_numpy(np.int64)
        keys = list(zip(profiles["state"], profiles["quantity"], strict=True))
        got = transport(profiles["n"].to_numpy(), workshops["n"].to_numpy(), lambda i: vector(*keys[i]) + b)
        for (i, j), n in sorted(got.flows.items()):
            out.append((*keys[i], *workshops.iloc[j][["state", "capacity", "b"]], n))
    return pd.DataFrame(out, columns=["state", "quantity", "w_state", "capacity", "b", "n"]), got


# ---------------------------------------------------------------- Spark


def _collected(groups: DataFrame, what: str) -> pd.DataFrame:
    got = groups.limit(MOST_GROUPS + 1).toPandas()
    if len(got) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} {what}")
    return got.sort_values(list(got.columns[:-1])).reset_index(drop=True)


def _edges_of(edges: np.ndarray):  # noqa: ANN202
    lowest = np.r_[0, edges]

    @F.pandas_udf("long")
    def edge(capacity: pd.Series) -> pd.Series:
        return pd.Series(lowest[np.searchsorted(edges, capacity.to_numpy(np.int64), side="right")])

    return edge


def _ranks(groups: pd.DataFrame, region: dict[str, str]):  # noqa: ANN202
    """Rows (state, quantity, scores) -> (state, quantity, units, rank): one and the workshops with a larger score."""

    def rank(rows):  # noqa: ANN001, ANN202
        vector, b, n = Bonus(region).of_profile(groups), groups["b"].to_numpy(np.int64), groups["n"].to_numpy(np.int64)
        for batch in rows:
            for state, quantity, scores in zip(batch["state"], batch["quantity"], batch["scores"], strict=True):
                all_units = vector(state, int(quantity)) + b
                order = np.argsort(all_units)
                below = np.r_[0, np.cumsum(n[order])]
                scores = np.asarray(scores, np.int64)
                better = below[-1] - below[np.searchsorted(all_units[order], scores, side="right")]
                yield pd.DataFrame({"state": state, "quantity": quantity, "units": scores, "rank_in_available": better + 1})

    return rank


def _groups(orders: DataFrame, supply: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders with (state, quantity) and workshops with (w_state, c, b)."""
    qty = F.when(F.coalesce(F.col("quantidade_total"), F.lit(0)) == 0, F.lit(100)).otherwise(F.col("quantidade_total"))
    o = orders.select("pedido_id", F.coalesce("empresa_estado", F.lit("")).alias("state"), qty.cast("long").alias("quantity"))
    terms = workshop_terms(supply)
    b = sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items() if k in ("quality", "punctuality", "speed")), F.lit(0.0))
    w = terms.select("oficina_id", F.coalesce("estado", F.lit("")).alias("w_state"),
                     F.coalesce(F.col("capacidade_mensal_pecas"), F.lit(0)).cast("long").alias("c"), F.round(b * UNITS).cast("long").alias("b"))
    return o, w


def optimal_assignment(orders: DataFrame, supply: DataFrame, regions: DataFrame) -> DataFrame:
    """(pedido_id, oficina_id_optimal, compatibility_score, rank_in_available), one row per assigned order.

    The rank is one and the number of available workshops with a larger score for the order."""
    spark = orders.sparkSession
    o, w = _groups(orders, supply)
    w = w.checkpoint()  # its normalisation reads the supply once more; used three times below
    profiles = _collected(o.groupBy("state", "quantity").agg(F.count(F.lit(1)).alias("n")), "order profiles")
    region = {r[0]: r[1] for r in regions.select("estado", "region").collect()}  # one row a state
    edge = _edges_of(capacity_edges(profiles["quantity"].to_numpy(np.int64)) if len(profiles) else np.array([1]))
    w = w.withColumn("capacity", edge("c"))
    groups = _collected(w.groupBy(F.col("w_state").alias("state"), "capacity", "b").agg(F.count(F.lit(1)).alias("n")), "workshop groups")
    schema = "state string, quantity long, w_state string, capacity long, b long, n long"
    if not len(profiles) or not len(groups):
        flows = pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
    else:
        flows, got = solve(profiles, groups, region)
        if got.total != got.bound:
            raise ArithmeticError(f"assignment of {got.total} units below its bound {got.bound}")
    p_key, w_key = ["state", "quantity"], ["w_state", "capacity", "b"]
    for keys, name in ((p_key, "p_off"), (w_key, "w_off")):
        flows[name] = flows.groupby(keys)["n"].cumsum() - flows["n"] if len(flows) else []
    rows = [tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in flows.itertuples(index=False)]
    slots = (spark.createDataFrame(rows, schema + ", p_off long, w_off long").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
             .select(*p_key, *w_key, (F.col("p_off") + F.col("i")).alias("p_rank"), (F.col("w_off") + F.col("i")).alias("w_rank")))
    asked = spark.createDataFrame(sorted({r[:2] for r in rows}), "state string, quantity long")
    p_ranked = grouped_row_number(o.join(asked, p_key, "left_semi"), p_key, [F.col("pedido_id")], "p_rank")
    w_ranked = grouped_row_number(w.select("oficina_id", *w_key), w_key, [F.col("oficina_id")], "w_rank")
    made = slots.join(p_ranked, [*p_key, "p_rank"]).join(w_ranked, [*w_key, "w_rank"])
    bonus_geo, bonus_cap = _bonus_columns(regions)
    made = bonus_geo(made).withColumn("units", F.col("b") + F.col("geo") + bonus_cap).select("pedido_id", "oficina_id", *p_key, "units")
    scores = made.groupBy(*p_key).agg(F.collect_set("units").alias("scores"))
    ranks = scores.mapInPandas(_ranks(groups, region), "state string, quantity long, units long, rank_in_available long")
    return made.join(ranks, [*p_key, "units"]).select(
        "pedido_id", F.col("oficina_id").alias("oficina_id_optimal"), (F.col("units") / UNITS).alias("compatibility_score"), "rank_in_available")


def _bonus_columns(regions: DataFrame):  # noqa: ANN202
    """The same bonus as columns over (state, quantity, w_state, capacity)."""
    def geo(made: DataFrame) -> DataFrame:
        one = regions.select(F.col("estado").alias("state"), F.col("region").alias("_r1"))
        two = regions.select(F.col("estado").alias("w_state"), F.col("region").alias("_r2"))
        j = made.join(one, "state", "left").join(two, "w_state", "left")
        near = (F.when((F.col("state") == "") | (F.col("w_state") == ""), GEO[2]).when(F.col("state") == F.col("w_state"), GEO[0])
                .when(F.col("_r1") == F.col("_r2"), GEO[1]).otherwise(GEO[2]))
        return j.withColumn("geo", near)

    q, c = F.col("quantity"), F.col("capacity")
    cap = (F.when(c <= 0, CAPACITY["none"]).when(10 * q <= c, CAPACITY["tiny"]).when(10 * q <= 3 * c, CAPACITY["small"])
           .when(10 * q <= 7 * c, CAPACITY["best"]).when(q <= c, CAPACITY["full"]).otherwise(CAPACITY["over"]))
    return geo, cap


def totals(assigned: DataFrame) -> DataFrame:
    """One row: total score, number of pairs, and whether no order and no workshop occurs twice."""
    return assigned.agg(F.coalesce(F.round(F.sum("compatibility_score"), 4), F.lit(0.0)).alias("total_score"), F.count(F.lit(1)).alias("n_assigned"),
                        ((F.countDistinct("pedido_id") == F.count(F.lit(1))) & (F.countDistinct("oficina_id_optimal") == F.count(F.lit(1))))
                        .alias("one_to_one"))
