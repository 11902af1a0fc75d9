"""Local correctness check: each registered Spark query against its SQL oracle (DuckDB).

usage: python scripts/compare.py [sf_dir] [name-prefix ...]
Compares row count, column names, column type families and an order-insensitive
hash of the values (doubles compared after rounding to 9 significant digits).
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from loomstat.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402
from loomstat.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


STRICT = os.environ.get("STRICT") == "1"


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if STRICT else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return repr(float(v)) if STRICT else f"{float(v):.9g}"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def family(t: str) -> str:
    t = t.lower()
    if any(k in t for k in ("int", "long", "short", "byte")):
        return "int"
    if any(k in t for k in ("double", "float", "decimal")):
        return "num"
    if "timestamp" in t:
        return "ts"
    if t.startswith("date"):
        return "date"
    if "bool" in t:
        return "bool"
    if any(k in t for k in ("string", "varchar")):
        return "str"
    return t


def digest(rows, cols):
    lines = sorted("|".join(norm(r[c]) for c in cols) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in sys.argv[1:] if not a.startswith("/")]
    load_all()
    spark = local_session()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            srows = [r.asDict() for r in df.collect()]
            scols = df.columns
            stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:2000]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLES:
            print(f"---- {name}: rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(ORACLES[name])
            ocols = [d[0] for d in cur.description]
            otypes = {d[0]: str(d[1]) for d in cur.description}
            orows = [dict(zip(ocols, r)) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle error {str(e)[:2000]}")
            bad += 1
            continue
        problems = []
        if sorted(scols) != sorted(ocols):
            problems.append(f"columns spark-only={sorted(set(scols)-set(ocols))} oracle-only={sorted(set(ocols)-set(scols))}")
        common = sorted(set(scols) & set(ocols))
        tf = [f"{c}:{stypes[c]}/{otypes[c]}" for c in common if family(stypes[c]) != family(otypes[c])]
        if tf:
            problems.append("types " + ", ".join(tf))
        if len(srows) != len(orows):
            problems.append(f"rows spark={len(srows)} oracle={len(orows)}")
        hs, ls = digest(srows, common)
        ho, lo = digest(orows, common)
        if hs != ho:
            # locate differing columns
            diffcols = []
            for c in common:
                a = sorted(norm(r[c]) for r in srows)
                b = sorted(norm(r[c]) for r in orows)
                if a != b:
                    ex = [(x, y) for x, y in zip(a, b) if x != y][:3]
                    diffcols.append(f"{c} e.g. {ex}")
            problems.append("values differ: " + "; ".join(diffcols)[:3000])
        status = "ok  " if not problems else "FAIL"
        if problems:
            bad += 1
        print(f"{status} {name}: rows={len(srows)} {ts:.1f}s " + " | ".join(problems))
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
