"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Every text is matched against three base patterns and one generic pattern for long mixed tokens. The value of each match
is hashed and counted over the whole corpus by distinct owners and by distinct repositories of an owner. Both decide: a value
that many owners hold, or that one or two owners hold in many repositories, is a copied example; one that few owners hold in
few repositories looks live. All base matches are reported; the method adds the generic matches that look live, and says of
every match which it is and in how many owners and repositories its value occurs.

Positions come without a Python function: ``split`` gives the pieces between matches and ``regexp_extract_all`` the
matches, so a match ends at the running sum of their lengths (code points).

Edge cases: a null text counts as empty; a null owner counts as one owner of its own; repeated rows are scanned each;
documents without matches have counts 0, the digest of the empty string and empty spans. Extra columns are ignored
(``redact``: kept); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstat.llm.common import Scratch, small, with_row_id

# Fixed values of the base kinds: pattern, and the least length of the value.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # all of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so short ones need no match
GENERIC = r"[A-Za-z0-9+/_-]{32,}"  # kept if it mixes cases and digits and looks live
KINDS = ("assign", "access", "hex", "generic")
BASE = 3

#: A value that so many distinct owners hold is a copied example.
WIDE_OWNERS = 3
#: So is a value in so many distinct repositories, whoever owns them.
WIDE_REPOSITORIES = 20
#: Fewer distinct characters make a placeholder, not a credential.
LEAST_VARIETY = 6
REDACTED = "<REDACTED>"


def _matches(text: Column, kind: int) -> Column:
    """Array of (kind, i, gap before, length, value, valid) for one kind."""
    pattern = F.lit((ASSIGN, ACCESS, HEX, GENERIC)[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == 0 else found
    pieces = F.split(text, pattern, -1)

    def one(x: Column, i: Column) -> Column:
        v = F.get(value, i)
        if kind == 0:
            valid = F.length(v) >= ASSIGN_LEAST
        elif kind == 3:
            valid = v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
        else:
            valid = F.lit(True)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"), F.length(x).alias("len"),
                        F.when(valid, F.sha2(v.cast("binary"), 256)).alias("hash"),
                        (F.size(F.array_distinct(F.split(v, ""))) >= LEAST_VARIETY).alias("varied"))

    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,hash:string,varied:boolean>>")
    # texts without a match, by far the most, are read once a kind
    return F.when(F.regexp_like(text, pattern), F.transform(found, one)).otherwise(none)


def scan(documents: DataFrame, scratch: Scratch, owner: str = "source", repository: str = "doc_id", row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``documents(doc_id, text, owner, repository)`` -> pinned ``(rid, doc_id)`` of all rows, and the reported matches
    ``(rid, kind, start, end, owners, repositories, live)``."""
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.pin(documents.select(
        rid.alias("rid"), "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repo"),
        F.concat(*[_matches(text, k) for k in range(len(KINDS))]).alias("m")))
    each = rows.where(F.size("m") > 0).select("rid", "owner", "repo", F.inline("m"))
    w = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(w)
    spans = scratch.pin(each.withColumn("end", end).where(F.col("hash").isNotNull()).select(
        "rid", "owner", "repo", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "hash", "varied"))
    held = spans.groupBy("hash", "owner", "repo").agg(F.first("varied").alias("varied")).groupBy("hash", "owner").agg(
        F.count(F.lit(1)).alias("repos"), F.first("varied").alias("varied")).groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories"), F.first("varied").alias("varied"))
    seen = held.select("hash", "owners", "repositories", ((F.col("owners") < WIDE_OWNERS) & (F.col("repositories") < WIDE_REPOSITORIES) & F.col("varied")).alias("live"))
    told = spans.join(seen, "hash").where((F.col("kind") < BASE) | F.col("live"))
    return rows.select("rid", "doc_id"), told.select("rid", "kind", "start", "end", "owners", "repositories", "live")


def _listed(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(documents: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row of ``documents``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, and for each span in
    turn the owners and repositories that hold its value (comma-joined)."""
    scratch = Scratch(documents.sparkSession, "secrets")
    rows, spans = scan(documents, scratch, owner, repository)
    count = lambda cond: F.count_if(cond)
    per = spans.groupBy("rid").agg(
        *[count(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        count(F.col("live")).alias("n_live"), count(~F.col("live")).alias("n_example"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories"))).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < BASE)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.join(per, "rid", "left").select(
        "doc_id", *[zero(f"n_{KINDS[k]}") for k in range(BASE)], F.sha2(text(_listed(base)).cast("binary"), 256).alias("base_sha256"),
        text(_listed(F.col("all"))).alias("spans"), zero("n_live"), zero("n_example"),
        *[text(F.array_join(F.col(f"all.{c}").cast("array<string>"), ",")).alias(c) for c in ("owners", "repositories")])


def redact(documents: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``documents`` with every reported match replaced by ``<REDACTED>`` and n_chars recounted; all rows and columns stay."""
    scratch = Scratch(documents.sparkSession, "redact")
    rid = "_" * (1 + max(map(len, documents.columns)))
    docs = with_row_id(documents, scratch, rid)
    _, spans = scan(docs, scratch, owner, repository, rid)
    by = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    merged = marked.withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cuts = merged.groupBy("rid", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = scratch.pin(cuts.groupBy(F.col("rid").alias(rid)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts" + rid)))
    found = F.col("_cuts" + rid)
    one = lambda s, i: F.concat(F.substring(F.col("text"), F.when(i == 0, 1).otherwise(F.get(found, i - 1)["end"] + 1).cast("int"),
                                            (s["start"] - F.when(i == 0, 0).otherwise(F.get(found, i - 1)["end"])).cast("int")), F.lit(REDACTED))
    tail = F.substring(F.col("text"), (F.element_at(found, -1)["end"] + 1).cast("int"), F.length("text"))
    text = F.when(found.isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform(found, one), ""), tail))
    out = docs.join(small(cuts), rid, "left").withColumn("text", text)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(found.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])


def _oracle_kind(kind: int, pattern: str) -> str:
    value = f"regexp_extract_all(t, '{pattern}', 2)" if kind == 0 else f"regexp_extract_all(t, '{pattern}')"
    keep = {0: f"length(v) >= {ASSIGN_LEAST}", 3: "regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')"}.get(kind, "true")
    return f"""
  SELECT rid, doc_id, source, {kind} AS kind, e - length(m) AS s, e, v FROM (
    SELECT rid, doc_id, source, m, v, sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS e FROM (
      SELECT rid, doc_id, source, unnest(ps[:len(ms)]) AS p, unnest(ms) AS m, unnest(vs) AS v, unnest(range(len(ms))) AS i FROM (
        SELECT rid, doc_id, source, regexp_split_to_array(t, '{pattern}') AS ps, regexp_extract_all(t, '{pattern}') AS ms, {value} AS vs FROM d
        WHERE regexp_matches(t, '{pattern}'))))
  WHERE {keep}"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_oracle_kind(k, p.replace("'", "''")) for k, p in enumerate((ASSIGN, ACCESS, HEX, GENERIC)))}),
held AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners,
    count(DISTINCT [coalesce(source, chr(0)), coalesce(CAST(doc_id AS VARCHAR), '')]) AS repositories FROM f GROUP BY v),
seen AS (SELECT *, owners < {WIDE_OWNERS} AND repositories < {WIDE_REPOSITORIES} AND len(list_distinct(string_split(v, ''))) >= {LEAST_VARIETY} AS live FROM held),
g AS (SELECT f.*, live, owners, repositories, CASE kind {' '.join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS))} END || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS said
  FROM f JOIN seen USING (v) WHERE kind < {BASE} OR live),
per AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = {k}) AS n_{KINDS[k]}" for k in range(BASE))},
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example,
  coalesce(string_agg(said, ',' ORDER BY s, kind) FILTER (kind < {BASE}), '') AS base, string_agg(said, ',' ORDER BY s, kind) AS spans,
  string_agg(owners, ',' ORDER BY s, kind) AS owners, string_agg(repositories, ',' ORDER BY s, kind) AS repositories FROM g GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{KINDS[k]}, 0) AS n_{KINDS[k]}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
  coalesce(owners, '') AS owners, coalesce(repositories, '') AS repositories
FROM d LEFT JOIN per USING (rid)
"""
