"""op7: linking, order, validation and canonical JSON."""

import json

import duckdb

from loomstat.llm.tool_calls import ORACLE, exchanges, link


def test_link(spark):
    ok = json.dumps({"turn": 1, "prompt": 'é "q"\n'}, ensure_ascii=False)
    calls = [(1, "a", None, 0, "respond", ok), (1, "b", "a", 1, "respond", '{"prompt":"x"}'), (1, "c", "b", 2, "respond", '{"prompt":5,"turn":1}'),
             (1, "d", "c", 3, "respond", '{"prompt":"x","turn":1,"more":2}'), (1, "e", "d", 4, "other", ok), (1, "f", "gone", 5, "configure", "not json"),
             (1, "x", "y", 6, "respond", None), (1, "y", "x", 7, "respond", ok), (1, "z", "x", 8, "respond", '{"prompt":"","turn":1}'), (1, None, None, 9, None, ok),
             (2, "a", None, 0, "respond", ok), (1, "a", None, 0, "respond", ok), (1, "s", "s", 3, "respond", ok)]
    results = [(1, "a", 2, "late"), (1, "a", 1, "first"), (1, "b", 3, None), (3, "a", 1, "spare"), (None, "q", 1, "no conversation"), (1, None, 1, "no id")]
    got = link(spark.createDataFrame(calls, "conv_id long, call_id string, after_id string, turn long, name string, arguments string"),
               spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")).collect()
    by = {(r["conv_id"], r["call_id"], r["status"]): r for r in got}
    assert len(got) == len(calls) + 4
    depth = {c: next(r["depth"] for r in got if r["conv_id"] == 1 and r["call_id"] == c) for c in "abcdefxyzs"}
    assert depth == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 0, "x": -1, "y": -1, "z": -1, "s": -1}
    a = by[1, "a", "linked"]
    assert a["n_results"] == 2 and a["valid"]
    assert a["json"] == json.dumps({"arguments": json.dumps({"prompt": 'é "q"\n', "turn": 1}, ensure_ascii=False, separators=(",", ":")), "id": "a", "name": "respond", "result": "first"},
                                   ensure_ascii=False, separators=(",", ":"))
    assert [by[k]["valid"] for k in ((1, "b", "linked"), (1, "c", "open"), (1, "d", "open"), (1, "e", "open"), (1, "f", "open"), (1, "x", "open"), (1, "y", "open"), (1, "z", "open"))] == [
        False, False, False, False, False, False, True, False]
    assert by[3, "a", "orphan"]["json"] == '{"id":"a","result":"spare"}'
    assert (2, "a", "open") in by and (1, None, "open") in by


def test_exchanges(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello"), (1, 3, "user", "More"), (1, 4, "assistant", None), (1, 5, "user", ""),
            (2, 0, "assistant", "first"), (2, 3, "user", "x"), (None, 1, "user", "y"), (3, None, None, None), (4, 0, "user", "long " * 50_000)]
    got = link(*exchanges(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int"))).collect()
    by = {(r["conv_id"], r["turn"], r["status"]): r for r in got}
    assert len(got) == 9
    assert [by[1, t, s]["depth"] for t, s in ((0, "open"), (1, "linked"), (3, "linked"), (5, "open"))] == [0, 1, 2, 3]
    assert by[1, 3, "linked"]["json"] == '{"arguments":"{\\"prompt\\":\\"More\\",\\"turn\\":3}","id":"call:1:3","name":"respond","result":""}'
    assert not by[1, 5, "open"]["valid"] and by[1, 1, "linked"]["valid"]
    assert by[2, 0, "orphan"]["call_id"] == "call:2:-1"


def test_one_chain_of_many_calls(spark):
    calls = spark.createDataFrame([(1, str(i), str(i - 1) if i else None, i, "respond", "{}") for i in range(300)], "conv_id long, call_id string, after_id string, turn long, name string, arguments string")
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    assert {r["turn"]: r["depth"] for r in link(calls, none).collect()} == {i: i for i in range(300)}


def test_empty_table(spark):
    assert link(*exchanges(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_repeated_results_are_rows(spark):
    """Every result occurs once in the output: linked, repeated or as an orphan."""
    calls = [(1, "a", None, 0, "respond", "{}"), (1, "a", None, 3, "respond", "{}"), (1, "b", "a", 1, "respond", "{}")]
    results = [(1, "a", 1, "x"), (1, "a", 1, "x"), (1, "a", 2, "second"), (1, "a", None, None), (1, "b", 4, "only"), (2, "a", 1, "p"), (2, "a", 1, "q")]
    got = link(spark.createDataFrame(calls, "conv_id long, call_id string, after_id string, turn long, name string, arguments string"),
               spark.createDataFrame([(*r, "y") for r in results], "conv_id long, call_id string, turn long, content string, status string")).collect()
    assert sorted((r["status"], r["turn"] or -1, json.loads(r["json"]).get("result")) for r in got if r["status"] in ("repeated", "orphan")) == [
        ("orphan", 1, "p"), ("orphan", 1, "q"), ("repeated", 1, "x"), ("repeated", 1, "x"), ("repeated", 2, "second")]
    assert [r["n_results"] for r in got if r["status"] == "linked"] == [4, 4, 1]


def test_repeats_in_sql(spark):
    rows = [(c, t, role, f"{role} {c} {t} {k % 2}") for c in range(4) for t, role in enumerate(("system", "user", "assistant", "user", "assistant")) for k in range(1 + 2 * (c % 2))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    got, want = link(*exchanges(df)), con.sql(ORACLE)
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
    assert any(r["status"] == "repeated" for r in got.collect())
