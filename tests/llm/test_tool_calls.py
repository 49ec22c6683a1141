import json

import pytest
from rollbook.llm import tool_calls as m

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, level string, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, ready string"
FIELDS = [("add", "a", "integer", True, None), ("add", "b", "number", False, None), ("say", "text", "string", True, ["hi", "yo"]),
          ("say", "loud", "boolean", False, None), ("put", "list", "array", False, None), ("put", "map", "object", False, None)]


def run(spark, calls, results=()):
    calls = spark.createDataFrame([(*c, "x", "x") for c in calls], CALLS)
    results = spark.createDataFrame([(*r, "x") for r in results], RESULTS)
    schemas = spark.createDataFrame(FIELDS, "name string, field string, type string, required boolean, allowed array<string>")
    df = m.link(calls, results, schemas)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    return df.collect()


@pytest.mark.parametrize("name, arguments, errors", [
    ("add", '{"b": 1.5, "a": 3}', None),
    ("add", '{"a": "3"}', "wrong type of a"),
    ("add", '{"a": 1.5}', "wrong type of a"),
    ("add", '{"b": 1}', "missing field a"),
    ("add", '{"c": 1, "d": null}', "missing field a; unknown field c; unknown field d"),
    ("say", '{"text": "hi", "loud": true}', None),
    ("say", '{"text": "no"}', "value not allowed for text"),
    ("put", '{"list": [1, {"z": 1, "a": 2}], "map": {}}', None),
    ("put", '{"list": {}, "map": []}', "wrong type of list; wrong type of map"),
    ("put", "{}", None),
    ("put", "[1]", "arguments are no JSON object"),
    ("put", "{broken", "arguments are no JSON object"),
    ("put", None, "arguments are no JSON object"),
    ("none", "{}", "unknown tool"),
])
def test_arguments(spark, name, arguments, errors):
    (r,) = run(spark, [(1, 1, "c", name, arguments, None)])
    assert (r.errors, r.status) == (errors, "invalid" if errors else "no result")
    told = json.loads(r.json)
    assert told["id"] == "c" and told["name"] == name and told["type"] == "tool_call"
    if arguments and errors != "arguments are no JSON object":
        assert told["arguments"] == json.loads(arguments)
        assert r.json == json.dumps(told, sort_keys=True, separators=(",", ":"))


def places(rows, conv=1):
    rows = [r for r in rows if r.conv_id == conv and r.level is not None]
    return [r.call_id for r in sorted(rows, key=lambda r: (r.ready, r.level, r.turn, r.part))]


def call(conv, turn, name, *needs):
    return (conv, turn, name, "put", "{}", list(needs) or None)


def test_order_without_later_references_is_kept(spark):
    got = run(spark, [call(1, t, f"c{t}", *([f"c{t - 2}"] if t > 2 else [])) for t in range(1, 20, 2)], [(1, t + 1, f"c{t}", "r") for t in range(1, 20, 2)])
    assert places(got) == [f"c{t}" for t in range(1, 20, 2) for _ in range(2)] and {r.status for r in got} == {"ok"}


def test_calls_come_behind_what_they_need(spark):
    edges = {"a": ["d"], "b": [], "c": ["a"], "d": ["f"], "e": ["b", "c"], "f": [], "g": ["a", "f"]}
    got = places(run(spark, [call(1, i, n, *needs) for i, (n, needs) in enumerate(edges.items())] + [call(2, 0, "a", "b"), call(2, 1, "b")]))
    assert sorted(got) == list(edges) and all(got.index(n) > got.index(x) for n, needs in edges.items() for x in needs)
    assert got.index("b") == 0


def test_cycles_and_what_is_behind_them(spark):
    got = run(spark, [call(1, 1, "a", "b"), call(1, 2, "b", "a"), call(1, 3, "c", "a"), call(1, 9, "d", "c"), call(1, 4, "e"), call(1, 5, "f", "f"), call(1, 6, "g", "e", "zz")])
    status = {r.call_id: r.status for r in got}
    assert status == {**dict.fromkeys("abcdf", "cycle"), "e": "no result", "g": "missing dependency"}
    assert [r.errors for r in got if r.call_id == "g"] == ["missing dependency zz"] and places(got) == ["e", "g"]


def test_all_behind_a_cycle_by_jumps(spark):
    import random
    rng = random.Random(3)
    for kind in range(3):
        edges = {("x", i): {i - 1} if kind == 0 else {rng.randrange(max(i, 1)) for _ in range(rng.choice([0, 1, 1, 1, 2]))} for i in range(1, 60)} | {("x", 0): {1 if kind == 0 else 0}}
        stuck, reach = {0, 1} if kind == 0 else {0}, set()
        for i in range(60):
            if i in stuck or edges["x", i] & reach:
                reach.add(i)
        table = spark.createDataFrame([(1, str(i), str(n)) for (_, i), needs in edges.items() for n in needs] + [(2, str(i), str(i + 1)) for i in range(5)], "conv_id long, call_id string, needs string")
        found = m.behind(table, spark.createDataFrame([(1, str(i)) for i in stuck], "conv_id long, call_id string"))
        assert sorted((r.conv_id, int(r.call_id)) for r in found.collect()) == [(1, i) for i in sorted(reach)]


def test_linking(spark):
    got = run(spark, [call(1, 1, "a"), call(1, 3, "a"), call(1, 2, "b"), call(2, 1, "a"), (None, 1, "a", "put", "{}", None), (1, 1, None, "put", "{}", None)],
              [(1, 2, "a", "first"), (1, 4, "a", "second"), (1, 1, "b", None), (1, 5, "zz", "lost"), (3, 1, "a", 'q"\n'), (None, 1, "a", "x")])
    said = {(r.conv_id, r.part, r.call_id, r.turn): (r.status, r.errors) for r in got}
    assert said == {(1, 0, "a", 1): ("ok", None), (1, 0, "a", 3): ("repeat", None), (1, 0, "b", 2): ("ok", None), (2, 0, "a", 1): ("no result", None),
                    (1, 1, "a", 2): ("ok", None), (1, 1, "a", 4): ("repeat", None), (1, 1, "b", 1): ("early", None), (1, 1, "zz", 5): ("orphan", None),
                    (3, 1, "a", 1): ("orphan", None), (None, 0, "a", 1): ("no identifier", None), (1, 0, None, 1): ("no identifier", None), (None, 1, "a", 1): ("no identifier", None)}
    assert len(got) == len(said) and json.loads(next(r.json for r in got if r.conv_id == 3))["content"] == 'q"\n'
    assert {json.loads(r.json)["content"] for r in got if r.call_id == "a" and r.part == 1 and r.conv_id == 1} == {"first", "second"}


def test_every_message_has_a_row(spark):
    """Equal messages, equal turns and rows without identifier: none is lost, the least stands."""
    calls = [call(1, 1, "a")] * 4 + [(1, 1, "a", "add", "{broken", ["zz"]), (1, 1, "a", None, None, None), (1, None, "a", "put", "{}", None), (None, None, None, None, None, None)] * 2
    results = [(1, 2, "a", "x")] * 3 + [(1, 2, "a", ""), (1, 2, "a", None), (1, None, "a", "y"), (None, 2, None, "z")]
    got = run(spark, calls, results)
    assert len(got) == len(calls) + len(results)
    count = lambda part, status: sum(r.part == part and r.status == status for r in got)
    assert (count(0, "repeat"), count(0, "no identifier"), count(1, "repeat"), count(1, "no identifier")) == (9, 2, 5, 1)
    stands = [r for r in got if r.status not in ("repeat", "no identifier")]
    assert [(r.part, r.turn) for r in sorted(stands, key=lambda r: r.part)] == [(0, None), (1, None)]


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert [r.status for r in run(spark, [], [(1, 1, "a", "x")])] == ["orphan"]


def test_conversations_give_every_status(spark):
    rows = [(c, t, "system" if t == 0 and c % 5 == 0 else "assistant" if t % 2 else "user", None if c == 3 else f"word {c} {t} " * (c % 6)) for c in range(60) for t in range(8)]
    rows += [(c, 9, "assistant", "") for c in range(5)] + [(c, 11, "user", "alone") for c in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = m.link(*m.from_conversations(df)).collect()
    assert {r.status for r in got} >= {"ok", "invalid", "no result", "missing dependency", "cycle", "orphan"}
    assert len({(r.conv_id, r.part, r.call_id) for r in got}) == len(got)


def test_whole_texts_reach_calls_and_results(spark):
    """Long, non-ASCII and quoted texts with line ends are escaped, validated and kept."""
    texts = ['say "hi" \\ / \n\r\t end', "žluťoučký 日本 \U0001f600 \u2028", "\x00\x01\x1f\x7f\b\f", "long " * 5000, "", "{\"a\": 1}"]
    rows = [(100 + i, turn, role, t) for i, t in enumerate(texts) for turn, role in ((1, "assistant"), (2, "user"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part): r for r in m.link(*m.from_conversations(df)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        said = json.loads(got[100 + i, 0].json)["arguments"]
        assert said.get("query", t) == t and ("query" in said) == ((100 + i) % 13 != 0)
        assert json.loads(got[100 + i, 1].json)["content"] == t


def test_both_names_are_the_query_over_whole_texts(spark):
    from rollbook.llm.queries import QUERIES, WHOLE

    assert WHOLE["op10_tool_calls_whole_text"] == QUERIES["op10_tool_calls"]
    sf = "/root/testdata/sf0.001"
    texts = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    rows = QUERIES["op10_tool_calls"][0](spark, sf).collect()
    assert all(json.loads(r.json)["content"] == texts[r.conv_id, r.turn] for r in rows if r.part == 1) and any(r.part for r in rows)
