import json
import random
import time

import pytest
from pyspark.sql import functions as F

from gridloom.llm import toolcalls

SCHEMAS = {"find": {"properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "w": {"type": "number"}}, "required": ["q"]}}


def call(i, name="find", after=None, **arguments):
    return {"id": i, "name": name, "arguments": arguments} | ({"after": after} if after else {})


def calls(*made):
    return json.dumps({"tool_calls": made})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


ROWS = [
    (1, 0, "user", "Find \"it\"\n please"),
    (1, 1, "assistant", calls(call("b", q="x", n=2, after=["a"]), call("a", n="no"), call("c", q="y", z=1, after=["b"]))),
    (1, 2, "tool", result("a", {"k": [1, 2.50], "a": None})),
    (1, 3, "tool", result("b", "text")),
    (1, 4, "tool", result("nobody", "x")),
    (1, 5, "assistant", calls(call("a", q="again", w=1.5), call("e", "other"))),
    (1, 6, "tool", result("a", "second")),
    (2, 0, "assistant", calls(call("p", q="1", after=["q"]), call("q", q="2", after=["p"]), {"id": "r", "name": "find", "arguments": "[1]"})),
    (2, 1, "assistant", None),
    (2, 2, "tool", "no json"),
    (None, 3, "user", ""),
    (2, None, "user", "x" * 100_000),
]


@pytest.fixture(scope="module")
def linked(spark):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("kind", "nth", "depth", "name")})
    return toolcalls.link(frame, SCHEMAS).collect()


def test_calls_and_results(linked):
    got = {(r.conv_id, r.turn, r.slot, r.call_id): r for r in linked if r.kind == "call"}
    expected = {
        (1, 1, 0, "b"): (1, True, ""), (1, 1, 1, "a"): (0, True, "missing:q,type:n"), (1, 1, 2, "c"): (2, False, "unknown:z"),
        (1, 5, 0, "a"): (0, True, ""), (1, 5, 1, "e"): (0, False, "no schema"),
        (2, 0, 0, "p"): (None, False, ""), (2, 0, 1, "q"): (None, False, ""), (2, 0, 2, "r"): (0, False, "no object"),
    }
    assert {k: (r.depth, r.linked, r.problems) for k, r in got.items()} == expected
    results = {(r.turn, r.call_id): (r.anchor, r.linked, r.problems) for r in linked if r.kind == "result"}
    assert results == {(2, "a"): (1, True, ""), (3, "b"): (1, True, ""), (4, "nobody"): (4, False, "no call"), (6, "a"): (5, True, "")}


def test_canonical_json(linked):
    for r in linked:
        value = json.loads(r.json)
        if r.kind == "message":
            assert r.json == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    texts = {(r.conv_id, r.turn): json.loads(r.json)["content"] for r in linked if r.kind == "message"}
    assert texts == {(c, t): x for c, t, role, x in ROWS if role == "user" or x in (None, "no json")}
    assert [r.json for r in linked if r.kind == "result" and r.turn == 2] == ['{"content":{"a":null,"k":[1,2.5]},"tool_call_id":"a"}']
    assert '{"arguments":{"n":2,"q":"x"},"id":"b","name":"find"}' in {r.json for r in linked}


def test_what_is_said_beside_calls(spark):
    rows = [
        (1, 0, "assistant", json.dumps({"content": "Let me \"look\"", "tool_calls": [call("a", q="x")]})),
        (1, 1, "assistant", json.dumps({"content": "done", "tool_calls": []})),
        (1, 2, "assistant", json.dumps({"tool_calls": []})),
        (1, 3, "assistant", json.dumps({"content": None, "tool_calls": [call("b", q="x")]})),
        (1, 4, "tool", result("a", "found")),
    ]
    got = toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    said = {r.turn: json.loads(r.json) for r in got if r.kind == "message"}
    assert said == {t: {"content": c, "role": "assistant"} for t, c in ((0, "Let me \"look\""), (1, "done"), (2, None))}
    assert sorted((r.turn, r.kind) for r in got if r.kind != "message") == [(0, "call"), (3, "call"), (4, "result")]
    assert [r.turn for r in sorted(got, key=lambda r: (r.anchor, r.depth, r.slot, r.turn))] == [0, 0, 4, 1, 2, 3]


def test_depths_of_long_chains_and_unknown_names(spark):
    made = [call(f"c{i}", q="x", after=[f"c{i - 1}"] if i else None) for i in range(60)]
    rows = [(1, 0, "assistant", calls(*made)), (2, 0, "assistant", calls(call("a", q="x", after=["gone"]), call("b", q="x")))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    depth = lambda f: {(r.conv_id, r.call_id): r.depth for r in toolcalls.link(f, SCHEMAS).collect() if r.kind == "call"}
    unknown = {(2, "a"): 0, (2, "b"): 0}
    assert depth(frame) == {(1, f"c{i}"): i for i in range(60)} | unknown
    assert depth(frame.where("conv_id = 2")) == unknown


def test_empty_table(spark):
    assert toolcalls.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_depths(made):
    """The depth of each call by walking back, None on or behind a cycle."""
    before = {}
    for c in made:
        before.setdefault(c["id"], set()).update(x for x in c.get("after", []) if any(x == d["id"] for d in made))
    depth, todo = {}, True
    while todo:
        todo = [i for i, b in before.items() if i not in depth and all(x in depth for x in b)]
        depth |= {i: max((depth[x] + 1 for x in before[i]), default=0) for i in todo}
    return {i: depth.get(i) for i in before}


def plain_problems(arguments):
    if not isinstance(arguments, dict):
        return "no object"
    right = {"q": lambda v: isinstance(v, str), "n": lambda v: isinstance(v, int) and not isinstance(v, bool), "w": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)}
    wrong = [f"type:{k}" if k in right else f"unknown:{k}" for k, v in arguments.items() if k not in right or not right[k](v)]
    return ",".join(sorted(wrong + ["missing:q"] * ("q" not in arguments)))


def test_against_a_plain_linker(spark):
    """Random graphs, deep chains, ladders and cycles, and random arguments, all in one table."""
    rng, rows, expected = random.Random(4), [], {}
    values = [1, -2.5, "x", "ü\"\\", True, None, [1, {"b": 1, "a": []}], {"z": 0, "y": "1"}]
    graphs = [[(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(n)] for n in (60, 500)]
    graphs += [[(f"{s}{i}", [f"a{i - 1}", f"b{i - 1}"] if i else []) for i in range(12) for s in "ab"]]
    graphs += [[("x", ["z"]), ("y", ["x"]), ("z", ["y"]), ("behind", ["y", "free"]), ("free", [])]]
    graphs += [[(f"n{i}", [f"n{rng.randrange(20)}" for _ in range(rng.randrange(3)) if rng.random() < 0.6]) for i in range(20)] for _ in range(25)]
    for conv, graph in enumerate(graphs):
        made = []
        for i, after in graph:
            arguments = {k: rng.choice(values) for k in rng.sample(["q", "n", "w", "other"], rng.randrange(4))} if rng.random() < 0.9 else rng.choice(values)
            made.append({"id": i, "name": "find", "arguments": arguments, "after": after})
        rng.shuffle(made)
        rows.append((conv, 0, "assistant", calls(*made)))
        answered = {c["id"] for c in made if rng.random() < 0.5}
        rows += [(conv, 1 + k, "tool", result(i, "ok")) for k, i in enumerate(sorted(answered))]
        depth = plain_depths(made)
        for slot, c in enumerate(made):
            text = json.dumps({"arguments": c["arguments"], "id": c["id"], "name": "find"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            expected[conv, slot] = (c["id"], depth[c["id"]], c["id"] in answered, plain_problems(c["arguments"]), text if c["arguments"] is not None else None)
    begin = time.time()
    got = toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).where("kind = 'call'").collect()
    assert time.time() - begin < 60
    assert len(got) == len(expected)
    for r in got:
        i, depth, linked, problems, text = expected[r.conv_id, r.slot]
        assert (r.call_id, r.depth, r.linked) == (i, depth, linked), (r, depth)
        if text is not None and not text.startswith('{"arguments":"'):
            assert r.problems == problems and r.json == text, (r, problems, text)


def test_numbers_are_not_changed(spark):
    texts = {
        '{"b":1e400,"a":"1e400 \\" 1e401"}': '{"a":"1e400 \\" 1e401","b":1e400}', '[12345678901234567890123456789012345678901]': None, '{"x":[-0.1e-400,1.50]}': '{"x":[-0.1e-400,1.5]}',
        '{"k":12345678901234567.25e3}': None, '"1e400"': None, '{"a":1,"a":2}': "null", "no 1e400": "null", '{"p":"","n":1e400}': "null",
    }
    frame = spark.createDataFrame(list(texts.items()), "t string, wanted string")
    for r in frame.select("t", "wanted", toolcalls.canonical(F.col("t")).alias("c")).collect():
        assert r.c == (r.t if r.wanted is None else None if r.wanted == "null" else r.wanted)


def test_odd_messages(spark, odd):
    frame = odd.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text", "score", "n", "part")
    got = toolcalls.link(frame, SCHEMAS)
    assert got.count() == odd.count() and got.where("kind <> 'message'").count() == 0
    marks = {"content": "1\ue0002\ue0003", "tool_calls": [call("\ue000i\ue000", q="\ue000q\ue000")]}
    said = toolcalls.link(spark.createDataFrame([(1, 0, "assistant", json.dumps(marks))], "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    assert sorted(json.loads(r.json).get("content") or r.call_id for r in said) == sorted(["1\ue0002\ue0003", "\ue000i\ue000"])
    twice = spark.createDataFrame(2 * [(1, 0, "assistant", calls(call("a", q="x")))] + 2 * [(1, 1, None, calls(call("a", q="x")))], "conv_id long, turn long, role string, text string")
    assert sorted(r.kind for r in toolcalls.link(twice, SCHEMAS).collect()) == ["call", "call", "message", "message"]
