"""Nested messages into flat rows, against a plain walk over parsed JSON."""

import json
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.functions.jsonflat import flatten, heads
from cairn.operators.nested import nested_blocks, nested_messages, nested_objects


def brute(text):
    try:
        top = json.loads(text, parse_constant=lambda c: 1 / 0)
    except Exception:
        return None
    out = []

    def walk(v, path, ring, ctx):
        if isinstance(v, dict):
            for k, x in v.items():
                p = f"{path}.{k}" if path else k
                if ctx and k == "content" and isinstance(x, (dict, str, list)):
                    for i, e in enumerate(x if isinstance(x, list) else [x]):
                        q = f"{p}[{i}]"
                        if isinstance(e, dict):
                            out.append((q, ring))
                            walk(e, q, q, True)
                        elif not isinstance(x, list):
                            out.append((q, ring))
                        else:
                            walk(e, q, ring, False)
                elif ctx and path and k == "input" and isinstance(x, str):
                    try:
                        y = json.loads(x, parse_constant=lambda c: 1 / 0)
                    except Exception:
                        continue
                    if isinstance(y, dict):
                        walk(y, p, ring, False)
                else:
                    walk(x, p, ring, False)
        elif isinstance(v, list):
            for i, e in enumerate(v):
                q = f"{path}[{i}]"
                if isinstance(e, dict):
                    out.append((q, ring))
                    walk(e, q, q, False)
                else:
                    walk(e, q, ring, False)

    walk(top, "", "", isinstance(top, dict))
    return sorted(out)


def rows(texts):
    r = flatten(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    for i, p, q in zip(r["row"].tolist(), r["path"].to_pylist(), r["parent_path"].to_pylist()):
        out[i].append((p, q))
    return [sorted(x) for x in out]


keys = st.sampled_from(["content", "input", "a", "b\"c", "é", "id"])
values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=6), st.sampled_from(['{"x": [{"y": [{}]}]}', "[{}]", "{"])), lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(keys, c, max_size=3)), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(values, min_size=1, max_size=5), st.booleans())
def test_any_json(vs, ascii_only):
    texts = [json.dumps(v, ensure_ascii=ascii_only) for v in vs]
    assert rows(texts) == [brute(t) or [] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(values, min_size=1, max_size=4), st.randoms())
def test_damaged_json(vs, rnd):
    texts = []
    for v in vs:
        t = list(json.dumps(v))
        for _ in range(rnd.randint(1, 2)):
            i = rnd.randrange(len(t) + 1)
            t[i : i + rnd.randint(0, 1)] = rnd.choice(["", "{", "}", "[", "]", ",", ":", '"', "\\", "1", " ", "e", "-"])
        texts.append("".join(t))
    assert rows(texts) == [brute(t) or [] for t in texts]


def test_operator(spark):
    long = json.dumps({"content": [{"text": "x" * 5_000_000, "input": {"l": [{"k": 1}]}}]})
    ms = [None, "", "{", '{"content": "hi"}', '{"content": {"input": "{\\"e\\": [{}]}"}}', '{"content": []}', '{"content": null}', long, long, '[{"a": [{}]}]', " {} "]
    df = spark.createDataFrame([(i, m, "p", True) for i, m in enumerate(ms)], "line_id bigint, message string, path string, block boolean")
    got = {}
    for r in nested_objects(df).collect():
        got.setdefault(r.line_id, []).append((r.path, r.parent_path))
    assert {k: sorted(v) for k, v in got.items()} == {i: b for i, m in enumerate(ms) if m and (b := brute(m))}
    assert nested_objects(df.limit(0)).count() == 0
    blocks = {(r.line_id, r.path): r.text for r in nested_blocks(df).collect()}
    assert blocks[3, "content[0]"] == "hi" and len(blocks) == 4
    assert nested_messages(df).count() == 8


def test_random_order_of_batches(spark):
    rnd = random.Random(0)
    ms = [json.dumps({"content": [{"i": k, "l": [{"j": [{}] * rnd.randrange(3)}]}]}) for k in range(50)]
    assert rows(ms) == [brute(m) for m in ms]


def test_fields_against_parsed_json():
    """Fields of messages and blocks as a parser reads them, whatever their form."""
    rnd = random.Random(4)
    value = lambda: rnd.choice(["a", 'q"\\u00e9', "é\\n", "", None, 5, -1.5e3, True, {"x": [1, "}"]}, [1, {"id": 2}], "{", "null"])
    said = lambda v: None if v is None else v if isinstance(v, str) else json.loads(json.dumps(v)) if isinstance(v, (dict, list)) else json.dumps(v)
    texts = []
    for _ in range(300):
        block = lambda: {k: value() for k in rnd.sample(["type", "id", "name", "tool_use_id", "text", "other"], 4)}
        m = {k: value() for k in rnd.sample(["id", "role", "model", "stop_reason", "z"], 3)}
        m |= {"usage": rnd.choice([None, {"output_tokens": value(), "deep": {"output_tokens": 7}}, {}, "x"]), "content": rnd.choice([[block(), {"content": [block()]}], block(), "plain\\ttext"])}
        texts.append(json.dumps(m, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1])))
    array = pa.array([*texts, None, "{", "5", '[{"id": 1}]'])
    read = lambda got, v: json.loads(got) if isinstance(v, (dict, list)) else got
    h = heads(array, ("id", "role"), "usage", ("output_tokens",))
    assert h["row"].tolist() == [*range(300), 303]
    for i, t in enumerate(texts):
        m = json.loads(t)
        assert all(read(h[k][i].as_py(), m.get(k)) == said(m.get(k)) for k in ("id", "role"))
        n = (m["usage"] or {}).get("output_tokens") if isinstance(m["usage"], (dict, type(None))) else None
        assert read(h["output_tokens"][i].as_py(), n) == said(n)
    b = flatten(array, True, False, ("type", "id", "text"))
    at = {(r, p): j for j, (r, p) in enumerate(zip(b["row"].tolist(), b["path"].to_pylist()))}
    for i, t in enumerate(texts):
        c = json.loads(t)["content"]
        if isinstance(c, str):
            assert b["text"][at[i, "content[0]"]].as_py() == c
            continue
        for p, o in ([("content[0]", c)] if isinstance(c, dict) else [("content[0]", c[0]), ("content[1].content[0]", c[1]["content"][0])]):
            assert all(read(b[k][at[i, p]].as_py(), o.get(k)) == said(o.get(k)) for k in ("type", "id", "text"))
