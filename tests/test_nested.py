"""Nested records against a plain recursive walk."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators import nested as N


def walk(v, path="", owner="", name=""):
    out = []
    if isinstance(v, dict):
        for k, x in v.items():
            k = k[:1].upper() + k[1:]
            p = f"{path}.{k}" if path else k
            if k in N.ARRAYS:
                if isinstance(x, str):
                    try:
                        x = json.loads(x)
                    except ValueError:
                        continue
                items = x if isinstance(x, list) else [x] if isinstance(x, dict) else []
                for i, e in enumerate(items):
                    if isinstance(e, dict):
                        out.append((f"{p}[{i}]", owner))
                        out += walk(e, f"{p}[{i}]", f"{p}[{i}]")
            elif isinstance(x, dict):
                out += walk(x, p, owner)
    return out


leaf = st.none() | st.integers(-5, 5) | st.text("ab{[", max_size=4)
tree = st.recursive(leaf, lambda c: st.dictionaries(st.sampled_from(["items", "Items", "data", "Layout", "Name", "tables"]), c | st.lists(st.dictionaries(st.sampled_from(["data", "Name"]), c, max_size=2) | st.none(), max_size=3), max_size=3), max_leaves=12)


def no_clash(v):
    if isinstance(v, dict):
        names = [k[:1].upper() + k[1:] for k in v]
        return len(set(names)) == len(names) and all(no_clash(x) and not (isinstance(x, list) and k[:1].upper() + k[1:] not in N.ARRAYS) for k, x in v.items())
    return all(map(no_clash, v)) if isinstance(v, list) else True


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from(["Regions", "items", "Layout", "Document"]), tree, max_size=3).filter(no_clash))
def test_paths_match_walk(record):
    got = [(r[1], r[2]) for r in N.unfold(N._loads(json.dumps(record)))]
    assert sorted(got) == sorted(walk(record))


@settings(max_examples=200, deadline=None)
@given(tree)
def test_reader_of_any_depth(v):
    text = json.dumps(v)
    deep = "[" * 5000 + text + "]" * 5000
    got = N.read_json(deep)
    for _ in range(5000):
        (got,) = got
    assert got == v
    for bad in ("[" * 5000 + "1 2" + "]" * 5000, "[" * 5000, "[" * 5000 + "]" * 4999, "[" * 5000 + "{,}" + "]" * 5000, "[" * 5000 + "]" * 5000 + "x"):
        assert N._loads(bad) is None


def test_records_of_any_depth():
    text = '{"Items":[' * 1500 + '{"Name":"x"}' + "]}" * 1500
    rows = N.unfold(N._loads(text))
    assert len(rows) == 1500 and rows[-1][1].count("Items[0]") == 1500 and rows[0][2] == "" and all(a[4] == b[5] for a, b in zip(rows, rows[1:]))


def test_cases(spark):
    rec = {"items": [{"Name": "a", "Data": '[{"x":1},null,{"x":1}]'}, None, {"Name": "a", "Data": {"x": 1}}], "Body": '{"Items":[{}]}'}
    rows = [(1, json.dumps(rec), "p"), (1, json.dumps(rec), "q"), (2, None, ""), (3, "", ""), (4, '{"Items":[{"a":', ""), (5, json.dumps(json.dumps(rec)), ""), (6, "null", ""), (7, "[1,2]", ""), (8, "[" * 100_000, ""), (9, json.dumps({"Items": {"n": "x" * 200_000}}), "")]
    df = spark.createDataFrame(rows, "page_id bigint, structured_json string, kind string")
    b = N.bridge(df)
    got = {tuple(r) for r in N.occurrences(b).select("page_id", "node_path", "parent_path").collect()}
    paths = {("Items[0]", ""), ("Items[0].Data[0]", "Items[0]"), ("Items[0].Data[2]", "Items[0]"), ("Items[2]", ""), ("Items[2].Data[0]", "Items[2]")}
    assert got == {(p, a, o) for p in (1, 5) for a, o in paths} | {(9, "Items[0]", "")}
    same = {r["node_id"] for r in b.where("kind = 'Data'").collect()}
    assert len(same) == 1
    o = {r["kind"]: r for r in N.objects(b.where("page_id = 5 and kind = 'Data'")).collect()}
    assert o["Data"]["occurrences"] == 3 and json.loads(o["Data"]["attributes"]) == {"X": 1}
    assert {r["occurrences"] for r in N.objects(b.where("page_id = 1 and kind = 'Data'")).collect()} == {3}
    flat = N.flat_table(b, "Items", ["Name"]).where("page_id = 5").orderBy("node_path").collect()
    assert [r["Name"] for r in flat] == ["a", "a"]
    assert N.bridge(df.limit(0)).count() == 0
