import json

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import nested

leaf = st.none() | st.booleans() | st.integers() | st.text(max_size=8)
value = st.recursive(leaf, lambda v: st.lists(v, max_size=3) | st.dictionaries(st.sampled_from(["title", "nodes", "meta", "x", "structure"]), v, max_size=4), max_leaves=20)


def brute(record):
    out = []

    def walk(x, parent):
        for n in x if isinstance(x, list) else [x]:
            if isinstance(n, dict):
                me = len(out)
                out.append((me, parent))
                walk(n.get("nodes"), me)

    walk(record.get("structure"), -1)
    return out


def found(text):
    return [(t[1], int(t[6])) for t in nested.triples(text) if t[0] == "node" and t[4] == nested.PARENT]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from(["structure", "doc_name", "meta"]), value, max_size=3), st.sampled_from([None, 2]))
def test_nodes_of_any_record(record, indent):
    text = json.dumps(record, indent=indent, ensure_ascii=bool(indent))
    if "structure" not in record:
        return
    want = brute(record)
    assert found(text) == want
    assert found(json.dumps(text)) == want  # quoted
    assert found("﻿ " + text + "\n") == want
    assert found(json.dumps({"any name": {"x": [record]}, "code": 0, "meta": {"y": {"z": {"structure": [{}]}}}})) == want
    assert found("```json\n" + text + "\n```") == want
    assert found(text[:-1]) == []  # cut off
    assert found(text + "x") == []


def test_other_fields_and_depth():
    text = '{"structure": {"title": "a", "meta": {"boxes": [{"x0": 1, "tags": [{"title": "b"}]}], "lang": "zh"}, "text": "{\\"nodes\\": [{}]}", "nodes": [null, "s", [{"y": 1}], {"title": null}]}, "meta": {"structure": [{}]}}'
    assert found(text) == [(0, -1), (1, 0)]
    t = list(nested.triples(text))
    assert ("node.meta.boxes", 0, "node", 0, nested.PARENT, 0, "0") in t
    assert ("node.meta.boxes.tags", 0, "", -1, "title", 0, "b") in t
    assert ("node", 0, "", -1, "meta.lang", 0, "zh") in t
    deep = '{"structure": ' + '{"nodes": [' * 5000 + "]}" * 5000 + "}"
    assert found(deep)[-1] == (4999, 4998)
    for bad in (None, "", "   ", "null", "[]", "{", '{"structure": [{]}', "[" * 100_000, '{"a": 01}', '{"a": "\n"}'):
        assert found(bad) == []


def test_tables(spark):
    rows = [(1, '{"doc_name": "d", "structure": [{"title": "a", "nodes": [{"title": "b"}, {"text": "t"}]}]}', "k"), (2, "{damaged", "k"), (3, None, "k"), (1, '{"structure": []}', "k")]
    df = spark.createDataFrame(rows, "id int, payload string, key string")
    flat = nested.pivot(nested.shred(df.filter("payload not like '%[]%'"), "id", "payload"), "node", ["title", "text"])
    assert sorted(map(tuple, flat.collect())) == [(1, 0, -1, "a", None), (1, 1, 0, "b", None), (1, 2, 0, None, "t")]
    assert nested.shred(df.limit(0), "id", "payload").count() == 0
    assert nested.shred(df, "id", "payload", tables=["record"], paths=["doc_name"]).collect()[0]["value"] == "d"


def test_documents_without_structure():
    bare = lambda text: [(t[1], int(t[6])) for t in nested.triples(text, bare=True) if t[0] == "node" and t[4] == nested.PARENT]
    for text in ('[{"title": "a", "nodes": [{"title": "b"}]}, null, {"title": "c"}]', '{"doc_name": "d", "nodes": [{"title": "a", "nodes": {"title": "b"}}, {"title": "c"}]}'):
        assert bare(text) == [(0, -1), (1, 0), (2, -1)]
        assert found(text) == []
    assert bare('{"structure": [{}], "nodes": [{}, {}]}') == [(0, -1)]
    assert bare('[{"structure": [{}]}]') == [(0, -1)]


def test_a_record_is_not_held():
    """Triples come before the record has been read to its end."""
    text = json.dumps({"structure": [{"title": str(i)} for i in range(20_000)]})
    it = nested.triples(text)
    assert [next(it)[0] for _ in range(3)] == ["record", "node", "node"]
    assert sum(t[4] == nested.PARENT for t in it) == 19_999
