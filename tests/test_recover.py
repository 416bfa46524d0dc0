import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowgauge.functions import recover

E1 = '{"id":"E1","type":"Action","text":"a"}'
R1 = f'{{"entities":[{E1}],"relations":[]}}'
FENCED = f"```json\n{R1}\n```"
ONE = {"entities": [json.loads(E1)], "relations": []}
FROM_TO = '{"entities":[],"relations":[{"from":"E2","to":"E1","type":"isPreceededBy"}]}'
BRACE = R1.replace('"a"', '"druk } in"')
ELLIPSIS = f'{{"entities":[{E1},\n…\n],"relations":[]}}'
#: raw text, then what span, repair and strict make of it
CASES = [
    (R1, ONE, ONE, ONE),
    (FENCED, ONE, ONE, ONE),
    (f"Hier: {R1} klaar", ONE, ONE, ONE),
    (f"{R1} {R1}", None, ONE, ONE),
    (f'{{"entities":[{E1},', None, {"entities": ONE["entities"]}, None),
    (f'{{"entities":[{E1},{{"id":"E2","ty', None, ONE, None),
    ('{"entities":[]}', {"entities": []}, {"entities": []}, None),
    (FROM_TO, json.loads(FROM_TO), json.loads(FROM_TO), json.loads(FROM_TO)),
    (BRACE, json.loads(BRACE), json.loads(BRACE), None),
    ('{"entities":[{"id":"E1","type":"Action","text":"zie [A] nu"},{"id":"E2","ty', None, None, None),
    ("", None, None, None),
    (None, None, None, None),
    ("geen diagram", None, None, None),
    (ELLIPSIS, None, ONE, None),
    (f"Zie {{x}} hier: {FENCED}", ONE, None, None),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_policies(k):
    raw, *want = CASES[k]
    got = [recover.recover_text(raw, p)[0] for p in ("span", "repair", "strict")]
    if raw == BRACE:  # the last brace is the right one for span; a shifted brace leaves repair the harvest
        want[1] = {"entities": [{"id": "E1", "type": "Action", "text": "druk } in"}], "relations": []}
    assert [json.loads(x) if x else None for x in got] == want


def test_broken_policy_is_an_error_row():
    text, error, trace = recover.recover_text("{", "no such policy")
    assert text is None and error and "KeyError" in trace


@settings(max_examples=300, database=None)
@given(st.text(st.sampled_from('{}[],`"a \n:json'), max_size=40))
def test_never_raises(raw):
    for policy in recover.POLICIES:
        text, error, _ = recover.recover_text(raw, policy)
        assert error is None
        if text is not None:
            assert isinstance(json.loads(text), dict)


@settings(max_examples=200, database=None)
@given(st.dictionaries(st.sampled_from(["entities", "relations"]), st.lists(st.just({"id": "E1"}), max_size=2), min_size=2))
def test_whole_objects_survive_all_policies(graph):
    raw = "x " + json.dumps(graph) + " y"
    for policy in recover.POLICIES:
        assert json.loads(recover.recover_text(raw, policy)[0]) == graph


def test_pages(spark):
    rows = [("d", 1, FROM_TO), ("d", 2, "geen"), ("d", 3, None), ("d", 4, '{"entities":"x","relations":[]}')]
    got = recover.recovered_pages(spark.createDataFrame(rows, "doc_id string, page int, raw string"), "strict").orderBy("page").collect()
    assert (got[0].json.relations[0].source, got[0].json.relations[0].target) == ("E2", "E1")
    assert got[1].json is None and got[2].json is None
    kept = recover.recovered_pages(spark.createDataFrame(rows[:1], "doc_id string, page int, raw string"), "span", rename=False).first()
    assert kept.json.relations[0].source is None
    n = recover.page_success(recover.recovered_pages(spark.createDataFrame(rows[:3], "doc_id string, page int, raw string"))).first()
    assert (n.ok, n.total) == (1, 3)
