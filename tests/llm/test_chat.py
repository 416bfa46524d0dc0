import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowgauge.llm import chat

CONTROL = st.lists(st.sampled_from(["\\", "#", "##", "###", " ", ": ", "<", "</turn>", "\n", "a", "é", "\\0", "0", "### user: "]), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.none(), CONTROL), CONTROL), max_size=5)


@settings(max_examples=500, database=None)
@given(TURNS)
def test_round_trip(turns):
    formatted = "".join(chat.render(r, t)[0] for r, t in turns)
    assert chat.parse(formatted) == turns


@settings(max_examples=300, database=None)
@given(st.one_of(st.none(), CONTROL), CONTROL)
def test_mask(role, text):
    said, lo, hi = chat.render(role, text)
    assert chat.unescape(said[lo:hi]) == text


def test_no_marker_starts_inside_a_text():
    said, lo, hi = chat.render("user", r"\### Assistant: </turn> ok ####")
    inside = chat.ESCAPED.sub("", said[lo:hi])
    assert chat.OPEN.strip() not in inside and "</turn>" not in inside


@pytest.mark.parametrize("broken", ["### user: a", "x### user: a </turn>\n", "### user a </turn>\n"])
def test_parse_refuses(broken):
    with pytest.raises(ValueError):
        chat.parse(broken)


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "extra": {"x": [1]}}]}, [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}, [("user", "q"), ("assistant", "a")]),
    ({"system": "s", "messages": [{"role": "user", "content": "q"}]}, [("system", "s"), ("user", "q")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": None}, [("user", "do\n\nthis"), ("assistant", "")]),
    ({"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"system": "", "prompt": "q", "response": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"question": "q", "answer": {"n": 1}}, None),
    ({"chat": {"prompt": "q", "reply": "a"}}, [("user", "q"), ("assistant", "a")]),
    ({"role": None, "text": "t"}, [(None, "t")]),
    ({"other": 1}, None),
    ([], None),
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_layouts(k):
    record, want = LAYOUTS[k]
    name, turns = chat.Registry().turns(json.dumps(record))
    assert (turns if name else None) == want


def test_prints_differ():
    assert len(chat.Registry().by_print) == len(chat.LAYOUTS)
    assert chat.Registry().turns("{broken") == (None, []) and chat.Registry().turns(None) == (None, [])


BAD = ["[" * 3000 + "]" * 3000, '{"role": "user", "text": ' + "[" * 2000 + "]" * 2000 + "}", '{"messages": {"role": "a"}}', '{"messages": []}', '{"messages": [3, null]}', "7", "null", "NaN", "", "{broken", "1" * 5000]


@pytest.mark.parametrize("k", range(len(BAD)))
def test_bad_records_give_no_turns(k):
    assert chat.Registry().turns(BAD[k]) == (None, [])


def test_deep_and_half_characters(spark):
    """Values below the layouts' paths may be nested; half a surrogate pair is no text."""
    deep = '{"role": "user", "text": "t", "extra": ' + "[" * 300 + "]" * 300 + "}"
    rows = [(1, 0, r'{"role": "us\ud800er", "text": "a\ud800b \ud83d\ude00"}'), (2, 0, deep), (3, 0, BAD[0]), (4, 0, r'{"role": "user", "text": {"\udfff": 1}}')]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string"))
    got = {r.conv_id: (r.role, r.text) for r in turns.collect()}
    assert got == {1: ("us\ufffder", "a\ufffdb \U0001f600"), 2: ("user", "t"), 3: (None, None), 4: (None, None)}
    assert chat.digests(chat.format_turns(turns)).count() == 2


def test_conversations(spark):
    turns = [{"role": "user", "text": "hi\n### "}, {"role": "assistant", "text": None}, {"role": None, "text": "x"}]
    rows = [(1, 0, turns[0]), (1, 1, turns[1]), (1, 1, turns[1]), (None, 5, turns[2]), (2, None, {"messages": [{"role": "assistant", "content": "a"}, {"role": "assistant", "content": "b"}]}), (3, 0, {"odd": 1})]
    df = spark.createDataFrame([(c, t, json.dumps(r), "z") for c, t, r in rows], "conv_id long, turn long, record string, seq string").repartition(3)
    canonical = chat.canonical_turns(df)
    assert canonical.where("layout is null").count() == 1
    segments = chat.format_turns(canonical)
    got = {r.conv_id: r for r in chat.digests(segments).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, None}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (3, sha("user\nhi\n### \n" + "assistant\n\n" * 2), 0)
    assert (got[2].loss_chars, got[2].loss_sha256) == (2, sha("ab"))
    assert got[None].turns_sha256 == sha("\nx\n")
    whole = {r.conv_id: r for r in chat.whole(segments).collect()}
    assert len(whole[2].formatted) == got[2].formatted_chars
    assert [whole[2].formatted[m.start : m.end] for m in whole[2].mask] == ["a", "b"]
    assert chat.digests(chat.format_turns(chat.canonical_turns(df.limit(0)))).count() == 0


def test_long_conversation_passes_in_batches(spark):
    df = spark.range(3000).selectExpr("7L as conv_id", "id as turn", "to_json(named_struct('role', if(id % 2 = 0, 'user', 'assistant'), 'text', repeat('ab', 50))) as record")
    r = chat.digests(chat.format_turns(chat.canonical_turns(df))).collect()
    assert [(x.n_turns, x.loss_chars) for x in r] == [(3000, 150_000)]
