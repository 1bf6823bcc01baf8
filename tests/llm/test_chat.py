import hashlib
import json
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from climaspark.llm import chat as C
from climaspark.llm.queries import op5_chat_formatting, table


def segment(role, text):
    esc = lambda s: "".join("\\" + c if c in "\\[]<" else c for c in s)
    return f"<s>{esc(text)}</s>" if role == "assistant" else f"[INST {esc(role)}]{esc(text)}[/INST]"


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a]b", "", "x\\"]), st.text(alphabet="\\[]</s>INST \né", max_size=20)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_round_trip(turns):
    assert C.read_segments("".join(segment(*t) for t in turns)) == [(r, t, r == "assistant") for r, t in turns]


def test_broken_text():
    for text in ("<s>open", "plain", "[INST user]x"):
        with pytest.raises(ValueError):
            C.read_segments(text)


def test_whole_table(spark, sf):
    conversations = defaultdict(list)
    for r in table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        conversations[r["conv_id"]].append((r["role"], r["text"] or ""))
    conversations[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in op5_chat_formatting(spark, sf).collect()}
    assert set(got) == set(conversations)
    for i, turns in conversations.items():
        said = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(segment(*t)) for t in turns))
        assert tuple(got[i])[1:] == want


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages"),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations"),
    ({"prompt": "q", "response": "a"}, "prompt-response"),
    ({"completion": "a", "prompt": "q"}, "prompt-completion"),
    ({"instruction": "q", "output": "a"}, "instruction"),
]


def test_layouts_become_the_same_turns(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(LAYOUTS)]
    got = C.canonical(spark.createDataFrame(rows, "conv_id long, record string")).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["layout"], r["role"], r["text"]) for r in got] == [(i, name, *t) for i, (_, name) in enumerate(LAYOUTS) for t in (("user", "q"), ("assistant", "a"))]


def test_fields_in_another_order_and_absent_input(spark):
    rows = [(0, '{"output": "a", "input": null, "instruction": "q"}'), (1, '{"response": "a", "prompt": "q"}')]
    got = C.canonical(spark.createDataFrame(rows, "conv_id long, record string"))
    assert [(r["role"], r["text"]) for r in got.where("conv_id = 0").orderBy("place").collect()] == [("user", "q"), ("assistant", "a")]
    assert got.where("conv_id = 1").count() == 2


def test_unknown_and_broken_records_are_seen(spark):
    got = C.canonical(spark.createDataFrame([(0, '{"x": 1}'), (1, "not json"), (2, None), (3, '{"messages": []}')], "conv_id long, record string")).collect()
    assert sorted(r["conv_id"] for r in got if r["layout"] is None) == [0, 1, 2, 3]


def test_odd_turns(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "tie"), (None, 0, "user", "x"), (2, None, "tool", "🎉"), (1, 0, "user", "tie")]
    d = C.digests(C.formatted(C.canonical(C.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), order="turn")))
    assert {r["conv_id"]: r["n_turns"] for r in d.collect()} == {1: 3, None: 1, 2: 1}
    assert C.digests(C.formatted(C.canonical(C.records_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string")), order="turn"))).count() == 0


def test_mixed_layouts(spark, sf):
    """Six layouts, chosen by their fingerprints, give the digests of the rows by turn."""
    from climaspark.llm.queries import chat_mixed_layouts

    want = {r["conv_id"]: tuple(r) for r in op5_chat_formatting(spark, sf).where("conv_id != -7").collect()}
    assert {r["conv_id"]: tuple(r) for r in chat_mixed_layouts(spark, sf).collect()} == want
    layouts = {r["layout"] for r in C.canonical(C.mixed_records(table(spark, sf, "conversations")), order="turn").select("layout").distinct().collect()}
    assert None not in layouts and len(layouts) >= 3


def test_every_layout_of_mixed_records(spark):
    rows = [(i, t, r, f"{r}<s>{i}") for i in range(9) for t, r in enumerate(["user", "assistant"] if i < 3 else ["user", "assistant", "user"] if i < 6 else ["human", "x]", None])]
    table_ = spark.createDataFrame(rows + [(None, 0, None, None)], "conv_id long, turn long, role string, text string")
    turns = C.canonical(C.mixed_records(table_), order="turn")
    assert {r["layout"] for r in turns.select("layout").distinct().collect()} == {"prompt-response", "prompt-completion", "instruction", "messages", "conversations", "turn"}
    a, b = (sorted(map(str, C.digests(C.formatted(x)).collect())) for x in (turns, C.canonical(C.records_of(table_), order="turn")))
    assert a == b


def test_a_text_beyond_the_parser_s_default_length(spark):
    n = 21_000_000
    d = spark.range(1).selectExpr("5L as conv_id", "0L as turn", "'assistant' as role", f"repeat('[long] ', {n // 7}) as text")
    got = C.digests(C.formatted(C.canonical(C.records_of(d), order="turn"))).first()
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (1, n, hashlib.sha256(b"[long] " * (n // 7)).hexdigest())
