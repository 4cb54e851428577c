import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

import __spark_entry__
from tracequarry.llm import chat
from tracequarry.llm.chat import CLOSE, MID, OPEN, TEMPLATE, TemplateError, compiled, digests, escape, fold, format_parts, parse, unescape


def plain(rows):
    turns = "".join(f"{r}\n{t}\n" for _, r, t in rows)
    loss = "".join(t for _, r, t in rows if r == "assistant")
    chars = sum(len(OPEN + MID + CLOSE) + len(escape(r)) + len(escape(t)) for _, r, t in rows)
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars


def check(rows, frame):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    key = lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode())
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(str((c, *plain(sorted(own, key=key)))) for c, own in convs.items())


def test_query_against_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    sure = "</s>[INST] ok [/INST]"
    check([*rows, (-7, 0, "user", sure), (-7, 1, "assistant", sure)], __spark_entry__.queries()["op8_chat_format"](spark, sf))


def test_odd_conversations(spark, monkeypatch):
    odd = "\\ [\\INST] </s> <\\/s> [INST][/INST] \\"
    rows = [(1, 0, "assistant", odd), (1, 0, "assistant", odd), (1, 1, None, None), (None, 3, "us\ner", "é😀"), (None, None, "a]b[/INST]", "x"), (2, 0, "assistant", ""), (3, 5, "assistant", "long " * 400_000), (3, 6, "user", "[" * 9)]
    rows += [(4, k, "assistant" if k % 2 else "user", f"{k} {odd}") for k in range(3000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    check(rows, digests(format_parts(frame)))
    assert digests(format_parts(frame.limit(0))).count() == 0


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s"]), st.text("\\[]/INST<s> a😀"))))
def test_round_trip(turns):
    pieces = compiled(TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert list(chat._read_back(pieces)) == [(r, t, t if r == "assistant" else "") for r, t in turns]


@given(st.text("\\[]/INST<s> a"))
def test_escape(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in (OPEN, MID, CLOSE))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{{ 'b' + 'c' }}d", "abcd"),
        ("{% if 1 == 2 %}x{% elif not false and (true or nothing) %}y{% else %}z{% endif %}", "y"),
        ("{% for m in messages %}{{ loop.index }}{% if loop.first %}<{% endif %}{{ m.role | upper }}{% if not loop.last %},{% endif %}{% endfor %}", "1<A,2B"),
        ("{% set x = 'q' | upper %}{{ x }}{{ missing }}{{ messages.role }}{{ 1 + 2 }}{{ true }}", "Q3true"),
    ],
)
def test_language(source, want):
    assert "".join(t for t, _ in compiled(source)({"messages": [{"role": "a"}, {"role": "b"}]})) == want


def test_folding():
    assert fold(parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% endif %}")) == ("block", ("text", "abcd"))
    assert [p for p in compiled("x{% generation %}{{ 'y' }}{% endgeneration %}z")({})] == [("x", False), ("y", True), ("z", False)]


@pytest.mark.parametrize("source", ["{{ x() }}", "{{ x[0] }}", "{{ x | exec }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ x", "{% import os %}", "{{ (x }}", "{{ 1 2 }}", "{% endif %}", "{{ x. }}"])
def test_outside_the_sandbox(source):
    with pytest.raises(TemplateError):
        compiled(source)


def test_fields_are_of_mappings_only():
    assert "".join(t for t, _ in compiled("{{ x.__class__ }}{{ x.real }}")({"x": 3})) == ""
