import hashlib
import random
from itertools import groupby

import pytest
from hypothesis import given
from hypothesis import strategies as st

from repograph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segment string, n_turns int"


def render(template, turns):
    messages = iter([{"role": r, "text": t} for r, t in turns])
    pieces = list(chat.generate(chat.parse(template))({"messages": messages}, False))
    return "".join(p for p, _ in pieces if p is not None), "".join(p for p, made in pieces if p is not None and made)


def result(spark, rows, template=chat.TEMPLATE):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return chat.format_conversations(df, template)


def expected(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    order = sorted(rows, key=lambda r: (*key(r), r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    out = []
    for _, group in groupby(order, key):
        turns = [(r[0], r[2] or "", r[3] or "") for r in group]
        said = "".join(t for _, role, t in turns if role == "assistant")
        everything = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        length = sum(len(f"<s>[INST] {chat.escape(r)} [/INST] {chat.escape(t)}</s>\n") for _, r, t in turns)
        out.append((turns[0][0], len(turns), hashlib.sha256(everything.encode()).hexdigest(), len(said),
                    hashlib.sha256(said.encode()).hexdigest(), length))
    return sorted(out, key=repr)


@given(st.text(alphabet="<>/s[]INST\\ aé\n", max_size=60))
def test_escape_is_reversible_and_hides_controls(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


def test_language_of_templates():
    turns = [("user", " a "), ("assistant", "b"), ("user", "c")]
    template = (
        "{{ 'x' + 1 }}{% for m in messages %}{% if loop.first %}^{% elif loop.last and not m.role == 'assistant' %}${% else %}"
        "{{ loop.index0 }}{% endif %}{{ (m.role + ':') | upper }}{% generation %}{{ m.text | trim }}{% endgeneration %};{% endfor %}!")
    assert render(template, turns) == ("x1^USER:a;1ASSISTANT:b;$USER:c;!", "abc")
    assert render("{% for m in messages %}{% if m.role != 'user' or m.text == 'c' %}{{m.text}}{% endif %}{% endfor %}", turns) == ("bc", "")


def test_constants_are_folded():
    tree = chat.parse("a{{ 'b' | upper }}{% if 1 == 2 %}no{% else %}c{% endif %}{{ not 0 }}")
    assert tree == chat.Node("list", None, (chat.Node("text", "aBcTrue"),))


@pytest.mark.parametrize("template", [
    "{{ m.__class__ }}", "{{ open('x') }}", "{% import os %}", "{% for m in range %}{% endfor %}", "{% if 1 %}", "{{ 1 +",
    "{{ 'a' | safe }}", "{{ m.role.upper }}", "{% for m in messages %}", "{{ messages }}", "{{ }}", "{{ (1 }}"])
def test_nothing_else_can_be_written(template):
    with pytest.raises(chat.TemplateError):
        chat.parse(template + ("}}" if template.endswith("+") else ""))


def rows_of(n):
    pick = random.Random(n)
    said = lambda: "".join(pick.choices(["</s>", "[INST]", "[/INST]", "<s>", "\\", "é ", "word ", "\n", "<", "["], k=pick.randint(0, 12)))
    rows = [(c, t, pick.choice(["user", "assistant", "system", "to[INST]ol", None]), pick.choice([said(), None, ""]))
            for c in range(n) for t in range(pick.randint(1, 9))]
    return [*rows, *rows[:5], (None, 1, "user", "a"), (None, None, "assistant", "b"), (3, None, "assistant", "first"),
            (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_round_trip(spark):
    rows = rows_of(60)
    random.Random(1).shuffle(rows)
    assert sorted(map(tuple, chat.read_back(result(spark, rows)).collect()), key=repr) == expected(rows)


def test_long_conversations_come_in_segments(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t} é" * 50_000) for t in range(40)] + [(2, 0, "user", "x" * 3_000_000)]
    formatted = result(spark, rows)
    assert formatted.where("conv_id = 1").count() > 5
    assert sorted(map(tuple, chat.read_back(formatted).collect()), key=repr) == expected(rows)


def test_spans_mark_what_is_learnt(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a</s>b")]
    row = result(spark, rows).collect()[0]
    assert [row.text[a:b] for a, b in zip(row.starts, row.stops, strict=True)] == ["a<\\/s>b"]


def test_empty_table(spark):
    assert chat.read_back(result(spark, [])).collect() == []
