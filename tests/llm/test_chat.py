"""Template compiler and conversation formatting."""

import hashlib
import random

import pytest

import brute
from frameweave.llm import chat_format, suite
from frameweave.llm.templates import Const, If, Output, Template, TemplateError, escape, parse, fold, unescape


def show(source, messages):
    return "".join(t for t, _ in Template(source).render(messages))


MESSAGES = [{"role": "system", "text": " Be brief "}, {"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]


def test_rendering():
    source = "{% set eos = '</s>' %}<s>{% for m in messages %}{% if m.role == 'user' and not loop.first %}[{{ loop.index }}:{{ m.text | upper }}]{% elif loop.last %}{% generation %}{{ m.text }}{% endgeneration %}{{ eos }}{% else %}{{ m.text | trim | default('x') }}{% endif %}{% endfor %}!"
    assert show(source, MESSAGES) == "<s>Be brief[2:HI]yo</s>!"
    pieces = list(Template(source).render(MESSAGES))
    assert [t for t, g in pieces if g] == ["yo"]
    assert show(source, []) == ""
    assert show("{% for m in messages %}{{ 1 + 2 }}{{ 'a' ~ 2 }}{{ 7 % 4 }}{{ m.nothing }}{{ 'b' in m.role }}{% endfor %}", MESSAGES[:1]) == "3a23False"


def test_constants_are_folded():
    tree = fold(parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% elif true or m.role %}d{% else %}y{% endif %}{{ 'e' | upper }}{{ m }}"))
    assert tree[0] == Output(Const("abcdE")) and len(tree) == 2
    assert isinstance(fold(parse("{% if m %}a{% endif %}"))[0], If)


@pytest.mark.parametrize(
    "source",
    [
        "{{ m.text() }}", "{{ m['text'] }}", "{{ x | bad }}", "{% for m in other %}{% endfor %}", "{% if x %}", "{{ }}",
        "{% import os %}", "{{ a b }}", "{% endfor %}", "{{ __import__('os') }}", "no loop", "{% for m in messages %}",
        "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{{ 'open }}{% for m in messages %}{% endfor %}",
    ],
)
def test_outside_the_language(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_no_access_to_objects():
    assert show("{% for m in messages %}{{ m.__class__ }}{{ m.role.__class__ }}{% endfor %}", MESSAGES) == ""


def test_escaping_is_reversible():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choices(["\\", "<", "#", "###", "</turn>", ": ", "\n", "a", "é", "<chat>"], k=rng.randint(0, 12)))
        assert unescape(escape(text)) == text
        role = "".join(rng.choices(["user", ":", " ", "#", "\\", ": ", "<"], k=rng.randint(0, 4)))
        made = "".join(t for t, _ in Template(chat_format.TEMPLATE).render([{"role": role, "text": text}]))
        assert chat_format.read_turn(made) == (role, text)


def want(turns):
    out = []
    for conv in {t[0] for t in turns}:
        rows = sorted((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        loss = "".join(x for _, r, x in rows if r == "assistant")
        whole = "".join(t for t, _ in Template(chat_format.TEMPLATE).render([{"role": r, "text": x} for _, r, x in rows]))
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()
        out.append((conv, len(rows), digest, len(loss), brute.sha(loss), len(whole)))
    return sorted(out, key=str)


def test_conversations(spark):
    turns = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "assistant", ""), (3, 5, "tool", "x" * 100_000),
        (3, 5, "tool", "x"), (4, 0, "assistant", suite.HOSTILE), (4, 0, "assistant", suite.HOSTILE), (None, 0, "user", "n"),
        (None, 1, "assistant", "😀</turn>"), (6, 0, "a: b", "hi"), (6, 1, ": ", ": "), (6, 2, "user:", "x"), (0, 0, "user", "zero"), (5, None, "user", "é"),
    ] + [(9, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(3000)]
    random.Random(2).shuffle(turns)
    docs = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as place", "2 as n")
    formatted = chat_format.format_turns(docs)
    got = sorted(map(tuple, chat_format.conversation_report(formatted).collect()), key=str)
    assert got == want(turns)
    assert chat_format.conversation_report(chat_format.format_turns(docs.limit(0))).count() == 0
