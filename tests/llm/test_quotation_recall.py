"""Links of generated conversations: how many quotes of each kind lead to the message that they were taken from."""

import random
import textwrap

import pytest

from sightline.llm import chat

KINDS = ["whole", "line", "wrapped", "upper", "nested", "part", "part wrapped"]


def sentence(r):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(r.randint(9, 16))).capitalize() + "."


def mark(lines, marks="> "):
    return "\n".join(marks + x for x in lines)


def conversation(r, kind):
    """Turns (text, reply_to): five messages of several lines, and a sixth that quotes one of them; a seventh quotes that, nested."""
    texts = ["\n".join(sentence(r) for _ in range(r.randint(2, 4))) for _ in range(5)]
    origin = r.randrange(5)
    lines = texts[origin].split("\n")
    words = r.choice(lines).split()
    at = r.randint(1, 3)
    quoted = {"whole": lines, "line": [r.choice(lines)], "wrapped": textwrap.wrap(" ".join(lines), 37), "upper": [r.choice(lines).upper()], "nested": lines, "part": [" ".join(words[at : at + 6])], "part wrapped": textwrap.wrap(" ".join(words[at : at + 7]), 20)}[kind]
    answer = sentence(r)
    rows = [(t, None) for t in texts] + [(f"someone wrote:\n{mark(quoted)}\n{answer}", origin + 1)]
    if kind == "nested":
        rows.append((f"{mark(quoted, '> > ')}\n{mark([answer])}\n{sentence(r)}", 6))
    return rows


@pytest.fixture(scope="module")
def linked(spark):
    r = random.Random(11)
    made = {f"{kind} {i}": conversation(r, kind) for kind in KINDS for i in range(30)}
    rows = [(conv, turn, "user", text) for conv, turns in made.items() for turn, (text, _) in enumerate(turns, 1)]
    got = chat.link_quotations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    return made, {(x.conv_id, x.turn): x for x in got}


@pytest.mark.parametrize("kind", KINDS)
def test_recall_by_kind(linked, kind):
    made, got = linked
    asked = [(conv, turn, reply) for conv, turns in made.items() if conv.rsplit(" ", 1)[0] == kind for turn, (_, reply) in enumerate(turns, 1) if reply]
    assert sum(got[conv, turn].reply_to == reply for conv, turn, reply in asked) >= 0.9 * len(asked)
    assert all(">" not in got[conv, turn].text for conv, turn, _ in asked)


def test_messages_without_quotes_link_nothing(linked):
    made, got = linked
    assert all(got[conv, turn].reply_to is None and got[conv, turn].unlinked is None and got[conv, turn].text == text for conv, turns in made.items() for turn, (text, reply) in enumerate(turns, 1) if not reply)


def test_quotes_of_nothing_are_kept_apart(spark):
    rows = [(1, 1, "a", "One text of this conversation."), (1, 2, "b", "> words that nobody here has ever said before\nAn answer.")]
    got = {r.turn: r for r in chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[2].text, got[2].reply_to, got[2].unlinked) == ("An answer.", None, "words that nobody here has ever said before") and got[1].unlinked is None
