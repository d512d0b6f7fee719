"""Markdown that an independent reader reads back is the normal form of the page."""

import pytest

import gfm
from lexloom.operators import render
from lexloom.operators.parser import parse
from test_engine import PLAIN, made

HAND = [
    "'''bold''' and ''it'' and '''''both'''''",
    "a'''b'''''c'' d",
    "''' spaced ''' '' !odd! ''",
    "[[a b|x]]![[c (d)]] [http://e.example/?a=1&b=2 s*t_u] [[e|'''f''' g]]",
    "1. no list\n\n- nor this\n\n+ this\n\n# one\n# two\n\n* a\n*# b\n*#* c\n* d\n\n* other\n\n* third",
    "* \n** x\n* y\n*# z",
    "== H # ''x'' ==\n=== ===\n====== six ======",
    "{|\n! A | !! B\n|-\n| 1 || [[x|y]]\n|-\n| `t` \\ | 2\n|}",
    " pre ''x''\n  more ``` ````\n\n<table>``` ``````</table>",
    "a < b & c &amp;lt; d &#42;e&#42; _f_ ~~g~~ `h` \\i [j] !k",
    "> quote\n\n#hash\n\n= eq\n\n~ tilde\n\n12) twelve\n\n{{t}} | pipe",
    "☕ é 漢字 '''é'''ñ",
]


def as_tuples(x):
    return tuple(map(as_tuples, x)) if isinstance(x, (list, tuple)) else x


def check(source):
    nodes = parse(source).nodes
    want, md = render.normal_form(nodes), render.markdown(nodes)
    assert as_tuples(gfm.read(md)) == as_tuples(want), (source, md)


@pytest.mark.parametrize("source", HAND + [p[0] for p in PLAIN])
def test_round_trip(source):
    check(source)


def test_round_trip_of_random_pages():
    for seed in range(6000):
        check(made(seed))


def test_reader():
    assert gfm.read("**a***b*\n\n- x\n  1. y\n\n* z\n\n| p |\n| --- |\n| \\| |") == [
        ("para", [("run", "a", True, False), ("run", "b", False, True)]),
        ("list", False, [([("run", "x", False, False)], [("list", True, [([("run", "y", False, False)], [])])])]),
        ("list", False, [([("run", "z", False, False)], [])]),
        ("table", [[[("run", "p", False, False)]], [[("run", "|", False, False)]]]),
    ]
