"""Texts made from patterns, and the literals that patterns need."""

import random
import re
from re import _constants as C
from re import _parser

import pytest

from millrace.llm.prefilter import Prefilter, literals


def examples(pattern: re.Pattern, n: int = 600, seed: int = 0) -> set[str]:
    """Random texts that the pattern matches."""
    rng = random.Random(seed)
    groups: dict[int, str] = {}

    def one(op, v):
        if op is C.LITERAL:
            return chr(v)
        if op is C.NOT_LITERAL or op is C.ANY:
            return rng.choice("x  .")
        if op is C.IN:
            if v[0][0] is C.NEGATE:
                return next(c for c in rng.sample("ab1 .", 5) if re.match(pattern_of(v), c))
            o, a = rng.choice(v)
            return {C.LITERAL: lambda: chr(a), C.RANGE: lambda: chr(rng.randint(*a)), C.CATEGORY: lambda: {C.CATEGORY_WORD: "a", C.CATEGORY_DIGIT: "4", C.CATEGORY_SPACE: " "}[a]}[o]()
        if op is C.MAX_REPEAT or op is C.MIN_REPEAT:
            return "".join(run(v[2]) for _ in range(rng.randint(v[0], min(v[1], v[0] + 2))))
        if op is C.SUBPATTERN:
            text = run(v[3])
            if v[0]:
                groups[v[0]] = text
            return text
        if op is C.BRANCH:
            return run(rng.choice(v[1]))
        return groups[v] if op is C.GROUPREF else ""

    def pattern_of(v):
        inside = "".join({C.LITERAL: lambda a: re.escape(chr(a)), C.RANGE: lambda a: f"{chr(a[0])}-{chr(a[1])}", C.CATEGORY: lambda a: {C.CATEGORY_WORD: r"\w", C.CATEGORY_NOT_WORD: r"\W", C.CATEGORY_DIGIT: r"\d", C.CATEGORY_SPACE: r"\s"}[a]}[o](a) for o, a in v[1:])
        return f"[^{inside}]"

    run = lambda items: "".join(one(op, v) for op, v in items)
    made = {run(_parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE)) for _ in range(n)}
    return {x for x in made if pattern.search(x)}


@pytest.mark.parametrize(("pattern", "want"), [(r"a(?:bc|def)g?", {"bc", "def"}), (r"x{3,}|tbd", {"xxx", "tbd"}), (r"(?:now )?go(?!od)", {"go"}), (r"server is down", {"server"}), (r"a?\d+", None), (r"[$#]\{", {"{"})])
def test_literals(pattern, want):
    assert literals(re.compile(pattern)) == want


def test_case():
    p = re.compile("insert it", re.I)
    found = Prefilter([p])
    assert found.may_match("INSERT IT".lower()) == [p] and found.may_match("inſert it") == [p] and found.may_match("nothing") == []
