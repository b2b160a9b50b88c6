"""Literals that a pattern cannot match without, read off the pattern itself.

A text without any literal of a pattern is not matched by it, so the pattern
need not be tried. The literals are lower case and hold no white space; a text
is looked up in lower case.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

import ahocorasick

#: What one more character of a literal is taken to save: only for the choice among sound sets.
_RATE = 12.0


def _cost(literals: frozenset[str]) -> float:
    return sum(_RATE ** -len(x) for x in literals)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    if a is None or b is None:
        return a or b
    return a if _cost(a) <= _cost(b) else b


def _sequence(items) -> frozenset[str] | None:
    """The cheapest set of literals of which each match of the items in turn holds one, or nothing."""
    best, run = None, ""
    for op, value in [*items, (None, None)]:
        if op is C.LITERAL and not chr(value).isspace():
            run += chr(value).lower()
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            if value[0]:
                best = _better(best, _sequence(list(value[2]) * min(value[0], 3)))
        elif op is C.SUBPATTERN:
            best = _better(best, _sequence(value[3]))
        elif op is C.ATOMIC_GROUP:
            best = _better(best, _sequence(value))
        elif op is C.BRANCH:
            parts = [_sequence(x) for x in value[1]]
            if all(parts):
                best = _better(best, frozenset().union(*parts))
        elif op is C.IN and all(o is C.LITERAL and not chr(v).isspace() for o, v in value):
            best = _better(best, frozenset(chr(v).lower() for _, v in value))
    return best


def literals(pattern: re.Pattern) -> frozenset[str] | None:
    """Literals one of which is in the lower-cased form of every match; nothing if the pattern needs none.

    Look-arounds, optional parts and classes of characters need nothing.
    """
    return _sequence(_parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE))


class Prefilter:
    """An automaton of the literals of numbered patterns."""

    def __init__(self, patterns: list[re.Pattern]):
        self.patterns = patterns
        owners: dict[str, set[int]] = {}
        always = set()
        for k, p in enumerate(patterns):
            found = literals(p)
            if not found:
                always.add(k)
            for x in found or ():
                owners.setdefault(x, set()).add(k)
        self.always = frozenset(always)
        self._found = ahocorasick.Automaton()
        for x, ks in owners.items():
            self._found.add_word(x, frozenset(ks))
        self._found.make_automaton()

    def may_match(self, low: str, free: bool = True) -> list[re.Pattern]:
        """The patterns that can match a text with this lower-cased form, in their order; those without literals if ``free``."""
        # these match i and s where case is ignored, but are not written so in lower case
        if not low.isascii() and ("ſ" in low or "ı" in low or "̇" in low):
            return self.patterns
        ks = set(self.always) if free else set()
        for _, more in self._found.iter(low):
            ks |= more
        return [self.patterns[k] for k in sorted(ks)]
