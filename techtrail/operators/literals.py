"""What every text that an expression matches must contain: a cheap test before the expression itself."""

from __future__ import annotations

import re
import warnings
from re import _constants as op
from re import _parser


def _best(sets: list[frozenset[str]]) -> frozenset[str] | None:
    """Of several sets, of each of which a text must contain a literal, the one whose shortest literal is longest; of equal ones the one with fewer literals."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _of_sequence(items) -> list[frozenset[str]]:
    """Sets of literals, of each of which what items match contains one."""
    found: list[frozenset[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            found.append(frozenset([run]))
        run = ""

    for kind, value in items:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):  # they take up no text, so what stands on their sides is adjacent
            continue
        end()
        if kind is op.SUBPATTERN:
            _, on, off, inner = value
            if not (on | off) & re.IGNORECASE:
                found += _of_sequence(inner)
        elif kind is op.ATOMIC_GROUP:
            found += _of_sequence(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, _, inner = value
            if least:
                found += _of_sequence(inner)
        elif kind is op.BRANCH:
            of = [_best(_of_sequence(x)) for x in value[1]]
            if all(of):
                found.append(frozenset().union(*of))
    end()
    return found


def _is_plain(pattern: str) -> bool:
    """Whether Java and Python read the expression alike: no class within a class, no intersections."""
    return not re.search(r"\[[^\]\\]*(?:\\.[^\]\\]*)*\[|&&", pattern)


def parsed(pattern: str):
    """The parsed expression, or None if the two dialects may differ in it."""
    if not _is_plain(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return _parser.parse(pattern)
    except (re.error, Warning, OverflowError, RecursionError):
        return None


def required(pattern: str, ignore_case: bool = False, least: int = 2) -> list[str] | None:
    """Literals one of which is in every text with a match, or None if there are none of so many letters; without case, all in small letters.

    Without case only ASCII literals count, as case is ASCII's alone in the expressions.
    """
    tree = parsed(pattern)
    if tree is None or (tree.state.flags & re.IGNORECASE and not ignore_case):
        return None
    sets = [s for s in _of_sequence(tree) if min(map(len, s)) >= least and (not ignore_case or all(x.isascii() for x in s))]
    best = _best(sets)
    return sorted({x.lower() if ignore_case else x for x in best}) if best else None


def _looks_around(items) -> bool:
    for kind, value in items:
        if kind in (op.ASSERT, op.ASSERT_NOT) or (kind is op.AT and value not in (op.AT_BEGINNING, op.AT_END, op.AT_BOUNDARY, op.AT_NON_BOUNDARY)):
            return True
        inner = [value[3]] if kind is op.SUBPATTERN else [value] if kind is op.ATOMIC_GROUP else [value[2]] if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) else value[1] if kind is op.BRANCH else []
        if kind is op.POSSESSIVE_REPEAT or any(map(_looks_around, inner)) or kind in (op.ATOMIC_GROUP, op.GROUPREF_EXISTS):
            return True
    return False


def holds_for_texts(pattern: str) -> bool:
    """Whether an expression that matches a line matches, with ^ and $ at lines, a text with that line too: it does if nothing in it asks what stands further around and no repeat refuses to give back."""
    tree = parsed(pattern)
    return tree is not None and not _looks_around(tree)


def _anchored(items) -> bool:
    for kind, value in items:
        if kind is op.AT and value in (op.AT_BEGINNING, op.AT_END):
            return True
        inner = [value[3]] if kind is op.SUBPATTERN else [value[2]] if kind in (op.MAX_REPEAT, op.MIN_REPEAT) else value[1] if kind is op.BRANCH else []
        if any(map(_anchored, inner)):
            return True
    return False


def asks_for_ends(pattern: str) -> bool:
    """Whether an expression that holds for texts asks where a line begins or ends."""
    return _anchored(parsed(pattern))
