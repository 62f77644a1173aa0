"""Which of many pattern rules a text fits: the literals of all rules in one automaton choose the patterns to try.

Every pattern that fits must contain some text literally.  That literal, the longest
one that each match needs, is found by reading the parsed pattern; all of them go into
one Aho-Corasick automaton, which reads a text once and names the rules whose
literal stands in it.  Only those patterns are run; rules without a literal always
are.  So thousands of rules cost a text about what the few that come near it cost,
and the plan holds one stage instead of a branch for each rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from re import _parser  # the parsed form of a pattern

#: Bytes of rules that are sent to every task at most; more are an error, not a slow job.
MOST_BYTES = 64 << 20


def literal(pattern: str) -> str:
    """The longest text that every match of ``pattern`` contains, empty if none is certain; patterns that ignore case have none."""
    parsed = _parser.parse(pattern)
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ""
    best = run = ""
    for op, value in _needed(parsed):
        if op == "char":
            run += value
        else:
            run = ""
        best = max(best, run, key=len)
    return best


def _needed(parsed) -> Iterator[tuple[str, str]]:
    """Characters that follow each other in every match, and breaks between them."""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            yield "char", chr(value)
        elif name == "AT":  # an anchor takes no room
            continue
        elif name == "SUBPATTERN" and not value[1] and not value[2]:
            yield from _needed(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            yield from _needed(value[2])
            yield "break", ""
        else:
            yield "break", ""


class Matcher:
    """The rules ``(label, pattern)`` of a pack, in order."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.patterns = [re.compile(p) for _, p in rules]
        self.automaton, self.always, by_text = ahocorasick.Automaton(), [], {}
        for i, (_, p) in enumerate(rules):
            text = literal(p)
            if text:
                by_text.setdefault(text, []).append(i)
            else:
                self.always.append(i)
        for text, own in by_text.items():
            self.automaton.add_word(text, own)
        if by_text:
            self.automaton.make_automaton()
        self.empty = not by_text

    def near(self, text: str) -> list[int]:
        """Rules whose pattern has to be tried on a text, ascending."""
        found = set(self.always)
        if not self.empty:
            for _, own in self.automaton.iter(text):
                found.update(own)
        return sorted(found)

    def matches(self, text: str) -> list[int]:
        """Rules that a text fits, ascending."""
        return [i for i in self.near(text) if self.patterns[i].search(text)]


def match_rules(table: DataFrame, text: str, rules: Sequence[tuple[str, str]], name: str = "rules") -> DataFrame:
    """``table`` plus ``name``: the indexes of all rules that ``text`` fits, ascending; null and empty texts are matched as empty.

    The automaton is built once in each task from the rules, whose size is checked
    (``MOST_BYTES``); rows pass through in their batches.
    """
    rules = [(str(a), str(b)) for a, b in rules]
    size = sum(len(a) + len(b) for a, b in rules)
    if size > MOST_BYTES:
        raise ValueError(f"{size} characters of rules are more than {MOST_BYTES}")
    at = table.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules)
        for batch in batches:
            found = pa.array([matcher.matches(t or "") for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [f"c{i}" for i in range(len(batch.columns) + 1)])

    plain = table.toDF(*[f"c{i}" for i in range(len(table.columns))])
    schema = f"{plain.schema.simpleString()[7:-1]},c{len(table.columns)}:array<int>"
    out = plain.mapInArrow(run, schema)
    return out.toDF(*table.columns, name)
