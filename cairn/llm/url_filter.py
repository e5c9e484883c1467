"""URL filters: all glob rules at once over each canonical URL, by a bit-parallel automaton.

Every rule is a chain of states, one bit each, over as many 64-bit words as all rules need. A byte c takes the states D to
``((D << 1) & STEP[c]) | (D & STAY[c])``: Shift-And, where wildcards are states that may stay. A start state's bit
isn't in STEP, so what is shifted out of the rule before it is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import text_buffer, tidy
from cairn.session import bounded_batches

_U = np.uint64
#: Words of states that are held for a URL at a time: rules beyond take further passes over the batch.
WORDS = 64
#: URLs at a time; fewer than this are taken one by one, with Python's own long integers for states.
ROWS, FEW = 4096, 4


@dataclass(frozen=True)
class Rule:
    """What ``action`` befalls URLs that any of ``globs`` meets; the rule with the greatest ``weight`` wins, then the earlier one."""

    name: str
    action: str
    globs: tuple[str, ...]
    weight: int


def site_rule(action: str, host: str, path: str = "/") -> Rule:
    """A host and all its subdomains, where the path starts with ``path``; the longest such rule wins."""
    plain = _quoted(host + path)
    return Rule(host + path, action, (f"{plain}**", f"*.{plain}**"), len(host + path))


def glob_rule(action: str, glob: str) -> Rule:
    """A glob over host and path that stands behind all site rules."""
    return Rule(glob, action, (glob,), -1)


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in "*?[\\" else c for c in text)


def _parsed(glob: str) -> tuple[list[tuple[frozenset[int], bool]], list[str]]:
    """A glob as steps (bytes it takes, whether it is ``?``) and the wildcard after each step, the first one before all."""
    steps: list[tuple[frozenset[int], bool]] = []
    stars, i = [""], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            n = len(glob[i:]) - len(glob[i:].lstrip("*"))
            stars[-1] = "**" if n > 1 or stars[-1] == "**" else "*"
            i += n
            continue
        if c == "?":
            steps.append((frozenset(range(256)) - frozenset(range(0x80, 0xC0)) - {ord("/")}, True))
            stars.append("")
        elif end > 0 and glob[i + 1 : end].isascii():
            steps.append((frozenset(map(ord, glob[i + 1 : end])), False))
            stars.append("")
            i = end
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            for byte in c.encode():
                steps.append((frozenset([byte]), False))
                stars.append("")
        i += 1
    return steps, stars


class Automaton:
    """The masks of some globs: ``*`` is a run without ``/``, ``**`` any run, ``?`` a character but ``/``, ``[abc]`` one of these, a backslash quotes."""

    def __init__(self, globs: Sequence[str]):
        parsed = [_parsed(g) for g in globs]
        self.bits = sum(len(steps) + 1 for steps, _ in parsed)
        self.words = max(1, -(-self.bits // 64))
        step, stay, start, ends, at = [0] * 256, [0] * 256, 0, [], 0
        for steps, stars in parsed:
            start |= 1 << at
            for k, star in enumerate(stars):
                if k:
                    for byte in steps[k - 1][0]:
                        step[byte] |= 1 << (at + k)
                for byte in range(256):
                    if star == "**" or (star == "*" and byte != ord("/")) or (k and steps[k - 1][1] and 0x80 <= byte < 0xC0):
                        stay[byte] |= 1 << (at + k)
            ends.append(at + len(steps))
            at += len(steps) + 1
        every = sum(1 << e for e in ends)
        for byte in range(256):
            every &= stay[byte]
        self.step, self.stay, self.start, self.ends = step, stay, start, ends
        #: States that nothing takes away and that lead nowhere: with these alone left, the rest of a URL changes nothing.
        self.settled = every
        split = lambda x: np.array([(x >> (64 * w)) & (2**64 - 1) for w in range(self.words)], _U)
        self._step, self._stay = np.stack([split(x) for x in step]), np.stack([split(x) for x in stay])
        self._start, self._open = split(start), ~split(every)

    def _one(self, data: np.ndarray, state: int) -> int:
        step, stay, live = self.step, self.stay, ~self.settled
        for byte in data.tobytes():
            state = ((state << 1) & step[byte]) | (state & stay[byte])
            if not state & live:
                break
        return state

    def final_states(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """States at the end of each text, a row of words each. Texts go byte by byte, all at once; a text leaves when it ends or settles."""
        states = np.tile(self._start, (len(starts), 1))
        rows, at = np.flatnonzero(ends > starts), starts.copy()
        while len(rows) > FEW:
            d, byte = states[rows], data[at[rows]]
            moved = d << _U(1)
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> _U(63)
            states[rows] = d = (moved & self._step[byte]) | (d & self._stay[byte])
            at[rows] += 1
            rows = rows[(at[rows] < ends[rows]) & (d & self._open).any(1)]
        for r in rows:
            state = self._one(data[at[r] : ends[r]], int.from_bytes(states[r].astype("<u8").tobytes(), "little"))
            states[r] = np.frombuffer(state.to_bytes(8 * self.words, "little"), "<u8")
        return states

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the globs (columns) take which texts (rows) as a whole."""
        states = self.final_states(data, starts, ends)
        e = np.array(self.ends, np.int64)
        return (states[:, e // 64] >> (e % 64).astype(_U)) & _U(1) == 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path of a URL, both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    whole = F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1)
    host = F.regexp_extract(whole, r"(?s)\A([^/]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.substr(whole, F.char_length(host) + 1)


def _portions(rules: Sequence[Rule]) -> list[tuple[Automaton, list[int]]]:
    """Automata of at most ``WORDS`` words each (a longer glob has its own), and each glob's rule."""
    out, globs, owners, bits = [], [], [], 0
    for i, rule in enumerate(rules):
        for glob in rule.globs:
            n = len(glob.encode()) + 1
            if globs and bits + n > 64 * WORDS:
                out.append((Automaton(globs), owners))
                globs, owners, bits = [], [], 0
            globs.append(glob)
            owners.append(i)
            bits += n
    return [*out, (Automaton(globs), owners)] if globs else out


def _winners(portions: list[tuple[Automaton, list[int]]], order: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the winning rule's place in order of precedence, or the number of rules."""
    n, none = len(offsets) - 1, len(order)
    place = np.empty(none + 1, np.int64)
    place[order], place[none] = np.arange(none), none
    won = np.full(n, none)
    for a in range(0, n, ROWS):
        starts, ends = offsets[a : a + ROWS + 1][:-1], offsets[a : a + ROWS + 1][1:]
        for automaton, owners in portions:
            met = np.where(automaton.matches(data, starts, ends), place[np.array(owners)], none)
            won[a : a + ROWS] = np.minimum(won[a : a + ROWS], met.min(1))
    return won


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``: of the rules that take host and path, the weightiest one's action; else ``default`` and a null rule.

    Only host and path are looked at: a query or fragment never counts. Null URLs, and those without
    ``://``, have an empty host and path, which ``**`` alone takes. Columns of ``pages`` with the new ones'
    names are replaced, all others stay. Very long URLs are read byte by byte, until what is left can't change the result;
    memory is some 8 bytes a word of states for 4,096 URLs at a time. ``rules`` are a parameter that travels with the
    tasks: 4 KB for every 64 characters of globs. A repeated row has its own verdict; an empty table or no rules are fine.
    """
    bounded_batches(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"))
    order = np.array(sorted(range(len(rules)), key=lambda i: (-rules[i].weight, i)), np.int64)
    names = pa.array([*[rules[i].name for i in order], None], pa.string())
    verdicts = pa.array([*[rules[i].action for i in order], default], pa.string())
    fields, globs = [f"`{f.name}` {f.dataType.simpleString()}" for f in split.schema], list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portions = _portions(globs)
        for batch in batches:
            n = batch.num_columns
            data, offsets = _joined(batch.column(n - 2), batch.column(n - 1))
            won = pa.array(_winners(portions, order, data, offsets))
            yield pa.RecordBatch.from_arrays([*batch.columns, names.take(won), verdicts.take(won)], [*batch.schema.names, "rule", "verdict"])

    return split.mapInArrow(tidy(run), ", ".join([*fields, "rule string", "verdict string"]))


def _joined(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.large_string()
    return text_buffer(pc.binary_join_element_wise(host.cast(wide), path.cast(wide), pa.scalar("", wide)))


#: The query's rules: sites as the contract has them, and globs for what none of them decides.
SITES = (site_rule("block", "net"), site_rule("allow", "example.net", "/en/"), site_rule("block", "example.com", "/de/"), site_rule("allow", "org", "/fr/"))
GLOBS = (glob_rule("block", "*spam*/**"), glob_rule("block", "*spam*"), glob_rule("block", "**.exe"), glob_rule("block", "**/wp-admin/**"))


def verdicts(pages: DataFrame) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every page; ``rule`` names the site rule, and is null where a glob or the default decides."""
    found = filter_urls(pages.select("page_id", "url"), [*SITES, *GLOBS])
    site = F.col("rule").isin(*[r.name for r in SITES])
    return found.select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict")
