"""Scans of contents by whole rules: an index of atoms, candidates verified by the rule, evidence, a bound on work.

An atom is a run of up to four bytes that every match of a pattern must hold; of a pattern's atoms the rarest is taken.
All atoms of a bundle lie in one index, sorted numbers behind a table of 2^16 bits, and a content's windows of as many
bytes are looked up in it at once in numpy. A second index holds up to eight bytes of each of a pattern's runs: only
patterns of which it finds all are verified, by their own regular expression, which also says where: (pattern, offset,
length), up to MOST_EVIDENCE of each pattern, and only rules whose condition can hold by what it finds are asked. Letters in an atom are folded, in the index and in the content, so patterns that
ignore case need no index of their own.

A rule is asked as its condition reads: whether a pattern occurs, how often, and of rules that hold where. Only the
last makes evidence, and what the condition leaves open is not looked for.

Work is counted in bytes that verifications of all patterns whose atom occurs would read: a content whose patterns ask for more than its
bound gets the status `timeout` and no matches, the same on every run. Where no status is shown a scan is strict: work
has no bound, and rules that don't compile are refused, so nothing that failed looks like a content without matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators import hunts

MOST_EVIDENCE = hunts.MOST_EVIDENCE
#: Verified bytes that a content may cost, as a multiple of its size and at least.
WORK_FACTOR, LEAST_WORK = 4_096, 1 << 26
#: Bytes of rule sources that one index is made of; more make several, each a pass over the contents.
MOST_SOURCE_BYTES = 32 << 20
#: Bytes of a content that are looked up at once.
SLAB = 1 << 20
#: Sets of patterns that one of a rule's conditions is taken apart to, at most.
MOST_NEEDS = 64
#: Bytes common in texts and programs: atoms of others are rarer.
COMMON = np.ones(256, np.float64)
COMMON[list(b" etaoinsrhldcumfpgwybvk\x00\xff")] = 3.0
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

MATCH_TYPE = pa.list_(pa.struct([("rule_id", pa.string()), ("namespace", pa.string()), ("patterns", pa.list_(pa.struct([("identifier", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))]))
MATCHES = "array<struct<rule_id:string,namespace:string,patterns:array<struct<identifier:string,offset:bigint,length:bigint>>>>"


def _runs(regex: str) -> list[bytes]:
    """Runs of bytes that every match of a regular expression holds."""
    from re import _constants as C
    from re import _parser

    runs, now = [], bytearray()

    def close() -> None:
        nonlocal now
        if now:
            runs.append(bytes(now))
        now = bytearray()

    def walk(items) -> None:
        for op, arg in items:
            if op is C.LITERAL and arg < 256:
                now.append(arg)
            elif op is C.SUBPATTERN:
                walk(arg[3])
            elif op is C.MAX_REPEAT or op is C.MIN_REPEAT:
                low, high, inner = arg
                close()
                if low:
                    walk(inner)
                    close()
            elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
                continue
            else:  # a class, a branch, any byte: breaks a run
                close()

    walk(_parser.parse(regex.encode("latin-1")))
    close()
    return runs


def atom(pattern: hunts.Pattern) -> bytes | None:
    """The rarest run of two to four bytes that a match must hold, folded; None if there is none."""
    best, least = None, np.inf
    for run in _runs(pattern.regex):
        run = FOLD[np.frombuffer(run, np.uint8)].tobytes()
        for size in (4, 3, 2):
            for i in range(len(run) - size + 1):
                piece = run[i : i + size]
                cost = COMMON[list(piece)].sum() - 2.5 * len(piece) - 0.5 * (len(set(piece)) - 1)
                if cost < least:
                    best, least = piece, cost
            if len(run) >= size:
                break
    return best


class Index:
    """The atoms of patterns, of up to eight bytes, each with the patterns it stands for."""

    def __init__(self, atoms: list[bytes | None]):
        self.always = [i for i, a in enumerate(atoms) if a is None]
        self.tables = {}
        for size in range(1, 9):
            own: dict[int, list[int]] = {}
            for i, a in enumerate(atoms):
                if a is not None and len(a) == size:
                    own.setdefault(int.from_bytes(a, "little"), []).append(i)
            if own:
                values = np.array(sorted(own), np.uint64)
                there = np.zeros(1 << 16, bool)
                there[self._short(values)] = True
                self.tables[size] = values, there, [own[int(v)] for v in values]

    @staticmethod
    def _short(values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def candidates(self, content: bytes) -> list[int]:
        """Patterns whose atom occurs, and those without one."""
        found = {size: set() for size in self.tables}
        for start in range(0, len(content), SLAB):
            self._look(FOLD[np.frombuffer(content, np.uint8, min(SLAB + 7, len(content) - start), start)], found)
        out = list(self.always)
        for size, at in found.items():
            of = self.tables[size][2]
            for i in at:
                out += of[i]
        return sorted(out)

    def _look(self, data: np.ndarray, found: dict[int, set[int]]) -> None:
        # eight bytes from every place, those beyond the end zero, and of these as many as a table has
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        wide = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))
        wide = np.ascontiguousarray(wide).view("<u8")[:, 0]
        for size, (values, there, _) in self.tables.items():
            if len(data) < size:
                continue
            window = wide[: len(data) - size + 1]
            if size < 8:
                window = window & np.uint64((1 << 8 * size) - 1)
            window = window[there[self._short(window)]]
            at = np.searchsorted(values, window)
            at[at == len(values)] = 0
            found[size].update(np.flatnonzero(np.bincount(at[values[at] == window], minlength=len(values))).tolist())


def _literal(regex: str) -> bytes | None:
    """The bytes that a regular expression is nothing but, or None."""
    from re import _constants as C
    from re import _parser

    items = list(_parser.parse(regex.encode("latin-1")))
    return bytes(arg for _, arg in items) if items and all(op is C.LITERAL and arg < 256 for op, arg in items) else None


def _needs(tree: tuple, named: dict[str, list[int]]) -> list[frozenset[int]]:
    """Sets of patterns, all of one of which occur where a condition holds; named gives the patterns of a name."""
    def of(name: str) -> list[frozenset[int]]:
        return [frozenset([i]) for i in named.get(name, [])]

    match tree:
        case ("and", a, b):
            a, b = _needs(a, named), _needs(b, named)
            return [x | y for x in a for y in b] if len(a) * len(b) <= MOST_NEEDS else min(a, b, key=len)
        case ("or", a, b):
            return _needs(a, named) + _needs(b, named)
        case ("hit", name):
            return of(name)
        case ("of", need, names) if need > 0:
            return [x for n in names for x in of(n)]
        case ("compare", what, op, number) if what and not hunts.COMPARISONS[op](0, number):
            return of(what[1:])
        case ("false",):
            return []
    return [frozenset()]


class Groups:
    """Groups of numbers, and which of them are there as a whole."""

    def __init__(self, groups: list, size: int):
        self.need = np.array([len(g) for g in groups], np.int64)
        self.member = np.array([x for g in groups for x in g], np.int64)
        self.of = np.repeat(np.arange(len(groups)), self.need)
        #: how many numbers there are
        self.size = size

    def whole(self, there: np.ndarray) -> np.ndarray:
        """A bit for each group; there: a bit for each number."""
        return np.bincount(self.of[there[self.member]], minlength=len(self.need)) == self.need


class Finder:
    """Where a pattern matches, overlaps included: (offset, length) of the first MOST_EVIDENCE, and how many there are."""

    def __init__(self, regex: str, ignore_case: bool):
        self.compiled = re.compile(regex.encode("latin-1"), re.S | (re.I if ignore_case else 0))
        self.literal, self.ignore_case = _literal(regex), ignore_case
        if self.literal and ignore_case:
            self.literal = self.literal.lower()
        #: folded bytes that a match must hold, longest first
        self.runs = sorted({FOLD[np.frombuffer(run, np.uint8)].tobytes() for run in _runs(regex)}, key=lambda run: (-len(run), run))
        # without a border no two matches overlap
        self.apart = self.literal and not any(self.literal.startswith(self.literal[i:]) for i in range(1, len(self.literal)))

    def there(self, content: bytes, lower: bytes) -> bool:
        """Whether there is a match."""
        if self.literal is not None:
            return self.literal in (lower if self.ignore_case else content)
        for run in self.runs:
            if run not in lower:
                return False
        return self.compiled.search(content) is not None

    def find(self, content: bytes, lower: bytes) -> tuple[list[tuple[int, int]], int]:
        """lower: the content with A-Z as a-z."""
        found, n, at = [], 0, 0
        if self.literal is None:
            while (m := self.compiled.search(content, at)) is not None:
                n += 1
                if n <= MOST_EVIDENCE:
                    found.append((m.start(), m.end() - m.start()))
                at = m.start() + 1  # matches may overlap
            return found, n
        text, size = lower if self.ignore_case else content, len(self.literal)
        while (at := text.find(self.literal, at)) >= 0:
            if n == MOST_EVIDENCE and self.apart:
                return found, n + text.count(self.literal, at)
            n += 1
            if n <= MOST_EVIDENCE:
                found.append((at, size))
            at += 1
        return found, n


class Content:
    """A content, and what is known of finders in it."""

    def __init__(self, content: bytes, likely: list[bool]):
        """likely: of each pattern whether it may occur."""
        self.content, self.lower, self.likely = content, content.lower(), likely
        self.known: dict[Finder, bool] = {}
        self.found: dict[Finder, tuple[list[tuple[int, int]], int]] = {}

    def __len__(self) -> int:
        return len(self.content)

    def there(self, pattern: int, finder: Finder) -> bool:
        if not self.likely[pattern]:
            return False
        if (known := self.known.get(finder)) is None:
            known = self.known[finder] = finder.there(self.content, self.lower)
        return known

    def find(self, pattern: int, finder: Finder) -> tuple[list[tuple[int, int]], int]:
        if not self.there(pattern, finder):
            return [], 0
        if finder not in self.found:
            self.found[finder] = finder.find(self.content, self.lower)
        return self.found[finder]


def _asked(tree: tuple, named: dict[str, list[tuple[int, Finder]]]) -> Callable[[Content], bool]:
    """A condition as a function of a content; named gives the patterns of a name, of which the last that occurs counts."""
    def hit(name: str) -> Callable[[Content], bool]:
        own = named.get(name, [])
        if len(own) == 1:
            pattern, finder = own[0]
            return lambda c: c.there(pattern, finder)
        return lambda c: any(c.there(*x) for x in own)

    match tree:
        case ("and", a, b):
            a, b = _asked(a, named), _asked(b, named)
            return lambda c: a(c) and b(c)
        case ("or", a, b):
            a, b = _asked(a, named), _asked(b, named)
            return lambda c: a(c) or b(c)
        case ("not", a):
            a = _asked(a, named)
            return lambda c: not a(c)
        case ("hit", name):
            return hit(name)
        case ("of", need, names):
            hits = [hit(n) for n in names]
            return lambda c: sum(h(c) for h in hits) >= need
        case ("compare", what, op, number):
            compared, own = hunts.COMPARISONS[op], named.get(what[1:], [])[::-1]
            if not what:
                return lambda c: compared(len(c), number)
            return lambda c: compared(next((n for x in own if (n := c.find(*x)[1])), 0), number)
    return lambda c: tree[0] == "true"


class Scanner:
    """Compiled rules, and those that don't compile. Rules that share a pattern share what is found of it."""

    def __init__(self, rules: list[tuple[str, str]], bounded: bool = True):
        """rules (namespace, source), each source one rule; bounded: whether a content may cost too much."""
        self.bounded = bounded
        #: (namespace, name, condition, patterns (name, number, finder))
        self.rules, self.failed = [], []
        #: sets of patterns, and the rule that each may make hold
        needs, self.needing = [], []
        finders: dict[tuple[str, bool], Finder] = {}
        atoms = []
        for namespace, source in rules:
            try:
                rule = hunts.parse_rule(source)
                holds = hunts.parse_condition(rule)
                compiled = [finders.get((p.regex, p.ignore_case)) or Finder(p.regex, p.ignore_case) for p in rule.patterns]
                own = [atom(p) for p in rule.patterns]
            except (hunts.RuleError, re.error) as e:
                self.failed.append((namespace, str(e)))
                continue
            patterns = [(p.name, len(atoms) + i, finders.setdefault((p.regex, p.ignore_case), c)) for i, (p, c) in enumerate(zip(rule.patterns, compiled, strict=True))]
            named: dict[str, list[tuple[int, Finder]]] = {}
            for name, *pattern in patterns:
                named.setdefault(name, []).append(tuple(pattern))
            atoms += own
            own = set(_needs(holds, {name: [i for i, _ in x] for name, x in named.items()}))
            needs += own
            self.needing += [len(self.rules)] * len(own)
            self.rules.append((namespace, rule.name, _asked(holds, named), patterns))
        self.index = Index(atoms)
        runs = [[run[:8] for run in finder.runs] for *_, patterns in self.rules for _, _, finder in patterns]
        number = {run: i for i, run in enumerate(dict.fromkeys(run for own in runs for run in own))}
        self.longer = Index(list(number))
        self.runs = Groups([{number[run] for run in own} for own in runs], len(number))
        self.needs, self.needing = Groups(needs, len(runs)), np.array(self.needing, np.int64)

    def likely(self, content: bytes) -> tuple[np.ndarray, list[int]]:
        """A bit for each pattern, whether it may occur, and the rules that may hold."""
        there = np.zeros(self.runs.size, bool)
        there[self.longer.candidates(content)] = True
        there = self.runs.whole(there)
        return there, np.unique(self.needing[self.needs.whole(there)]).tolist()

    def matched(self, content: bytes) -> tuple[str, list[tuple[int, dict[str, list[tuple[int, int]]]]]]:
        """Status, and the rules that hold, in their order, each with where its patterns match."""
        bound = max(LEAST_WORK, WORK_FACTOR * len(content))
        if self.bounded and len(self.runs.need) * len(content) > bound and len(self.index.candidates(content)) * len(content) > bound:
            return "timeout", []
        likely, asked = self.likely(content)
        out, c = [], Content(content, likely.tolist())
        for r in asked:
            _, _, holds, patterns = self.rules[r]
            if holds(c):
                out.append((r, {name: found for name, *x in patterns if (found := c.find(*x)[0])}))
        return ("matched" if out else "clean"), out

    def scan(self, content: bytes) -> tuple[str, list[dict]]:
        """Status and matches, in the rules' order."""
        status, matched = self.matched(content)
        return status, [
            {"rule_id": self.rules[r][1], "namespace": self.rules[r][0], "patterns": [{"identifier": f"${p}", "offset": o, "length": n} for p, found in hits.items() for o, n in found]}
            for r, hits in matched]


def _scanned(batches: Iterator[pa.RecordBatch], rules: Broadcast, bounded: bool) -> Iterator[pa.RecordBatch]:
    """Rows (tenant_id, artifact_id, content) to (tenant_id, artifact_id, status, matches)."""
    scanner = Scanner(rules.value, bounded)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            out = [("error", None) if c is None else scanner.scan(c) for c in piece.column(2).to_pylist()]
            columns = [piece.column(0), piece.column(1), pa.array([s for s, _ in out], pa.string()), pa.array([m for _, m in out], MATCH_TYPE)]
            yield pa.RecordBatch.from_arrays(columns, names=["tenant_id", "artifact_id", "status", "matches"])


def _evidence(batches: Iterator[pa.RecordBatch], rules: Broadcast, bounded: bool) -> Iterator[pa.RecordBatch]:
    """Rows (tenant_id, artifact_id, content) to a row for each place: (tenant_id, artifact_id, rule_id, identifier, offset, length)."""
    scanner = Scanner(rules.value, bounded)
    names = pa.array([rule[1] for rule in scanner.rules], pa.string())
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            row, rule, identifier, many, places = [], [], [], [], []
            for i, content in enumerate(piece.column(2)):
                for r, hits in scanner.matched(content.as_py())[1] if content.is_valid else ():
                    for name, found in hits.items():
                        row.append(i)
                        rule.append(r)
                        identifier.append(f"${name}")
                        many.append(len(found))
                        places += found
            of = pa.array(np.repeat(np.arange(len(many)), np.array(many, np.int64)))
            row, place = pa.array(row, pa.int64()).take(of), np.array(places, np.int64).reshape(-1, 2)
            columns = [piece.column(0).take(row), piece.column(1).take(row), names.take(pa.array(rule, pa.int64())).take(of), pa.array(identifier, pa.string()).take(of), pa.array(place[:, 0]), pa.array(place[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["tenant_id", "artifact_id", "rule_id", "identifier", "offset", "length"])


def broken_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, error): rules (rule_id, source) that don't compile."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, f) for i, s in zip(batch["rule_id"].to_pylist(), batch["source"].to_pylist()) for _, f in Scanner([(str(i), s or "")]).failed]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], batch["rule_id"].type), pa.array([f for _, f in found], pa.string())], names=["rule_id", "error"])

    return rules.select("rule_id", "source").mapInArrow(check, f"rule_id {rules.schema['rule_id'].dataType.simpleString()}, error string")


def bundles_of(rules: DataFrame, most: int = MOST_SOURCE_BYTES) -> Iterator[list[tuple[str, str]]]:
    """rules (rule_id, source) in the order of their ids, in lists whose sources hold so many bytes at most."""
    held, size = [], 0
    for r in rules.select(F.col("rule_id").cast("string").alias("rule_id"), "source").where("source IS NOT NULL").orderBy("rule_id").toLocalIterator():
        n = len(r["source"].encode())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r["rule_id"], r["source"]))
        size += n
    if held:
        yield held


def _given(content: DataFrame, body: str) -> DataFrame:
    keys = ["tenant_id", "artifact_id"]
    return content.select(*keys, F.col(body).cast("binary").alias("__content")).repartition(int(content.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _passes(given: DataFrame, rules: DataFrame, task: Callable, columns: str, strict: bool) -> list[DataFrame]:
    if strict and (broken := broken_rules(rules).orderBy("rule_id").limit(5).collect()):
        raise hunts.RuleError("rules that don't compile: " + ", ".join(f"{r['rule_id']} ({r['error']})" for r in broken))
    keys = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in given.columns[:2])
    return [given.mapInArrow(partial(task, rules=given.sparkSession.sparkContext.broadcast(own), bounded=not strict), f"{keys}, {columns}") for own in bundles_of(rules)]


def evidence(content: DataFrame, rules: DataFrame, *, body: str = "content", strict: bool = False) -> DataFrame:
    """(tenant_id, artifact_id, rule_id, identifier, offset, length): the places that `scan` lists, a row for each.

    No row tells of a failure, so a caller without the statuses of `scan` asks for strict: RuleError if a rule doesn't
    compile, and whatever work a content costs is done.
    """
    columns = "rule_id string, identifier string, offset long, length long"
    given = _given(content, body)
    passes = _passes(given, rules, _evidence, columns, strict)
    if not passes:
        return content.sparkSession.createDataFrame([], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:2]) + f", {columns}")
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def scan(content: DataFrame, rules: DataFrame, *, body: str = "content", strict: bool = False) -> DataFrame:
    """content (tenant_id, artifact_id, body) with `status` and `matches` by rules (rule_id, source).

    A null body is an error. Rules that don't compile match nothing; `broken_rules` names them. Strict, they raise
    RuleError, and no content is given up for its work, so that matches alone tell all. Each list of sources up
    to MOST_SOURCE_BYTES is a pass; with several, an artifact's matches are put together and its worst status stands.
    Contents are dealt to as many tasks as a shuffle has, as little to read is much to scan.
    """
    keys = ["tenant_id", "artifact_id"]
    given = _given(content, body)
    passes = _passes(given, rules, _scanned, f"status string, matches {MATCHES}", strict)
    if not passes:
        return given.select(*keys, F.lit("clean").alias("status"), F.array().cast(MATCHES).alias("matches"))
    if len(passes) == 1:
        return passes[0]
    both = passes[0]
    for more in passes[1:]:
        both = both.unionByName(more)
    worst = F.array_max(F.collect_set(F.struct(F.array_position(F.array(*map(F.lit, ("clean", "matched", "error", "timeout"))), F.col("status")).alias("n"), "status")))
    return both.groupBy(*keys).agg(worst["status"].alias("status"), F.flatten(F.collect_list("matches")).alias("matches"))
