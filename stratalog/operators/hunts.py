"""Rules and hunts: a documented subset of a pattern language, bundles, scans with a result cache, forward scans."""

from __future__ import annotations

import itertools
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.scalars import BUNDLE_HEADER

CACHE_KEY = ["tenant_id", "artifact_sha256", "rule_bundle_digest", "engine_version", "scan_config_digest"]
#: Rules of one index; more make several passes.
MOST_LITERAL_RULES = 100_000
MOST_EVIDENCE = 64


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Pattern:
    name: str
    kind: str  # text, hex or regex
    regex: str
    ignore_case: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    patterns: tuple[Pattern, ...]
    condition: str
    source: str = field(repr=False, default="")


_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)


def rule_name(source: str) -> str:
    """The one rule a source holds."""
    words = re.findall(r"[A-Za-z0-9_]+", re.sub(r"//[^\n]*|/\*.*?(?:\*/|\Z)", "", source, flags=re.S))
    at = [i for i, w in enumerate(words) if w == "rule"]
    if len(at) != 1:
        raise RuleError("no rule found" if not at else f"one rule expected, {len(at)} found")
    if at[0] + 1 >= len(words) or not re.match(r"[A-Za-z_]", words[at[0] + 1]):
        raise RuleError("invalid rule identifier")
    return words[at[0] + 1]


def _text_regex(text: str, flags: set[str]) -> str:
    raw = re.sub(r"\\(x[0-9a-fA-F]{2}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], chr(int(m[1][1:], 16)) if m[1][0] == "x" else m[1]), text)
    chars = [re.escape(c) for c in raw.encode().decode("latin-1")]
    forms = (["".join(c + r"\x00" for c in chars)] if "wide" in flags else []) + (["".join(chars)] if "wide" not in flags or "ascii" in flags else [])
    out = "(?:" + "|".join(forms) + ")"
    return rf"(?<![A-Za-z0-9]){out}(?![A-Za-z0-9])" if "fullword" in flags else out


def _hex_regex(body: str) -> str:
    out = ""
    for token in re.findall(r"[0-9A-Fa-f?]{2}|\[\d+(?:-\d+)?\]|[()|]", body):
        if token[0] == "[":
            lo, _, hi = token[1:-1].partition("-")
            out += rf"[\x00-\xff]{{{lo},{hi or lo}}}"
        elif token in "()|":
            out += "(?:" if token == "(" else token
        elif token == "??":
            out += r"[\x00-\xff]"
        elif "?" in token:
            options = [f"{n:02x}" for n in range(256) if re.fullmatch(token.lower().replace("?", "."), f"{n:02x}")]
            out += "[" + "".join(r"\x" + o for o in options) + "]"
        else:
            out += r"\x" + token.lower()
    return out


def parse_rule(source: str) -> Rule:
    """Text strings (nocase, wide, ascii, fullword), hex strings with wildcards and jumps, regexes; and, or, not, any/all/N of, filesize, #counts."""
    name = rule_name(source)
    clean = _COMMENT.sub(lambda m: m[1] or "", source)
    strings = re.search(r"strings\s*:(.*?)condition\s*:", clean, re.S)
    condition = re.search(r"condition\s*:(.*)\}", clean, re.S)
    if not condition:
        raise RuleError("no condition")
    patterns = []
    for m in re.finditer(r'\$(\w*)\s*=\s*(?:"((?:\\.|[^"\\])*)"|\{([^}]*)\}|/((?:\\.|[^/\\])+)/([is]*))((?:\s+(?:nocase|wide|ascii|fullword)\b)*)', strings[1] if strings else ""):
        flags = set(m[6].split())
        if m[2] is not None:
            patterns.append(Pattern(m[1], "text", _text_regex(m[2], flags), "nocase" in flags))
        elif m[3] is not None:
            patterns.append(Pattern(m[1], "hex", _hex_regex(m[3])))
        else:
            patterns.append(Pattern(m[1], "regex", f"(?{m[5]}:{m[4]})" if m[5] else m[4], "nocase" in flags or "i" in m[5]))
    return Rule(name, tuple(patterns), condition[1].strip(), source)


def parse_condition(rule: Rule) -> tuple:
    """A condition as a tree: (and|or, a, b), (not, a), (true|false,), (hit, name), (of, need, names), (compare, what, op, number)."""
    tokens = re.findall(r"\(|\)|,|[#$]\w*\*?|\d+(?:KB|MB)?|[<>=!]=?|\w+", rule.condition)
    at = 0
    names = [p.name for p in rule.patterns]

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        token = peek()
        if not token or want and token != want:
            raise RuleError(f"unsupported condition near {token or 'its end'}")
        at += 1
        return token

    def number() -> int:
        token = take()
        m = re.fullmatch(r"(\d+)(KB|MB)?", token)
        if not m:
            raise RuleError(f"a number expected, not {token}")
        return int(m[1]) * {"KB": 1024, "MB": 1 << 20}.get(m[2], 1)

    def known(name: str) -> str:
        if name not in names:
            raise RuleError(f"no string ${name}")
        return name

    def of(need: str | int) -> tuple:
        take("of")
        if peek() == "them":
            take()
            chosen = names
        else:
            take("(")
            chosen = []
            while peek() != ")":
                token = take()
                if token != ",":
                    chosen += [n for n in names if n.startswith(token[1:-1])] if token.endswith("*") else [known(token[1:])]
            take(")")
        return ("of", len(chosen) if need == "all" else 1 if need == "any" else need, tuple(chosen))

    def compare(what: str) -> tuple:
        op = take()
        if op not in COMPARISONS:
            raise RuleError(f"a comparison expected, not {op}")
        return ("compare", what, op, number())

    def atom() -> tuple:
        token = peek()
        if token == "not":
            take()
            return ("not", atom())
        if token == "(":
            take()
            out = either()
            take(")")
            return out
        if token in ("any", "all"):
            return of(take())
        if token in ("true", "false"):
            return (take(),)
        if token == "filesize":
            take()
            return compare("")
        if token.startswith("#"):
            return compare(f"#{known(take()[1:])}")
        if token.startswith("$"):
            return ("hit", known(take()[1:]))
        if token.isdigit():
            return of(number())
        raise RuleError(f"unsupported condition near {token}")

    def both() -> tuple:
        out = atom()
        while peek() == "and":
            take()
            out = ("and", out, atom())
        return out

    def either() -> tuple:
        out = both()
        while peek() == "or":
            take()
            out = ("or", out, both())
        return out

    out = either()
    if at != len(tokens):
        raise RuleError(f"unsupported condition near {peek()}")
    return out


COMPARISONS = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


def holds(tree: tuple, counts: dict[str, int], size: int) -> bool:
    """A condition over the counts of its patterns' matches and the content's size."""
    match tree:
        case ("and", a, b):
            return holds(a, counts, size) and holds(b, counts, size)
        case ("or", a, b):
            return holds(a, counts, size) or holds(b, counts, size)
        case ("not", a):
            return not holds(a, counts, size)
        case ("hit", name):
            return counts.get(name, 0) > 0
        case ("of", need, names):
            return sum(counts.get(n, 0) > 0 for n in names) >= need
        case ("compare", what, op, number):
            return COMPARISONS[op](counts.get(what[1:], 0) if what else size, number)
    return tree[0] == "true"


def _column(tree: tuple, hit, count, size: Column) -> Column:
    """A condition as a column: hit and count give a pattern's."""
    match tree:
        case ("and", a, b):
            return _column(a, hit, count, size) & _column(b, hit, count, size)
        case ("or", a, b):
            return _column(a, hit, count, size) | _column(b, hit, count, size)
        case ("not", a):
            return ~_column(a, hit, count, size)
        case ("hit", name):
            return hit(name)
        case ("of", need, names):
            return sum((hit(n).cast("int") for n in names), F.lit(0)) >= need
        case ("compare", what, op, number):
            return COMPARISONS[op](count(what[1:]) if what else size, number)
    return F.lit(tree[0] == "true")


def compile_rule(rule: Rule, content: Column) -> Column:
    """Whether a binary column meets a rule. Bytes are read as Latin-1, so offsets and classes count bytes."""
    text = F.decode(content, "iso-8859-1")
    by = {p.name: ("(?s)" + ("(?i)" if p.ignore_case else "") + p.regex) for p in rule.patterns}
    return _column(parse_condition(rule), lambda n: text.rlike(by[n]), lambda n: F.regexp_count(text, F.lit(by[n])), F.octet_length(content))


def evidence(rule: Rule, content: Column) -> Column:
    """(pattern, text) of up to MOST_EVIDENCE matches of each pattern."""
    text = F.decode(content, "iso-8859-1")
    each = [F.transform(F.slice(F.regexp_extract_all(text, F.lit("(?s)" + ("(?i)" if p.ignore_case else "") + p.regex), F.lit(0)), 1, MOST_EVIDENCE), lambda m, n=p.name: F.struct(F.lit(n).alias("pattern"), m.alias("text"))) for p in rule.patterns]
    return F.concat(*each) if each else F.array().cast("array<struct<pattern:string,text:string>>")


def scan(artifact: DataFrame, sources: list[str], *, content: str = "content") -> tuple[DataFrame, list[str]]:
    """artifact with `rules`, the names of the rules it meets, in one pass; and the sources that didn't compile."""
    found, failed = [], []
    for source in sources:
        try:
            rule = parse_rule(source)
            found.append(F.when(compile_rule(rule, F.col(content)), rule.name))
        except RuleError:
            failed.append(source)
    rules = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return artifact.withColumn("rules", rules), failed


def bundle_digest(rules: DataFrame, *, rule_id: str = "stable_id", source: str = "source", config: str = "", header: str = BUNDLE_HEADER) -> DataFrame:
    """One digest over a bundle's rules in the order of their ids. A bundle is a few thousand rules at most."""
    each = F.array_sort(F.collect_list(F.struct(F.col(rule_id).alias("i"), F.col(source).alias("s"))))
    body = F.array_join(F.transform(each, lambda r: F.concat(r["i"], F.lit("\0"), r["s"], F.lit("\0"))), "")
    return rules.agg(F.sha2(F.concat(F.lit(header + "\0"), body, F.lit(config)), 256).alias("digest"))


def _literals(batches: Iterator[pa.RecordBatch], rules: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (tenant_id, artifact_id, text) to (tenant_id, artifact_id, rule_id): the index of atoms names candidates, the literal decides."""
    from stratalog.operators.scanner import Index, atom

    named: dict[bytes, list[str]] = {}
    for rule_id, literal in rules.value:
        if literal is not None:
            named.setdefault(literal.encode(), []).append(rule_id)
    literals = list(named)
    index = Index([atom(Pattern("", "text", re.escape(x.decode("latin-1")))) if x else None for x in literals])
    for batch in batches:
        rows, ids = [], []
        for i, text in enumerate(batch.column(2)):
            if text.is_valid:
                content = text.as_buffer().to_pybytes()
                found = [r for at in index.candidates(content) if literals[at] in content for r in named[literals[at]]]
                rows += [i] * len(found)
                ids += found
        keys = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(1), pa.array(ids, pa.string())], names=["tenant_id", "artifact_id", "rule_id"])


def literal_matches(content: DataFrame, rules: DataFrame, *, text: str = "text") -> DataFrame:
    """(tenant_id, artifact_id, rule_id): artifacts that contain a rule's literal, in one pass over the contents.

    All literals of a bundle make one index, so a text is read once however many rules there are. A bundle of more
    than MOST_LITERAL_RULES is cut into several, each a pass of its own. A null literal matches nothing, an empty one all.
    """
    given = content.select("tenant_id", "artifact_id", F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "__text") + ", rule_id string"
    rows, out = rules.select("rule_id", "literal").orderBy("rule_id", "literal").toLocalIterator(), None
    while (some := list(itertools.islice(rows, MOST_LITERAL_RULES))) or out is None:
        sent = content.sparkSession.sparkContext.broadcast([(r["rule_id"], r["literal"]) for r in some])
        one = given.mapInArrow(partial(_literals, rules=sent), schema)
        out = one if out is None else out.unionByName(one)
        if not some:
            break
    return out


def execute(planned: DataFrame, cache: DataFrame, scanned: DataFrame) -> DataFrame:
    """A hunt's outcome per planned artifact: from the cache if its key is there, else fresh.

    planned (tenant_id, artifact_id, CACHE_KEY...); cache (CACHE_KEY, status,
    n_rules); scanned (tenant_id, artifact_id, status, n_rules), lazily evaluated
    for the misses alone.
    """
    known = planned.join(cache.select(*CACHE_KEY, "status", "n_rules"), CACHE_KEY).withColumn("cached", F.lit(True))
    missed = planned.join(cache.select(*CACHE_KEY), CACHE_KEY, "left_anti").join(scanned, ["tenant_id", "artifact_id"]).withColumn("cached", F.lit(False))
    columns = ["tenant_id", "artifact_id", "status", "n_rules", "cached"]
    return known.select(*columns).unionByName(missed.select(*columns))


def counters(outcome: DataFrame) -> DataFrame:
    """planned, scanned, cache_hits, matched (rule hits), timed_out, failed and the final state. Cached timeouts and errors still count."""
    count = lambda c: F.count_if(c).cast("long")
    bad = F.col("status").isin("timeout", "error")
    return outcome.agg(
        F.count("*").alias("planned"), count(~F.col("cached") & ~bad).alias("scanned"), count(F.col("cached")).alias("cache_hits"), F.coalesce(F.sum("n_rules"), F.lit(0)).cast("long").alias("matched"),
        count(F.col("status") == "timeout").alias("timed_out"), count(F.col("status") == "error").alias("failed")).withColumn(
        "state", F.when(F.col("timed_out") + F.col("failed") > 0, "COMPLETED_PARTIAL").otherwise("COMPLETED"))


def forward(new: DataFrame, bundles: DataFrame, cache: DataFrame) -> DataFrame:
    """(new artifact, active bundle of its tenant) pairs still to scan: a pair with a cache entry is skipped altogether.

    Every artifact meets every active bundle of its tenant by intent, so pairs are as many as the scans they stand for.
    """
    active = bundles.where("active").select("tenant_id", "rule_bundle_digest").distinct()
    pairs = new.join(active, "tenant_id")
    return pairs.join(cache.select("tenant_id", "artifact_sha256", "rule_bundle_digest").distinct(), ["tenant_id", "artifact_sha256", "rule_bundle_digest"], "left_anti")
