"""Secret scans through a trigram index.

From each rule's regular expression a Boolean trigram query is derived: text that matches must
hold these trigrams. Per block of rows a small inverted index maps each trigram that some query
uses to the rows that hold it; postings are intersected and united as the query says, and only
the rows left are searched with the expression itself. A rule without a mandatory trigram (a
run of hex digits, say) searches all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.texts import only, portions, slices

try:  # the parser of the standard library's expressions
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # Python < 3.11
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched leftmost and without overlaps; a match counts if ``group`` has
    at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# fixed values: the base rules
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# fixed values: published shapes of further credentials
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google_api", r"AIza[A-Za-z0-9_-]{35}"),
    # starts only where a run of its characters does, so a long run is read once
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,256}:[^\s/:@]{1,256}@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + EXTRA_RULES

Query = frozenset  # a conjunction of clauses; a clause is a set of trigram sets of which one must be held whole
_MOST = 64  # strings kept exactly while an expression is analysed


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> Query:
    """What text must hold if it holds one of ``strings``; nothing if one is too short to say."""
    sets = frozenset(_trigrams(s) for s in strings)
    return Query() if not sets or frozenset() in sets else Query([sets])


def _flush(strings: set[str], found: set) -> None:
    found.update(_clause(strings))


def _sequence(tree) -> tuple[set[str] | None, set]:
    """The exact strings that ``tree`` matches (None: unknown) and the clauses of what it needs."""
    exact: set[str] | None = {""}
    run: set[str] = {""}  # strings that end where we are
    found: set = set()
    for op, arg in tree:
        part, needs = _node(op, arg)
        found |= needs
        if part is None or len(part) * len(run) > _MOST:
            _flush(run, found)
            exact, run = None, part if part is not None and len(part) <= _MOST else {""}
        else:
            run = {a + b for a, b in product(run, part)}
            exact = run if exact is not None else None
    if exact is None:
        _flush(run, found)
    return exact, found


def _node(op, arg) -> tuple[set[str] | None, set]:
    if op is _c.LITERAL:
        return {chr(arg)}, set()
    if op is _c.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is _c.LITERAL:
                chars.add(chr(value))
            elif kind is _c.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, set()
        return (chars, set()) if len(chars) <= 8 else (None, set())
    if op is _c.SUBPATTERN:
        return _sequence(arg[3])
    if op is _c.BRANCH:
        branches = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in branches):
            union = set().union(*[e for e, _ in branches])
            if len(union) <= _MOST:
                return union, set()
        # one branch must hold: a clause stands only if every branch has one to offer
        offers = [next(iter(sorted(n, key=str)), None) if e is None else next(iter(_clause(e)), None) for e, n in branches]
        return None, {frozenset().union(*offers)} if all(offers) else set()
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        low, high, inner = arg
        exact, needs = _sequence(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, set()
        if exact is not None and low == high and low <= 4 and len(exact) ** low <= _MOST:
            return {"".join(x) for x in product(exact, repeat=low)}, set()
        if low == 0:
            return None, set()
        return None, needs if exact is None else set(_clause(exact))
    if op is _c.AT:
        return {""}, set()
    return None, set()


def trigram_query(rule: Rule) -> Query:
    """Clauses that every matching text meets, in lower case so one index serves all rules.

    Each clause is a set of alternatives, each alternative a set of trigrams. Empty: no
    mandatory trigram, the rule scans every row.
    """
    exact, found = _sequence(_p.parse(rule.pattern))
    if exact is not None:
        found = set(_clause(exact))
    return Query(frozenset(frozenset(t.lower() for t in alternative) for alternative in clause) for clause in found)


def candidates(query: Query, postings: dict[str, np.ndarray], every: np.ndarray) -> np.ndarray:
    """Rows that meet the query: intersections within an alternative, unions over alternatives."""
    rows = every
    for clause in query:
        united = np.zeros(0, every.dtype)
        for alternative in clause:
            held = rows
            for t in sorted(alternative, key=lambda x: len(postings[x])):
                held = np.intersect1d(held, postings[t], assume_unique=True)
                if not len(held):
                    break
            united = np.union1d(united, held)
        rows = united
    return rows


def block_postings(lowered: Sequence[str], needed: Sequence[str]) -> dict[str, np.ndarray]:
    """The inverted index of one block of rows, for the trigrams that some query uses."""
    return {t: np.array([i for i, text in enumerate(lowered) if t in text], np.int64) for t in needed}


def rule_matches(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


_FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def _ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _scan(rules: tuple[Rule, ...], redacted: str | None = None):
    queries = [trigram_query(r) for r in rules]
    needed = sorted({t for q in queries for clause in q for alternative in clause for t in alternative})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [r.compiled() for r in rules]
        order = {r.kind: i for i, r in enumerate(rules)}
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in portions(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            spans: list[list] = [[] for _ in texts]
            for lo, hi in slices(texts, 4 << 20):
                block = texts[lo:hi]
                postings = block_postings([_ascii_lower(x) for x in block], needed)
                every = np.arange(hi - lo)
                for rule, query, expression in zip(rules, queries, compiled):
                    for i in candidates(query, postings, every).tolist():
                        spans[lo + i] += [(s, order[rule.kind], rule.kind, e) for s, e in rule_matches(block[i], rule, expression)]
            listed = [[{"kind": k, "start": s, "end": e} for s, _, k, e in sorted(x)] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(listed, kinds)], names=["doc_id", "spans"])

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            at = batch.schema.get_field_index(redacted)
            named = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            for found in run(iter([named])):
                texts = [blotted(t, s) for t, s in zip(batch.column(at).to_pylist(), found.column("spans").to_pylist())]
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return redact if redacted else run


def blotted(text: str | None, spans: list[dict], mark: str = "[SECRET]") -> str | None:
    """``text`` with each maximal run of found spans replaced by ``mark``."""
    if text is None or not spans:
        return text
    out, done = [], 0
    runs: list[list[int]] = []
    for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if runs and s["start"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s["end"])
        else:
            runs.append([s["start"], s["end"]])
    for start, end in runs:
        out += [text[done:start], mark]
        done = end
    return "".join([*out, text[done:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans`` (kind, start, end in code points,
    end exclusive) by start, then by the order of ``rules``.

    Null is the empty text, which holds no spans. Repeated rows each get their own row, equal
    starts of different kinds are all listed, other columns are not read.
    """
    texts = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(_scan(tuple(rules)), _FOUND)


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every found span blotted out of the text; all columns and rows are kept.

    Overlapping and touching spans give one mark. Null texts stay null.
    """
    return docs.mapInArrow(_scan(tuple(rules), text_col), docs.schema)


def secret_report(found: DataFrame) -> DataFrame:
    """Counts per base kind and span lists; the base digest covers the base kinds only."""
    base = [r.kind for r in BASE_RULES]
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(F.array_join(F.transform(of_base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"))
