"""Secret scan through a trigram inverted index.

Each rule's regular expression is taken apart into a Boolean query of byte trigrams that every match must
hold (letters folded to lower case). A chunk of texts is indexed by trigram; a rule's postings are
intersected and united as its query says, and only the texts that remain are searched with the expression. A
rule without mandatory trigrams is scanned fully; if it demands a run of one character class, texts without
such a run are passed over by that scan.

Defined results: a null or empty text holds nothing; spans are in code points, end exclusive, leftmost and
non-overlapping within a rule; rules may overlap each other. Equal rows give equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as rc
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import raw_texts, slices, tidy

Query = tuple | None  # ("and" | "or", parts) of trigrams and queries; None: no demand
LIMIT = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    fold: bool = False
    group: int = 0
    least: int = 0


#: Rules in the order in which equal starts are listed (fixed values).
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", fold=True, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9a-zA-Z]{16,}"),
    Rule("login", r"[a-z]{2,12}://[^\s:@/]{1,64}:[^\s:@/]{3,64}@"),
)


def spell(items) -> tuple[list[str] | None, Query]:  # type: ignore[no-untyped-def]
    """Of a parsed sequence: all strings it can be, if few, else None; and what its matches must hold."""
    whole: list[str] | None = [""]
    run: list[str] = [""]
    needs: list = []

    def flush() -> None:
        q = one_of(run)
        if q:
            needs.append(q)

    for op, arg in items:
        own, more = spell_one(op, arg)
        if more:
            needs.append(more)
        if own is not None and len(run) * len(own) <= LIMIT:
            run = [a + b for a in run for b in own]
            whole = run if whole is not None else None
        else:
            flush()
            run, whole = own if own is not None else [""], None
    if whole is None:
        flush()
    return whole, (("and", tuple(needs)) if needs else None)


def spell_one(op, arg) -> tuple[list[str] | None, Query]:  # type: ignore[no-untyped-def]
    if op is rc.LITERAL:
        return [chr(arg)], None
    if op is rc.IN:
        chars = [c for kind, x in arg for c in ([x] if kind is rc.LITERAL else range(x[0], x[1] + 1) if kind is rc.RANGE else range(999))]
        return ([chr(c) for c in chars], None) if len(chars) <= 6 and arg[0][0] is not rc.NEGATE else (None, None)
    if op is rc.SUBPATTERN:
        return spell(arg[3])
    if op is rc.BRANCH:
        parts = [spell(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return [t for s, _ in parts for t in s], None  # type: ignore[union-attr]
        asked = [one_of(s) if s is not None else q for s, q in parts]
        return None, (("or", tuple(asked)) if all(asked) else None)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        least, most, what = arg
        own, needs = spell(what)
        if own is not None and most == 1:
            return ([""] if least == 0 else []) + own, None
        if own is not None and least == most and len(own) ** least <= LIMIT:
            out = [""]
            for _ in range(least):
                out = [a + b for a in out for b in own]
            return out, None
        return None, ((one_of(own) if own is not None else needs) if least else None)
    return None, None


def one_of(strings: list[str]) -> Query:
    """One of these strings stands in the text."""
    sets = [sorted({b[k : k + 3] for k in range(len(b) - 2)}) for b in (s.encode().lower() for s in strings)]
    return ("or", tuple(("and", tuple(x)) for x in sets)) if sets and all(sets) else None


def trigrams(q: Query) -> set[bytes]:
    return {t for x in q[1] for t in ({x} if isinstance(x, bytes) else trigrams(x))} if q else set()


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold else 0)) for r in rules]
        parsed = [parser.parse(r.pattern, re.ASCII) for r in rules]
        spelled = [spell(p) for p in parsed]
        self.queries = [one_of(s) if s is not None else q for s, q in spelled]
        self.runs: list[tuple[bytes, bytes] | None] = []
        for p, q in zip(parsed, self.queries, strict=True):
            op, arg = p[0] if len(p) == 1 else (None, None)
            only = q is None and op is rc.MAX_REPEAT and len(arg[2]) == 1 and arg[2][0][0] is rc.IN and arg[0] > 1
            inside = re.compile(b"[" + b"".join(b"%s" % re.escape(bytes([c])) for k, x in arg[2][0][1] for c in ([x] if k is rc.LITERAL else range(x[0], x[1] + 1))) + b"]") if only else None
            self.runs.append((bytes(120 if inside.match(bytes([b])) else 32 for b in range(256)), b"x" * arg[0]) if inside else None)
        wanted = sorted(set().union(*(trigrams(q) for q in self.queries)))
        self.slot = {t: k for k, t in enumerate(wanted)}
        self.codes = np.array([t[0] << 16 | t[1] << 8 | t[2] for t in wanted] or [1 << 24], dtype=np.int32)
        self.begins = np.zeros(1 << 16, dtype=bool)
        self.begins[self.codes[self.codes < 1 << 24] >> 8] = True

    def index(self, raw: list[bytes]) -> np.ndarray:
        """Postings of the wanted trigrams: a row of texts for each."""
        data = np.frombuffer(b"\n\n\n".join(raw).lower() + b"\n\n\n", dtype=np.uint8)
        # Few pairs of bytes begin a trigram that is asked for.
        pair = data[:-2].astype(np.uint16) << np.uint16(8) | data[1:-1]
        at = np.nonzero(self.begins[pair])[0]
        code = pair[at].astype(np.int32) << 8 | data[at + 2]
        slots = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[slots] == code
        at, slots = at[hit], slots[hit]
        doc = np.searchsorted(np.cumsum([len(x) + 3 for x in raw]), at, side="right")
        out = np.zeros((len(self.slot), len(raw)), dtype=bool)
        out[slots, doc] = True
        return out

    def candidates(self, q: Query, postings: np.ndarray) -> np.ndarray:
        parts = [postings[self.slot[x]] if isinstance(x, bytes) else self.candidates(x, postings) for x in q[1]]  # type: ignore[index]
        return np.logical_and.reduce(parts) if q[0] == "and" else np.logical_or.reduce(parts)  # type: ignore[index]

    def scan(self, raw: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Of each text: (start, number of the rule, end), in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in raw]
        if not raw:
            return out
        postings = self.index(raw)
        kept: dict[int, str] = {}
        for k, (rule, pattern) in enumerate(zip(self.rules, self.compiled, strict=True)):
            if self.queries[k]:
                docs = np.nonzero(self.candidates(self.queries[k], postings))[0].tolist()
            elif self.runs[k]:
                marks, run = self.runs[k]  # type: ignore[misc]
                docs = [d for d, x in enumerate(raw) if run in x.translate(marks)]
            else:
                docs = range(len(raw))
            for d in docs:
                if d not in kept:
                    kept[d] = raw[d].decode("utf-8", "replace")
                for m in pattern.finditer(kept[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[d].append((m.start(), k, m.end()))
        for x in out:
            x.sort()
        return out


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def find(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of (doc_id, text): spans array<struct<kind,start,end>>, by start, then in the rules' order."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in s.scan(raw_texts(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    src = df.select("doc_id", "text")
    return src.mapInArrow(tidy(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The rows with every span of a secret replaced in `text` (overlapping spans as one); n_chars follows where there is one."""
    at, schema = df.columns.index("text"), df.schema
    size = df.columns.index("n_chars") if "n_chars" in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for batch in batches:
            for part in slices(batch, "text"):
                found = s.scan(raw_texts(part))
                columns = list(part.columns)
                if any(found):
                    texts = columns[at].to_pylist()
                    for d, spans in enumerate(found):
                        if spans:
                            text, out, end = texts[d], [], 0
                            for a, _, b in spans:
                                if a >= end:
                                    out += [text[end:a], mark]
                                end = max(end, b)
                            texts[d] = "".join(out) + text[end:]
                    columns[at] = pa.array(texts, columns[at].type)
                    if size is not None:
                        old = columns[size].to_pylist()
                        columns[size] = pa.array([len(texts[d]) if found[d] else old[d] for d in range(len(found))], columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(tidy(run), schema)
