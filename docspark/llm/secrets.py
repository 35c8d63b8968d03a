"""Secret scan: patterns of known shapes plus an assignment-aware lexer.

The lexer reads source and configuration syntax into pairs of a target name
and a literal (`name = "x"`, `name: x`, `"name": "x"`, `export NAME=x`,
`name => 'x'`, `cfg["name"] = x`, `<name>x</name>`, a YAML value on the line
below), folds joined strings, follows names that stand for an earlier literal
of the same text, and scores each literal by how sensitive its target's name
is and how random the literal looks. It goes over the operators of a text
once, so its time follows the length of the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The base patterns, in the order in which they are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones just fail
KINDS = ("assign", "access", "hex", "named")

NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.6,
    "signature": 0.5, "bearer": 0.8, "access": 0.4, "key": 0.6, "salt": 0.5, "session": 0.4,
}
THRESHOLD = 0.9
LEAST_LENGTH = 8
MOST_PIECES = 64  # of constants that a joined literal takes over; its own strings are not bounded

WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# An operator stands between a name and its literal; the others only part them.
OPERATOR = re.compile(r"=>|:=|\?=|[=!<>]=+|[:=]")
NO_PAIR = ("<=", ">=", "<==", ">==")
# Read backwards from an operator: a name, quoted or not, as it is or as a subscript.
NAME_BEFORE = re.compile(r"""[ \t]*+(?:\][ \t]*+)?(?P<q>["'`]\\?+)?(?P<name>[A-Za-z0-9_.\-]++)(?(q)(?P=q))""")
TYPE = re.compile(r"&?[A-Za-z_][A-Za-z0-9_.\[\]<>, \t|?!&*]*+")
PREFIX = re.compile(r"[fFbBrRuU]{1,2}(?=[\"'`])")
QUOTED = {
    '"': re.compile(r'"([^"\n\\]*+(?:\\.[^"\n\\]*+)*+)("?)'),
    "'": re.compile(r"'([^'\n\\]*+(?:\\.[^'\n\\]*+)*+)('?)"),
}
OUTSIDE = r"\s\"'`<>(){}\[\],;&|\\:"
BARE = re.compile(f"[^{OUTSIDE}=]++")
RUN = re.compile(f"[^{OUTSIDE}]++")
PADDING = re.compile(f"={{1,2}}(?![^{OUTSIDE}]|[\"'])")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
BLANKS = re.compile(r"[ \t]*+")
SPACE = re.compile(r"\s*+")
GOES_ON = re.compile(r"[ \t]*+\+\s*+|[ \t]*+(?=[\"'])")
GOES_ON_BELOW = re.compile(r"\s*+\+\s*+|\s*+(?=[\"'])")  # inside of parentheses
CHAINED = re.compile(r"[ \t]*+=(?![=>])")
# A value that stands on the lines below: nothing, or the mark of a block, at the end of a line.
BELOW = re.compile(r"(?P<block>[|>][+\-]?)?[ \t]*+\r?\n(?P<indent>[ \t]++)")
LINE = re.compile(r"[^\r\n]*+")
TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.\-]*+)(?:\s[^<>]*+)?>([^<]*+)</\1\s*+>")


@dataclass(frozen=True)
class Pair:
    """A literal that a name holds, and where its pieces stand; `via` names the constant it came by."""

    name: str
    literal: str
    pieces: tuple[tuple[int, int], ...]
    via: str | None = None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _name(before: str) -> str:
    """The name that ends a stretch of text."""
    found = NAME_BEFORE.match(before[::-1])
    return found["name"][::-1].lstrip("0123456789.-") if found else ""


def _string(text: str, at: int) -> tuple[int, int, int] | None:
    """(start, end, where to go on) of a string literal that begins here; one that is not closed ends with its line."""
    if prefix := PREFIX.match(text, at):
        at = prefix.end()
    mark = text[at : at + 1]
    for quote in ("\"\"\"", "'''", "\\\"", "\\'", "`"):
        if text.startswith(quote, at):
            start = at + len(quote)
            end = text.find(quote, start)
            if end < 0:
                end = LINE.match(text, start).end()
            return start, end, end + len(quote)
    if mark in QUOTED and mark:
        found = QUOTED[mark].match(text, at)
        return found.start(1), found.end(1), found.end()
    return None


def _below(text: str, at: int) -> tuple[tuple[int, int], ...]:
    """The line below, or the lines of a block, without their indent."""
    found = BELOW.match(text, at)
    if not found:
        return ()
    indent, at, out = found["indent"], found.end(), []
    while True:
        line = LINE.match(text, at)
        if line[0].strip():
            out.append((line.start(), line.start() + len(line[0].rstrip())))
        if not found["block"]:
            return tuple(out)
        at = line.end() + 1
        if not text.startswith(indent, at):
            return tuple(out)
        at += len(indent)


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs in reading order, constants propagated.

    One pass over the operators. The name is read backwards to the operator
    before, the literal forwards: a string in any quotes, escaped ones and
    triple ones too, strings and names joined by `+`, a bare word, or what
    stands on the lines below. A type between a name and its `=` belongs to
    neither. A bare identifier takes the literal that it last held; one that is
    assigned to itself, as in `a = b = "x"`, is no literal: all names of the
    chain hold what ends it. Operators inside a string are read too, but their
    literals are single pieces, so no stretch is read over and over.
    """
    held: dict[str, Pair] = {}
    out: list[Pair] = []
    chain: list[str] = []
    left, inner, run, typed = 0, 0, 0, None  # typed: (name, number of its pair) after a colon

    def hold(pair: Pair) -> None:
        for name in (*chain, pair.name):
            held[name] = Pair(name, pair.literal, pair.pieces, pair.via)
            out.append(held[name])
        chain.clear()

    for found in OPERATOR.finditer(text):
        operator, (at, after) = found[0], found.span()
        before, left = text[left:at], after
        name = _name(before)
        if typed and operator == "=" and TYPE.fullmatch(before.strip()):
            declared, number = typed
            if number < len(out) and not any(c.isdigit() for c in out[number].literal):
                del out[number:]  # it was the type
            # Or the colon gives a name of its own to what the right name holds, as in `env: PWD=x`.
            chain += [declared] if name else []
            name = name or declared
        typed = None
        if operator in NO_PAIR or not name:
            chain.clear()
            continue
        inside = at < inner
        at = BLANKS.match(text, after).end()
        joint = GOES_ON
        if text.startswith("(", at):
            at, joint = SPACE.match(text, at + 1).end(), GOES_ON_BELOW
        if operator == ":":
            typed = name, len(out)
        if string := _string(text, at):
            if inside:
                hold(Pair(name, text[string[0] : string[1]], (string[:2],)))
                continue
            literal, pieces, inner = _joined(text, [string[:2]], string[2], held, joint)
            hold(Pair(name, literal, pieces))
            continue
        bare = BARE.match(text, at)
        if not bare:
            lines = () if inside or operator != ":" else _below(text, at)
            if lines:
                inner = max(inner, lines[-1][1])
                literal = "\n".join(text[a:b] for a, b in lines)
                strings = [x for a, _ in lines[:1] if (x := _string(text, a))]
                if strings and len(lines) == 1:
                    lines = (strings[0][:2],)
                    literal = text[lines[0][0] : lines[0][1]]
                if len(lines) > 1 or strings or not any(c in literal for c in " \t:="):
                    hold(Pair(name, literal, lines))
            chain.clear()
            continue
        word, end = bare[0], bare.end()
        if IDENTIFIER.fullmatch(word):
            if operator != ":" and CHAINED.match(text, end) and not PADDING.match(text, end):
                if text.startswith("=", end):
                    run = _whole(text, name, at, run, out)
                chain.append(name)
                continue
            more = None if inside else joint.match(text, end)
            if more and "+" in more[0]:
                literal, pieces, inner = _joined(text, [], end, held, joint, word)
                if pieces:
                    hold(Pair(name, literal, pieces))
                    continue
            if word in held:
                source = held[word]
                hold(Pair(name, source.literal, source.pieces, source.name))
                continue
        elif text.startswith("=", end) and not PADDING.match(text, end):
            run = _whole(text, name, at, run, out)
        if padding := PADDING.match(text, end):
            word, end = word + padding[0], padding.end()
        shown = word.rstrip(".!?")
        if shown:
            hold(Pair(name, shown, ((at, at + len(shown)),)))
    if "</" in text:
        out += [Pair(m[1], m[2], (m.span(2),)) for m in TAG.finditer(text) if m[2].strip()]
    return out


def _whole(text: str, name: str, at: int, run: int, out: list[Pair]) -> int:
    """Tell a run with `=` in it as one literal, once; returns its end."""
    if at < run:
        return run
    end = RUN.match(text, at).end()
    out.append(Pair(name, text[at:end], ((at, end),)))
    return end


def _joined(
    text: str, pieces: list[tuple[int, int]], at: int, held: dict[str, Pair], joint: re.Pattern, word: str | None = None
) -> tuple[str, tuple[tuple[int, int], ...], int]:
    """(literal, pieces, end) of strings and known names that stand side by side or are joined by `+`."""
    texts = [text[a:b] for a, b in pieces]
    if word in held:
        texts.append(held[word].literal)
        pieces = list(held[word].pieces)
    while more := joint.match(text, at):
        if string := _string(text, more.end()):
            pieces.append(string[:2])
            texts.append(text[string[0] : string[1]])
            at = string[2]
        elif "+" in more[0] and (bare := BARE.match(text, more.end())):
            if bare[0] in held and len(pieces) + len(held[bare[0]].pieces) <= MOST_PIECES:
                texts.append(held[bare[0]].literal)
                pieces += held[bare[0]].pieces
            at = bare.end()
        else:
            break
    return "".join(texts), tuple(pieces), at


def name_score(name: str) -> float:
    """1 - product of (1 - weight) over the sensitive words of a name."""
    words = [w.lower() for w in WORDS.findall(name)]
    words += [a + b for a, b in zip(words, words[1:], strict=False)]
    return 1 - math.prod(1 - NAME_WEIGHTS.get(w, 0) for w in words)


def literal_score(literal: str) -> float:
    """0 to 1: bits per character against 4, lower without digits."""
    n = len(literal)
    if n < LEAST_LENGTH:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    mixed = any(c.isdigit() for c in literal) and any(c.isalpha() for c in literal)
    return min(1.0, bits / 4) * (1.0 if mixed else 0.5)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the base ones and those the lexer adds.

    An added span is a literal that no base span holds whole, and whose name and
    shape together score `THRESHOLD` or more, each 1 at most, or whose beginning
    is the value of a base span of kind assign.
    """
    if not text:
        return [], []
    base = base_spans(text)
    if not ("=" in text or ":" in text or "</" in text):
        return base, base
    whole, assigned = _Cover(base), _Cover([x for x in base if x[1] == 0])
    added, scores = set(), {}
    for p in pairs(text):
        left = [(a, b) for a, b in p.pieces if not whole.holds(a, b)]
        if not left:
            continue
        if p.pieces not in scores:
            scores[p.pieces] = literal_score(p.literal)
        begun = any(assigned.reaches(a) for a, _ in left)
        if begun or name_score(p.name) * (0.5 + scores[p.pieces]) >= THRESHOLD:
            added.update((a, 3, b) for a, b in left if b > a)
    return base, sorted([*base, *added])


class _Cover:
    """Spans in order of their starts, asked by place."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [s for s, _, _ in spans]
        self.ends = list(accumulate((e for _, _, e in spans), max))

    def holds(self, start: int, end: int) -> bool:
        """Does one span hold all of this?"""
        i = bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end

    def reaches(self, start: int) -> bool:
        """Does a span begin before this and end behind it?"""
        i = bisect_left(self.starts, start)
        return i > 0 and self.ends[i - 1] > start


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by a mark of its kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if end > at:
            out += [text[at : max(start, at)], f"[{KINDS[kind].upper()}]"]
            at = end
    return "".join([*out, text[at:]])


SCAN = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_named", T.LongType()),
    ]
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            base, spans = scan(text.as_py())
            kinds = Counter(k for _, k, _ in spans)
            sha = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((kinds[0], kinds[1], kinds[2], sha, joined(spans), kinds[3]))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        longs = [pa.array(columns[i], pa.int64()) for i in (0, 1, 2, 5)]
        texts = [pa.array(columns[i], pa.string()) for i in (3, 4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *longs[:3], *texts, longs[3]], SCAN.fieldNames())


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans.

    Kinds are assign, access, hex (the base patterns) and named (added by the
    lexer); offsets are code points, ends exclusive. A NULL or empty text has
    no spans. Repeated rows are scanned each for itself, ties in start follow
    the order of kinds, an empty table gives no rows, and columns other than
    doc_id and text are not read. No shuffle: each text is read where it lies.
    """
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(_digest, SCAN)


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked; `n_chars`, if there, follows.

    NULL texts stay NULL; rows, order of columns and types are kept.
    """
    names = docs.columns
    at = names.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(at)]
            columns = list(batch.columns)
            out = []
            changed = []
            for text in texts:
                spans = scan(text)[1]
                changed.append(bool(spans))
                out.append(masked(text, spans) if spans else text)
            columns[at] = pa.array(out, columns[at].type)
            if "n_chars" in names and any(changed):
                i = names.index("n_chars")
                lengths = [
                    len(t) if c else n.as_py() for t, c, n in zip(out, changed, columns[i], strict=True)
                ]
                columns[i] = pa.array(lengths, columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(mask, docs.schema)
