"""Secrets in text: fixed base patterns, and assignment-aware lexing of source and configuration.

The lexer cuts a text into strings, names, signs and marks and reads name-literal pairs in the forms
that source code, JSON, YAML, XML and property files share: assignments, typed declarations, keys,
elements and attributes, name and value halves, blocks of lines, lists and calls.  Comments and
strings are read like code.  Literals are carried through names that stand for them, through
concatenation and into strings, within the scopes that braces make, and each is scored by how
sensitive the names are that it reaches.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import slices

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "literal")

#: The base patterns; letters of names in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
_NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of a name and how much each says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "privatekey": 1.0, "accesskey": 0.9,
    "secretkey": 1.0, "authkey": 0.9, "signingkey": 0.9, "encryptionkey": 0.9, "clientsecret": 1.0, "authtoken": 1.0,
    "connectionstring": 0.7, "salt": 0.5, "auth": 0.5, "key": 0.3,
}
#: What stands in a template where the secret goes.
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|none|null|nil|true|false|undefined|todo|changeme|change_me|example|sample|dummy|test|password|passwd|secret|token|your[\W_].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|\$\w+)$")
#: The parts of SENSITIVE that hold no other one: what is left of a text's letters and digits, lower-cased, has one of them if any name weighs.
_HINTS = tuple(x for x in SENSITIVE if not any(y in x for y in SENSITIVE if y != x))
_LOWER = bytes(range(256)).lower()
_BETWEEN = bytes(c for c in range(256) if not chr(c).isalnum() or c > 127)

#: Tokens of source and configuration.  Every alternative is possessive, and each kind of quote fails
#: to close once a line at most, so the time is proportional to the text.
_NAME = r"[A-Za-z_][A-Za-z0-9_]*+(?:[.-][A-Za-z0-9_]++)*+"
_TOKEN = re.compile(
    r"""(?P<text>(?<![A-Za-z0-9_])[bBrRuUfF@$]?(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|\'\'\'(?:[^'\\]|\\.|'(?!''))*+\'\'\')"""
    r"""|(?<![A-Za-z0-9_])[bBrRuUfF@$]?(?:"(?:[^"\\\n]|\\.)*+"|(?<!&)'(?:[^'\\\n]|\\.)*+')|"(?:[^"\\\n]|\\.)*+"|`(?:[^`\\\n]|\\.)*+`(?!`))"""
    rf"""|(?P<name>{_NAME})"""
    r"""|(?P<word>[0-9][A-Za-z0-9_]*+)"""
    r"""|(?P<sign>:=|=>|\+=|\?\?=|\|\|=|=(?!=)|:(?![:/]))"""
    r"""|(?P<join>\+|\|\||\?\?|\.\.)"""
    r"""|(?P<line>\n|//|/\*|\*/|<!--|-->)"""
    r"""|(?P<mark>::|==+|[][(){}<>|&*?!,;'])"""
    r"""|(?P<other>\\.|[^ \t])""",
    re.A | re.S,
)
_PLAIN = re.compile(_NAME, re.A)
_BARE = re.compile(r"[A-Za-z0-9+/_.=$~!@%^&*-]+", re.A)
#: A name in braces within a string: its value becomes part of the string.
_WITHIN = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]{0,80})\}", re.A)
#: An element with nothing but text in it, and the attribute that may name it.
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)([^<>]*+)>([^<>]++)</", re.A)
_NAMED_BY = re.compile(r"""(?<![A-Za-z0-9])(?:name|key|id)\s*+=\s*+["']([^"'\n]{1,80})["']""", re.A | re.I)
#: A YAML block of lines after | or >.
_BLOCK = re.compile(r"[|>][-+0-9]*+[ \t]*+\n", re.A)
#: Words that are types where a name stands before them; calls whose first argument is
#: the name of a value; names for the two halves of a pair.
_TYPES = frozenset("string str text char byte bytes object any varchar nvarchar varchar2 nvarchar2".split())
_GETTERS = frozenset("getenv env environ get getproperty getstring getenvironmentvariable lookup fetch config var input prompt print".split())
_NAME_HALF, _VALUE_HALF = frozenset(("name", "key", "id", "variable")), frozenset(("value", "content", "default"))
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def sensitivity(name: str) -> float:
    """0 to 1: the most that a part of the name, or two parts in a row, says; camel case is split."""
    parts = [x.lower() for x in _CAMEL.findall(name)]
    joined = [*parts, *map("".join, zip(parts, parts[1:]))]
    return max((SENSITIVE.get(x, SENSITIVE.get(x.removesuffix("s"), 0.0)) for x in joined), default=0.0)


def strength(literal: str) -> float:
    """0 to 1: how much a literal looks like a secret, by length, bits a character and mixed kinds."""
    if len(literal) < 6 or PLACEHOLDERS.match(literal) or " " in literal.strip() and len(literal.split()) > 3:
        return 0.0
    counts = {c: literal.count(c) for c in set(literal)}
    bits = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    mixed = sum(any(map(f, literal)) for f in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum()))
    return min(1.0, len(literal) / 16) * 0.4 + min(1.0, bits / 4) * 0.4 + (mixed - 1) / 3 * 0.2


def hinted(text: str) -> bool:
    """Whether a name with sensitivity can be in the text, whatever stands between its parts."""
    folded = text.encode("ascii", "ignore").translate(_LOWER, _BETWEEN).decode("ascii")
    return any(x in folded for x in _HINTS)


class Scope:
    """Names of a block in braces: what each is given, and reads that no name of the block answers."""

    def __init__(self):
        self.given: dict[str, int] = {}
        self.open: dict[str, list[int]] = {}


class Lexer:
    """Name-literal pairs of a text, and which names' values each name is given.

    A variable is a name in a scope; braces open and close scopes.  A read is answered by the nearest
    scope around it that gives the name a value, before or after (configuration has no order), failing
    that by any.  ``a.token`` and ``b.token`` are different names.
    """

    def __init__(self, text: str):
        self.text = text
        self.names: list[str] = []
        self.spans: list[list[tuple[int, int]]] = []
        self.reads: list[list[int]] = []
        self.anywhere: dict[str, list[int]] = {}
        self.scopes = [Scope()]
        self.region(0, len(text), 0)
        for m in _ELEMENT.finditer(text):
            by = _NAMED_BY.search(m[2])
            a, b = m.span(3)
            body = m[3].strip()
            if body:
                a += m[3].index(body)
                self.pair([by[1] if by else m[1]], [(a, a + len(body))], [])
        while self.scopes:
            self.close()

    def variable(self, raw: str) -> int:
        given = self.scopes[-1].given
        k = given.get(raw)
        if k is None:
            k = given[raw] = self.node(raw, [])
            self.anywhere.setdefault(raw, []).append(k)
        return k

    def node(self, raw: str, reads: list[int]) -> int:
        self.names.append(raw)
        self.spans.append([])
        self.reads.append(reads)
        return len(self.names) - 1

    def pair(self, names: list[str], spans: list[tuple[int, int]], reads: list[str]) -> None:
        for raw in names:
            k = self.variable(raw)
            self.spans[k] += spans
            for x in reads:
                self.scopes[-1].open.setdefault(x, []).append(k)

    def close(self) -> None:
        """Answers the reads of the innermost scope; the others go to the scope around it, the smaller table into the larger."""
        scope = self.scopes.pop()
        left = {}
        for x, readers in scope.open.items():
            hit = scope.given.get(x)
            if hit is None and self.scopes:
                left[x] = readers
                continue
            if hit is None and (hits := self.anywhere.get(x) or self.anywhere.get(x.rpartition(".")[2], [])):
                hit = self.node("", hits) if len(hits) > 1 else hits[0]  # one node that all readers share
            if hit is not None:
                for k in readers:
                    self.reads[k].append(hit)
        if self.scopes:
            around = self.scopes[-1]
            if len(around.open) < len(left):
                around.open, left = left, around.open
            for x, readers in left.items():
                held = around.open.get(x)
                if held is None:
                    around.open[x] = readers
                elif len(held) < len(readers):
                    readers += held
                    around.open[x] = readers
                else:
                    held += readers

    def region(self, lo: int, hi: int, depth: int) -> None:
        """Reads statements of text[lo:hi]; strings are read again, as regions of their own, to a depth that quotes allow."""
        text = self.text
        toks = [(m.lastgroup, *m.span()) for m in _TOKEN.finditer(text, lo, hi)]
        toks.append(("line", hi, hi))
        typed: dict[int, str] = {}
        bottom, named, k = len(self.scopes), (-99, ""), 0
        while k < len(toks):
            kind, a, b = toks[k]
            if kind == "mark" and text[a] in "{}":
                if text[a] == "{":
                    self.scopes.append(Scope())
                elif len(self.scopes) > bottom:
                    self.close()
            elif kind == "text":
                self.inside(a, b, depth)
            elif kind == "sign" and k:
                names = self.before(toks, k, typed)
                if names:
                    spans, reads, end = self.after(toks, k, depth)
                    if names and text[a:b] == ":" and k not in typed and (at := self.type_ends(toks, k)):
                        typed[at] = names[0]
                        end = k + 1
                    if text[a:b] in ("+=", "||=", "??="):
                        reads = reads + [names[0]]
                    last = names[0].lower()
                    if last in _VALUE_HALF and k - named[0] <= 12:
                        names = [*names, named[1]]
                    elif last in _NAME_HALF and k + 1 < len(toks):
                        first = spans[0] if spans else m.span() if (m := _BARE.match(text, toks[k + 1][1], hi)) else (0, 0)
                        if 0 < first[1] - first[0] <= 80:
                            named = k, text[slice(*first)]
                    self.pair(names, spans, reads)
                    for j in range(k + 1, end):
                        if toks[j][0] == "text":
                            self.inside(toks[j][1], toks[j][2], depth)
                    k = max(k + 1, end)
                    continue
            k += 1
        while len(self.scopes) > bottom:
            self.close()

    def inside(self, a: int, b: int, depth: int) -> None:
        lo, hi = self.inner(a, b)
        if depth < 3 and hi - lo >= 8 and (self.text.find("=", lo, hi) >= 0 or self.text.find(":", lo, hi) >= 0):
            self.scopes.append(Scope())
            self.region(lo, hi, depth + 1)
            self.close()

    def inner(self, a: int, b: int) -> tuple[int, int]:
        """What is between the quotes of a string, whatever its prefix."""
        text = self.text
        a += text[a] not in "\"'`"
        n = 3 if b - a >= 6 and text[a] != "`" and text[a] * 3 == text[a : a + 3] else 1
        return a + n, b - n

    def before(self, toks, k: int, typed: dict[int, str]) -> list[str]:
        """The names that the sign at k may give a value to."""
        text = self.text
        if k in typed:
            return [typed[k]]
        j = k - 1
        if j and toks[j][0] == "mark" and (text[toks[j][1]] in "?!" or text[toks[j][1]] == "]" and toks[j - 1][0] == "text"):
            j -= 1
        kind, a, b = toks[j]
        if kind == "text":
            a, b = self.inner(a, b)
            return [text[a:b]] if 0 < b - a <= 80 and "\n" not in text[a:b] else []
        if text[a] == ")" and j >= 3 and text[toks[j - 2][1]] == "(":
            j -= 3
            kind, a, b = toks[j]
            if text[a:b].lower() not in _TYPES:
                return []
        if kind != "name":
            return []
        names = [text[a:b]]
        i = j - 1
        while i >= 0 and (text[toks[i][1] : toks[i][2]] == "*" or text[toks[i][1] : toks[i][2]].lower() == "as") and j - i < 4:
            i -= 1
        if i >= 0 and toks[i][0] == "name" and (names[0].lower() in _TYPES or i and text[toks[i - 1][1] : toks[i - 1][2]] == "var"):
            names.append(text[toks[i][1] : toks[i][2]])
        return names

    def type_ends(self, toks, k: int) -> int | None:
        """The place of the = that follows a colon and a type."""
        text, depth, j = self.text, 0, k + 1
        while j < len(toks):
            kind, a, b = toks[j]
            x = text[a:b]
            if kind == "sign":
                spaced = text[a - 1] in " \t" and text[b : b + 1] in (" ", "\t")
                ok = x == "=" and j > k + 1 and depth == 0 and j + 1 < len(toks) and (toks[j + 1][0] == "text" or spaced and toks[j + 1][0] != "line")
                return j if ok else None
            if kind not in ("name", "mark") or x in ("{", "}", ";", "==") or x == "," and not depth:
                return None
            depth += (x in "<[(") - (x in ">])")
            if depth < 0:
                return None
            j += 1
        return None

    def after(self, toks, k: int, depth: int) -> tuple[list[tuple[int, int]], list[str], int]:
        """Literal spans, names read, and the first token after the value of the sign at k."""
        text, (_, sign, end) = self.text, toks[k]
        colon = text[sign:end] == ":"
        spans, reads, j = [], [], k + 1
        if colon and (m := _BLOCK.match(text, toks[j][1])):
            return self.block(toks, k, m.end())
        while toks[j][0] == "line" and j + 1 < len(toks) and text[toks[j][1] : toks[j][2]] == "\n" and j - k <= 3:
            j += 1
        if j > k + 1 and (toks[j][0] != "text" or j + 1 < len(toks) and toks[j + 1][0] == "sign"):
            return [], [], k + 1
        listed, key = 0, False  # in how many brackets; whether the next string is the name of a value
        while j < len(toks):
            kind, a, b = toks[j]
            x = text[a:b]
            if kind == "text":
                lo, hi = self.inner(a, b)
                if key:
                    reads.append(text[lo:hi])
                else:
                    spans.append((lo, hi))
                    reads += _WITHIN.findall(text, lo, hi)
                key = False
                j += 1
                more = toks[j][0] == "join" or toks[j][0] == "text" or listed and text[toks[j][1] : toks[j][2]] in (",", ")", "]", "\n")
                if not more:
                    return spans, reads, j
                continue
            if kind == "join" and (spans or reads):
                j += 1
                while toks[j][0] == "line" and j + 1 < len(toks):
                    j += 1
                continue
            if x in ("(", "["):
                listed += 1
            elif x in (")", "]") and listed:
                listed -= 1
                if not listed and toks[j + 1][0] != "join":
                    return spans, reads, j + 1
            elif x == "," and listed:
                pass
            elif kind == "line" and listed and x == "\n":
                pass
            elif kind == "name" and text[b : b + 1] == "(":
                key = x.rpartition(".")[2].lower() in _GETTERS
                listed, j = listed + 1, j + 1
            elif kind == "name" and text[b : b + 1] == "[" and j + 2 < len(toks) and toks[j + 2][0] == "text":
                key, listed, j = True, listed + 1, j + 1
            elif kind == "name" and (toks[j + 1][0] == "join" or listed):
                reads.append(x)
            elif not listed and kind in ("name", "word", "sign", "join", "mark", "other") and (m := _BARE.match(text, a, toks[-1][2])):
                if not colon or any(c.isdigit() for c in m[0]):
                    reads.append(m[0])
                    spans.append(m.span())
                while toks[j][1] < m.end() and j + 1 < len(toks):
                    j += 1
                return spans, reads, j
            else:
                return spans, reads, j
            j += 1
        return spans, reads, len(toks)

    def block(self, toks, k: int, at: int) -> tuple[list[tuple[int, int]], list[str], int]:
        """The lines of a YAML block: those further in than the line of the key."""
        text, hi = self.text, toks[-1][2]
        line = text.rfind("\n", 0, toks[k][1]) + 1
        lead = len(text[line : toks[k][1]]) - len(text[line : toks[k][1]].lstrip(" -"))
        spans, j = [], k + 1
        while at < hi:
            stop = text.find("\n", at, hi)
            stop = hi if stop < 0 else stop
            body = text[at:stop]
            if body.strip() and len(body) - len(body.lstrip(" ")) <= lead:
                break
            if body.strip():
                spans.append((stop - len(body.lstrip(" \t")), at + len(body.rstrip())))
            at = stop + 1
        while j < len(toks) - 1 and toks[j][1] < at:
            j += 1
        return spans, [], j


def literals(text: str, threshold: float = 0.55) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the literals that reach a sensitive name.

    A name that is given another name's value passes it on, through any number of steps; each
    literal has the score of the most sensitive name it reaches.  Time grows in proportion to the
    text: names are visited once, the most sensitive first, and those that read a name from outside
    all its scopes share one node with all its values.

    Bounds of the grammar, beyond which no pair is formed (the base patterns do not depend on them):
    quoted names, names in braces and ``name=`` attributes of 80 characters; a name half and a value half
    12 tokens apart; a value three line ends below its sign; strings in strings to three levels.
    """
    if not any(c in text for c in "=:<") or not hinted(text):
        return []
    lexer = Lexer(text)
    weights = [sensitivity(x.rpartition(".")[2] if _PLAIN.fullmatch(x) else x) for x in lexer.names]
    best: dict[tuple[int, int], tuple[float, str]] = {}
    seen = [False] * len(weights)
    for k in sorted((k for k, w in enumerate(weights) if w), key=lambda k: -weights[k]):
        todo = [k]
        while todo:
            at = todo.pop()
            if seen[at]:
                continue
            seen[at] = True
            for span in lexer.spans[at]:
                if weights[k] > best.get(span, (0.0,))[0] and text[span[0] : span[1]] not in lexer.anywhere:
                    best[span] = weights[k], lexer.names[k]
            todo += lexer.reads[at]
    scored = ((a, b, name, weight * (0.3 + 0.7 * s)) for (a, b), (weight, name) in best.items() if (s := strength(text[a:b])))
    return sorted(x for x in scored if x[3] >= threshold)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within each kind."""
    out = []
    folded = text.lower()
    if any(x in folded for x in _NAMED):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.55, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, spans) for each row; spans is an array of (kind, start, end, name, score).

    Spans are code points, end exclusive, ordered by start, then kind as in KINDS, then end.  Kinds
    assign, access and hex are the base patterns, whose spans are always there, with score 1;
    literal spans are those that the lexer adds.  Null and empty texts have no spans.  Rows are
    independent of each other; repeated ids give repeated rows; an empty table gives none.
    """

    def scan(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "__text"):
                rows = []
                for text in part.column("__text").to_pylist():
                    found = []
                    if text:
                        found = [(a, KINDS.index(k), b, "", 1.0) for a, b, k in base_spans(text)]
                        found += [(a, KINDS.index("literal"), b, name, score) for a, b, name, score in literals(text, threshold)]
                    rows.append([{"kind": KINDS[k], "start": a, "end": b, "name": name, "score": score} for a, k, b, name, score in sorted(found)])
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(k) for k in range(2, part.num_columns)), pa.array(rows, kind)], names=["id", *keep, "spans"])

    types = dict(docs.dtypes)
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *(F.col(c) for c in keep))
    schema = ", ".join([f"id {types[id_col]}", *(f"`{c}` {types[c]}" for c in keep), "spans array<struct<kind: string, start: long, end: long, name: string, score: double>>"])
    return plain.mapInArrow(scan, schema)


def redact(text, spans):
    """Column: the text with every span replaced by [REDACTED]; overlapping spans count as one.

    Spans must be ordered by start, as find_secrets leaves them.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("[REDACTED]")).alias("out"),
        )
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(longer)

    done = F.aggregate(spans, start, step)
    whole = F.concat(done["out"], F.substr(text, done["at"].cast("int") + 1))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(whole)
