"""Secret scans by assignment-aware lexing.

Every assignment operator (=, :=, =>, :) of a text is lexed into a name before
it and an expression after it, in the syntaxes of programs, INI, YAML, JSON,
shell and environment files: quoted and triple-quoted strings, bare values,
adjacent and added strings, names of earlier assignments and ${NAME}
references, whose constants are propagated. A quoted literal that isn't
reported is lexed itself for the assignments in it. A literal is scored by how
sensitive its target's name is and by its own shape. Literals in the format of
a known provider count wherever they stand, with or without a name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import ChainMap, Counter
from functools import lru_cache
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import common as C

#: Least score of a reported secret.
THRESHOLD = 6.0
_OPERATOR = re.compile(r"(?<![=!<>+\-*/%&|^~:])(?:=>|:=|=(?![=~])|:(?![:=/\\]))")
_STRING = re.compile(r"[rbfuRBFU]{0,2}(\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)", re.S)
#: An unquoted value, up to the next pair of a query string.
_BARE = re.compile(r"(?:\$\{[A-Za-z_]\w*\}|[^\s\"'`,;(){}\[\]<>#&]|&(?![\w.\-]+=))+")
_QUOTE, _LINE_END = re.compile("[\"'`]"), re.compile("\n")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.]*\Z")
_REFERENCE = re.compile(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)|\{([A-Za-z_]\w*)\}")
_BLANK = re.compile(r"[ \t]*")
_JOIN = re.compile(r"[ \t]*(?:\\\r?\n)?[ \t]*(\+|\.(?=[ \t]*[\"'])|&(?=[ \t]))?[ \t]*(?:\\?\r?\n[ \t]*(?=[\"']))?")
_OPENED = re.compile(r"\(\s*(?=[rbfuRBFU]{0,2}[\"'])")
_ESCAPE = re.compile(r"\\(.)", re.S)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How sensitive a name is that holds these parts.
_SENSITIVE = {
    "password": 5, "passwd": 5, "passphrase": 5, "pwd": 4, "pass": 3, "secret": 5, "secrets": 5, "token": 4, "apikey": 5, "credential": 4, "credentials": 4,
    "auth": 3, "authorization": 4, "bearer": 4, "jwt": 3, "signature": 2, "salt": 2, "key": 2, "pin": 2, "dsn": 2, "cookie": 2, "session": 2, "private": 2, "access": 1, "api": 1, "client": 1, "encryption": 2, "signing": 2, "webhook": 2, "master": 1,
}
#: Names that hold these parts tell of a secret, but not the secret itself.
_HARMLESS = frozenset("file path dir url uri field label name type length len size min max count policy reset hint help text message error prompt column header public id regex pattern format expires expiry ttl".split())
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_(?:live|test)_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_\-]{35}|glpat-[0-9A-Za-z_\-]{20}|(?<![_\-])eyJ[0-9A-Za-z_\-]{10,}\.eyJ[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]+|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)")
_HINTS = ("AKIA", "ASIA", "gh", "xox", "sk_", "AIza", "glpat-", "eyJ", "-----BEGIN")
_PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|-+|0+|<.*>|\[.*\]|%.*%|\{\{.*\}\}|none|null|nil|true|false|undefined|todo|tbd|example.*|sample.*|dummy.*|test|changeme.*|change_me.*|replace.*|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)|password|passwd|secret|token|key|string|str|int|bool|float|env|os\.environ.*|process\.env.*|getenv.*)\Z")


def entropy(s: str) -> float:
    """Bits per character."""
    n = len(s)
    return -sum(c / n * log2(c / n) for c in Counter(s).values()) if n else 0.0


def name_score(name: str) -> float:
    """How sensitive a target's name is."""
    parts: list[str] = []
    for p in _PARTS.findall(name):
        both = (parts[-1] if parts else "") + p.lower()  # api_key is one word
        parts[-1:] = [both] if parts and both in _SENSITIVE else [*parts[-1:], p.lower()]
    score = float(sum(_SENSITIVE.get(p, 0) for p in dict.fromkeys(parts)))
    if parts and parts[-1] in _HARMLESS:
        score /= 3
    return min(score, 7.0)


@lru_cache(256)  # a constant may stand under many names
def literal_score(value: str) -> float:
    """How much a literal is like a secret, whatever its name; a placeholder, and one character repeated or none, is none."""
    if len(set(value)) < 2 or _PLACEHOLDER.match(value):
        return -10.0
    if _KNOWN.search(value):
        return 8.0
    if re.match(r"(?i)[a-z][a-z0-9+.\-]*://[^/\s:@]+:[^/\s:@]+@", value):
        return 6.0
    if " " in value.strip():
        return -3.0 if len(value.split()) > 3 else -1.0
    bits, kinds = entropy(value), sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    score = 1.0
    if re.match(r"(?:https?|file)://|\.{0,2}/", value):
        score -= 4
    if len(value) >= 16 and bits >= 3.0 and kinds >= 2:
        score += 2.0
    if len(value) >= 20 and bits >= 3.5:
        score += 1.0
    if kinds >= 2:
        score += 1.0
    if kinds == 1 and value.isalpha() and value.islower():
        score -= 1.0
    return score


def rated(name: str, value: str, quoted: bool) -> float | None:
    """The score of a literal with its target's name, if it is reported."""
    score, own = name_score(name), literal_score(value)
    if quoted and score >= 5 and own == 0 and value.isalpha() and value.islower():
        own = 1.0  # a quoted word under a password's name
    if not quoted and len(value) < 6:
        own -= 1.0  # a short bare word is likely of a sentence
    return round(score + own, 2) if (score >= 2 and score + own >= THRESHOLD) or own >= THRESHOLD else None


def _unescaped(text: str, start: int, end: int) -> tuple[str, list[int] | range]:
    """The characters of a quoted literal's span without its escapes, and the place of each and of the end."""
    if "\\" not in text[start:end]:
        return text[start:end], range(start, end + 1)
    out, places, at = [], [], start
    while at < end:
        places.append(at)
        if text[at] == "\\" and at + 1 < end:
            out.append({"n": "\n", "t": "\t"}.get(text[at + 1], text[at + 1]))
            at += 2
        else:
            out.append(text[at])
            at += 1
    return "".join(out), [*places, end]


class _Lexer:
    """All work is linear in the text: names are read backwards from their operators, and no character is in more than a few of them."""

    def __init__(self, text: str, constants=None, limit: int | None = None):
        self.text, self.constants = text, {} if constants is None else constants
        self.limit = len(text) if limit is None else limit  # a constant that would be longer isn't folded
        self.quotes = [m.start() for m in _QUOTE.finditer(text)]
        self.lines = [m.start() for m in _LINE_END.finditer(text)]

    def _blanks_before(self, at: int, low: int) -> int:
        while at > low and self.text[at - 1] in " \t\r\f\v":
            at -= 1
        return at

    def _name_ending(self, end: int, low: int) -> str | None:
        """The bare or quoted name that ends there, a quoted one maybe in brackets."""
        text, at = self.text, end
        if at > low and text[at - 1] == "]":
            at = self._blanks_before(at - 1, low)
        if at > low and text[at - 1] in "\"'`":
            k = bisect_left(self.quotes, at - 1) - 1
            start = self.quotes[k] + 1 if k >= 0 else 0
            return text[start : at - 1] if k >= 0 and low < start < at - 1 else None
        if at != end:
            return None
        while at > low and (text[at - 1].isalnum() or text[at - 1] in "_$.-"):
            at -= 1
        while at < end and text[at] not in _LETTERS and text[at] != "$":
            at += 1
        return text[at:end] or None

    def name_before(self, at: int) -> str | None:
        """The name of an operator's target, in its line; a type may come between, as in name: type = value."""
        text, k = self.text, bisect_left(self.lines, at)
        low = self.lines[k - 1] + 1 if k else 0
        end = self._blanks_before(at, low)
        start = end
        while start > low and (text[start - 1].isalnum() or text[start - 1] in "_.[]"):
            start -= 1
        colon = self._blanks_before(start, low)
        if start < end and text[start] in _LETTERS and colon > low and text[colon - 1] == ":":
            named = self._name_ending(self._blanks_before(colon - 1, low), low)
            if named:
                return named
        return self._name_ending(end, low)

    def resolve(self, value: str) -> str:
        """The value with the constants that it refers to, unless that is longer than the limit."""
        if "$" not in value and "{" not in value:
            return value
        of = lambda m: self.constants.get(m.group(1) or m.group(2) or m.group(3), (m.group(), 0, 0))[0]
        size = len(value) + sum(len(of(m)) - len(m.group()) for m in _REFERENCE.finditer(value))
        return _REFERENCE.sub(of, value) if size <= self.limit else value

    def expression(self, at: int, stop: int | None) -> tuple[str, int, int] | None:
        """The constant that the expression at this place folds to, with its span; a bare value ends at stop at the latest."""
        text = self.text
        at = _BLANK.match(text, at).end()
        opened = text[at : at + 1] == "(" and _OPENED.match(text, at)
        if opened:
            at = opened.end()
        start, out, end, size, quoted = at, [], at, 0, False
        while True:
            m = _STRING.match(text, at)
            if m:
                raw = m.group(1)
                q = 3 if raw[:3] in ('"""', "'''") else 1
                body = raw[q:-q]
                out.append(self.resolve(_ESCAPE.sub(lambda e: {"n": "\n", "t": "\t"}.get(e.group(1), e.group(1)), body) if "\\" in body else body))
                quoted = quoted or at == start
            else:
                m = _BARE.match(text, at) if stop is None else _BARE.match(text, at, stop)
                if not m:
                    break
                word = m.group()
                if _IDENTIFIER.match(word):
                    known = self.constants.get(word) or self.constants.get(word.rsplit(".", 1)[-1])
                    if text[m.end() : m.end() + 1] in ("(", "["):
                        return None  # a call or an item isn't a constant
                    if known:
                        out.append(known[0])
                    elif out or self.text[m.end() : m.end() + 3].lstrip().startswith("+"):
                        return None
                    else:
                        out.append(word)
                elif out and not text[at - 1] == "+":
                    break
                else:
                    out.append(self.resolve(word).rstrip(".") if word.endswith(".") else self.resolve(word))
            end = m.end()
            size += len(out[-1])
            if size > self.limit:
                return None
            if stop is not None and end >= stop:
                break
            join = _JOIN.match(text, end)
            nxt = join.end()
            if nxt >= len(text) or not (join.group(1) or (quoted and _STRING.match(text, nxt))):
                break
            gap = text[end:nxt]
            if text[nxt] in "\r\n" or ("\n" in gap and not (opened or join.group(1) or "\\" in gap)):
                break  # a string on the next line belongs to this one in brackets, or where the line is continued
            at = nxt
        if not out:
            return None
        return "".join(out), start, end

    def pairs(self):
        """(name, literal, start, end, score or None) of all assignments.

        Those in a quoted literal that isn't reported come after it. An
        operator in the bare value of another one has a value up to the next
        operator, if the whole value isn't reported.
        """
        at, bare, found = 0, 0, list(_OPERATOR.finditer(self.text))
        for k, m in enumerate(found):
            if m.start() < at:
                continue
            named = self.name_before(m.start())
            if not named:
                continue
            inner = m.start() < bare
            stop = min(bare, found[k + 1].start() if k + 1 < len(found) else bare) if inner else None
            got = self.expression(m.end(), stop)
            if not got:
                continue
            value, start, end = got
            self.constants[named] = self.constants[named.rsplit(".", 1)[-1]] = got
            first = _STRING.match(self.text, start)
            score = rated(named, value, first is not None)
            yield named, value, start, end, score
            if first is not None or self.text[start : start + 1] in "\"'`":
                at = end
                if score is None:
                    yield from self.inside(start, end)
            elif not inner:
                bare, at = end, end if score is not None else at

    def inside(self, start: int, end: int):
        """The pairs in the quoted literals of an expression; their names are unknown outside."""
        for m in _STRING.finditer(self.text, start, end):
            q = 3 if m.group(1)[:3] in ('"""', "'''") else 1
            body, places = _unescaped(self.text, m.start(1) + q, m.end(1) - q)
            if "=" in body or ":" in body:
                for name, value, a, b, score in _Lexer(body, ChainMap({}, self.constants), self.limit).pairs():
                    yield name, value, places[a], places[b], score


def secrets(text: str) -> list[tuple[str | None, str, int, int, float]]:
    """(name, literal, start, end, score) of all secrets in a text, in order. Spans are of the expressions, in characters."""
    out = []
    if "=" in text or ":" in text:
        out = [found for found in _Lexer(text).pairs() if found[4] is not None]
    if any(h in text for h in _HINTS):
        spans = sorted((a, b) for _, _, a, b, _ in out)
        starts, ends = [a for a, _ in spans], [*accumulate((b for _, b in spans), max)]
        for m in _KNOWN.finditer(text):
            k = bisect_right(starts, m.start())
            if not k or ends[k - 1] < m.end():
                out.append((None, m.group(), m.start(), m.end(), 8.0))
    return sorted(out, key=lambda x: (x[2], x[3], x[0] or ""))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, name, literal, start, stop, score): every secret of every text.

    Needs doc_id and text. name is null for a known format that no assignment
    names; start and stop are the expression's span in characters. A name
    assigned several times is its last value before the use; a constant that
    would be longer than its whole text is not folded. Names and literals are
    of any length: short ones score as others do, but a bare word under six
    characters a point less. A null or empty text has no secrets; unended
    strings are no literals; repeated rows have equal results; secrets of one
    place are ordered by end and name; ids keep their type; long texts are
    taken whole; an empty table gives no rows; other columns are ignored.
    """
    C.arrow_batches(docs.sparkSession)
    docs = docs.select(C.own(docs, "doc_id").alias("doc_id"), C.own(docs, "text").alias("text")).where("text is not null")

    def run(batches):
        for batch in batches:
            rows = [(i, *found) for i, text in enumerate(batch.column("text").to_pylist()) for found in secrets(text)]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            at, *cols = (pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *cols], names=["doc_id", "name", "literal", "start", "stop", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, name string, literal string, start long, stop long, score double")


def op9_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every document."""
    return scan(C.table(spark, sf_dir, "documents"))
