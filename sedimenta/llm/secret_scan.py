"""Secret scan by assignment-aware lexing of source and configuration syntax."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How telling each word of a target's name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "signature": 0.5, "privatekey": 1.0, "accesskey": 0.9, "secretkey": 1.0, "authtoken": 1.0,
    "accesstoken": 1.0, "clientsecret": 1.0, "dsn": 0.6, "connectionstring": 0.7, "cookie": 0.5, "session": 0.4, "salt": 0.5, "otp": 0.5, "pin": 0.4,
}
PHRASES = {("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("connection", "string"): 0.7}
HARMLESS = {"public", "count", "length", "len", "max", "min", "limit", "size", "type", "name", "path", "file", "url", "uri", "field", "label", "expires", "expiry", "ttl", "regex", "pattern", "placeholder", "header", "hint"}
PLACEHOLDER = re.compile(
    r"^(?:x+|\*+|\.+|-+|none|null|nil|true|false|undefined|changeme|change_me|password|secret|token|test|example|dummy|todo|tbd|your.*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|str|string|text|int|integer|bytes|varchar\d*|optional|any)$", re.I
)
KNOWN_FORMS = r"AKIA[0-9A-Z]{16}|gh[pousr]_\w{30,}|xox[abprs]-[\w-]{10,}|sk_(?:live|test)_\w{16,}|AIza[\w-]{30,}|eyJ[\w-]+\.[\w-]+\.[\w-]*|-----BEGIN [A-Z ]*PRIVATE KEY"
KNOWN = re.compile(rf"^(?:{KNOWN_FORMS})")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
BARE = re.compile(r"[^\s,;#'\"`(){}\[\]<>]+")
BARE_PHRASE = re.compile(rf"{BARE.pattern}(?:[ \t]+{BARE.pattern})*")
SCHEME = re.compile(r"(?:bearer|basic|token)[ \t]+(?=\S+\s*$)", re.I)  # of an Authorization header, before its one token
BARE_SCHEME = re.compile(r"(?:bearer|basic|token)[ \t]+(?=[^\s,;#'\"`(){}\[\]<>])", re.I)
PHRASE_NAMES = {"passphrase", "password", "passwd", "pwd"}
PROMPT = re.compile(r"\b(?:enter|your|please|password|passphrase|must|invalid|incorrect|forgot|wrong|required|the|is)\b", re.I)
HOLE = re.compile(r"\$?\{([A-Za-z_][\w.]*)\}")
LOGIN = re.compile(r"[A-Za-z][\w+.-]{1,20}://([^\s/:@'\"<>]*):([^\s/@'\"<>]+)@[\w.-]")
SETTER = re.compile(r"^(?:set|with|use|put|add)_?(?=[A-Z_a-z])")
#: What a text has that holds a secret: a word of a telling name, a login in a URL, or a known form; other texts aren't lexed.
HINT = rf"(?i:pass|pwd|secret|token|key|cred|auth|bearer|sign|dsn|connection|cookie|session|salt|otp|pin|://[^/\s]*:[^@\s]*@)|{KNOWN_FORMS}"
TOKEN = re.compile(
    r"""(?P<blank>[ \t\f\v]+|\\\r?\n)|(?P<line>\r?\n|\r)
    |(?P<text>(?:[rRbBuUfF]{1,2}|@|\$@?)?(?:\"\"\"(?:[^\\"]|\\.|"(?!""))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`))
    |(?P<name>[A-Za-z_$][\w$]*(?:'(?:t|s|re|ve|ll|d|m)\b|(?:(?:\.|::|->|-(?=[A-Za-z_]))[A-Za-z_$][\w$]*)*))
    |(?P<op>=>|:=|\+=|\?\?=|\|\|=|\?=|==+|!=+|<=|>=|=~|~=|::|\?:|://|[=:])|(?P<other>[^\s])""",
    re.S | re.X,
)
ASSIGN = {"=>", ":=", "+=", "?=", "??=", "||=", "=", ":", "?:"}
TAG = re.compile(r"<([A-Za-z_][\w:.-]*)((?:\s+[A-Za-z_][\w:.-]*\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'))*)\s*(/?>)")
ATTRIBUTE = re.compile(r"([A-Za-z_][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
CONTENT = re.compile(r"\s*([^<>]*?)\s*</")
SCHEMA = "doc_id bigint, name string, start int, end int, score double, redacted string, literal_sha256 string, propagated boolean"


class Token:
    __slots__ = ("kind", "start", "end", "text")

    def __init__(self, kind: str, start: int, end: int, text: str):
        self.kind, self.start, self.end, self.text = kind, start, end, text

    @property
    def value(self) -> str:
        """What is between a literal's quotes."""
        body = self.text.lstrip("rRbBuUfF@$")
        n = 3 if body[:3] in ('"""', "'''") else 1
        return body[n:-n]


def lex(text: str) -> list[Token]:
    """The tokens of a text, without blanks and continued line ends."""
    return [Token(m.lastgroup, m.start(), m.end(), m[0]) for m in TOKEN.finditer(text) if m.lastgroup != "blank"]


class Grown:
    """The value of a name that ``+=`` adds to: its parts, put together when they are asked for, so that many additions cost no more than their length."""

    def __init__(self, value: str):
        self.parts = [value]

    def text(self) -> str:
        if len(self.parts) > 1:
            self.parts = ["".join(self.parts)]
        return self.parts[0]


class Lexed:
    """A text's tokens and the (name, value, start, end, propagated) that its statements give; values are those that are known there."""

    def __init__(self, text: str):
        self.text, self.tokens = text, lex(text)
        self.known: dict[str, Grown] = {}

    def _at(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts

    def _kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def _skip_lines(self, i: int) -> int:
        while self._kind(i) == "line":
            i += 1
        return i

    # -- values

    def _operand(self, i: int):
        """(value, end, next token, whether a constant was put in) of a literal, a known name, or ``sep.join([...])``."""
        if self._kind(i) == "text":
            t = self.tokens[i]
            if self._at(i + 1, ".") and self._at(i + 2, "join") and self._at(i + 3, "("):
                return self._join(t.value, i + 4)
            value = HOLE.sub(lambda h: self.known[h[1]].text() if h[1] in self.known else h[0], t.value)
            return value, t.end, i + 1, value != t.value
        if self._kind(i) == "name" and self.tokens[i].text in self.known:
            return self.known[self.tokens[i].text].text(), self.tokens[i].end, i + 1, True
        return None

    def _join(self, sep: str, i: int):
        parts, i = [], self._skip_lines(i)
        if not self._at(i, "[", "("):
            return None
        i = self._skip_lines(i + 1)
        while not self._at(i, "]", ")"):
            if not (found := self._operand(i)):
                return None
            parts.append(found[0])
            i = self._skip_lines(found[2])
            if self._at(i, ","):
                i = self._skip_lines(i + 1)
        i = self._skip_lines(i + 1)
        return (sep.join(parts), self.tokens[i].end, i + 1, True) if self._at(i, ")") else None

    def expression(self, i: int, open_line: bool = True):
        """(value, start, end, next token, propagated) of literals and known names that are joined by ``+``, ``.`` or standing side by
        side, in brackets or not. They may begin on a later line if they aren't assigned to there, and go on over lines inside brackets."""
        depth, below, parts, used, start, end = 0, False, [], False, -1, -1
        while True:
            while self._at(i, "(") or self._kind(i) == "line" and (depth or not parts and open_line):
                below |= self._kind(i) == "line"
                depth += self._at(i, "(")
                i += 1
            found = self._operand(i)
            if not found or below and not parts and self._at(found[2], *ASSIGN):
                break
            start = self.tokens[i].start if start < 0 else start
            value, end, i, more = found
            parts.append(value)
            used |= more
            j = i
            while depth and (self._at(j, ")") or self._kind(j) == "line"):
                depth -= self._at(j, ")")
                j += 1
            i = j
            if self._at(i, "+") or self._at(i, ".") and self._kind(i + 1) in ("text", "name"):
                i = self._skip_lines(i + 1)
            elif self._kind(i) != "text":
                break
        return ("".join(parts), start, end, i, used) if parts else None

    def _bare(self, i: int, phrase: bool, style: str):
        """A word of configuration syntax that begins at a token; of a header the word after the auth scheme, of a passphrase all to the
        line's end. In source code (``style``) a word of letters alone is another name, not a literal."""
        if i >= len(self.tokens) or self.tokens[i].kind in ("line", "text"):
            return None
        at = self.tokens[i].start
        m = (BARE_PHRASE if phrase else BARE).match(self.text, at)
        if not m:
            return None
        if scheme := BARE_SCHEME.match(self.text, at):
            m = BARE.match(self.text, scheme.end())
        value = m[0].rstrip(".")
        if not value or self.text[m.end() : m.end() + 1] in ("(", "[") or style == "code" and not any(c.isdigit() for c in value):
            return None
        while i < len(self.tokens) and self.tokens[i].start < m.end():
            i += 1
        return value, m.start(), m.start() + len(value), i, False

    # -- targets

    def _target(self, first: int, op: int) -> list[str | None]:
        """The names that the tokens of a statement before its operator assign to."""
        own = [t for t in self.tokens[first:op] if t.kind != "line"]
        if self.tokens[op].text in ("=", "?=") and (typed := next((k for k, t in enumerate(own) if t.text in (":", "?:") and k and own[k - 1].kind in ("name", "text")), 0)):
            own = own[:typed]
        parts: list[list[Token]] = [[]]
        depth = 0
        for t in own:
            depth += t.text in ("(", "[", "{")
            depth = max(0, depth - (t.text in (")", "]", "}")))
            if t.text == "," and not depth:
                parts.append([])
            else:
                parts[-1].append(t)
        return [self._name(p) for p in parts]

    @staticmethod
    def _name(tokens: list[Token]) -> str | None:
        """An identifier, a quoted or subscripted key: the last of them."""
        for t in reversed(tokens):
            if t.kind == "name":
                return t.text.strip("$.-")
            if t.kind == "text":
                return t.value.strip()
            if t.text not in (")", "]", "}"):
                return None
        return None

    # -- statements

    def pairs(self):
        """All pairs of the text, in the order of their values."""
        # first: where the statement's target begins; colon: whether a colon in it gave nothing yet (a type may follow)
        tokens, first, ternary, colon, together, i = self.tokens, 0, False, False, True, 0
        self.line = 0
        while i < len(tokens):
            t = tokens[i]
            if t.kind == "line" or t.text in (";", "{", "("):
                first, ternary, colon, together = i + 1, False, False, True
                self.line = i + 1 if t.kind == "line" else self.line
            elif t.text == "?" and not self._at(i + 1, ":"):
                ternary = True
            elif t.text == "#" and self._at(i + 1, "define") and self._kind(i + 2) == "name":
                if found := self.expression(i + 3, False) or self._bare(i + 3, False, "config"):
                    yield from self._give([tokens[i + 2].text], found, "=")
                    i = found[3]
                    continue
            elif t.kind == "name" and self._at(i + 1, "(") and (found := self._call(i)):
                yield from self._give([found[0]], found[1], "(")
                i = found[1][3]
                continue
            elif t.text in ASSIGN and i > first and not (t.text == ":" and ternary):
                if t.text == ":" and colon:
                    first = i - 1
                done = None
                for pair in self._assigned(first, i):
                    if pair is not None:
                        yield pair[0]
                        done = pair[1]
                if done is not None:
                    first, i, colon, together = done, done, False, True
                    continue
                colon = t.text in (":", "?:")
                first = first if colon else i + 1
            elif t.text == ",":
                if not together or i == first:  # the next key of a literal; else names that are assigned to together
                    first, colon, together = i + 1, False, True
            elif t.kind != "name" and t.text not in (")", "*"):
                together = False
            i += 1
        yield from self._tags()
        yield from self._logins()

    def _call(self, i: int):
        """(name, value) of ``define("NAME", "value")`` and of ``setName("value")``: calls whose first or only arguments are literals."""
        callee = self.tokens[i].text
        if self._kind(i + 2) == "text" and self._at(i + 3, ","):
            found = self.expression(self._skip_lines(i + 4))
            return (self.tokens[i + 2].value, found) if found and self._at(self._skip_lines(found[3]), ")", ",") else None
        last = re.split(r"\.|::|->", callee)[-1]
        name = SETTER.sub("", last)
        if name != last or SENSITIVE.get(last.lower(), 0) == 1:
            found = self.expression(i + 2)
            if found and self._at(self._skip_lines(found[3]), ")"):
                return name, found
        return None

    def _assigned(self, first: int, op: int):
        """For an assignment ((name, value, start, end, propagated), next token), for each of several names; None where it gives none."""
        sign, names = self.tokens[op].text, self._target(first, op)
        if not any(names):
            return
        words = list(map(str.lower, WORDS.findall(names[-1] or "")))
        line = self.text[self.tokens[self.line].start : self.tokens[op].start].strip(" \t\"'-") if op - self.line <= 4 else None
        config = sign == ":" or line in (names[-1], f"export {names[-1]}") and self.text[self.tokens[op].start - 1] not in " \t"
        phrase = "passphrase" in words and line in (names[-1], f"export {names[-1]}")
        i = op + 1
        for no, name in enumerate(names if len(names) > 1 else names[-1:]):
            if no:
                if not self._at(i, ","):
                    return
                i += 1
            found = self.expression(i)
            quoted = found is not None
            if not found:
                found = self._bare(i, phrase, "config" if config else "code")
                if found and sign == ":" and self._at(found[3], "="):
                    return  # ``name: type = ...``
            if not found:
                yield None
                while i < len(self.tokens) and len(names) > 1 and self.tokens[i].kind != "line" and not self._at(i, ",", ";"):
                    i += 1
                continue
            i = found[3]
            if name:
                for pair in self._give([name], found, sign, quoted):
                    yield pair, i

    def _give(self, names: list[str], found: tuple, sign: str, quoted: bool = True):
        value, start, end, _, used = found
        for name in names:
            if sign == "+=" and quoted:
                have = self.known.setdefault(name, Grown(""))
                used |= bool(have.parts[0])
                have.parts.append(value)
                if not name_score(name):
                    continue  # nobody asks for it here
                value = have.text()
            elif quoted and sign != "(":
                self.known[name] = Grown(value)
            yield name, value, start, end, used

    def _tags(self):
        """Names and values of XML elements, and of tags with a key and a value."""
        for m in TAG.finditer(self.text):
            given = {a[1].lower(): (a[2] if a[2] is not None else a[3], a.start(2) if a[2] is not None else a.start(3)) for a in ATTRIBUTE.finditer(self.text, m.start(2), m.end(2))}
            key = next((given[k][0] for k in ("key", "name") if k in given), None)
            if key and "value" in given:
                value, at = given["value"]
                yield key, value, at, at + len(value), False
            if m[3] == ">" and (c := CONTENT.match(self.text, m.end())) and c[1] and self.text.startswith(m[1], c.end()):
                yield key or m[1], c[1], c.start(1), c.end(1), False

    def _logins(self):
        for m in LOGIN.finditer(self.text):
            yield "password", m[2], m.start(2), m.end(2), False


def pairs(text: str):
    """All (name, value, start, end, propagated) of a text. A name's latest
    value is put in where a later expression uses it."""
    return Lexed(text).pairs()


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    best = max([SENSITIVE.get(w, 0.0) for w in words] + [PHRASES.get(p, 0.0) for p in zip(words, words[1:])] + [SENSITIVE.get("".join(words), 0.0)], default=0.0)
    return best * (0.4 if words and words[-1] in HARMLESS or "public" in words or "max" in words else 1.0)


def literal_score(value: str, phrase: bool = False, min_length: int = 4) -> float:
    """0 for placeholders, prose and literals of fewer than ``min_length`` characters, near 1 for long strings of high entropy. ``phrase``: several
    words may be a secret, if they are 12 characters or more and don't ask for one."""
    if KNOWN.match(value):
        return 1.0
    n = len(value)
    if n < min_length or PLACEHOLDER.match(value):
        return 0.0
    if any(c.isspace() for c in value) and not (phrase and n >= 12 and not PROMPT.search(value)):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = any(c.isdigit() for c in value) + any(c.isupper() for c in value) + any(c.islower() for c in value) + any(not c.isalnum() for c in value)
    return min(1.0, 0.35 * min(1, entropy / 3.5) + 0.3 * min(1, n / 20) + 0.12 * mixed)


def findings(text: str, threshold: float, min_length: int = 4):
    """(name, start, end, score, redacted, sha256, propagated), one for each place, in order; of several names for a place the most telling."""
    best: dict[tuple[int, int], tuple] = {}
    for name, value, start, end, used in pairs(text):
        s = name_score(name)
        if not s and not KNOWN.match(value):
            continue
        value = value[m.end() :].rstrip() if (m := SCHEME.match(value)) else value
        if LOGIN.search(value):
            continue  # its password has a finding of its own
        like = literal_score(value, not PHRASE_NAMES.isdisjoint(map(str.lower, WORDS.findall(name))), min_length)
        s = max(s, 0.6) if KNOWN.match(value) else s  # a known form tells what it is under any name
        if (score := round(0.5 * s + 0.5 * like, 4)) >= threshold and like >= 0.3:
            shown = value[:3] + "*" * min(8, max(0, len(value) - 3))
            found = (name, start, end, score, shown, hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest(), used)
            if (start, end) not in best or best[start, end][3] < score:
                best[start, end] = found
    # a place inside another one that is found is the same secret
    out: list[tuple] = []
    ends: list[int] = []
    for found in sorted(best.values(), key=lambda f: (f[1], -f[2])):
        if not ends or found[2] > ends[-1]:
            out.append(found)
            ends.append(found[2])
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, min_length: int = 4) -> DataFrame:
    """One row for each literal that is assigned to a sensitive name:
    ``doc_id, name, start, end, score, redacted, literal_sha256, propagated``.

    Texts are lexed into literals, names, operators and lines, and read by statements: assignments (``=``, ``:=``,
    ``=>``, ``+=``, ``:``) to plain, quoted, subscripted, dotted and typed names, or to several names at once; ``#define``; calls that
    set (``define("NAME", ...)``, ``setName(...)``); XML elements and attributes; passwords in URLs. Values are strings of all
    common quotes, joined by ``+``, adjacency or ``join``, also on later lines, with ``${name}`` holes, and bare words of configuration syntax.
    The scheme of an Authorization header (Bearer, Basic, Token) isn't part of the secret; literals
    of several words count for passphrases and passwords; keys of a known form count under any name.
    Names whose value is known are put in where later expressions use them. The score is the
    mean of how telling the name is and how much the literal looks like a secret; literals of fewer than ``min_length`` characters don't.
    ``start`` and ``end`` are character offsets of the expression; the literal itself is never
    returned, only three characters and its SHA-256.

    Whole texts are lexed, in time in proportion to their length; those that hold no word of a sensitive name, no login in a URL and no known
    form can hold no secret and stay in the JVM. NULL and empty texts give no rows; ids are whole numbers, NULL ids are returned as they
    are; rows that repeat are reported again; other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(HINT))

    def scan(batches):
        for batch in batches:
            rows = [(d, *f) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for f in findings(t, threshold, min_length)]
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
            names = ["doc_id", "name", "start", "end", "score", "redacted", "literal_sha256", "propagated"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return base.mapInArrow(scan, SCHEMA)


def op7_secret_scan(spark, sf_dir) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
