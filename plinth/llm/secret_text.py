"""Finding credential literals in one file: decoding, literals with their place, and what they look like."""

from __future__ import annotations

import base64
import binascii
import bisect
import itertools
import math
import re
from collections import Counter
from typing import NamedTuple

import ahocorasick


class Literal(NamedTuple):
    value: str  # joined over continued lines
    line: int  # from 1, lines end at LF
    start: int  # character offsets of the first piece
    end: int
    kind: str  # how it was found
    structured: bool  # looks like a secret by itself
    parts: tuple  # further (start, end) pieces on following lines


def decode(content: bytes) -> tuple[str, str, bytes]:
    """(text, codec, byte-order mark) such that ``mark + text.encode(codec)`` is ``content``."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            try:
                return content[len(mark) :].decode(codec), codec, mark
            except UnicodeDecodeError:
                break
    try:
        return content.decode("utf-8"), "utf-8", b""
    except UnicodeDecodeError:
        return content.decode("latin-1"), "latin-1", b""


#: Name parts of passwords (any literal may be one) and of tokens (literals with a digit).
_PASSWORD = r"pw|pass(?:word|wd|phrase|code|wort|e)?s?\d*|pwd|kennwort|contrase(?:n|ñ|Ã±)a|wachtwoord|heslo|senha"
_TOKEN = r"secret|token|api[_\-.]?key|apikey|access[_\-.]?key|(?:service|signing|private|secret|auth|encryption|account|storage)[_\-.]?key|authtoken|bearer|cred(?:ential)?s?|authori[sz]ation|auth"
_HIT = re.compile(rf"(?i)(?:{_PASSWORD}|{_TOKEN})")
def _words() -> ahocorasick.Automaton:
    """Lower-case words one of which is in every name above, and the signs of addresses and key blocks."""
    words = ["pw", "pass", "kennwort", "contrase", "wachtwoord", "heslo", "senha", "secret", "token", "bearer", "cred", "auth", "://", "?", "&", "-----begin", "authorization"]
    words += [a + sep + "key" for a in ("api", "access", "service", "signing", "private", "auth", "encryption", "account", "storage") for sep in ("", "_", "-", ".")]
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, len(w) - 1)
    found.make_automaton()
    return found


#: A short literal at the end of a line that goes on with another literal on the next line.
_GOES_ON = re.compile(r"[\"'`][ \t]*[+,.\\]?[ \t]*\r?\n[ \t]*[+.&]?[ \t]*[\"'`]")
_AUTOMATON = None


def _marks(text: str) -> list[int]:
    """Places that make a line worth reading: a name, a long token, an address or a block of a key."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _words()
    low = text.lower()
    if len(low) != len(text):  # a few letters change length
        low = "".join(ch.lower() if len(ch.lower()) == 1 else ch for ch in text)
    marks = {end - back for end, back in _AUTOMATON.iter(low)}
    marks.update(m.start() for m in _TOKENS.finditer(text))
    marks.update(m.start() for m in _GOES_ON.finditer(text))
    return sorted(marks)


_SPLIT = re.compile(r"[\"'`](?P<v>[A-Za-z0-9+/_.~\-]{6,15})[\"'`]\s*[+,.\\]?\s*$")
_IS_PASSWORD = re.compile(rf"(?i)(?:^|[_\-.]|(?<=[a-z])(?=[A-Z])|pg|db|smtp|ftp|user|my|root)(?:{_PASSWORD})$")
_IS_TOKEN = re.compile(rf"(?i)(?:^|[_\-.]|x|client|session|refresh|access|auth|my|api|proxy)(?:{_TOKEN})(?:[_\-.]?key)?$")
_CAMEL_PASSWORD = re.compile(r"[a-z](?:Pass(?:word|wd|phrase)?|Pwd)$")
_CAMEL_TOKEN = re.compile(r"[a-z](?:Secret|Token|Key|Credentials?|Auth)$")
#: Names whose values are ids, checksums and the like.
_BENIGN = re.compile(r"(?i)(?:commit|integrity|build[_\-]?id|sha\d*|digest|checksum|crc\d*|md5|hash|rev|revision|etag|uuid|guid|version|fingerprint|public[_\-]?key|pubkey|resolved|trace[_\-]?id|request[_\-]?id|object[_\-]?id|tree|parent|blob|ssh-(?:rsa|ed25519|dss))[\w\-]*[\"'`\])]*\s*(?::\s*&?\s*(?:'static\s+)?(?:const\s+)?\w+\s*=|:=|=>|[:=,|>]|is|was|\s)*\s*[\"'`]?(?:sha\d+[:\-])?[\"'`]?$")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.\-_#?•]+|<.*>|\$.*|\{\{.*\}\}|\{%.*|%\w+%|%\(\w+\)s|#\{.*|@\w+@|\[.*\]|(?:replace|change|insert|fill|put|enter)[\s_\-]?.*(?:me|here|this|it)?|to[\s_\-]?do.*|tbd|your[\s_\-].*|my[_\-]?(?:password|secret|token)|"
    r"(?:none|null|nil|true|false|yes|no|empty|unset|optional|required|redacted|masked|hidden|dummy|example|sample|placeholder|default|undefined|string|str|text|bytes|int|bool|boolean|object|any|password|passwd|secret|token|credential|api[_\-]?key|bearer|basic))[;,.]?$|(?:vault|env|os\.environ|process\.env|secrets?|ssm|keyring|config)[.:/\[(]|getenv|getpass|\(\)$|^!vault|^ENC\["
)
_CALL = re.compile(r"^[A-Za-z_][\w.:]*[(\[]")
_UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\}?$")
_HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]{16,}$")
_JWT = re.compile(r"^eyJ[\w\-]{6,}\.[\w\-]{6,}\.[\w\-]{6,}={0,2}$")
_PREFIX = re.compile(r"^[A-Za-z]{2,6}(?:[_\-][a-z]{2,6})?[_\-][A-Za-z0-9][\w\-]{14,}$")
_UPPER_ID = re.compile(r"^[A-Z0-9]{16,24}$")
_MIXED = re.compile(r"^[A-Za-z0-9+/_.~\-]{18,}={0,2}$")
_URL = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]{1,20}://[^\s:/@'\"`<>]*:(?P<a>[^\s@/'\"`<>]+)@[\w.\-]+|[?&](?:sig|signature|token|access_token|auth|key|apikey|api_key|secret|password|pwd|pass|x-amz-signature)=(?P<b>[\w%+/.~\-=]{8,})")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BEGIN = re.compile(r"-----BEGIN(?: (?P<label>[A-Z0-9 ]+)-----)?")
_PEM_BREAK = re.compile(r"\\[rn]|\r?\n")
#: Quotes, comment signs and operators around the lines of a block; then a line of any kind, and one of base64.
_PEM_AROUND = " \t\r\"'`#/*;<>|+.,()\\-"
_PEM_LINE = re.compile(r"(?:[A-Za-z0-9+/=_\-]+(?: +[A-Za-z0-9+/=]{16,})*|[A-Z][A-Za-z\-]+: [^\"'`]*)?")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}(?: +[A-Za-z0-9+/=]+)*")
_TOKENS = re.compile(r"[A-Za-z0-9+/_.~\-]{16,}={0,2}")
_LONE = re.compile(r"^\s*(?:[+.&]\s*|\|\|\s*)?[rbuRBU]?([\"'`])(?P<v>(?:(?!\1).)+)\1\s*[;),+\\\]}]*\s*$")
_AFTER = re.compile(
    r"[\"'`\])}]*\s*"
    r"(?:(?:\w+\s*=\s*)?[\"'`]?\s*><(?P<tag>\w+)>|/?\s*>|(?:,\s*)?\.?(?:val(?:ue)?|content|text)\s*[=:]|:\s*&?\s*(?:'static\s+)?(?:const\s+)?(?:mut\s+)?(?:str|String|string|char|text|bytes)\b[^=\n]{0,12}=|\[\]\s*=|\*?\s*:=|=>|==?|->|:|\||,|(?:on\s+\S+\s+)?(?:is|was)\b|set\s+to\b|IDENTIFIED\s+BY\b)?"
    r"\s*(?:[\"'`]\s*,?\s*)?(?P<rest>.*)$",
    re.IGNORECASE,
)
_QUOTED = re.compile(r"(?:concat!\(|Some\(|String::from\(|b?\(|\{|\[)*\s*[rbfuRBFU@$]{0,2}(?P<q>\"\"\"|'''|[\"'`])(?P<v>.*)$")
_BARE = re.compile(r"(?P<v>[^\s\"'`<>;,|]+)")
_PHRASE = re.compile(r"(?P<v>[A-Za-z0-9_]+(?: [A-Za-z0-9_]+){2,}?)(?=\s*(?:$|[\"'`<|;,)}\]]|for now\b|\(|\*/|-->))")
_SCHEME = re.compile(r"(?i)(?:Bearer|Basic|Token|Digest)\s+")
#: File types in which an unquoted word after a name is a value, not a type or variable.
_PLAIN_TYPES = re.compile(r"(?i)(?:\.(?:ya?ml|properties|toml|ini|env|conf|cfg|config|sh|bash|zsh|mk|tf|tfvars|md|rst|txt|xml|netrc|npmrc|pypirc|service|plist|html?|sql)|(?:^|/)(?:Makefile|Dockerfile|README|\.[a-z]+rc|VERSION|[^./]+))$")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def structured(v: str) -> bool:
    """Whether a literal looks like a credential by itself: form, character classes and entropy."""
    v = _SCHEME.sub("", v, 1) if v[:1] in "BbTtDd" else v
    if len(v) < 16 or _UUID.match(v) or v.startswith(("sha256", "sha1", "sha512", "md5")):
        return False
    if _JWT.match(v):
        return True
    digits = sum(ch.isdigit() for ch in v)
    if _HEX.match(v):
        return digits >= 3 and digits < len(v) and entropy(v) > 2.5
    upper, lower = any(ch.isupper() for ch in v), any(ch.islower() for ch in v)
    if _UPPER_ID.match(v):
        return digits >= 2 and upper and entropy(v) > 3.0
    if not (_MIXED.match(v) or _PREFIX.match(v)):
        return False
    if v.count("/") > 1 and re.fullmatch(r"[\w.\-]+(?:/[\w.\-]+)+", v) and not (upper and lower and digits > 3):
        return False  # a path
    return upper and lower and (digits >= 1 or _PREFIX.match(v) is not None and v.count("_") + v.count("-") >= 2 and not v.replace("_", "-").islower() and _run_of_mixed(v)) and entropy(v) > 3.4


def _run_of_mixed(v: str) -> bool:
    """Whether the last part changes case the way random text does, not at word starts."""
    last = re.split(r"[_\-]", v)[-1]
    return len(last) >= 16 and len(re.findall(r"[A-Z]{2}", last)) >= 2


def encoded(v: str) -> str | None:
    """The text a base64 literal holds, if it is one of printable ASCII."""
    if len(v) < 12 or not re.fullmatch(r"[A-Za-z0-9+/_\-]+={0,2}", v):
        return None
    try:
        raw = base64.b64decode(v + "=" * (-len(v) % 4), altchars=b"-_" if "-" in v or "_" in v else None, validate=True)
    except (binascii.Error, ValueError):
        return None
    return raw.decode("ascii") if len(raw) >= 8 and all(32 <= c < 127 or c in (9, 10, 13) for c in raw) else None


def placeholder(v: str) -> bool:
    v = _SCHEME.sub("", v.strip(), 1)
    return not v or _PLACEHOLDER.search(v) is not None or len(set(v)) <= 2


def _close(rest: str, quote: str) -> int:
    """Index of the closing quote, honouring backslashes; -1 if there is none."""
    k = 0
    while True:
        k = rest.find(quote, k)
        if k < 0:
            return -1
        back = 0
        while k - back - 1 >= 0 and rest[k - back - 1] == "\\":
            back += 1
        if back % 2 == 0:
            return k
        k += 1


def _block(text: str, begin: re.Match, line_end: int) -> int:
    """End of the key or certificate block that begins here; the end of its marker if none does.

    A block is closed by the END of its own label with nothing but its lines between; a block cut off
    goes on for its base64 lines.
    """
    if not begin["label"]:
        return begin.end()
    close = text.find(f"-----END {begin['label']}-----", begin.end())
    if close >= 0 and text.find("-----BEGIN", begin.end(), close) < 0 and all(_PEM_LINE.fullmatch(x.strip(_PEM_AROUND)) for x in _PEM_BREAK.split(text[begin.end() : close])):
        return close + len(begin["label"]) + 14
    stop = begin.end()
    rest = re.sub(r"\\[rn]", "  ", text[stop:line_end])
    if _PEM_BODY.match(rest.strip(_PEM_AROUND)):
        stop += re.match(r"[^A-Za-z0-9]*[A-Za-z0-9+/=]+(?: +[A-Za-z0-9+/=]+)*", rest).end()
        if stop < line_end and text[stop:line_end].strip(_PEM_AROUND):
            return stop
    elif ")" in rest or rest.strip(_PEM_AROUND):
        return stop
    at = line_end + 1
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = re.sub(r"\\[rn]", " ", text[at:end]).strip(_PEM_AROUND)
        if _PEM_BODY.fullmatch(line) or (end == len(text) and re.fullmatch(r"[A-Za-z0-9+/=]+", line)):
            stop = end
        elif line and not re.fullmatch(r"[A-Z][A-Za-z\-]+: .*", line):
            break
        at = end + 1
    return stop


def literals(text: str, location: str | None) -> list[Literal]:
    """All literals of a text that may be credentials, in order; at most one per place.

    Private key blocks are one literal, from their first line to their end.
    """
    plain_type = _PLAIN_TYPES.search(location or "x") is not None
    out: list[Literal] = []
    marks = _marks(text)
    if not marks:
        return out
    lines = text.split("\n")
    offsets = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
    skip_to = 0  # character offset up to which text belongs to a literal found before
    last = -1
    for mark in marks:
        k = bisect.bisect_right(offsets, mark) - 1
        if k == last or mark < skip_to:
            continue
        last = k
        line, base = lines[k], offsets[k]
        block = (base, base)
        if "-----BEGIN" in line:
            begin = _PEM_BEGIN.search(text, base)
            pem = _PEM.match(text, begin.start())
            stop = _block(text, begin, base + len(line))
            block = (begin.start(), stop)
            cut_off = pem and not text[pem.end() :].strip()
            if pem and (cut_off or stop == len(text) > pem.end() or re.search(r"[A-Za-z0-9+/=]{16}", text[pem.end() : stop])):
                stop = len(text) if cut_off else stop
                out.append(Literal(text[begin.start() : stop], k + 1, begin.start(), stop, "private key", True, ()))
            if stop > base + len(line):
                skip_to = stop
                continue
        for value, start, end, kind, form, pieces in _in_line(line, plain_type, lines, k):
            parts = tuple((offsets[k + d] + a, offsets[k + d] + b) for d, a, b in pieces)
            s, e, at = base + start, base + end, k
            if start < 0:  # the value begins on a later line
                (s, e), parts, at = parts[0], parts[1:], k + pieces[0][0]
            if s < skip_to or (s < block[1] and e > block[0]):
                continue
            out.append(Literal(value, at + 1, s, e, kind, form, parts))
            skip_to = max(skip_to, parts[-1][1] if parts else e)
    return out


def _continued(value: str, lines: list[str], k: int, tail: str) -> tuple[str, list]:
    """Further string pieces on the following lines, when the literal does not end on its own."""
    pieces: list = []
    t = tail.strip()
    if t.endswith((";", "}", "]")) or (t.endswith(")") and not t.endswith("()")):
        return value, pieces
    d = 1
    values = [value]
    while k + d < len(lines):
        m = _LONE.match(lines[k + d])
        if not m:
            break
        pieces.append((d, m.start("v"), m.end("v")))
        values.append(m["v"])
        if lines[k + d].rstrip().endswith((";", ")", "}", "]")):
            break
        d += 1
    return "".join(values), pieces


def _in_line(line: str, plain_type: bool, lines: list[str], k: int) -> list:
    """(value, start, end, kind, structured, pieces) of one line; start -1: the value is on a later line."""
    got: list = []
    taken: list[tuple[int, int]] = []

    def add(value, start, end, kind, form, pieces=()):
        if any(a < end and start < b for a, b in taken):
            return
        taken.append((start, end))
        got.append((value, start, end, kind, form, list(pieces)))

    if "://" in line or "?" in line or "&" in line:
        for m in _URL.finditer(line):
            g = "a" if m["a"] is not None else "b"
            if not placeholder(m[g]) and not (g == "b" and m[g].isalpha() and m[g].islower()):
                add(m[g], m.start(g), m.end(g), "url", True)
    done = -1
    for h in _HIT.finditer(line):
        if h.start() < done:
            continue
        a, b = h.start(), h.end()
        while a > 0 and (line[a - 1].isalnum() or line[a - 1] in "_-."):
            a -= 1
        while b < len(line) and (line[b].isalnum() or line[b] in "_-"):
            b += 1
        name = line[a:b].strip("-._")
        done = b
        is_password = _IS_PASSWORD.search(name) is not None or _CAMEL_PASSWORD.search(name) is not None
        is_token = _IS_TOKEN.search(name) is not None or _CAMEL_TOKEN.search(name) is not None
        if not (is_password or is_token) or (line[b : b + 1] == "(" and not line[b + 1 : b + 2] in "\"'`"):
            continue
        got_one = _value_after(line, b, is_password, plain_type, lines, k)
        if got_one:
            add(*got_one)
    short = _SPLIT.search(line)
    if short and k + 1 < len(lines) and not any(a < short.end() and short.start() < b for a, b in taken):
        v, pieces = _continued(short["v"], lines, k, "")
        if pieces and structured(v) and not _BENIGN.search(line[: short.start("v")]):
            add(v, short.start("v"), short.end("v"), "token", True, pieces)
    for m in _TOKENS.finditer(line):
        v = m.group()
        if any(a < m.end() and m.start() < b for a, b in taken):
            continue
        tail = line[m.end() :]
        pieces: list = []
        if tail[:1] in "\"'`" and tail and not structured(v) or (tail[:1] in "\"'`" and tail and len(tail.strip()) <= 3):
            v, pieces = _continued(v, lines, k, tail[1:])
        if not structured(v):
            eq = v.find("=")
            if 0 < eq < len(v) - 3 and structured(v[eq + 1 :]):
                v = v[eq + 1 :]
            else:
                continue
        start = line.index(v[: m.end() - m.start()], m.start()) if not pieces else m.start()
        before = line[:start]
        if _BENIGN.search(before) or before.rstrip("\"'` ").endswith(("sha256:", "sha256-", "sha1:", "sha512:", "sha512-", "md5:")):
            continue
        if _bare_block(lines, k):
            continue
        hexa = _HEX.match(v) is not None
        if hexa and not re.search(r"[=:,>|\"'`(]\s*[\"'`]?$|(?:\bis|\bwas|->|set to `)\s*$|^\s*(?:>-?)?\s*$|\w\s+$", before):
            continue
        if hexa and re.search(r"(?i)\b(?:at|hash|commit|merge|revert|from|see|since)\s+$", before):
            continue
        if re.search(r"[=:,>|\"'`(\s\[{]$|^$", before) or before.endswith(("Bearer ", "Basic ")):
            add(v, start, m.end(), "token", True, pieces)
    return got


def _bare_block(lines: list[str], k: int) -> bool:
    """A line of nothing but base64 beside another one: the body of some encoded block."""
    body = re.compile(r"^[\s#/*\-;!<>\"']*[A-Za-z0-9+/]{40,}={0,2}[\s\"',\\]*$")
    if not body.match(lines[k]):
        return False
    return any(0 <= j < len(lines) and (body.match(lines[j]) or "-----" in lines[j]) for j in (k - 1, k + 1))


def _value_after(line: str, b: int, is_password: bool, plain_type: bool, lines: list[str], k: int):
    """The value that follows a name ending at ``b``."""
    m = _AFTER.match(line, b)
    if not m:
        return None
    rest, at = m["rest"], m.start("rest")
    sep = line[b:at]
    if not sep.strip() and not rest:
        return None
    bare_sep = sep.strip(" \"'`])}")
    if re.fullmatch(r"[|>][+\-]?\s*", rest):
        d = 1
        if k + d < len(lines):
            v = lines[k + d].strip()
            if v and not placeholder(v) and len(v) >= 4:
                a = lines[k + d].index(v)
                return v, -1, -1, "password" if is_password else "token", structured(v), [(d, a, a + len(v))]
        return None
    if rest[:1] in "|>" and re.match(r"[|>][+\-]?$", rest.strip()):
        return None
    q = _QUOTED.match(rest)
    if not (q and q.start("v") > 0) and sep and sep.rstrip()[-1:] in "\"'`" and (bare_sep or re.search(r"\s[\"'`]$", sep)):
        # The separator ended inside an opening quote.
        quote = sep.rstrip()[-1]
        end = _close(rest, quote)
        value = rest[: end if end >= 0 else len(rest)]
        return _accept(value, at, is_password, plain_type, True, rest[end + 1 :] if end >= 0 else "", lines, k)
    if q:
        quote = q["q"]
        inner = q["v"]
        end = _close(inner, quote)
        value = inner[: end if end >= 0 else len(inner)]
        tail = inner[end + len(quote) :] if end >= 0 else ""
        return _accept(value, at + q.start("v"), is_password, plain_type, True, tail, lines, k)
    name_at = re.search(r"[\w.\-]*$", line[:b]).start()
    around = line[name_at - 1 : name_at] if name_at else ""
    if bare_sep in ("=", ":") and around in ("\"", "'", "`") and around:
        end = _close(rest, around)  # name=value inside one string
        if end > 0:
            return _accept(rest[:end], at, is_password, plain_type, True, rest[end + 1 :], lines, k)
    spring = line[max(0, name_at - 2) : name_at] == "${" and "}" in rest
    if spring and bare_sep == ":":
        return _accept(rest[: rest.index("}")], at, is_password, plain_type, True, ")", lines, k)
    scheme = _SCHEME.match(rest)
    skip = scheme.end() if scheme else 0
    body = rest[skip:]
    if _CALL.match(body):
        return None
    noted = re.search(r"(?i)(?:--[\w\-]+|todo\s+remove\s+\S+|temporary:?\s+\S+|old\s+\S+|echo\s+[\"']\S+)$", line[:b]) is not None
    if not bare_sep and sep.strip(" ") == "" and sep and not noted and not re.search(r"(?i)(?:--[\w\-]*|todo\b.*|temporary\b.*|remove\b.*|old\b.*|echo\s+[\"'].*|login\b.*|password\s+|^\s*[#/;\-*]+.*)$", line[:b]):
        return None  # a name followed by a word: prose
    phrase = _PHRASE.match(body) if is_password else None
    if phrase and (plain_type or noted or bare_sep in ("is", "was", "->", "|") or bare_sep.endswith(("is", "was"))) and len(phrase["v"].split()) <= 8:
        v = re.sub(r" for now$", "", phrase["v"])
        if bare_sep or noted:
            return _accept(v, at + skip, is_password, plain_type, True, "", lines, k)
    w = _BARE.match(body)
    if not w:
        return None
    value = w["v"]
    value = value.rstrip(".,;:)}]") if not structured(value) else value
    if bare_sep.endswith(("is", "was")) or bare_sep == "" or bare_sep in ("->", "|"):
        quoted = True
        if value.isalpha() and value.islower() and bare_sep not in ("|", "->") and not noted and not re.match(r" for now\b", line[at + skip + len(value) :]):
            return None  # "the token is read by ..."
        if bare_sep in ("|",) and "|" not in body:
            return None
    else:
        quoted = plain_type or line.lstrip().startswith(("#", "//", "/*", "*", "--", "<!--", ";"))
    if line[at + skip + len(value) : at + skip + len(value) + 1] in ("\"", "'", "`", "<"):
        quoted = True
    return _accept(value, at + skip, is_password, plain_type, quoted, "", lines, k)


def _accept(value: str, start: int, is_password: bool, plain_type: bool, quoted: bool, tail: str, lines: list[str], k: int):
    whole, pieces = _continued(value, lines, k, tail) if tail is not None and (tail.strip() in ("", "+", ",", ".", "\\", "&", "||", ")")) and tail.strip() != ")" and value else (value, [])
    if placeholder(whole) or len(whole) < 4 or _CALL.match(whole) and not structured(whole):
        return None
    inner = _SCHEME.sub("", whole, 1)
    if _UUID.match(inner):
        return None
    skip = len(whole) - len(inner) if whole.endswith(inner) and value.startswith(whole[: len(whole) - len(inner)]) else 0
    form = structured(inner) or encoded(inner) is not None
    u = _URL.search(whole)
    if u:
        return None  # the part that is secret was taken already, or it is a placeholder
    if "://" in whole or whole.startswith("-----BEGIN"):
        return None
    if is_password:
        if not quoted and not form:
            return None
        if whole.isdigit() and len(whole) < 6:
            return None
        return whole, start, start + len(value), "password", form, pieces
    if form or (quoted and len(inner) >= 8 and any(ch.isdigit() for ch in inner) and " " not in inner and not re.fullmatch(r"[a-z]+[_\-]?\d{1,4}", inner)):
        return inner, start + skip, start + len(value), "token", form, pieces
    return None
