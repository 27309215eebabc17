"""The detectors, in the order in which they are tried."""

from __future__ import annotations

import base64
import binascii
import json
import re
from typing import Any
from urllib.parse import parse_qsl, unquote_plus, urlsplit
from xml.sax.saxutils import unescape

from cairnlog.operators.embedded.model import MAX_DEPTH, Detection, Detector, Number, Pairs, balanced_end, find_top, quoted_end, scalar, split_top, strict_json, unquote


def detect_json(text: str) -> list[Detection]:
    """Balanced braces or brackets that are strictly JSON; the outermost ones."""
    out, i = [], 0
    while (m := re.compile(r"[{\[]").search(text, i)) is not None:
        i = m.start()
        end = balanced_end(text, i, quotes='"', brackets="{[")
        if end is not None:
            try:
                out.append(Detection("json", i, end, strict_json(text[i:end]), text[i:end]))
                i = end
                continue
            except (ValueError, RecursionError):
                pass
        i += 1
    return out


_TAG = re.compile(r"\s*<(/?)([a-z]+)(\s[^>]*?)?(/?)>")


class _Xml:
    """The property list subset of XML."""

    def __init__(self, text: str, at: int) -> None:
        self.text, self.at = text, at

    def tag(self) -> tuple[str, bool, bool]:
        m = _TAG.match(self.text, self.at)
        if not m:
            raise ValueError("no tag")
        self.at = m.end()
        return m[2], bool(m[1]), bool(m[4])

    def content(self, name: str) -> str:
        end = self.text.find(f"</{name}>", self.at)
        if end < 0:
            raise ValueError("not closed")
        raw, self.at = self.text[self.at : end], end + len(name) + 3
        out, i = [], 0
        while i < len(raw):
            if raw.startswith("<![CDATA[", i):
                j = raw.index("]]>", i)
                out.append(raw[i + 9 : j])
                i = j + 3
                continue
            j = raw.find("<![CDATA[", i)
            j = len(raw) if j < 0 else j
            part = unescape(raw[i:j], {"&quot;": '"', "&apos;": "'"})
            out.append(re.sub(r"&#(x?)([0-9a-fA-F]+);", lambda m: chr(int(m[2], 16 if m[1] else 10)), part))
            i = j
        return "".join(out)

    def value(self, depth: int = 0) -> Any:
        name, closing, empty = self.tag()
        if closing or depth > MAX_DEPTH:
            raise ValueError("unexpected end")
        if name in ("true", "false"):
            if not empty:
                self.tag()
            return name == "true"
        if name in ("dict", "array"):
            out: list = Pairs() if name == "dict" else []
            while not empty:
                back = self.at
                inner, end, _ = self.tag()
                if end:
                    if inner != name:
                        raise ValueError("crossed tags")
                    break
                if name == "dict":
                    if inner != "key":
                        raise ValueError("no key")
                    key = self.content("key")
                    out.append((key, self.value(depth + 1)))
                else:
                    self.at = back
                    out.append(self.value(depth + 1))
            return out
        if name in ("string", "integer", "real", "date", "data", "uid"):
            text = "" if empty else self.content(name)
            return Number(text.strip()) if name in ("integer", "real") else "".join(text.split()) if name == "data" else text
        raise ValueError(name)


def _open_step(text: str, depth: int = 0) -> Any:
    """`{ key = value; }`, `( a, b )`, quoted and bare words."""
    t = text.strip()
    if depth > MAX_DEPTH:
        raise ValueError("too deep")
    if t.startswith("{") and balanced_end(t, 0) == len(t):
        out = Pairs()
        for part in split_top(t[1:-1], ";"):
            if part.strip():
                at = find_top(part, "=")
                if at < 0:
                    raise ValueError("no pair")
                out.append((unquote(part[:at].strip()), _open_step(part[at + 1 :], depth + 1)))
        return out
    if t.startswith("(") and balanced_end(t, 0) == len(t):
        return [_open_step(p, depth + 1) for p in split_top(t[1:-1], ",") if p.strip()]
    if t in ("YES", "NO"):
        return t == "YES"
    if not t or (t[0] not in "\"'" and re.search(r"[{}();=]", t)):
        raise ValueError("no word")
    return scalar(t)


def detect_plist(text: str) -> list[Detection]:
    out = []
    for m in re.finditer(r"(?:<\?xml[^>]*\?>\s*)?(?:<!DOCTYPE plist[^>]*>\s*)?<plist(?:\s[^>]*)?>", text):
        x = _Xml(text, m.end())
        try:
            v = x.value()
            if x.tag() == ("plist", True, False):
                out.append(Detection("plist", m.start(), x.at, v, text[m.start() : x.at]))
        except (ValueError, RecursionError):
            continue
    for m in re.finditer(r"\b(?:plist|propertyList)\s*[=:]\s*(?=[{(])", text):
        end = balanced_end(text, m.end())
        if end:
            try:
                out.append(Detection("plist", m.end(), end, _open_step(text[m.end() : end]), text[m.end() : end]))
            except (ValueError, RecursionError):
                continue
    for m in re.finditer(r"bplist00[^\s\"']*|\b62706c6973743030[0-9a-fA-F]*\b|\bYnBsaXN0MD[A-Za-z0-9+/]*=*", text):
        encoding = "literal" if m[0].startswith("bplist") else "hex" if m[0][0] == "6" else "base64"
        out.append(Detection("binary-plist", m.start(), m.end(), Pairs([("encoding", encoding), ("characters", Number(str(len(m[0]))))]), m[0]))
    return out


def _about(name: str, raw: str, size: int) -> Pairs:
    return Pairs([("encoding", name), ("characters", Number(str(len(raw)))), ("decoded_bytes", Number(str(size)))])


def detect_encoded(text: str) -> list[Detection]:
    """PEM blocks, JSON web tokens, long hex and base64 words: what they are and how long, not their content."""
    out = []
    for m in re.finditer(r"-----BEGIN ([A-Z0-9 ]+)-----\s+([A-Za-z0-9+/=\s]+?)-----END \1-----", text):
        out.append(Detection("pem", m.start(), m.end(), Pairs([("label", m[1]), *_about("pem", m[0], len("".join(m[2].split())) * 3 // 4)]), m[0]))
    for m in re.finditer(r"(?<![\w.+/=-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?![\w.+/=-])", text):
        try:
            head = m[0].split(".")[0]
            if isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict):
                out.append(Detection("jwt", m.start(), m.end(), _about("jwt", m[0], len(m[0]) * 3 // 4), m[0]))
        except (ValueError, binascii.Error):
            continue
    for m in re.finditer(r"(?<![\w+/=.-])[A-Za-z0-9+/]{16,}={0,2}(?![\w+/=-])", text):
        t = m[0]
        if re.fullmatch(r"[0-9a-fA-F]+", t) and len(t) % 2 == 0 and re.search(r"\d", t) and re.search(r"[a-fA-F]", t):
            out.append(Detection("hex", m.start(), m.end(), _about("hex", t, len(t) // 2), t))
        elif len(t) >= 24 and len(t) % 4 == 0 and re.search(r"[a-z]", t) and re.search(r"[A-Z]", t) and (t.endswith("=") or re.search(r"[0-9+/]", t)):
            out.append(Detection("base64", m.start(), m.end(), _about("base64", t, len(t) * 3 // 4 - t.count("=")), t))
    return out


_START_LINE = re.compile(r"(?m)^.*?\b((GET|HEAD|POST|PUT|DELETE|PATCH|OPTIONS|TRACE|CONNECT) (\S+) (HTTP/\d(?:\.\d)?)|(HTTP/\d(?:\.\d)?) (\d{3})(?: ([^\r\n]*))?)[ \t]*\r?$")


def detect_http(text: str) -> list[Detection]:
    """A start line and two headers at least; query and form are decoded."""
    out = []
    for m in _START_LINE.finditer(text):
        headers, at = Pairs(), m.end()
        while h := re.compile(r"\r?\n[ \t]*([A-Za-z][A-Za-z0-9-]*):[ \t]*([^\r\n]*)").match(text, at):
            headers.append((h[1], h[2].strip()))
            at = h.end()
        if len(headers) < 2:
            continue
        v = Pairs()
        if m[2]:
            u = urlsplit(m[3])
            v += [("method", m[2]), ("path", u.path), ("version", m[4])]
            if u.query:
                v.append(("query", Pairs(parse_qsl(u.query, keep_blank_values=True))))
        else:
            v += [("version", m[5]), ("status", Number(m[6])), ("reason", m[7] or "")]
        v.append(("headers", headers))
        if any(k.lower() == "content-type" and "x-www-form-urlencoded" in x for k, x in headers) and (b := re.compile(r"\r?\n\r?\n([^\r\n]+)").match(text, at)):
            v.append(("form", Pairs((unquote_plus(k), unquote_plus(x)) for k, x in parse_qsl(b[1], keep_blank_values=True))))
            at = b.end()
        out.append(Detection("http", m.start(1), at, v, text[m.start(1) : at]))
    return out


_PY_FRAME = re.compile(r'\r?\n[ \t]+File "([^"\n]+)", line (\d+)(?:, in ([^\r\n]+))?(?:\r?\n[ \t]{4,}[^\r\n]+)?')
_AT_FRAME = re.compile(r"\r?\n[ \t]+at ([^\r\n]+)|\r?\n[ \t]+\.\.\. \d+ more")
_THROWN = re.compile(r"(?m)(?:^|(?<=\s))((?:[A-Za-z_$][\w$]*\.)*[A-Z][\w$]*(?:Exception|Error|Throwable|Failure))(?::[ \t]*([^\r\n]*))?(?=\r?\n[ \t]+at )")


def detect_stacktrace(text: str) -> list[Detection]:
    out = []
    for m in re.finditer(r"Traceback \(most recent call last\):", text):
        at, frames = m.end(), []
        while f := _PY_FRAME.match(text, at):
            frames.append(Pairs([("file", f[1]), ("line", Number(f[2])), ("function", f[3] or "")]))
            at = f.end()
        e = re.compile(r"\r?\n([A-Za-z_][\w.]*)(?:: ?([^\r\n]*))?").match(text, at)
        if frames and e:
            out.append(Detection("stacktrace", m.start(), e.end(), Pairs([("language", "python"), ("type", e[1]), ("message", e[2] or ""), ("frames", frames)]), text[m.start() : e.end()]))
    at = 0
    while m := _THROWN.search(text, at):
        if text[max(0, m.start() - 11) : m.start()].endswith("Caused by: "):
            at = m.end()
            continue
        v, end = _thrown(text, m)
        out.append(Detection("stacktrace", m.start(1), end, v, text[m.start(1) : end]))
        at = end
    return out


def _thrown(text: str, m: re.Match) -> tuple[Pairs, int]:
    at, frames = m.end(), []
    while f := _AT_FRAME.match(text, at):
        if f[1]:
            frames.append(f[1].strip())
        at = f.end()
    v = Pairs([("language", "java" if re.search(r"\.java:|Native Method", " ".join(frames)) else "javascript" if re.search(r":\d+:\d+\)?$", frames[0] if frames else "") else "jvm"), ("type", m[1]), ("message", (m[2] or "").strip()), ("frames", frames)])
    if c := re.compile(r"\r?\n[ \t]*Caused by: ").match(text, at):
        if n := _THROWN.match(text, c.end()):
            cause, at = _thrown(text, n)
            v.append(("caused_by", cause))
    return v, at


def _proto(text: str, depth: int = 0) -> Pairs:
    out, i = Pairs(), 0
    key = re.compile(r"\s*([A-Za-z_][\w.]*)\s*(:\s*(?=\{)|:|(?=\{))\s*")
    if depth > MAX_DEPTH:
        raise ValueError("too deep")
    while text[i:].strip():
        m = key.match(text, i)
        if not m:
            raise ValueError("no key")
        i = m.end()
        if text[i : i + 1] == "{":
            end = balanced_end(text, i)
            if not end:
                raise ValueError("open")
            out.append((m[1], _proto(text[i + 1 : end - 1], depth + 1)))
        elif text[i : i + 1] in "\"'" and text[i : i + 1]:
            end = quoted_end(text, i)
            if not end:
                raise ValueError("open")
            out.append((m[1], unquote(text[i:end])))
        else:
            w = re.compile(r"[^\s{},;:]+").match(text, i)
            if not w:
                raise ValueError("no value")
            end = w.end()
            out.append((m[1], scalar(w[0])))
        i = re.compile(r"[ \t\r\n]*[,;]?").match(text, end).end()
    return out


def detect_protobuf(text: str) -> list[Detection]:
    out, at = [], 0
    for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\{(?=\s*[A-Za-z_][\w.]*\s*[:{])", text):
        if m.start() < at:
            continue
        brace = m.end() - 1
        end = balanced_end(text, brace)
        if end:
            try:
                body = _proto(text[brace + 1 : end - 1])
            except (ValueError, RecursionError):
                continue
            if body:
                at = end
                out.append(Detection("protobuf-text", m.start(), end, Pairs([(m[1], body)]), text[m.start() : end]))
    return out


def _python(text: str, depth: int = 0) -> Any:
    t = text.strip()
    if depth > MAX_DEPTH:
        raise ValueError("too deep")
    if t[:1] in ("{", "[", "(") and t[:1] and balanced_end(t, 0) == len(t):
        parts = [p for p in split_top(t[1:-1], ",") if p.strip()]
        if t[0] == "{" and all(find_top(p, ":") >= 0 for p in parts):
            return Pairs((str(_python(p[: find_top(p, ":")], depth + 1)), _python(p[find_top(p, ":") + 1 :], depth + 1)) for p in parts)
        return [_python(p, depth + 1) for p in parts]
    if t in ("True", "False"):
        return t == "True"
    if t == "None":
        return None
    if t[:1] in "\"'" and t[:1] and quoted_end(t, 0) == len(t):
        return unquote(t)
    if isinstance(scalar(t), Number):
        return scalar(t)
    raise ValueError("no literal")


def detect_python(text: str) -> list[Detection]:
    """Literals that JSON isn't: single quotes, True, False, None."""
    out, at = [], 0
    for m in re.finditer(r"[{\[]", text):
        if m.start() < at:
            continue
        end = balanced_end(text, m.start())
        if not end or not re.search(r"'|\b(?:True|False|None)\b", text[m.start() : end]):
            continue
        try:
            v = _python(text[m.start() : end])
        except (ValueError, RecursionError):
            continue
        if v:
            at = end
            out.append(Detection("python", m.start(), end, v, text[m.start() : end]))
    return out


def _swift(text: str, depth: int = 0) -> Any:
    """Debug text of Foundation and Swift values."""
    t = text.strip()
    if depth > MAX_DEPTH:
        raise ValueError("too deep")
    if m := re.fullmatch(r"Optional\((.*)\)", t, re.S):
        return _swift(m[1], depth + 1)
    if t.startswith("<") and t.endswith(">") and ":" in t:
        return _object(t, depth)
    if t.startswith("{") and balanced_end(t, 0) == len(t):
        return _open_step(t, depth)
    if t.startswith("[") and balanced_end(t, 0) == len(t):
        parts = [p for p in split_top(t[1:-1], ",") if p.strip()]
        if parts and all(find_top(p, ":") > 0 for p in parts):
            return Pairs((unquote(p[: find_top(p, ":")].strip()), _swift(p[find_top(p, ":") + 1 :], depth + 1)) for p in parts)
        return [_swift(p, depth + 1) for p in parts]
    if m := re.match(r"([A-Za-z_][\w.]*)\(", t):
        if balanced_end(t, m.end() - 1) == len(t):
            parts = [p for p in split_top(t[m.end() : -1], ",") if p.strip()]
            if parts and all(re.match(r"\s*[A-Za-z_]\w*\s*:", p) for p in parts):
                return Pairs([("type", m[1]), *((p.split(":", 1)[0].strip(), _swift(p.split(":", 1)[1], depth + 1)) for p in parts)])
            return Pairs([("type", m[1]), ("values", [_swift(p, depth + 1) for p in parts])])
    if not t or re.search(r"[{}()\[\]]", t) and t[0] not in "\"'":
        raise ValueError("no value")
    return scalar(t)


def _object(t: str, depth: int) -> Pairs:
    m = re.fullmatch(r"<([A-Za-z_][\w.]*)\s*:\s*(0x[0-9a-fA-F]+)\s*;?\s*(.*)>", t, re.S)
    if not m:
        raise ValueError("no object")
    out = Pairs([("type", m[1]), ("address", m[2])])
    for p in split_top(m[3], ";"):
        if p.strip():
            at = find_top(p, "=")
            if at < 0:
                raise ValueError("no pair")
            out.append((p[:at].strip(), _swift(p[at + 1 :], depth + 1)))
    return out


def detect_foundation(text: str) -> list[Detection]:
    out: list[Detection] = []
    at = 0

    def take(start: int, end: int | None, parse) -> None:
        nonlocal at
        if end and start >= at:
            try:
                v = parse(text[start:end])
            except (ValueError, RecursionError):
                return
            if isinstance(v, list) and v:
                at = end
                out.append(Detection("foundation", start, end, v, text[start:end]))

    for m in re.finditer(r"<[A-Za-z_][\w.]*\s*:\s*0x[0-9a-fA-F]+[^<>]*>|\{(?=\s*[\w\"]+\s*=)|(?<![\w.])[A-Za-z_][\w.]*\((?=\s*[A-Za-z_]\w*\s*:)|(?<![\w.])\.?[a-z]\w*\((?=[A-Za-z_]\w*\s*:)|Optional\(|\[(?=\s*\"[^\"]*\"\s*:)", text):
        s = m.start()
        if m[0].startswith("<"):
            take(s, m.end(), lambda t: _object(t, 0))
        elif m[0] == "{":
            end = balanced_end(text, s)
            take(s, end if end and ";" in text[s:end] else None, _open_step)
        elif m[0] == "[":
            take(s, balanced_end(text, s), _swift)
        else:
            take(s, balanced_end(text, m.end() - 1), _swift)
    for m in re.finditer(r"(?m)^[ \t]*▿ [^\n]*(?:\n[ \t]+(?:▿|-) [^\n]*)+", text):
        lines = [(len(x) - len(x.lstrip()), x.strip()[2:]) for x in m[0].split("\n")]
        out.append(Detection("foundation", m.start(), m.end(), _dump(lines), m[0]))
    return out


def _dump(lines: list[tuple[int, str]]) -> Pairs:
    head, rest = lines[0], lines[1:]
    out, i = Pairs([("value", head[1])]), 0
    while i < len(rest):
        j = i + 1
        while j < len(rest) and rest[j][0] > rest[i][0]:
            j += 1
        key, _, v = rest[i][1].partition(": ")
        out.append((key, _dump([(rest[i][0], v or key), *rest[i + 1 : j]]) if j > i + 1 else scalar(v)))
        i = j
    return out


def _jvm(text: str, depth: int = 0) -> Any:
    t = text.strip()
    if depth > MAX_DEPTH:
        raise ValueError("too deep")
    if m := re.match(r"([A-Za-z_][\w.$]*)?([({\[])", t):
        if balanced_end(t, m.end() - 1) == len(t):
            inner = t[m.end() : -1]
            if m[1] and inner.startswith("{") and balanced_end(inner, 0) == len(inner):
                return Pairs([("type", m[1]), *_jvm(inner, depth + 1)])
            parts = [p for p in split_top(inner, ",") if p.strip()]
            if parts and all(find_top(p, "=") > 0 for p in parts):
                pairs = Pairs((p[: find_top(p, "=")].strip(), _jvm(p[find_top(p, "=") + 1 :], depth + 1)) for p in parts)
                return Pairs([("type", m[1]), *pairs]) if m[1] else pairs
            if m[2] == "[" and not m[1]:
                return [_jvm(p, depth + 1) for p in parts]
            raise ValueError("no pairs")
    return scalar(t)


def detect_jvm(text: str) -> list[Detection]:
    out, at = [], 0
    for m in re.finditer(r"(?<![\w.$])(?:[A-Z][\w.$]*)?[({\[](?=\{?[A-Za-z_]\w*=)", text):
        if m.start() < at:
            continue
        end = balanced_end(text, m.end() - 1)
        if end and ";" not in text[m.start() : end]:
            try:
                v = _jvm(text[m.start() : end])
            except (ValueError, RecursionError):
                continue
            if isinstance(v, Pairs) and v:
                at = end
                out.append(Detection("jvm-debug", m.start(), end, v, text[m.start() : end]))
    return out


_KEY = re.compile(r"(?<![\w.-])[A-Za-z_][\w.-]*")


def _pair(text: str, at: int, sep: str) -> tuple[str, Any, int, str] | None:
    """(key, value, end, raw value) of a pair that starts at a position."""
    m = _KEY.match(text, at)
    if not m:
        return None
    token = text[text.rfind(" ", 0, at) + 1 : at]
    if "://" in token.split("\n")[-1]:
        return None
    i = re.compile(r"[ \t]*").match(text, m.end()).end()
    if text[i : i + 1] != sep or text[i : i + 2] in ("==", "::", ":/") or (sep == "=" and text[i - 1 : i] in "!<>=" and text[i - 1 : i]):
        return None
    i = re.compile(r"[ \t]*").match(text, i + 1).end()
    ch = text[i : i + 1]
    if not ch or ch in "\r\n":
        return None
    if ch in "\"'`":
        end = quoted_end(text, i)
        return (m[0], unquote(text[i:end]), end, text[i:end]) if end else None
    if ch in "{[(":
        end = balanced_end(text, i)
        if end:
            return m[0], text[i:end], end, text[i:end]
    w = re.compile(r"[^\s,;]+").match(text, i)
    return (m[0], scalar(w[0]), w.end(), w[0]) if w else None


def _groups(text: str, sep: str) -> list[tuple[int, int, list[tuple[str, Any, str]]]]:
    """Stretches of pairs that follow each other after blanks, commas, semicolons or an indented new line."""
    out, i = [], 0
    while m := _KEY.search(text, i):
        pairs, at = [], m.start()
        p = _pair(text, at, sep)
        if not p:
            i = m.end()
            continue
        end = at
        while p:
            pairs.append((p[0], p[1], p[3]))
            end = p[2]
            gap = re.compile(r"[ \t]*[,;]?[ \t]*(?:\r?\n[ \t]+)?").match(text, end).end()
            p = _pair(text, gap, sep) if gap > end else None
        out.append((m.start(), end, pairs))
        i = max(end, m.end())
    return out


def detect_logfmt(text: str) -> list[Detection]:
    out = []
    for s, e, pairs in _groups(text, "="):
        raw = pairs[0][2]
        if len(pairs) >= 2 or raw[0] not in "{[(<" or raw == "<null>":
            out.append(Detection("logfmt", s, e, Pairs((k, v) for k, v, _ in pairs), text[s:e]))
    return out


def detect_fields(text: str) -> list[Detection]:
    out = []
    for s, e, pairs in _groups(text, ":"):
        key, value, raw = pairs[0]
        line = text[text.rfind("\n", 0, s) + 1 : len(text) if text.find("\n", e) < 0 else text.find("\n", e)]
        place = "." in key and re.fullmatch(r"\d+[,.:]?", raw)
        alone = line.strip() == text[s:e].strip() and "." not in key
        structured = re.search(r"[_.\-]|[a-z][A-Z]", key) and not (isinstance(value, str) and re.fullmatch(r"[A-Za-z]+", value))
        sure = not place and (raw[0] in "\"'`{[(/" or "://" in raw or alone or structured)
        if len(pairs) >= 2 or sure:
            out.append(Detection("fields", s, e, Pairs((k, v) for k, v, _ in pairs), text[s:e]))
    return out


#: In the order of trial; more can be appended.
REGISTRY: list[Detector] = [detect_json, detect_plist, detect_encoded, detect_http, detect_stacktrace, detect_protobuf, detect_python, detect_foundation, detect_jvm, detect_logfmt, detect_fields]


def register(detector: Detector, first: bool = False) -> None:
    """Adds a detector to those that every analysis tries."""
    REGISTRY.insert(0 if first else len(REGISTRY), detector)
