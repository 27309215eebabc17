"""Personal information inside free text: found, typed, and replaced by placeholders.

Offset-preserving deobfuscation: small transducers rewrite a text (look-alike characters, invisible characters,
spelled digits, at/dot disguises) while they keep for every output character the source characters it stands
for. Identifiers are detected in the rewritten text and their spans are mapped back to the source.

Defined results: spans are in code points of the source text, end exclusive, and never overlap (e-mail before
address before phone and document number before name; then the longer, then the earlier); null and empty texts
have none; texts are scanned whole; a document delivered twice is reported once; columns other than key and text
are ignored; an empty table gives an empty result; an empty list of name parts finds no names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The list of name parts is a parameter that travels to the workers; a longer one is refused.
NAME_PARTS_LIMIT = 500_000

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlqwABEKMHOPCTXIJSaopvikABEZHIKMNOPTYX"))
_INVISIBLE = "­​‌‍⁠﻿"
# Digit words in English, German, French and Spanish.
_DIGIT_WORDS = {
    w: str(d)
    for d, ws in enumerate(["zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"])
    for w in ws.split()
}
_DIGIT_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)\b(?:{_DIGIT_WORD})(?:[ -]+(?:{_DIGIT_WORD}))" + r"{5,}\b")
_BRACKET_AT, _BRACKET_DOT = (rf"[ \t]*[\[({{<][ \t]*(?i:{w})[ \t]*[\])}}>][ \t]*" for w in ("at|arobase|arroba", "dot|punkt|punto|point"))
_WORD_DOT = r"[ \t]+(?:dot|DOT)[ \t]+"
_HOST = r"[A-Za-z0-9-]++"
#: How an at is written, and how the dots of the host behind it are (a host without one is none).
_DISGUISED = [
    (re.compile(_BRACKET_AT), re.compile(rf"{_HOST}(?:(?:{_BRACKET_DOT}|{_WORD_DOT}|\.){_HOST})++(?![\w@-])")),
    (re.compile(r"[ \t]++(?:at|AT)[ \t]++"), re.compile(rf"{_HOST}(?:(?:{_WORD_DOT}|{_BRACKET_DOT}){_HOST})++(?![\w@-])")),
    (re.compile(r"[ \t]*+@[ \t]*+"), re.compile(rf"{_HOST}(?:{_BRACKET_DOT}{_HOST})++(?![\w@-])")),
    (re.compile(r"[ \t]++@[ \t]++"), re.compile(rf"{_HOST}(?: ?\. ?{_HOST})++(?![\w@-])")),
]
#: A written dot read backwards: in brackets, or as a word with something before it.
_DOT_BACK = re.compile(r"[ \t]*+[\])}>][ \t]*(?i:tod|tknup|otnup|tniop)[ \t]*[\[({<][ \t]*+(?=[A-Za-z0-9_])|[ \t]++(?:tod|TOD)[ \t]++(?=[A-Za-z0-9_])")
_DOTS = re.compile(rf"{_BRACKET_DOT}|[ \t]+(?:dot|DOT)[ \t]+| ?\. ?")
_HINT = re.compile(r"(?i)[\[({<]\s*(?:at|arobase|arroba|dot|punkt|punto|point)\s*[\])}>]|\sdot\s|\s@|@\s")
#: What a text holds if it has a disguise without a bare "dot": an at or a dot in brackets, or an @ between blanks.
_BRACKETED = re.compile(r"[\[({<][ \t]*(?i:at|arobase|arroba|dot|punkt|punto|point)[ \t]*[\])}>]")
_APART = re.compile(r"@(?<=[ \t]@)[ \t]")


class Free:
    """Spans taken one after another; one that overlaps another is refused."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []

    def take(self, s: int, e: int) -> bool:
        i = bisect_left(self.spans, (s, e))
        if (i and self.spans[i - 1][1] > s) or (i < len(self.spans) and self.spans[i][0] < e):
            return False
        self.spans.insert(i, (s, e))
        return True


class Rewritten:
    """A text with, for each character, the source span it stands for. Identity while nothing was rewritten."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.begin: list[int] | None = None
        self.end: list[int] | None = None
        self.spelled: list[tuple[int, int]] = []  # where numbers stand that were spelled out

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, new) in order; every new character stands for the whole replaced span."""
        if not edits:
            return
        begin = self.begin if self.begin is not None else list(range(len(self.text)))
        end = self.end if self.end is not None else list(range(1, len(self.text) + 1))
        out, b, e, at = [], [], [], 0
        for s, t, new in edits:
            out.append(self.text[at:s])
            b += begin[at:s]
            e += end[at:s]
            out.append(new)
            b += [begin[s]] * len(new)
            e += [end[t - 1]] * len(new)
            at = t
        out.append(self.text[at:])
        self.text, self.begin, self.end = "".join(out), b + begin[at:], e + end[at:]

    def source(self, s: int, t: int) -> tuple[int, int]:
        return (s, t) if self.begin is None else (self.begin[s], self.end[t - 1])


def _characters(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    edits = []
    for i, ch in enumerate(text):
        if ch < "­":
            continue
        new = "" if ch in _INVISIBLE else _LOOKALIKES.get(ch)
        if new is None and not ("À" <= ch <= "ɏ"):
            folded = unicodedata.normalize("NFKC", ch)
            new = folded if folded != ch and folded.isascii() and len(folded) == 1 else None
        if new is not None:
            edits.append((i, i + 1, new))
    return edits


def _small(text: str) -> str:
    """Small letters, also where an expression that ignores case takes one letter for another."""
    if not text.isascii() and any(c in text for c in _ODD):
        text = text.translate(_ODD_CASES)
    return text.lower()


# Letters whose other case lies outside their alphabet.
_ODD = "\u0130\u0131\u017f\u212a"
_ODD_CASES = str.maketrans(_ODD, "iisk")


def _digits(text: str) -> list[tuple[int, int, str]]:
    words = _small(text).replace("-", " ").split()
    if sum(words.count(w) for w in _DIGIT_WORDS.keys() & set(words)) < 4:
        return []
    if "1111" not in "".join(["1" if w in _DIGIT_WORDS else "0" for w in words]):
        return []  # the words between the first and the last of six stand bare
    return [(m.start(), m.end(), "".join(_DIGIT_WORDS[_small(w)] for w in re.split(r"[ -]+", m[0]))) for m in _SPELLED.finditer(text)]


def _disguises(text: str) -> list[tuple[int, int, str]]:
    if not _HINT.search(text):
        return []
    edits: list[tuple[int, int, str]] = []
    free = Free()
    back = text[::-1]
    for written, hosts in _DISGUISED:
        end = 0
        for at in written.finditer(text):
            host = hosts.match(text, at.end())
            begin = _local_part(text, back, at.start(), end) if host else at.start()
            if begin < at.start() and free.take(begin, host.end()):
                end = host.end()
                edits.append((begin, end, _DOTS.sub(".", text[begin : at.start()]) + "@" + _DOTS.sub(".", host[0])))
    return sorted(edits)


def _local_part(text: str, back: str, at: int, least: int) -> int:
    """Where the local part that ends at `at` begins: letters, signs and written dots, of any length."""
    i, n = at, len(text)
    while i > least:
        if text[i - 1] in _LOCAL_CHARACTERS:
            i -= 1
        elif i < at and text[i].isalnum() and (m := _DOT_BACK.match(back, n - i)) and n - m.end() > least:
            i = n - m.end()
        else:
            break
    while i < at and not (text[i] in _LOCAL_FIRST and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in "_.+%-"))):
        i += 1
    return i


def _cases(words: Iterable[str]) -> frozenset[str]:
    """Words as they stand in a text: small, with a capital, in capitals."""
    return frozenset(x for w in words for x in (w, w.capitalize(), w.upper()))


_DOT_CASES = frozenset(["dot", "DOT"])
_LETTERS = re.compile(r"[^\W\d_]+")


_no_digits: set[str] = set()


def _any_digit_word(words: set[str]) -> bool:
    """Whether one of a text's words is a digit word in any case; those that aren't are remembered."""
    if len(_no_digits) > 1_000_000:
        _no_digits.clear()
    new = {w for w in words - _no_digits if _small(w) not in _DIGIT_WORDS}
    _no_digits.update(new)
    return not words <= _no_digits


def rewrite(text: str, words: set[str] | None = None) -> Rewritten:
    """words: the text's words, if known; they tell cheaply which transducers have nothing to do."""
    r = Rewritten(text)
    r.replace(_characters(text))
    words = words if words is not None and r.begin is None else set(_LETTERS.findall(r.text))
    r.spelled = []
    if _any_digit_word(words):
        edits = _digits(r.text)
        r.replace(edits)
        grown = 0
        for b, e, new in edits:
            r.spelled.append((b + grown, b + grown + len(new)))
            grown += len(new) - (e - b)
    if words & _DOT_CASES or _BRACKETED.search(r.text) or _APART.search(r.text):
        edits = _disguises(r.text)
        r.replace(edits)
        for b, e, new in reversed(edits):  # numbers behind an address move with it
            r.spelled = [(x, y) if x < b else (x + len(new) - (e - b), y + len(new) - (e - b)) for x, y in r.spelled]
    return r


_EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![\w-])")
_REMOTE = re.compile(r"(?i)\b(?:ssh|scp|sftp|rsync|mosh|telnet|ssh-copy-id)\b|\bgit\s+(?:clone|remote|fetch|pull|push)\b")
_REMOTE_WORDS = frozenset(x for w in ("ssh", "scp", "sftp", "rsync", "mosh", "telnet", "git") for x in (w, w.capitalize(), w.upper()))

_LOCAL_FIRST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOCAL_CHARACTERS = _LOCAL_FIRST | frozenset("._%+-")


def _emails(text: str) -> Iterator[re.Match]:
    """Every address, looked for around each @."""
    i = end = -1
    while (i := text.find("@", i + 1)) >= 0:
        j = i
        while j > max(0, end) and text[j - 1] in _LOCAL_CHARACTERS:
            j -= 1
        while j < i and not text[j].isalnum():
            j += 1
        if j < i and (m := _EMAIL.match(text, j)):
            end = m.end()
            yield m


_EXT = r"(?:,?\s*(?:ext\.?|extension|x|Durchwahl|poste|interno)\s*\d{1,6}\b)?"
_EXTENSION = re.compile(f"(?i){_EXT}")
_PHONES = [
    re.compile(rf"(?i)(?<![\w+.])\+\d{{1,3}}(?:[ .-]?\(0\)[ ]?\d{{1,5}}|[ .-]?\(\d{{1,5}}\))?(?:[ .-]?\d{{1,8}}){{1,7}}(?!\d|[.-]\d){_EXT}"),
    re.compile(rf"(?i)(?<![\w(+])\(\d{{2,5}}\)[ -]?\d{{3,4}}[ .-]\d{{3,5}}(?!\d|[.-]\d){_EXT}"),
    re.compile(rf"(?i)(?<![\w./+#-])\d{{3}}([.-])\d{{3}}\1\d{{4}}(?![\w]|[./-]\d){_EXT}"),
    re.compile(rf"(?i)(?<![\w./+#-])0\d(?:[ .-]\d{{2}}){{4}}(?![\w]|[./-]\d){_EXT}"),
    re.compile(rf"(?i)(?<![\w./+#-])0\d{{2,4}}[ /-]\d{{4,8}}(?:[ -]\d{{1,5}})?(?![\w]|[./-]\d){_EXT}"),
]

#: A character that a number of each kind holds.
_PHONE_SIGNS = ["+", "(", "-.", "0", "0"]

_LABEL = re.compile(r"(?i)\b(?:ssn|social security(?: (?:number|no\.?))?|tax (?:number|no\.?|id)|tin|steuer(?:nummer|-?id(?:entifikationsnummer)?)|national (?:id|identity)(?: (?:card|number|no\.?))?|id card|identity card|ausweisnummer|personalausweis(?:nummer)?|reisepass(?:nummer)?|ni (?:number|no\.?)|nino|national insurance(?: (?:number|no\.?))?|passport(?: (?:number|no\.?))?|driver'?s? licen[cs]e|driving licen[cs]e|führerschein(?:nummer)?|dni|nie|nif|pasaporte|passeport|numéro de sécurité sociale|sozialversicherungsnummer|versichertennummer|medical record|patient (?:id|number|no\.?)|mrn)(?![\w])")
_LABEL_WORDS = _cases("ssn social tax tin steuer steuernummer steuerid steueridentifikationsnummer national card identity ausweisnummer personalausweis personalausweisnummer reisepass reisepassnummer ni nino passport licence license führerschein führerscheinnummer dni nie nif pasaporte passeport numéro sozialversicherungsnummer versichertennummer medical patient mrn".split())
_IDNUM = re.compile(r"(?i)(?<![\w./-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{2,3}/\d{3}/\d{4,5}|\d{4}-\d{4}-\d{2,4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,2}\d{6,9}[A-Z]?|[A-Z]\d[A-Z]\d{6,8}[A-Z]?|\d{8}[- ]?[A-Z]|\d{9,13}|[A-Z\d]{4,}\d{3,}[A-Z\d]*)(?![\w]|[./-]\d)")

_NUM = r"\d{1,4}(?:[-–]\d{1,4})?"
_WORD = r"[A-ZÀ-Þ](?:[\w-]|['’](?=\w))*"
_UNIT = r"(?:,? (?:Apt|Apartment|Unit|Flat|Suite|Ste|Room|Wohnung|Whg|apto|piso|appt)\.? ?#?\d{1,4}[A-Za-z]?|,? #\d{1,4})"
_EN_END = r"(?:Street|St\.|St\b(?!\.)|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Close|Court|Ct|Drive|Dr|Way|Place|Pl|Square|Sq|Terrace|Crescent|Gardens|Grove|Hill|Mews|Row|Parkway|Pkwy|Highway|Hwy|Alley|Walk)"
_ADDRESSES = [
    re.compile(rf"(?<![\w-])(?:(?:Flat|Apt|Apartment|Unit|Suite)\.? \d{{1,4}}[A-Za-z]?, )?{_NUM} ?[A-Za-z]? (?:{_WORD} ){{1,3}}(?:{_EN_END}|{_EN_END.upper().replace(chr(92) + 'B', chr(92) + 'b')})(?!\w){_UNIT}?"),
    re.compile(rf"(?i:(?<![\w-]){_NUM}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:rue|avenue|av\.|boulevard|bd|place|allée|chemin|impasse|quai|route|cours)) (?i:(?:de la |de l['’]|du |des |de |d['’])?){_WORD}(?:[ -]{_WORD})*{_UNIT}?"),
    re.compile(rf"(?i:(?<![\w-])(?:calle|avenida|avda\.|plaza|paseo|camino|carrera|c/)) (?i:(?:de la |de los |de las |del |de |la )?){_WORD}(?: {_WORD})*,? (?:n\.?º ?)?\d{{1,4}}[A-Za-z]?\b{_UNIT}?"),
    re.compile(rf"(?<![\w-]){_WORD}(?i:straße|strasse|str\.|weg|allee|platz|gasse|ufer|damm|ring|chaussee) \d{{1,4}} ?[a-f]?(?!\w){_UNIT}?"),
    re.compile(rf"(?<![\w-]){_WORD}(?: {_WORD})? (?i:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse) \d{{1,4}} ?[a-f]?(?!\w){_UNIT}?"),
]


#: Words of which a text holds one if it holds an address of each kind (None: see below), as they are written.
_ADDRESS_WORDS = [
    frozenset(x for w in "Street St Road Rd Avenue Ave Boulevard Blvd Lane Ln Close Court Ct Drive Dr Way Place Pl Square Sq Terrace Crescent Gardens Grove Hill Mews Row Parkway Pkwy Highway Hwy Alley Walk".split() for x in (w, w.upper())),
    _cases("rue avenue av boulevard bd place allée chemin impasse quai route cours".split()), _cases("calle avenida avda plaza paseo camino carrera c".split()), None, _cases("straße strasse str weg allee platz gasse".split()) | {"STRAßE"},
]


def _compound_street(low: str) -> bool:
    """Whether a text can hold a compound street name followed by a number."""
    if "straße " in low or "strasse " in low or "str. " in low or "weg " in low or "allee " in low or "platz " in low or "gasse " in low or "ufer " in low or "damm " in low or "chaussee " in low:
        return True
    return "ring " in low and _RING.search(low) is not None


_RING = re.compile(r"ring \d")
_NUMBER_RUN = re.compile(r"[+(]?\d[\d ().\-/]{5,}\d")


class NameGrammar:
    """What name parts are made of, learned from an incomplete list of them.

    Units are found by letter successor variety: a beginning after which at least three different letters (or the
    end) follow. Units are taken off the parts and the rests examined again until nothing new is found; rests
    that often stand at the end are endings. A word is like a name if it is listed or splits into two units or
    more with at most one ending.
    """

    def __init__(self, parts: Iterable[str], variety: int = 3, often: int = 4) -> None:
        self.listed = {p.strip().lower() for p in parts if p and p.strip()}
        self.units: set[str] = set()
        pool = set(self.listed)
        while True:
            after: dict[str, set[str]] = defaultdict(set)
            for w in pool:
                for n in range(2, min(4, len(w)) + 1):
                    after[w[:n]].add(w[n : n + 1] or "$")
            new = {p for p, s in after.items() if len(s) >= variety} - self.units
            # of two nested beginnings the one with the greater variety is the unit
            new = {p for p in new if not any(q != p and (q.startswith(p) or p.startswith(q)) and len(after[q]) > len(after[p]) for q in new | self.units)}
            if not new:
                break
            self.units |= new
            pool = {r for w in self.listed for r in self._rests(w)}
        self.endings: set[str] = set()
        self.endings = self._often_last(often)
        self._fill_gaps()
        self.endings = self._often_last(often)
        self._known: dict[str, bool] = {}
        self._plain: set[str] = set()
        self._compound = any(not _LETTERS.fullmatch(p) for p in self.listed)
        units, endings = ("|".join(sorted(map(re.escape, x), key=len, reverse=True)) for x in (self.units, self.endings))
        whole = "|".join(sorted((re.escape(p) for p in self.listed if not self._splits(p)), key=len, reverse=True))
        made = [x for x in (whole, rf"(?:{units}){{2,}}" + (rf"(?:{endings})?" if endings else "") if units else "") if x]
        self.pattern = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(made)})(?![^\W\d_])", re.I) if made else None

    def _often_last(self, often: int) -> set[str]:
        return {r for r, n in Counter(r for w in self.listed for r in self._rests(w, last=True)).items() if n >= often and r not in self.units}

    def _fill_gaps(self, seen_in: int = 2) -> None:
        """Adds what alone keeps several parts from splitting: a stretch between units, or at either end."""
        gaps: Counter[str] = Counter()
        for w in self.listed:
            if not self._covers(w):
                gaps.update({w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1) if self._covers(w[:i]) and self._covers(w[i + n :])})
        self.units |= {g for g, n in gaps.items() if n >= seen_in and g not in self.endings}

    def _covers(self, w: str) -> bool:
        reach = {0}
        for i in range(len(w)):
            if i in reach:
                reach |= {i + n for n in (2, 3, 4) if w[i : i + n] in self.units and i + n <= len(w)}
        return len(w) in reach

    def _rests(self, word: str, last: bool = False) -> set[str]:
        """What is left of a word at each place a sequence of units leads to; last: only where no unit follows."""
        out, todo, seen = set(), [0], {0}
        while todo:
            i = todo.pop()
            steps = [i + n for n in (2, 3, 4) if word[i : i + n] in self.units and len(word[i : i + n]) == n]
            if i < len(word) and i and (not last or not steps):
                out.add(word[i:])
            for j in steps:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return out

    def like_name(self, word: str) -> bool:
        w = word.lower()
        if w not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[w] = w in self.listed or self._splits(w)
        return self._known[w]

    def any_name(self, words: set[str]) -> bool:
        """Whether one of a text's words is like a name; the words that aren't are remembered."""
        if self.pattern is None or self._compound:
            return self.pattern is not None
        if len(self._plain) > 1_000_000:
            self._plain.clear()
        hit = False
        for w in words - self._plain:
            if self.pattern.fullmatch(w):
                hit = True
            else:
                self._plain.add(w)
        return hit

    def _splits(self, w: str) -> bool:
        reach = {0: 0}
        for i in range(len(w)):
            if i in reach:
                for n in (2, 3, 4):
                    if w[i : i + n] in self.units and len(w[i : i + n]) == n:
                        reach[i + n] = max(reach.get(i + n, 0), reach[i] + 1)
        return any(k >= 2 and (i == len(w) or w[i:] in self.endings) for i, k in reach.items())


_DIGIT = re.compile(r"\d")
_TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Herrn|Frau|Mme|Mlle|Monsieur|Madame|M|señora?|señorita|Sra?|Don|Doña)\.? )$", re.I)
_SIGN = re.compile(r"[ \t>]*(?:--|—|–|~|-|\*)?[ \t]*")


_CAPITAL = r"(?-i:[A-ZÀ-Þ])[\w'’-]*(?-i:[a-zß-ÿ])"
#: Names that their surroundings tell, whatever they are made of: behind a title, a word that introduces, a closing.
_TOLD = [
    re.compile(rf"(?i)\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Señorita|Sra?|Don|Doña)\.? ({_CAPITAL}(?:(?: |-| [A-Z]\. ){_CAPITAL})++)"),
    re.compile(rf"(?i)\b(?:my name is|mein Name ist|ich heiße|je m['’]appelle|me llamo|mi nombre es) ({_CAPITAL}(?:(?: |-| [A-Z]\. ){_CAPITAL})*+)"),
    re.compile(rf"(?im)^[ \t]*(?:(?:kind |best |warm )?regards|cheers|(?:many )?thanks|sincerely(?: yours)?|mit freundlichen grüßen|viele grüße|cordialement|saludos)[,!.]?[ \t]*\n[ \t]*(?:--|—|–|~|-)?[ \t]*({_CAPITAL}(?:(?: |-| [A-Z]\. ){_CAPITAL})*+)[ \t]*$"),
]
_TOLD_WORDS = [
    _cases("mr mrs ms miss dr prof herr herrn frau mme mlle monsieur madame señor señora señorita sr sra don doña".split()),
    _cases("name heiße appelle llamo nombre".split()), _cases("regards cheers thanks sincerely grüßen grüße cordialement saludos".split()),
]


def _told(text: str, words: set[str]) -> list[tuple[int, int]]:
    """Names in surroundings that tell them, also where no part of them is like the listed ones."""
    return [m.span(1) for p, signs in zip(_TOLD, _TOLD_WORDS) if not words.isdisjoint(signs) for m in p.finditer(text)]


def _names(text: str, grammar: NameGrammar, words_of_text: set[str], most: float = float("inf")) -> list[tuple[int, int]]:
    """Runs of words like names; most: words after which a new name begins."""
    words = [m.span() for m in grammar.pattern.finditer(text)] if grammar.any_name(words_of_text) else []
    out, i = [], 0
    while i < len(words):
        j = i
        while j + 1 < len(words) and text[words[j][1] : words[j + 1][0]] in (" ", "-", ", ") and j - i < most - 1:
            if text[words[j][1] : words[j + 1][0]] == ", " and (j > i and ", " in text[words[i][0] : words[j][1]]):
                break
            j += 1
        s, e = words[i][0], words[j][1]
        upper = text[s].isupper()
        initial_after = re.match(r" [A-Z]\.(?![\w])", text[e : e + 4])
        initial_before = re.search(r"(?<![\w.])[A-Z]\. $", text[max(0, s - 5) : s])
        if j > i:
            if text[s:e].count(" ") or upper:
                out.append((s, e))
        elif upper and initial_after:
            k = j + 1  # given name, initial, family name
            if k < len(words) and text[e : words[k][0]] == initial_after[0] + " " and text[words[k][0]].isupper():
                out.append((s, words[k][1]))
                j = k
            else:
                out.append((s, e + 3))
        elif upper and initial_before:
            out.append((s - 3, e))
        elif upper and (_TITLE.search(text[max(0, s - 12) : s]) or _alone(text, s, e)):
            out.append((s, e))
        i = j + 1
    return out


def _in_url(text: str, at: int) -> bool:
    """Whether a scheme's :// stands before, with neither a slash nor a blank between."""
    slash = text.rfind("/", text.rfind("\n", 0, at) + 1, at)
    return slash >= 2 and text[slash - 2 : slash] == ":/" and not any(c.isspace() for c in text[slash + 1 : at])


def _alone(text: str, s: int, e: int) -> bool:
    """A sign-off: nothing else but a dash or tilde stands on the line."""
    begin, end = text.rfind("\n", 0, s) + 1, text.find("\n", e)
    before, after = text[begin:s], text[e : end if end >= 0 else len(text)]
    return bool(_SIGN.fullmatch(before)) and not after.strip(" \t\r.,!") and not after.strip().startswith(",")


_SIGNS, _LINKING = re.compile(r"[^\w\n]*+"), re.compile(r"(?i)number|no|nr|is|ist|es|est|was|of|card|für mich|für")


def _number_behind(t: str, b: int, end: int) -> tuple[int, int] | None:
    """The number behind a label: with at most three linking words between."""
    at = b
    for _ in range(4):
        at = _SIGNS.match(t, at, end).end()
        if m := _IDNUM.match(t, at, end):
            return m.span()
        link = _LINKING.match(t, at, end)
        if not link:
            return None
        at = link.end()
    return None


def _number_before(t: str, begin: int, a: int) -> tuple[int, int] | None:
    """The number before a label, with a sign or words between that point back at it."""
    own = next((len(w) for w in ("my ", "his ", "her ", "the ") if t[max(begin, a - 4) : a].lower().endswith(w)), 0)
    for e in {a, a - own}:
        k = e
        while k > begin and t[k - 1].isspace():
            k -= 1
        low = t[max(begin, k - 5) : k].lower()
        sign = next((x for x in ("is my", "--", "//", "/*", "as", "#", "(") if low.endswith(x)), None)
        if sign:
            k -= len(sign)
            break
    else:
        return None
    while k > begin and (t[k - 1].isspace() or t[k - 1] in "'\")];,"):
        k -= 1
    i, runs = k, 1  # the number's characters: at most five runs with single blanks between
    while i > begin and (t[i - 1].isalnum() or t[i - 1] in "./-_" or (t[i - 1] == " " and runs < 6)):
        runs += t[i - 1] == " "
        i -= 1
    return next((m.span() for m in _IDNUM.finditer(t, i, a) if m.end() == k), None)


def detect(text: str | None, grammar: NameGrammar) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the source text, in order."""
    if not text:
        return []
    words = set(_LETTERS.findall(text))
    r = rewrite(text, words)
    t = r.text
    if r.begin is not None:
        words = set(_LETTERS.findall(t))
    found: list[tuple[int, str, int, int]] = []
    if "@" in t:
        remote = {t.rfind("\n", 0, c.start()) + 1: c.end() for c in reversed(list(_REMOTE.finditer(t)))} if words & _REMOTE_WORDS else {}  # first command of each line
        for m in _emails(t):
            after = remote.get(t.rfind("\n", 0, m.start()) + 1) if remote else None
            target = (after is not None and m.start() >= after) or re.match(r":[\w~/]", t[m.end() : m.end() + 2]) or _in_url(t, m.start())
            if not target:
                found.append((0, "EMAIL", m.start(), m.end()))
    if _DIGIT.search(t):
        low = t.lower()
        for p, signs in zip(_ADDRESSES, _ADDRESS_WORDS):
            if words & signs if signs is not None else _compound_street(low):
                found += [(1, "ADDRESS", m.start(), m.end()) for m in p.finditer(t)]
        for run in _NUMBER_RUN.finditer(t):
            written = run[0]
            fitting = [p for p, signs in zip(_PHONES, _PHONE_SIGNS) if any(c in written for c in signs)] if sum(map(str.isdigit, written)) >= 7 else []
            end = max(_EXTENSION.match(t, run.end()).end(), min(len(t), run.end() + 1)) if fitting else 0
            for m in (m for p in fitting for m in p.finditer(t, max(0, run.start() - 2), end)):
                if 7 <= sum(c.isdigit() for c in re.sub(r"(?i)(?:ext|x|poste|durchwahl|interno).*", "", m[0])) <= 15:
                    found.append((2, "PHONE", m.start(), m.end()))
        found += [(2, "PHONE", b, e) for b, e in r.spelled if 7 <= e - b <= 15 and t[b] == "0" and not (b and t[b - 1] == "+")]  # written as it is dialled
        labels = [m.span() for m in _LABEL.finditer(t)] if words & _LABEL_WORDS else []
        if labels:
            for a, b in labels:
                begin, end = t.rfind("\n", 0, a) + 1, t.find("\n", b)
                m = _number_behind(t, b, end if end >= 0 else len(t)) or _number_before(t, begin, a)
                if m:
                    found.append((2, "IDNUM", *m))
    found += [(3, "NAME", s, e) for s, e in (*_names(t, grammar, words), *_told(t, words))]
    found.sort(key=lambda x: (x[0], -(x[3] - x[2]), x[2]))
    free = Free()
    taken = [(kind, s, e) for _, kind, s, e in found if free.take(s, e)]
    return sorted(((k, *r.source(s, e)) for k, s, e in taken), key=lambda x: x[1])


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with a numbered placeholder per distinct value, such as <EMAIL_1>; the rest is unchanged."""
    if not text or not spans:
        return text
    out, at, known = [], 0, defaultdict(dict)
    for kind, s, e in spans:
        number = known[kind].setdefault(text[s:e].lower(), len(known[kind]) + 1)
        out += [text[at:s], f"<{kind}_{number}>"]
        at = e
    return "".join([*out, text[at:]])


def grammar_of(name_parts: DataFrame) -> NameGrammar:
    parts = [r[0] for r in name_parts.select("name_part").filter("name_part is not null").distinct().limit(NAME_PARTS_LIMIT + 1).collect()]
    if len(parts) > NAME_PARTS_LIMIT:
        raise ValueError("the list of name parts is longer than NAME_PARTS_LIMIT")
    return NameGrammar(sorted(parts))


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def find_personal_data(docs: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, span_start, span_end). One pass over the texts; only the spans are shuffled."""
    grammar = grammar_of(name_parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, k, s, e) for d, t in zip(pdf["doc_id"], pdf["text"]) for k, s, e in detect(t, grammar)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "span_start", "span_end"])

    return _source(docs, key, text).mapInPandas(run, "doc_id long, kind string, span_start long, span_end long").distinct()


def redact(docs: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, found): every document once, personal information replaced by typed placeholders."""
    grammar = grammar_of(name_parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [detect(t, grammar) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [redacted(t, s) for t, s in zip(pdf["text"], spans)], "found": [len(s) for s in spans]})

    return _source(docs, key, text).mapInPandas(run, "doc_id long, text string, found int").dropDuplicates(["doc_id"])
