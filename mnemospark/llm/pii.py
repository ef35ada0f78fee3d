"""Personal information in free text: found and replaced by typed placeholders.

Texts are read line by line; a find doesn't go beyond its line. Generators propose spans of each kind, many of them and overlapping. Boosted trees, a model per
kind, score each from its format and its context. A kind's threshold is calibrated on held-out
examples; of overlapping spans the more probable one holds. The models are trained on
made-up sentences (``pii_corpus``), a bounded number of them. A generator runs only on lines that have what
each of its spans has: some digits, a street word, two capitalised words and the like.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm import boosting, pii_corpus

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
#: Rounds of made-up sentences that the models are trained on; each has about twenty.
ROUNDS = 900
#: Lines whose signs are looked up at once.
GROUP = 2_048
#: Code points from here on have no case, digit or blank that isn't read as a plain one.
CASED = 0x3000

# ---------------------------------------------------------------- one character for one character


class _Same(dict):
    """Full-width and other digits and signs as plain ones, special blanks and dashes as plain ones."""

    def __missing__(self, code: int) -> int:
        c, out = chr(code), code
        if 0xFF01 <= code <= 0xFF5E:
            out = code - 0xFEE0
        elif code > 127 and c.isdecimal():
            out = ord(str(int(c)))
        elif code > 127 and c.isspace() and c not in "\u0085  ":
            out = 32
        elif c in "‐‑‒–—−﹣":
            out = 45
        elif c in "’‘ʼ":
            out = 39
        self[code] = out
        return out


_SAME = _Same()

# ---------------------------------------------------------------- generators


def _letters(*categories: str) -> str:
    """Letters of alphabets with case, as the inside of a character class."""
    return "".join(chr(c) for c in range(0x41, 0x2000) if unicodedata.category(chr(c)) in categories)


_W = r"[^\W\d_]"
_U, _L = _letters("Lu", "Lt"), _letters("Ll")
_CAP = rf"(?:(?:O'|Mc|Mac|D'|d')?[{_U}][{_L}]+(?:[-'](?:[{_U}]?[{_L}]+))*)"
_UPPER = rf"(?:(?:O'|D'|MC)?[{_U}]{{2,}}(?:[-'][{_U}]+)*)"
_PARTICLES = "van|von|der|den|de|del|della|da|di|le|la|du|dos|al|el|bin|ten"
_FAM = rf"(?:(?:(?:{_PARTICLES}) ){{0,2}}(?:{_CAP}|O'{_CAP}))"
_TITLES = "Mr Mrs Ms Miss Mx Dr Prof Herr Frau Herrn Monsieur Madame Mademoiselle Mme Mlle Señor Señora Señorita Sr Sra Srta Don Doña Sir Lady Dame".split()
_TITLE = f"(?:{'|'.join(_TITLES)})"
#: Forms of address after a name in a script without case.
_CJK_TITLES = "先生|女士|小姐|太太|老师|医生|教授|同学"
_LOCAL = r"(?<![\w.+%-])[^\W_][\w.%+-]{0,63}+(?:(?:\s?[(\[{]dot[)\]}]\s?|\sdot\s)[\w%+-]{1,40}){0,3}"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
_EN = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|court|ct|row|way|place|pl|square|sq|terrace|boulevard|blvd|crescent|gardens|mews|parade|walk|highway|quay|green|grove|rise|hill"
_DE = "straße|strasse|str\\.|weg|allee|platz|gasse|ring|damm|ufer|hof|steig|pfad|chaussee|stieg"
_FR = "rue|chemin|avenue|impasse|boulevard|allée|allee|place|quai|route|cours|passage|sentier|square"
_ES = "calle|avenida|avda\\.?|plaza|camino|paseo|carrera|travesía|ronda|callejón|carretera"
_TAIL = rf"(?:,? (?:apt|flat|unit|suite|no)\.? ?\d+\w?)?(?:, \d{{1,2}}\.?[ºª°]? ?[A-Da-d]?(?=,))?(?:, (?:\d{{4,5}} )?{_W}[\w'-]+(?: (?-i:[A-ZÀ-Þ])[\w'-]+)?(?: \d{{4,5}})?(?!\w))?"
_NUMBER_WORDS = "|".join(sorted({w for ws in pii_corpus._DIGITS.values() for w in ws} | {"oh"}, key=len, reverse=True))

#: Kind, what a line must have, and the pattern.
_GENERATORS: list[tuple[str, str, re.Pattern]] = [
    ("email", "at", re.compile(rf"(?i){_LOCAL}(?:\s?@\s?|\s?[(\[{{]\s?at\s?[)\]}}]\s?)[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,40}}){{1,5}}")),
    ("email", "at dot", re.compile(rf"(?i){_LOCAL}\sat\s[a-z0-9-]{{1,63}}(?:\sdot\s[a-z0-9-]{{1,40}}){{1,5}}")),
    ("number", "7 digits", re.compile(r"(?<![\w@#$€£-])(?<!\d[.,:/])(?:\+ ?|00)?\(?\d(?:(?:[ ./-]|\) ?[-/]?| ?\()?\d){6,15}(?!\w)(?![.:/-]\d)")),
    ("phone", "number words", re.compile(rf"(?i)(?<!\w)(?:(?:plus )?(?:{_NUMBER_WORDS})[ ,-]{{1,2}}){{6,}}(?:{_NUMBER_WORDS})(?!\w)")),
    ("id_number", "mixed", re.compile(r"(?<![\w@/+=.-])(?=[A-Za-z\d]*\d[A-Za-z\d]*\d)(?:[A-Za-z]{1,3}\d[A-Za-z0-9]{5,13}|\d{7,9}-?[A-Za-z]|[A-Za-z]\d{7,8}-?[A-Za-z])(?![\w/+=@])")),
    ("id_number", "6 digits", re.compile(r"(?<![\w@-])[A-Za-z]{2} ?\d{2} \d{2} \d{2} ?[A-Za-z](?!\w)")),
    ("id_number", "upper digits", re.compile(r"(?<![\w@-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("address", "en", re.compile(rf"(?i)(?<![\w.,:/-])(?:(?:flat|apt|apartment|unit|suite) \d+\w?, ?)?\d{{1,5}}[a-z]?,? (?:[nsew]\.?\s)?(?:{_W}[\w'-]*\s){{1,4}}?(?:{_EN})(?!\w)\.?{_TAIL}")),
    ("address", "fr", re.compile(rf"(?i)(?<![\w.,:/-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:{_FR}) (?:(?:d[eu]s?|de la|de l'|d'|la|le|l') ?)?{_W}[\w'-]*(?: (?-i:[{_U}])[\w'-]*| {_W}[\w'-]*(?=,)){{0,2}}{_TAIL}")),
    ("address", "es", re.compile(rf"(?i)(?<!\w)(?:{_ES}|c/) ?(?:{_W}[\w'-]* ){{0,3}}?{_W}[\w'-]*,? (?:n\.?[ºo°] ?)?\d{{1,4}}(?!\w|\.\d){_TAIL}")),
    ("address", "de", re.compile(rf"(?i)(?<!\w){_W}[\w-]*(?:{_DE}) ?\d{{1,4}}(?: ?[a-f])?(?!\w|\.\d){_TAIL}")),
    ("address", "de", re.compile(rf"(?<!\w)(?:{_CAP} )?(?:{_CAP}) (?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring|Damm|Ufer) \d{{1,4}}(?: ?[a-f])?(?!\w|\.\d){_TAIL}")),
    ("address", "de at", re.compile(rf"(?<!\w)(?:Am|An der|An den|Im|In der|In den|Auf dem|Auf der|Zum|Zur|Unter den|Hinter dem|Hinter der|Vor dem|Beim) (?:{_CAP} ){{0,2}}{_CAP} \d{{1,4}}(?: ?[a-f])?(?!\w|\.\d){_TAIL}")),
    ("name", "title", re.compile(rf"(?i:(?<!\w){_TITLE})\.?\s(?:[{_U}]\.\s?){{0,2}}(?:{_CAP}\s)?(?:{_FAM}|{_UPPER})")),
    ("name", "capitals", re.compile(rf"(?<![\w@.])(?=({_CAP} (?:[{_U}]\. ?){{0,2}}{_FAM}))")),
    ("name", "capitals", re.compile(rf"(?<![\w@.])(?=({_CAP} {_CAP} {_FAM}))")),
    ("name", "comma", re.compile(rf"(?<![\w@.])(?=({_CAP}, {_CAP})(?!\w))")),
    ("name", "upper", re.compile(rf"(?<![\w@.])(?=({_UPPER}(?:,? (?:[{_U}]\. ?)?){_UPPER})(?![\w@.]\w))")),
    ("name", "initial", re.compile(rf"(?<![\w@.])(?:[{_U}]\. ?){{1,3}}{_FAM}")),
    ("name", "cjk", re.compile(rf"[\u4e00-\u9fff]{{1,3}}(?:{_CJK_TITLES})")),
]

_AT = re.compile(r"(?i)[(\[{]\s?at\s?[)\]}]")
_LOW_TITLES = frozenset(x.lower() for x in _TITLES)
_EN_WORDS, _FR_WORDS = frozenset(_EN.split("|")), frozenset(_FR.split("|"))
_ES_WORDS = frozenset(x.removesuffix("\\.?") for x in _ES.split("|"))
_DE_ENDS = tuple(x.removesuffix("\\.") for x in _DE.split("|"))
_AM_WORDS = frozenset("am an im in auf zum zur unter hinter vor beim".split())
_NUMBERS = frozenset(_NUMBER_WORDS.split("|"))


#: What a line may have, as bits; the words of which each is a sign.
_BITS = {x: 1 << i for i, x in enumerate(("en", "fr", "es", "de at", "title", "number", "at", "dot", "particle", "given", "de", "capitals", "slash", "cjk", "upper", "initial", "mixed", "1 digits", "2 digits", "6 digits", "7 digits", "sign"))}
_SIGNS = {"en": _EN_WORDS, "fr": _FR_WORDS, "es": _ES_WORDS, "de at": _AM_WORDS, "title": _LOW_TITLES, "number": _NUMBERS, "at": {"at"}, "dot": {"dot"}, "particle": frozenset(_PARTICLES.split("|"))}
_FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point below ``CASED`` its class (1 word character, 2 capital, 4 digit, 8 white space, 16 colon or at sign), and its small letter; the last entry stands for all others."""
    kind, low = np.ones(CASED + 1, np.uint8), np.arange(CASED + 1, dtype=np.uint64)
    capitals = set(map(ord, _U))
    for code in range(CASED):
        c = chr(code)
        kind[code] = (c.isalnum() or c == "_") | (code in capitals) << 1 | c.isdecimal() << 2 | c.isspace() << 3 | (c in ":@") << 4
        small = c.lower()
        if len(small) == 1:
            low[code] = ord(small)
    return kind, low


def _hash(word: str) -> int:
    total = 0
    for i, c in enumerate(word):
        total += ord(c) * pow(_FACTOR, i, 1 << 64)
    return total % (1 << 64)


@lru_cache(8)
def _words(given: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that are signs, sorted, and their bits."""
    bits: dict[int, int] = {}
    for name, words in [*_SIGNS.items(), ("given", given)]:
        for w in words:
            bits[_hash(w)] = bits.get(_hash(w), 0) | _BITS[name]
    keys = np.array(sorted(bits), np.uint64)
    return keys, np.array([bits[int(k)] for k in keys], np.int64)


def _bits(lines: list[str], given: frozenset[str]) -> np.ndarray:
    """Bits of each line, looked up for all lines at once on their code points. A word is known by its hash; a chance hit costs time only."""
    kind_of, low_of = _tables()
    text = "\n".join(lines) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    near = np.minimum(codes, CASED)
    kind = kind_of[near]
    ends = np.cumsum([len(x) + 1 for x in lines])
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(len(lines), np.int64)
    n = np.add.reduceat((kind & 4) >> 2, starts, dtype=np.int64)
    for k in (1, 2, 6, 7):
        out |= np.where(n >= k, _BITS[f"{k} digits"], 0)
    line_of = lambda at: np.searchsorted(ends, at, side="right")
    out[line_of(np.flatnonzero(codes == 64))] |= _BITS["sign"]
    slash = np.flatnonzero(codes == 47)
    slash = slash[(slash > 0) & ((codes[slash - 1] | 32) == 99)]
    out[line_of(slash)] |= _BITS["slash"]
    out[line_of(np.flatnonzero((codes >= 0x4E00) & (codes <= 0x9FFF)))] |= _BITS["cjk"]
    cap, digit = (kind & 2) > 0, (kind & 4) > 0
    letter = ((kind & 1) > 0) & ~digit
    out[line_of(np.flatnonzero(cap[:-1] & cap[1:]))] |= _BITS["upper"]
    out[line_of(np.flatnonzero(cap[:-1] & (codes[1:] == 46)))] |= _BITS["initial"]
    out[line_of(np.flatnonzero((letter[:-1] & digit[1:]) | (digit[:-1] & letter[1:])))] |= _BITS["mixed"]
    out[line_of(np.flatnonzero(digit[:-2] & (codes[1:-1] == 45) & letter[2:]))] |= _BITS["mixed"]
    # words and their hashes
    inside = (kind & 1).astype(np.int8)
    edge = np.diff(inside, prepend=0)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power = _powers(_FACTOR, len(codes))
    both = []
    for c in (low_of[near], codes.astype(np.uint64)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power, dtype=np.uint64)])
        both.append((total[after] - total[first]) * _powers(_INVERSE, len(codes))[first])
    keys, bits = _words(given)
    line = line_of(first)
    for hashes, mask in zip(both, (~_BITS["given"], _BITS["given"]), strict=True):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        found = np.where(keys[at] == hashes, bits[at], 0) & mask
        some = np.flatnonzero(found)
        np.bitwise_or.at(out, line[some], found[some])
    # two capitals, the first in a token before the second's, or with a particle between
    index = np.arange(len(codes))
    capital = np.maximum.accumulate(np.where(kind & 2, index, -1))
    stop = np.maximum.accumulate(np.where(kind & 24, index, -1))
    at = np.flatnonzero(kind & 2)
    at = at[at > 1]
    spaced = at[(kind[at - 1] & 8) > 0] - 1
    pair = spaced[(spaced > 0)]
    pair = pair[capital[pair - 1] > stop[pair - 1]]
    out[line_of(pair)] |= _BITS["capitals"]
    dotted = at[codes[at - 1] == 46]
    dotted = dotted[(kind[dotted - 2] & 2) > 0]
    out[line_of(dotted)] |= _BITS["capitals"]
    out |= np.where(out & _BITS["particle"], _BITS["capitals"], 0)
    return out


@lru_cache(2)
def _power_table(factor: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, factor, np.uint64)]), dtype=np.uint64)


def _powers(factor: int, n: int) -> np.ndarray:
    return _power_table(factor, 1 << max(10, (n - 1).bit_length()))[:n]


@lru_cache(65_536)
def _plan(bits: int) -> tuple[list[tuple[str, str, re.Pattern]], bool]:
    """The generators that a line with these bits may need, and whether names in small letters may be in it."""
    b = _BITS
    has = {x for x in ("6 digits", "7 digits", "title", "capitals", "initial", "cjk") if bits & b[x]}
    if bits & b["capitals"]:
        has.update(["comma", *(["upper"] if bits & b["upper"] else [])])
    if bits & b["2 digits"]:
        has.update(x for x in ("mixed",) if bits & b[x])
        has.update(["upper digits"] if bits & b["upper"] else [])
    if bits & (b["sign"] | b["at"]):
        has.add("at")
    if bits & b["at"] and bits & b["dot"]:
        has.add("at dot")
    if bits & b["number"]:
        has.add("number words")
    if bits & b["1 digits"]:
        has.update(x for x in ("en", "fr", "de at") if bits & b[x])
        has.update(["de", *(["es"] if bits & (b["es"] | b["slash"]) else [])])
    return [g for g in _GENERATORS if g[1] in has], bool(bits & b["given"])


def _lacks(need: str, line: str) -> bool:
    """Whether a line lacks what can't be told by its bits."""
    if need == "de":
        low = line.lower()
        return not any(x in low for x in _DE_ENDS)
    if need == "number words":
        return sum(w in _NUMBERS for w in _WORDS.findall(line.lower())) < 7
    if need == "comma":
        return ", " not in line
    return need == "at" and "@" not in line and _AT.search(line) is None


# ---------------------------------------------------------------- features

#: Words around a span that speak for or against a kind.
CUES = {
    "phone": "call number phone tel telephone mobile cell text texted voicemail message answers ring dial fax reach called ruf unter telefon nummer handy klempner plumber vet appelle téléphone portable llama teléfono móvil whatsapp".split(),
    "id": "passport id ssn social security tax national insurance identity ausweis ausweisnummer steuer-id steuer formular form sécu identité dni nie nif licence license file personalausweis reisepass iban pasaporte".split(),
    "order": "order parcel ticket isbn tracking invoice version serial bestellung commande pedido sendung booking reference score account catalogue points units".split(),
    "mail": "mail e-mail email write address cc'd invoices contact schreib rechnung bounces sign-up used adresse escríbeme".split(),
    "place": "lives live send deliver parcel parcels address moved keys wohnen paket anschrift habite vivo".split(),
    "travel": "bus room near train tram platform closed exit page level tries after line".split(),
    "thing": "method catalogue gallery hardware library hall street road lane avenue row court close fair holdings ltd gmbh inc sons company league museum point bay drive school university hospital market lake".split(),
    "small": "the a an to of and or for with on in is was at by from my your it we i you der die das und mit ist war im am zu le la les et de du el los y con goes people pages tries".split(),
}
_CUE = {k: frozenset(v) for k, v in CUES.items()}
_TOKEN = re.compile(r"[^\W_]+(?:['\-][^\W_]+)*")
_WORDS = re.compile(r"\w+")
_DIGIT_GROUPS = re.compile(r"\d+")
_SENTENCE = re.compile(rf"[.!?] (?=[{_U}])")
_STARTS_WITH_TITLE = re.compile(rf"(?i){_TITLE}\b\.? ")
_INITIAL = re.compile(rf"\b[{_U}]\.")
_STARTERS = frozenset("the my our your his her their this that these call ask meet let bus did do does how what when where who why after before and but or no yes is are was were i we you he she it they as at on in if an a room remember could honestly please st saint lake old new good happy das der die ein eine wie wir ich er sie es am im mit und oder mein meine hier le la les un une el los una version parcel passport regards well note dear hello hi".split())
_ARTICLES = frozenset(("the", "a", "an", "die", "der", "das", "la", "le", "el", "lake", "st", "bus", "room"))


def _features(t: str, a: int, b: int, kind: str, given: frozenset[str]) -> list[float]:
    span = t[a:b]
    before, after = t[max(0, a - 48) : a], t[b : b + 32]
    cuts = [m.end() for m in _SENTENCE.finditer(before)]  # context ends with the sentence before
    if cuts:
        before = before[cuts[-1] :]
    prev = _TOKEN.findall(before.lower())
    nxt = _TOKEN.findall(after.lower())
    lows = _TOKEN.findall(span.lower())
    groups = [len(x) for x in _DIGIT_GROUPS.findall(span)]
    n_groups, n_words = len(groups), len(lows)
    letters = sum(map(str.isalpha, span))
    near, near2, n2, n3, n4 = prev[-6:], prev[-2:], nxt[:2], nxt[:3], nxt[:4]
    last, follow = (prev[-1] if prev else ""), (nxt[0] if nxt else "")
    first, final = (lows[0], lows[-1]) if lows else ("", "")
    rest = lows[1:]
    small = _CUE["small"]
    trimmed = before.rstrip()
    starts = [x[0].isupper() for x in _TOKEN.findall(span) if x[0].isalpha()]
    grp = [*groups[:5], 0, 0, 0, 0, 0][:5]
    return [
        b - a, sum(groups), letters, n_words, n_groups, *grp, groups[-1] if groups else 0,
        span[0] == "+", "(" in span[:6], span[0] == "0", span[:2] == "00", span.count(" "), span.count("-"), span.count("."), span.count("/"),
        span[0].isalpha(), span[-1].isalpha(), sum(map(str.isupper, span)) / (letters or 1),
        (not _CUE["phone"].isdisjoint(near)) + (not _CUE["phone"].isdisjoint(n3)), (not _CUE["id"].isdisjoint(near)) + (not _CUE["id"].isdisjoint(n3)), not _CUE["order"].isdisjoint(near),
        (not _CUE["mail"].isdisjoint(near)) + (not _CUE["mail"].isdisjoint(n4)), not _CUE["place"].isdisjoint(near), not _CUE["travel"].isdisjoint(near2),
        not _CUE["thing"].isdisjoint(n2), not _CUE["thing"].isdisjoint(rest), not small.isdisjoint(lows[1:-1]), last in _ARTICLES,
        first in given, n_words > 1 and lows[1] in given, final in given, first in _STARTERS, _STARTS_WITH_TITLE.match(span) is not None, _INITIAL.search(span) is not None, "," in span,
        after[:2] in ("'s", "& ") or after[:3] == " & ", after[:1] == ":", after[:1].isalnum(), trimmed[-1:] in ("", ":", ".", ">"), final[-1:] == "s" and first not in given,
        len(final) > 1 and final.isalpha(), (follow in small) - (final in small), any(starts) and not all(starts), bool(starts) and not starts[0],
    ]


def candidates(line: str, given: frozenset[str], lower: re.Pattern | None, bits: int | None = None) -> list[tuple[int, int, str]]:
    """Every proposed (start, end, kind) in a line; spans may overlap, also with different kinds."""
    plan, small = _plan(int(_bits([line], given)[0]) if bits is None else bits)
    out: set[tuple[int, int, str]] = set()
    for kind, need, pattern in plan:
        if need in ("de", "number words", "at", "comma") and _lacks(need, line):
            continue
        for m in pattern.finditer(line):
            a, b = m.span(1) if m.re.groups and m.group(1) else m.span()
            if a == b:
                continue
            if kind == "number":
                out.add((a, b, "phone"))
                out.add((a, b, "id_number"))
            else:
                out.add((a, b, kind))
    if lower is not None and small:
        out.update((m.start(), m.end(), "name") for m in lower.finditer(line))
    return sorted(out)


@lru_cache(8)
def _lower_names(given: frozenset[str]) -> re.Pattern | None:
    """A given name in small letters and the word after it."""
    if not given:
        return None
    return re.compile(rf"(?<![\w@.+-])(?:{'|'.join(sorted(map(re.escape, given), key=len, reverse=True))}) (?:[a-z]\. )?[{_L}][{_L}'-]{{2,}}(?![\w@])")


# ---------------------------------------------------------------- model


@dataclass
class Model:
    trees: dict[str, boosting.Trees]
    thresholds: dict[str, float]
    given: frozenset[str]

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """The spans to redact in each text, in order and without overlap."""
        lines = [t.translate(_SAME).split("\n") if t else [] for t in texts]
        found = self._lines(list(dict.fromkeys(x for some in lines for x in some)))
        out = []
        for some in lines:
            at, here = 0, []
            for x in some:
                here += [(at + a, at + b, kind) for a, b, kind in found.get(x, ())]
                at += len(x) + 1
            out.append(here)
        return out

    def _lines(self, lines: list[str]) -> dict[str, list[tuple[int, int, str]]]:
        """The spans of each line that has some. Few lines at a time, so that few candidates are held."""
        out: dict[str, list[tuple[int, int, str]]] = {}
        for i in range(0, len(lines), GROUP):
            out |= self._group(lines[i : i + GROUP])
        return out

    def _group(self, lines: list[str]) -> dict[str, list[tuple[int, int, str]]]:
        rows, feats = [], []
        lower = _lower_names(self.given)
        for t, bits in zip(lines, _bits(lines, self.given).tolist(), strict=True):
            for a, b, kind in candidates(t, self.given, lower, bits) if bits else ():
                rows.append((t, a, b, kind))
                feats.append(_features(t, a, b, kind, self.given))
        out: dict[str, list[tuple[int, int, str]]] = {}
        if not rows:
            return out
        x = np.array(feats, float)
        kinds = np.array([r[3] for r in rows])
        p, needed = np.zeros(len(rows)), np.ones(len(rows))
        for kind, trees in self.trees.items():
            at = kinds == kind
            if at.any():
                p[at], needed[at] = trees.probability(x[at]), self.thresholds[kind]
        per: dict[str, list[tuple[float, int, int, str]]] = {}
        for (t, a, b, kind), q, low in zip(rows, p.tolist(), needed.tolist(), strict=True):
            if q >= low:
                per.setdefault(t, []).append((q, a, b, kind))
        for t, found in per.items():
            taken: list[tuple[int, int, str]] = []
            for _, a, b, kind in sorted(found, key=lambda f: (-round(f[0], 2), f[1] - f[2], f[1])):
                if all(b <= c or a >= d for c, d, _ in taken):
                    taken.append((a, b, kind))
            out[t] = sorted(taken)
        return out


@lru_cache(4)
def train(given: frozenset[str] = frozenset(), rounds: int = ROUNDS, seed: int = 3) -> Model:
    """Models from made-up sentences; ``given`` are given names known besides the common ones.

    A fifth of the sentences calibrate the scores and set the thresholds.
    """
    known = frozenset(x.lower() for x in pii_corpus.GIVEN) | given
    names = sorted({x.capitalize() for x in known})
    trees, thresholds = {}, {}
    data: dict[str, tuple[list, list, list]] = {k: ([], [], []) for k in KINDS}
    lower = _lower_names(known)
    made = [(text.translate(_SAME), gold) for text, gold in pii_corpus.examples(rounds, seed, names)]
    for n, ((t, gold), bits) in enumerate(zip(made, _bits([t for t, _ in made], known).tolist(), strict=True)):
        for a, b, kind in candidates(t, known, lower, bits):
            hit = any(k == kind and 2 * (min(b, d) - max(a, c)) >= max(b, d) - min(a, c) for c, d, k in gold)
            x, y, held = data[kind]
            x.append(_features(t, a, b, kind, known))
            y.append(float(hit))
            held.append(n % 5 == 0)
    for kind, (x, y, held) in data.items():
        x, y, held = np.array(x, float), np.array(y), np.array(held)
        model = boosting.fit(x[~held], y[~held])
        thresholds[kind] = boosting.calibrate(model, x[held], y[held])
        trees[kind] = model
    return Model(trees, thresholds, known)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, keys: list[str], text: str, given_names: list[str] | None = None) -> DataFrame:
    """``keys, redacted, kinds, spans`` of every row of ``df``.

    ``redacted`` is the text with every find replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``,
    ``[ADDRESS]`` or ``[NAME]``; ``kinds`` are the kinds found, each once; ``spans`` say where, in
    characters of the text. ``given_names`` are given names known besides common ones, such as those of the
    speakers; their number must be bounded.

    Repeated rows stay. A null text stays null, with no kinds; an empty one stays empty.
    """
    model = train(frozenset(x.lower() for x in given_names or [] if x and x.isalpha()))
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame.pop("t").tolist()
            texts = [x if isinstance(x, str) else None for x in texts]
            spans = held.value.spans(texts)
            yield frame.assign(
                redacted=[None if t is None else redacted(t, s) for t, s in zip(texts, spans, strict=True)],
                kinds=[sorted({k for _, _, k in s}) for s in spans],
                spans=[[{"start_char": a, "end_char": b, "kind": k} for a, b, k in s] for s in spans],
            )

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInPandas(run, f"{types}, redacted string, kinds array<string>, spans array<struct<start_char: int, end_char: int, kind: string>>")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "redacted", "kinds", "spans")
