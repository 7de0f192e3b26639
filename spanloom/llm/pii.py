"""Personal information in free text: a semi-Markov conditional random field over whole spans.

Candidate segments come from generous patterns: strings with an at sign (or what stands for one), runs of digits and
codes, street-like phrases in several languages, and runs of words that could be names. A candidate may carry several
labels; each label is scored by features of the whole span (its shape, digit groups, street word, whether its words are
known given or family names or built like them) and of the words around it. Everything else is outside, with score 0.
The segmentation with the highest total is found by dynamic programming over text positions; as entities are bounded in
length and the outside is free, the recurrence is best[end] = max(best[end before], best[start] + score), which chooses
boundaries and types jointly. ``pii_train`` fits the weights by conditional likelihood over the same lattice.

Defined cases: null, empty or invalid JSON attributes hold nothing; JSON inside strings is read as JSON at any depth and
its string leaves are searched one by one; numbers and keys are not searched; a repeated value counts each time; texts
of any length are searched whole; repeated rows give repeated results for each row.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.nested import read_deep

TYPES = ("email", "phone", "identity_number", "street_address", "name")
FIELDS = ("input.value", "output.value")
WEIGHTS = Path(__file__).with_name("pii_weights.json")
#: Vocabularies of public tokenizers (lines of base64 token and rank): which words are common ones.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Most people whose names are sent to the tasks as a list.
MAX_PEOPLE = 2_000_000
#: Texts per worker whose result is kept, as texts repeat.
CACHED_TEXTS = 50_000

_AT = r"(?:@|\s?(?:\(at\)|\[at\]|\{at\}|<at>)\s?)"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)\s?)"
_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
EMAIL = re.compile(rf"[^\W_][\w.+\-']*(?P<at>{_AT}){_LABEL}(?:{_DOT}{_LABEL})+|[^\W_][\w.+\-']*(?P<word>\sat\s){_LABEL}(?:\sdot\s{_LABEL})+", re.I)
_EMAIL_HINT = re.compile(r"@|[(\[{<]at[)\]}>]|\sdot\s", re.I)
_GROUP = r"(?:\(\d+\)|\d+)"
_EXT = r"(?:,?\s(?:ext|extension|x)\.?\s?\d{1,6})?"
DIGITS = re.compile(rf"(?<![\w.])\+?{_GROUP}(?:[ .\-/]{_GROUP})+{_EXT}(?!\w)|(?<![\w.@/\-])\+?\d{{7,15}}{_EXT}(?![\w@])", re.I)
CODE = re.compile(r"(?<![\w@/.\-])(?:[A-Za-z]{1,3}-?|[A-Z]{1,2} )\d{2,}(?:[ .\-]\d+)*(?:[ \-]?[A-Z](?![a-z])|[a-z])?(?![\w@])|(?<![\w@/.\-])\d{6,}[A-Z](?![\w@])")
# Street words of several languages (fixed values).
STREET_WORDS = "street st road rd avenue ave lane ln drive dr court ct boulevard blvd way terrace ter place pl square sq close crescent cres row walk parkway pkwy highway hwy".split()
STREET_PREFIXES = "rue avenue boulevard bd allée allee chemin place impasse quai route cours passage square calle avenida paseo plaza carrer via viale piazza corso ulica ul. aleja al. улица ул.".split()
STREET_ENDINGS = "straße strasse str weg gasse allee platz ring damm ufer steig pfad".split()
_FLAT = r"(?:,?\s(?:Flat|Apt|Apartment|Unit|Suite|App|Wohnung|Piso|No)\.?\s?\#?\d+[A-Za-z]?\b)?"
_NUMBER = r"\d{1,5}\s?[A-Za-z]?"
ADDRESSES = [
    ("en", re.compile(rf"(?<![\w.\-/]){_NUMBER},?\s(?:[^\W\d_][\w'’.\-]*\s){{1,4}}?(?P<w>{'|'.join(STREET_WORDS)})\b\.?{_FLAT}", re.I)),
    ("fr", re.compile(rf"(?<![\w.\-/]){_NUMBER},?\s(?P<w>{'|'.join(map(re.escape, STREET_PREFIXES))})\s(?:(?:de|du|des|del|della|la|las|los|le|les|d|l)['’\s]\s?){{0,3}}[^\W\d_][\w'’\-]*{_FLAT}", re.I)),
    ("xx", re.compile(rf"(?<!\w)(?P<w>{'|'.join(map(re.escape, STREET_PREFIXES))})\s(?:(?:de|du|des|del|della|la|las|los|le|les|d|l)['’\s]\s?){{0,3}}(?:[^\W\d_][\w'’\-]*\s){{0,2}}[^\W\d_][\w'’\-]*,?\s{_NUMBER}(?!\w){_FLAT}", re.I)),
    ("de", re.compile(rf"(?<![\w])[^\W\d_][\w\-]*(?P<w>{'|'.join(STREET_ENDINGS)})\.?\s{_NUMBER}(?!\w){_FLAT}", re.I)),
    ("am", re.compile(rf"(?<!\w)(?P<w>(?i:am|an der|an den|im|in der|zum|zur|auf der|auf dem|unter den|hinter der|hinter dem|beim))\s(?:[A-ZÄÖÜ][\w\-]*\s){{1,3}}{_NUMBER}(?!\w){_FLAT}")),
]
_SHORT = frozenset("st rd ave ln dr ct blvd ter pl sq cres pkwy hwy str".split())  # street words written with a full stop
_STREET_SET = frozenset(w.strip(".") for w in [*STREET_WORDS, *STREET_PREFIXES, *"am im an in zum zur auf unter hinter beim".split()])
_STREET_TAILS = tuple(STREET_ENDINGS)
TOKEN = re.compile(r"[^\W\d_]\.(?=\s|,|$)|[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+|[^\w\s]|_|\n")
PARTICLES = frozenset("de da di du del della der den van von la le dos bin ibn af av zu zur ten ter".split())
_SHAPES = frozenset(
    "NN NNN IN INN NIN NNIN IIN NpN IpN NppN NIpN N,N N,I N,NI N,NN NN,N pN,N pN,I ppN,N N,II nn nnn n,n in nin npn n,i ln nl l,n n,l lin Nn nN ipn pn,n pNN pnn n,ni".split()
)
_LONGEST = max(map(len, _SHAPES))


@cache
def common_words(paths: tuple[str, ...] = VOCABULARIES) -> frozenset[str]:
    """Words that a tokenizer's vocabulary writes in small letters, whole, after a blank: at most as many as it has tokens."""
    out = set()
    for line in (line for path in paths for line in Path(path).read_bytes().splitlines()):
        token = base64.b64decode(line.split()[0]).decode("utf-8", "replace")
        if token[:1] == " " and len(token) > 2 and token[1:].isalpha() and token.islower():
            out.add(token[1:])
    return frozenset(out)


class People:
    """Known given and family names, how such names begin and end, and the words that are common ones."""

    def __init__(self, given: list[str], family: list[str], common: frozenset[str] = frozenset()):
        self.given = {w for n in given if n for w in n.lower().split()}
        self.family = {w for n in family if n for w in n.lower().split()} - PARTICLES
        self.common = common
        self.heads = {k: {w[:3] for w in s if len(w) > 4} for k, s in (("g", self.given), ("f", self.family))}
        self.tails = {k: {w[-4:] for w in s if len(w) > 4} for k, s in (("g", self.given), ("f", self.family))}
        self._seen: dict[str, str] = {}

    def kind(self, word: str) -> str:
        """g, f, b: known as given, family name, both; h, k, m: built like one; c: a common word; w: none of these."""
        found = self._seen.get(word)
        if found is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            w = word.lower()
            g, f = w in self.given, w in self.family
            if g or f:
                found = "b" if g and f else "g" if g else "f"
            else:
                g, f = (len(w) > 4 and w[:3] in self.heads[k] and w[-4:] in self.tails[k] for k in "gf")
                found = "m" if g and f else "h" if g else "k" if f else "c" if w in self.common or w in CLASS else "w"
            self._seen[word] = found
        return found


# Kinds of words that tell what stands beside them (fixed values), in English, German, French and Spanish.
_CLASSES = {
    "phone": "tel telephone phone call calls called callback mobile cell fax number reach reachable text ring dial whatsapp sms hotline telefon handy anruf rückruf mobil erreichbar téléphone portable appelez appeler joindre teléfono móvil llame llamar llámeme",
    "mail": "mail email mailto courriel correo cc bcc inbox login mailbox write forward",
    "identity": "ssn social security insurance passport identity national nino travel document id card reisepass ausweis ausweisnummer personalausweis passeport identité carte pasaporte dni nie ni license licence",
    "code": "code serial ticket order invoice batch reference ref checksum part isbn claim flight model key build version release tracking host ip page room line rows row record rechnung bestellung factura pedido commande facture colis tariff digest hash token sku item lot entry index position article voucher",
    "address": "address lives live living stays stay moved moves ship shipped deliver delivered delivery resident residing adresse anschrift wohnhaft wohnt zog habite demeurant domicilié dirección vive domicilio office visit parcel",
    "title": "mr mrs ms miss dr prof sir madam herr frau herrn m mme monsieur madame señor señora sr sra dear hello hi hey hola bonjour hallo regards wishes sincerely greetings attn cordially",
    "person": "name named signed by from for with contact patient customer traveller passenger client caller approved asked confirmed spoke ask interview account nurse clerk manager user kunde kundin client cliente colleague employee tenant sister brother mother father wife husband kin guardian witness doctor applicant member guest author owner witnessed told met thanked says said visited",
    "group": "team release board hall project works department group inc ltd company gmbh table service system server tool app station office unit bridge river mountain city town park museum school university journal committee council agency bank hotel library desk",
    "time": "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday am pm hours hour minutes minute seconds ms days percent units eur usd kg km",
    "link": "and or und et y the a an to of at on in is was has had will still who der die das le la el les los un une ein eine that this your our his her their its as not",
}
CLASS = {w: k for k, words in _CLASSES.items() for w in words.split()} | {w: "street" for w in STREET_WORDS if w != "dr"}


def word_class(token: str) -> str:
    """What a word or sign beside a span is, as far as that can bear on it: small words and signs are themselves."""
    t = token.lower()
    found = CLASS.get(t)
    if found:
        return t if found == "link" else found
    if not t[0].isalnum():
        return t
    return "#" if t[0].isdigit() else "Word" if token[0].isupper() else "word"


@dataclass
class Candidate:
    start: int
    end: int
    labels: tuple[str, ...]
    features: list[str] = field(default_factory=list)


def _digit_shape(s: str) -> str:
    s = re.sub(r"(?:,?\s(?:ext|extension|x)\.?\s?\d+)$", "e", s, flags=re.I)
    out = re.sub(r"[A-Za-z]", "A", s[:-1] if s.endswith("e") else s)
    out = re.sub(r"\d+", lambda m: str(len(m.group())), out)
    return out + ("e" if s.endswith("e") else "")


_EXTENSION = re.compile(r",?\s(?:ext|extension|x)\.?\s?\d+$", re.I)
#: Most digits of one number, its extension apart.
NUMBER_DIGITS = 15
#: Fewest digits of a candidate.
LEAST_DIGITS = 6
_MANY_DIGITS = re.compile(r"\d(?:[^\n]{0,3}?\d){5}")
_BLANK = r"[^\S\n]"
_GAP = rf"(?:{_BLANK}+,?|,){_BLANK}*"
# What each shape without a known lower-case word holds: two capital words or initials, at most a comma and two particles between.
_NAME_HINT = re.compile(rf"[^\W\d_a-z][^\W\d_]*(?:['’\-][^\W\d_]+)*\.?{_GAP}(?:(?:{'|'.join(sorted(PARTICLES))}){_BLANK}+){{0,2}}[^\W\d_a-z]")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")


def _street_like(words: list[str]) -> bool:
    return any(w in _STREET_SET or w.endswith(_STREET_TAILS) for w in map(str.lower, words))


_PART = re.compile(r"[^ ]+")


def _digit_runs(m: re.Match) -> Iterator[tuple[int, int]]:
    """A run of digit groups, and every run of neighbouring groups parted by blanks in it that has no more digits than a number
    can have: their number is linear in the length of the run. Of a run with no more digits than one number has, those left
    when groups are taken off either end, and the two sides of each blank that leaves LEAST_DIGITS on both."""
    a, b, s = m.start(), m.end(), m.group()
    yield a, b
    ext = _EXTENSION.search(s)
    parts = [k.span() for k in _PART.finditer(s, 0, ext.start() if ext else len(s))]
    digits = [sum(map(str.isdigit, s[x:y])) for x, y in parts]
    if sum(digits) <= NUMBER_DIGITS:
        if not ext:
            for start, _ in parts[1:3]:
                yield a + start, b
            if len(parts) > 1:
                yield a, a + parts[-2][1]
        for i in range(1, len(parts)):
            if min(sum(digits[:i]), sum(digits[i:])) >= LEAST_DIGITS:
                yield a, a + parts[i - 1][1]
                yield a + parts[i][0], b
        return
    for i, (start, _) in enumerate(parts):
        n = 0
        for j in range(i, len(parts)):
            end = parts[j][1]
            n += digits[j]
            if n > NUMBER_DIGITS:
                break
            yield a + start, a + end
            if ext and j == len(parts) - 1:
                yield a + start, b


def candidates(text: str, people: People) -> list[Candidate]:
    out: list[Candidate] = []
    if _EMAIL_HINT.search(text):
        for m in EMAIL.finditer(text):
            which = "at" if m.group("at") else "word"
            domain = text[m.end(which) : m.end()]
            sep = m.group(which).strip().lower()
            last = re.split(rf"{_DOT}|\sdot\s", domain, flags=re.I)[-1]
            out.append(Candidate(m.start(), m.end(), ("email",), [f"sep={sep}", f"tld={'a' if last.isalpha() else 'd'}{min(len(last), 3)}", f"plain={'.' in domain}", f"dom={'d' if domain[0].isdigit() else 'a'}"]))
    digits = _MANY_DIGITS.search(text), _DIGIT.search(text)
    if digits[0]:
        spans = {span for m in DIGITS.finditer(text) for span in _digit_runs(m)} | {m.span() for m in CODE.finditer(text)}
        for a, b in sorted(spans):
            s = text[a:b]
            n = sum(map(str.isdigit, s))
            if n < LEAST_DIGITS:
                continue
            shape = _digit_shape(s)
            out.append(Candidate(a, b, ("phone", "identity_number"), [f"shape={shape}", f"n={n}", f"plus={s[0] == '+'}", f"paren={'(' in s}", f"ext={shape[-1] == 'e'}", f"head={s[:2] if s[0].isalpha() else s[0]}"]))
    words = _LETTERS.findall(text)
    if digits[1] and _street_like(words):
        for kind, rx in ADDRESSES:
            for m in rx.finditer(text):
                s = m.group()
                if s[-1] == "." and m.group("w").lower() not in _SHORT:
                    s = s[:-1]  # the end of the sentence
                n = sum(1 for w in s.split() if w[0].isalpha())
                caps = "".join("N" if w[0].isupper() else "p" if w in PARTICLES else "n" for w in re.findall(r"[^\W\d_]+", s)[:6])
                out.append(Candidate(m.start(), m.start() + len(s), ("street_address",), [f"kind={kind}", f"word={m.group('w').lower()}", f"words={n}", f"lower={s.islower()}", f"kw={kind}{n}", f"caps={kind}{caps}", f"short={kind}{len(m.group('w')) < 4}{m.group('w')[0].isupper()}"]))
    if _may_name(text, people):
        _names(text, people, out)
    for c in out:
        c.features += _context(text, c.start, c.end)
    return out


def _may_name(text: str, people: People) -> bool:
    """Whether ``_names`` could find a candidate; never false where it would."""
    return bool(_NAME_HINT.search(text)) or any(not w[0].isupper() and people.kind(w) != "c" for w in _WORD.findall(text))


def _names(text: str, people: People, out: list[Candidate]) -> None:
    tokens = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    code = []
    for _, _, t in tokens:
        if t == ",":
            code.append(",")
        elif t[0].isalpha():
            if len(t) == 2 and t[1] == ".":
                code.append("I" if t[0].isupper() else "i")
            elif t[0].isupper():
                code.append("N")
            elif t in PARTICLES:
                code.append("p")
            else:
                code.append("l" if len(t) < 3 or people.kind(t) == "c" else "n")
        else:
            code.append("x")
    codes = "".join(code)
    for i, c in enumerate(codes):
        if c in "x,":
            continue
        for n in range(2, _LONGEST + 1):
            shape = codes[i : i + n]
            if len(shape) < n or shape[-1] == "x":
                break
            if shape not in _SHAPES:
                continue
            part = tokens[i : i + n]
            if "\n" in text[part[0][0] : part[-1][1]]:
                break
            kinds = []
            for (_, _, t), s in zip(part, shape):
                kinds.append(people.kind(t) + ("U" if len(t) > 1 and t.isupper() else s) if s in "Nnl" else s)
            known, like, common, new = (sum(k[0] in of and len(k) > 1 for k in kinds) for of in ("gfb", "hkm", "c", "w"))
            sound = "".join(("F" if k[0] in "fbkm" else "G" if k[0] in "gh" else "C" if k[0] == "c" else "W") if len(k) > 1 else k for k in kinds)
            out.append(Candidate(part[0][0], part[-1][1], ("name",), [
                f"pat={'|'.join(kinds)}", f"sound={sound}", f"code={shape}", f"known={known}", f"like={like}", f"common={common}", f"new={new}", f"mix={known}{like}{common}{new}", f"class={'+'.join(sorted({CLASS[t.lower()] for _, _, t in part if t.lower() in CLASS}))}",
            ]))


#: Words before a span that can bear on it.
BEFORE = 6


def _context(text: str, start: int, end: int) -> list[str]:
    """What stands before and after a span: the nearest signs and words as classes, the nearest telling words on both sides."""
    before = TOKEN.findall(text, max(0, start - 80), start)[-BEFORE - 4 :]
    if "\n" in before:
        before = before[len(before) - before[::-1].index("\n") :]
    p2, p1 = (["^", "^"] + [word_class(t) for t in before[-2:]])[-2:]
    after = [m.group() for m, _ in zip(TOKEN.finditer(text, end), range(BEFORE))]
    n1, n2 = ([word_class(t) for t in after[:2]] + ["$", "$"])[:2]
    words = [CLASS.get(t.lower(), "") for t in before if t[0].isalpha()][-BEFORE:][::-1]
    told = [k for k in words if k and k != "link"]
    next_told = next((k for t in after if (k := CLASS.get(t.lower())) and k != "link"), "")
    cut = ["cut"] if text.startswith(("..", "…"), end) else []  # the text breaks off here
    first = word_class(before[-1]) if before and before[-1][0].isalpha() else words[0] if words else "^"
    return ["bias", *cut, f"p1={p1}", f"p2={p2}_{p1}", f"n1={n1}", f"n2={n1}_{n2}", f"told={told[0] if told else ''}", f"told2={'_'.join(told[:2])}", f"first={first}", f"next={next_told}", f"side={told[0] if told else ''}|{next_told}"]


@cache
def weights(path: str = str(WEIGHTS)) -> dict[str, dict[str, float]]:
    """Weight by feature, by label."""
    return json.loads(Path(path).read_text())


def lattice(text: str, people: People, model: dict[str, dict[str, float]]) -> list[tuple[int, int, str, float]]:
    out = []
    for c in candidates(text, people):
        for label in c.labels:
            w = model[label]
            out.append((c.start, c.end, label, sum(w.get(f, 0.0) for f in c.features)))
    return out


def decode(segments: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The best set of segments that don't overlap; the outside scores 0. Ties go to the earlier, then longer segment."""
    good = sorted((s for s in segments if s[3] > 0), key=lambda s: (s[1], s[0]))
    if len(good) < 2:
        return [s[:3] for s in good]
    from bisect import bisect_right

    ends = [s[1] for s in good]
    best, back = [0.0], [(-1, 0)]
    for i, (start, _, _, score) in enumerate(good):
        j = bisect_right(ends, start, 0, i)
        take = best[j] + score
        if take > best[i]:
            best.append(take)
            back.append((i, j))
        else:
            best.append(best[i])
            back.append((-1, i))
    out, i = [], len(good)
    while i:
        k, j = back[i]
        if k >= 0:
            out.append(good[k][:3])
        i = j
    return out[::-1]


class Finder:
    """Entities of texts, with repeated texts looked up."""

    def __init__(self, people: People, model: dict[str, dict[str, float]] | None = None):
        self.people, self.model = people, model or weights()
        self._seen: dict[str, list[tuple[int, int, str]]] = {}

    def entities(self, text: str) -> list[tuple[int, int, str]]:
        found = self._seen.get(text)
        if found is None:
            if len(self._seen) > CACHED_TEXTS:
                self._seen.clear()
            found = self._seen[text] = decode(lattice(text, self.people, self.model))
        return found

    def redact(self, text: str) -> str:
        """The text with a typed placeholder, e.g. [EMAIL], in place of each entity."""
        out, at = [], 0
        for start, end, label in self.entities(text):
            out += [text[at:start], f"[{label.upper()}]"]
            at = end
        return "".join(out) + text[at:]


def _loads(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return read_deep(text)


def _inner(text: str):
    if text[:1] in ("{", "[") or text[:1].isspace():
        try:
            v = _loads(text)
        except ValueError:
            return None
        if isinstance(v, (dict, list)):
            return v
    return None


def leaves(value) -> Iterator[str]:
    """String leaves of a JSON value, in order, JSON inside strings read as JSON."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            inner = _inner(v)
            if inner is None:
                yield v
            else:
                stack.append(inner)
        elif isinstance(v, dict):
            stack.extend(reversed(v.values()))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def redact_value(value, finder: Finder):
    """A JSON value with its string leaves redacted; JSON inside strings stays JSON inside strings."""
    if isinstance(value, str):
        inner = _inner(value)
        return finder.redact(value) if inner is None else json.dumps(redact_value(inner, finder), ensure_ascii=False)
    if isinstance(value, dict):
        return {k: redact_value(v, finder) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_value(v, finder) for v in value]
    return value


def _people(principals: DataFrame | None, vocabularies: tuple[str, ...]) -> People:
    if principals is None:
        return People([], [], common_words(vocabularies))
    rows = principals.select("given_name", "family_name").distinct().limit(MAX_PEOPLE + 1).collect()
    if len(rows) > MAX_PEOPLE:
        raise ValueError(f"more than {MAX_PEOPLE} people; the list of names is sent to every task")
    return People([r[0] for r in rows], [r[1] for r in rows], common_words(vocabularies))


def _attributes(doc: str) -> dict | None:
    try:
        v = _loads(doc)
    except ValueError:
        return None
    return v if isinstance(v, dict) else None


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')


def _redact_document(doc: str, finder: Finder) -> str:
    top = _attributes(doc)
    if not top or not any(f in top for f in FIELDS):
        return doc
    try:
        return json.dumps({k: redact_value(v, finder) if k in FIELDS else v for k, v in top.items()}, ensure_ascii=False)
    except RecursionError:  # deeper than the library can write: every string of the document is redacted where it stands
        return _STRING.sub(lambda m: json.dumps(finder.redact(json.loads(m.group())), ensure_ascii=False), doc)


def _may_hold(doc: Column) -> Column:
    """Whether a document may have one of the fields: it names one, or writes keys with escapes."""
    return doc.contains("put.value") | doc.contains("\\u")


def find(df: DataFrame, principals: DataFrame | None = None, key: str = "arrival_seq", attributes: str = "attributes", vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """One row per entity: key, field, pii_type, occurrence (1 to k for the k entities of a type in a field)."""
    people = df.sparkSession.sparkContext.broadcast(_people(principals, vocabularies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(people.value)
        for b in batches:
            rows, fields, types, numbers = [], [], [], []
            for i, doc in enumerate(b.column(1).to_pylist()):
                top = _attributes(doc)
                for f in FIELDS:
                    if not top or f not in top:
                        continue
                    count: dict[str, int] = {}
                    for text in leaves(top[f]):
                        for _, _, label in finder.entities(text):
                            count[label] = count.get(label, 0) + 1
                            rows.append(i), fields.append(f), types.append(label), numbers.append(count[label])
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(fields), pa.array(types), pa.array(numbers, pa.int32())], names=["k", "field", "pii_type", "occurrence"])

    rows = df.where(_may_hold(F.col(attributes))).select(F.col(key).alias("k"), F.col(attributes).alias("a"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, field string, pii_type string, occurrence int").withColumnRenamed("k", key)


def redact(df: DataFrame, principals: DataFrame | None = None, attributes: str = "attributes", vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """``df`` with the texts of both fields redacted in ``attributes``; documents without them pass unchanged."""
    people = df.sparkSession.sparkContext.broadcast(_people(principals, vocabularies))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        finder = Finder(people.value)

        for docs in batches:
            yield pd.Series([_redact_document(d, finder) if d and ("put.value" in d or "\\u" in d) else d for d in docs], dtype=object)

    from collections.abc import Iterator as It

    import pandas as pd

    run.__annotations__ = {"batches": It[pd.Series], "return": It[pd.Series]}
    return df.withColumn(attributes, F.pandas_udf(run, "string")(F.col(attributes)))
