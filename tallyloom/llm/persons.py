"""Names, birth dates and contacts of persons as typed, and whether two typed records can be one person."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from .places import distance

# Given names and the nicknames and abbreviations used for them.
NICKNAMES = {
    "ALEXANDER": "ALEX SANDER", "ALFREDO": "FRED PEDONG FREDO", "ANGELICA": "ANGGE GEL ANGIE", "ANTONIO": "TONY TONYO TONIO", "BEATRIZ": "BEA BETTY", "BENJAMIN": "BEN BENJIE",
    "CARLOS": "CALOY CHARLIE", "CARMELITA": "LITA MELY", "CHRISTIAN": "CHRIS XTIAN", "CONCEPCION": "CHON CONNIE", "CORAZON": "CORA AZON", "CRISPIN": "PINO", "CRISTINA": "TINA CRISTY",
    "DANILO": "DANNY DAN NILO", "DOLORES": "LOLENG LOLITA", "DOMINADOR": "DOMING", "DOMINGO": "DOMING MINGO", "EDUARDO": "EDDIE EDONG EDDY", "ELIZABETH": "BETH ELIZ LIZA BETTY", "EMMANUEL": "MANNY NOEL",
    "ERNESTO": "ERNING ERNIE NESTO", "ESPERANZA": "ESPIE PANSA", "FERNANDO": "FERDIE NANDING NANDO", "FILOMENA": "FILO MENA", "FLORENCIA": "FLOR ENCIA", "FRANCISCO": "KIKO PACO FRANK FCO", "GLORIA": "GLORY",
    "GREGORIO": "GREG GORYO", "HERMINIA": "MINIA HERMIE", "IMELDA": "MELDA", "ISAGANI": "GANI", "JEFFREY": "JEFF", "JOCELYN": "JOY LYN", "JOSE": "PEPE JOEY JO", "JOSEFINA": "JOSIE PINING", "JOSELITO": "JOJO LITO",
    "JUAN": "JOHNNY WANITO", "KATHERINE": "KAT KATHY", "KRISTINE": "KRIS TIN", "LEONARDO": "LEO NARDO", "LOURDES": "LULU ODENG", "LUZVIMINDA": "LUZ MINDA", "MANUEL": "MANING MANNY", "MARIA": "MA MARY MARING",
    "MARILOU": "MALOU LOU", "MATEO": "TEO", "MICHAEL": "MIKE MIKEY", "MICHELLE": "MICH", "NICANOR": "NICK KANOR", "NORMA": "NORMS", "PATRICIA": "PAT TRISH", "PERPETUA": "PET", "PHILIP": "PHIL", "REMEDIOS": "MEDING REMY",
    "REYNALDO": "REY NALDO", "RICARDO": "CARDING RICKY", "ROBERTO": "BERT BOBBY OBET", "RODRIGO": "DIGOY ROD", "ROLANDO": "ROLLY LANDO", "RONALD": "RON", "ROSARIO": "CHARING CHARO", "ROWENA": "WENG", "SOLEDAD": "CHOLENG SOL",
    "TEODORO": "DORO TEDDY", "TERESA": "TESS TESSIE", "VERONICA": "NICA VERO", "VICTOR": "VIC", "WILFREDO": "WILLY", "WILHELMINA": "HELMI MINA", "ZENAIDA": "NAIDA", "ZACARIAS": "CARIAS", "DANIEL": "DANNY DAN",
    "EDGARDO": "EDGAR", "ERLINDA": "LINDA", "ISABEL": "YSABEL", "LEONORA": "NORA", "MARGARITA": "MARGIE", "MILAGROS": "MILA", "PEDRO": "PEDRING", "RAMON": "MON", "TOMAS": "TOMMY", "VICENTE": "VIC ENTENG", "VIRGINIA": "VIRGIE",
}
# Spellings of name extensions, of parts with a legal form, and particles that come and go.
EXTENSIONS = {"JR": "JR", "JUNIOR": "JR", "JNR": "JR", "SR": "SR", "SENIOR": "SR", "II": "II", "2ND": "II", "III": "III", "3RD": "III", "111": "III", "IV": "IV", "4TH": "IV"}
LEGAL_FORMS = {"STA": "SANTA", "STO": "SANTO", "THERESA": "TERESA"}
PARTICLES = {"DE", "LA", "LAS", "LOS", "DEL", "DELA", "DELOS", "D", "Y"}

_LETTERS = re.compile(r"[^\W_]+")


class Lexicon:
    """What a country's names need: nicknames of each given name, spellings of extensions, legal forms of parts, particles.

    All are tables that a caller may load from elsewhere; nothing here depends on the records that are compared.
    """

    def __init__(self, nicknames: dict[str, str] = NICKNAMES, extensions: dict[str, str] = EXTENSIONS, legal_forms: dict[str, str] = LEGAL_FORMS, particles: Iterable[str] = PARTICLES):
        self.nicknames, self.extensions, self.legal_forms, self.particles = nicknames, extensions, legal_forms, frozenset(particles)
        self.full: dict[str, frozenset[str]] = {}
        for name, nicks in nicknames.items():
            for nick in nicks.split():
                self.full[nick] = self.full.get(nick, frozenset()) | {name}
        #: Given names in their own right: two of them are two names, however alike they are.
        self.known = frozenset(nicknames) | frozenset(self.full)
        self.long_particles = tuple(p for p in sorted(self.particles) if len(p) > 4)
        self._seen: dict[str, tuple[int, str]] = {}

    def __reduce__(self) -> tuple:
        return Lexicon, (self.nicknames, self.extensions, self.legal_forms, self.particles)

    def formal(self, word: str) -> frozenset[str]:
        """The full names that a word may stand for: itself, or the names of which it is a nickname."""
        return self.full.get(word, frozenset()) | {word}

    def is_particle(self, word: str) -> bool:
        """A particle, a long one also with a typing error after its first letter."""
        return word in self.particles or any(word[:1] == p[0] and distance(word, p, 1) <= 1 for p in self.long_particles)

    def kind(self, word: str) -> tuple[int, str]:
        """What a word of a name is, with the initial of its first formal reading: 0 an extension, 1 an initial, 2 a particle, 3 a full word."""
        if (found := self._seen.get(word)) is None:
            found = 0 if word in self.extensions else 1 if len(word) == 1 else 2 if self.is_particle(word) else 3, min(self.formal(word))[0]
            if len(self._seen) < 200_000:  # a memo, no limit on words
                self._seen[word] = found
        return found


DEFAULT = Lexicon()


@lru_cache(200_000)
def _words(text: str, lexicon: Lexicon) -> tuple[str, ...]:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).upper()
    return tuple(lexicon.legal_forms.get(w, w) for w in _LETTERS.findall(plain.replace("'", "")))


class Name:
    """A typed name as a bag of words: full words in their order, initials, and the extension, wherever it was typed."""

    __slots__ = ("words", "initials", "extension", "particles", "lead", "lexicon")

    def __init__(self, last: str | None, first: str | None, middle: str | None, extension: str | None, lexicon: Lexicon = DEFAULT):
        self.lexicon = lexicon
        self.words: list[str] = []
        self.initials: list[str] = []
        self.extension = ""
        self.particles = ""
        lead: list[str] = []
        for k, text in enumerate((first, last, middle, extension)):
            first_here = True
            for w in _words(text, lexicon) if text else ():
                kind, initial = lexicon.kind(w)
                if kind == 0:
                    self.extension = self.extension or lexicon.extensions[w]
                elif k == 3:
                    continue
                elif kind == 1:
                    self.initials.append(w)
                elif kind == 2:
                    self.particles += w[0]
                    continue
                elif w not in self.words:
                    self.words.append(w)
                if k < 2 and first_here:
                    lead.append(initial)
                    first_here = False
        if len(lead) < 2:
            lead = [lexicon.kind(w)[1] for w in self.words[:2]]
        #: Initials of the given and the family name, in the order of the alphabet.
        self.lead = ".".join(sorted(lead))


def forms(name: Name) -> list[str]:
    """Canonical rewritings of a name, by which its variants meet.

    Token order doesn't count: a form is one word in one formal reading (nicknames written out, legal forms of parts,
    particles left out), or the whole name reduced to the initials of given and family name, which errors inside words
    and missing parts leave alone.
    """
    out = {f for w in name.words for f in name.lexicon.formal(w) if len(f) > 2}
    if name.lead:
        out.add(f"={name.lead}")
    return sorted(out)


@lru_cache(500_000)
def _typo(a: str, b: str) -> bool:
    least = min(len(a), len(b))
    most = 1 if least <= 4 else 2 if least < 9 else 3
    # An edit takes away one letter of a word at most, so letters that the other lacks are a lower bound.
    if abs(len(a) - len(b)) > most or sum(max(0, a.count(c) - b.count(c)) for c in {*a}) > most:
        return False
    return distance(a, b, most) <= most


def compare_names(a: Name, b: Name) -> tuple[int, int, int, bool]:
    """(words that are equal up to nicknames and joins, words equal up to typing errors, initials that fit, contradiction).

    Two different words that the lexicon knows as names are no typing error of each other.
    """
    lexicon = a.lexicon
    formal, full, known = lexicon.formal, lexicon.full, lexicon.known
    x, y = list(a.words), list(b.words)
    same = typo = initial = 0
    for w in list(x):
        if w in y:
            x.remove(w)
            y.remove(w)
            same += 1
    for w in list(x):
        for v in y:
            if formal(w) & formal(v):
                x.remove(w)
                y.remove(v)
                same += 1
                break
    for one, two in ((x, y), (y, x)):  # several words typed as one
        for w in [w for w in one if len(w) > 5] if two else ():
            joined = {v + u: (v, u) for v in two for u in two if v is not u and abs(len(v) + len(u) - len(w)) < 2}
            parts = joined.get(w) or next((p for j, p in joined.items() if len(w) > 7 and _typo(j, w)), None)
            if not parts and len(w) > 7:
                parts = [v for v in two if len(v) > 3 and v in w or v in full and any(len(f) > 3 and f in w for f in full[v])]
            if parts:
                one.remove(w)
                for v in parts:
                    two.remove(v)
                same += len(parts)
    for w in list(x):
        names = full.get(w)
        for v in y:
            if _typo(w, v) and not (w in known and v in known) or v not in known and names and any(_typo(f, v) for f in names) or w not in known and v in full and any(_typo(w, f) for f in full[v]):
                x.remove(w)
                y.remove(v)
                typo += 1
                break
    contradiction = False
    left_a, left_b = list(a.initials), list(b.initials)
    for i in list(left_a):
        if i in left_b:
            left_a.remove(i)
            left_b.remove(i)
    for initials, words, particles in ((left_a, y, b.particles), (left_b, x, a.particles)):
        for i in initials:
            if i in particles:
                continue
            fits = [w for w in words if any(f.startswith(i) for f in formal(w))]
            if fits:
                words.remove(fits[0])
                initial += 1
            elif [w for w in words if len(w) > 2]:
                contradiction = True
    if [w for w in x if len(w) > 2] and [w for w in y if len(w) > 2]:
        contradiction = True
    if a.extension and b.extension and a.extension != b.extension:
        contradiction = True
    return same, typo, initial, contradiction


_ISO = re.compile(r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*$")
_SLASH = re.compile(r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4})\s*$")
_YEAR = re.compile(r"^\s*(\d{4})\s*$")


def parse_birth(iso: str | None) -> tuple[int, int, int] | None:
    """(year, month, day), 0 where a part isn't given; None for nothing, a filler or text."""
    if not iso:
        return None
    if m := _ISO.match(iso):
        y, mo, d = map(int, m.groups())
    elif m := _SLASH.match(iso):
        mo, d, y = map(int, m.groups())
    elif m := _YEAR.match(iso):
        y, mo, d = int(m[1]), 0, 0
    else:
        return None
    return None if (y, mo, d) == (1900, 1, 1) or y < 1850 else (y, mo, d)


def births_agree(a: tuple[int, int, int] | None, b: tuple[int, int, int] | None) -> int:
    """2 equal, 1 unlike in a way of typing errors, 0 unknown, -1 less than 13 years apart, -2 further."""
    if a is None or b is None:
        return 0
    if a == b:
        return 2
    far = -1 if abs(a[0] - b[0]) < 13 else -2
    if not (a[1] and b[1]):
        return 1 if a[0] == b[0] else far
    if a[0] == b[0] and {a[1], a[2]} == {b[1], b[2]}:
        return 1
    off = 0
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            step = abs(x - y)
            close = step == 1 or step % 10 == 0 or sorted(str(x)) == sorted(str(y)) or (k == 0 and sum(p != q for p, q in zip(str(x), str(y))) == 1)
            off += 1 if close else 2
    return 1 if off <= 2 else far


def births_near(a: tuple[int, int, int] | None, b: tuple[int, int, int] | None) -> bool:
    """Unlike in one digit, or with month and day exchanged; the year or the day of the year is kept."""
    if births_agree(a, b) != 1 or not (a[0] == b[0] or a[1:] == b[1:]):
        return False
    if a[0] == b[0] and a[1:] == b[2:0:-1]:
        return True
    x, y = ("%04d%02d%02d" % d for d in (a, b))
    return sum(p != q for p, q in zip(x, y)) == 1


def contacts_near(a: str, b: str) -> bool:
    """Ten-digit contacts of which one half is equal and the other differs in one or two digits."""
    if len(a) != 10 or len(b) != 10 or a == b or a[:5] != b[:5] and a[5:] != b[5:]:
        return False
    return sum(x != y for x, y in zip(a, b)) <= 2


@lru_cache(200_000)
def birth_parts(birth: str) -> tuple[str, str]:
    """The year of a birth date and its day of the year, '' where they aren't given; of two births that are near, one is equal."""
    b = parse_birth(birth)
    return (str(b[0]), f"{b[1]}.{b[2]}" if b[1] and b[2] else "") if b else ("", "")


def contact_key(digits: str | None) -> str:
    """The last ten digits of a contact; '' for fewer, or all alike."""
    d = re.sub(r"[^0-9]", "", digits or "")[-10:]
    return d if len(d) == 10 and len(set(d)) > 1 else ""


def sex_key(sex: str | None) -> str:
    return (sex or "").strip()[:1].upper()


def one_person(a: Name, b: Name, birth: int, contact: bool, place: bool, sex: bool, near: bool = False) -> bool:
    """Whether two records with these agreements are one person.

    At least two of birth date, contact and place must agree, birth dates and sexes must not differ, and the names must
    not contradict: some words equal (or, with typing errors, two), and the given name among what fits. If birth dates
    or contacts are ``near``, one agreement is enough for names of two equal words.
    """
    agreements = (birth == 2) + contact + place
    if birth < -1 or not sex or agreements < 2 and not (near and agreements):
        return False
    same, typo, initial, contradiction = compare_names(a, b)
    if agreements < 2:
        return not contradiction and same >= 2
    return not contradiction and (same + typo >= 2 or (same + typo >= 1 and initial >= 1 and birth >= 0))
