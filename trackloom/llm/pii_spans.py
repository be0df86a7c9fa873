"""Candidate spans for personal details and the votes of the labelers on them.

Every e-mail shape, every run of digits, every house number beside a street word and every run of capitalised words is a candidate;
members' names, which by definition are no details, are the only ones left out. Each labeler votes for (1), against (-1) or not at
all (0). Its knowledge is general: shapes, titles, single cue words, gazetteers of members and their given names. Context is read in
words, without interjections in brackets; inside brackets, only words of the same brackets are context.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

KINDS = ("email", "phone", "id_number", "address", "person")
EMAIL_KIND, PHONE_KIND, ID_KIND, ADDRESS_KIND, PERSON_KIND = range(5)
#: Labelers per kind, in order: form, gazetteer, words before, words after, other details nearby.
LABELERS = 5
#: Slots of hashed features and slots per candidate; slot 0 stays empty.
FEATURES, WIDTH = 1 << 14, 18


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Shapes.
_GAP = "[ \u00a0\u2007\u2009\u202f]"
_UP = "A-ZÀ-ÖØ-Þ"
_CAP = rf"[{_UP}][\w’'-]*"
EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*\s?(?:@|[(\[]\s?at\s?[)\]])\s?[A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)[A-Za-z0-9-]+)+",
    re.I,
)
_AT = ("@", "at)", "at]", "at )", "at ]", "AT)", "AT]", "AT )", "AT ]")
_STEP = rf"(?:{_GAP}?[/.-]?(?:{_GAP}|\n)?)"
# A number from its first digit; what may stand before it; one that mixes letters and digits.
DIGITS = re.compile(r"[0-9]+")
# Numbers worth a look: five digits in a row, several groups, letters and digits in turn, a street word or the end of one before,
# or a word in capitals or a street word next.
WORTHWHILE = re.compile(
    rf"[0-9](?<![0-9][0-9])(?:(?<=(?:aße|tr\.|sse|weg|Weg|lee|atz|ing|amm|fer|eig)\s.)|"
    rf"[0-9]*(?:(?<=[0-9]{{5}})|\)?(?:{_GAP}[/.-]?|[/.-]|\n)(?:{_GAP}|\n)?\(?[0-9]|[A-Z][0-9]|[A-Za-z]?(?:\s(?:bis|ter|quater))?,?\s(?:[{_UP}]|(?:rue|avenue|av\.|place|impasse|chemin|quai|boulevard|bd|allée|cours|square|route|passage)\s)))"
)
# Words before a name after which a house number may stand; a text that has one is searched from each number.
NUMBER_LAST_WORDS = (
    "calle ", "Calle ", "avenida ", "Avenida ", "avda", "Avda", "av. ", "Av. ", "plaza ", "Plaza ", "paseo ", "Paseo ", "camino ", "Camino ", "c/", "ronda ",
    "Ronda ", "travesía ", "Travesía ", "carrera ", "Carrera ", "Am ", "An der ", "Auf der ", "Im ", "In der ", "Zum ", "Zur ", "Beim ", "Hinter der ", "Unter den ",
)
NUMBER = re.compile(rf"\d+\)?(?:{_STEP}\(?\d+\)?)*(?:{_GAP}?-?[A-Z]\b)?(?!\w)")
LETTERS = re.compile(rf"(?<![\w@.+/-])[A-Z]{{1,3}}{_GAP}?\Z")
MIXED = re.compile(r"[A-Z]\d+[A-Z][A-Z\d]*\d[A-Z\d]*(?!\w)")
PHONE_SHAPE = re.compile(
    rf"(?:\+|00)\d[\d() ./\-\u00a0\u2007\u2009\u202f\n]{{6,}}|\(?0\d{{1,4}}\)?(?:{_GAP}|[/.-])*\d{{2,4}}(?:(?:{_GAP}|[.-])?\d{{2,4}}){{0,3}}|"
    r"(?:\(\d{3}\) ?|\d{3}[-. ])?\d{3}-\d{4}"
)
DIALLED = re.compile(r"\+|00\d|\(?0\d")
ID_SHAPE = re.compile(
    rf"\d{{6}}-\d{{4}}|\d\d/\d{{3}}/\d{{5}}|\d{{11}}|\d{{3}}{_GAP}\d{{3}}{_GAP}\d{{3}}{_GAP}\d\d|\d{{3}}-\d\d-\d{{4}}|"
    rf"[A-Z]{{1,3}}{_GAP}?\d{{2}}{_GAP}?\d{{2}}{_GAP}?\d{{2}}{_GAP}?[A-Z]?|[A-Z]{{1,3}}\d{{6,9}}-?[A-Z]?|[A-Z]{{2}}\d{{4}}-\d{{4}}-\d\d|[A-Z]\d[A-Z\d]{{4,}}"
)
YEAR_PAPER = re.compile(r"(?:19|20)\d\d-\d")
STREET_EN = (
    r"(?:(?:St|Rd|Ln|Ave|Ter|Cres|Dr|Ct|Sq|Pl|Gdns)\b\.?|"
    r"(?:Street|Road|Lane|Avenue|Close|Terrace|Crescent|Drive|Way|Court|Square|Place|Gardens|Row|Hill|Grove|Walk|Mews|Park)\b)"
)
STREET_FR = r"(?:rue|avenue|av\.|place|impasse|chemin|quai|boulevard|bd|allée|cours|square|route|passage)"
STREET_ES = r"(?:calle|avenida|avda\.?|av\.|plaza|paseo|camino|c/|ronda|travesía|carrera)"
STREET_DE = r"(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig)"
# From a house number on: number first (English, French). Up to a house number: number last (German, Spanish).
NUMBER_FIRST = re.compile(
    rf"\d+[A-Za-z]?(?:\s(?:bis|ter|quater))?,?\s(?:(?:{_CAP}\s){{1,3}}?{STREET_EN}|"
    rf"{STREET_FR}\s(?:(?:de\sla|de|du|des)\s|de\sl['’]|d['’])?{_CAP}(?:[ -]{_CAP})*)"
)
NUMBER_LAST = re.compile(
    rf"(?<!\w)(?:(?:{STREET_ES}|{STREET_ES.title()})\s?(?:(?:de\sla|del|de\slos|de\slas|de)\s)?{_CAP}(?:\s{_CAP})*,?\s(?:(?:n\.?[º°]|núm\.?|nº)\s?)?|"
    rf"[{_UP}][\w-]*?[a-zß]{STREET_DE}\s|{_CAP}[\s-]{STREET_DE.title()}\s|"
    rf"(?P<am>(?:Am|An der|Auf der|Im|In der|Zum|Zur|Beim|Hinter der|Unter den)\s(?:{_CAP}\s)?{_CAP}\s))\Z"
)
HOUSE_END = re.compile(r"[A-Za-z]?(?!\w)")
_BLANKS = " \u00a0\u2007\u2009\u202f"
_FR_STARTS = frozenset(w[0] for w in "rue avenue place impasse chemin quai boulevard allée cours square route".split())
_YEAR = re.compile(r"(?:1[5-9]|20)\d\d\Z")

# Words, in English, German, French and Spanish.
TITLES = _words(
    "mr mrs ms miss mister dr prof professor sir lady lord dame herr herrn frau fräulein mme mlle monsieur madame mademoiselle "
    "sr sra srta señor señora señorita don doña"
)
PARTICLES = _words("de la las los le del della der den dem von van vom zu zur zum da di du des dos ten ter al bin ibn")
# Particles that hardly stand anywhere but in names.
NAME_LINKS = _words("van della di dos ter bin ibn")
FUNCTION = _words(
    "mine ours meine meinen meiner meinem seine seiner unsere unserer unser ihre ihrer mes tes nos vos leur leurs mis sus nuestra nuestro "
    "the a an this that these those i we you he she it they my our your his her its their what when where who why how if and or but "
    "of in on at to from for by with as no not every each all any some let so yes after before since until "
    "der die das den dem des ein eine einen einem einer jede jeder jedes jene jener diese dieser ich wir sie er es ihr man mein unser "
    "was wann wer wo wie wenn und oder aber von vom zu zum zur im in am an auf aus bei mit nach unter über für laut seit als ob doch siehe kein keine "
    "le la les un une des ce cette ces je nous vous il elle ils elles on notre votre son sa ses mon ma que qui quand où si et ou mais "
    "du de en au aux à sur sous pour par avec dans selon depuis chaque "
    "el los las una unos unas este esta esto esos esas yo nosotros usted él ella ellos ellas su sus mi qué que quien cuando donde si y o pero "
    "del al con sin por para según desde cada se"
)
DETERMINERS = _words(
    "the this that every each no der die das den dem des ein eine einen einem einer jede jeder jedes diese dieser dieses jene jener jenes "
    "le la les un une ce cette ces chaque el los las una este esta cada ese esa"
)
PLACE_WORDS = _words("in near bei près cerca")
INSTITUTIONS = _words(
    "committee council act house chamber board ministry minister office department opposition treasury bill court party commission authority "
    "agency member members chair speaker officer president secretary government parliament assembly university school hospital clinic bank "
    "company group union institute paper item petition docket room clause section report "
    "street road lane avenue square bridge river park city town county valley harbour station "
    "ausschuss haus rat gemeinde behörde regierung landesregierung fraktion gesetz minister ministerin präsident präsidentin abgeordnete "
    "abgeordneter abgeordneten kollege kollegin kommission opposition rechnungshof beirat vorlage antrag sitzung petition nummer drucksache titel "
    "paragraf seiten unterlagen straße platz stadt damm spital steinbruch bahn umgehung "
    "comité conseil loi assemblée ministre président présidente trésor commission opposition parlement ville région rue clinique document pétition "
    "consejo ley congreso cámara ministro ministra presidente presidenta tesoro comisión oposición parlamento villa región calle "
    "documento petición partida clínica"
)
PERSON_BEFORE = _words(
    "name names named called signed signature signatory from met meet saw knew know told tell ask asked thank wrote constituent constituents neighbour "
    "neighbours neighbor neighbors widow widower son daughter father mother brother sister wife husband patient tenant resident client victim witness friend "
    "colleague owner behalf interview quote by "
    "namen namens unterschrift unterzeichnet traf treffen fragen frage fragte sagte nachbar nachbarin nachbarn witwe witwer sohn tochter "
    "mutter vater bruder schwester mieter mieterin bewohner bewohnerin kunde kundin zeuge zeugin patientin freund freundin zuruf bürger bürgerin "
    "nom nommé nommée signé signature rencontré demander demandez demandé voisin voisine voisins veuve veuf fils fille père mère frère sœur patiente "
    "locataire client cliente témoin appelé appelée ami amie "
    "nombre llamado llamada firma firmado firmada conocí preguntar pregunten pregunte vecino vecina vecinos viuda viudo hijo hija padre "
    "madre hermano hermana paciente inquilino inquilina clienta testigo amigo amiga"
)
PERSON_AFTER = _words(
    "wrote writes lives lived said says told tells called calls phoned asked asks waits waited waiting reached whose who tenant born aged "
    "died ill complained resident works worked came left gallery "
    "schrieb schreibt wohnt wohnte wohnhaft sagte sagt wartet wartete erreichbar geboren starb erkrankt deren dessen klagte rief kam tribüne "
    "écrit habite habitait domicilié domiciliée dit attend attendait répond né née âgé âgée dont mort morte vit téléphoné tribune "
    "escribió escribe vive vivía domicilio dijo dice espera lleva atiende nacido nacida cuyo cuya murió llamó tribuna"
)
PHONE_WORDS = _words(
    "call calls called ring rang phone phoned telephone tel fax mobile cell dial reached unter erreichbar telefon telefonnummer anrufen anruf handy "
    "appeler appelez répond téléphone portable joindre llamar llame atiende teléfono móvil"
)
ID_WORD = re.compile(
    r"(?:insurance|identity|passport|tax|social|licen[cs]e|ausweis|pass|steuer|versicherung|reisepass|fiscal|identité|passeport|sécurité|"
    r"identidad|pasaporte|seguridad|seguro|dni|nif|ssn)"
)
NUMBER_WORDS = _words("card no nr number nummer numéro número n id document documento de del")
PAPER_WORDS = _words(
    "paper petition docket amendment item clause section route room vote page pages letter letters file case invoice order drucksache titel raum abschnitt paragraf "
    "aktenzeichen seiten document documento pétition ligne article dossier petición partida artículo enmienda expediente página páginas"
)
EMAIL_WORDS = _words("from to at or via mail email e-mail address write und von oder unter an de à ou adresse desde o en a correo escriba")
ADDRESS_WORDS = _words("at of in live lives lived unter wohnhaft wohnt wohne au domicilié domiciliée habite en domicilio a from nach to address anschrift adresse dirección vive vivo destiné enviado")
DOMAIN_ENDS = _words("example invalid test com org net edu gov eu de fr es uk info io")

_TOKEN = rf"[{_UP}](?:(?:rs?|s|rof|ra|rta)?\.|[\w’'-]*)"
_LINK = r"\s(?:(?:de|del|della|der|den|la|las|los|von|van|zu|da|di|du|des|dos|ten|ter)\s){0,2}(?:d['’])?"
# A capitalised word and more of them; what may stand right before it is looked at afterwards, so that the search can skip ahead.
_OPENING = r"(?!(?:(?<=T)h(?:e|is)|(?<=D)(?:er|ie|as|en)|(?<=E)l|(?<=L)[ae]s?|(?<=J)ede[rs]?|(?<=I)[nm]?|(?<=C)haque|(?<=N)o)\s)"
RUN = re.compile(rf"[{_UP}]{_OPENING}(?:(?:rs?|s|rof|ra|rta)?\.|[\w’'-]*)(?:{_LINK}{_TOKEN})+(?![\w@])")
COMMA_NAME = re.compile(rf",\s({_CAP})(\s[{_UP}]\.)?(?![\w@])")
_LAST_WORD = re.compile(rf"(?<![\w@.’'-]){_CAP}\Z")
_PART = re.compile(r"\S+")
_INITIAL = re.compile(r"[^\W\d_]\.")
_WORD = re.compile(r"\w(?:[\w’'-]*\w)?")
_ASIDE = re.compile(r"[(\[][^()\[\]]*[^\W\d_]{4}[^()\[\]]*[)\]]")
_SENTENCE_END = re.compile(r"[.!?:]['’\"»”)\]]*\s+$|\n\s*$|^\s*$|[(\[—–-]\s*$")
_SPEAKER = re.compile(r"\s*(?:\([^()\n]{0,24}\)\s*)?:")


@lru_cache(maxsize=1 << 16)
def plain(name: str) -> str:
    """Without case, accents and blanks at the ends."""
    text = unicodedata.normalize("NFKD", name).casefold()
    return "".join(c for c in text if not unicodedata.combining(c)).strip(" .,")


@lru_cache(maxsize=1 << 17)
def slot(text: str) -> int:
    return 1 + zlib.crc32(text.encode()) % (FEATURES - 1)


@dataclass(frozen=True)
class Gazetteer:
    """Members by family name, and given names."""

    families: dict[str, frozenset[str]] = field(default_factory=dict)
    given: frozenset[str] = frozenset()

    @staticmethod
    def of(names: list[str]) -> Gazetteer:
        families: dict[str, set[str]] = {}
        given: set[str] = set()
        for name in names:
            parts = plain(name).split()
            if parts:
                families.setdefault(parts[-1], set()).update(parts[:-1] or [""])
                given.update(p for p in parts[:-1] if len(p) > 1)
        return Gazetteer({f: frozenset(g) for f, g in families.items()}, frozenset(given))

    def is_member(self, given: str, family: str) -> bool:
        """In any spelling: initials, without accents, in capitals."""
        known = self.families.get(plain(family))
        if known is None:
            return False
        g = plain(given)
        return not g or any(k == g or (len(g) == 1 and k[:1] == g) for k in known)


@dataclass(slots=True)
class Candidate:
    """family: of a person, in plain form. mention: a family name alone, which counts if a person of that family is found."""

    kind: int
    start: int
    end: int
    votes: tuple[int, ...]
    features: list[int]
    family: str = ""
    mention: bool = False


# The end of a sentence; not after an initial, a title or an abbreviation of up to three letters.
_STOP = re.compile(r"[^\W\d_]{4}[.!?]['’\"»”]*\s")


def words_before(text: str, start: int, count: int = 4) -> list[str]:
    """Up to `count` words of the same sentence before a place, in lower case, nearest last."""
    size = 48
    while True:
        part, whole = text[max(0, start - size) : start], start <= size
        if "(" in part or ")" in part or "[" in part or "]" in part:
            part = _ASIDE.sub(" ", part)
            opened = max(part.rfind("("), part.rfind("["))
            if opened > max(part.rfind(")"), part.rfind("]")):
                part, whole = part[opened:], True
            elif not whole and (")" in part or "]" in part) and size < 4096:
                size *= 2
                continue
        stops = [m.end() for m in _STOP.finditer(part)]
        if stops:
            part, whole = part[stops[-1] :], True
        words = _WORD.findall(part)
        if whole or len(words) > count:
            return [w.lower() for w in words[-count:]]
        size *= 2


def words_after(text: str, end: int, count: int = 4) -> list[str]:
    size = 48
    while True:
        part, whole = text[end : end + size], end + size >= len(text)
        if "(" in part or ")" in part or "[" in part or "]" in part:
            part = _ASIDE.sub(" ", part)
            closed = [i for i in (part.find(")"), part.find("]")) if i >= 0]
            opened = [i for i in (part.find("("), part.find("[")) if i >= 0]
            if closed and (not opened or min(closed) < min(opened)):
                part, whole = part[: min(closed)], True
            elif opened and not whole and size < 4096:
                size *= 2
                continue
        if stop := _STOP.search(part):
            part, whole = part[: stop.end()], True
        words = _WORD.findall(part)
        if whole or len(words) > count:
            return [w.lower() for w in words[:count]]
        size *= 2


_SHAPES = {i: "9" if chr(i).isdigit() else "A" if chr(i).isupper() else "a" for i in range(0x250) if chr(i).isalnum()}


def _shape(found: str) -> str:
    """Digits as 9, capitals as A, other letters as one a."""
    shape = found[:24].translate(_SHAPES)
    while "aa" in shape:
        shape = shape.replace("aa", "a")
    return shape


class Reader:
    """Finds the candidates of one text after another."""

    def __init__(self, gazetteer: Gazetteer):
        self.gazetteer = gazetteer

    def candidates(self, text: str | None) -> list[Candidate]:
        if not text:
            return []
        self.text, self.found, self.taken, self.runs = text, [], [], []
        if any(a in text for a in _AT):
            self._emails()
        self._numbers()
        self.details = sorted(self.taken)
        self._people()
        if self.runs:
            self._judge_numbers()
        return self.found

    def _free(self, start: int, end: int) -> bool:
        return all(e <= start or end <= s for s, e in self.taken)

    def _add(self, kind: int, start: int, end: int, votes: tuple[int, ...], before: list[str], after: list[str], family: str = "", first: str = "") -> None:
        name = KINDS[kind]
        f = [slot(f"{name}|bias"), slot(f"{name}|votes|{votes}")]
        f += [slot(f"{name}|vote{i}|{v}") for i, v in enumerate(votes)]
        f += [slot(f"{name}|left|{w}") for w in before[-3:]] + [slot(f"{name}|right|{w}") for w in after[:3]]
        if before:
            f.append(slot(f"{name}|last|{before[-1]}"))
        if after:
            f.append(slot(f"{name}|next|{after[0]}"))
        f.append(slot(f"{name}|shape|{_shape(self.text[start:end])}"))
        if first:
            f.append(slot(f"{name}|first|{first}"))
        self.found.append(Candidate(kind, start, end, votes, (f + [0] * WIDTH)[:WIDTH], family))

    def _around(self, start: int, end: int) -> tuple[list[str], list[str]]:
        return words_before(self.text, start), words_after(self.text, end)

    def _emails(self) -> None:
        for m in EMAIL.finditer(self.text):
            before, after = self._around(*m.span())
            known = re.split(r"[.\s)\]]+", m[0])[-1].lower() in DOMAIN_ENDS
            self._add(EMAIL_KIND, m.start(), m.end(), (1, int(known), int(bool(before) and before[-1] in EMAIL_WORDS), 0, 0), before, after)
            self.taken.append(m.span())

    def _numbers(self) -> None:
        """From each first digit: a house number beside a street, or a number of five digits or more."""
        text, done = self.text, 0
        every = False
        for word in NUMBER_LAST_WORDS:
            if word in text:
                every = True
                break
        for m in (DIGITS if every else WORTHWHILE).finditer(text):
            at = m.start()
            if at < done:
                continue
            left, stop = text[at - 1] if at else " ", m.end()
            if not every:
                stop = DIGITS.match(text, at).end()
            if left.isalpha() or left in "_@.":
                if not left.isupper() or self._mixed(at) or not LETTERS.search(text, max(0, at - 5), at):
                    continue
            elif left.isspace() or left in "([":
                if end := self._address(at, stop):
                    done = end
                    continue
            if stop - at < 5 and not any(c in "0123456789" for c in text[stop : stop + 4]) and not left.isupper():
                continue
            shape = NUMBER.match(text, at)
            if shape is None:
                continue
            start, end = at, shape.end()
            if left in "+(":
                start -= 1
            elif left.isupper() or left in _BLANKS:
                letters = LETTERS.search(text, max(0, at - 5), at)
                start = letters.start() if letters else at
            if start and (text[start - 1].isalnum() or text[start - 1] in "_@.+/-"):
                continue
            if text[at:end].isdigit() and end - at < 5:
                continue
            self._number(start, end)
            done = end

    def _mixed(self, at: int) -> bool:
        """Letters and digits in turn, such as C01X00T47."""
        m = MIXED.match(self.text, at - 1)
        if m and not (at > 1 and (self.text[at - 2].isalnum() or self.text[at - 2] in "_@.+/-")) and sum(c.isdigit() for c in m[0]) > 3:
            self._number(at - 1, m.end())
            return True
        return False

    def _address(self, at: int, stop: int) -> int:
        text = self.text
        start, end, street = at, 0, None
        after = text[stop : stop + 16].lstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ,")[:8].lstrip()
        if after and (after[0].isupper() or after[0] in _FR_STARTS or after[:3] in ("bis", "ter")):
            street = NUMBER_FIRST.match(text, at)
        if street:
            end = street.end()
        else:
            back = text.rfind(" ", max(0, at - 32), at - 1) + 1
            word = text[back : at - 1]
            if word and (word[0].isupper() or word[-1] in ".,º°" or word[0] == "c") and word[-1] not in "?!:;" and at - stop < 6:
                house, street = HOUSE_END.match(text, stop), NUMBER_LAST.search(text, max(0, at - 64), at)
                if street and house:
                    start, end = street.start(), house.end()
        if not street or not self._free(start, end):
            return 0
        before, after = self._around(start, end)
        paper = before and before[-1] in PAPER_WORDS
        vague = start < at and street["am"] is not None if street.re is NUMBER_LAST else False
        kind = -1 if paper or (vague and _YEAR.match(text[at:stop])) else 0 if vague else 1
        self._add(ADDRESS_KIND, start, end, (1, kind, int(any(w in ADDRESS_WORDS for w in before[-2:])), 0, 0), before, after)
        self.taken.append((start, end))
        return end

    def _number(self, start: int, end: int) -> None:
        run = self.text[start:end]
        digits = sum(c.isdigit() for c in run)
        if digits < 5 and not run[0].isalpha() or digits < 4 or not self._free(start, end):
            return
        if run.startswith("(") and ")" not in run:
            start, run = start + 1, run[1:]
        if run.endswith(")") and "(" not in run:
            end, run = end - 1, run[:-1]
        letters = run[0].isalpha()
        phone = -1 if letters or not 7 <= digits <= 15 else 1 if PHONE_SHAPE.fullmatch(run) else 0
        identity = 1 if ID_SHAPE.fullmatch(run) else 0 if digits >= 6 else -1
        self.runs.append((start, end, phone, identity))
        if phone == 1 or identity == 1:
            self.taken.append((start, end))

    def _judge_numbers(self) -> None:
        """Votes on the numbers, once names and other details are known."""
        self.details = sorted([(c.start, c.end) for c in self.found if c.kind in (EMAIL_KIND, ADDRESS_KIND) or (c.kind == PERSON_KIND and not c.mention and c.votes[0] >= 0)])
        for start, end, phone, identity in self.runs:
            run, near = self.text[start:end], self._near(start, end)
            before, after = self._around(start, end)
            letters, dialled = run[0].isalpha(), 1 if DIALLED.match(run) else 0
            named = [w for w in before if w not in NUMBER_WORDS][-1:]
            paper = bool((named and named[0] in PAPER_WORDS) or (before and before[-1] in PAPER_WORDS and before[-1] not in NUMBER_WORDS) or YEAR_PAPER.match(run))
            is_id = not paper and any(ID_WORD.match(w) or (len(w) > 6 and ID_WORD.search(w)) for w in before)
            said = not paper and any(w in PHONE_WORDS for w in before)
            self._add(PHONE_KIND, start, end, (phone, dialled if phone == 1 else -1 if letters else 0, -1 if paper or is_id else int(said), 0, near), before, after)
            self._add(ID_KIND, start, end, (identity, -1 if dialled and identity < 1 else 0, 1 if is_id else -1 if paper or said else 0, 0, near), before, after)

    def _near(self, start: int, end: int) -> int:
        """Whether another detail stands in the same sentence."""
        for s, e in self.details:
            a, b = (e, start) if e <= start else (end, s)
            if 0 <= b - a <= 120 and not re.search(r"[.!?]\s+[^\W\d_]{2}", self.text[a:b] + " "):
                return 1
        return 0

    def _people(self) -> None:
        text, given = self.text, self.gazetteer.given
        spans: list[tuple[int, int, str, str, bool, bool]] = []  # start, end, given, family, form, more like a noun
        for m in COMMA_NAME.finditer(text):
            last, first = _LAST_WORD.search(text, max(0, m.start() - 64), m.start()), m[1]
            if last is None or (first.lower() in FUNCTION and (first.isupper() or plain(first) not in given)):
                continue
            prior = _LAST_WORD.search(text, max(0, last.start() - 32), max(0, last.start() - 1))
            if prior and text[last.start() - 1].isspace() and last[0].isupper() and prior[0].isupper() and prior[0].lower() not in TITLES:
                continue  # 'ANNA KELLER, ...'
            known, loud = plain(first) in given, len(last[0]) > 1 and last[0].isupper() and not first.isupper()
            if known or loud:
                spans.append((last.start(), m.end(), first, last[0], True, False))
        commas = len(spans)
        for m in RUN.finditer(text):
            glued = m.start() > 0 and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_@.’'-")
            if spans and any(s < m.end() and m.start() < e for s, e, *_ in spans[:commas]):
                continue
            words = m[0].split()
            if len(words) == 2 and (glued or (words[0].lower() in FUNCTION or words[1].lower() in FUNCTION) and plain(words[0]) not in given):
                continue
            parts = [(p.start() + m.start(), p[0]) for p in _PART.finditer(m[0])]
            spans += self._in_run(parts[1:] if glued else parts)
        seen: dict[str, list[tuple[int, int]]] = {}
        members = self.gazetteer.is_member
        for start, end, first, family, form, noun in spans:
            if not self._free(start, end) or members(first, family):
                continue
            before, after = self._around(start, end)
            official = not INSTITUTIONS.isdisjoint(text[start:end].lower().replace(",", " ").split())
            form_vote = -1 if noun or official else 1 if form else 0
            known = int(plain(first) in given)
            cue = -1 if before and (before[-1] in DETERMINERS or before[-1] in PLACE_WORDS) else 1 if any(w in PERSON_BEFORE for w in before) else 0
            tail = -1 if _SPEAKER.match(text, end) else 1 if any(w in PERSON_AFTER for w in after) else 0
            key = plain(family)
            self._add(PERSON_KIND, start, end, (form_vote, known, cue, tail, self._near(start, end)), before, after, key, plain(first))
            if not official:
                seen.setdefault(key, []).append((start, end))
                seen.setdefault("", []).append((start, end))
        for key in seen:
            if key:
                self._mentions(key, {text[s:e] for s, e in seen[key]}, seen[""])

    def _in_run(self, parts: list[tuple[int, str]]) -> list[tuple[int, int, str, str, bool, bool]]:
        """Name-shaped spans of a run of capitalised words, cut at titles and function words."""
        text, given = self.text, self.gazetteer.given
        loud = len(parts) > 3 and all(w.isupper() for _, w in parts if w[0].isupper())
        if not loud and all(w.isupper() for _, w in parts if len(w) > 2):
            i, j = parts[0][0], parts[-1][0] + len(parts[-1][1])
            near = [w for w in _WORD.findall(text[max(0, i - 40) : i])[1:][-3:] + _WORD.findall(text[j : j + 40])[:3] if len(w) > 1 and w.isalpha()]
            loud = len(near) > 0 and all(w.isupper() for w in near)
        segments: list[tuple[bool, list[tuple[int, str]]]] = []
        titled, own = False, []
        for at, word in parts:
            low = word.rstrip(".").lower()
            if low in TITLES and word[0].isupper() and len(low) > 1:
                segments.append((titled, own))
                titled, own = True, []
            elif word[0].isupper() and low in FUNCTION and not _INITIAL.fullmatch(word) and (loud or not (low in given or (own and low in PARTICLES and not own[-1][1][0].islower()))):
                segments.append((titled, own))
                titled, own = False, []
            else:
                own.append((at, word))
        segments.append((titled, own))
        out = []
        for titled, own in segments:
            while own and own[0][1][0].islower():
                own = own[1:]
            while own and (own[-1][1][0].islower() or own[-1][1].lower() in PARTICLES):
                own = own[:-1]
            if own:
                out += self._loud(titled, own) if loud else self._quiet(titled, own)
        return out

    def _loud(self, titled: bool, own: list[tuple[int, str]]) -> list:
        """In a text of capitals: what stands after a title, an initial or a known given name."""
        out, i, given = [], 0, self.gazetteer.given
        while i < len(own):
            word = own[i][1]
            first = _INITIAL.fullmatch(word) is not None or plain(word) in given
            if first and i + 1 < len(own):
                last = i + 2 if _INITIAL.fullmatch(own[i + 1][1]) and i + 2 < len(own) else i + 1
                out.append((own[i][0], own[last][0] + len(own[last][1]), word, own[last][1], _INITIAL.fullmatch(word) is not None or (titled and i == 0), False))
                i = last
            elif titled and i == 0:
                out.append((own[0][0], own[0][0] + len(word), "", word, True, False))
            i += 1
        return out

    def _quiet(self, titled: bool, own: list[tuple[int, str]]) -> list:
        text, given = self.text, self.gazetteer.given
        article = False
        if not titled:
            before = text[max(0, own[0][0] - 12) : own[0][0]].split()
            last = before[-1].lower() if before else ""
            article = last in DETERMINERS and text[own[0][0] - 1 : own[0][0]].isspace()
            if article and len(own) > 2 and plain(own[0][1]) not in given:
                own, article = own[1:], False
            while len(own) > 1 and (own[0][1].lower() in INSTITUTIONS or (len(own) > 2 and own[0][1].lower() in PERSON_BEFORE)):
                own = own[1:]
            while own and own[0][1][0].islower():
                own = own[1:]
            if not own:
                return []
            if plain(own[0][1]) not in given and not _INITIAL.fullmatch(own[0][1]) and _SENTENCE_END.search(text[max(0, own[0][0] - 8) : own[0][0]]):
                later = [i for i in range(1, len(own) - 1) if plain(own[i][1]) in given]
                own = own[later[0] :] if later else own
        if own[0][1] == "M." and not titled and self._monsieur(own):
            titled, own = True, own[1:]
        spans = [own]
        links = [i for i, (_, w) in enumerate(own) if w[0].islower()]
        if links and plain(own[0][1]) not in given and not titled:
            tail = own[links[-1] + 1 :]
            named = len(tail) > 1 and (_INITIAL.fullmatch(tail[0][1]) is not None or plain(tail[0][1]) in given)
            spans = [tail] if named else [own, tail]
        out = []
        for s in spans:
            capital = [w for _, w in s if w[0].isupper()]
            if len(capital) < 2 and not titled:
                continue
            if _INITIAL.fullmatch(s[-1][1]):
                s = s[:-1]
                capital = capital[:-1]
                if len(capital) < 2 and not titled or not s:
                    continue
            if titled and len(capital) == 1 and capital[0].lower() in INSTITUTIONS:
                continue
            first = capital[0] if len(capital) > 1 else ""
            initial = any(_INITIAL.fullmatch(w) for w in capital)
            end = s[-1][0] + len(s[-1][1])
            # A noun and a place, such as 'coast of X', look the same as a name with a particle.
            place = not titled and not initial and sum(w[0].islower() for _, w in s) == 1 and plain(first) not in given
            linked = any(w in NAME_LINKS for _, w in s)
            out.append((s[0][0], end, first, s[-1][1], titled or initial or linked, place and not linked or (article and s is own)))
        return out

    def _monsieur(self, own: list[tuple[int, str]]) -> bool:
        """'M.' is the French title before two names, and where it begins a sentence whose verb follows the name; else an initial."""
        if len(own) > 2:
            return True
        end = own[-1][0] + len(own[-1][1])
        start = own[0][0]
        return bool(_SENTENCE_END.search(self.text[max(0, start - 8) : start]) and re.match(r"\s[^\W\d_A-Z]", self.text[end : end + 2]))

    def _mentions(self, key: str, names: set[str], spans: list[tuple[int, int]]) -> None:
        """The family name alone elsewhere in the text, in any letter case and with or without accents."""
        text = self.text
        family = next((w for n in names for w in re.split(r"[\s,]+", n) if plain(w) == key), key)
        bare = "".join(c for c in unicodedata.normalize("NFKD", family) if not unicodedata.combining(c))
        for form in {f for w in (family, bare) for f in (w, w.upper(), w.title(), w.capitalize())}:
            at = text.find(form)
            while at >= 0:
                end = at + len(form)
                alone = not (at and (text[at - 1].isalnum() or text[at - 1] in "_@.’'-+")) and not re.match(r"[\w@’'-]*\w|@", text[end : end + 2])
                if alone and all(e <= at or end <= s for s, e in spans) and self._free(at, end) and not self._member_named(at, form):
                    self.found.append(Candidate(PERSON_KIND, at, end, (0,) * LABELERS, [0] * WIDTH, key, True))
                at = text.find(form, end)

    def _member_named(self, at: int, family: str) -> bool:
        """Whether a family name stands with the given name of a member."""
        before = re.search(rf"({_CAP}|[A-ZÀ-Þ]\.)\s$", self.text[max(0, at - 40) : at])
        return bool(before and plain(before[1]) not in TITLES and self.gazetteer.is_member(before[1], family))
