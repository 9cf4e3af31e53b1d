"""Personal information in free text: finding it and replacing it.

Kinds: e-mail addresses, phone numbers, identity numbers, postal addresses and names of
persons; when texts are redacted also dates of birth. Numbers are accepted by format and
surroundings, names by a list of known persons or by what leads to them.

Replacements are typed placeholders. Numbers and dates are brought to one spelling
(``+44 1632 960668`` and ``0044 1632 960668`` are one number), validated, and permuted by a
keyed Feistel network, with the kind as a tweak, within the numbers of their kind that are
valid (or, if they are not, within those that are not): area codes, reserved ranges and
check letters hold for the pseudonym as they held for the number, the country code stays,
and the layout is that of the text. So equal values stay linked across documents however
they are written. For other kinds the pseudonym is a keyed tag of the normalised value.

Null and empty texts have no findings and stay as they are; texts are searched whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.llm.arrow import batches, lists

#: Given or family names looked up in one pass; more are looked up in further passes.
NAME_BLOCK = 200_000

_LETTERS = r"[^\W\d_]"
_AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?|\sat\s(?=[\w-]+\sdot\s))"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
EMAIL = re.compile(
    rf"(?<![\w.+%/@-])(?!git@)[a-z0-9](?:[\w.%+-]*[\w])?{_AT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:{_DOT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*{_DOT}[a-z]{{2,24}}(?![\w@]|-\w|\.\w|:\w+/)",
    re.I,
)
PHONE = re.compile(
    r"(?<![\w.+#-])(?:"
    r"(?:\+|00)44[ .-]?(?:\(0\)[ .-]?)?(?:20[ .-]?\d{4}[ .-]?\d{4}|\d{4}[ .-]?\d{6}|\d{3}[ .-]?\d{3}[ .-]?\d{4})"
    r"|0(?:20[ .-]\d{4}[ .-]\d{4}|[17]\d{3}[ .-]\d{6}|[17]\d{9})"
    r"|(?:(?:\+|00)1[ .-]?|1[ .-])?(?:\([2-9]\d\d\)[ .-]?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}"
    r"|(?:\+|00)1[2-9]\d\d[2-9]\d{6}"
    r"|0[1-9](?:[ .-]\d\d){4}"
    r"|(?:\+|00)(?!44|1)[2-9]\d{0,2}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){2,4}"
    r")(?:,?\s?(?:ext\.?|x|extension)\s?\d{1,6})?(?![\w-]|\.\d)",
    re.I,
)
IDENTITY = re.compile(
    r"(?<![\w.+#-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}|\d{8}-?[A-Z]|\d{2}\.\d{3}\.\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{2} ?\d{3} ?\d{4}|[A-Z]{2} ?\d{6,7})(?![\w-]|\.\d)",
    re.I,
)
_ID_WORDS = re.compile(r"(?:\bssn(?:-like)?|\bnational insurance(?: number)?|\bcarn[eé] de identidad|\bpasaporte|\bn[uú]mero de identidad|\bdni|\bnie|\bnif|\btax id|\bid card|\bpassport(?: no\.?| number)?|\bidentity(?: card)?|\bsocial security(?: number)?)\W{0,3}$", re.I)
_TOWN = rf"{_LETTERS}[\w'’-]*(?: (?!by\b|before\b|and\b|is\b|the\b|we\b|user\b){_LETTERS}[\w'’-]*)?"
_ONE = rf"{_LETTERS}[\w'’-]+"
_POSTCODE = r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}(?![\w-])"
_KIND = r"(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|close|drive|dr\.?|court|ct\.?|boulevard|blvd\.?|way|place|pl\.?|square|terrace|crescent)"
_END = rf"(?:\d{{4,5}}(?:-\d{{4}})?\s+{_ONE}|{_ONE}(?: {_ONE})?,?\s+{_POSTCODE}|{_ONE}(?:,?\s+\d{{5}}(?:-\d{{4}})?(?![\w.-]))?)"
ADDRESS = re.compile(
    r"(?<![\w/.-])(?:"
    rf"(?:(?:flat|apt\.?|apartment|unit|suite)\s+\d+\w?,?\s+)?\d{{1,5}}[a-z]?\s+{_ONE}(?:\s{_ONE})?\s+{_KIND}(?:,?\s+(?:apt\.?|flat|unit|suite|#)\s?\d+\w?)?,?\s+{_END}"
    rf"|(?:calle|c/|avenida|avda\.?|plaza|paseo|camino)\s?(?:\s?de(?:\s(?:la|los|las))?\s|\sdel\s)?\s?{_ONE}(?:\s{_ONE})?,?\s+\d{{1,5}}(?:,\s*\d{{1,2}}\.?\s?[ºª°]\s?[a-z]?)?,?\s+{_END}"
    rf"|\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|boulevard|bd|avenue|place|quai|chemin|all[eé]e|via|viale|piazza|corso)\s(?:(?:de|du|des|la|le|les|della|del)\s|d[’']|l[’'])*{_ONE}(?:\s{_ONE})?,?\s+{_END}"
    rf"|{_LETTERS}+(?:weg|straße|strasse|str\.|gasse|platz|allee)\s+\d{{1,5}}\s?[a-z]?,?\s+{_END}"
    r")",
    re.I,
)
_GIVEN = rf"(?:{_LETTERS}[\w'’-]+|{_LETTERS}\.)"
_NAME = rf"(?:{_LETTERS}[\w'’-]+, {_LETTERS}[\w'’-]*\.?(?: {_LETTERS}\.)?|{_GIVEN}(?: {_LETTERS}\.)? {_LETTERS}[\w'’-]+)"
#: What leads to a person, as it stands in lower-cased text.
_LEADS = (
    "owner is", "talked to", "talk to", "spoke to", "speak to", "spoke with", "met", "met with", "meet", "meeting with", "interview with", "reviewed with", "reviewed by", "goes to",
    "reported by", "written by", "approved by", "signed by", "signed off by", "sent by", "forward this to", "forward it to", "forwarded to", "send this to", "send it to", "handed to", "ask", "asked",
    "user", "agreed with", "on behalf of", "thanks to", "contact", "dear", "hello", "hi", "regards,", "sincerely,", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "dr", "dr.", "prof.", "señor", "señora", "sr.", "sra.",
    "hablar con", "firmado por", "de parte de", "según informó",
)
#: What ends the clause a name stands in.
_CLAUSE = re.compile(r"(?=\s?[,.;:!?)\n]|\s(?:about|and|or|before|after|for|could|can|cannot|will|would|should|is|was|has|had|on|at|if|when|who|because|backup|from|said|says|with|y|para|antes|sobre|porque)\b|\s*$)", re.I)
NAME_AFTER = re.compile(rf"(?<![\w-])(?:{'|'.join(re.escape(lead) for lead in sorted(_LEADS, key=len, reverse=True))})\s+(?=(?P<name>{_NAME})(?:{_CLAUSE.pattern}|(?=\s(?-i:[a-zà-ÿ]))))", re.I)
NAME_ENDS = re.compile(rf"(?<![\w./@-])(?P<name>{_NAME})$", re.I)
_TO_CONTACT = re.compile(r"\s?[/:(<]\s?[<(]?$")
_STREETS = ("rue ", "bd ", "quai ", "chemin ", "all", "via", "piazza", "corso ", " st", " road", " rd", " ave", " lane", " ln", " close", " drive", " dr", " court", " ct", " boulevard", " blvd", " way", " pl", " square", " terrace", " crescent", "calle", "c/", "avenida", "avda", "plaza", "paseo", "camino", "weg ", "straße ", "strasse ", "str. ", "gasse ", "platz ", "allee ")
_LONG_NUMBER = re.compile(r"\d{2}[ .)-]{0,2}\d{3}|(?:\d\d[ .-]){4}\d\d")
_COMMON = frozenset(
    "the a an and or of to in on at for by with from is was be it no not we you they this that please need "
    "contact call tel phone about user owner ask talked reviewed credit reported on-call signed off number "
    "report send mailed bounced login reach them escalation backup leave cc el la los las de del en y con que".split()
)
#: Words of systems, teams and calendars, which no person is called by.
_THINGS = frozenset(
    "team agent service server gateway broker kafka queue cache cluster database index api admin root support system backend frontend pipeline worker manager platform cloud data center "
    "centre group project product release build engine router node storage search network security operations monitor payment billing order account customer client vendor office department "
    "board council committee company bank university model token tenant shard lock job task test stage step loop hook table file script branch commit ticket page version flag monday tuesday "
    "wednesday thursday friday saturday sunday january february march april may june july august september october november december north south east west new every each all more than its our "
    "your their his her my another other some any these those there here who what when where how which whether if before after then now today tomorrow yesterday".split()
)
_WORD = re.compile(rf"{_LETTERS}[\w'’]*")
_WORD_PAIR = re.compile(rf"(?<![\w./@#-]){_LETTERS}[\w'’]*(?:\.(?= ))?")


def _plausible(name: str) -> bool:
    parts = [p.strip(",").lower() for p in name.split()]
    return all(p and p not in _COMMON and p not in _THINGS for p in parts) and any(len(p) > 2 for p in parts)


#: Leads that are also common words or units: the name after them must be capitalised.
_WEAK_LEADS = frozenset("mr mrs ms dr prof sr sra met meet hi hello dear contact".split())


def _written_as_name(m: re.Match) -> bool:
    """Capitalised like a name, or (as users write in haste) wholly in lower case, without short words, at the end of a clause and after a lead that only persons follow."""
    parts = [p.strip(",.") for p in m.group("name").split()]
    if all(p[:1].isupper() for p in parts):
        return True
    lead = m.group()[: m.start("name") - m.start()].split()[0].lower().strip(".,")
    return lead not in _WEAK_LEADS and bool(_CLAUSE.match(m.string, m.end("name"))) and all(p.islower() and (len(p) > 3 or len(p) == 1) for p in parts)


class Names:
    """Given and family names of known persons, whatever their case and blanks."""

    def __init__(self, pairs: list[tuple[str, str]]):
        clean = [((g or "").strip().lower(), (f or "").strip().lower()) for g, f in pairs]
        self.given = {g for g, _ in clean if g}
        self.family = {f for _, f in clean if f}

    @classmethod
    def of(cls, given: frozenset, family: frozenset) -> Names:
        out = cls([])
        out.given, out.family = given, family
        return out

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        if self.family.isdisjoint(_WORD.findall(text.lower())):
            return
        words = [(m.start(), m.end(), m.group().lower()) for m in _WORD_PAIR.finditer(text)]
        given = lambda w: w in self.given or (len(w) == 2 and w[1] == ".")
        for i, (start, end, word) in enumerate(words):
            if word not in self.family:
                continue
            if i and words[i - 1][1] + 1 == start and text[words[i - 1][1]] == " ":
                first = words[i - 1]
                if len(first[2]) == 2 and first[2][1] == "." and i > 1 and words[i - 2][2] in self.given and words[i - 2][1] + 1 == first[0]:
                    yield words[i - 2][0], end
                    continue
                if given(first[2]):
                    yield first[0], end
                    continue
            if text[end : end + 2] == ", " and i + 1 < len(words) and words[i + 1][0] == end + 2 and words[i + 1][2] in self.given:
                last = words[i + 1][1]
                if i + 2 < len(words) and words[i + 2][0] == last + 1 and re.fullmatch(rf"{_LETTERS}\.", words[i + 2][2]):
                    last = words[i + 2][1]
                yield start, last


def _free(taken: list[tuple[int, int, str]], start: int, end: int) -> bool:
    return all(end <= a or b <= start for a, b, _ in taken)


#: A date after a word that makes it a date of birth.
BORN = re.compile(
    r"(?:\bborn(?: on)?|\bdob|\bdate of birth|\bbirthday|\bnacid[oa](?: el)?|\bfecha de nacimiento)\W{1,3}"
    r"(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2} [a-z]{3,9} \d{4}|[a-z]{3,9} \d{1,2}, \d{4})(?!\w)",
    re.I,
)


def find(text: str | None, names: Names | list[tuple[int, int]], dates: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, in order, none overlapping another; ``names`` are known persons or where they stand."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []

    def take(matches, kind: str, group=0, fine=lambda m: True) -> None:
        for m in matches:
            start, end = m.span(group)
            if fine(m) and _free(taken, start, end):
                taken.append((start, end, kind))

    low = text.lower()
    if "@" in low or "at]" in low or "at)" in low or " dot " in low:
        take(EMAIL.finditer(text), "email")
    if _LONG_NUMBER.search(low):
        take(PHONE.finditer(text), "phone", fine=lambda m: _is_phone(low, m))
        take(IDENTITY.finditer(text), "identity", fine=lambda m: _is_identity(low, m))
    if any(street in low for street in _STREETS):
        for m in ADDRESS.finditer(text):
            if not low[: m.start()].endswith("slot "):
                taken = [x for x in taken if x[1] <= m.start() or m.end() <= x[0]]
                taken.append((*m.span(), "address"))
    if dates and any(word in low for word in ("born", "dob", "birth", "naci")):
        take(BORN.finditer(text), "date", "date", lambda m: read_date(m.group("date")) is not None)
    take(NAME_AFTER.finditer(text), "name", "name", lambda m: _plausible(m.group("name")) and _written_as_name(m))
    ends = [m.start() for m in re.finditer(r"\s+signed off\b", low)] if "signed off" in low else []
    for start, _, kind in list(taken):
        if kind in ("email", "phone") and (m := _TO_CONTACT.search(text, max(0, start - 4), start)):
            ends.append(m.start())
    for end in ends:
        m = NAME_ENDS.search(text[:end], max(0, end - 80))
        if m and _plausible(m.group("name")):
            start = m.start("name")
            first, _, rest = m.group("name").partition(" ")
            if rest[1:2] == "." and first.islower() and rest[0].isupper():  # a word before a name with an initial
                start += len(first) + 1
            if _free(taken, start, end):
                taken.append((start, end, "name"))
    for start, end in names.spans(text) if isinstance(names, Names) else names:
        if _free(taken, start, end):
            taken.append((start, end, "name"))
    return sorted(taken)


def _is_phone(low: str, m: re.Match) -> bool:
    found = m.group()
    if re.fullmatch(r"\d{3} \d{3} \d{4}", found) and found[4:7] != "555":  # else three plain numbers in a row
        return bool(re.search(r"(?:call|tel|phone|at|number|on-call is|fax|mobile|[:/(])\s?$", low[: m.start()]))
    return not re.search(r"(?:port range|build|run|id|cursor|digest)\s$", low[: m.start()])


def _is_identity(low: str, m: re.Match) -> bool:
    found = m.group()
    if _ID_WORDS.search(low[max(0, m.start() - 32) : m.start()]):
        return True
    if re.search(r"(?:\bshape|\bdims?|\bsize|\brange|\bover)(?: is| of)?\s$", low[: m.start()]):
        return False
    if re.fullmatch(r"\d{9}|[A-Za-z]{2} ?\d{3} ?\d{4}|[A-Za-z]{2} ?\d{6,7}", found):
        return False  # such numbers and codes are common: only a word before tells what they are
    if re.fullmatch(r"\d{8}[A-Za-z]", found):
        return found[-1].isupper() and not re.search(r"(?:build|commit|digest|with|to|a|en|run)\s$", low[: m.start()])
    return True


def _mixed(key: bytes, tweak: str, round_: int, value: int | str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}:{round_}:{value}".encode(), key=key, digest_size=16).digest(), "big")


def permute_digits(digits: str, key: bytes, tweak: str = "", rounds: int = 8) -> str:
    """A keyed permutation of the digit strings of one length: balanced Feistel network, radix 10."""
    if len(digits) < 2:
        return digits
    half = len(digits) // 2
    left, right = digits[:half], digits[half:]
    for r in range(rounds):
        mixed = (int(left) + _mixed(key, f"{tweak}:{len(digits)}", r, right)) % 10 ** len(left)
        left, right = right, str(mixed).zfill(len(left))
    return left + right


def restore_digits(digits: str, key: bytes, tweak: str = "", rounds: int = 8) -> str:
    """The inverse of ``permute_digits``."""
    if len(digits) < 2:
        return digits
    half = len(digits) // 2 if rounds % 2 == 0 else len(digits) - len(digits) // 2
    left, right = digits[:half], digits[half:]
    for r in reversed(range(rounds)):
        before = (int(right) - _mixed(key, f"{tweak}:{len(digits)}", r, left)) % 10 ** len(right)
        left, right = str(before).zfill(len(right)), left
    return left + right


def permute_within(value: str, key: bytes, tweak: str, fine: Callable[[str], bool]) -> str:
    """The permutation restricted to the digit strings ``fine`` holds for, or to the others: the cycle is walked until it is back among them."""
    kind, out = fine(value), permute_digits(value, key, tweak)
    while len(value) > 1 and fine(out) != kind:
        out = permute_digits(out, key, tweak)
    return out


#: Check letters of the Spanish identity number, by remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def dni_letter(digits: str, lead: str = "") -> str:
    """The check letter of a national (8 digits) or foreigner's number (X, Y or Z and 7 digits)."""
    return DNI_LETTERS[int(str("XYZ".index(lead)) + digits if lead else digits) % 23]


def valid_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _valid_national(country: str) -> Callable[[str], bool]:
    if country == "1":
        return lambda d: len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"
    return lambda d: d[0] != "0"


def phone_parts(value: str) -> tuple[str, str, str]:
    """(country code, national number, extension) as digits; '' is an unknown country.

    A number without country code is North American if it has ten digits from 2 on, and
    British if it starts with 0 and has ten or eleven.
    """
    main, _, extension = re.sub(r"(?i)(?:ext\.?|extension|x)", "x", value).partition("x")
    digits = re.sub(r"\D", "", main.replace("(0)", ""))
    if main.lstrip().startswith("+") or digits.startswith("00"):
        digits = digits if main.lstrip().startswith("+") else digits[2:]
        size = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
        return digits[:size], digits[size:], re.sub(r"\D", "", extension)
    if len(digits) == 11 and digits[0] == "1":
        return "1", digits[1:], re.sub(r"\D", "", extension)
    if len(digits) == 10 and digits[0] in "23456789":
        return "1", digits, re.sub(r"\D", "", extension)
    if len(digits) == 11 and digits[0] == "0":
        return "44", digits[1:], re.sub(r"\D", "", extension)
    return "", digits, re.sub(r"\D", "", extension)


#: Country codes of two digits.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Names of months by their first three letters, English and Spanish.
MONTHS = {"jan": 1, "ene": 1, "feb": 2, "mar": 3, "apr": 4, "abr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "ago": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "dic": 12}
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1), 73_049  # to the end of 2099


def read_date(text: str) -> datetime.date | None:
    """The date of any of the spellings that are found; day before month in figures."""
    figures = [int(x) for x in re.findall(r"\d+", text)]
    try:
        if word := re.search(r"[A-Za-z]{3}", text):
            month = MONTHS[word.group().lower()]
            return datetime.date(figures[1], month, figures[0])
        return datetime.date(*figures) if text[4:5] == "-" else datetime.date(figures[2], figures[1], figures[0])
    except (ValueError, KeyError, IndexError):
        return None


def _date(value: str, key: bytes) -> str:
    day = read_date(value)
    at = (day - _FIRST_DAY).days
    if 0 <= at < _DAYS:
        day = _FIRST_DAY + datetime.timedelta(int(permute_within(str(at).zfill(5), key, "date", lambda d: int(d) < _DAYS)))
    if re.search(r"[A-Za-z]", value):
        spelled = day.strftime("%B")
        return f"{spelled} {day.day}, {day.year}" if value[0].isalpha() else f"{day.day} {spelled} {day.year}"
    if value[4:5] == "-":
        return day.isoformat()
    mark = "/" if "/" in value else "."
    return f"{day.day:02d}{mark}{day.month:02d}{mark}{day.year}"


def _laid_out(value: str, digits: str, letters: str = "") -> str:
    """``value`` with its digits, and its letters if given, replaced in order."""
    new, other = iter(digits), iter(letters)
    return "".join(next(new) if c.isdecimal() and c.isascii() else next(other) if letters and c.isalpha() else c for c in value)


def _phone(value: str, key: bytes) -> str:
    country, national, extension = phone_parts(value)
    shown = re.sub(r"\D", "", value)
    kept = shown[: len(shown) - len(extension) - len(national)]  # international prefix, country code, trunk 0
    fine = _valid_national(country)
    if country == "44" and national[0] in "127":  # the kind of line stays
        new = national[0] + permute_within(national[1:], key, f"phone:44{national[0]}", lambda d: True)
    else:
        new = permute_within(national, key, f"phone:{country}", fine)
    return _laid_out(value, kept + new + permute_digits(extension, key, "extension"))


def _identity(value: str, key: bytes) -> str:
    digits, letters = re.sub(r"\D", "", value), "".join(c for c in value.upper() if c.isalpha())
    if not letters:
        return _laid_out(value, permute_within(digits, key, "ssn", valid_ssn) if len(digits) == 9 else permute_digits(digits, key, "identity"))
    if value[-1].isalpha():  # a check letter
        lead = letters[0] if len(letters) > 1 and letters[0] in "XYZ" else ""
        new = permute_digits(digits, key, f"dni:{lead}")
        letter = dni_letter(new, lead)
        if letters[-1] != dni_letter(digits, lead):  # not valid before, so not after
            letter = DNI_LETTERS[(DNI_LETTERS.index(letter) + 1 + _mixed(key, "letter", 0, new) % 22) % 23]
        out = _laid_out(value, new, lead + letter)
        return out if value[-1].isupper() else out[:-1] + out[-1].lower()
    # A series of two letters and a number: letters count as two digits each.
    series = "".join(f"{ord(c) - 65:02d}" for c in letters)
    new = permute_within(series + digits, key, f"series:{len(letters)}", lambda d: all(int(d[i : i + 2]) < 26 for i in range(0, 2 * len(letters), 2)))
    out = "".join(chr(65 + int(new[i : i + 2])) for i in range(0, 2 * len(letters), 2))
    return _laid_out(value, new[2 * len(letters) :], out if value[0].isupper() else out.lower())


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """A typed placeholder that is the same for the same value, however it is written."""
    permuted = {"phone": _phone, "identity": _identity, "date": _date}.get(kind)
    if permuted:
        return f"[{kind.upper()}:{permuted(value, key)}]"
    same = " ".join(value.lower().split())
    if kind == "email":
        same = re.sub(_DOT, ".", re.sub(_AT, "@", same))
    if kind == "name" and ", " in same:
        family, given = same.split(", ", 1)
        same = f"{given} {family}"
    return f"[{kind.upper()}:{hashlib.blake2b(f'{kind}:{same}'.encode(), key=key, digest_size=8).hexdigest()}]"


def redact(text: str | None, names: Names | list[tuple[int, int]], key: bytes) -> tuple[str | None, int]:
    """``text`` with each finding replaced, and their number; what is outside the findings is kept to the letter."""
    if text is None:
        return None, 0
    out, at, found = [], 0, find(text, names, dates=True)
    for start, end, kind in found:
        out += [text[at:start], pseudonym(kind, text[start:end], key)]
        at = end
    return "".join(out) + text[at:], len(found)


def _spans(names):
    """Adds where names of this block stand, as (start, end, start, end, ...), to what blocks before found."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.int32()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names.of(*names.value)
        for batch in stream:
            held = batch.column(2).to_pylist()
            for spans, text in zip(held, batch.column(1).to_pylist(), strict=True):
                spans += [x for span in known.spans(text or "") for x in span]
            counts = [len(spans) for spans in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(counts, [x for spans in held for x in spans], pa.int32())], schema=schema)

    return run


def _longest(spans: list[int]) -> list[tuple[int, int]]:
    """The spans without those inside or overlapping a longer one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(zip(spans[::2], spans[1::2], strict=True)), key=lambda x: (x[0] - x[1], x)):
        if all(end <= a or b <= start for a, b in out):
            out.append((start, end))
    return sorted(out)


def _map(names, key: bytes | None):
    """Findings or redacted texts of (id, text[, spans])."""
    found_schema = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("found_text", pa.string())])
    text_schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_found", pa.int32())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names.of(*names.value) if names is not None else None
        for batch in stream:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            given = [known] * len(ids) if known is not None else [_longest(s) for s in batch.column(2).to_pylist()]
            if key is None:
                rows = {(i, kind, t[a:b]) for i, t, n in zip(ids, texts, given, strict=True) for a, b, kind in find(t, n)}
                yield from batches(found_schema, *([r[c] for r in rows] for c in range(3)))
            else:
                done = [redact(t, n, key) for t, n in zip(texts, given, strict=True)]
                yield from batches(text_schema, ids, [t for t, _ in done], [n for _, n in done])

    return run


def _blocks(people: DataFrame, column: str) -> list[frozenset]:
    """The different names of a column, in blocks of at most ``NAME_BLOCK``."""
    name = F.lower(F.trim(column))
    different = people.select(name.alias("name")).filter(F.length("name") > 0).distinct()
    parts = max(1, -(-different.count() * 5 // (4 * NAME_BLOCK)) if different.count() > NAME_BLOCK else 1)
    part = lambda b: different if parts == 1 else different.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == b)
    return [frozenset(part(b).toPandas()["name"]) for b in range(parts)]


def _searched(rows: DataFrame, people: DataFrame, given_col: str, family_col: str, key: bytes | None, kinds: str) -> DataFrame:
    spark = rows.sparkSession
    pairs = [(g, f) for g in _blocks(people, given_col) for f in _blocks(people, family_col)]
    if len(pairs) == 1:
        return rows.mapInArrow(_map(spark.sparkContext.broadcast(pairs[0]), key), kinds)
    rows = rows.withColumn("spans", F.array().cast("array<int>"))
    for pair in pairs:  # a name needs a given and a family name, so each pair of blocks is a pass
        rows = rows.mapInArrow(_spans(spark.sparkContext.broadcast(pair)), "id long, text string, spans array<int>")
    return rows.mapInArrow(_map(None, key), kinds)


def find_personal(records: DataFrame, people: DataFrame, id_col: str = "seq", text_col: str = "text", given_col: str = "given_name", family_col: str = "family_name") -> DataFrame:
    """(id, kind, found_text), one row per different finding of a record."""
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    return _searched(rows, people, given_col, family_col, None, "id long, kind string, found_text string").distinct()


def redact_personal(records: DataFrame, people: DataFrame, key: bytes, id_col: str = "seq", text_col: str = "text", given_col: str = "given_name", family_col: str = "family_name") -> DataFrame:
    """(id, text, n_found): the texts with typed placeholders; null texts stay null."""
    if not 16 <= len(key) <= 64:
        raise ValueError("key must have 16 to 64 bytes")
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _searched(rows, people, given_col, family_col, key, "id long, text string, n_found int")
