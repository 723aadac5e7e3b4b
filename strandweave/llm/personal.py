"""Personal information in free text: find it, name its kind, put placeholders in its place.

Method: anchor expansion. One Aho-Corasick automaton finds at-signs, schemes, digit pairs,
identifier and address cues and given names in a text. Around each anchor a deterministic
local parser expands by whole words, however long they are, to the boundaries of an e-mail
address, telephone number, identity number, account, street address or person's name and
validates it (top-level domain, numbering plan, check digits, and the words before it). A
parser looks at as many words on either side as its form can have, so long texts cost in
proportion to their length and no item is cut. Spans found earlier in the order account,
e-mail, address, identity number, telephone, name are not reused.

Text is compared in a form of the same length (full-width forms and kinds of space folded
one to one), so that the text around a placeholder stays unchanged.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "phone", "id_number", "address", "person_name")
# Words on either side of an anchor that a form can take up at most.
REACH = {"email": 2, "spelled": 12, "street": 14, "number": 14}

# Top-level domains that a spelled-out address ("name at host dot com") may end in.
SPELLED_TLDS = frozenset("com net org edu gov info biz example test invalid io co uk de fr es it pt br nl pl ru ua tr jp kr au us ca ch at be eu dev app me mx ar cl in".split())
# Cues of an identity number, in several languages.
ID_CUES = (
    "ssn", "social security", "my social", "as my social", "passport", "passeport", "pasaporte", "passaporte", "reisepass", "paspoort", "paszport", "pasaport",
    "tax id", "tax number", "tax no", "taxpayer", "steuer-id", "steuernummer", "steuer id", "steueridentifikation", "numéro fiscal", "numero fiscal", "número fiscal", "identification fiscale",
    "national id", "identity number", "identity card", "id card", "id number", "ausweis", "personalausweis", "documento de identidad", "meu documento", "mi documento", "carte d'identité", "carta d'identità",
    "codice fiscale", "sécurité sociale", "seguridad social", "sozialversicherung", "national insurance", "insurance number", "número de identidad", "bilhete de identidade", "cpf", "dni", "nie ", "nif", "bsn", "pesel", "паспорт", "инн", "снилс",
)
# Words before a number that make it something else than a telephone or identity number.
OTHER_NUMBERS = re.compile(
    r"(?:order|ticket|parcel|package|tracking|catalogue|catalog|isbn|invoice|build|version|firmware|lottery|code|error|ip|population|page|chapter|lane|pier|bus|line|flight|room|seat|serial|model|batch|reference|ref|case|bestellung|bestellnummer|paket|sendung|commande|colis|pedido|paquete|encomenda|rechnung|factura|fatura|set|score|steps)"
    r"s?(?:[\s-]*(?:numbers?|nummer|nr|no|num|numéro|número)\b)?[\s.:#№]*$|#\s*$|\b0x$|https?://\S*$|/p/\S*$",
    re.IGNORECASE,
)
# Common given names of the corpus languages.
GIVEN = frozenset(
    "adam adrian agnes aisha alan albert alejandro alessandra alex alexander alice alina amelie amy ana andrea andreas andrew anita ann anna anne anton antonio astrid barbara beatriz ben "
    "benjamin bernd bianca brian bruno camille carla carlos carmen caroline catherine cecilia charles charlotte chiara chris christian christine clara claudia daniel daniela david diana diego "
    "dmitri eduardo elena elisa elizabeth ella ellen emil emily emma eric erik eva felix fernando florian frances francesco francisco frank gabriel george georg gianni giulia grace hannah hans "
    "harry heinrich helen helena henry hugo ian igor ines ingrid irene isabel ivan jack jakob james jan jane javier jean jennifer jens joana johan johannes john jonas jorge jose joseph juan julia "
    "julian julie karen karl kate katharina kevin klara klaus lara laura lea lena leo leonie lisa louis louise lucas lucia luis luisa lukas magda manuel marc marco maria marie mario mark marta martha "
    "martin mary mateo matthias max maya mehmet mia michael michelle miguel mikhail monika nadia natalia nicolas nina noah nora olga oliver olivia oscar pablo patricia paul paula pedro peter petra "
    "philip pierre rachel rafael ralf ricardo richard robert rosa ruth samuel sandra sara sarah sebastian simon sofia sophie stefan stephen susan teresa theo thomas tim tobias tom tomas victor "
    "vera walter william yasmin zoe".split()
)
# Common given names of the corpus languages in other letters.
GIVEN_OTHER = frozenset(
    "александр алексей андрей анна антон артём борис вадим валентина валерий вера виктор виктория владимир галина дарья денис дмитрий евгений екатерина елена иван игорь ирина кирилл константин ксения лариса людмила максим марина мария "
    "михаил надежда наталья николай оксана олег ольга павел пётр роман светлана сергей софья татьяна юлия юрий андрій богдан василь володимир ганна дмитро катерина олександр олена оксана петро сергій тарас юрій "
    "paweł michał łukasz tomasz krzysztof małgorzata agnieszka katarzyna zofia stanisław ayşe fatma mustafa ahmet hüseyin çağla özgür şule ömer ümit".split()
)
# Second words that make two capitalised words a band, shop, place or other thing.
NOT_SURNAME = frozenset(
    "trio quartet quintet band brass choir orchestra ensemble festival club street st road rd avenue ave lane drive close court row terrace blvd square park hill bridge station school church museum bakery shop store "
    "cafe bar inn hotel hall house books records bros sons ltd inc gmbh sa market harbour quay pier lake river valley island bay port town city county county fund prize award cup league united and und et y e or is was "
    "has had said says with from for the a an in on at of to went where when who which day week month street's day's today tomorrow monday tuesday wednesday thursday friday saturday sunday strikers players theatre "
    "foundation institute college university society association committee project group team show podcast radio times news press review gallery studio works works' express line".split()
)
# Cues before a person's name.
_NAME_CUE = re.compile(
    r"(?:thanks to|\bmeet|my name is|please contact|thank you,?|happy birthday,?|soup with|lunch with|dinner with|my (?:landlord|landlady|boss|neighbou?r|dentist|doctor|teacher|colleague|friend|cousin|brother|sister|plumber)|just met|according to|where|merci à|gracias a|obrigad[oa] a|dank an|dank aan|grazie a|"
    r"signed,?|signs? (?:some |many |most )?(?:posts |letters |replies )?(?:as|with)|named?|called|name is|ich heiße|je m'appelle|me llamo|mi chiamo|\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|sra?|dona|señor|señora|madame|monsieur)\.?)\s*$",
    re.IGNORECASE,
)

_EN_STREET = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|court|ct|row|terrace|blvd|boulevard|place|pl|way|square|sq|crescent|cres|walk|gardens|parkway|pkwy|highway|hwy|alley|mews|quay|trail|circle|grove|rise"
_NOT_STREET = r"(?!(?:of|the|for|hours?|minutes?|days?|weeks?|months?|years?|degrees|kg|km|m|people|times|and|or|in|on|at|to|is|are|was|were|a|an|my|our|per|percent|more|old friends|steps|flights|words|am|pm)\b)"
ADDRESS = (
    re.compile(
        rf"(?<![\w.,:/#-])(?:(?:flat|unit|apt\.?|apartment)\s+\w{{1,4}},\s+)?\d{{1,5}}\s?[a-z]?\s+(?:(?:[nsew]\.?|north|south|east|west)\s+)?(?:{_NOT_STREET}[^\W\d_][\w'’.-]*\s+){{1,3}}(?:{_EN_STREET})\b\.?(?:,\s*(?:apt\.?|apartment|flat|unit|suite|floor)\s*\w{{1,4}}\b)?",
        re.IGNORECASE,
    ),
    re.compile(r"(?<!\w)(?:[^\W\d_][\w.-]*(?:straße|strasse|str\.|gasse|allee|platz|ufer|chaussee|damm|steig|weg|ring|graben)|[^\W\d_][\w.-]+ (?:straße|strasse|str\.|gasse|allee|platz|ufer|weg|ring))\s+\d{1,4}\s?(?:[a-h]\b)?", re.IGNORECASE),
    re.compile(r"(?<!\w)\d{1,4}[a-h]?(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|av\.|boulevard|bd\.?|bld\.?|chemin|ch\.|impasse|allée|allee|place|pl\.|quai|route|passage|cours|sentier|ruelle|square)\s+(?:(?:de la|de l'|des|du|de|d'|l'|la|le|les)\s*)?[^\W\d_][\w'’-]+(?:\s+(?:de|du|des|la|le|et)\b)?(?:\s+[A-ZÀ-Þ][\w'’-]+)?", re.IGNORECASE),
    re.compile(r"(?<!\w)(?:calle|c/|plaza|pza\.?|plza\.?|avenida|avda?\.?|av\.|paseo|p\.º|camino|carretera|ctra\.?|ronda|travesía|callejón|rua|r\.|travessa|tv\.|trav\.|largo|lg\.|praça|pç\.|estrada|alameda|beco|calçada|via|viale|piazza|corso|vicolo|ul\.|ulica|al\.|os\.)\s*(?:(?:[^\W\d_][\w'’-]*|[^\W\d_]{1,4}\.)\s+){0,5}?[^\W\d_][\w'’-]*,?\s+(?:n\.?[º°o]?\.?\s*)?\d{1,4}\s?(?:[a-h]\b)?", re.IGNORECASE),
    re.compile(r"(?<!\w)[^\W\d_][\w-]*(?:straat|laan|plein|gracht|kade|singel|dreef)\s+\d{1,4}\s?(?:[a-h]\b)?", re.IGNORECASE),
    re.compile(r"(?<!\w)(?:ул\.|улица|улице|проспект|пр-т|пр\.|переулок|пер\.|набережная|вул\.|вулиця|вулиці|провулок)\s*(?:[^\W\d_][\w-]*\.?\s+){0,3}?[^\W\d_][\w-]*,?\s+(?:д\.|дом|буд\.|будинок)?\s*\d{1,4}(?:\s?[а-д]\b)?", re.IGNORECASE),
    re.compile(r"[一-鿿]{1,4}[都道府県市区郡][一-鿿ぁ-ヿ]{1,12}(?:町|村|丁目|通り?|区)?\s?\d{1,4}(?:[-－‐の]\d{1,4}|丁目\d{0,4}番?地?\d{0,4}号?|番地?\d{0,4}号?)+|[가-힣]{1,10}(?:로|길)\s?\d{1,4}(?:-\d{1,3})?(?:번지|호)?(?=\s|$|[.,)에])"),
    re.compile(r"(?<!\w)(?:[^\W\d_][\w-]*\s+){1,3}(?:sokağı|sokak|sok\.|caddesi|cad\.|bulvarı)\s*(?:no\s*[:.]?\s*)?\d{1,4}", re.IGNORECASE),
)
_STREET_WORDS = (
    "street", " st", "road", " rd", "avenue", " ave", "lane", " ln", "drive", " dr", "close", "court", " ct", " row", "terrace", "blvd", "boulevard", " place", " pl", " way", "square", "crescent", " walk", "gardens", "parkway", "highway", "alley",
    "mews", "quay", "trail", "circle", "grove", " rise", "straße", "strasse", "str.", "gasse", "allee", "platz", "ufer", "chaussee", "damm ", "steig", "weg ", "ring ", "graben", "rue ", "chemin", "impasse", "quai", "route", "passage", "cours ", "sentier",
    "ruelle", "calle", "c/", "plaza", "pza", "avenida", "avda", "av.", "paseo", "camino", "carretera", "ronda", "travesía", "callejón", "rua ", "r. ", "travessa", "tv.", "largo", "praça", "estrada", "alameda", "beco", "calçada", "via ", "viale", "piazza",
    "corso", "vicolo", "ul.", "ulica", "straat", "laan", "plein", "gracht", "kade", "singel", "sokağı", "sokak", "caddesi", "bulvarı", "ул.", "улиц", "проспект", "пр-т", "пр.", "переулок", "пер.", "набережная", "вул.", "вулиц", "провулок", "丁目", "番地", "町", "市", "区", "로 ", "길 ",
)

EMAIL = re.compile(r"(?<![\w.%+-])[\w][\w.%+-]*(?:@|\s@\s)(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(?![\w@])", re.IGNORECASE)
EMAIL_MARKED = re.compile(r"(?<![\w.%+-])[\w][\w.%+-]*\s*[(\[{<]\s*(?:at|arroba|ät)\s*[)\]}>]\s*[a-z0-9-]+(?:(?:\s*[(\[{<]\s*(?:dot|punkt|point|punto|ponto)\s*[)\]}>]\s*|\.|\s+dot\s+)[a-z0-9-]+)+", re.IGNORECASE)
EMAIL_SPELLED = re.compile(r"(?<![\w.%+-])[\w][\w.%+-]*\s+(?:at|arroba)\s+[a-z0-9-]+(?:(?:\s+dot\s+|\.)[a-z0-9-]+)+", re.IGNORECASE)

# accounts: not a kind that is asked for by name, but replaced like one
IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?![A-Z0-9])")
CARD = re.compile(r"(?<![\w+.#-])[3-6]\d{3}(?:[\s-]?\d){11,15}(?![\w-])")
USERINFO = re.compile(r"(?<=://)[^\s/@:]+:[^\s/@]+(?=@)")

_SEP = r"[\s.\-/]"
PHONE = (
    re.compile(rf"(?<![\w+])(?<!\d[\s.\-/])(?:\+|00){_SEP}?[1-9]\d{{0,2}}{_SEP}{{0,2}}(?:\(0?\d{{0,4}}\){_SEP}?)?\d{{1,5}}(?:{_SEP}{{0,2}}\d{{1,8}}){{0,5}}(?![\w-])"),
    re.compile(rf"(?<![\w+])(?<!\d[\s.\-/])(?:1{_SEP})?\(\d{{2,5}}\){_SEP}{{0,2}}\d{{2,6}}(?:{_SEP}\d{{2,4}}){{1,3}}(?![\w-])"),
    re.compile(rf"(?<![\w+])(?<!\d[\s.\-/])(?:1{_SEP})?[2-9]\d\d{_SEP}[2-9]\d\d{_SEP}\d{{2}}{_SEP}?\d{{2}}(?![\w-])"),
    re.compile(rf"(?<![\w+])(?<!\d[\s.\-/])0[1-9]\d{{1,4}}(?:{_SEP}\d{{2,8}}){{1,4}}(?![\w-])"),
    re.compile(r"(?<![\w+])(?<!\d[\s.\-/])0[1-9](?:[\s.\-/]\d\d){4}(?![\w-])"),
    re.compile(r"(?<![\w+])(?<!\d[\s.\-/])(?:1?[2-9]\d\d[2-9]\d{6}|0[1-9]\d{8,10})(?![\w-])"),
    re.compile(r"(?<![\w+])(?<!\d[\s.\-/])\d{3}-\d{4}(?![\w-])"),
)
ID_ALONE = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D])(?![\w-])", re.IGNORECASE)
ID_CUED = re.compile(r"(?<![\w.+#-])(?<!\+\d\s)(?<!\+\d\d\s)(?<!\)\s)(?<!\))(?:[A-Z]{1,3}[-.]?)?\d(?:[\s./-]?\d){4,13}(?:\s?[-/]?\s?[A-Z])?(?![\w-])", re.IGNORECASE)
_UP = "[" + "".join(chr(c) for c in range(0x41, 0x530) if chr(c).isupper()) + "]"
_NAME_WORD = rf"(?:{_UP}[\w'’-]*[\w]|{_UP}{{2,}}(?:[-'’]{_UP}+)*)"
NAME_AFTER = re.compile(rf"\s+(?:(?:{_UP}\.\s?){{0,2}})(?:(?:van|von|de|da|del|della|di|la|le|der|den|ter|zu|mc|o')\s+){{0,2}}({_NAME_WORD})", 0)
NAME_LOWER = re.compile(r"\s+(?:(?:[a-z]\.\s?){0,2})([a-zà-öø-ÿ]{4,})(?![\w.@])")
NAME_INITIAL = re.compile(rf"(?<![\w.@&])(?:{_UP}\.\s?){{1,3}}({_NAME_WORD})(?![\w@])")
NAME_CUED = re.compile(rf"\s*({_NAME_WORD})\s+(?:(?:{_UP}\.\s?){{0,2}})(?:(?:van|von|de|da|del|della|di|der|den)\s+)?({_NAME_WORD})(?![\w@])")
# Words that open a sentence before a name without being one.
_OPENERS = re.compile(
    r"(?:hello|hi|hey|dear|thanks|thank|sorry|please|yes|no|well|today|yesterday|tomorrow|tonight|finally|sometimes|maybe|also|still|then|now|later|meanwhile|however|later|okay|danke|hallo|bitte|ja|nein|heute|gestern|liebe|merci|bonjour|salut|oui|non|aujourd'hui|hier|gracias|hola|ayer|hoy|sí|obrigad[oa]|olá|ontem|hoje|sim|grazie|ciao|oggi|ieri)\b",
    re.IGNORECASE,
)
# What is said of persons right after their name.
SAID_OF = ("lives at", "lives in", "lives on", "lived at", "was born", "has moved to", "'s address", "'s phone", "'s number", "'s email", "'s passport", "wohnt in", "wohnt am", "habite au", "habite à", "vive en", "abita in", "mora na", "mora no", "woont in", "mieszka przy", "живёт на", "живет на", "мешкає на")
NAME_ENDS = re.compile(rf"(?<![\w@.])({_NAME_WORD})((?:\s+{_NAME_WORD}){{1,3}})\s*$")

NAME_REVERSED = re.compile(rf"({_NAME_WORD}),\s+$")


_TOKEN = re.compile(r"\S+")
_DOT = frozenset("dot (dot) [dot] {dot} <dot> punkt (punkt) [punkt] punto (punto) [punto] point (point) [point] ponto (ponto) [ponto]".split())


@lru_cache(maxsize=1)
def _same_length() -> dict[int, str]:
    table = {cp: chr(cp - 0xFEE0) for cp in range(0xFF01, 0xFF5F)}
    table |= {cp: " " for cp in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    table |= {cp: "-" for cp in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212)}
    return table


@lru_cache(maxsize=1)
def automaton():
    """All anchors with the parsers they start."""
    import ahocorasick

    kinds: dict[str, set[str]] = {}
    for s in ("@", "(at)", "[at]", "{at}", "<at>", " at ", "arroba", "mailto:"):
        kinds.setdefault(s, set()).add("email")
    kinds.setdefault("://", set()).add("scheme")
    for s in ("+", *(f"{i:02d}" for i in range(100))):
        kinds.setdefault(s, set()).add("number")
    for s in ID_CUES:
        kinds.setdefault(s, set()).add("cue")
    for s in _STREET_WORDS:
        kinds.setdefault(s, set()).add("street")
    for s in (*GIVEN, *GIVEN_OTHER):
        kinds.setdefault(s, set()).add("given")
    for c in "abcdefghijklmnopqrstuvwxyz":
        kinds.setdefault(f" {c}. ", set()).add("initial")
    for s in SAID_OF:
        kinds.setdefault(s, set()).add("saidof")
    for s in ("thanks to ", "meet ", "my name is ", "contact ", "birthday ", "landlord ", "landlady ", "just met ", "according to ", "soup with ", "merci à ", "gracias a ", "obrigado a ", "obrigada a ", "dank an ", "grazie a ", "dank aan ", "mr. ", "mrs. ", "ms. ", "dr. ", "herr ", "frau ", "signed "):
        kinds.setdefault(s, set()).add("namecue")
    a = ahocorasick.Automaton()
    for s, k in kinds.items():
        a.add_word(s, (len(s), tuple(k)))
    a.make_automaton()
    return a


def _is_iban(s: str) -> bool:
    """The check digits of an account number: its letters as numbers, the first four behind, leave 1 of 97."""
    s = "".join(s.split())
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _is_card(s: str) -> bool:
    """The check digit of a card number: every second digit from the right doubled, digits summed."""
    d = [int(c) for c in s if c.isdigit()][::-1]
    return len(d) >= 15 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every personal item, in order, without overlaps."""
    t = text.translate(_same_length())
    low = t.lower()
    if len(low) != len(t):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    at: dict[str, list[int]] = {}
    cues: list[tuple[int, int]] = []
    for end, (n, kinds) in automaton().iter(low):
        for k in kinds:
            at.setdefault(k, []).append(end + 1 - n)
            if k == "cue":
                cues.append((end + 1 - n, end + 1))
    if low[:1].isalpha() and low[1:3] == ". ":
        at.setdefault("initial", []).append(-1)
    if not at:
        return []
    taken: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in taken)

    words = [m.span() for m in _TOKEN.finditer(t)]
    begins = [x for x, _ in words]

    def windows(places: list[int], reach: int) -> list[tuple[int, int]]:
        """The places with ``reach`` words on either side, together where they meet."""
        out: list[list[int]] = []
        for p in sorted(places):
            i = max(0, bisect_right(begins, max(p, 0)) - 1)
            # a place before a word belongs to the word behind it
            lo, hi = max(0, i - reach), min(len(words) - 1, i + reach + 1)
            while reach == REACH["spelled"] and hi + 1 < len(words) and (low[slice(*words[hi])] in _DOT or low[slice(*words[hi + 1])] in _DOT):
                hi += 1
            a, b = words[lo][0], words[hi][1]
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def search(pattern: re.Pattern, places: list[int], kind: str, reach: str, ok=None) -> None:
        for a, b in windows(places, REACH[reach]):
            while m := pattern.search(t, a, b):
                if free(m.start(), m.end()) and (ok is None or ok(m)):
                    taken.append((m.start(), m.end(), kind))
                    a = m.end()
                else:
                    a = m.start() + 1

    cased = any(c.isupper() for c in t) and any(c.islower() for c in t)
    if "scheme" in at and "email" in at:
        search(USERINFO, at["scheme"], "account", "email")
    if "number" in at:
        search(IBAN, at["number"], "account", "number", lambda m: _is_iban(m.group()))
        search(CARD, at["number"], "account", "number", lambda m: _is_card(m.group()) and not OTHER_NUMBERS.search(t[max(0, m.start() - 32) : m.start()]))
    if "email" in at:
        search(EMAIL, [p for p in at["email"] if t[p] == "@"], "email", "email")
        search(EMAIL_MARKED, at["email"], "email", "spelled", lambda m: m.group().strip()[-1].isalpha())
        search(EMAIL_SPELLED, at["email"], "email", "spelled", lambda m: re.split(r"[\s.]+", m.group().lower())[-1] in SPELLED_TLDS)
    if "street" in at and any(c.isdigit() for c in t):
        for i, pattern in enumerate(ADDRESS):
            search(pattern, at["street"], "address", "street", lambda m, i=i: _address_ok(m, i, t, cased))
    if "number" in at:
        plain = lambda m: not OTHER_NUMBERS.search(t[max(0, m.start() - 32) : m.start()])
        search(ID_ALONE, at["number"], "id_number", "number", lambda m: plain(m) and m.group()[-1:].upper() == m.group()[-1:])
        if "cue" in at:
            search(ID_CUED, at["number"], "id_number", "number", lambda m: plain(m) and 6 <= _digits(m.group()) <= 13 and _cued(t, m, cues))
        for i, pattern in enumerate(PHONE):
            least = 9 if i == 0 else 7
            search(pattern, at["number"], "phone", "number", lambda m, least=least: plain(m) and least <= _digits(m.group()) <= 15)
    for p in at.get("given", ()):
        e = p
        while e < len(t) and (t[e].isalnum() or t[e] in "'’-"):
            e += 1
        if (p and (t[p - 1].isalnum() or t[p - 1] in "@._-'’+&/#")) or low[p:e] not in GIVEN and low[p:e] not in GIVEN_OTHER or (e < len(t) and t[e] in "@_+"):
            continue
        m = NAME_AFTER.match(t, e) if t[p].isupper() else None
        if m and m.end() < len(t) and t[m.end()] in "@_+":
            m = None
        if not m and not cased and t[p].islower():
            m = NAME_LOWER.match(t, e)
            if m and not _NAME_CUE.search(low[max(0, p - 40) : p]):
                m = None
        if m and m.group(1).lower().strip("'’s") not in NOT_SURNAME and m.group(1).lower() not in NOT_SURNAME and len(m.group(1)) >= 3:
            if cased and m.group(1).isupper() != t[p:e].isupper() and len(t[p:e]) > 1 and m.group(1).isupper():
                continue
            if free(p, m.end()):
                taken.append((p, m.end(), "person_name"))
                continue
        r = NAME_REVERSED.search(t[max(0, p - 40) : p])
        opens = r and not _OPENERS.match(r.group()) and re.search(r"(?:^|[.!?]\s)$", t[max(0, p - 42) : max(0, p - 40) + r.start()]) and re.match(r"\s+[a-z]{3,}\s", t[e : e + 20])
        if t[p].isupper() and r and (opens or _NAME_CUE.search(t[max(0, p - 90) : max(0, p - 40) + r.start()])) and free(p - len(r.group()), e):
            taken.append((max(0, p - 40) + r.start(), e, "person_name"))
    for p in at.get("initial", ()):
        m = NAME_INITIAL.match(t, p + 1)
        if m and len(m.group(1)) >= 4 and m.group(1).lower() not in NOT_SURNAME and free(m.start(), m.end()) and not re.search(r"\d[a-z]?\s*$", t[max(0, p - 4) : p + 1]):
            if cased and not _street_follows(low, m.end()) and (_NAME_CUE.search(t[max(0, p - 40) : p + 1]) or m.group(1)[1:].islower()):
                taken.append((m.start(), m.end(), "person_name"))
    for p in at.get("namecue", ()):
        cue = p + len(next((w for w in re.findall(r"^\S+ (?:\S+ )??(?=\S)", t[p : p + 30])), ""))
        for q in {cue, t.find(" ", p) + 1, t.find(" ", t.find(" ", p) + 1) + 1}:
            if q <= p or not _NAME_CUE.search(t[max(0, q - 40) : q]):
                continue
            m = NAME_CUED.match(t, q)
            if m and cased and not {m.group(1).lower(), m.group(2).lower()} & NOT_SURNAME and free(m.start(1), m.end()) and not (m.group(1).isupper() ^ m.group(2).isupper()):
                taken.append((m.start(1), m.end(), "person_name"))
    for p in at.get("saidof", ()):
        m = NAME_ENDS.search(t, max(0, t.rfind(".", 0, p) + 1), p) if cased else None
        if m:
            # a word that opens the sentence before the name is none of it
            names = [m.group(1), *m.group(2).split()]
            start = m.start()
            if len(names) > 2 and _OPENERS.match(names[0]):
                start, names = m.start(2) + 1, names[1:]
            if not {x.lower() for x in names} & NOT_SURNAME and not _OPENERS.match(names[0]) and free(start, m.end(2)):
                taken.append((start, m.end(2), "person_name"))
    return sorted(taken)


def _street_follows(low: str, end: int) -> bool:
    return bool(re.match(rf"\.?\s+(?:{_EN_STREET})\b", low[end : end + 16]))


def _address_ok(m: re.Match, i: int, t: str, cased: bool) -> bool:
    s = m.group()
    if i == 0:
        words = [w for w in re.findall(r"[^\W\d_][\w'’.-]*", s) if w.lower() not in ("flat", "unit", "apt", "apartment")]
        names = words[:-1] if len(words) > 1 else words
        # in normal spelling the words of a street's name are capitalised
        return not cased or all(w[0].isupper() for w in names if len(w) > 1) or t[: m.start()].upper() == t[: m.start()] and s.upper() == s
    if i in (1, 4):
        return not cased or s.lstrip()[0].isupper()
    if i == 3 and cased:
        name = re.findall(r"[^\W\d_][\w'’.-]*", s)
        return any(w[0].isupper() for w in name[1:]) and (name[0][0].isupper() or name[0].lower() in ("calle", "c", "rua", "via", "plaza", "ul."))
    return True


def _cued(t: str, m: re.Match, cues: list[tuple[int, int]]) -> bool:
    """A cue stands close before the number, or right after it in the same sentence."""
    return any((0 <= m.start() - e <= 30 and not re.search(r"[.!?]\s+[A-ZÀ-Þ][a-zß-ÿ]", t[e : m.start()])) or (0 <= s - m.end() <= 16 and not re.search(r"[.!?]", t[m.end() : s])) for s, e in cues)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def personal_kinds(rows: DataFrame, src: str, rec_key, text: str) -> DataFrame:
    """(src, rec_key, kind): one row per record and kind of personal item in ``text``.

    Null and empty texts give no row; a repeated row is a record of its own.
    """
    picked = rows.select(rec_key.alias("rec_key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            enc = b.column("text").cast(pa.string()).dictionary_encode()
            kinds = [sorted({k for _, _, k in find_spans(s) if k in KINDS}) for s in enc.dictionary.to_pylist()]
            has = {i for i, k in enumerate(kinds) if k}
            if not has:
                continue
            keys = b.column("rec_key")
            out = [(keys[r].as_py(), k) for r, i in enumerate(enc.indices.to_pylist()) if i in has for k in kinds[i]]
            yield pa.RecordBatch.from_arrays([pa.array([src] * len(out)), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out])], ["src", "rec_key", "kind"])

    return picked.mapInArrow(run, "src string, rec_key string, kind string")


def redacted(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``{text}_redacted``: typed placeholders in the place of personal items, else unchanged; null stays null."""
    rows = rows.drop(f"{text}_redacted")
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(f"{text}_redacted", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            enc = b.column(text).cast(pa.string()).dictionary_encode()
            done = pa.array([redact(s, find_spans(s)) for s in enc.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), done.take(enc.indices)], [*names, f"{text}_redacted"])

    return rows.mapInArrow(run, schema)
