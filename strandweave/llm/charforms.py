"""One consistent form of text that looks the same: tables by rule, and the same fold in Python and in DuckDB.

The *skeleton* of a text equals that of another exactly if both read the same: width
forms, composition, ligatures, invisible characters, kinds of space and look-alike
letters are folded; case, accents, words and marks are kept. The *form* is the skeleton
rendered readably: a word with a Cyrillic or Greek letter that has no Latin double gets
that script's letters back. It is a function of the skeleton and can be folded back, so
texts have equal forms exactly if they have equal skeletons.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Look-alike letters by the Latin letter they look like (a subset of the public
# Unicode confusables data: letters that look the same in common fonts).
LOOKALIKES = {
    "a": "аɑ⍺", "c": "сϲⅽ", "d": "ԁ", "e": "е℮", "g": "ɡ",
    "h": "һհ", "i": "іⅰ", "j": "јϳ", "l": "ӏⅼ", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "νѵⅴ", "w": "ԝѡ",
    "x": "хⅹ", "y": "уү", "z": "ᴢ",
    "A": "АΑⱭ", "B": "ВΒ", "C": "СϹ", "D": "Ԁ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ",
    "H": "НΗҺ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚK", "M": "МΜϺ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ",
    "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
}
# The same for letters of the Cherokee and Lisu scripts.
for _latin, _other in zip("ABCDEGHJKLMPRSTVWZ", "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", strict=True):
    LOOKALIKES[_latin] = LOOKALIKES.get(_latin, "") + _other
for _latin, _other in zip("ABCDEFGHIJKLMNOPRSTUVWXYZ", "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", strict=True):
    LOOKALIKES[_latin] = LOOKALIKES.get(_latin, "") + _other

# Characters without width, beside the categories Cf (format) and variation selectors.
INVISIBLE = (
    "\u00ad\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068"
    "\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufeff\uffa0\u3164\ufff9\ufffa\ufffb"
)

#: Compatibility decompositions that only change the form, not what one reads.
SAME_TO_THE_EYE = {"<wide>", "<narrow>", "<compat>", "<square>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>"}
_KEPT = set("¨¯´¸˘˙˚˛˜˝ͺ΄΅᾽᾿῀῾‗‾゛゜")


@lru_cache(maxsize=1)
def latin_of() -> dict[str, str]:
    return {c: latin for latin, others in LOOKALIKES.items() for c in others}


def _compat(c: str) -> str:
    """The compatibility form of one character where it is the same to the eye, recursively."""
    d = unicodedata.decomposition(c)
    if not d or c in _KEPT:
        return c
    parts = d.split()
    if parts[0][0] == "<":
        if parts[0] not in SAME_TO_THE_EYE:
            return c
        parts = parts[1:]
        return "".join(_compat(chr(int(p, 16))) for p in parts)
    return c


@lru_cache(maxsize=1)
def char_map() -> dict[int, str]:
    """Code point -> folded text, for every code point that folds to something else (built by rule)."""
    latin, out = latin_of(), {}
    for cp in range(0x80, 0x1F000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0x4E00 <= cp <= 0x9FFF:
            continue
        c = chr(cp)
        if c in INVISIBLE:
            out[cp] = ""
            continue
        if unicodedata.category(c) == "Zs":
            out[cp] = " "
            continue
        t = "".join(latin.get(x, x) for x in _compat(c))
        # a precomposed letter whose base is a look-alike: fold the base, compose again
        t = "".join("".join(latin.get(y, y) for y in unicodedata.normalize("NFD", x)) if any(y in latin for y in unicodedata.normalize("NFD", x)) else x for x in t)
        t = unicodedata.normalize("NFC", t)
        if t != c:
            out[cp] = t
    for c, t in latin.items():
        out[ord(c)] = t
    return out


@lru_cache(maxsize=1)
def _work() -> re.Pattern:
    """Finds a character that the fold changes, or that composes with others."""
    folds = _ranges([*char_map(), *range(0x300, 0x370), *range(0x1100, 0x1200), 0x3099, 0x309A])
    return re.compile("[" + "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in folds) + "]")


def _ranges(cps) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for cp in sorted(set(cps)):
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return [(a, b) for a, b in out]


def skeleton(s: str) -> str:
    """The skeleton of ``s``; the same result as ``fold_sql`` in DuckDB."""
    if s.isascii():
        return s
    if not _work().search(s):
        return unicodedata.normalize("NFC", s)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", s.translate(char_map())).translate(char_map()))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cls(chars) -> str:
    """A regular-expression class of ``chars``, as ranges."""
    return "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in _ranges(ord(c) for c in set(chars))) + "]"


def fold_sql(source: str) -> str:
    """SQL: (i, s, sk), the skeleton of every text of ``source`` (i, s), one column a step."""
    inner = f"SELECT i, s, s AS x FROM {source} WHERE form_any(s)"
    for step in ("form_shed", "form_common", "form_rare", "form_many", "nfc_normalize", "form_common", "form_rare", "nfc_normalize"):
        inner = f"SELECT i, s, {step}(x) AS x FROM ({inner})"
    return f"SELECT i, s, x AS sk FROM ({inner}) UNION ALL SELECT i, s, nfc_normalize(s) FROM {source} WHERE NOT form_any(s)"


def duckdb_setup(con) -> None:
    """The steps of ``fold_sql`` as macros, and form_show, the readable form of a skeleton.

    ``translate`` costs in proportion to its table, so every step runs only on texts that a
    character class finds it has work on; the large table of rare forms is a step of its own.
    """
    one = {chr(k): v for k, v in char_map().items() if len(v) == 1}
    many = {chr(k): v for k, v in char_map().items() if len(v) > 1}
    common = {c: v for c, v in one.items() if c in latin_of() or v == " " or 0xFF01 <= ord(c) <= 0xFF5E}
    rare = {c: v for c, v in one.items() if c not in common}
    step = lambda x, d: f"CASE WHEN regexp_matches({x}, {_q(_cls(d))}) THEN translate({x}, {_q(''.join(d))}, {_q(''.join(d.values()))}) ELSE {x} END"
    con.execute(f"CREATE MACRO form_shed(s) AS CASE WHEN regexp_matches(s, {_q(_cls(INVISIBLE))}) THEN regexp_replace(s, {_q(_cls(INVISIBLE) + '+')}, '', 'g') ELSE s END")
    con.execute(f"CREATE MACRO form_common(s) AS {step('s', common)}")
    con.execute(f"CREATE MACRO form_rare(s) AS {step('s', rare)}")
    keys, values = ("[" + ",".join(_q(c) for c in x) + "]" for x in (many, many.values()))
    con.execute(
        f"CREATE MACRO form_many(s) AS CASE WHEN regexp_matches(s, {_q(_cls(many))}) THEN "
        f"array_to_string(list_transform(string_split(s, ''), lambda c: coalesce(list_extract({values}, list_position({keys}, c)::BIGINT), c)), '') ELSE s END"
    )
    folds = _q(_cls([*one, *many, *INVISIBLE, *(chr(c) for c in range(0x300, 0x370)), *(chr(c) for c in range(0x1100, 0x1200)), chr(0x3099), chr(0x309A)]))
    con.execute(f"CREATE MACRO form_any(s) AS regexp_matches(s, {folds})")
    for script, low, high in (("cyrillic", 0x0400, 0x052F), ("greek", 0x0370, 0x03FF)):
        pairs = {}
        for latin, others in LOOKALIKES.items():
            for c in others:
                if low <= ord(c) <= high and latin not in pairs:
                    pairs[latin] = c
        # composed letters, by rule: e with diaeresis has a Cyrillic double, and so on
        for cp, v in list(char_map().items()):
            if low <= cp <= high and len(v) == 1 and v not in pairs:
                pairs[v] = chr(cp)
        con.execute(f"CREATE MACRO form_{script}(w) AS translate(w, {_q(''.join(pairs))}, {_q(''.join(pairs.values()))})")
    con.execute(
        "CREATE MACRO form_word(w) AS CASE WHEN regexp_matches(w, '[\\x{400}-\\x{52f}]') THEN form_cyrillic(w) "
        "WHEN regexp_matches(w, '[\\x{370}-\\x{3ff}]') THEN form_greek(w) ELSE w END"
    )
    con.execute(
        "CREATE MACRO form_show(s) AS CASE WHEN regexp_matches(s, '[\\x{370}-\\x{52f}]') THEN "
        "array_to_string(list_transform(string_split(s, ' '), lambda w: form_word(w)), ' ') ELSE s END"
    )
