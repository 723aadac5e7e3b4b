"""Template residue, filler, error pages and script notices.

Method. A text is judged block by block (a block is a line). Placeholders are cut out of a
block, which leaves its *template*, the fixed words (a label, a greeting, or nothing). Blocks
of all documents are aligned by these: a slot that is filled in another record of the same
template, or in which records keep different variable names, was never filled here, while a
placeholder that is the same in every record and filled in none is part of what the author
wrote (somebody who talks about ``${price}``), unless placeholders make up so much of the
block that it says nothing without them. Blanks and defaults are slots as well, where other
records fill them. Copies of a record change nothing in this, and more records only add
evidence. Whole-page templates (error and unavailability messages, script notices, filler)
are found by the share of a block that their vocabulary covers, so that a sentence about an
error does not count, and are aligned by their words without codes: most stand in many
different documents.

The evidence table is small against the corpus (blocks with a placeholder or a message).
Templates are made distinct before they are joined. Filled records are found by the longer
end of a template: a bitmap of these ends (``BITS`` bits, whatever the corpus holds) goes
to the second reading of the documents, which passes on only blocks that may have such an end.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .abuse import _ANY, _EDGE, _spelled
from .charforms import skeleton
from .languages import plain

BITS = 1 << 20
HOLE = "⁇"

# Forms of an unfilled placeholder.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\$\{[^{}\n]{0,60}\}|#\{[^{}\n]{0,60}\}|\{[A-Za-z_][\w.]*(?:![rsa])?(?::[^{}\s]{0,12})?\}|\{\d{0,2}\}"
    r"|\[\[[^\[\]\n]{1,60}\]\]|<%[^%\n]{0,60}%>|%%[A-Za-z_]+%%|%[A-Z]+(?:_[A-Z]+)+%|%\([A-Za-z_]\w*\)[sdr]|\$[A-Z][A-Z_]{2,30}\$|__[A-Z][A-Z_]{2,30}__"
    r"|\[(?:INSERT|YOUR|ADD|ENTER|NAME|TITLE|TEXT|DATE|PLACEHOLDER|REPLACE)\b[^\[\]\n]{0,60}\]|\[[^\[\]\n]{0,40}\b(?:tbd|tba|todo|goes here|here)\]"
    r"|<(?:name|your[_ -]?\w*|insert[_ -]?\w*|user(?:name)?|title|text|date|placeholder|[A-Z]+(?:_[A-Z]+)+)>"
    r"|\[object Object\]|\bundefined\b|\bNaN\b|(?<![\w/.-])(?:X{4,}|x{5,}|_{4,}|\?{5,})(?![\w/.-])|\b(?:TODO|FIXME|TBD)\b(?::[^.\n]{0,40})?|(?<=^)(?:null|None|nil|N/A)(?=$)",
    re.IGNORECASE,
)

# What stands in a slot that was filled with nothing or with a default; it counts only where other records have the slot filled.
SOFT = re.compile(
    r"(?<=[^\W\d_]) (?=[,.](?:\s|$))|(?<=\s)(?:\(\s*\)|\"\s*\"|“\s*”|«\s*»)(?=[\s.,!?]|$)|\b(?:John Doe|Jane Doe|Your Name|Company Name|First Last|Max Mustermann|Jean Dupont|Juan Pérez|Mario Rossi)\b"
)

# Words of filler Latin.
LATIN_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur consecte adipiscing adipis adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco ullam laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit "
    "voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit "
    "anim id est laborum vestibulum vivamus pellentesque curabitur vel mauris at justo nec purus donec".split()
)
# Words that are repeated to fill space.
FILL_WORDS = frozenset("text test content sample lorem blah foo bar baz asdf asdfg asdfgh qwer qwert qwerty qwertz azerty zxcv yxcv hjkl jkl dfgh fghj placeholder dummy xxx abc texto texte tekst testo testing demo example テキスト ダミー テスト 텍스트 테스트 текст тест metin".split())

# Strong phrases of each kind of page template, as patterns on the case-folded block.
STRONG = {
    "error": re.compile(
        r"\b(?:error|erreur|fehler|erro|errore|fout|błąd|hata|ошибка|помилка)\b\s*[:#=(]?\s*\d{3}\b|\b[45]\d\d\b[\s:.-]+(?:[a-z]+ )?(?:not found|forbidden|gateway|service|internal|error|unauthori[sz]ed|timeout|bad|gone|too many|unavailable)"
        r"|not found\b|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|temporarily unavailable|internal server error|\bforbidden\b|too many requests|rate limit|access (?:is )?denied|don't have permission|do not have permission"
        r"|something went wrong|no longer (?:available|exists)|is (?:currently )?(?:not available|unavailable)|n'est (?:plus|pas) disponible|introuvable|nicht gefunden|nicht (?:mehr )?verfügbar|existiert nicht|no encontrad[ao]|ya no está disponible|no (?:está|esta) disponible"
        r"|não encontrad[ao]|não está (?:mais )?disponível|non (?:è stata )?trovat[ao]|non (?:è )?(?:più )?disponibile|niet gevonden|niet (?:meer )?beschikbaar|nie znaleziono|niedostępn|bulunamadı|не найден|недоступн|не знайдено|見つかりません|エラー|利用できません|찾을 수 없|오류"
        r"|\btraceback\b|\bkeyerror\b|\bexception\b|stack trace|segmentation fault|upstream|connection (?:was )?(?:reset|refused|timed out|lost)|request (?:has )?timed out|timed? ?out|checking your (?:connection|browser)|verify (?:that )?you are (?:a )?human|are you (?:a )?(?:human|robot)|captcha"
        r"|under maintenance|scheduled maintenance|session (?:has )?expired|could not be (?:found|served|loaded|displayed)|failed to load|unable to load|couldn't load|can't be reached|cannot be displayed|status=[45]\d\d|an (?:unexpected )?error (?:has )?occurred|try again later|please try again"
    ),
    "script": re.compile(
        r"(?:javascript|\bjs\b|\bscripts?\b|スクリプト|自바스크립트|스크립트|скрипт).{0,60}(?:enabl|activ|requir|need|must|disabl|block|allow|turn|switch|support|through|aktiv|nécessaire|einschalt|erforder|necess|activ|włącz|etkin|включ|увімк|有効|無効|필요|활성)"
        r"|(?:enabl|activ|requir|need|must|disabl|block|allow|turn|switch|without|through|aktivier|active|habilit|attiv|ative|schakel|włącz|etkin|включ|увімк).{0,60}(?:javascript|\bjs\b|\bscripts?\b|スクリプト|скрипт)"
    ),
    "filler": re.compile(
        r"placeholder|coming soon|under construction|intentionally (?:left )?blank|for layout\b|layout (?:purposes )?only|dummy (?:post|page|entry|content|profile|description|message)|(?:text|content|bio|name|title|description|caption|story|headline) (?:goes )?here\b|sample text|dummy text|replace this|replace me|your own (?:content|text|words)|lorem ipsum|insert .{0,20}here|to be (?:added|written|replaced|announced)"
        r"|texto de (?:ejemplo|exemplo|relleno|prueba)|sustituir antes|texte à remplacer|texte d'exemple|faux texte|platzhalter|beispieltext|blindtext|mustertext|hier (?:steht|kommt|text)|testo (?:di esempio|segnaposto)|voorbeeldtekst|tekst zastępczy|przykładowy tekst|örnek metin|пример текста|текст-заполнитель|приклад тексту|ダミーテキスト|ここに.{0,12}(?:入|書|テキスト)|サンプルテキスト|여기에|예시 텍스트"
    ),
}

# Further words of such messages (with their strong phrases they make up most of a message).
MESSAGE_WORDS = frozenset(
    "error errors page pages site app application feed thread post posts profile resource resources content server status reference incident ray request requested requests connection browser "
    "please enable enabled disabled disable activate allow allowed turn switch javascript js script scripts required requires needs need run start load loaded loading reload refresh retry try again later minutes seconds after "
    "sorry oops removed author available unavailable longer anymore moved deleted exists exist found not missing permission permissions view access denied forbidden unauthorized gateway bad timeout temporarily service internal "
    "went wrong something while checking continue takes few wait network check part did work properly without support supports blocks block nothing shown here show display displayed open use see rendering "
    "keyerror traceback exception upstream headers sent gave reason overflow too many rate limited limit served could cannot can't doesn't don't does back home help terms powered id "
    "session expired log login sign signed in out again account password cookies cookie verify human robot captcha security maintenance scheduled dummy used layout only purposes coming soon under construction intentionally left blank entry message unexpected occurred unable failed reach reached "
    "text sample goes replace own placeholder description section bio tell people who you are example insert add publishing before dummy name "
    "veuillez activer afficher contenu cette publication page n'est plus disponible erreur introuvable réessayez tard texte remplacer avant publication "
    "bitte aktivieren sie um diese seite zu sehen nicht gefunden angeforderte angeforderter inhalt existiert mehr fehler später versuchen verfügbar "
    "active en su navegador para continuar página encontrada vuelva intentarlo más tarde texto ejemplo sustituir antes publicar habilite "
    "hier steht blindtext mustertext er wird ersetzt ersetzen inhalt folgt bald "
    "pagina niet gevonden gevraagde inhoud bestaat trovata riprova più tardi não encontrada tente novamente ative no seu "
    "страница страницу страницы не найдена найден найдено найдены ошибка сервер сервера сервис недоступен недоступна недоступно временно запрос доступ запрещен запрещён пожалуйста попробуйте повторите позже попытку снова раз обновите извините "
    "удалена удален удалён удалено больше существует контент публикация запись автор включите скрипты браузере вашем просмотра просмотреть увидеть продолжить эту этой этого текст текста пример замените перед публикацией "
    "сторінка сторінку сторінки знайдено знайдена помилка недоступний тимчасово запит заборонено будь ласка спробуйте пізніше ще оновіть вибачте видалено більше існує вміст допис публікація увімкніть скрипти браузері вашому перегляду переглянути побачити продовжити цю цієї приклад тексту замініть "
    "strona strony stronę nie znaleziono znaleziona została błąd serwera serwer niedostępna niedostępny niedostępne tymczasowo żądanie dostęp zabroniony proszę spróbuj ponownie później odśwież przepraszamy usunięta usunięty już istnieje treść wpis włącz skrypty przeglądarce aby zobaczyć wyświetlić kontynuować tę tej jest tekst zastępczy przykładowy zastąp "
    "sayfa sayfası sayfayı bulunamadı hata sunucu hizmet kullanılamıyor geçici olarak istek erişim engellendi lütfen tekrar deneyin daha sonra yenileyin üzgünüz silinmiş kaldırıldı artık mevcut değil içerik gönderi etkinleştirin etkin tarayıcınızda görmek görüntülemek devam etmek için bu örnek metin yerine "
    "está disponível ".split()
)
# Words that say nothing about the kind of a block.
NEUTRAL = frozenset("the a an of to in on at for by with from and or it its this that these is was be has have been will may must no your our my we us as so let if when then than de la le les des du et à el los las un una y o der die das den dem ein eine und zu im il lo di da em e do os het een van i w na ve bir".split())
FURNITURE = re.compile(r"^(?:powered by \S+|back to the (?:start|home) ?page|home(?: \| \w+)+|©.{0,40}|\W*)$", re.IGNORECASE)
_LABEL = re.compile(r"^\s*([^\W\d_][\w ]{0,24}?)\s?:\s+(?=\S)")
# What every placeholder holds some of, in lower case; and every blank or default.
_MAYBE = re.compile(r"[{\[<%$]|__|\?{5}|x{4}|undefined|\bnan\b|todo|fixme|tbd|^(?:null|none|nil|n/a)$")
_SOFT_SIGNS = (" ,", " .", "(", '"', "“", "«", "Doe", "Your Name", "Company Name", "First Last", "Mustermann", "Dupont", "Juan Pérez", "Mario Rossi")
_WORDS = re.compile(r"[^\W_](?:[\w'’-]*[^\W_])?")
_PIECES = re.compile(rf"{HOLE}|{_WORDS.pattern}")
_HOLES = re.compile(f"{HOLE}(?: {HOLE})*")
_CJK = re.compile(r"[぀-ヿ一-鿿가-힣]")
_LINES = re.compile(r"[\r\n\u2028\u2029\x0b\x0c\x85]+")
_SENTENCES = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_CLAUSES = re.compile(r"[、，,;；]\s*")
_CODE = re.compile(r"^(?:\d+|[0-9a-f]*\d[0-9a-f-]*)$")


@lru_cache(maxsize=1)
def _hints():
    """Finds what every strong phrase (by all readings of its pattern) and every filler holds some of, with the kinds that need it."""
    import ahocorasick

    of: dict[str, set[str]] = {}
    for kind, p in STRONG.items():
        for r in _spelled(_parser.parse(p.pattern)):
            of.setdefault(max(re.split(f"[{_ANY}{_EDGE}]", r), key=len), set()).add(kind)
    for w in (*FILL_WORDS, *(w for w in LATIN_FILLER if len(w) >= 4)):
        of.setdefault(w, set()).add("words")
    a = ahocorasick.Automaton()
    for h, kinds in of.items():
        a.add_word(h, frozenset(kinds))
    a.make_automaton()
    return a


def _message(block: str) -> str | None:
    """The kind of page template or filler that the block as a whole is, else None."""
    low = block.casefold().replace("’", "'")
    # only patterns of whose phrases a part is there are tried
    kinds: set[str] = set()
    for _, k in _hints().iter(low):
        kinds |= k
    if not kinds:
        return None
    words = [w for w in _WORDS.findall(low) if not _CODE.match(w)]
    if not words:
        return None
    telling = [w for w in words if w not in NEUTRAL] or words
    if "words" in kinds:
        if len(words) >= 4:
            if sum(w in LATIN_FILLER for w in words) >= 0.7 * len(words):
                return "filler"
            top, n = Counter(words).most_common(1)[0]
            if top in FILL_WORDS and n >= 0.7 * len(words):
                return "filler"
        if len(words) >= 3 and all(w in FILL_WORDS for w in words):
            return "filler"
    covered = sum(w in MESSAGE_WORDS or w in FILL_WORDS for w in telling) / len(telling)
    cjk = bool(_CJK.search(low))
    for kind, strong in STRONG.items():
        if kind not in kinds or not strong.search(low):
            continue
        if cjk:
            # the parts with the phrase must be most of it
            parts = [x for x in _CLAUSES.split(low) if x.strip()]
            if sum(len(x) for x in parts if strong.search(x)) >= 0.5 * sum(map(len, parts)):
                return kind
        elif covered >= 0.6:
            return kind
        else:
            # a language whose words are not listed: the phrase must be most of the message
            said = sum(len(m.group()) for m in strong.finditer(low))
            if said >= 0.6 * len(low.strip()):
                return kind
    return None


def _bodies(block: str) -> list[str]:
    """A block without its label, and as it is."""
    m = _LABEL.match(block)
    return [block[m.end() :], block] if m else [block]


def _said(body: str) -> str | None:
    """The kind of message that a body is as a whole or in each of its sentences."""
    # a sentence holds no hint that the body does not hold
    if next(_hints().iter(body.casefold().replace("’", "'")), None) is None:
        return None
    parts = [_message(x) for x in _SENTENCES.split(body) if not FURNITURE.match(x)]
    return _message(body) or (parts[0] if len(parts) > 1 and all(parts) else None)


def judge(text: str) -> list[tuple[str, str, str | None]]:
    """(kind, template, placeholders) of every suspicious block.

    The template of a message is its words with codes left out; slots are ``bare`` (the block
    says nothing without its placeholders), ``slot``, or ``soft`` (a blank or a default).
    """
    out: list[tuple[str, str, str | None]] = []
    for b, *forms in _forms(text):
        if FURNITURE.match(b):
            continue
        kind = next((k for f in (b, *forms) for x in _bodies(f) if (k := _said(x))), None)
        if kind:
            out.append((kind, " ".join(w for w in _WORDS.findall(b.casefold()) if not _CODE.match(w)), None))
            continue
        if _MAYBE.search(b.lower()):
            spots = [m.group().casefold() for m in PLACEHOLDER.finditer(b)]
            if spots:
                template = _template(b)
                empty = any(not _WORDS.search(PLACEHOLDER.sub(" ", x)) and PLACEHOLDER.search(x) for x in _bodies(b))
                bare = empty or _bare(len(spots), len(template) - len(spots))
                out.append(("bare" if bare else "slot", " ".join(template), "\n".join(spots)))
                continue
        if any(x in b for x in _SOFT_SIGNS) and (soft := SOFT.search(b)) and len(template := _template(b, SOFT)) >= 5:
            out.append(("soft", " ".join(template), soft.group().casefold()))
    return out


def _template(block: str, holes: re.Pattern = PLACEHOLDER) -> list[str]:
    """The words of a block, with ``HOLE`` for every placeholder."""
    return [w if w == HOLE else w.casefold() for w in _PIECES.findall(holes.sub(f" {HOLE} ", block))]


def _bare(spots: int, words: int) -> bool:
    """Whether a block with so many placeholders and other words says nothing without the placeholders."""
    return words <= 3 or spots >= 2 and words <= 4 * spots


def _end(template: list[str]) -> tuple[str, list[str]] | None:
    """The key by which filled records of a template are found: its longer end (the last backwards), else its first inner words."""
    n = len(template)
    first = template.index(HOLE)
    back = template[::-1].index(HOLE)
    if first or back:
        return ("^", template[:first]) if first >= back else ("$", template[: n - back - 1 : -1])
    runs = [r.split() for r in " ".join(template).split(HOLE) if r.strip()]
    return ("~", max(runs, key=len)[:2]) if runs else None


def _bit(kind: str, words: list[str]) -> int:
    return zlib.crc32("".join([kind, *(f" {w}" for w in words)]).encode()) % BITS


def _ends(words: list[str], bits: np.ndarray, heads: np.ndarray, sizes: dict[str, set[int]]) -> Iterator[str]:
    """The keys of templates of which a block of these words may be a filled record, by their bits (of the first word, then of all) and numbers of words."""
    n = len(words)
    for kind, row in (("^", words), ("$", words[::-1])):
        if sizes[kind] and n > 1:
            h = zlib.crc32(f"{kind} {row[0]}".encode())
            if not heads[h % BITS]:
                continue
            if 1 in sizes[kind] and bits[h % BITS]:
                yield f"{kind} {row[0]}"
            for k, w in enumerate(row[1 : min(n - 1, max(sizes[kind]))], 2):
                h = zlib.crc32(f" {w}".encode(), h)
                if k in sizes[kind] and bits[h % BITS]:
                    yield " ".join([kind, *row[:k]])
    for k in sizes["~"]:
        for i in range(1, n - k):
            if heads[_bit("~", words[i : i + 1])] and bits[_bit("~", words[i : i + k])]:
                yield " ".join(["~", *words[i : i + k]])


def _forms(text: str) -> list[list[str]]:
    """The blocks of a text: the skeleton of each, and where they differ its plain form and the block as written.

    A skeleton has Latin letters for look-alikes in every word, so words of other scripts can be read only in the other forms.
    """
    out = []
    for block in _LINES.split(text if text.isascii() else unicodedata.normalize("NFC", text)):
        forms = [block] if block.isascii() else [skeleton(block), plain(block), block]
        forms = list(dict.fromkeys(" ".join(f.split()) for f in forms))
        if forms[0]:
            out.append(forms)
    return out




def _blocks(text: str) -> list[str]:
    """The skeletons of the blocks of a text."""
    out = []
    for block in _LINES.split(text if text.isascii() else unicodedata.normalize("NFC", text)):
        form = " ".join((block if block.isascii() else skeleton(block)).split())
        if form:
            out.append(form)
    return out


_EVIDENCE = "kind string, template string, value string, whole bigint"


def find_residue(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, kind, evidence): documents with residue, by kind and by what shows it; one row for each.

    Null, empty and blank texts are no case. Copies are judged alike, each under its own id,
    and never count as evidence for each other. Slots are ``placeholder`` with the evidence
    ``aligned`` (another record of the same template has the slot filled, or records of it
    keep different placeholders) or ``alone`` (the block says nothing without its placeholders).
    Blanks and defaults need two records that fill their slot differently. Messages (``error``,
    ``script``, ``filler``) have the evidence ``repeated`` (the page template stands in several
    different documents) or ``alone``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            known: dict[str, list] = {}
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t or not t.strip():
                    continue
                got = known.get(t)
                if got is None:
                    got = known[t] = [(*x, zlib.crc32(t.encode()) | zlib.adler32(t.encode()) << 32) for x in dict.fromkeys(judge(t))]
                rows += [(d, *x) for x in got]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([_signed(x) for x in c] if t is types[4] else c, t) for c, t in zip(cols, types, strict=True)], [doc, "kind", "template", "value", "whole"])

    evidence = cut(docs.select(doc, text).mapInArrow(run, f"{doc} bigint, {_EVIDENCE}"))
    messages = evidence.where("value IS NULL")
    pages = messages.groupBy("template").agg((F.min("whole") != F.max("whole")).alias("again"))
    slots = evidence.where("value IS NOT NULL").select(doc, F.col("kind").alias("how"), "template", "value")
    templates = slots.groupBy("template").agg((F.min(F.when(F.col("how") != "soft", F.col("value"))) != F.max(F.when(F.col("how") != "soft", F.col("value")))).alias("varied"))
    templates = templates.withColumn("varied", F.coalesce("varied", F.lit(False)))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keyed = [(t, " ".join([e[0], *e[1]]), e[0], len(e[1]), _bit(*e), _bit(e[0], e[1][:1]), f"^{_HOLES.sub('.+', t)}$") for t in b.column(0).to_pylist() if (e := _end(t.split()))]
            cols = list(zip(*keyed, strict=True)) if keyed else [[]] * 7
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["template", "end", "place", "size", "bit", "head", "pattern"])

    open_ = cut(templates.where("NOT varied").select("template").mapInArrow(ends, "template string, end string, place string, size int, bit int, head int, pattern string"))
    # at most BITS numbers, and one for each number of words that an end has
    bits, heads = np.zeros(BITS, bool), np.zeros(BITS, bool)
    sizes: dict[str, set[int]] = {"^": set(), "$": set(), "~": set()}
    for place, size in open_.select("place", "size").distinct().collect():
        sizes[place].add(size)
    bits[[r[0] for r in open_.select("bit").distinct().collect()]] = True
    heads[[r[0] for r in open_.select("head").distinct().collect()]] = True

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple[str, str]] = set()
            for t in set(b.column(0).to_pylist()):
                for block in _blocks(t) if t and t.strip() else ():
                    words = _template(block) if _MAYBE.search(block.lower()) else [w.casefold() for w in _WORDS.findall(block)]
                    if HOLE not in words:
                        out.update((e, " ".join(words)) for e in _ends(words, bits, heads, sizes))
            cols = list(zip(*out, strict=True)) if out else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["end", "record"])

    aligned = templates.where("varied").select("template", F.lit(2).alias("fillings"))
    if bits.any():
        records = docs.select(text).mapInArrow(filled, "end string, record string").distinct()
        fits = open_.join(records, "end").where("record RLIKE pattern")
        aligned = aligned.unionByName(fits.groupBy("template").agg(F.when(F.min("record") != F.max("record"), 2).otherwise(1).alias("fillings")))
    judged = slots.join(aligned, "template", "left").where("how = 'bare' OR (how = 'slot' AND fillings >= 1) OR fillings >= 2")
    shown = judged.select(doc, F.lit("placeholder").alias("kind"), F.when(F.col("fillings").isNotNull(), F.lit("aligned")).otherwise(F.lit("alone")).alias("evidence"))
    told = messages.join(pages, "template").select(doc, "kind", F.when(F.col("again"), F.lit("repeated")).otherwise(F.lit("alone")).alias("evidence"))
    return told.unionByName(shown).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
