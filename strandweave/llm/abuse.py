"""Abusive, hateful and sexual content: a score and a decision for every text, and rates per source.

Method. Text is brought to its plain form (see ``languages.plain``), letters spelled out
with spaces or dots are joined, and every word is matched with a lexicon by a Levenshtein
automaton run over the lexicon's trie: the rows of the automaton are carried down the trie,
so all terms within the allowed distance come from one walk. Digits for letters, masks
(``*``) and repeated letters cost nothing; other edits (a swap of neighbours is one) cost
one. A word that is a whole token of a public vocabulary is frequent and never taken for a
misspelling. Words become lexicon terms with classes; a window of terms (insult, address,
threat, group, contempt, sexual request) makes a sentence suspicious, and its score comes
from the context of the window: a logistic model of signs such as quotation, the writer's
own person, a negation or a harmless sense, fitted to the reviewed texts. A word that
nobody knows is also read as the name of a group.

Words are remembered by each worker (bounded), texts are made distinct in each Arrow
batch, and nothing is shuffled but the counts of the rates.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as _c
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import plain

THRESHOLD = 0.5
KEPT = 300_000
CORE = frozenset({"insult", "slight", "sexual", "contempt", "group"})

# The lexicon, by class, in natural order of language (en de es fr it pt nl pl ru uk tr).
TERMS: dict[str, str] = {
 "insult": (
 "idiot idiots moron morons clown clowns loser losers creep creeps parasite parasites scumbag scumbags degenerate degenerates coward cowards fraud frauds pig pigs rat rats fool fools imbecile imbeciles cretin "
 "bastard bastards bitch bitches asshole assholes dickhead wanker whore slut retard retarded trash garbage scum filth vermin worm cockroach cockroaches jerk dumbass twat prick dimwit halfwit swine lowlife pervert "
 "cunt cunts bellend knobhead tosser tossers arsehole arseholes shithead shitbag prat numpty nitwit dunce simpleton buffoon weirdo freak freaks traitor traitors slob hag skank douche douchebag motherfucker fucker fuckers git lardass "
 "dipshit dumbfuck fatso sicko psycho deadbeat dirtbag scumbags whores sluts wankers jackass dolt fuckwit fuckface shitface bimbo hooker pedo paedo nutcase crybaby snowflake leech liar liars brat brats "
 "trottel abschaum versager drecksack schwein arschloch wichser hurensohn missgeburt penner vollidiot dummkopf mistkerl schlampe hure fotze ratte depp deppen arsch drecksau miststück vollpfosten schwachkopf trottel spast versagerin nichtsnutz "
 "imbécil imbecil idiota idiotas parásito parasito rata ratas cerdo cerda basura escoria payaso gilipollas cabrón cabron puta puto pendejo estúpido estúpida estupido inútil mierda zorra subnormal tarado cobarde gusano capullo maricón maricon boludo pelotudo imbéciles idiotas cretino hijueputa "
 "porc ordure imbécile connard connasse salaud salope lâche minable déchet vermine abruti crétin pouffiasse enculé sous-merde raclure merde pute bouffon bouffonne salopard salopards connards crétins abrutis minable tocard trou-du-cul "
 "fallito verme parassita stronzo stronza bastardo coglione cretino deficiente maiale feccia schifoso schifosa puttana troia vigliacco spazzatura merda idiota imbecille scemo scema pirla stupida stronzi idioti cretini bastardi "
 "lixo verme otário babaca imbecil canalha vagabundo vagabunda porco covarde nojento escroto arrombado fracassado merda idiota otária burra imbecis idiotas vadia puta desgraçado desgraçada "
 "idioot sukkel klootzak eikel lul hoer mongool varken rat tuig uitschot loser kneus lafaard trut debiel rotzak teef stommeling achterlijke "
 "debil kretyn śmieć szmata gnój dupek skurwysyn świnia pasożyt szczur tchórz frajer palant kurwa idiota idiotka idiotką idiotko idiotą suka gnida dziwka śmieciem zerem ścierwo kretynka kretyni "
 "урод кретин паразит мразь тварь дебил дурак идиот сволочь ублюдок скотина свинья ничтожество отброс мусор крыса крысы трус гнида сука шлюха придурок чмо "
 "виродок покидьок нікчема тварюка бидло щур свиня боягуз дурень ідіот кретин сміття паскуда "
 "aptal gerizekalı gerizekali salak şerefsiz serefsiz orospu piç ezik pislik pisliksin aptalsın salaksın korkak parazit sıçan "
 ),
 "slight": (
 "worthless pathetic useless stupid ugly disgusting spineless brainless filthy rotten dumb lousy miserable vile repulsive revolting despicable talentless idiotic moronic dirty fat clueless hopeless hideous deranged braindead shameless nasty creepy ignorant illiterate disgrace gross "
 "dreckiger dreckige dreckigste widerlicher widerliche widerlichste nutzloser nutzlose nutzloseste dümmste dumme dummer erbärmlicher erbärmliche erbärmlichste hässliche hässlicher hässlichste "
 "miserable repugnante asqueroso asquerosa patético patética ridículo maldito maldita despreciable "
 "pourri pourrie pathétique débile stupide inutile dégoûtant répugnant puant "
 "lurido lurida sporco inutile patetico ridicolo disgustoso miserabile stupido "
 "miserável nojento inútil patético ridículo imundo podre burro estúpido "
 "walgelijke waardeloze domme smerige zielige lelijke obrzydliwy żałosny głupi głupia bezużyteczny brudny "
 "тупой тупая тупые жалкий мерзкий никчёмный никчемный вонючий убогий грязный тупий жалюгідний огидний бридкий нікчемний "
 "iğrenç zavallı değersiz pis çirkin rezil "
 ),
 "you": (
 "you your yours yourself youre du dich dir dein deine deiner euch tu te ti eres tú usted vous toi ton ta es sei tuo tua você voce vc jij je jou jouw ty cię twoja twój jesteś ты тебя тебе твой твоя тебя ти тебе твій sen seni sana senin siz "
 ),
 "group": (
 "immigrants immigrant foreigners foreigner refugees refugee migrants women woman jews muslims blacks gays lesbians trans gypsies blondes disabled cripples elderly catholics christians arabs asians mexicans africans indians turks homosexuals lesbians hindus sikhs atheists roma romani poles queers transsexuals pensioners cripples "
 "ausländer flüchtlinge frauen juden muslime schwule behinderte zigeuner migranten extranjeros inmigrantes refugiados mujeres judíos musulmanes gays gitanos étrangers immigrés réfugiés femmes juifs musulmans gitans "
 "stranieri immigrati rifugiati profughi donne ebrei musulmani zingari estrangeiros imigrantes refugiados mulheres judeus muçulmanos ciganos buitenlanders vluchtelingen vrouwen joden moslims "
 "cudzoziemcy uchodźcy imigranci kobiety żydzi muzułmanie чужаки чужаков иностранцы мигранты беженцы женщины евреи чужинці мігранти біженці жінки євреї yabancılar yabancı mülteciler göçmenler kadınlar yahudiler "
 ),
 "contempt": (
 "vermin animals infection disease plague rats cockroaches thieves parasites subhuman subhumans savages pests leeches scum filth criminals invaders swarm breed breeding infest crawling stink steal "
 "ungeziefer ratten parasiten abschaum pack gesindel ratas parásitos alimañas plaga escoria basura ladrones animales rats vermine parasites nuisibles racaille voleurs cafards ratti parassiti vermi ladri bestie feccia "
 "ratos parasitas vermes ladrões pragas bichos animais lixo ratten ongedierte parasieten tuig uitschot szczury pasożyty robactwo złodzieje крысы паразиты твари воры скот нелюди щури паразити злодії нелюди fareler sıçanlar parazitler hırsız hırsızlar haşere "
 ),
 "sexual": (
 "nudes nude naked boobs tits titties pussy dick cock cum horny blowjob handjob anal porn porno xxx hardcore uncensored slutty milf onlyfans orgasm masturbate masturbating sexy sext sexting fetish threesome fuck fucking topless undress "
 "nacktbilder nacktfotos nackt geil geiles geile titten ficken muschi schwanz desnuda desnudas desnudo nudes tetas follar coño polla ropa nue nues nichons baiser chatte salope spogliata nuda nudo tette scopare culo pelada pelado nua peitos foder buceta "
 "naakt naaktfoto's tieten neuken nagie cycki ruchać голая голые голой голую сиськи трахать секс гола голі голу цицьки çıplak memelerini seks sikiş "
 ),
 "other": (
 "will find beat smash teeth put hospital watch back walk home tonight delete account before come over hope someone breaks break legs jump bridge deserve slapped slap kill die dead hurt burn hang shoot stab rape punch crush find choke "
 "shut mouth up get lost go cry mother crawl into hole nobody wants here asked hates hate like people should locked cellar forgotten miss gone favour favor ashamed kids parent begging attention imagine being dog must even everyone face breathe world too spit every last "
 "driven out keep them smaller brains do not vote round rid hire nature real families neighbours flies refuse share bus stink steal cure town was fine crawling want send me show asking bend around everything sit thinking body kitchen table wearing under skirt guess "
 "would having that the them there down away under first anyone tonight schools school shelters homes houses sleep problem solved throw kick drive bomb torch strip lick grope fondle undress spank rough casual strings no "
        "selling clips subscribers subscribe take off pics wild night bed look amazing more piece waste oxygen detected opinion rejected only could write such this what old hill south bank those people from with dm explicit thing turn talking know where live kids "
 ),
}

# Digits and signs that stand for letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "2": "z", "6": "g", "$": "s", "@": "a", "!": "i", "+": "t", "|": "il"}

# Words for people of a group by a slur, which need no other term beside them.
SLURS = "faggot faggots nigger niggers kike kikes chink chinks spic spics tranny trannies gook gooks wetback wetbacks paki pakis raghead ragheads untermensch untermenschen kanake kanaken sudaca sudacas bougnoule bougnoules youpin terrone terroni хач хачи чурка чурки жид жиды ciapaty ciapaci"

_SLURS = frozenset(SLURS.split())

VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def frequent_words(paths: tuple[str, ...] = VOCABULARIES) -> frozenset[str]:
    """Words that are whole tokens of public vocabularies: frequent words, never read as a misspelling."""
    out = set()
    for path in paths:
        with open(path, "rb") as f:
            for line in f:
                token = base64.b64decode(line.split()[0])
                if token[:1] == b" " and len(token) > 3:
                    word = token[1:].decode("utf-8", "ignore").casefold()
                    if word.isalpha():
                        out.add(word)
    return frozenset(out)


class Trie:
    """A trie of terms, and the walk of a Levenshtein automaton over it."""

    __slots__ = ("next", "term")

    def __init__(self):
        self.next: dict[str, Trie] = {}
        self.term: str | None = None

    def add(self, word: str) -> None:
        node = self
        for c in word:
            node = node.next.setdefault(c, Trie())
        node.term = word

    def within(self, word: str, most: int, first: str | None = None) -> list[tuple[int, str]]:
        """(distance, term) of all terms within ``most`` edits; digits, masks and repeats are free.

        With ``first`` only terms that begin with this letter."""
        n = len(word)
        out: list[tuple[int, str]] = []
        far = most + 1
        # a repeated letter may be left out at no cost
        free = [i > 0 and word[i] == word[i - 1] for i in range(n)]
        start = [0] * (n + 1)
        for j in range(1, n + 1):
            start[j] = start[j - 1] + (0 if free[j - 1] else 1)
        reads = [(c, LEET.get(c, ""), c == "*") for c in word]

        def walk(node: Trie, row: list[int], before: str) -> None:
            if node.term is not None and row[n] <= most:
                out.append((row[n], node.term))
            for c, child in node.next.items():
                new = [row[0] + 1]
                small = new[0]
                for j in range(1, n + 1):
                    w, leet, any_ = reads[j - 1]
                    same = w == c or any_ or c in leet
                    v = row[j - 1] + (0 if same else 1)
                    skip = new[j - 1] + (0 if free[j - 1] or (w == before and w == c) else 1)
                    if skip < v:
                        v = skip
                    # a doubled letter of the term may be written once
                    gap = row[j] + (0 if c == before and any_ is False and w == c else 1)
                    if gap < v:
                        v = gap
                    new.append(v)
                    if v < small:
                        small = v
                if small < far:
                    walk(child, new, c)

        if first is None:
            walk(self, start, "")
        elif first in self.next:
            only = Trie()
            only.next = {first: self.next[first]}
            walk(only, start, "")
        return out


def _mask(word: str) -> int:
    m = 0
    for c in word:
        m |= 1 << (ord(c) % 61)
    return m


def _free_reading(trie: Trie, word: str) -> list[tuple[int, str]]:
    """``trie.within(word, 0)`` as a walk of the automaton's states: only disguises, which cost nothing."""
    n = len(word)
    free = [i > 0 and word[i] == word[i - 1] for i in range(n)] + [False]
    reads = [None if c == "*" else frozenset(c + LEET.get(c, "")) for c in word]
    out: list[tuple[int, str]] = []

    def close(states: set[int]) -> set[int]:
        for j in list(states):
            while free[j]:
                j += 1
                states.add(j)
        return states

    todo = [(trie, close({0}), "")]
    while todo:
        node, states, before = todo.pop()
        if node.term is not None and n in states:
            out.append((0, node.term))
        for c, child in node.next.items():
            new = {j + 1 for j in states if j < n and (reads[j] is None or c in reads[j])}
            if c == before:
                new |= {j for j in states if j and reads[j - 1] is not None and c in reads[j - 1]}
            if new:
                todo.append((child, close(new), c))
    return out


@lru_cache(maxsize=1)
def misspellable() -> tuple[Trie, dict[int, list[int]]]:
    """The terms of the windows' classes that may be read from a misspelling, and their letters by length."""
    trie, letters = Trie(), {}
    for w, c in lexicon()[1].items():
        if len(w) >= 5 and c & CORE:
            trie.add(w)
            for n in (len(w) - 1, len(w), len(w) + 1):
                letters.setdefault(n, []).append(_mask(w))
    return trie, letters


@lru_cache(maxsize=1)
def lexicon() -> tuple[Trie, dict[str, set[str]]]:
    classes: dict[str, set[str]] = {}
    trie = Trie()
    for name, words in TERMS.items():
        for w in words.split():
            classes.setdefault(w, set()).add(name)
    # words that windows name one by one can be disguised too
    for _, _, p in WINDOWS:
        for w in re.findall(r"[^\W\d_]{4,}", re.sub(r"\\.", " ", p)):
            classes.setdefault(w, {"other"})
    for w in classes:
        trie.add(w)
    return trie, classes


_PLAIN_WORD = re.compile(r"^[^\W\d_]+(?:['’-][^\W\d_]+)*$")
_LETTERS = re.compile(r"[^\W\d_]")


def terms_of(word: str) -> tuple[str, ...]:
    """The lexicon terms that a word may stand for, the likeliest first; else the word itself."""
    trie, classes = lexicon()
    if word in classes:
        return (word,)
    letters = len(_LETTERS.findall(word))
    masks = word.count("*")
    if not letters and not any(c in LEET for c in word) or word.isdigit() and len(word) < 4:
        return (word,)
    squeezed = re.sub(r"(.)\1+", r"\1", word)
    disguised = masks > 0 or (any(c in LEET for c in word) and letters > 0) or len(squeezed) < len(word) - 1 or (word.isdigit() and len(word) >= 4) or any(c in "$@|+" for c in word)
    if disguised:
        if masks and masks >= len(word):
            return (word,)
        got = _free_reading(trie, word)
        if letters < 2:
            # one letter and masks are too little to accuse anybody of a slur
            got = [x for x in got if x[1] not in _SLURS]
        if not got and squeezed != word:
            got = _free_reading(trie, squeezed)
        if not got and len(squeezed) >= 6:
            got = [x for c in sorted(set(squeezed[0] + LEET.get(squeezed[0], ""))) for x in trie.within(squeezed, 1, first=c)]
        if got:
            ranked = sorted(got, key=lambda x: (x[0], abs(len(x[1]) - len(word)), not (classes[x[1]] & CORE), x[1]))
            return tuple(t for d, t in ranked if (d, abs(len(t) - len(word))) == (ranked[0][0], abs(len(ranked[0][1]) - len(word))))
        return (word,)
    if len(word) >= 4 and _PLAIN_WORD.match(word) and word not in frequent_words():
        # a swap of two neighbouring letters is one edit
        for i in range(len(word) - 1):
            t = word[:i] + word[i + 1] + word[i] + word[i + 2 :]
            if classes.get(t, frozenset()) & CORE:
                return (t,)
        if len(squeezed) >= 4 and classes.get(squeezed, frozenset()) & CORE:
            return (squeezed,)
        if len(word) >= 5:
            near, letters = misspellable()
            mine = _mask(word)
            # one edit changes at most two letters: most words need no walk
            if not any((mine ^ m).bit_count() <= 2 for m in letters.get(len(word), ())):
                return (word,)
            # short words have many neighbours: their first letter is kept
            got = near.within(word, 1, first=word[0] if len(word) < 7 else None)
            # a plural, an inflection or another ending is not a misspelling
            got = [(d, t) for d, t in got if len(t) >= 5 and not (word.startswith(t) or t.startswith(word)) and word[:-1] != t[:-1]]
            if got:
                return (min(got, key=lambda x: (x[0], x[1]))[1],)
    return (word,)


def unheard(word: str) -> bool:
    """Whether a word is neither a term nor a frequent word: it may name a group nobody listed. Disguised words count too."""
    if len(word) < 5 or word in lexicon()[1] or word in frequent_words():
        return False
    return _PLAIN_WORD.match(word) is not None or len(_LETTERS.findall(word)) >= 2 and all(c.isalnum() or c in "*$@!|+" for c in word)


_UNIT = r"(?:\*{0,3}[^\W_]\*{0,3}|\*{1,3})"
_SPELLED = re.compile(rf"(?<![\w*]){_UNIT}([ .\-_]{{1,5}}){_UNIT}(?:\1{_UNIT})+(?![\w*])(?![.\-_]+[\w*](?:[.\-_]|\W|$))")
_TOKENS = re.compile(r"[\w*$@|'’]+(?:[!+](?=\w)[\w*$@|]+)*|[.!?。！？;:,]")
_URL = re.compile(r"https?://\S+|(?<!\w)@[\w.]+")
_END = {".", "!", "?", "。", "！", "？"}


def _join(letters: str) -> str:
    """Letters that were spelled out, as one word, or as the words of the lexicon they run together from; misspelled ones cost more."""
    _, classes = lexicon()
    if letters in classes:
        return letters
    best: list[tuple[float, list[str]] | None] = [(0.0, [])] + [None] * len(letters)
    for e in range(1, len(letters) + 1):
        for b in range(max(0, e - 14), e):
            if best[b] is None:
                continue
            part = letters[b:e]
            got = part if part in ("i", "a") else terms_of(part)[0] if e - b >= 3 else None
            if got and (got in classes or got in ("i", "a")):
                cost = best[b][0] + (2.5 if part.isalpha() and got != part else 1.0)
                if best[e] is None or cost < best[e][0]:
                    best[e] = (cost, [*best[b][1], got])
    return " ".join(best[-1][1]) if best[-1] else letters


def _sentences(text: str, known: dict[str, tuple[str, ...]]) -> list[list[tuple[str, ...]]]:
    low = _URL.sub(" ", text.casefold().replace("’", "'"))
    out: list[list[tuple[str, ...]]] = [[]]
    for w in _TOKENS.findall(low):
        if w in _END:
            if out[-1]:
                out.append([])
            continue
        w = w.strip("'")
        if not w:
            continue
        t = known.get(w)
        if t is None:
            if len(known) >= KEPT:
                known.clear()
            t = known[w] = terms_of(w)
        out[-1].append(t)
    return [s for s in out if s]


def _any(name: str) -> str:
    return "(?:" + "|".join(sorted((re.escape(w) for w in set(TERMS[name].split())), key=len, reverse=True)) + ")"


_INS, _ADJ, _YOU, _GRP, _LOW, _SEX = (_any(x) for x in ("insult", "slight", "you", "group", "contempt", "sexual"))
_PEOPLE = r"(?:old|young|disabled|black|brown|white|gay|trans|poor|deaf|blind|hill|mountain|island|river|valley|city|village|country|north|south|east|west|northern|southern|eastern|western)"
_GROUP = rf"(?:{_GRP}|(?:those |the |these )?{_PEOPLE} people|people from (?:the )?[\w ]{{3,20}}|those people|these people)"
_HARM = "(?:kill|murder|strangle|choke|stab|shoot|slit|gut|skin|drown|burn|hang|beat|smash|crush|punch|slap|kick|hurt|rape|bury|destroy|slaughter|lynch|hunt|behead|poison|bash|cut)"
_HARMED = "(?:shot|hanged|hung|killed|beaten|slapped|raped|deported|gassed|banned|removed|eliminated|exterminated|burned|burnt|drowned|stabbed|whipped|sterilised|sterilized|castrated|lynched|expelled|jailed|locked|kicked out|thrown out|driven out|wiped out|put down|sent back|put in camps)"
_WILL = "(?:'ll| will| am going to|'m going to|'m gonna| gonna| am gonna|'d love to| want to| would love to)"
_PART = "(?:cock|dick|pussy|tits|titties|boobs|ass|arse|balls|nipples|clit)"

# Windows that also hold for a word nobody knows in the place of a group.
ROUND_UP = rf"\b(?:round up|death to|hate all|kill all|burn all|deport all) (?:the |all |those |these )?{_GROUP}\b"
BURN_DOWN = rf"\b(?:burn|bomb|torch|blow up|gas)(?: [^ ]+){{0,3}} (?:shelters?|homes?|houses?|camps?|church(?:es)?|mosques?|schools?)(?: [^ ]+){{0,3}} {_GROUP}\b"
BRAINS = rf"\b{_GROUP} (?:all |just )?have (?:much )?(?:smaller|tiny|no|inferior) (?:brains?|minds?|souls?)\b"
NAMELESS = frozenset({ROUND_UP, BURN_DOWN, BRAINS})
# Windows of terms, as (score, kind, pattern on the terms of a sentence).
WINDOWS = [
    (0.9, "abusive", rf"\b(?:you|u|ur|your|you're|youre) (?:[^ ,]+ ){{0,4}}?(?:{_ADJ}|{_INS}|waste of oxygen|piece of)\b"),
    (0.9, "abusive", rf"\b{_INS} like you\b"),
    (0.8, "abusive", rf"\b(?:what an?|look at this|such a|imagine being this|only a)(?: {_ADJ})* (?:{_INS}|{_ADJ}|piece of|waste of)\b.*\b(?:you|your|choke|nobody wants|parent)\b"),
    (0.8, "abusive", rf"\b(?:shut (?:your|the) (?:\w+ )?mouth|shut up|get lost|crawl back|go jump|choke on it|piss off|drop dead|go to hell|go die|go cry|fuck off|fuck you|kill yourself|kys|screw you)\b(?:.*\b(?:{_INS}|{_ADJ}|you|your|waste|piece)\b)?"),
    (0.7, "abusive", rf"\b(?:you|your|yourself)\b.*(?<![^ ])(?:{_INS}|waste of oxygen|piece of \w+)$"),
    (0.8, "abusive", rf"\b{_INS} detected\b"),
    (0.85, "abusive", rf"\b(?:seu|sua|du|tu|ты|ти|you|pedazo de|espèce d[e']|sale|pezzo di|brutto|brutta|jij|ty|seni)(?: {_ADJ})? (?:{_INS})\b|\b(?:ninguém|nadie|personne ne|nessuno|keiner|niemand|никто) (?:gosta de você|te quiere|t'aime|ti vuole|mag dich|тебя не)\b"),
    (0.9, "abusive", r"\b(?:everyone|everybody|we all|people) hates? you\b|\bnobody (?:would miss|wants|likes|loves) you\b|\bdo us all a favou?r\b|\bwaste of oxygen\b|\bpeople like you should\b"),
    (0.95, "abusive", r"\bi(?:'ll| will| am going to|'m going to) (?:find|hunt|beat|kill|hurt|smash|break|stab|shoot|rape|crush|slap|punch|burn|get|end|destroy) (?:you|your)\b(?! (?:a|an|the|some|another|something|one)\b)|\bsmash your (?:teeth|face|head)\b|\bput you in (?:a )?(?:hospital|grave|ground|coffin)\b|\bwatch your back\b"),
    (0.95, "abusive", r"\b(?:delete|kill|end|erase) you\b|\bi hope (?:someone|somebody|you|they) (?:breaks?|die|dies|kills?|hurts?|burns?|rots?|gets? )\b|\b(?:you|they) (?:all )?deserve to (?:be (?:slapped|beaten|hurt|shot|killed|locked|hanged|raped)|die|suffer|rot|burn)\b|\bjump off a (?:bridge|cliff|roof|building)\b|\bi know where you live\b|\bbreaks? your (?:legs|neck|arms|bones|face|jaw)\b|\block(?:ed)? in a cellar\b"),
    (0.95, "abusive", rf"\bi{_WILL} (?:[^ ]+ )?{_HARM} (?:you|u|your|ur)\b|\b(?:we|they|somebody|someone)(?:'ll| will|'re going to| are going to) (?:[^ ]+ )?{_HARM} (?:you|your)\b"),
    (0.9, "abusive", rf"\b(?:you|u) (?:all |really |both )?(?:should|must|ought to|deserve to|need to) (?:all |just |really )?(?:be|get) (?:[^ ]+ )?(?!banned|removed|locked|sent|put|expelled){_HARMED}\b|\b(?:you|u) should (?:just |go )*{_HARM} yourself\b|\b(?:somebody|someone) (?:needs to|should|has to|must|ought to) (?:[^ ]+ )?{_HARM} you\b|\bgo back (?:home )?to (?:your (?:own )?(?:country|land|continent|hole|cave|swamp|village)|where you (?:came|come) from)\b"),
    (0.8, "abusive", r"^(?:fucking |stupid |dirty )*(?:whore|slut|bitch|cunt|asshole|arsehole|motherfucker|wanker|moron|idiot|imbecile|retard|dickhead|bastard|scumbag|loser|arschloch|wichser|hurensohn|schlampe|puta|cabrón|gilipollas|pendejo|connard|connasse|salope|enculé|stronzo|puttana|coglione|klootzak|hoer|kurwa|skurwysyn|сука|мразь|урод|дебил|orospu|şerefsiz)$"),
    # groups
    (0.9, "hateful", rf"\b{_GROUP} (?:are|is|aren't|isn't) (?:not |never |hardly |barely )?(?:even |really )?(?:human|humans|people|welcome here)\b|\b{_GROUP} (?:should|must|ought to|deserve to|need to) (?:all |just |not |never )*(?:(?:be|get) (?:[^ ]+ )?(?:{_HARMED}|allowed)|exist|breathe|breed|rot|die|go back)\b"),
    (0.9, "hateful", rf"\b(?:deport|exterminate|kill|shoot|gas|burn|hang|expel|sterilise|drown|lynch|ban) (?:all |the |all the |every |these |those ){{1,2}}{_GROUP}\b|\b{_GROUP} (?:raus|fuera|dehors|fora|eruit|вон|геть)\b"),
    (0.85, "hateful", rf"\b(?:{'|'.join(SLURS.split())})\b"),
    (0.9, "hateful", rf"\b{_GROUP} (?:are|is|have been|were) (?:all |just |nothing but |only |an? |the )*(?:\w+ )?(?:{_LOW}|{_INS}|{_ADJ})\b"),
    (0.9, "hateful", rf"\b{_GROUP}\b.*\b(?:driven out|(?:throw|kick|drive|get) them (?:all )?out|get rid of (?:them|it)|rid of them|keep them out|breed like|like rats|stink and steal|do not deserve|don't deserve|thieves by nature|kick(?:ed)? (?:them )?out|should be (?:shot|hanged|deported|gassed|removed|eliminated|banned|locked)|are the (?:problem|disease)|we are the cure|too (?:{_ADJ})|every last one of them|all (?:{_ADJ}|{_LOW}))"),
    (0.9, "hateful", ROUND_UP),
    (0.9, "hateful", BRAINS),
    (0.9, "hateful", rf"\b(?:i spit on|never hire|refuse to share (?:a|the) \w+ with|do not want|don't want|send back|get rid of|down with|came crawling|before) (?:the |all |those |these )?{_GROUP}\b(?:.*\b(?:{_LOW}|{_ADJ}|{_INS}|neighbours|rid|out|steal|nature)\b)?"),
    (0.9, "hateful", rf"\b(?:keep|get|throw|kick|drive|burn|bomb|torch|gas|shoot|lock) (?:down |out |up )?(?:[^ ]+ ){{0,4}}?{_GROUP}\b.*\b(?:away|out|they are|sleep|live|solved|schools?|animals)\b"),
    (0.9, "hateful", BURN_DOWN),
    (0.85, "hateful", rf"\b(?:los|las|les|gli|die|diese|diesen|esses|essas|esos|estos|questi|queste|ces|os|deze|die|ci|эти|ці|bu|these|those)(?: [^ ]+){{1,2}} (?:are|sind|son|sont|sono|são|zijn|są|это|-)(?: [^ ]+){{0,3}}? (?:{_LOW})\b.*\b(?:out|raus|weg|gehören|vertrieben|fuera|echarlos|chasse|chasser|dehors|cacciati|cacciarli|via|fora|todos|alle|tous|tutti|eruit|гнать|геть)\b"),
    # sexual
    (0.9, "sexual", r"\b(?:strip|lick|grope|fondle|undress|spank|taste|ravish|mount|ride) (?:you|your)\b|\b(?:rough|hot|wild|anonymous|casual) sex\b|\bup for (?:some )?(?:\w+ )?(?:sex|nudes|sexting)\b|\bno strings\b.*\b(?:pics|sex|tonight)\b"),
    (0.9, "sexual", r"\b(?:send|show|give|dm|text)(?: me| us)?(?: your| some| more)*(?: \w+){0,2} (?:nudes|nude|naked|boobs|tits|pussy|dick|cock|pics of your)\b|\b(?:i want|want|need|wish) you (?:naked|nude)\b|\byour (?:\w+ )?(?:naked|nude) (?:body|skin|self)\b|\byour (?:\w+ )?(?:boobs|tits|titties|pussy|cock|dick|ass)\b"),
    (0.9, "sexual", r"\bsit on my face\b|\bbend over\b.*\b(?:see|show|everything|want)\b|\bturn around and bend over\b|\btake it all off\b|\bexplicit (?:xxx |\w+ )?(?:pics|photos|videos|clips|content)\b|\bxxx (?:pics|photos|videos|clips)\b|\bunder (?:that|your) (?:skirt|dress|shirt|bra)\b|\b(?:dirty|uncensored|naughty) (?:\w+ )?(?:clips|videos|pics|photos)\b|\bhorny\b|\b(?:hardcore|xxx) only\b|\bfuck me\b|\bsuck my\b|\bsexy thing\b|\b(?:blowjob|handjob|threesome|cum)\b"),
    (0.9, "sexual", rf"\b(?:see|suck|lick|touch|taste|ride|stroke|grab|kiss) (?:on )?(?:my|your) (?:[^ ]+ )?{_PART}\b|\b(?:wanna|want to|let me|gonna|going to) (?:[^ ]+ )?(?:fuck|bang|spank|undress) (?:you|u|me)\b|\b(?:wanna|want to) fuck\b"),
    # other languages: an insult with an address or an order, a request for naked pictures, a group with contempt
    (0.9, "abusive", rf"\b(?:du bist|du|eres|tu es|t'es|sei|você é|voce é|vc é|jij bent|je bent|jesteś|ты|ти|sen)(?: [^ ]+){{0,4}} (?:{_INS}|{_ADJ})\b|\b(?:tu es|t'es|vous êtes)(?: (?:vraiment|trop|si|tellement|un|une|pauvre|gros|grosse|sale))* (?:con|conne|cons)\b"),
    (0.85, "abusive", rf"\b(?:{_INS}|{_ADJ})(?: [^ ]+){{0,3}} (?:eres|sei|és|bist du|es-tu)\b"),
    (0.9, "abusive", rf"\b(?:halt die klappe|halt's maul|halt das maul|verpiss dich|geh sterben|stirb|lárgate|vete a la mierda|cállate|callate|ferme ta gueule|ta gueule|dégage|va mourir|casse-toi|stai zitto|stai zitta|vaffanculo|fai schifo|crepa|cala a boca|some daqui|vai se foder|hou je bek|rot op|zamknij się|zamknij sie|spadaj|wypierdalaj|заткнись|закрой рот|сдохни|проваливай|пошел вон|пошёл вон|заткайся|здохни|замовкни|kapa çeneni|defol|siktir|geber|sus lan)\b(?:.*\b(?:{_INS}|{_ADJ}|dich|te|ti|boca|tutti)\b)?"),
    (0.95, "abusive", r"\b(?:dir|dich) (?:schlägt|bricht|haut|macht) (?:jemand|einer)\b|\bich (?:finde|kriege|schlage|bringe) dich\b|\bojalá (?:te|alguien)\b|\bte voy a (?:matar|romper|pegar|encontrar|partir)\b|\bon te (?:cassera|cassera|tuera|brisera|frappera)\b|\bj'espère qu'on te\b|\bje vais te (?:tuer|frapper|trouver|casser)\b|\b(?:spero che )?ti (?:spacchino|spacco|rompo|ammazzo|trovo|rompano|ammazzino)\b|\btomara que (?:alguém |te )|\bte (?:quebre|quebro|mato|encontre|pego|mate|arrebento)\b|\bчтоб (?:тебе|ты|тебя)\b|\b(?:убью|найду|зарежу|сломаю) (?:тебя|тебе)\b|\bтебе (?:ноги|руки|лицо|зубы) (?:пере|с)?лома|\bщоб (?:тобі|ти|тебе)\b|\bseni (?:bulup|bulacağım|öldüreceğim|gebert)|\bik (?:maak|vind|sla) je\b|\bzabiję cię|\bznajdę cię"),
    (0.85, "abusive", rf"\b(?:dich|dir|te|ti|tout le monde te|todos te|você|тебя|тебе|seni|sana|cię|jou|je)\b.*(?<![^ ])(?:{_INS})(?: humano| humain)?$"),
    (0.9, "abusive", r"\b(?:you are|you're|you mean|you are worth|you're worth) (?:absolutely |worth |just )?nothing(?! (?:but|if|like|less|short)\b)\b|\bdu bist (?:gar )?nichts wert\b|\bno (?:vales|sirves para) nada\b|\btu ne (?:vaux|sers à) rien\b|\btu (?:vaux|sers à) rien\b|\bnon (?:vali|servi a) (?:niente|nulla)\b|\b(?:você )?não (?:vales|vale|serves|serve) (?:para )?nada\b|\bje bent niets waard\b|\bjesteś nic niewart\w*|\bты (?:ничего не стоишь|никто и звать)\b|\bти нічого не варт\w*|\bbeş para etmezsin\b|\bhiçbir işe yaramazsın\b"),
    (0.95, "abusive", r"\bi (?:hope|wish) you (?:would |all )?(?:just )?(?:disappear|vanish|were dead|never existed)\b|\bojalá (?:te mueras|te mates|te pudras|desaparezcas|revientes)\b|\bj'espère que tu (?:vas )?(?:crèves?|crever|disparais|disparaisses|meurs|mourir)\b|\bich hoffe,? du (?:stirbst|verschwindest|verreckst|krepierst)\b|\bspero che tu (?:muoia|sparisca|crepi)\b|\b(?:tomara que|espero que) (?:você |tu )?(?:morras?|sumas?|desapareças?)\b|\bik hoop dat je (?:doodgaat|sterft|verdwijnt)\b|\boby(?:ś|s) (?:zdech\w*|zniknął|zniknęła)\b|\bчтоб ты (?:сдох\w*|исчез\w*|провалил\w*)|\bщоб ти (?:здох\w*|зник\w*|провалив\w*)|\bumarım (?:ölürsün|geberirsin|yok olursun)\b"),
    (0.9, "sexual", r"\b(?:schick|schicke|send|mándame|mandame|envíame|enviame|pásame|envoie|montre|mandami|inviami|manda|me manda|envia|stuur|wyślij|пришли|скинь|надішли|gönder)\b.*\b(?:photos?|fotos?|foto's|bilder|bild|imágenes|immagini|imagens|pics|zdjęcia|zdjęcie|фото|фотки|resim\w*|fotoğraf\w*)\b.*\b(?:sans rien(?! [^ ]+(?:er|ir|re)\b)|sans vêtements|sin nada(?! (?:de|que|más)\b)|sin ropa|senza niente(?! (?:di|da|in)\b)|senza vestiti|sem nada(?! (?:de|que|mais)\b)|sem roupas?|ohne alles|ohne klamotten|ohne kleidung|zonder kleren|zonder iets|bez niczego|bez ubrania|bez ubrań|без одежды|без всего|без одягу|без нічого|kıyafetsiz)\b"),
    (0.9, "sexual", r"\b(?:schick|schicke|zeig|mándame|mandame|envíame|enviame|pásame|envoie|envoie-moi|montre|montre-moi|mandami|inviami|fammi vedere|manda|me manda|mande|envia|stuur|laat|wyślij|pokaż|пришли|скинь|покажи|надішли|скинь|gönder|göster)\b.*\b(?:nacktbilder|nacktfotos|nackt|sin ropa|desnuda|desnudo|desnudas|nue|nues|nu|nude|nudes|spogliata|nuda|nudo|sem roupa|pelada|pelado|nua|naakt\w*|nagie|nago|голые|голая|голую|голой|голі|голу|гола|çıplak)\b|\bdu geiles stück\b"),
    (0.9, "hateful", rf"\b{_GRP}(?: [^ ]+){{0,2}}? (?:sind|son|sont|sono|são|zijn|są|это|-|є|hepsi|ist|es una?|são uns|sono dei|sont des)(?: [^ ]+){{0,3}}? (?:{_LOW}|{_INS}|{_ADJ})\b"),
    (0.9, "hateful", rf"\b{_GRP}\b.*\b(?:raus|vertreiben|fuera|echarlos|expulsar|qu'on les chasse|dehors|les chasser|vanno cacciati|cacciarli|via tutti|fora|expulsos|expulsar|eruit|wyrzucić|won|гнать|вон|гнати|геть|kovulmalı|defolsun|atılmalı)\b|\b(?:гнать|гнати|raus mit|fuera|dehors|fora|weg met|precz z)\b.*\b{_GRP}\b|\bпонаехали\b.*\b(?:крысы|гнать|твари|чужак\w*)\b"),
    (0.85, "hateful", rf"\b(?:{_LOW}|{_INS})\b.*\b(?:гнать|гнати)\b"),
]

# Phrases of languages written without spaces.
UNSPACED = [
    (0.95, "sexual", re.compile(r"(?:裸|ヌード|下着|おっぱい|エロ)[^。]{0,10}(?:写真|画像|動画)?[^。]{0,6}(?:送れ|送って|見せろ|見せて|くれ)|알몸|나체|야한 사진|벗은 사진|벗어")),
    (0.9, "hateful", re.compile(r"(?:外国人|移民|難民|女|老人|障害者|よそ者)[^。]{0,12}(?:ゴミ|クズ|役立たず|害虫|寄生虫|ネズミ|追い出せ|出て行け|消えろ|死ね)|(?:외국인|이민자|난민|여자|노인|장애인)[^.]{0,14}(?:쓰레기|벌레|해충|쥐|기생충|쫓아|몰아|꺼져|내쫓)")),
    (0.9, "abusive", re.compile(r"(?:お前|おまえ|てめえ|貴様|あんた)[^。]{0,12}(?:ゴミ|クズ|役立たず|バカ|馬鹿|アホ|消えろ|死ね|キモ|気持ち悪|うざ)|(?:クズ|ゴミ|バカ|馬鹿|アホ|役立たず|カス)(?:野郎|ども)?は(?:黙って?(?:いろ|ろ)|黙れ|消えろ|出て行け)|誰も(?:お前|おまえ|てめえ|あんた|君)(?:なんか|のことなんか|のこと)?[^。]{0,4}(?:好きじゃない|嫌い|必要としていない|愛していない)|黙れ|死ね|殺す|殺して?やる|消えろ[、よ]|くたばれ|(?:너|네|니|당신)[^.]{0,14}(?:쓰레기|병신|멍청|바보|찌질|역겨|꺼져|죽어|한심|버러지|기생충|새끼)|아무도 (?:너|널|너를|너 같은|네)[^.]{0,8}(?:안 ?좋아|좋아하지 않|원하지 않|싫어)|죽여 ?버|죽어 ?버|뒤져|닥쳐|꺼져|가만 ?안 ?둬")),
]

# Signs that a term is quoted, reported or rejected.
QUOTED = re.compile(
    r"\b(?:called|calling|calls|call (?:me|him|her|them|people|strangers|each)|said|says|saying|wrote|writes|trolls? writes?|trolls?|hisses|hissed|shouts|shouted|screams|yells|yelled|whispers|moderators?|removed a post|reported|report|quote[sd]?|quoting|paper on|study (?:on|about)|talk on|talk about|lecture|workshop|hate speech|slurs?|the word|stop using|stop calling|"
    r"villain|curtain|play|character|movie|film|novel|lyrics?|in the game|boss in|respawned|as the lawyers put it|lawyers|exhibition|education|screening|health|consent|museum of|stage name|reclaimed|documentary|chapter about|"
    r"nennt|nannte|nennen|sagte|schrieb|vortrag|ausstellung|hör(?:t)? auf|llamar|llamó|llamaron|dijo|escribió|charla|basta (?:ya )?de|traiter|traité|appelé|a dit|arrêtez|exposition|conférence|chiamare|chiamato|ha detto|smettetela|basta con|mostra|conferenza|chamar|chamou|disse|parem de|palestra|exposição|"
    r"noemde|noemen|zei|lezing|stop met|nazwał|nazywać|powiedział|wykład|przestańcie|назвал|называть|сказал|написал|лекция|выставка|хватит называть|перестаньте|назвав|називати|сказав|лекція|виставка|досить|dedi|demeyin|demek|konferans|sergi|söyleşi)\b"
)
# Signs that the writer or a thing is meant.
OWN = re.compile(
    r"\b(?:i am|i'm|im|i felt|i feel|i was|i feel like|makes me|made me feel|am i|my own|i can be|call me|my (?:code|car|phone|computer|laptop|vacuum|printer|keyboard|cooking|spelling|handwriting|day|mood|cat|dog|hair|room|desk)|the (?:dog|cat|code|weather|printer|film|bread)|ich (?:bin|war|fühle|idiot|trottel|depp|esel)|mich|mein|meine|staubsauger|soy|me siento|yo|mi|je suis|je me|moi|mon|ma|sono|mi sento|io|mio|mia|sou|me sinto|eu|meu|minha|ik ben|ik|mijn|jestem|czuję|mój|moja|я|мой|моя|меня|мій|ben|kendimi|benim)\b"
)
HARMLESS = re.compile(r"\b(?:the best|best \w+ ever|pest control|mole rat|breast cancer|chicken breast|cocktails?|cockpit|essex|so good|love (?:him|her|it|them|the)|we need more|welcome|beat the eggs|kill the lights|killed it|naked eye|art class|life drawing|statues?|sculptures?|paintings?|museum|gallery|counted separately|not disgusting|good riddance to it|ducklings)\b")


_ANY = "\0"  # in a reading of a pattern: characters that are not known
_EDGE = "\n"  # ... a place where a word surely ends or begins
_RUN = re.compile(r"\w+")
_MOST = 100_000  # readings of a piece of a pattern; a piece with more is not used, which makes a gate wider only


def _spelled(items) -> set[str]:
    """All readings of a parsed pattern, with ``_ANY`` for what is not fixed and ``_EDGE`` for edges of words."""
    out = {""}
    for op, arg in items:
        if op is _c.LITERAL:
            got = {chr(arg)}
        elif op is _c.AT:
            got = {_EDGE}
        elif op is _c.ASSERT_NOT and arg[0] < 0 and list(arg[1]) == [(_c.NOT_LITERAL, 32)]:
            got = {_EDGE}
        elif op in (_c.ASSERT, _c.ASSERT_NOT):
            got = {""}
        elif op is _c.IN and all(o is _c.LITERAL for o, _ in arg):
            got = {chr(c) for _, c in arg}
        elif op is _c.BRANCH:
            got = set().union(*(_spelled(x) for x in arg[1]))
        elif op is _c.SUBPATTERN:
            got = _spelled(arg[3])
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, inner = arg
            once = _spelled(inner)
            got = ({""} if low == 0 else set()) | (once if low < 2 else set()) | ({x + _ANY + y for x in once for y in once} if high > 1 else set())
        else:
            got = {_ANY}
        out = {x + y for x in out for y in got} if len(out) * len(got) <= _MOST else {_ANY}
    return out


def _required(items, before: str = _ANY, after: str = _ANY) -> list[frozenset[str]]:
    """Groups of words: whatever the pattern matches in holds a word of each group."""
    pieces: list[list] = [[]]
    for item in items:
        # words end at a written space or edge, so the pieces between them are looked at alone
        if item == (_c.LITERAL, 32) or item[0] in (_c.AT, _c.ASSERT_NOT) and _spelled([item]) == {_EDGE}:
            pieces.append([])
        else:
            pieces[-1].append(item)
    groups = []
    for k, piece in enumerate(pieces):
        group = set()
        for reading in _spelled(piece):
            reading = (_EDGE if k else before) + reading + (_EDGE if k < len(pieces) - 1 else after)
            sure = [m.group() for m in _RUN.finditer(reading) if reading[m.start() - 1] != _ANY and reading[m.end()] != _ANY]
            if not sure:
                break
            group.add(max(sure, key=len))
        else:
            groups.append(frozenset(group))
    return groups


def _gates(pattern: str) -> list[list[frozenset[str]]]:
    """For every alternative of a pattern its groups of required words; no groups where nothing is required."""
    items = list(_parser.parse(pattern))
    at = [k for k, (op, _) in enumerate(items) if op is _c.BRANCH]
    if len(at) == 1 and all(op is _c.AT for k, (op, _) in enumerate(items) if k != at[0]):
        return [_required([*items[: at[0]], *alternative, *items[at[0] + 1 :]]) for alternative in items[at[0]][1][1]]
    return [_required(items)]


@lru_cache(maxsize=1)
def _compiled() -> tuple[list[tuple[float, str, re.Pattern, list[int]]], dict[str, int]]:
    """The windows, each with the groups (as bits) that its alternatives need, and the groups of every word."""
    bits: dict[frozenset[str], int] = {}
    of: dict[str, int] = {}
    windows = []
    for score, kind, p in WINDOWS:
        needs = []
        for groups in _gates(p):
            need = 0
            for g in groups:
                if g not in bits:
                    bits[g] = 1 << len(bits)
                    for w in g:
                        of[w] = of.get(w, 0) | bits[g]
                need |= bits[g]
            needs.append(need)
        windows.append((score, kind, re.compile(p), needs))
    return windows, of


@lru_cache(maxsize=100_000)
def _open(present: int) -> tuple[tuple[float, str, re.Pattern], ...]:
    """The windows that can match a sentence whose words are of the groups ``present``."""
    return tuple((score, kind, p) for score, kind, p, needs in _compiled()[0] if any(n & present == n for n in needs))


def _present(terms: list[str]) -> int:
    """The groups, as bits, of the words of a sentence: runs of word characters, as word edges of a pattern see them."""
    get = _compiled()[1].get
    out = 0
    for t in terms:
        if t.isalnum():
            out |= get(t, 0)
        else:
            for w in _RUN.findall(t):
                out |= get(w, 0)
    return out


_HAS_CJK = re.compile(r"[぀-ヿ一-鿿가-힣]")


# What is believed before any label is seen, as log odds: of a window by its kind, and of the signs around it.
SIGNS = ("abusive", "hateful", "sexual", "strong", "quoted", "quoted_after", "own", "harmless", "several", "negated")
PRIOR = (2.0, 2.0, 2.0, 0.6, -3.4, -0.6, -3.2, -3.6, 0.2, -3.4)


def _sign_vector(s: str, score: float, kind: str, m: re.Match, hits: int) -> tuple[float, ...]:
    """The signs of a window found in a sentence of terms: its kind, and what stands around it."""
    q = QUOTED.search(s)
    told = q is not None and (q.start() < m.start() or kind != "abusive" or not _ADDRESS.search(m.group()))
    o = OWN.search(s) if kind == "abusive" else None
    own = o is not None and o.start() <= m.start() + 3 and not _ADDRESSED.search(s[o.start() :])
    return (
        kind == "abusive", kind == "hateful", kind == "sexual", score >= 0.9, told, q is not None and not told, own, HARMLESS.search(s) is not None, hits > 1, kind == "abusive" and _NEGATED.search(m.group()) is not None,
    )


_NEGATED = re.compile(r"\b(?:you|u|your|you're|youre|du|eres|tu|sei|você|jij|ты|ти) (?:[^ ]+ )?(?:not|never|aren't|nicht|kein|keine|no|pas|non|não|niet|geen|nie|не)\b|\b(?:aren't|are not|bist kein|no eres|n'es pas|non sei|não é) ")
_ADDRESS = re.compile(r"\b(?:you|your)\b")
_ADDRESSED = re.compile(r"\b(?:you|your|du|dich|dir|tu|te|ti|eres|sei|você|ты|тебе|тебя)\b")


def _odds(signs: tuple[float, ...], weights: tuple[float, ...]) -> float:
    return 1 / (1 + math.exp(-sum(w for w, x in zip(weights, signs, strict=True) if x)))


def fit_context(labelled: list[tuple[str, str]], rounds: int = 30, belief: float = 2.0) -> tuple[float, ...]:
    """Weights of ``SIGNS`` from (text, label) pairs: logistic regression towards ``PRIOR``, by Newton's method.

    The example of a text is its likeliest window; texts without a window teach nothing.
    ``belief`` is the weight of the prior in examples. No labels give the prior.
    """
    rows = [(signs, label != "clean") for text, label in labelled if label and text and (signs := _best_signs(text)) is not None]
    w0 = np.array(PRIOR)
    if not rows:
        return PRIOR
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    w = w0.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + belief * np.eye(len(w)), x.T @ (y - p) - belief * (w - w0))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 6) for v in w)


def _best_signs(text: str) -> tuple[float, ...] | None:
    found: list[tuple[float, tuple[float, ...]]] = []
    score_text(text, seen=found)
    return max(found)[1] if found else None


def score_text(
    text: str | None, known: dict[str, tuple[str, ...]] | None = None, sentences: dict[str, tuple[float, str]] | None = None, weights: tuple[float, ...] = PRIOR, seen: list | None = None
) -> tuple[float, str]:
    """(score from 0 to 1, kind) of one text: the likeliest window of any sentence; kind is clean where no window is found.

    ``known`` and ``sentences`` remember words and sentences between calls (of the same ``weights``);
    ``seen`` collects the signs of all windows.
    """
    if not text:
        return 0.0, "clean"
    known = {} if known is None else known
    sentences = {} if sentences is None else sentences
    best, kind = 0.0, "clean"
    read = plain(text)
    if _SPELLED.search(read):
        read = _SPELLED.sub(lambda m: _join(re.sub(r"[ .\-_]", "", m.group().casefold())), read)
    for part in _PARTS.split(read):
        if not part:
            continue
        got = sentences.get(part) if seen is None else None
        if got is None:
            if len(sentences) >= KEPT:
                sentences.clear()
            got = _score_part(part, known, weights, seen)
            if seen is None:
                sentences[part] = got
        if got[0] > best:
            best, kind = got
    if not text.isascii() and _HAS_CJK.search(text):
        t = read if _HAS_HANGUL.search(text) else read.replace(" ", "")
        for score, k, pattern in UNSPACED:
            if score > best and pattern.search(t):
                best, kind = score, k
    return round(best, 3), kind


_PARTS = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\s//\s|\n")
_HAS_HANGUL = re.compile(r"[가-힣]")


def _score_part(part: str, known: dict[str, tuple[str, ...]], weights: tuple[float, ...], seen: list | None) -> tuple[float, str]:
    best, kind = 0.0, "clean"
    for words in _sentences(part, known):
        for terms in _readings(words):
            windows = _open(_present(terms))
            if windows:
                best, kind = _score_sentence(" ".join(t for t in terms if t not in ",;:"), windows, best, kind, weights, seen)
        if best < THRESHOLD:
            # a word nobody knows may name a group: read as one, but only in windows about groups
            first = [w[0] for w in words]
            terms = ["foreigners" if len(w) == 1 and unheard(w[0]) else w[0] for w in words]
            if terms != first:
                lowering = any(lexicon()[1].get(t, _NONE) & _LOWERING for t in first)
                windows = tuple(x for x in _open(_present(terms)) if x[1] == "hateful" and (lowering or x[2].pattern in NAMELESS))
                best, kind = _score_sentence(" ".join(t for t in terms if t not in ",;:"), windows, best, kind, weights, seen)
    return best, kind


_NONE: frozenset[str] = frozenset()
_LOWERING = {"contempt", "insult", "slight"}


def _readings(words: list[tuple[str, ...]]) -> Iterator[list[str]]:
    """The sentence with the likeliest term of each word, and with other terms of its masked words."""
    first = [w[0] for w in words]
    yield first
    open_ = [i for i, w in enumerate(words) if len(w) > 1]
    for i in open_:
        for other in words[i][1:]:
            yield [*first[:i], other, *first[i + 1 :]]
    if len(open_) > 1:
        yield [w[-1] for w in words]


def _score_sentence(s: str, windows: tuple[tuple[float, str, re.Pattern], ...], best: float, kind: str, weights: tuple[float, ...], seen: list | None) -> tuple[float, str]:
    hits = [(score, k, m) for score, k, pattern in windows if (m := pattern.search(s))]
    for score, k, m in hits:
        signs = _sign_vector(s, score, k, m, len(hits))
        odds = _odds(signs, weights)
        if seen is not None:
            seen.append((odds, signs))
        if odds > best:
            best, kind = odds, k
    return best, kind


def score_fields(rows: DataFrame, key: str, fields: list[str], *, carry: list[str] | None = None, threshold: float = THRESHOLD, only_found: bool = False, weights: tuple[float, ...] = PRIOR) -> DataFrame:
    """(key, *carry, field, score, kind, abusive): one row for every non-empty text field of every row.

    Null and empty fields give no row; repeated rows are scored each. With ``only_found``
    just the rows at or above ``threshold``.
    """
    carry = carry or []
    picked = rows.select(key, *carry, *fields)
    types = {f.name: f.dataType.simpleString() for f in picked.schema.fields}
    schema = ", ".join([f"{key} {types[key]}", *(f"`{c}` {types[c]}" for c in carry), "field string, score double, kind string, abusive boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        sentences: dict[str, tuple[float, str]] = {}
        texts_known: dict[str, tuple[float, str]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            for f in fields:
                enc = b.column(f).cast(pa.string()).dictionary_encode()
                got = []
                for t in enc.dictionary.to_pylist():
                    r = texts_known.get(t)
                    if r is None:
                        if len(texts_known) > 50_000:
                            texts_known.clear()
                        r = texts_known[t] = score_text(t, known, sentences, weights)
                    got.append(r)
                scores = pa.array([g[0] for g in got], pa.float64()).take(enc.indices)
                kinds = pa.array([g[1] if t else None for g, t in zip(got, enc.dictionary.to_pylist(), strict=True)], pa.string()).take(enc.indices)
                out = pa.RecordBatch.from_arrays(
                    [b.column(key), *(b.column(c) for c in carry), pa.array([f] * b.num_rows, pa.string()), scores, kinds, pa.compute.greater_equal(scores, threshold)],
                    [key, *carry, "field", "score", "kind", "abusive"],
                )
                keep = pa.compute.fill_null(out.column("abusive"), False) if only_found else pa.compute.is_valid(out.column("kind"))
                yield out.filter(keep)

    return picked.mapInArrow(run, schema)


def rates(rows: DataFrame, key: str, fields: list[str], source: str, *, threshold: float = THRESHOLD, weights: tuple[float, ...] = PRIOR) -> DataFrame:
    """Per source and field: texts, abusive texts by kind, and the rate. A null source is a source of its own."""
    scored = score_fields(rows, key, fields, carry=[source], threshold=threshold, weights=weights)
    hit = lambda k: F.count_if(F.col("abusive") & (F.col("kind") == k)).alias(k)
    return scored.groupBy(source, "field").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("abusive").alias("found"), hit("abusive"), hit("hateful"), hit("sexual"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
