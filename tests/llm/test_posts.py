import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import abuse, languages, personal
from strandweave.sources import table

PERSONAL = {
    "Write me at rosa+news@lumo.test if you want": {"email"}, "mail nadia.immerbruk[at]lumo.test now": {"email"}, "simon.pell at ferry dot example is the address": {"email"}, "kestrovan09 @ example.org": {"email"},
    "my mail is marco_this＠ferry.example": {"email"}, "the handle @brassmoth.sky.example is taken": set(), "meet at noon dot sharp, you know where": set(),
    "Text me on 07700 900579 when": {"phone"}, "new phone who dis (212.555.0120)": {"phone"}, "Appelez le ０１－９９－００－１６－７２ après": {"phone"}, "call 1 (303) 555 01 18 and ask": {"phone"}, "Ruft an unter (030) 23125-347": {"phone"},
    "order number 433377285 shipped, build 6.6.471": set(), "ticket #6699-27828 has been open": set(), "we won the set 21-19, 18-21, 21-7": set(), "catalogue 978-0-63271-900-8 is out of print": set(), "error code 0x7426, firmware 4.185, ip 192.0.2.4": set(),
    "my tax id 00 339 878 595 does not work": {"id_number"}, "they read out 987654306 as my social": {"id_number"}, "posted my own SSN QQ 33 87 69 C": {"id_number"}, "Renewing passport X29022063, fourth visit": {"id_number"}, "Meine Ausweisnummer X7640126Y wird": {"id_number"},
    "I live at 155a West Wren Street and": {"address"}, "On habite au 93 impasse du Puits Neuf, 00120 Brissac-le-Bas": {"address"}, "Vivimos en Plaza de los Tejedores 141, piso 2": {"address"}, "Wir wohnen in der Speicherstraße 161 in Muldenau": {"address"},
    "Moramos na Travessa da Fonte Seca 177, 0099-120 Vilarel": {"address"}, "Ferry 5 leaves from Pier 5, Nordwick square, at 5:45": set(), "set the oven to 425 degrees for 4 hours": set(),
    "Huge thanks to Hugo Dunvarrow for": {"person_name"}, "just met J. Ashgrimmer at the kiosk": {"person_name"}, "my landlord THOMAS DUNVARROW raised": {"person_name"}, "Festival lineup: Ferrin Trio, Cinder Hill Brass": set(), "": set(),
    "mail anna.velmorin@example.com": {"email"}, "M. Quistrel owes me a bicycle pump": {"person_name"}, "On habite au 16B bis rue du Vieux Lavoir": {"address"},
    "my tax id is odd. Text me on 2125550161 when": {"phone"},
}


@pytest.mark.parametrize("text,kinds", list(PERSONAL.items()))
def test_personal_kinds(text, kinds):
    assert {k for _, _, k in personal.find_spans(text)} == kinds


def test_personal_items_of_any_length():
    """An item is replaced whole, however long it or what is around it is."""
    host = ".".join(["sub"] * 60) + ".example.com"
    local = "a" * 10_000
    for text, want in (
        (f"write to bob@{host} today", "write to [EMAIL] today"), (f"write to {local}@example.com today", "write to [EMAIL] today"),
        ("x" * 100_000 + " a.b@example.com " + "y" * 100_000, "x" * 100_000 + " [EMAIL] " + "y" * 100_000),
        ("mail simon at " + "ferry dot " * 40 + "example now", "mail [EMAIL] now"),
        ("pay to DE89 3704 0044 0532 0130 00 please", "pay to [ACCOUNT] please"), ("card 4111 1111 1111 1111 was charged", "card [ACCOUNT] was charged"), ("card 4111 1111 1111 1112 was charged", "card 4111 1111 1111 1112 was charged"),
        ("see https://rosa:secret@host.example/x", "see https://[ACCOUNT]@host.example/x"),
        ("Nguyen Thi Lan lives at the end of it", "[PERSON_NAME] lives at the end of it"), ("Meet Priya Raghunathan tomorrow", "Meet [PERSON_NAME] tomorrow"),
        ("Спасибо, Ольга Ковальчук, за всё", "Спасибо, [PERSON_NAME], за всё"), ("Живу на ул. Лесная, д. 14 уже год", "Живу на [ADDRESS] уже год"), ("Dzięki, Łukasz Żeromski, za pomoc", "Dzięki, [PERSON_NAME], za pomoc"),
    ):
        assert personal.redact(text, personal.find_spans(text)) == want


def test_personal_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "call +44 7700 900184 or mail a.b@example.com", 5), (3, "call +44 7700 900184 or mail a.b@example.com", 5), (4, "x " * 100_000 + "mail a.b@example.com", 5)], "k bigint, t string, kind int")
    got = sorted((r["rec_key"], r["kind"]) for r in personal.personal_kinds(df, "actions", F.col("k").cast("string"), "t").collect())
    assert got == [("3", "email"), ("3", "email"), ("3", "phone"), ("3", "phone"), ("4", "email")]
    red = [r["t_redacted"] for r in personal.redacted(df, "t").collect()]
    assert red[:3] == [None, "", "call [PHONE] or mail [EMAIL]"] and red[4].endswith("x mail [EMAIL]")
    assert personal.personal_kinds(df.limit(0), "a", F.col("k").cast("string"), "t").count() == 0


ABUSIVE = ["You are a worthless clown", "Y0u 4r3 4 w0r7hl355 cl0wn", "You are a uѕеlеѕs l***r", "You are a c   l   o   w   n", "I will find you and beat you until you cry", "Eres un imbécil miserable, lárgate de aquí", "Immigrants are vermin and should be driven out", "お前みたいなゴミ野郎は消えろ", "Send me nudes or I will keep asking"]
HARMLESS = ["I felt like a complete idiot when I locked myself out", "Please stop calling strangers clown online, words hurt", "Pest control came for the rats and vermin", "My code is garbage but it runs", "The naked mole rat is thirty years old", "", "New paper on hate speech against refugees", "Chicken breast, thighs and wings on sale"]


def test_abuse_cases():
    assert [t for t in ABUSIVE if abuse.score_text(t)[0] < abuse.THRESHOLD] == []
    assert [t for t in HARMLESS if abuse.score_text(t)[0] >= abuse.THRESHOLD] == []


UNGATED = ["Refugees should be shot", "All immigrants should be deported", "Death to all immigrants", "Immigrants should be kicked out", "Throw the immigrants out", "We will put you in a grave", "Somebody should put you in a coffin"]


def test_gates_let_every_alternative_pass():
    """Every alternative of every window is tried: its gate opens for a text that it matches."""
    assert [t for t in UNGATED if abuse.score_text(t)[0] < abuse.THRESHOLD] == []
    rng = random.Random(3)

    def write(items, pick):
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                out += chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else "q"
            elif name in ("ANY", "NOT_LITERAL"):
                out += "q"
            elif name == "BRANCH":
                out += write(pick(arg[1]), pick)
            elif name == "SUBPATTERN":
                out += write(arg[3], pick)
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(write(arg[2], pick) for _ in range(rng.choice(range(arg[0], min(arg[1], arg[0] + 2) + 1))))
        return out

    def branches(items):
        for op, arg in items:
            if str(op) == "BRANCH":
                yield arg[1]
                for x in arg[1]:
                    yield from branches(x)
            elif str(op) == "SUBPATTERN":
                yield from branches(arg[3])
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT"):
                yield from branches(arg[2])

    tried = 0
    for score, kind, p in abuse.WINDOWS:
        parsed = abuse._parser.parse(p)
        for group in list(branches(parsed)):
            for one in group:
                for _ in range(3):
                    s = write(parsed, lambda g, group=group, one=one: one if g is group else rng.choice(g))
                    m = abuse.re.search(p, s)
                    if m:
                        tried += 1
                        assert (score, kind, abuse.re.compile(p)) in abuse._open(abuse._present(s.split(" "))), (p, s)
    assert tried > 10_000


def test_misspelled_terms_of_all_classes():
    texts = ["Foreigers are vermin", "Refugees are vermni", "Refugees are cockroackes", "Send me nuddes", "You are an idoit", "You are a bastrad", "Immigrnats are parasites"]
    assert [t for t in texts if abuse.score_text(t)[0] < abuse.THRESHOLD] == []


def test_masked_and_single_words():
    assert {"porno", "prick", "pussy"} & set(abuse.terms_of("p****")) >= {"porno", "prick", "pussy"}
    texts = ["show me your p****", "Vaffanculo!", "Defol!", "Siktir!", "Kys!"]
    assert [t for t in texts if abuse.score_text(t)[0] < abuse.THRESHOLD] == []
    assert [t for t in ("Ok!", "Rats!", "You.", "P****") if abuse.score_text(t)[0] >= abuse.THRESHOLD] == []


OTHER_ABUSE = ["Go back to your country, you animal.", "I'll slit your throat when I see you.", "Blacks are not human.", "Muslims should be banned from living here.", "Wanna see my cock?", "You should be hanged, traitor.", "Tu es une grosse merde", "you are a mroon", "You're such a cnut", "The Zorblaxians are vermin", "Whore!", "Kys"]
OTHER_ABUSE += ["No vales nada, ojalá desaparezcas", "Du bist nichts wert", "Tu ne sers à rien", "Envoie-moi des photos de toi sans vêtements", "Mándame fotos sin ropa", "クズは黙ってろ、誰もお前なんか好きじゃない", "You are nothing", "I hope you disappear"]
OTHER_CLEAN = ["You are nothing like your brother", "Envoie-moi des photos du jardin, sans rien changer", "No vale nada esta lavadora", "誰も怒らなかった","I will find you a good seat", "I'll get you a coffee", "You are not stupid, do not worry", "Go back to your seat please", "You should be banned from the kitchen, that cake was the best", "Stop saying refugees are parasites", "Women should vote in every election", "Courgettes are not people", "You are the best clown in the circus", "They called me a loser at school and it hurt"]


def test_abuse_in_other_words():
    assert [t for t in OTHER_ABUSE if abuse.score_text(t)[0] < abuse.THRESHOLD] == []
    assert [t for t in OTHER_CLEAN if abuse.score_text(t)[0] >= abuse.THRESHOLD] == []


def test_context_is_fitted_and_holds_out(spark, data):
    """Weights of four fifths of the labels judge the rest."""
    rows = sorted((r["text"], r["label"]) for r in table(spark, data, "review_labels").collect() if r["label"] and r["text"])
    random.Random(5).shuffle(rows)
    both = found = true = 0
    for k in range(5):
        w = abuse.fit_context([r for i, r in enumerate(rows) if i % 5 != k])
        for t, label in rows[k::5]:
            got = abuse.score_text(t, weights=w)[0] >= abuse.THRESHOLD
            both, found, true = both + (got and label != "clean"), found + got, true + (label != "clean")
    assert both / found > 0.95 and both / true > 0.95
    assert abuse.fit_context([]) == abuse.PRIOR
    told = ("abusive", "quoted", "own", "harmless", "negated")
    assert all(abuse.PRIOR[abuse.SIGNS.index(s)] * w[abuse.SIGNS.index(s)] > 0 for s in told)


def test_abuse_agrees_with_labels(spark, data):
    rows = [r for r in table(spark, data, "review_labels").collect() if r["label"]]
    right = sum((r["label"] != "clean") == (abuse.score_text(r["text"])[0] >= abuse.THRESHOLD) for r in rows)
    assert right / len(rows) > 0.97  # some labels are wrong


def test_automaton_matches_edit_distance():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    trie, words = abuse.Trie(), ["clown", "coward", "parasite", "moron", "brute", "creep"]
    for w in words:
        trie.add(w)
    rng = random.Random(4)
    for _ in range(400):
        w = rng.choice(words)
        s = list(w)
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.choice("bdfhk")
        s = "".join(s)
        if any(a == b for a, b in zip(s, s[1:], strict=False)):
            continue  # repeats are free for the automaton
        got = {t for _, t in trie.within(s, 1)}
        want = {t for t in words if edits(s, t) <= 1}
        assert want <= got and all(edits(s, t) <= 2 for t in got)


def test_scores_and_rates(spark):
    df = spark.createDataFrame([(1, "You are a worthless clown", None, "a", "z"), (2, "", "hello there friends", "a", "z"), (3, None, None, None, "z"), (1, "You are a worthless clown", None, "a", "z")], "ingest_seq bigint, action_text string, target string, feed string, field string")
    got = abuse.score_fields(df.drop("field"), "ingest_seq", ["action_text", "target"], only_found=True).collect()
    assert sorted((r["ingest_seq"], r["field"]) for r in got) == [(1, "action_text"), (1, "action_text")]
    rates = {(r["feed"], r["field"]): (r["texts"], r["found"]) for r in abuse.rates(df, "ingest_seq", ["action_text", "target"], "feed").collect()}
    assert rates == {("a", "action_text"): (2, 2), ("a", "target"): (1, 0)}
    assert abuse.score_fields(df.limit(0), "ingest_seq", ["target"]).count() == 0


def test_language_names(spark):
    df = spark.createDataFrame([(x,) for x in ("EN", "en-US", "eng", "English", "pt-BR", "jpn", "xx", "und", "unknown", "", None, "zh", "Deutsch", " ru ")], "l string")
    assert [r[0] for r in df.select(languages.named_language(F.col("l"))).collect()] == ["en", "en", "en", "en", "pt", "ja", None, None, None, None, None, None, None, "ru"]


def test_full_sentences_only():
    assert languages.passages("lol") == [] == languages.passages("https://lumo.example/p/7 @a.b #tag 😂") == languages.passages("+1 ok")
    assert len(languages.passages("План на воскресенье: погулять без цели. // Trading the printer for a cup of coffee.")) == 2


@pytest.fixture(scope="module")
def net(spark):
    sf = "/root/testdata/sf0.1"
    clean = [table(spark, sf, "pinned_posts").select("post_text", "lang")]
    return languages.fit_language_net(table(spark, sf, "actions"), clean, key="ingest_seq", text="action_text", lang="lang")


def test_language_held_out_accuracy(spark, net):
    """Main language of held-out evaluation texts, whose labels are clean and whose sentences occur in no post."""
    rows = table(spark, "/root/testdata/sf0.1", "eval_items").collect()
    right = 0
    for r, found in zip(rows, languages.judge(net, [r["item_text"] for r in rows], {}), strict=True):
        chars: dict[str, int] = {}
        for s, code, _, sure in found:
            if not sure:
                continue
            chars[code] = chars.get(code, 0) + len(s)
        right += max(chars, key=chars.get, default=None) == r["lang"]
    assert right / len(rows) > 0.9


def test_language_tables(spark, net):
    two = "План на воскресенье: погулять без цели, а потом написать открытки. // Still thinking about the compost heap from the harbour market and the old tannery."
    df = spark.createDataFrame([(1, two, "ru", 1), (2, None, "en", 1), (3, "", None, 1), (4, "lol", None, 1), (5, two, None, 1)], "ingest_seq bigint, action_text string, lang string, segment int")
    got = sorted((r["ingest_seq"], r["true_lang"]) for r in languages.unnamed_languages(df, "ingest_seq", "action_text", "lang", net).collect())
    assert got == [(1, "en"), (5, "en"), (5, "ru")]
    seg = languages.language_segments(df, "ingest_seq", "action_text", net).where("ingest_seq = 1").collect()
    assert [(r["segment"], r["lang"]) for r in seg] == [(0, "ru"), (1, "en")] and all(0.5 < r["confidence"] <= 1 for r in seg)
    assert languages.unnamed_languages(df.limit(0), "ingest_seq", "action_text", "lang", net).count() == 0


def test_every_text_has_a_language(spark, net):
    texts = [None, "", "😂 123", "lol", "ok danke", "Это не просто", "这是一个用中文写的句子，没有其他语言。", "هذه جملة مكتوبة باللغة العربية فقط", "The ferry leaves at noon and we will be late. " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "ingest_seq bigint, action_text string")
    got: dict = {}
    for r in languages.language_segments(df, "ingest_seq", "action_text", net).collect():
        got.setdefault(r["ingest_seq"], []).append(r)
    assert set(got) == set(range(len(texts))) and all(0 <= r["confidence"] <= 1 for rows in got.values() for r in rows)
    assert [(got[i][0]["lang"], got[i][0]["confidence"], got[i][0]["full"]) for i in range(3)] == [("und", 0.0, False)] * 3
    assert [got[i][0]["lang"] for i in (5, 6, 7, 8)] == ["ru", "und", "und", "en"] and got[8][0]["full"] and not got[3][0]["full"]
    # the whole text counts, but for the spaces between sentences
    assert sum(r["chars"] for r in got[8]) >= 3000 * 45


def test_network_is_saved(spark, net, tmp_path):
    path, fits = str(tmp_path / "net"), []

    def fit():
        fits.append(1)
        return net

    first, again = languages.saved_net(spark, path, fit), languages.saved_net(spark, path, fit)
    assert len(fits) == 1
    x, _ = languages._windows(["The ferry leaves at noon", "Das Boot fährt um zwölf"])
    assert np.array_equal(first.probabilities(x), again.probabilities(x))
