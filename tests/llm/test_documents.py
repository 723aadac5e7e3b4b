import random

import numpy as np
import pytest

from strandweave.llm import leaks, residue
from strandweave.sources import table


def _longest(doc, item):
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            k = 0
            while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_align_matches_brute_force():
    rng = np.random.default_rng(2)
    docs, items, want = [], [], []
    for _ in range(300):
        a, b = rng.integers(1, 5, rng.integers(1, 30)), rng.integers(1, 5, rng.integers(1, 25))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        docs.append(a)
        items.append(b)
        want.append((h.max(), _longest(list(a), list(b))))
    assert leaks.align(docs, items) == want


def test_leaks_of_documents_match_brute_force(spark, data):
    docs, items = table(spark, data, "documents"), table(spark, data, "eval_items")
    words = {r["item_id"]: leaks.words_of(r["item_text"]) for r in items.collect()}
    grams: dict = {}
    for k, w in words.items():
        for i in range(len(w) - 14):
            grams.setdefault(tuple(w[i : i + 15]), set()).add(k)
    want = set()
    for r in docs.collect():
        w = leaks.words_of(r["text"] or "")
        for i in range(len(w) - 14):
            want |= {(r["doc_id"], k) for k in grams.get(tuple(w[i : i + 15]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items).where("longest_run >= 15").collect()}
    assert got == want and want


def test_leak_cases(spark):
    item = " ".join(f"word{i}" for i in range(40))
    w = item.split()
    docs = [
        (1, "X " + " ".join(w[3:18]) + " y"), (2, " ".join(w[3:17])), (3, "“" + " ,\n".join(x.upper() for x in w[20:36]) + "”"), (4, None), (5, ""), (6, " ".join(w[:10] + ["other"] + w[11:20])),
        (7, "z " * 50_000 + " ".join(w[25:])), (8, " ".join(w[:15]).replace("o", "ο")), (1, "X " + " ".join(w[3:18])),
    ]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, "too short to leak"), (3, None)], "item_id bigint, item_text string")
    got = leaks.find_leaks(df, items).where("longest_run >= 15").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 3, 7, 8]
    assert leaks.find_leaks(df.limit(0), items).count() == 0
    assert leaks.find_leaks(df, items.limit(0)).count() == 0


def test_edited_copies_are_aligned(spark):
    """A passage that is leaked only with edits has a row, wherever its edits and those of other copies are."""
    w = [f"word{i}" for i in range(40)]

    def edit(*places):
        return " ".join("other" if i in places else x for i, x in enumerate(w))

    texts = {1: edit(7, 14, 21, 28, 35), 2: edit(5, 11, 17, 23, 29, 35), 3: edit(*range(9, 40)), 4: " ".join(w), 5: " ".join(w[:4] + ["other"]), 6: " ".join(x for i, x in enumerate(w) if i % 8)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, item_text string")
    got = {r["doc_id"]: (r["score"], r["longest_run"]) for r in leaks.find_leaks(df, items).collect()}
    assert got == {1: (65, 7), 2: (62, 5), 3: (18, 9), 4: (80, 40), 6: (66, 7)}
    alone = {r["doc_id"] for i in texts for r in leaks.find_leaks(df.where(f"doc_id = {i}"), items).collect()}
    assert alone == set(got)
    exact = {r["doc_id"] for r in leaks.find_leaks(df, items, edited=False).where("longest_run >= 15").collect()}
    assert exact == {4}


RESIDUE = [
    "{user_profile}", "Hello {{ display_name }}, here is what happened in [INSERT PERSONA HERE] this week: undefined", "Persona: [object Object]\nAnswer: %(handle)s", "Please enable JavaScript to use this site.",
    "Veuillez activer scripts pour afficher ce contenu.", "Error 403: Forbidden\nBack to the start page", "error=Gateway Timeout; status=502; id=e77d01", "Lorem ipsum dolor sit amet consectetur elit sed magna aliqua.",
    "Text text text text text", "A normal sentence about bread.\n\nThis site needs JS to run. Turn it on and reload.", "ページが見つかりません。エラー 500", "Página no encontrada. Vuelva a intentarlo más tarde (403)",
    "Sample text goes here. Replace this text with your own content.", "Your bio here. Tell people who you are. Texte à remplacer avant publication.", "XXXXX", "Traceback: KeyError 'post_body' while rendering page 7f31-a2",
]
CONTENT = [
    "Wrote a small rant about sites that demand JavaScript just to show text, and then I went for a long walk by the river.",
    "In our style guide we write ${price} for variables, and the neighbours sent cake.", "Typesetting class: why lorem ipsum is not Latin you can read, and other stories.",
    "My build page says 404 Not Found again, there is a poster at the ferry kiosk about mending socks.", "How do I escape {{ user.name }} in a template? I tried raw blocks and then gave up for the day.",
    "Turned off JavaScript for a week and most recipes still worked", "Somebody typed https://lumo.example/xxxxxxxxxxxxxxxxxxxxxx into the choir chat and nobody knows why", "", "  \n ", None,
    "Reminder that carving spoons during lunch is good for you!", "どうして古い自転車はいつもこんなににぎやかなのだろう。",
]


def test_residue_cases(spark):
    rows = [(i, t, "k") for i, t in enumerate(RESIDUE)] + [(100 + i, t, "k") for i, t in enumerate(CONTENT)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    got = {r["doc_id"] for r in residue.find_residue(df).collect()}
    assert got == set(range(len(RESIDUE)))
    assert residue.find_residue(df.limit(0)).count() == 0


MESSAGES = [
    "Страница не найдена", "Не найдено: страница не найдена", "Ошибка 404", "ОШИБКА 500", "Помилка 404", "Сторінку не знайдено", "Страница недоступна", "текст текст текст текст", "Пример текста", "Включите JavaScript", "Увімкніть JavaScript",
    "Esta página não está disponível", "Bulunamadı", "Nie znaleziono", "Strona niedostępna",
]


@pytest.mark.parametrize("text", MESSAGES)
def test_messages_of_all_scripts(text):
    assert {k for k, *_ in residue.judge(text)} - {"slot"}, text


def test_length_is_no_limit(spark):
    """A template in one paragraph, a long Japanese message, a message of more than 12 words that are not listed."""
    many = "Dear {{first}}, " + "thank you for joining {{place}} on {{day}}; your host is {{host}} and the gate is {{gate}}, " * 6
    long = "Dear reader, this is the letter that we send to everybody who has joined us since the spring, and which tells you where the next walk will start, namely at {}, as soon as the weather allows it"
    ja = "お使いのブラウザではJavaScriptが無効になっているため、このページの内容をすべて表示するにはJavaScriptを有効にしてから、もう一度このページを再読み込みしてください"
    es = "no encontrado, " * 8
    talk = "昨日の夜はエラーについて友達と長い間話していたけれど、そのあと川沿いを散歩して、古い橋の近くでおいしいパンを買い、家に帰ってから家族みんなで食べた"
    rows = [(1, many), (2, long.format("{{ place }}")), (3, ja), (4, es), (5, long.format("the old mill")), (6, talk)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.find_residue(df).collect()} == {1, 2, 3, 4}


def test_hints_are_necessary():
    """Whatever a strong pattern finds holds a hint."""
    for p in residue.STRONG.values():
        for r in residue._spelled(residue._parser.parse(p.pattern)):
            assert next(residue._hints().iter(r.replace("\0", "").replace("\n", "")), None), r
    for t in MESSAGES + RESIDUE + [x or "" for x in CONTENT]:
        low = t.casefold().replace("’", "'")
        assert not any(p.search(low) for p in residue.STRONG.values()) or next(residue._hints().iter(low), None), t


def test_slots_are_induced_from_records(spark):
    """The same placeholder in every record belongs to the template; different ones are slots never filled."""
    kept = [(i, f"Notes on {{{{ price }}}} written by number {i} of many good people here today") for i in range(8)]
    slot = [(100 + i, f"Notes for {v} written by one of many good people here") for i, v in enumerate(("{user}", "[[name]]", "$TITLE$", "%(x)s"))]
    df = spark.createDataFrame(kept + slot, "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.find_residue(df).collect()} == {100, 101, 102, 103}


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_slots_do_not_depend_on_the_number_of_records(spark, n):
    """A constant template is judged alike however often it is seen; talk stays talk beside other talk."""
    rows = [(i, "Dear {{first_name}}, welcome to {{community}}.") for i in range(n)]
    rows += [(100 + i, "Today I learned that {{ user }} is how they write a variable in the engine of my sister") for i in range(n)]
    rows += [(200 + i, f"Today I learned that ${{price}} is not money, said number {i} of the many people here") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.find_residue(df).collect()} == set(range(n))


def test_long_filled_records(spark):
    df = spark.createDataFrame([(1, "word " * 200_000), (2, "word word word word ${x} word word word")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in residue.find_residue(df).collect()] == [2]


def test_slots_are_aligned_with_filled_records(spark):
    """One placeholder in a sentence: unfilled if the same sentence is filled elsewhere, at its start, middle or end."""
    say = ["{} has not posted anything in this community since last month", "The summary that you asked for covers the time until {}", "Your weekly report about {} is ready for you to read now", "{} was seen with {} at the harbour market again and again because of the wind and the rain, said {}"]
    rows = [(i, t.replace("{}", "{{ name }}")) for i, t in enumerate(say)] + [(10 + i, t.replace("{}", "Rosa of the mill")) for i, t in enumerate(say)]
    other = [(20, "Your weekly rant about ${price} is ready for you to read now"), (21, "Your weekly rant about is ready for you to read")]
    df = spark.createDataFrame(rows + other, "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.find_residue(df).collect()} == {0, 1, 2, 3}
    alone = spark.createDataFrame(rows[:3] + other, "doc_id bigint, text string")
    assert residue.find_residue(alone).count() == 0


@pytest.mark.parametrize("n", [1, 200_000])
def test_long_text(spark, n):
    df = spark.createDataFrame([(1, "word " * n)], "doc_id bigint, text string")
    assert residue.find_residue(df).count() == 0


def test_every_kind_passes_its_own_hint():
    for kind, p in residue.STRONG.items():
        for r in residue._spelled(residue._parser.parse(p.pattern)):
            plain = r.replace("\0", "").replace("\n", "")
            assert any(kind in k for _, k in residue._hints().iter(plain)), (kind, r)


def test_slots_that_were_left_blank(spark):
    """A blank counts where other records of its template are filled in different ways, in blocks of any length."""
    tail = "we have received your order and will send it as soon as the ferry goes again " + "and again " * 60
    rows = [(1, f"Dear Anna, {tail}"), (2, f"Dear Boris, {tail}"), (3, f"Dear , {tail}"), (4, "I like plums , pears and the sea very much"), (5, f"Hello %FIRST_NAME%, {tail}"), (6, f"Hello Carla, {tail}"), (7, "Hello %FIRST_NAME%")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["evidence"]) for r in residue.find_residue(df).collect()}
    assert got == {(3, "aligned"), (5, "aligned"), (7, "aligned")}


def test_pages_that_repeat(spark):
    page = "Page not found. Error 404"
    rows = [(1, f"one\n{page}"), (2, f"two\n{page.replace('404', '500')}"), (3, "Please enable JavaScript to continue."), (4, "Please enable JavaScript to continue.")]
    got = {(r["doc_id"], r["kind"], r["evidence"]) for r in residue.find_residue(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # copies of a document are no repetition
    assert got == {(1, "error", "repeated"), (2, "error", "repeated"), (3, "script", "alone"), (4, "script", "alone")}


def test_edited_copies_are_found(spark):
    """Copies of 30 words with a word changed, dropped or added in every ten: measured recall of the score."""
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(60)]
    docs = []
    for i, t in items:
        words = t.split()[5:35]
        for at in range(4, 30, 10):
            edit = rng.randrange(3)
            words[at : at + 1] = [[rng.choice(vocabulary)], [], [words[at], rng.choice(vocabulary)]][edit]
        docs.append((i, " ".join([*(rng.choice(vocabulary) for _ in range(50)), *words, *(rng.choice(vocabulary) for _ in range(50))])))
    docs += [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(150))) for i in range(60)]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, it).where("leaked").collect()}
    assert got == {(i, i) for i in range(60)}


def test_items_in_blocks(spark, monkeypatch):
    """More items than a block holds give the same rows in several passes."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(30)]
    docs = [(i, "so " + items[i % 30][1] + " and so on") for i in range(50)]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    rows = lambda e: {tuple(r) for r in leaks.find_leaks(df, it, edited=e).collect()}
    whole = rows(False), rows(True)
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 7)
    parts = rows(False), rows(True)
    exact = lambda x: {r for r in x if r[3] >= 15}
    assert exact(parts[0]) == exact(whole[0]) and parts[1] == whole[1] and len(exact(parts[0])) >= 50


def test_more_messages_and_filler(spark):
    cases = ["Session expired, please sign in again to see this profile\nHome | Help | Terms", "asdf asdf asdf qwer qwer", "This is a dummy post used for layout only. Content coming soon.", "Under construction, please try again later"]
    talk = ["My session at the gym expired, so I signed in again at the desk and had a coffee", "The bakery is coming soon to our street, said the baker", "We used a dummy in the play and nobody noticed it"]
    df = spark.createDataFrame(list(enumerate(cases + talk)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.find_residue(df).collect()} == set(range(len(cases)))
