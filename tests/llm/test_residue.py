"""Held-out forms: worded like neither the exemplars nor the test tables."""

import random
from collections import Counter

import pytest

from lorelake.llm import residue as R

UNSEEN = """Sorry, but this web application can't be used until JavaScript has been turned on in your browser settings.
We're sorry, the shop doesn't work properly without JavaScript enabled. Please enable it to continue.
Warning! JavaScript is currently disabled. Please turn it on in order to view the video.
To use this form, your browser must support JavaScript.
This browser is no longer supported. Please switch to a supported browser.
Scripts seem to be turned off in your browser; please allow scripts and reload.
Verifying that you are human. This may take a few seconds.
Please enable cookies and reload the page to continue.
Aktivieren Sie bitte JavaScript, um diese Seite zu nutzen.
Pour afficher ce site, activez JavaScript dans votre navigateur.
Active JavaScript en su navegador para continuar.
Включите JavaScript, чтобы продолжить.
Error 404: page not found
HTTP 403 Forbidden
The URL you requested was not found.
Sorry, the page you were looking for could not be found. It may have been moved or deleted.
This page does not exist anymore. Go back to the home page.
You are not authorized to access this page.
500 - Internal Server Error. The server could not complete the request.
Bad gateway (502). The server received an invalid response from upstream.
The service is unavailable at this time. Please try again later.
Too many requests. You have reached the limit; wait and try again.
{"status": 404, "error": "Not Found", "message": "the requested resource could not be found"}
Oops! Something went wrong on our end. Please try again.
An unexpected error occurred while the page was loading.
Failed to load content. Please try again later.
Could not connect to the database server
Fatal error: Uncaught TypeError in /var/www/index.php on line 33
Warning: Undefined variable $x in /home/a/b.php on line 9
Traceback (most recent call last):\\n  File "x.py", line 3, in <module>
Your login session has expired, please sign in again.
Please log in or register to read this content.
The site is down for scheduled maintenance. We will be back soon.
This site is under construction. Check back soon!
Die Seite wurde leider nicht gefunden.
La page demandée n'existe plus.
La página que ha solicitado no existe.
Страница удалена или не существует.
Сервис временно недоступен, повторите попытку.
Lorem ipsum dolor sit amet, consectetur adipiscing.
Ut enim ad minim veniam, quis nostrud exercitation.
This is some dummy text that you should replace before publication.
Placeholder text, to be replaced later.
[insert a short biography of the author here]
Hello {{first_name}}, your order has shipped.
Dear [Your name here], we are glad to have you.
Welcome back, ${user.displayName}!
Price: %PRODUCT_PRICE%
<h1><%= page.title %></h1>
Contact: <phone number goes here>
The title is ##TITLE## and the author is unknown.
TODO: write about the second voyage.
asdfgh qwerty asdf zxcv
bla bla bla bla bla bla
Address: TBD
Text goes here. Text goes here. Text goes here.
Description will be added later.
Hier kommt später ein Text hin: Blindtext.
Content coming soon.
click here to edit""".split("\n")

ORDINARY = """{{char}} looks up when {{user}} comes in from the rain.
[Mood: wary | HP 12 | Gold 40]
She read the letter twice: access denied, it said, and she laughed.
The old programmer told stories about the error that took a whole harbour down.
"Page not found," he joked when the librarian came back without the book.
In 1404 the gate was found open and nobody ever learned why.
The actors threw away their scripts before the second act began.
His browser history was nobody's business, the detective said.
The server carried four plates and did not drop one of them.
Dolores sat with the elite of the town and drank to a good year.
The service at the inn was slow, but the bread was warm and the beds were clean.
They were asked to wait outside while the council talked about the request.
The bridge is closed for repair until the spring floods are over.
A novel about a broken database and the two people who loved it.
The test of a good lantern is a long night.
No, no, he said, and shook his head.
The cook put the dish back on the fire to keep it warm.
Her account of the siege was lost; a copy was found in the cellar.
The forbidden garden has a gateway of white stone.
Five hundred internal letters of the guild are kept in the tower.
It cost $5 in the north, and 3 < 4 as every child knows.
The word placeholder means a mark that holds a place for something else.
The forms say "to be announced" beside every name that nobody would speak.
A bad gate way up the hill led to an invalid will.
The temporary bridge was available to all who paid the toll.""".split("\n")

WORDS = "the of and a to in that was he she it with as his her on at by which had not but from they is be this were all there when who one said if out so up no would what them into more then some could time very only your you page line read new back please site show again later first open".split()


def _corpus(n=400, seed=2):
    rng = random.Random(seed)
    names = [a + b for a in ("Mar", "Tol", "Ves", "Kor", "Lin", "Dra") for b in ("en", "ith", "ova", "ul", "as")]
    return [" ".join(rng.choices(WORDS, k=30) + rng.choices(names, k=8)) + "." for _ in range(n)]


@pytest.fixture(scope="module")
def verdicts(spark):
    def judge(texts):
        rows = [(i, t, True) for i, t in enumerate([*texts, *_corpus()])]
        docs = spark.createDataFrame(rows, "doc_id long, text string, residue boolean")
        return {r.doc_id: r.residue for r in R.judged(docs).collect()}

    return judge


def test_unseen_forms(verdicts):
    inside = [f"{_corpus(1, i)[0]} {t}\n\n{_corpus(1, i + 99)[0]}" for i, t in enumerate(UNSEEN)]
    got = verdicts([*UNSEEN, *inside, *ORDINARY])
    n = len(UNSEEN)
    alone, within, wrong = [sum(got[i] for i in part) for part in (range(n), range(n, 2 * n), range(2 * n, 2 * n + len(ORDINARY)))]
    print("missed:", [UNSEEN[i % n] for i in range(2 * n) if not got[i]], "wrong:", [ORDINARY[i] for i in range(len(ORDINARY)) if got[2 * n + i]])
    assert alone >= 0.9 * n and within >= 0.9 * n and wrong <= 1


def test_no_unseen_form_is_an_exemplar():
    known = {tuple(R.terms_in(t)) for _, t in R.exemplars()}
    unseen = {tuple(R.terms_in(R.slotted(t))) for t in UNSEEN}
    assert not known & {ts for ts in unseen if not any(x.startswith("slot:") for x in ts)}


def test_edges(spark):
    texts = [None, "", " \n", "word " * 3, "word " * 60_000, UNSEEN[12] + "\n" + "fill " * 3 + "x " * 2 + "\n", UNSEEN[12]]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(6, UNSEEN[12], False)]
    got = [(r.doc_id, r.residue) for r in R.judged(spark.createDataFrame(rows, "doc_id long, text string, residue boolean")).collect()]
    assert Counter(i for i, x in got if x) == Counter([4, 5, 6, 6]) and len(got) == len(rows)  # a word repeated without end is filler
    assert R.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exemplars_from_a_table(spark):
    rows = [(True, "The vault is sealed for the night"), (False, "they say the vault is sealed"), (None, "x"), (True, None)]
    labelled = spark.createDataFrame(rows, "residue boolean, text string")
    docs = spark.createDataFrame([(1, "The vault is sealed for the night."), (2, "error 404 not found"), (3, "a b c")], "doc_id long, text string")
    assert {r.doc_id: r.residue for r in R.judged(docs, labelled).collect()} == {1: True, 2: False, 3: False}


def test_long_slots_and_wrapped_notices(spark):
    texts = ["[Insert a two-sentence summary of the town's history, goals and known members here]", "504\nGateway Timeout\nThe server\ndid not\nrespond\nin time."]
    assert {r.doc_id: r.residue for r in R.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()} == {0: True, 1: True}
