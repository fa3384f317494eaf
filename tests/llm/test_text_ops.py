"""Personal data, language, HTML and decontamination: patterns against plain regular expressions, known cases, held-out accuracy."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wattloom.llm import decontamination, html_text, langid, pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text):
    return sorted((m.start(), list(BASE).index(k), k, m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m.group()))


def noise(rng, n):
    return "".join(rng.choice("0123456789ab.@@+-() \n%é") for _ in range(n))


PLANTED = ["write to a.b+c@d-e.co.uk, or x@y", "host 10.0.255.1 and 1.2.3.4.5.6.7.8 and 300.1.1.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (456) 555-2186 now", "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432",
           "a@b.c@d.e", "@x.y", "", None, "SSN 078-05-1120", "part 078-05-1120"]


def KIND(k):
    return list(BASE).index(k)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    for t in [*PLANTED, *[noise(rng, rng.randint(0, 120)) for _ in range(4000)]]:
        got = [(s, KIND(k), k, e) for s, e, k, _ in pii.spans_of(t) if k in pii.BASE]
        assert got == base_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1" * 150_000, "+1((((" * 50_000, "@" * 300_000, "a@" * 150_000):
        pii.spans_of(t)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    kinds = lambda t: [k for _, _, k, _ in pii.spans_of(t)]
    assert kinds(PLANTED[4]).count("iban") == 2
    assert kinds("SSN 078-05-1120") == ["national_id"] and kinds("part 078-05-1120") == []
    score = {k: p for _, _, k, p in pii.spans_of("visa card 4111111111111111")}["card"]
    assert score > {k: p for _, _, k, p in pii.spans_of("order 4111111111111111")}["card"]


def test_masking():
    assert pii.masked("mail a@b.cd, card 4111 1111 1111 1111.") == "mail [EMAIL], card [CARD]."
    assert pii.masked(None) is None and pii.masked("") == "" and pii.masked("plain") == "plain"


def test_digest_query(docs, corpus, no_docs):
    got = sorted(map(tuple, pii.digest(docs).select("doc_id", "n_email", "base_sha256").collect()), key=repr)
    want = sorted(((i, 0, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base_spans(t)).encode()).hexdigest()) for i, t in corpus), key=repr)
    assert got == want
    assert pii.digest(no_docs).count() == 0 and pii.mask_pii(no_docs).columns == no_docs.columns


def test_masked_rows_keep_their_columns(spark):
    d = spark.createDataFrame([(1, "x a@b.cd", 8, None), (2, None, None, "y"), (1, "x a@b.cd", 8, None)], "doc_id long, text string, n_chars long, spans string")
    got = sorted(map(tuple, pii.mask_pii(d).collect()), key=repr)
    assert got == [(1, "x [EMAIL]", 9, None), (1, "x [EMAIL]", 9, None), (2, None, None, "y")]


LETTERS = {"en": "the of and to in that is was", "fr": "le la des est que dans une pour", "de": "der die und das nicht mit von sich", "es": "el los que una por con para las"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(LETTERS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, l, rng.randint(3, 60)), l, 1) for i in range(400) for l in [rng.choice(list(LETTERS))]]
    rows += [(1000, None, "en", 1), (1001, "", "en", 1), (1002, "12 34 -- !", "en", 1), (1003, "the of", None, 1), (1003, "the of", None, 1), (None, "der die und das nicht", "de", 1), (1004, sentence(rng, "de", 30000), "de", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").repartition(4)


def test_language_held_out(tongues):
    got = langid.identify(tongues)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(tongues.select("doc_id", "lang").dropDuplicates(["doc_id"]), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert len(held) > 60 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got.collect()}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en" and by[None].lang_pred == "de" and by[1004].lang_pred == "de" and all(0 <= r.score <= 1 for r in by.values())
    assert got.count() == tongues.count()


def test_mixture_is_found(tongues):
    rng = random.Random(9)
    names, logp = langid.fit(tongues.select("lang", "text"))
    import numpy as np
    texts = [sentence(rng, "en", 300) + " " + sentence(rng, "de", 100), sentence(rng, "fr", 200), sentence(rng, "es", 40) + " " + sentence(rng, "fr", 40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    best, score = langid.mixture(*langid.trigrams(data, off), logp)
    assert names[best[0]] == "en" and 0.6 < score[0] < 0.9 and names[best[1]] == "fr" and score[1] == 1 and 0.35 < score[2] < 0.7


def test_language_filter(tongues, no_docs):
    kept = langid.keep_languages(tongues)
    assert kept.columns == tongues.columns and kept.count() == tongues.count() - 3
    assert langid.identify(no_docs).count() == 0 and langid.keep_languages(no_docs).count() == 0
    only = tongues.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify(only).collect()} == {("und", 0.0)}


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site name</p></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="ad">Buy this now and save.</div><article><header><h1>The  title &amp; more</h1></header><p>One <b>two<br>three.<p>Caf&eacute;&nbsp;x &lt;y&gt; 3 < 4.</p><aside>Related</aside><table><tr><td>cell</td></tr></table>
<form><p>Sign up</p></form><div class="share-buttons sharing">Share me</div><p>Short.</p><section id="comments"><article><p>I liked this very much, thank you.</p></article></section></article>
<div class="cookie-notice">We use cookies.</div><footer>&copy; 2020</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == "The title & more\nOne two three.\nCafé x <y> 3 < 4.\ncell\nShort."


def test_page_without_article():
    text = "This is a sentence of the main text that goes on for a while, so that it counts. " * 3
    page = f"<body><ul class=menu><li><a href=x>Home</a></li></ul><div class='content'><h2>Head</h2><p>{text}</p><p>{text}</p></div><div class=sidebar><p>{text}</p></div>"
    assert html_text.main_text(page).split("\n") == ["Head", text.strip(), text.strip()]


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<p class='x", "<script>", "<!--", "</p></div></x>", "<a href='" * 2000, "<p \"" * 2000, "&", "&#0;&#xFFFFFF;", "<svg><p>x</p></svg>", "<>" * 1000])
def test_broken_pages(page):
    html_text.main_text(page)


def test_extract(spark):
    d = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (3, "v", "", 5), (None, "w", "<article><p>x" + "y" * 200000, 5)], "page_id long, url string, html string, n_chars int")
    got = {(r.page_id, r.n_chars) for r in html_text.extract(d).collect()}
    assert got == {(1, len(html_text.main_text(PAGE))), (2, 0), (3, 0), (None, 200001)}
    assert html_text.extract(d).count() == 5 and html_text.extract(d.limit(0)).count() == 0


ITEMS = [(1, "A farmer sold 12 apples to Maria for 5 dollars each on Monday morning, how much money did Maria pay in total?"), (2, "Which city is the capital of the old kingdom by the northern sea and why was it built there?"), (3, "two words"), (4, None), (5, ""), (6, "what is seven plus three?")]


@pytest.fixture(scope="module")
def leak_docs(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join("".join(rng.choice("qwrtzpsdf") for _ in range(5)) for _ in range(n))
    texts = {
        1: filler(50) + ". " + ITEMS[0][1] + " " + filler(50), 2: ITEMS[1][1].upper(), 3: filler(30) + ". A farmer sold 77 apples to Johann Peters for 9 dollars each on Monday morning, how much money did Johann Peters pay in total? " + filler(9),
        4: "A farmer sold 12 apples", 5: filler(200), 6: None, 7: "", 8: "two words", 9: "Tell me: what is seven plus three? Thanks.",
        10: "A farmer sold 12 apples to Maria for 5 dollars each on Friday evening, how often did Otto call?", 11: filler(40000) + " " + ITEMS[1][1],
        12: "A farmer sold 1 apples to Otto for 2 dollars each on Monday morning, how much money did Berta pay in total?",
    }
    rows = [(i, t, 1, 2) for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[0], (None, ITEMS[1][1], 1, 2)], "doc_id long, text string, item_id int, window int").repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in [*ITEMS, ITEMS[0]]], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_leaks(leak_docs, bench, monkeypatch, sent):
    monkeypatch.setattr(decontamination, "SENT_WINDOWS", sent)           # 0: all windows go into the join
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(leak_docs, bench).collect()}
    assert {(1, 1), (2, 2), (3, 1), (9, 6), (11, 2), (None, 2)} <= set(got)
    assert not {d for d, _ in got} & {4, 5, 6, 7, 8}
    assert got[3, 1].slots >= 3 and got[3, 1].consistent == 1


def test_inconsistent_slots(spark, bench):
    """The same benchmark name stands for two names here: no re-parameterised question."""
    item = [(1, "so Maria met Maria and then Maria saw Maria when only Maria knew Maria there")]
    doc = [(1, "so Otto met Berta and then Karl saw Emma when only Hugo knew Paul there"), (2, "so Otto met Otto and then Otto saw Otto when only Otto knew Otto there")]
    b, d = spark.createDataFrame(item, "item_id long, text string"), spark.createDataFrame(doc, "doc_id long, text string")
    assert [r.doc_id for r in decontamination.leaks(d, b).collect()] == [2]


def test_drop_leaks(leak_docs, bench, no_docs):
    kept = decontamination.drop_leaks(leak_docs, bench)
    assert kept.columns == leak_docs.columns
    assert {4, 5, 6, 7, 8} <= {r.doc_id for r in kept.collect()} and not {1, 2, 3, 9, 11, None} & {r.doc_id for r in kept.collect()}
    assert decontamination.leaks(no_docs, bench).count() == 0 and decontamination.leaks(leak_docs, bench.limit(0)).count() == 0


def test_exact_copies_always_count(spark):
    """Items of numbers, names and units, short items inside a sentence, and a long verbatim run of a longer item."""
    long = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60))
    items = [(1, "12 17 23 31 40 52 61 75 88 90"), (2, "5 kg 7 kg 9 kg 11 kg is 32 kg"), (3, "Anna Otto Karl Emma Hugo Berta Paul Maria Fritz"), (4, "Which river crosses old Vienna?"), (5, long), (6, "8 times 12 is 96")]
    docs = [(i, f"some other words before and then {t} and some more behind") for i, t in items if i != 5]
    docs += [(5, "here " + " ".join(long.split()[20:33]) + " there"), (7, "here " + " ".join(long.split()[20:32]) + " there"), (8, "12 17 23 31 41 52 61 75 88 90"), (9, "Anna Otto Karl Emma Hugo"), (10, "Which river crosses old Paris?")]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(d, b).collect()}
    assert {k for k in got if k[0] <= 6} == {(i, i) for i in range(1, 7)}
    assert not {k for k in got if k[0] in (7, 8, 9)}
    assert (got[1, 1].tokens, got[1, 1].covered, got[1, 1].slots, got[1, 1].consistent) == (10, 10, 0, 1) and (got[5, 5].tokens, got[5, 5].covered) == (60, 13)
    assert {r.doc_id for r in decontamination.drop_leaks(d, b).collect()} >= {7, 8, 9}


@pytest.mark.parametrize("front", ["<html><head><title>No</title><meta charset=x><body>", "<html><head><title>No</title>", "<svg viewBox='0 0 1 1'/>", "<iframe src=x>", "<svg><path d='M0'/>"])
def test_elements_without_an_end_tag(front):
    assert html_text.main_text(f"{front}<article><p>One two three.</p><svg width='3' /><p>Four five six.</p></article>").split("\n")[-2:] == ["One two three.", "Four five six."]


def test_formulas_stay_in_their_sentence():
    page = "<article><p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>3</mn></mrow><annotation>x=3 in TeX</annotation></semantics></math> holds here.</p></article>"
    assert html_text.main_text(page) == "So x=3 holds here." and html_text.main_text("<article><p>One two three.</p><script>x<p>Four five six.</p>") == "One two three."
