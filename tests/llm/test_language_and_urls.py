import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from panelyst.llm import langid, urls
from panelyst.llm.catalogue import URL_RULES, fold

WORDS = {
    "en": "the and that with from this have will their there which about would".split(),
    "de": "und nicht auch einer sich werden haben durch über können schon wieder".split(),
    "el": "και είναι από που για στην αυτό δεν έχει όταν".split(),
}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def fixture(spark):
    rng = random.Random(7)
    rows = [(i, text(lang, 30, rng), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(WORDS), 90))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_best_path_against_all_paths():
    rng = np.random.default_rng(8)
    bounds = np.array([0, 4, 4, 9, 10])
    scores = rng.normal(size=(10, 3)).astype(np.float32)
    got = langid.best_path(scores, bounds, 0.7)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        def value(path, a=a):
            return sum(float(scores[a + i, k]) for i, k in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:], strict=False))

        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert abs(value(tuple(got[a:b])) - value(best)) < 1e-5


def test_only_languages_of_a_word_s_script_are_scored(spark):
    """Scores by plain loops: trigrams of a word in each language written in its script, nothing for the others."""
    model = langid.learn(fixture(spark), fold("doc_id", 5) != 0)
    reader, mask = langid.Reader(), 0xFFFFFFFF
    texts = ["Der Weg und και από the", None, "", "１２ 漢字 Über " + "a" * 5000, "και schon και"]
    starts, ends, scripts, gram, words, _ = reader.read(texts)
    scores = langid.word_scores(model, starts, ends, scripts, gram)
    want = [w for t in texts for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    assert len(want) == len(scores) == words[-1]
    for row, word in enumerate(want):
        script = langid.SCRIPT_NAMES[scripts[row]]
        spoken = {"latin": ("de", "en"), "greek": ("el",)}.get(script, model.languages)
        chars = [32, 32, *map(ord, word), 32]
        for k, lang in enumerate(model.languages):
            if lang not in spoken:
                assert scores[row, k] == -np.inf
                continue
            total = 0.0
            for i in range(2, len(chars)):
                last, before, before2 = chars[i], chars[i - 1], chars[i - 2] if chars[i - 1] != 32 else 32
                h = (last * 0x9E3779B1 & mask) ^ (before * 0x85EBCA6B & mask) ^ (before2 * 0xC2B2AE35 & mask)
                total += float(model.grams[k][((h ^ h >> 15) * 0x2C1B3C6D & mask) >> 32 - langid.GRAM_BITS])
            assert abs(scores[row, k] - total) < 1e-3 * abs(total)


def test_held_out_documents_and_spans(spark):
    docs = fixture(spark)
    model = langid.learn(docs, fold("doc_id", 5) != 0)
    assert model.languages == ("de", "el", "en")
    wrong = langid.languages(docs, model).join(docs, "doc_id").where("lang_pred != lang").count()
    assert wrong == 0
    rng = random.Random(9)
    parts = [text("en", 12, rng), text("el", 12, rng), text("de", 12, rng)]
    mixed = spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string")
    spans = langid.language_spans(mixed, model).orderBy("start").collect()
    assert [(s.lang, " ".join(parts)[s.start : s.end]) for s in spans] == list(zip(["en", "el", "de"], parts, strict=True))
    row = langid.languages(mixed, model).first()
    assert row.n_switches == 2 and row.score < 0.6


def test_labels_of_other_rows_do_not_matter(spark):
    """Neither lang, source nor doc_id reaches a prediction."""
    docs = fixture(spark)
    model = langid.learn(docs, fold("doc_id", 5) != 0)
    other = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    a = [r.lang_pred for r in langid.languages(docs, model).orderBy("doc_id").collect()]
    assert a == [r.lang_pred for r in langid.languages(other, model).orderBy("doc_id").collect()]


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.learn(fixture(spark), F.lit(True))
    rows = langid.languages(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert langid.languages(no_docs, model).collect() == []
    nothing = langid.learn(no_docs, F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.languages(odd_docs, nothing).collect()} == {("und", 0.0)}


URLS = [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("casino-win.com/en/1", "", "", None, "block"),
    ("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("http://a.www.example.com/en/casino", "a.www.example.com", "/en/casino", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("https://x.net/fr/a", "x.net", "/fr/a", "net/fr/", "block"), ("https://x.net/en/a", "x.net", "/en/a", None, "allow"),
    ("https://x.com", "x.com", "", None, "allow"), ("https://com/", "com", "/", "com/", "allow"),
    ("https://a.org/free-win", "a.org", "/free-win", None, "block"), ("https://a.org/free-free", "a.org", "/free-free", None, "allow"),
    ("https://a.org/freedom/winter", "a.org", "/freedom/winter", None, "allow"), ("https://a.org/?q=POKER", "a.org", "/", None, "block"),
    ("https://a.org/scasino", "a.org", "/scasino", None, "allow"), ("https://a.org/casino2", "a.org", "/casino2", None, "block"),
    ("://?#", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("x://ÄB.net/fr/", "Äb.net", "/fr/", "net/fr/", "block"),
]


def test_urls(spark):
    rows = [(i, u, "old", "old") for i, (u, *_) in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = {r.page_id: tuple(r)[1:5] for r in urls.judge_urls(pages, URL_RULES).collect()}
    assert got == {i: tuple(want) for i, (_, *want) in enumerate(URLS)}
    assert urls.judge_urls(pages.limit(0), URL_RULES).collect() == []
    assert urls.judge_urls(pages.unionByName(pages), []).where("rule IS NULL").count() == 2 * len(URLS)


def test_finder_against_plain_search():
    import re

    count = urls._finder(urls.STRICT, urls.SOFT)
    rng = random.Random(10)
    pool = [*urls.STRICT, *urls.SOFT, "-", "/", ".", "a", "1", "é", "X"]
    for _ in range(3000):
        url = "".join(rng.choice(pool) for _ in range(rng.randrange(8)))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url)
        found = lambda terms: sum(bool(re.search(rf"(?<![a-z]){t}(?![a-z])", low)) for t in terms)
        assert count(url) == (found(urls.STRICT), found(urls.SOFT))
