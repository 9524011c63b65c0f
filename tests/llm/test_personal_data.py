import hashlib
import random
import re

import numpy as np
import pytest

from panelyst.llm import crf, pii
from panelyst.llm.catalogue import pii_model
from panelyst.llm.pii_examples import EXAMPLES


@pytest.fixture(scope="module")
def model():
    return pii_model()


def plain_spans(text):
    digits = lambda m: "".join(c for c in m.group() if c in "0123456789")
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m)):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m)) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_patterns_against_plain_ones():
    rng = random.Random(11)
    pool = [*"ab1 23.@-+()4.@1-. \n%é", "4111111111111111", "+1 (415) 555-0199", "a.b@c.de", "10.0.0.1"]
    for _ in range(20_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_are_read_in_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 100_000, "a@" * 100_000, "+" * 200_000, "+1 " * 100_000):
        pii.base_spans(text)


def test_the_field_learns_its_table_and_related_forms(model):
    for line in EXAMPLES:
        text, spans = pii.parse_example(line)
        assert pii.field_spans([text], model) == [spans]
    new = "please call 312-555-0175 or write to dora (at) post (dot) example (dot) com today"
    assert [new[a:b] for _, a, b in pii.field_spans([new], model)[0]] == ["312-555-0175", "dora (at) post (dot) example (dot) com"]


def test_long_stretches_are_read_whole(spark, model):
    """A number at each place of a table much longer than 400 tokens, among texts with short stretches."""
    phone = "call 415-555-0133 now, "
    texts = ["row 1 of 2, " * shift + phone * 300 for shift in range(8)] + [phone]
    wanted = [[("phone", m.start(), m.end()) for m in re.finditer("415-555-0133", t)] for t in texts]
    assert pii.field_spans(texts, model) == wanted
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.mask(docs, model).collect():
        assert r.text == texts[r.doc_id].replace("415-555-0133", "[PHONE]")


def test_decoding_in_steps_of_any_size(monkeypatch, model):
    rng = np.random.default_rng(16)
    sequences = [rng.integers(0, pii.N_FEATURES, (n, 6)).astype(np.int32) for n in (1, 64, 65, 130, 700)]
    whole = []
    for steps in (1, 7, 64, 1000):
        monkeypatch.setattr(crf, "STEPS", steps)
        whole.append([x.tolist() for x in crf.decode(model, sequences)])
    assert all(w == whole[0] for w in whole)


def test_held_out_examples():
    """Trained on three quarters of the table, the field finds most of the rest and marks little else (a wrong border counts)."""
    parsed = [pii.parse_example(x) for x in EXAMPLES]
    rest = parsed[::4]
    model = pii.train([p for i, p in enumerate(parsed) if i % 4])
    found = pii.field_spans([t for t, _ in rest], model)
    hits = sum(len(set(f) & set(s)) for f, (_, s) in zip(found, rest, strict=True))
    assert hits >= 0.5 * sum(len(s) for _, s in rest)
    assert sum(len(set(f) - set(s)) for f, (_, s) in zip(found, rest, strict=True)) <= 2


def test_decoding_against_all_paths():
    import itertools

    rng = np.random.default_rng(12)
    model = crf.Model(rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    sequences = [rng.integers(0, 6, (n, 2)).astype(np.int32) for n in (1, 4, 2, 5)]
    for x, got in zip(sequences, crf.decode(model, sequences), strict=True):
        def value(path, x=x):
            s = model.begin[path[0]] + sum(model.emissions[x[i], k].sum() for i, k in enumerate(path))
            return s + sum(model.transitions[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(itertools.product(range(3), repeat=len(x)), key=value)
        assert tuple(got) == best


def test_rows(odd_docs, no_docs, model):
    rows = pii.personal_data(odd_docs, model).collect()
    texts = sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())
    assert len(rows) == len(texts)
    for r, (_, text) in zip(sorted(rows, key=lambda r: r.doc_id or -1), texts, strict=True):
        if r.doc_id is not None:
            assert r.base_sha256 == hashlib.sha256(pii.written_spans(plain_spans(text)).encode()).hexdigest()
    assert pii.personal_data(no_docs, model).collect() == []


def test_masking(spark, model):
    docs = [(1, "mail a.b@c.de, card 4111 1111 1111 1111 and +4111111111111111 now", 5), (2, None, None), (3, "clean 2019 text", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(frame, model).collect()}
    masked = "mail [EMAIL], card [CARD] and +[CARD] now"
    assert got == {1: (masked, len(masked)), 2: (None, None), 3: ("clean 2019 text", 15)}
    assert pii.mask(frame, model).columns == frame.columns
