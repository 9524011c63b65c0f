import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from panelyst.llm import alignment
from panelyst.llm.catalogue import PIECES, aligner

NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


@pytest.mark.parametrize("seed", range(20))
def test_gallop_is_a_rank(seed):
    rng = np.random.default_rng(seed)
    short, long = (np.unique(rng.integers(0, size, n)) for size, n in ((5000, rng.integers(1, 400)), (5000, rng.integers(1, 3000))))
    assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()
    assert alignment.gallop(long, short).tolist() == np.searchsorted(short, long).tolist()
    assert alignment.gallop(short[:0], long).tolist() == [] and alignment.gallop(short, long[:0]).tolist() == [0] * len(short)


def libraries():
    """Ids and bytes of both vocabularies, straight from the libraries."""
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # Byte-level letters: the library's own pre-tokenizer shows each byte.
    shown = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    of = {}
    for text in [chr(i) for i in range(256)] + ["漢", "\U0001f600", "߿", "￿"] + [chr(i << 6) for i in range(4, 0x300)] + [chr(i << 12) for i in range(8, 0x110)]:
        try:
            raw = text.encode()
        except UnicodeEncodeError:
            continue
        of.update(zip(shown.pre_tokenize_str(text)[0][0], raw, strict=True))

    def ids(text):
        first = a.encode(f" {text}", add_special_tokens=False).ids
        second = b.encode(text)
        names = [b.id_to_piece(i) for i in second]
        return (
            list(zip(first, [bytes(of[c] for c in a.id_to_token(i)) for i in first], strict=True)),
            [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(second, names, strict=True)],
        )

    return ids


def plain(rows):
    """Every row by plain loops over tokens and their byte ranges."""
    ids, made = libraries(), []
    count = Counter()
    for r in rows:
        spans = [[], []]
        if r.text:
            both = ids(r.text)
            if all(b"".join(x[1] for x in side) == f" {r.text}".encode() for side in both):
                for side in (0, 1):
                    at = 0
                    for i, raw in both[side]:
                        spans[side].append((i, at, at + len(raw)))
                        at += len(raw)
        a, b = spans
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        by_end = [{x[2]: x[0] for x in side} for side in spans]
        links = [(by_end[0][e], by_end[1][e]) for e in ends]
        groups, start = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if start < x[2] <= e) for side in spans))
            start = e
        # Only small texts: all pairs of ranges.
        laps = sum(1 for x in a for y in b if x[1] < y[2] and y[1] < x[2]) if len(a) < 3000 else None
        count.update(links)
        made.append((r.doc_id, len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "", laps))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (d, na, nb, ng, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest, laps)
        for d, na, nb, ng, links, digest, laps in made
    ]


@pytest.mark.parametrize("chunk_bytes", [1, 3000, 8 << 20])
def test_against_plain_loops(spark, odd_docs, chunk_bytes):
    more = spark.createDataFrame(
        [(100 + i, t) for i, t in enumerate(["a▁b", "▁", " ", "  lead", "trail ", "<s> </s> <unk> <0x41>", "<|endoftext|>", "\u0000x", "Größe über Maß", "ﬁ Å"])],
        "doc_id long, text string",
    )
    docs = odd_docs.select("doc_id", "text").unionByName(more).where("coalesce(length(text), 0) < 30000")
    got = alignment.alignments(docs, aligner, PIECES, chunk_bytes=chunk_bytes).select(*NAMES).collect()
    want = plain(docs.collect())
    skip = {w[:-1] for w in want if w[-1] is None}
    cut = lambda rows: sorted(repr(tuple(r)[:-1] if tuple(r)[:-1] in skip else tuple(r)) for r in rows)
    assert cut(got) == cut(want)
    assert any(r.n_a == 0 for r in got if r.doc_id == 100) and {r.n_b for r in got if r.doc_id == 106} != {0}


def test_words_give_the_ids_of_whole_texts(odd_docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), alignment.piece_level(path, most_words=3)
    rng = np.random.default_rng(4)
    pool = [*"ab1 .'!é漢\U0001f600　\u0085\n\t\u0000▁", " ", " ", "  ", "the", "▁a", "<s>", "<0x41>", "ﬁ", "A\u030a"]
    texts = [r.text for r in odd_docs.where("length(text) > 0").collect()]
    texts += ["".join(rng.choice(pool, rng.integers(1, 40))) for _ in range(4000)]
    texts = list(filter(None, texts))
    assert [own.encode(t).tolist() for t in texts] == [library.encode(t) for t in texts]


def test_every_row_once_and_none(spark, odd_docs, no_docs):
    got = alignment.alignments(odd_docs, aligner, PIECES)
    assert sorted(map(repr, (r.doc_id for r in got.collect()))) == sorted(map(repr, (r.doc_id for r in odd_docs.collect())))
    assert alignment.alignments(no_docs, aligner, PIECES).collect() == []
    assert len(aligner().both[1].pieces) == PIECES
