"""Operator 13 against a plain form that holds all pairs of tokens of a text against each other."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from larkspan.llm import align

DOCS = "doc_id long, text string, row string, pair string"
TEXTS = [None, "", " ", "a", "<|endoftext|> x <|endoftext|>", "<s>a</s> <0x41> <unk>", "▁a ▁▁", "naïve café — ½ ﬁ Å①", "日本語のテキスト 🙂🙂 é", "  two  spaces\n\n\tand \x00 tabs \r\n", "x" * 3000, "The cat sat. The cat's hats, 12345!", "The cat sat. The cat's hats, 12345!"]


@pytest.fixture(scope="module")
def tokenizers():
    path_a, path_b = align.tokenizer_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_b)


def plain(tokenizers, text):
    """(A's ids, B's ids, links as id pairs, groups as told) by looking at every pair of tokens."""
    a, b = tokenizers
    if not text:
        return [], [], [], ""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    raw = [[bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
    if any(b"".join(r) != (" " + text).encode() for r in raw):
        return [], [], [], ""
    spans = []
    for r in raw:
        ends = np.cumsum([len(x) for x in r]).tolist()
        spans.append([(e - len(x), e) for e, x in zip(ends, r, strict=True)])
    links = [(i, j) for i, (s, e) in zip(ids[0], spans[0], strict=True) for j, (t, f) in zip(ids[1], spans[1], strict=True) if s < f and t < e]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    told, start = [], 0
    for cut in cuts:
        told.append("|".join(",".join(str(i) for i, (s, e) in zip(own, at, strict=True) if start <= s and e <= cut) for own, at in zip(ids, spans, strict=True)))
        start = cut
    return ids[0], ids[1], links, ";".join(told)


def check(got, texts, tokenizers):
    want = [plain(tokenizers, t) for t in texts]
    counts = Counter(p for w in want for p in w[2])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for r, (a, b, links, told) in zip(got, want, strict=True):
        assert (r.n_a, r.n_b, r.n_links) == (len(a), len(b), len(links))
        assert r.n_groups == (told.count(";") + 1 if told else 0)
        assert r.n_best == sum(counts[p] == best[p[1]] for p in links)
        assert r.count_sum == sum(counts[p] for p in links)
        assert r.groups_sha256 == (hashlib.sha256(told.encode()).hexdigest() if told else "")


def test_alignment_by_all_pairs(spark, tokenizers):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], DOCS)
    got = sorted(align.align(docs, *align.tokenizer_paths()).collect(), key=lambda r: r.doc_id)
    check(got, TEXTS, tokenizers)
    assert [r.n_a for r in got[:2]] == [0, 0] and got[6].n_links == 0 and got[3].n_links == 1


def test_alignment_of_given_documents(spark, tokenizers):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    got = align.query(spark, "/root/testdata/sf0.001").collect()
    short = [r.doc_id for r in rows if len(r.text or "") < 3000]
    by = {r.doc_id: r for r in got}
    assert len(by) == len(got) == len(rows)
    tokens = align.Tokens(*align.tokenizer_paths())
    for r in rows:  # counts need all texts, so only what a text alone gives is held against the plain form here
        if r.doc_id in short[:60]:
            a, b, links, told = plain(tokenizers, r.text)
            x = by[r.doc_id]
            assert (x.n_a, x.n_b, x.n_links, x.groups_sha256) == (len(a), len(b), len(links), hashlib.sha256(told.encode()).hexdigest())
    counts = Counter()
    for r in rows:
        *_, pairs, times = align.one_text(tokens, r.text)
        counts.update(dict(zip(list(pairs), list(times), strict=True)))
    size = len(tokens.bytes_b)
    best = Counter()
    for p, n in counts.items():
        best[p % size] = max(best[p % size], n)
    for r in rows:
        *_, pairs, times = align.one_text(tokens, r.text)
        assert by[r.doc_id].count_sum == sum(int(counts[p] * t) for p, t in zip(pairs, times, strict=True))
        assert by[r.doc_id].n_best == sum(int(t) for p, t in zip(pairs, times, strict=True) if counts[p] == best[p % size])


def test_null_ids_repeated_rows_and_empty_tables(spark, tokenizers):
    texts = ["same words here", "same words here", "same words here", "other"]
    docs = spark.createDataFrame([(None, texts[0], "", ""), (None, texts[1], "", ""), (7, texts[2], "", ""), (7, texts[3], "", "")], DOCS)
    got = align.align(docs, *align.tokenizer_paths()).collect()
    assert sorted((r.doc_id is None, r.n_links) for r in got) == sorted([(True, 3), (True, 3), (False, 3), (False, 1)])
    assert {r.count_sum for r in got if r.n_links == 3} == {9}
    assert align.align(docs.limit(0), *align.tokenizer_paths()).collect() == []


def test_both_libraries_give_the_same_ids():
    """On every kind of character beside letters, digits and signs, and on random strings."""
    tokens = align.Tokens(*align.tokenizer_paths())
    rng = np.random.default_rng(3)
    points = [c for c in range(1, 0x30000, 17) if not 0xD800 <= c <= 0xDFFF]
    texts = [f" a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}!" for c in points]
    near = [*"ab 1'\n\t.,<|>", "'s", "<|endoftext|>", "é", "日", "🙂", "́", " ", " ", "\x85"]
    texts += ["".join(rng.choice(near, 40)) for _ in range(2000)]
    for t, e in zip(texts, tokens.plain.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert tokens.quick.encode_ordinary(t) == e.ids


def test_long_texts():
    """Runs of white space that the quick library can't take, and a word without an end."""
    tokens = align.Tokens(*align.tokenizer_paths())
    for text in (" " * 1_000_000 + "a", "x" * 200_000, "word " * 100_000):
        n_a, n_b, groups, links, *_ = align.one_text(tokens, text)
        assert n_a and n_b and max(n_a, n_b) <= links < n_a + n_b and groups <= min(n_a, n_b)
