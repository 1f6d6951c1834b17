import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from treelift.llm.packing import VOCABULARY, Packer, WordMemo, pack_documents, pack_examples

ODD = ["", " ", "\n\n", "It's  done. DON'T, x", "a.b,c", "É, ñ. ß", "ΑΣ, Σ", "İx", "don't.", "1,234.5", "<|endoftext|> x", "naïve\u00a0co", "e\u0301, o\u0308.", "日本語, 。", "..", ",", "a\tb\x1cc", "ªº, ŉa."]


def test_ids_are_those_of_the_tokenizer():
    plain = Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(2)
    texts = ODD + [" ".join(rnd.choice(ODD) for _ in range(30)) for _ in range(50)]
    for limit in (10**6, 5):
        memo = WordMemo(VOCABULARY, limit)
        for at in range(0, len(texts), 7):
            for t, got in zip(texts[at : at + 7], memo.encode(texts[at : at + 7]), strict=True):
                assert got.tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1]


def test_a_word_is_learned_once():
    memo, plain = WordMemo(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = ["Word, word. WORD; word: word\nword!"]
    texts += ["<|ENDOFTEXT|> X, y", "A,. b., C", "it'S, Don'T. 'S, x' , y", "4, 5. É, Ü; Ŀ: ǆ! Ǆ? İ, x", "a_, b-. (c), d)", "Ω, x", " , .", "x,\n. y"]
    got = memo.encode(texts[:1])
    assert set(memo.at) == {"", "word", ",", ".", ";", ":", "word!"}
    for t, ids in zip(texts, got + memo.encode(texts[1:]), strict=True):
        assert ids.tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1]


def check(pieces, full):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc_id, ids in full.items():
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
    return by_sequence


def test_documents(make_docs):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["alpha", "Beta,", "x.", "42"]) for _ in range(rnd.choice([0, 3, 50, 700, 5000]))) for _ in range(250)]
    texts[3] = None
    plain = Tokenizer.from_file(VOCABULARY)
    full = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    sequences = check(pack_documents(make_docs(texts).repartition(2)).collect(), full)
    fill = [sum(p.length for p in ps) for ps in sequences.values()]
    assert max(fill) <= 2048 and sum(f < 2048 for f in fill) <= 2 + sum(len(ps) == 256 for ps in sequences.values())


def test_limits_of_examples(spark):
    rnd = random.Random(6)
    rows = []
    for k in range(300):
        n = rnd.randint(1, 90)
        rows.append((k, [rnd.randint(0, 999) for _ in range(n)], [rnd.random() < 0.4 for _ in range(n)]))
    examples = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<boolean>")
    sequences = check(pack_examples(examples.coalesce(1), (100, 3, 40)).collect(), {r[0]: r[1] for r in rows})
    for ps in sequences.values():
        assert sum(p.length for p in ps) <= 100 and len(ps) <= 3 and sum(p.loss_tokens for p in ps) <= 40


def test_edges(make_docs):
    assert pack_documents(make_docs([])).count() == 0
    rows = pack_documents(make_docs([(None, ""), (1, None), (1, None)]).selectExpr("*", "1 as ids")).collect()
    assert sorted((r.doc_id or -1, r.length, r.doc_tokens) for r in rows) == [(-1, 1, 1), (1, 1, 1), (1, 1, 1)]
    packer = Packer((10, 2, 10), 0, window=1)
    packer.finish()
    assert packer.take().num_rows == 0
