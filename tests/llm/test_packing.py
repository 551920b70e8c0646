import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing


def _brute(rows, capacity=2048):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    out = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            out.append((i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def _check(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_sequences(odd_docs):
    rows = packing.pack_documents(odd_docs).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == Counter(_brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()]))
    _check(rows)


def test_word_cache_is_exact(monkeypatch):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", "  a  b", "It's the dog's.", "x\n\ny.,", "café, Ét.", "<|endoftext|> a <|startoftext|>b. <|STARTOFTEXT|>", "ΟΔΟΣ, ΑΣ.",
             "a b c.\x1cd", "İstanbul. 12,34.5 'll. we'll, 漢字, 字。", "H̱x ẖ.", "a.\tb,\rc", "... ,,, .", "'s. 's, d'd."]
    for limit in (1_000_000, 3):
        monkeypatch.setattr(packing, "CACHE_WORDS", limit)
        packing._CACHE.clear()
        packing._TOKENIZERS.clear()
        for x, raw in zip(texts + texts, packing.encode_texts(texts + texts, packing.default_tokenizer())):
            assert np.frombuffer(raw, "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids


def test_letters_that_become_marks_are_not_cut_off():
    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["TARİHİ.", "abcİ.", "abcİ,", "घोड\u095c,", "বা\u09df,", "ש\ufb2a.", "ab\u0958. ab\u0958, x"]
    for x, raw in zip(texts, packing.encode_texts(texts, packing.default_tokenizer())):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids


def _best_fit(lengths, capacity):
    """Sequences that best fit decreasing opens, document by document."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in room if s >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else capacity) - n)
    return len(room)


def test_plan_matches_document_by_document_best_fit():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        room = _best_fit(lengths, capacity)
        counts = Counter(lengths)
        runs = packing.plan_slots(counts, capacity)
        used, sequences = Counter(), {}
        for length, lo, hi, each, first, place in runs:
            assert lo == used[length]
            used[length] = hi
            for rank in range(lo, hi):
                sequences.setdefault(first + (rank - lo) // each, []).append((place + (rank - lo) % each * length, length))
        assert used == counts and len(sequences) == room
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity


def test_hot_length_is_ranked_by_many_groups(spark):
    pieces = spark.range(3000).selectExpr("id doc_id", "0 piece", "0L start", "if(id % 3 = 0, 5L, 1 + id % 7) length", "id ids_crc32")
    rows = packing.pack(pieces, capacity=16, rank_group=50).collect()
    assert len(rows) == 3000
    assert _check(rows, 16) == _best_fit([r["length"] for r in rows], 16)


def test_empty(no_docs):
    assert packing.pack_documents(no_docs).count() == 0
