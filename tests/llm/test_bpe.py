from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from plumbline.llm.bpe import Automaton, Encoder, decode, digests, encode, tokenizer_path


@pytest.fixture(scope="module")
def own():
    return Encoder(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def same(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text.encode()) == (ids, library.decode(ids, skip_special_tokens=False)), text


TEXTS = [
    "", " ", "Hello, World! it's don't we'll 123 4a5", "aaaaaaaaaaaaaaa aaaa AAAA", "été ÉTÉ été naïve", "<|endoftext|>x<|startoftext|> <|EndOfText|>",
    "a b c\x1cd\x85e\x0bf", "日本語テキスト 한국어 ไทย", "Σίσυφος ΣΑΣ İstanbul ǅ", "'S 'Re ''s 'sx", "---***$$$ %%%&&&!!!", "½ ² ① ٣ 1٣2", "́́ a ​﻿", "🙂🙃👩‍👩‍👧",
    "x" * 3000, "ab" * 900, "\x00\x01\x7f", "don'T I'LL", "</w> a</w> <w>",
]


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(own, library, text):
    same(own, library, text)


def test_random_texts(own, library):
    rng = random.Random(1)
    alphabets = ["ab", "aeiourstln", "the ing", "abcdefghijklmnopqrstuvwxyz'0123456789 .,;", "éèàüñßs e", "aA \n\t"]
    for _ in range(3000):
        letters = rng.choice(alphabets)
        same(own, library, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60))))


def slow(word, merges, end="</w>"):
    """Merges applied one after the other."""
    out = [*word[:-1], word[-1] + end]
    for u, v in merges:
        k = 0
        while k < len(out) - 1:
            if (out[k], out[k + 1]) == (u, v):
                out[k : k + 2] = [u + v]
            k += 1
    return out


def test_random_merges_like_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        base = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
        vocab, merges = {t: k for k, t in enumerate(base)}, []
        while len(merges) < 14:
            u, v = rng.choice([t for t in vocab if not t.endswith("</w>")]), rng.choice(list(vocab))
            if u + v not in vocab:
                merges.append((u, v))
                vocab[u + v] = len(vocab)
        machine = Automaton(vocab, merges)
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert [machine.labels[t] for t in machine.read(word)] == slow(word, merges), (word, merges)


def test_frame(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(99, None, None), (0, TEXTS[2], "y"), (None, "no id", "z")]
    got = digests(encode(spark.createDataFrame(rows, "doc_id long, text string, decoded string"))).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    key = lambda r: (str(r[0]), r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decode(spark, library):
    df = spark.createDataFrame([(1, [320, 49407]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.decoded for r in decode(df).collect()} == {1: library.decode([320, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_one_transition_per_symbol(own):
    machine = own.automaton
    machine._empty()
    word = "zqxjzqxjk" * 50
    path = machine.read(word)
    # a periodic word soon meets its own states again, and reading it a second time adds none
    held = len(machine.states), len(machine.next), len(machine.ends)
    assert held[0] <= 30 and machine.read(word) == path and held == (len(machine.states), len(machine.next), len(machine.ends))
    assert "".join(machine.labels[t] for t in path) == word + "</w>"


def test_a_full_table_starts_anew(own, library, monkeypatch):
    from plumbline.llm import bpe

    monkeypatch.setattr(bpe, "ARCS", 20)
    rng = random.Random(3)
    for _ in range(60):
        same(own, library, "".join(rng.choice("abcdefgh z") for _ in range(60)))
        assert len(own.automaton.next) <= 90
