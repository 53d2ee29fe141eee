"""Byte-pair coding against the library that defines it, word by word and over whole tables."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from dyadflow.llm import bpe

SF = "/root/testdata/sf0.001"
POOL = [*"aAbeEtshinrollld'' \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​́̈éÉßİΣςσ漢字½²Ⅷ٣🎉<>|/w0123456789.,-_\x00\x7f"]
POOL += ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "the", "ing", "</w>", "ﬁ", "Å", "Ǆ", "ͅ", "가", "가"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.vocabulary_path())


def odd_texts():
    draw = random.Random(5)
    made = ["".join(draw.choice(POOL) for _ in range(draw.randrange(60))) for _ in range(5_000)]
    return [*made, "", " \n", "x" * 20_000, "ab" * 9_000 + "́", "🎉" * 3_000, "the " * 20_000]


def test_ids_and_texts_are_the_librarys(coder, library):
    texts = odd_texts()
    wanted = library.encode_batch(texts, add_special_tokens=False)
    found = coder.encode(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [w.ids for w in wanted]
    decoded = [coder.decode(f).decode() for f in found]
    assert decoded == [library.decode(w.ids, skip_special_tokens=False) for w in wanted]


def test_check_tells_exactly_which_guesses_hold(coder):
    """A greedy guess passes the check of neighbours if and only if it is what merging gives."""
    merges, draw = coder.merges, random.Random(6)
    words = ["".join(draw.choice("abcdeinorst") for _ in range(draw.randrange(2, 14))) for _ in range(4_000)]
    agree = {True: 0, False: 0}
    for word in words:
        guess = merges.greedy(word)
        pairs = np.array(guess)
        holds = bool(merges.compatible(pairs[:-1], pairs[1:]).all())
        assert holds == (guess == merges.exact(word)), word
        agree[holds] += 1
    assert min(agree.values()) > 100  # both outcomes were met


def test_guesses_try_only_lengths_that_occur(coder, monkeypatch):
    """Tokens are looked up no longer than any that starts with the same letters."""

    class Counted(dict):
        tries = 0

        def get(self, *key):
            Counted.tries += 1
            return super().get(*key)

    draw = random.Random(8)
    words = ["".join(draw.choice("abcdeinorst") for _ in range(12)) for _ in range(2_000)]
    wanted = [coder.merges.greedy(w) for w in words]
    monkeypatch.setattr(coder.merges, "inner", Counted(coder.merges.inner))
    assert [coder.merges.greedy(w) for w in words] == wanted
    assert Counted.tries < 3 * sum(map(len, wanted))


def test_short_and_long_words_are_merged_alike(coder, monkeypatch):
    draw = random.Random(7)
    words = ["".join(draw.choice("aabceehinorstt") for _ in range(draw.randrange(1, 40))) for _ in range(4_000)]
    scanned = [coder.merges.exact(w) for w in words]
    monkeypatch.setattr(bpe, "SCANNED", 0)
    assert [coder.merges.exact(w) for w in words] == scanned


def test_small_memory_gives_the_same(coder, monkeypatch):
    texts = odd_texts()[:500]
    wanted = coder.encode(texts)
    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 3)
    monkeypatch.setattr(bpe, "LONGEST_KEPT", 2)
    again = bpe.Coder(bpe.vocabulary_path())
    assert [again.encode([t])[0] for t in texts] == wanted


def test_merges_out_of_order_are_merged_exactly():
    """A merge listed before those of its parts: guesses are not trusted."""
    vocab = {s: i for i, s in enumerate(["a", "b", "c", "a</w>", "b</w>", "c</w>", "abc</w>", "bc</w>"])}
    model = {"end_of_word_suffix": "</w>", "vocab": vocab, "merges": [["a", "bc</w>"], ["b", "c</w>"]]}
    merges = bpe.Merges(model)
    assert not merges.proper
    assert merges.encode(["abc", "bc", "ba"]) == [[6], [7], [1, 3]]


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.Coder(public_tokenizers.path("byte_bpe_50k.json"))


def test_report_over_a_table_with_odd_rows(spark, library):
    odd = [(-1, None), (-2, ""), (-2, ""), (-3, "word " * 30_000), (-4, "<|endoftext|>Zoë's"), (None, "İstanbul")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "text AS ids", "1 AS n_tokens")
    found = sorted(map(tuple, bpe.report(docs).collect()), key=str)
    wanted = []
    for row in docs.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        wanted.append((
            row["doc_id"], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        ))
    assert found == sorted(wanted, key=str)
    assert bpe.report(docs.limit(0)).count() == 0


def test_encoded_and_decoded_columns(spark, library):
    rows = [(1, "Hello  World's café"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coded = bpe.encoded(docs)
    ids = {r["doc_id"]: list(r["ids"]) for r in coded.collect()}
    assert ids == {1: library.encode("Hello  World's café", add_special_tokens=False).ids, 2: [], 3: []}
    texts = {r["doc_id"]: r["text"] for r in bpe.decoded(coded).collect()}
    assert texts == {1: library.decode(ids[1], skip_special_tokens=False), 2: "", 3: ""}
