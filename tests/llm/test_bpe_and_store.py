import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cutlab.llm import bpe, token_store
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", " ", "\n\t", "Hello, wörld! it's 12 o'clock", "ΟΔΟΣ ΣΑΣ İstanbul ẞ ß", "é é Å", "a\x1cb \x1d\x85c d e​f", "<|endoftext|>x<|startoftext|> <|EndOfText|>", "日本語のテキスト 한국어 한", "🙂👩‍👩‍👧 1½ Ⅷ ²", "don'T WE'RE i'll 'sx ''s", "a" * 400 + " " + "ab" * 300, "word " * 3000, "x<|endoftext|", "a\x7fb\x00\x01 \x02", "́ͅ",
]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_encodes_and_decodes_as_the_library(text):
    for enc in (bpe.encoder(PATH), token_store.library_encoder(PATH)):
        ids, decoded = expected(text)
        got = enc.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids and enc.decode(got) == decoded


def test_every_character_as_the_library():
    """Each assigned or unassigned character of the first planes, between letters and alone."""
    for enc in (bpe.encoder(PATH), token_store.library_encoder(PATH)):
        for at in range(0, 0x20000, 512):
            text = " ".join(f"a{c}b {c}" for k in range(at, at + 512) if not 0xD800 <= k < 0xE000 for c in [chr(k)])
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == expected(text)[0], hex(at)


def test_memory_stays_bounded():
    seen = bpe.Remembered(lambda w: w.encode(), most=10)
    for k in range(200):
        assert seen[f"w{k}"] == f"w{k}".encode() and seen["w0"] == b"w0"
    assert len(seen) <= 10 and len(seen.old) <= 10


def test_new_words_are_taken_at_once_and_memory_stays_bounded(monkeypatch):
    """One search for all unknown words of a text, which count as the library has them; small steps and memories change nothing."""
    monkeypatch.setattr(token_store, "CACHE_WORDS", 20)
    rng = random.Random(9)
    letters = "aBcΣσİẞé́\u1100\u1161,.'s1½日\x00\x1f\x85\u0378\ue000🙂"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 70]))) for _ in range(40)) for _ in range(60)]
    for step in (1, 7, 1 << 16):
        monkeypatch.setattr(token_store, "STEP_WORDS", step)
        enc = token_store.library_encoder.__wrapped__(PATH)
        for text in [*texts, *(t or "" for t in TEXTS), *texts[:9]]:
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == expected(text)[0]
            assert len(enc.known) < 20 and len(enc.old) < 20 + 3000
    enc, searches = token_store.library_encoder.__wrapped__(PATH), []
    pieces = enc.vocabulary.pieces
    monkeypatch.setattr(enc.vocabulary, "pieces", lambda word: searches.append(word) or pieces(word))
    text = " ".join(f"wörd{chr(97 + k % 26)}{chr(97 + k // 26)}x, ok" for k in range(600))
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == expected(text)[0] and not searches


def test_query_digests_with_repeats_and_other_columns(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(0, "again", "y", 2), (0, "again", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = bpe.encode_decode(df, PATH).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, _, _ in rows:
        ids, decoded = expected(t)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded)
        assert want in [(r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in by[i]]
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64])
def test_chunks_round_trip(n):
    ids = np.array([random.Random(n).randrange(2**32) for _ in range(n)], "<u4")
    assert token_store.unpack(token_store.pack(ids, 8), 8).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        token_store.unpack(b"XXXX" + token_store.pack(ids)[4:])


def test_store_in_order_with_offsets(spark, monkeypatch):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(3, "dup b"), (3, "dup a"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = token_store.stored_ids(df, PATH, content=True).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in out] == [i for i, _ in order]
    start = 0
    for r, (_, t) in zip(out, order):
        ids = expected(t)[0] + [1]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert token_store.stored_ids(df.limit(0), PATH).count() == 0
