import hashlib
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from strandline.llm import bpe
from strandline.llm.queries import vocabulary_path

PATH = vocabulary_path()
LIBRARY = Library.from_file(PATH)
OWN = bpe.Tokenizer(PATH)
HARD = ["", "a" * 5000, "ab" * 3000, "x  y\n\n z<|endoftext|>hi <|endoftext|>", "don't I'll", "\x1c a\x85b\x1f ", "日本語 ひ", "é" * 999, "".join(map(chr, range(1, 3000)))]


def ids(b):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


def test_same_as_library():
    for text, got in zip(HARD, OWN.encode(HARD), strict=True):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids(got) == want
        assert OWN.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    assert [ids(x) for x in OWN.encode(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.integers(0, 50_256), max_size=20))
@settings(max_examples=100, deadline=None)
def test_any_ids_decode_alike(tokens):
    assert OWN.decode(tokens) == LIBRARY.decode(tokens, skip_special_tokens=False)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    tok = bpe.Tokenizer(PATH)
    texts = ["one two three four", "five six seven", "one two"]
    assert [ids(x) for t in texts for x in tok.encode([t])] == [LIBRARY.encode(t).ids for t in texts]


def test_frames(odd, empty):
    out = bpe.encode(odd, PATH)
    rows = out.collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.id in (3, 4)} == {0}
    back = {r.id: r.text for r in bpe.decode(out, PATH).collect()}
    for r in odd.collect():
        assert back[r.doc_id] == (r.text or "")
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(back[r.id].encode()).hexdigest() and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest()
    assert bpe.encode(empty, PATH).count() == 0
