import struct
import zlib

import numpy as np
import pytest

from quarry.llm import token_output as T
from quarry.llm.queries import tokenizer_path

TEXTS = ["Hello, World. it's 3.14!! ...", None, "", "ÉTÉ déjà-vu ﬁ Ǆ naïve İ ſ", "a b　c ́x", "don't <|endoftext|> stop.", "é<|endoftext|>x <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> and <|endoftext", "A<|EndOfText|>b <|endoftext|> C",  "word, word. word.,", "x" * 5000, "tab\tnew\nline\x0bvt", "日本語 テキスト"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_library_on_whole_texts(whole):
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = T.WordEncoder(f.read())
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(TEXTS)]
        assert [[*ids, 1] for ids in got] == [whole(t) for t in TEXTS]


def test_memo_may_overflow(whole, monkeypatch):
    monkeypatch.setattr(T, "MEMO_WORDS", 3)
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = T.WordEncoder(f.read())
    for t in TEXTS:
        (got,) = encoder.encode([t])
        assert [*np.frombuffer(got, "<u4").tolist(), 1] == whole(t)


def test_plain_words_go_to_the_model_together_and_marks_apart(whole, monkeypatch):
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = T.WordEncoder(f.read())
    letters = "aeiounrst\u00e9\u00df\u00fc"
    words = ["".join(letters[i // 12**k % 12] for k in range(4)) for i in range(5000)]
    text = " ".join(words) + " " + " ".join(f"{w}{m}" for w, m in zip(words, ["***", "&&&", ".", "!?", "'.", ".'", "'s,", "\u00d7.", "\u00f7!", "1.", "\u0301.", "<|x|>", "\u2026."] * 400, strict=False))
    alone, add = [], encoder._add
    monkeypatch.setattr(encoder, "_add", lambda tokenizer, some, texts: (alone.extend(some), add(tokenizer, some, texts)))
    assert [[*np.frombuffer(x, "<u4").tolist(), 1] for x in encoder.encode([text])] == [whole(text)]
    assert len(alone) < 3700  # of 10,000 words; those with marks that aren't ASCII or have apostrophes, digits and accents
    # Where ids don't tell where a word ends, each goes alone.
    encoder.ends[:] = False
    encoder.memo.clear()
    assert [[*np.frombuffer(x, "<u4").tolist(), 1] for x in encoder.encode([text])] == [whole(text)]


def test_shard_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    ids = rng.choice([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1], 3000).astype(np.uint32)
    starts = np.array([0, 10, 10, 1500, 3000])
    shard = T.Shard(T.pack_shard([5, None, -3, 9], starts, ids))
    assert shard.doc_ids == [5, None, -3, 9] and shard.starts.tolist() == starts.tolist()
    assert (shard.tokens(0, 3000) == ids).all() and (shard.tokens(511, 1537) == ids[511:1537]).all()
    assert [shard.token(i) for i in range(0, 3000, 7)] == ids[::7].tolist()
    assert shard.tokens(20, 20).tolist() == []
    with pytest.raises(IndexError):
        shard.token(3000)
    with pytest.raises(ValueError):
        T.Shard(b"nope" + struct.pack("<HHQQ", 1, 0, 0, 0))


def test_files_in_order_with_nulls_and_repeats(spark, tmp_path, whole):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)][::-1] + [(2, "again", "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest = T.write_tokens(docs, f"file://{tmp_path}/t", tokenizer_path(), shard_tokens=20)
    assert manifest.count() > 2
    got = T.read_tokens(manifest, f"file://{tmp_path}/t", ids=True).orderBy("start").collect()
    want = sorted([(r[0], r[1]) for r in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    at = 0
    for r, (_, text) in zip(got, want, strict=True):
        ids = whole(text)
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_digest(docs, f"file://{tmp_path}/t", tokenizer_path()).count() == 0
