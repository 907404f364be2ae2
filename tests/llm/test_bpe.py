import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftline.llm import bpe
from driftline.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(blob):
    return np.frombuffer(blob, "<u4").tolist()


def encoded(df):
    out = bpe.decode(bpe.encode(df, tokenizer_path(), buckets=5), tokenizer_path())
    return out.collect()


def test_ids_and_text_are_the_librarys(odd, tok):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), r["decoded"]) for r in encoded(odd))
    want = []
    for r in odd.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"] if r["doc_id"] is not None else -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_empty_table(make):
    assert encoded(make([])) == []


def test_added_tokens_and_white_space(make, tok):
    texts = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x  \n\n y", "   ", "'s 'S it's", "\x01\x02\x00", "a b", "�", "½ ²", "＜|endoftext|>"]
    for r in encoded(make(list(enumerate(texts)))):
        assert ids_of(r["ids"]) == tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded"] == texts[r["doc_id"]]


def test_code_points_that_unicode_versions_class_differently(make, tok):
    b = bpe.load(tokenizer_path())
    assert b.odd_ranges
    lows = [int(x, 16) for x in b.odd_ranges.replace("\\U", " ").replace("-", " ").split()]
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}" for c in lows if not 0xD800 <= c < 0xE000]
    for r in encoded(make(list(enumerate(texts)))):
        assert ids_of(r["ids"]) == tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_long_texts_are_split_in_pieces(monkeypatch, tok):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    text = "Some words, and more words 123 it's  here. " * 40
    b = bpe.load(tokenizer_path())
    pieces = [w for part in b.split(text) for w in part]
    assert pieces == b.words.findall(text)


@pytest.mark.parametrize("top", [1, 200, 224, 70_000, 1 << 20, 1 << 32])
def test_packing(top):
    v = np.random.default_rng(1).integers(0, top, 3000, dtype=np.uint64).astype(np.uint32)
    assert (bpe.unpack(bpe.pack(v), len(v)) == v).all()
    assert len(bpe.unpack(bpe.pack(v[:0]), 0)) == 0


def test_keys_of_other_types(spark):
    df = spark.createDataFrame([("a", "x y", 1), (None, "z", 2)], "name string, body string, ids int")
    got = {r["name"]: r["n_tokens"] for r in bpe.encode(df, tokenizer_path(), "name", "body").collect()}
    assert got == {"a": 2, None: 1}


def test_several_blocks_and_a_wrong_file(make, monkeypatch, tmp_path, tok):
    texts = [f"doc {k} shares words with all others and has x{k}" for k in range(30)]
    rows = [r for r in bpe.encode(make(list(enumerate(texts))), tokenizer_path(), buckets=3).collect()]
    assert all(ids_of(r["ids"]) == tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in rows) and len(rows) == 30
    import json

    spec = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBpe(str(tmp_path / "t.json"))
    made = list(bpe.Blocks(tokenizer_path(), bpe.load(tokenizer_path()).odd_ranges, 4)(make(list(enumerate(texts))).toArrow().select(["doc_id", "text"]).to_batches()))
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 100)
    more = list(bpe.Blocks(tokenizer_path(), bpe.load(tokenizer_path()).odd_ranges, 4)(make(list(enumerate(texts))).toArrow().select(["doc_id", "text"]).to_batches()))
    assert len(made) < len(more) and sum(len(b[1]) for b in more) == 30
