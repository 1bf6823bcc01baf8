import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")

from climaspark.llm import packing as P  # noqa: E402
from climaspark.llm import tokens as T  # noqa: E402
from climaspark.llm.queries import op4_binary_packing, table  # noqa: E402

PUBLIC = ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")


def whole(text):
    return np.asarray(T.encoder(T.default_tokenizer()).tokenizer.encode(text, add_special_tokens=False).ids + [P.END], "<u4")


@given(st.text(alphabet=st.sampled_from(list("abcDEF'.,<|>endoftx \n\t\0\x02\x1c\xa0éÉßΣσ́½²ª×÷ÀÿµJ̌ǅ日🎉12-&")), max_size=60))
@settings(max_examples=500, deadline=None)
def test_words_are_the_whole_text(text):
    texts = [text, "", f"{text} {text}.", text + "e" * 40, "<|endoftext|> <|ENDOFTEXT|>. Don't. 'S. it's,'ll (we're) x'ab.c"]
    for t, ids in zip(texts, T.ids_of(T.default_tokenizer(), texts), strict=True):
        assert ids.tolist() == whole(t)[:-1].tolist()


def test_a_full_store(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 20)
    enc = T.Words(T.default_tokenizer())
    for i in range(60):
        t = f"Word{'abcdefg'[i % 7]}, other{chr(97 + i % 26)}{chr(97 + i % 19)} words. again"
        ids, first = enc.encode(*T.flat(T.pa.array([t, t])))
        assert ids[first[1] :].tolist() == whole(t)[:-1].tolist() and enc.n < 60


def test_equal_hashes(monkeypatch):
    """Words whose hashes collide are told apart by their bytes."""
    monkeypatch.setattr(T, "mix", lambda x: x % T.U64(5))
    enc = T.Words(T.default_tokenizer())
    t = "some words here, which collide with others. Some longer internationalisation words too"
    for _ in range(2):
        ids, _ = enc.encode(*T.flat(T.pa.array([t])))
        assert ids.tolist() == whole(t)[:-1].tolist()


def test_long_texts_in_spans(monkeypatch):
    monkeypatch.setattr(T, "SPAN", 50)
    texts = ["word " * 100, "", "x" * 200, "é日 " * 30, "end"]
    for t, ids in zip(texts, T.ids_of(T.default_tokenizer(), texts), strict=True):
        assert ids.tolist() == whole(t)[:-1].tolist()


@pytest.mark.parametrize("name", PUBLIC)
def test_every_public_tokenizer(spark, documents, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    texts = ["The Quick, brown fox's  den.", "Größe\n\n  déjà vu", "<|endoftext|>", "", "日本 x\ty", "Don't STOP"]
    plain = T.Whole(path)
    assert T.is_wordwise(path) == (name == "word_bpe_49k.json")
    rows = P.pack(documents(list(enumerate(texts))), tokenizer_path=path, with_ids=True).collect()
    for i, t in enumerate(texts):
        ids = [x for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == [*plain.batch([t])[0], P.END]


def verify(rows, texts):
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in texts.items():
        ids, at = whole(t), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            n = r["length"]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + n].tobytes()) == r["ids_crc32"]
            assert n & (n - 1) == 0 and n <= P.LENGTH and r["offset"] == 0 and 1 << r["bucket"] == n
            at += n
        assert at == len(ids)
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_whole_table(spark, sf):
    verify(op4_binary_packing(spark, sf).collect(), {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()})


def test_odd_rows(spark, odd, documents):
    got = P.pack(odd).collect()
    assert sum(r["length"] for r in got if r["doc_id"] in (1, 4)) == 2 and P.pack(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        P.pack(odd, length=1000)


def test_buckets(spark, documents, tmp_path):
    pieces = P.pack(documents([(i, "some words here " * i) for i in range(40)]), with_ids=True)
    P.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == pieces.count() and back.where("size(ids) != shiftleft(1, bucket)").count() == 0


def test_binary_lengths():
    doc, size = P.binary_lengths(np.array([2 * 2048 + 13, 1]))
    assert doc.tolist() == [0] * 5 + [1] and size.tolist() == [2048, 2048, 8, 4, 1, 1]
    assert P.binary_lengths(np.array([3]), 1)[1].tolist() == [1, 1, 1]
