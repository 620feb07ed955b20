import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import awkward, no_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldpulse.llm.packing import PIECES, WordEncoder, cut_pieces, pack, packed_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Don't STOP<|endoftext|>now 3.14\x85x\x0b\x1cy", "ÉÀ ΣΑΣ İstanbul é ́a ﬁ", "日本語 العربية 🙂🙂 a b c", "x" * 5000]


@pytest.mark.parametrize("max_tokens", [2048, 64])
def test_pieces_hold_each_id_once_and_fill_sequences(spark, max_tokens):
    rows, df = awkward(spark, [(100 + n, t, "en") for n, t in enumerate(TEXTS * 8)])
    got = packed_documents(df, PATH, max_tokens=max_tokens)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc, text, *_ in rows:
        want.append((doc, np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")))
    found, filled = {}, {}
    for r in got.collect():
        found.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key in {(doc, len(ids)) for doc, ids in want}:
        same = [ids for doc, ids in want if (doc, len(ids)) == key]
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in found[key])
        assert sum(n for _, n, _ in pieces) == key[1] * len(same)
        for start, n, crc in pieces:
            assert crc in {zlib.crc32(ids[start : start + n].tobytes()) for ids in same}
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= max_tokens
    assert packed_documents(no_rows(df), PATH).count() == 0


def test_all_limits_hold_and_padding_is_small(spark):
    df = spark.range(20_000).selectExpr(
        "id as row", "id", "0L as start", "1 + pmod(xxhash64(id), 700) as length", "0L as ids_crc32", "0L as doc_tokens"
    ).selectExpr("*", "length div (1 + id % 3) as loss", "cast(null as bigint) as own")
    got = pack(df, 2048, 8, 1200)
    assert got.count() == 20_000 and got.select("row").distinct().count() == 20_000
    sums = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum("loss").alias("loss"), F.count("*").alias("k"))
    assert sums.filter("n > 2048 or loss > 1200 or k > 8").isEmpty()
    with pytest.raises(ValueError):
        pack(df, 100)


def test_pieces_of_documents_pack_almost_gapless(spark):
    text = "concat_ws(' ', transform(sequence(1, 1 + cast(pmod(xxhash64(id), 3000) as int)), x -> 'word'))"
    docs = spark.range(3000).selectExpr("id as doc_id", f"{text} as text")
    got = packed_documents(docs, PATH).groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n")
    padding, total = got.selectExpr("sum(if(n & (n - 1) = 0, 0, 2048 - n))", "sum(n)").first()
    assert padding < 0.005 * total
    assert cut_pieces(docs, PATH).columns == [c.split()[0] for c in PIECES.split(", ")]


def test_words_are_encoded_as_in_whole_texts_whatever_is_remembered():
    tokenizer = Tokenizer.from_file(PATH)
    texts = [
        "Word word. WORD, word.. word!, don't I'VE it's a1b2 3.14 e-mail co-op. x_y <|endoftext|> <|ENDOFTEXT|>", "ΣΑΣ Σας. İstanbul, ISTANBUL ſ K ß é é. Å",
        "日本語。 日本語, 한국어 각 𝔸𝔹 ﬁn. ǅ ª º ⅷ ² x². a​b ﻿c d́.", ", . ., a. A, .a", "café. café, naïve", "hello" * 60 + ".", "'s 't 'll 's.",
    ]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for kept in (1_000_000, 8, 1):
        words = WordEncoder(PATH, kept)
        for _ in range(3):
            assert words.encode([t.encode().split() for t in texts]) == want
            assert [words.encode([t.encode().split()])[0] for t in texts[::-1]] == want[::-1]
