from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpuslens.llm.packing import Encoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, sequence_id string"
ODD = ["it's 'tis I'LL ²3 a²b ªº × ÷ ÿ", "¿qué? «oui», x_y 12.5.\n!!. a... b", "", " \t\n", "İ Σς ＡＢ", "É́", "<|endoftext|> a", "a\x85b\x1cc"]


def test_encoder_equals_the_tokenizer():
    encode, whole = Encoder(PATH, known=10), Tokenizer.from_file(PATH)
    for text in ODD * 2 + ["word, Word. WORD.\nword " * 50]:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_round_trip_without_gaps(spark, rng):
    texts = ODD + [None, "long words, " * 4000] + ["some text here. " * rng.randrange(1, 400) for _ in range(60)]
    docs = [(k, t, "x") for k, t in enumerate(texts)]
    rows = pack(spark.createDataFrame(docs, DOCS).repartition(3), PATH, open_windows=3, width=512).collect()
    whole = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, text, _ in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[k], key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == ids
        assert all(r.doc_tokens == len(ids) for r in own)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    fills = []
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        fills.append(sum(r.length for r in own))
    assert max(fills) <= 512
    assert sum(f < 512 for f in fills) <= 6  # only merged leftovers are not full


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], DOCS)
    assert pack(empty, PATH, with_ids=False).count() == 0
    twice = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, "b", None)], DOCS)
    got = pack(twice, PATH, with_ids=False).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 2), (1, 2), (1, 2)]
