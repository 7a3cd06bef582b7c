"""Token ids and word features against direct readings."""
import zlib

import numpy as np
import pyarrow as pa

from cantata.llm.packing import _token_pieces
from cantata.llm.queries import vocabulary
from cantata.llm.toxicity import Features

ODD = ["a\x01b \x01 c", "<|ENDOFTEXT|> Ab", "<|endoftext|>x", "", None, "x<|startoftext|>Y Z", "IT'S I'LL", "İstanbul   a ́B", "é ́E", "\x85 A\x1cB  c", "ΣΣ AΣ ", "many words " * 2500]


def test_ids_equal_whole_text_encoding():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(ODD))), "text": ODD})
    got = pa.Table.from_batches(_token_pieces(vocabulary(), 2048)([batch])).to_pandas()
    want = []
    for i, t in enumerate(ODD):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert list(got.itertuples(index=False, name=None)) == want


def test_inflected_words_share_stems():
    one, two, far = (set(Features()(t).tolist()) for t in ("achlichber", "achlichkeit", "entirely"))
    assert len(one & two) == 3 and not one & far
    assert set(Features()("").tolist()) == set(Features()(None).tolist()) == set()


def test_words_of_letters_skip_the_text_rules_with_equal_ids():
    from tokenizers import Tokenizer

    from cantata.llm import packing

    tok, ids = Tokenizer.from_file(vocabulary()), packing._Ids(vocabulary())
    latin = "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0x100)]))
    words = [a + b for a in latin + "aemz" for b in latin + "qx"] + ["internationalisation" * 20, latin * 3]
    calls, encode = [], packing._encode
    packing._encode = lambda *a: calls.append(a) or encode(*a)
    try:
        got = ids(" ".join(words))
        assert not calls
    finally:
        packing._encode = encode
    assert got == np.array(tok.encode(" ".join(words), add_special_tokens=False).ids + [0], "<u4").tobytes()


def test_caches_that_idle_workers_keep_are_small():
    from cantata.llm import packing

    assert 2 * packing.REMEMBERED * 200 <= 80e6 and Features.MOST * 350 <= 50e6
