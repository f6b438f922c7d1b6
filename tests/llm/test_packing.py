import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from latticework.llm.packing import pack, patterns

public_tokenizers = pytest.importorskip("public_tokenizers")


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_patterns_hold_every_piece_once(histogram):
    packs = patterns(histogram, 64)
    assert all(sum(held) <= 64 and n > 0 for n, held in packs)
    total = Counter()
    for n, held in packs:
        for size in held:
            total[size] += n
    assert total == Counter(histogram)


def test_pieces_against_the_json_vocabulary(spark):
    from tokenizers import Tokenizer

    texts = {1: "Hello wörld, this is text.", 2: None, 3: "", 4: "x <|endoftext|> y", 5: "many words here " * 3000, 6: "Hello wörld, this is text.", 7: "naïve 日本語 🙂\n\n tabs\t\t 12345"}
    rows = [(k, v, 0) for k, v in texts.items()] + [(6, texts[6], 1)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = pack(df, keep_ids=True).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seen = defaultdict(list)
    for r in got:
        want = coder.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        part = want[r.start : r.start + r.length]
        assert r.doc_tokens == len(want) and r["ids"] == part
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id].append((r.start, r.length))
    assert len(seen[6]) == 41 and sorted(seen[5])[0] == (0, 2048)
    assert sum(n for _, n in seen[5]) == len(coder.encode(texts[5]).ids) + 1
    packs = defaultdict(list)
    for r in got:
        packs[r.sequence_id].append((r.offset, r.length))
    for spans in packs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(df.limit(0)).count() == 0
