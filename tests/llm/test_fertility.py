import math
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from latticework.llm import tokens
from latticework.llm.fertility import MEASURES, PER_TOKEN, SHARES, Measures, base_counts, judge, repeated_words, script_of

pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = (text or "").split("\n")
    seen, dup = set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@given(st.text(alphabet="ab é\n\t #|\x0b ", max_size=80))
def test_base_counts(text):
    assert base_counts(text) == brute(text)


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
def test_repeats(words):
    assert repeated_words(words) == brute(" ".join(w.decode() for w in words))[4]


def test_scripts():
    assert [script_of(x) for x in ("abc", "naïve", "Привет мир", "日本", "1 2", "γεια", "안녕")] == ["latin", "latin", "cyrillic", "han", "latin", "greek", "hangul"]


PROSE = "the house by a river was old and cold so nobody went there in winter but two brave children from town".split()


RICH = [a + b for a in "water house stone garden market window forest winter silver letter river table paper summer music animal doctor school street valley engine mirror bridge castle cotton dinner flower hammer island jacket".split() for b in ("", "s", "less", "like", "ed", "ing")]


def text_of(seed, words=PROSE, n=80):
    return " ".join(np.random.default_rng(seed).choice(words, n)) + "."


def test_verdicts(spark):
    prose = text_of(0)
    rows = {1: prose, 2: None, 3: "", 4: "short text", 5: "same words again " * 60, 6: " ".join(f"{w}%%%" for w in prose.split()), 7: prose * 400, 8: "͸" * 60}
    rows |= {100 + k: text_of(k) for k in range(1, 120)}
    df = spark.createDataFrame([(k, v, "x") for k, v in rows.items()] + [(1, prose, "y")], "doc_id long, text string, script string")
    got = {r.doc_id: r for r in judge(df).collect()}
    assert {k: (got[k].base_failed, got[k].kept) for k in (1, 2, 3, 4, 5, 6)} == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (True, False), 6: (False, False)}
    assert got[7].base_failed and all(got[k].kept for k in rows if k > 100)
    for k, text in rows.items():
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines) == brute(text)[:4] if k != 7 else got[k].base_failed
    assert judge(df).count() == len(rows) + 1 and judge(df.limit(0)).count() == 0


def brute_measures(text):
    """Token by token."""
    bpe, multi, (pieces, _) = tokens.byte_bpe(), tokens.byte_bpe(tokens.multi_path()), tokens.piece_bpe()
    ids = [list(bpe.encode_ordinary(text)), list(multi.encode_ordinary(text)), [i for w in WORD.findall(text) for i in pieces.encode(w)]]

    def is_piece(encoder, i):
        try:
            return encoder.decode_single_token_bytes(i).decode() is None
        except UnicodeDecodeError:
            return True

    shares = [sum(is_piece(e, i) for i in x) / len(x) for e, x in ((bpe, ids[0]), (multi, ids[1]))] + [sum(pieces.is_byte(i) for i in ids[2]) / len(ids[2])]
    n = len(ids[0])
    entropy = -sum(c / n * math.log(c / n) for c in Counter(ids[0]).values()) / math.log(min(n, 2000))
    return n, *[len(text) / len(x) for x in ids[:2]], sum(map(len, WORD.findall(text))) / len(ids[2]), *shares, entropy


@pytest.mark.parametrize("text", [text_of(1), "naïve café 日本語 \U00010330\U00010331 x", "aaaa " * 30, "Привет, мир! " * 5, text_of(2, n=3000)])
def test_measures_against_brute_force(text):
    assert np.allclose(Measures()(text), brute_measures(text))


class Watched:
    """An encoder that notes what it is given."""

    def __init__(self, encoder):
        self.encoder, self.calls = encoder, []

    def encode_to_numpy(self, text, **options):
        self.calls.append(text)
        return self.encoder.encode_to_numpy(text, **options)

    def encode_ordinary(self, text):
        self.calls.append(text)
        return self.encoder.encode_ordinary(text)


def test_chunks_of_many_texts_are_cut_once():
    measure = Measures()
    measure.bpe = watched = Watched(measure.bpe)
    texts = [text_of(k, RICH, 200) for k in range(50)]
    got = measure.many([None, *texts, ""])
    assert len(watched.calls) == 1 and len(watched.calls[0]) < sum(map(len, texts)) / 10
    assert got[0] == got[-1] == (0,) * 8 and np.allclose(got[1:-1], [brute_measures(t) for t in texts])


@pytest.mark.parametrize("block", [1, 50, 8_000_000])
def test_chunks_against_whole_texts(monkeypatch, block):
    """White space of all kinds beside words, marks, contractions and the end marker."""
    monkeypatch.setattr("latticework.llm.fertility.BLOCK", block)
    rng, parts = np.random.default_rng(2), [*"ab1'.é日 \n\t\n!", "  ", " \n ", "\r\n", "\xa0", "\u3000", "\x1c", "\x85", "\u2003", "'s", " 're", tokens.END]
    texts = ["".join(rng.choice(parts, int(n))) for n in rng.integers(0, 20, 400)] + ["\u3000", " ", "\n\n", " \u3000a", "a \u3000"]
    measure = Measures()
    for text, row in zip(texts, measure.many(texts)):
        ids, multi = tokens.ids_of(measure.bpe, text), tokens.ids_of(measure.multi, text)
        assert row[0] == len(ids)
        if text:
            assert np.allclose(row[1:3], [len(text) / len(ids), len(text) / len(multi)])
            assert np.allclose(row[4:6], [measure.bpe_bytes[ids].mean(), measure.multi_bytes[multi].mean()])


def brute_band(values, width, slack):
    """Bounds from the values of a group, by sorting them."""
    v = sorted(values)
    low, mid, high = (v[max(math.ceil(q * len(v)) - 1, 0)] for q in (0.25, 0.5, 0.75))
    return mid - max(width * (mid - low), slack(mid)), mid + max(width * (high - mid), slack(mid))


def test_each_measure_alone_rejects_and_bands_match_brute_force(spark):
    gothic = "".join(map(chr, range(0x10330, 0x1034A)))
    clean = [(k, text_of(k, RICH, 200), "en") for k in range(150)] + [(200 + k, text_of(k, "дом у реки был стар и холоден так что зимой туда никто не ходил".split(), 120), "ru") for k in range(150)]
    odd = [
        (1000, text_of(6, ["".join(x) for x in product("bcdfg", "vwxzj", "qk", "xz")], 240), "en"),  # short tokens
        (1001, " ".join(f"{w} {gothic[i % 26]}" if i % 4 == 0 else w for i, w in enumerate(text_of(7, RICH, 200).split())), "en"),  # bytes
        (1002, text_of(8, [RICH[6 * k + k % 6] for k in range(10)], 150), "en"),  # few different tokens
        (1003, text_of(9), None), (1004, text_of(9), "xx"),  # groups of one: the fixed band
    ]
    df = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in judge(df, language="lang").collect()}
    assert all(got[i].kept for i, _, _ in clean)
    assert [got[k].kept for k in (1000, 1001, 1002, 1003, 1004)] == [False, False, False, True, True]
    inside = lambda r, b, names: all(b[m][0] <= r[m] <= b[m][1] for m in names)
    slack = {m: (lambda mid: 0.20 * mid) if m in PER_TOKEN else (lambda mid: 0.10) if m in SHARES else (lambda mid: 0.15) for m in MEASURES}
    bands = {g: {m: brute_band([r[m] for r in got.values() if r.band == g and not r.base_failed], 4 if m == "entropy" else 12, slack[m]) for m in MEASURES} for g in ("en", "ru")}
    for r in got.values():
        if r.band in bands and not r.base_failed:
            b = bands[r.band]
            fits = inside(r, b, PER_TOKEN) and all(r[m] <= b[m][1] for m in SHARES) and r.entropy >= b["entropy"][0]
            assert r.kept == fits
    assert got[1000].rejected_by in PER_TOKEN and got[1002].rejected_by == "entropy"
    assert got[1001].fallback_share > bands["en"]["fallback_share"][1]


ORDINARY = {
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء",
    "hebrew": "כל בני אדם נולדו בני חורין ושווים בערכם ובזכויותיהם כולם חוננו בתבונה ובמצפון לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה",
    "indic": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है",
    "thai": "มนุษย์ ทั้งหลาย เกิดมา มีอิสระ และ เสมอภาคกัน ในเกียรติศักดิ์ และสิทธิ ต่างมี เหตุผล และมโนธรรม",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을 부여받았으며",
    "han": "人人 生而自由 在尊严 和权利上 一律平等 他们 赋有 理性 和良心 并应 以兄弟关系 的精神 相对待",
    "south": "બધા મનુષ્યો જન્મથી સ્વતંત્ર છે અને ગૌરવ તથા અધિકારોમાં સમાન છે તેમને બુદ્ધિ અને અંતઃકરણ મળેલાં છે",
    "other": "ມະນຸດ ທຸກຄົນ ເກີດມາ ມີອິດສະຫຼະ ແລະ ສະເໝີພາບ ໃນທາງ ກຽດສັກສີ ແລະ ສິດທິ ທຸກໆຄົນ ມີເຫດຜົນ ແລະ ຈິດໃຈ",
    "kana": "すべての 人間は 生まれながらにして 自由であり かつ 尊厳と 権利とに ついて 平等である",
}
RARE = {
    "arabic": (0x750, 0x77E), "hebrew": (0x591, 0x5AF), "indic": (0x972, 0x97F), "thai": (0xE4F, 0xE5B), "hangul": (0xBDC1, 0xBDF0),
    "han": (0x20000, 0x20100), "kana": (0x31F0, 0x31FF), "symbols": (0x2A00, 0x2AFF),
}


def shuffled(words, n=90):
    """A text of n words in an order without repeated triples."""
    rng = np.random.default_rng(3)
    return " ".join(rng.choice(words, n))


def test_rare_characters_fail_in_every_script(spark):
    rows = [(1, k, shuffled(v.split())) for k, v in ORDINARY.items()]
    rng = np.random.default_rng(4)
    rare = {k: ["".join(map(chr, rng.integers(a, b, 5))) for _ in range(80)] for k, (a, b) in RARE.items()}
    # among ordinary words of the script, so that its letters decide the band
    rows += [(2, k, shuffled(v + ORDINARY.get(k, "").split()[:5])) for k, v in rare.items()]
    df = spark.createDataFrame([(i, name, text) for i, (_, name, text) in enumerate(rows)], "doc_id long, name string, text string")
    got = {r.doc_id: r for r in judge(df, language=None).collect()}
    for i, (kind, name, _) in enumerate(rows):
        assert not got[i].base_failed, (name, kind)
        assert got[i].kept == (kind == 1), (name, kind, got[i])
