import random

import pytest

from lodeline.llm import encode as E
from lodeline.llm.bytebpe import CHUNK, ByteBPE

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    bpe = ByteBPE(E.default_vocabulary())
    t = tokenizers.Tokenizer.from_file(E.default_vocabulary().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return bpe, lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def ours(bpe, texts):
    flat, n = bpe.encode(texts)
    out, at = [], 0
    for k in n:
        out.append(flat[at : at + k].tolist())
        at += k
    return out


def test_agrees_with_the_library(pair):
    bpe, ref = pair
    rnd = random.Random(3)
    alphabet = "  \n\t\r'''strevmldSTRé19½,.!　 ab-日�😀̀"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(20000)]
    texts += ["<|endoftext|>", "", " ", "\n\n x", "it's'll 'd", "''s", " 's", "\n's", "a" * 3000, "ab " * 5000, "'" * 99, " " * 4000 + "x"]
    assert ours(bpe, texts) == ref(texts)


def test_round_trip_and_offsets(pair):
    bpe, _ = pair
    for text in ("naïve café — 10½", "", "😀" * 50, "x\r\n\r\ny"):
        ids = ours(bpe, [text])[0]
        assert bpe.decode(ids) == text
        assert bpe.offsets(ids) == [len(b"".join(bpe.bytes_of[i] for i in ids[:n])) for n in range(len(ids))]


def test_collisions_don_t_change_ids(pair, monkeypatch):
    import numpy as np

    bpe, ref = pair
    fresh = ByteBPE(E.default_vocabulary())
    fresh._powers(4)
    monkeypatch.setattr(fresh, "_powers", lambda n: None)
    fresh._pow, fresh._inv = np.ones(100, np.uint64), np.ones(100, np.uint64)  # a sum of symbols: anagrams collide
    assert ours(fresh, ["stop spot pots tops", "abc cba"]) == ref(["stop spot pots tops", "abc cba"])


def test_long_text_is_whole(pair):
    bpe, ref = pair
    text = "word " * (CHUNK // 4)
    assert ours(bpe, ["a", text, None, "b"]) == ref(["a", text, "", "b"])


def test_frames(spark):
    d = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello world", "x"), (None, "a", "q")], "doc_id bigint, text string, ids string").withColumnRenamed("ids", "__text2")
    got = E.encode(d).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == [(0, [64]), (1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert {r.doc_id: r.n_tokens for r in E.count_tokens(d).collect()} == {1: 2, 2: 0, 3: 0, None: 1}
    back = E.decode(E.encode(d)).where("doc_id = 1").first()
    assert back.text == "Hello world"
    off = E.encode(d, with_offsets=True).where("doc_id = 1").first()
    assert off.offsets == [0, 5] and E.encode(d.limit(0)).count() == 0
