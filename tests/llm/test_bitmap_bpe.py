import subprocess
import sys
from pathlib import Path

import pytest
import public_tokenizers as public
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bitmap_bpe as b


RANKS, PATTERN = b.production_ranks()
ENC = b.Encoder(RANKS, PATTERN)
LIB = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
PAIRS = b.Pairs(RANKS)


def same(text):
    ids = LIB.encode_ordinary(text)
    assert ENC.encode(text) == ids
    assert ENC.decode(ids) == text.encode()
    want = [(len(x), " ".join(map(str, x)).encode(), t.encode()) for t in (text, "", text + text) for x in (LIB.encode_ordinary(t),)]
    assert b.encode_texts(ENC, PAIRS, pa.array([text, "", text + text], pa.large_string())) == want


@pytest.mark.parametrize("text", ["", " ", "  ", "a", "a  b", "a \n b", "\n\n x", "it's we'LL 12  34", "x  y  z", "\x1c a\x1f b", "tail ", "tail  \n", "ééé 漢字 🙂🙂", "<|endoftext|> a", "\u0085 q"])
def test_cases(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b\x1c  abTe'sl1,é漢", max_size=40))
def test_white_space(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
PARTS = [*CONTRACTIONS, "'", "season", "a", "Ab", "é", "漢", "ß", "12", "٣", "!", "?!", "…", "_", " ", "  ", "\t", "\n", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "🙂"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9).map("".join))
def test_all_alternatives_of_the_pattern(text):
    same(text)


def test_contractions_and_a_letter():
    texts = [before + c + letter + rest for c in CONTRACTIONS for letter in "abcdefghijklmnopqrstuvwxyzA" for rest in ("", "eason x") for before in ("", " ", "\n", "\t", "  ", "a ", "x\n")]
    got = b.encode_texts(ENC, PAIRS, pa.array(texts, pa.large_string()))
    assert [x[1] for x in got] == [" ".join(map(str, LIB.encode_ordinary(t))).encode() for t in texts]
    for one in texts[::17]:
        same(one)


def test_many_generated_texts():
    import random

    rng = random.Random(11)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 8))) for _ in range(100_000)]
    for at in range(0, len(texts), 5_000):
        some = texts[at : at + 5_000]
        got = b.encode_texts(ENC, PAIRS, pa.array(some, pa.large_string()))
        assert [x[1] for x in got] == [" ".join(map(str, LIB.encode_ordinary(t))).encode() for t in some]


def test_long_pretoken():
    same("ab" * 20_000 + "a" * 50_000)


def test_queue_order():
    q = b.RankQueue(70_000)
    for r, p in [(69_999, 1), (3, 9), (3, 2), (64, 0), (3, 5)]:
        q.push(r, p)
    assert [q.pop() for _ in range(6)] == [(3, 2), (3, 5), (3, 9), (64, 0), (69_999, 1), None]
    assert not any(any(x) for x in q.levels)


def test_side_by_side():
    import random

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abenrstéth,'1", k=rng.randint(1, 30))) for _ in range(300)) for _ in range(20)]
    got = b.encode_texts(ENC, PAIRS, pa.array(texts, pa.large_string()))
    assert [x[1] for x in got] == [" ".join(map(str, LIB.encode_ordinary(t))).encode() for t in texts]


def test_frame(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (None, "", "z")], "doc_id bigint, text string, n_tokens string")
    rows = sorted(b.encode_documents(df, RANKS, PATTERN).collect(), key=str)
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(1, 2), (1, 2), (2, 0), (None, 0)]
    assert b.encode_documents(df.limit(0), RANKS, PATTERN).count() == 0


PEAK = """
import random, sys
import pyarrow as pa
import public_tokenizers as public
from graphloom.llm import bitmap_bpe as b

ranks, pattern = b.production_ranks()
encoder, pairs, rng = b.Encoder(ranks, pattern), b.Pairs(ranks), random.Random(3)
words = ["".join(rng.choices("abdehinorstu", k=rng.randint(6, 12))) for _ in range(200_000)]
texts = pa.array([" ".join(rng.choices(words, k=600)) for _ in range(1000)], pa.large_string())
peak = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmHWM")).split()[1]) >> 10
b.encode_texts(encoder, pairs, texts.slice(0, 1))
open("/proc/self/clear_refs", "w").write("5")
before = peak()
b.encode_texts(encoder, pairs, texts)
print(peak() - before)
"""


def test_memory_of_a_chunk():
    """Two of these and a full JVM heap share an executor's 3000 MB."""
    got = subprocess.run([sys.executable, "-c", PEAK], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(got.stdout) < 190


def test_blocks_of_a_chunk(monkeypatch):
    import random

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abenrstéth,'1", k=rng.randint(1, 80))) for _ in range(n)) for n in (0, 1, 40, 0, 9)]
    monkeypatch.setattr(b, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(b, "PIECES_AT_ONCE", 3)
    monkeypatch.setattr(b, "SIDE_BY_SIDE", 10)
    got = b.encode_texts(ENC, PAIRS, pa.array(texts, pa.large_string()))
    assert [x[1:] for x in got] == [(" ".join(map(str, LIB.encode_ordinary(t))).encode(), t.encode()) for t in texts]
