import itertools
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash

from graphloom.llm import anchor_simhash as a
from graphloom.llm.components import components, forest


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps, ids, t=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= t:
            parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint():
    rng = random.Random(3)
    texts = ["", " \n", "One", "a B", "a b c", "É é x", "w " * 900] + [" ".join(rng.choices(["aa", "bb", "Cc", "d\tx", "éÉ"], k=rng.randint(1, 700))) for _ in range(40)]
    got = a.fingerprints(pa.array(texts, pa.large_string()))
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


def test_code_is_perfect_and_covers():
    anchors = a.Anchors(2)
    assert (np.diff(anchors.tables[0][1]) == 1).all()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for flips in ([], [0], [5, 22], [22, 23], [40, 45], [63, 1], [50, 60]):
        y = x.copy()
        for f in flips:
            y ^= np.uint64(1 << f)
        ax, ix, home = anchors.replicate(x)
        ay, iy, _ = anchors.replicate(y)
        at_home = dict(zip(ix[home].tolist(), ax[home].tolist()))
        assert len(at_home) == len(x)
        have = set(zip(iy.tolist(), ay.tolist()))
        assert all((i, c) in have for i, c in at_home.items())
        assert len(have) == len(iy)


def test_links_both_ways(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(i)) for i in rng.integers(0, 63, 6)], base ^ np.uint64(0b1111)]))
    anchor, row, home = a.Anchors(2).replicate(fp)
    want = plain_classes(fp.tolist(), fp.tolist())
    for limit in (20_000, 2):
        monkeypatch.setattr(a, "FLIP_FROM", limit)
        node, root = a.links(anchor, fp[row], home, 2)
        label = {int(x): int(x) for x in fp} | dict(zip(node.tolist(), root.tolist()))
        assert [label[int(x)] for x in fp] == want


def test_forest_and_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(40)]
    nodes = sorted({x for e in edges for x in e})
    label = {x: x for x in nodes}
    for _ in nodes:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    node, root = forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert {x: x for x in nodes} | dict(zip(node.tolist(), root.tolist())) == label
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {x: x for x in nodes} | got == label


def test_against_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choices("abcdefghij", k=rng.randint(3, 400))) for _ in range(25)]
    texts = base + [t + " z" for t in base] + base[:5] + [None, "", "  "]
    rows = [(i * 3 % 1000, t, "x") for i, t in enumerate(texts)]
    got = a.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    want = plain_classes(fps, [r[0] for r in rows])
    assert sorted(map(tuple, got)) == sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, want))
    assert a.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


PEAK = """
import random
import pyarrow as pa
from graphloom.llm import anchor_simhash as a

rng = random.Random(3)
words = ["".join(rng.choices("abdehinorstu", k=rng.randint(3, 9))) for _ in range(100_000)]
texts = pa.array([" ".join(rng.choices(words, k=1200)) for _ in range(1000)], pa.large_string())
peak = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmHWM")).split()[1]) >> 10
a.fingerprints(texts.slice(0, 1))
open("/proc/self/clear_refs", "w").write("5")
before = peak()
a.fingerprints(texts)
print(peak() - before)
"""


def test_memory_of_a_chunk():
    """The pipeline runs two of these beside a JVM heap that earlier stages have filled."""
    got = subprocess.run([sys.executable, "-c", PEAK], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(got.stdout) < 175


def test_blocks_of_a_chunk(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "Bc", "é", "def"], k=n)) for n in (0, 1, 2, 3, 4, 30, 0, 7)]
    monkeypatch.setattr(a, "SHINGLES_AT_ONCE", 5)
    assert a.fingerprints(pa.array(texts, pa.large_string())).tolist() == [plain_fingerprint(t) for t in texts]
