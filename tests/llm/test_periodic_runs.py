"""Periodic runs against every period tried at every place."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic_runs as runs

SF = "/root/testdata/sf0.001"


def brute(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(s <= i and j + q <= s + m and q % p == 0 for s, m, p in found):
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = sha("".join(f"{s},{m},{q}\n" for s, m, q in found))
    kept = sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), listed, kept)


def found_in(*texts):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x = np.concatenate([np.array(t, np.int64) for t in texts])
    out = [[] for _ in texts]
    for s, n, q in runs.runs_of(x, bounds).tolist():
        k = int(np.searchsorted(bounds, s, "right")) - 1
        out[k].append((s - int(bounds[k]), n, q))
    return out


@pytest.mark.parametrize("block", [16, 32, 128])
def test_transform_is_exact(block):
    rng = np.random.default_rng(block)
    rows = rng.integers(0, runs.PRIME, (3, block)).astype(np.uint64)
    assert (runs.transform(runs.transform(rows), inverse=True) == rows).all()
    x = np.tile(rng.integers(0, 5, block + 3), 9)
    seeds = {(i, d) for i, d in zip(*(a.tolist() for a in runs.again(x, block, runs.gaps(x))), strict=True) if i + d + block <= len(x)}
    true = {(i, d) for i in range(0, len(x), block) for d in range(block, 2 * block) if i + d + block <= len(x) and (x[i : i + block] == x[i + d : i + d + block]).all()}
    assert true <= seeds and len(seeds - true) <= 1


part = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 9), st.integers(0, 40))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(part, max_size=4), min_size=1, max_size=4))
def test_every_run(texts):
    made = [[w for period, times, more in text for w in period * times + period[:more]] for text in texts]
    assert found_in(*made) == [brute(t) for t in made]


def test_long_periods_and_many_multiples():
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 10**6, 777).tolist()
    text = [5] * 30000 + [6] + [5] * 20000 + unit * 5 + unit[:100] + [1, 2] * 1000
    assert found_in(text) == [[(0, 30000, 1), (30001, 20000, 1), (50001, 777 * 5 + 100, 777), (50001 + 777 * 5 + 100, 2000, 2)]]


def test_false_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(runs.Prefixes, "same", lambda self, i, d, n: np.ones(len(i), bool))
    text = [1, 2, 3] * 8 + list(range(10, 40)) + [7] * 9
    assert set(found_in(text)[0]) == set(brute(text))


def test_rows_of_every_kind(spark):
    rows = [(i, " ".join(["a b c"] * i) + " x\x0bz") for i in range(40)] + [(None, "w " * 50), (7, None), (8, ""), (8, ""), (9, "lone"), (10, "x\ty\n" * 9000 + "end"), (11, " \t")]
    rows += [(100 + i, " ".join(str(k * k % 97) for k in range(5 * i))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, start int, period string")
    got = sorted(map(tuple, runs.periodic_runs(docs, plant=True).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows), key=repr)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in docs if len(r["text"] or "") < 12000}
    got = {r["doc_id"]: tuple(r) for r in runs.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in short.items():
        assert got[doc_id] == expected(doc_id, text)
