"""Phrase collocations against counts of every stretch of words, and summaries that must keep what is frequent."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import phrases


def brute(rows, threshold=10, share=50, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found = {}
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= threshold}
    for (lang, p), a in candidates.items():
        if any(m == lang and len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= share * a for (m, q), b in candidates.items()):
            continue
        cuts = [(1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, totals[lang], -s) for lang, own in found.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def rows():
    rng = random.Random(5)
    out = [(None, None), ("en", ""), (None, "no  lang\there. " * 12), ("und", "No Lang HERE!" * 3), ("en", "A a a a" * 40), ("xx", "ÀB ÀB\x0bàb c;" * 15)]
    out += [(rng.choice(["en", "fr", None]), " ".join(rng.choice("abcdefg") for _ in range(60)) + rng.choice(".?!\n")) for _ in range(120)]
    return out + [("en", "one hot phrase again, " * 20000)] + out[-2:]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(phrases, "BYTES", 5000)
        monkeypatch.setattr(phrases, "MASS", 7000)
        monkeypatch.setattr(phrases, "FILTER", 2**8)
    docs = spark.createDataFrame([(l, t, 1, "x", 2) for l, t in rows()], "lang string, text string, n int, phrase string, words int").repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs, top=30 if small else 2000).collect()))
    assert got == brute(rows(), top=30 if small else 2000)
    assert phrases.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("room", [1, 4])
def test_summaries_keep_what_is_frequent(room):
    rng = random.Random(2)
    stream = list(range(10_000, 1_400_000)) + [i for i in range(500) for _ in range(10)]
    rng.shuffle(stream)
    summary = phrases.Summary(room * len(stream) // 10 + 1)
    summary.capacity = min(summary.capacity, 200_000 * room)
    for i in range(0, len(stream), 100_000):
        keys, counts = np.unique(np.array(stream[i : i + 100_000], np.uint32), return_counts=True)
        summary.add(keys, counts)
    assert 0 < summary.off < 10
    kept = summary.survivors(10).tolist()
    assert set(range(500)) <= set(kept) and len(kept) <= summary.capacity


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        numbers = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert (phrases.unpacked(phrases.packed(numbers), n) == numbers).all()


def test_blocks_wait_for_their_language(monkeypatch):
    monkeypatch.setattr(phrases, "BYTES", 1000)
    texts = [(lang, b"some words %d" % i) for i in range(600) for lang in ("en", "fr", "de", "xx")]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array([x for _, x in texts])], names=["lang", "text"])
    found = list(phrases.blocks(iter([batch]), 3))
    for lang in ("en", "fr", "de", "xx"):
        own = [data for at, data, _ in found if at == lang]
        assert b"\n".join(own).split() == b"\n".join(t for at, t in texts if at == lang).split()
        assert all(len(data) > 900 for data in own[:-1])


def test_little_goes_through_shuffles(spark, monkeypatch):
    """No table of the first pass is written besides its shuffle, and the second pass sends phrases packed."""
    names = []
    monkeypatch.setattr(phrases, "spill", lambda df, name: names.append(name) or df)
    rng = random.Random(3)
    texts = [("en", " ".join(f"w{rng.randrange(300)}" for _ in range(4000))) for _ in range(20)]
    docs = spark.createDataFrame(texts, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute(texts)
    assert names == ["phrases"]
    every = type("", (), {"value": b"\xff" * (phrases.FILTER // 8)})
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array([x.encode() for _, x in texts])], names=["lang", "text"])
    rows = pa.Table.from_batches(phrases.counted(3, every, 6)(iter([batch])))
    assert 10 * (rows["phrases"].nbytes + rows["counts"].nbytes) < 6 * pa.compute.sum(rows["size"]).as_py()
