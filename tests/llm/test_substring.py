"""Substring dedup where the passages are hard to see: split sources, periodic runs, many edits."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_dedup import SF, documents, frame, words
from tidemark.llm import substring_dedup


def fresh(name, n):
    return [f"{name}{i}" for i in range(n)]


def covered(spark, texts):
    """Words of each document that lie in a passage."""
    out = {i: set() for i, _ in texts}
    for r in substring_dedup.repeats(frame(spark, [(i, " ".join(w)) for i, w in texts])).collect():
        assert r["src_doc_id"] < r["doc_id"] and r["identity"] >= 0.8
        out[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return out


def test_passage_whose_halves_occur_before(spark):
    """The halves are in earlier documents, or at an earlier place of the source; every such passage is still found."""
    texts, wanted = [], []
    for x in range(12):
        left, right, i = fresh(f"l{x}_", 30), fresh(f"r{x}_", 30), 100 * x
        texts += [(i + 1, fresh(f"a{x}_", 20) + left + fresh(f"b{x}_", 20)), (i + 2, fresh(f"c{x}_", 20) + right)]
        texts += [(i + j, fresh(f"d{i + j}_", 25) + left + right + fresh(f"e{i + j}_", 25)) for j in (10, 11)]
        wanted.append(i + 11)
    for x in range(12):
        left, right, i = fresh(f"m{x}_", 30), fresh(f"s{x}_", 30), 5000 + 100 * x
        texts.append((i, left + fresh(f"f{x}_", 30) + right + fresh(f"g{x}_", 30) + left + right))
        texts.append((i + 1, fresh(f"h{x}_", 25) + left + right + fresh(f"k{x}_", 25)))
        wanted.append(i + 1)
    got = covered(spark, texts)
    assert [i for i in wanted if not set(range(25, 85)) <= got[i]] == []


def test_random_passages_of_fifty_words(spark):
    """Texts dealt from common lines, so that first occurrences are scattered: of each run of 50 words that an earlier one holds 40 words in a row are found."""
    rnd = random.Random(5)
    lines = [fresh(f"x{x}_", rnd.randint(6, 38)) for x in range(60)]
    texts = [(i, sum((rnd.choice(lines) for _ in range(12)), [])) for i in range(150)]
    got, first, missed = covered(spark, texts), {}, 0
    for i, w in texts:
        runs = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        for j, run in enumerate(runs):
            if run in first:
                missed += not any(set(range(j + s, j + s + 40)) <= got[i] for s in range(11))
        for run in runs:
            first.setdefault(run, i)
    assert missed == 0


def periodic_texts():
    """Runs of periods 1 to 20 in three documents, the first one short or long, each starting at another word of the period."""
    texts, wanted = [], []
    for d in range(1, 21):
        line = fresh(f"p{d}_", d)
        for y, (first, n) in enumerate([(600, 600), (75, 600), (600, 75)]):
            i, run = 10000 * d + 100 * y, [w + f"y{y}" for w in line] * 700
            texts.append((i, fresh(f"a{i}_", 30) + run[:first] + fresh(f"b{i}_", 30)))
            texts.append((i + 1, fresh(f"c{i}_", 20) + run[d // 2 : d // 2 + n] + fresh(f"d{i}_", 20)))
            wanted.append((i + 1, n))
    return texts, wanted


def test_periodic_runs(spark):
    texts, wanted = periodic_texts()
    got = covered(spark, texts)
    ends = {i: 0 if i < 130000 else 10 for i, _ in wanted}  # longer periods than 12 may lose words at the ends
    assert [i for i, n in wanted if not set(range(20 + ends[i], 20 + n - ends[i])) <= got[i]] == []


def test_tiles_cover_a_run():
    long = 40
    for d in range(1, 13):
        for n in (long + d - 1, 100, 601):
            for m in (long + d - 1, 77, 900):
                for turn, src_turn in ((0, d - 1), (d - 1, 0), (d // 2, d // 3)):
                    found = list(substring_dedup.tiles(5 << 32 | turn << 28 | n, 9 << 32 | src_turn << 28 | m, d, long))
                    assert set().union(*(range(i, i + size) for i, _, size in found)) == set(range(5, 5 + n))
                    for i, j, size in found:
                        assert size >= long and 9 <= j and j + size <= 9 + m and (i - 5 - turn - (j - 9) + src_turn) % d == 0


def test_every_repeat_of_documents(spark):
    """Brute force over the documents, texts of one repeated word too: of each run of 50 words that an earlier document holds 40 words in a row are found."""
    texts = [(i, words(t)) for i, t in documents()]
    cover = {i: set() for i, _ in texts}
    for r in substring_dedup.op2_substring_dedup(spark, SF).collect():
        cover[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    first, missed = {}, 0
    for i, w in texts:
        runs = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        for j, run in enumerate(runs):
            if run in first:
                missed += not any(set(range(j + s, j + s + 40)) <= cover[i] for s in range(11))
        for run in runs:
            first.setdefault(run, i)
    assert missed == 0


def test_passages_with_many_edits(spark):
    """Copies of 80 words with one word in 7, 8, 10 or 12 changed (identity 0.86 to 0.92), 50 each: nearly all are found."""
    rnd = random.Random(7)
    texts, kinds = [], {}
    for every in (7, 8, 10, 12):
        for x in range(50):
            i, base = 10000 * every + 10 * x, fresh(f"p{every}_{x}_", 80)
            copy = [f"e{every}_{x}_{j}" if j % every == x % every else w for j, w in enumerate(base)]
            texts.append((i, fresh(f"a{i}_", rnd.randint(5, 90)) + base + fresh(f"b{i}_", 40)))
            texts.append((i + 1, fresh(f"c{i}_", rnd.randint(5, 90)) + copy + fresh(f"d{i}_", 40)))
            kinds[i + 1] = every
    got = covered(spark, texts)
    found = {every: sum(len(got[i]) >= 40 for i, e in kinds.items() if e == every) for every in (7, 8, 10, 12)}
    assert found[7] >= 45 and found[8] >= 48 and found[10] == found[12] == 50, found


def least_of_each_window(s, window):
    """Places of the least of every ``window`` values in a row, the first of equal ones; of fewer values the least one."""
    tops = range(max(len(s) - window, 0) + 1) if len(s) else []
    return {min(range(i, min(i + window, len(s))), key=lambda j: (s[j], j)) for i in tops}


def test_minimizers_of_many_texts_at_once():
    """As brute force has it text by text: empty and short texts, texts as long as a window, ties inside and across texts."""
    rnd = np.random.default_rng(3)
    for window in (1, 2, 11, 12):
        for _ in range(60):
            counts = rnd.choice([0, 1, 2, 10, 11, 12, 13, 30, 90], int(rnd.integers(1, 9)))
            gaps = rnd.integers(0, 4, len(counts))
            firsts = np.cumsum(counts + gaps) - counts - gaps
            s = rnd.integers(0, rnd.choice([2, 9, 10**12]), max(int((firsts + counts).max()), 0)).astype(np.uint64)
            wanted = {int(a) + x for a, n in zip(firsts, counts, strict=True) for x in least_of_each_window(s[a : a + n].tolist(), window)}
            got = substring_dedup.minimizers_of(s, firsts, counts, window).tolist()
            assert sorted(got) == sorted(wanted)


def test_seeds_take_no_step_for_each_text(monkeypatch):
    """Texts without ties are searched all at once."""
    steps = []
    monkeypatch.setattr(substring_dedup, "minimizers", lambda s, window, f=substring_dedup.minimizers: steps.append(len(s)) or f(s, window))
    words = np.random.default_rng(4).integers(1, 2**63, 20000).astype(np.uint64)
    hashes, text, places = substring_dedup.seeds(words, np.arange(0, 20001, 100), 40, [])
    assert not steps
    assert set(text.tolist()) == set(range(200)) and (places >> 32).max() < 100 and len(hashes) > 200 * 15


def test_ends_of_an_alignment_take_few_steps(monkeypatch):
    """Where no diagonal nearby has three equal words in a row, none is followed; what ``extend`` gives stays as it was."""
    steps = []
    monkeypatch.setattr(substring_dedup, "reach", lambda e, f=substring_dedup.reach: steps.append(1) or f(e))
    a, b = np.arange(130, dtype=np.uint32), np.arange(1000, 1130, dtype=np.uint32)
    assert substring_dedup.extend(a, b) == (0, 0, 0, 0) and len(steps) == 1
    b = np.concatenate([a[:20], b[:2], a[20:60], b[2:]])  # two words more
    assert substring_dedup.extend(a, b) == (60, 62, 60, 62)
    assert len(steps) <= 8


def test_plain_groups_are_chained_at_once():
    """Groups that increase give what chain by chain gives, long seeds, gaps and repeated points included; the others are left."""
    long, rnd = 40, np.random.default_rng(6)
    rows = []
    for src in range(300):
        p = np.cumsum(rnd.integers(1, 30, int(rnd.integers(1, 9))))
        q = p + np.cumsum(rnd.integers(0, 2 if src % 3 else 30, len(p))) if src % 5 else rnd.permutation(p)
        kind = rnd.choice([0, 15], len(p), p=[0.8, 0.2]) if src % 7 else np.full(len(p), 3)
        rows += [(9, src, int(x) << 32, int(y) << 32, int(k)) for x, y, k in zip(p, q, kind, strict=True)]
    columns = [np.array(c) for c in zip(*sorted(rows), strict=True)]
    plain, rest = substring_dedup.in_line(columns, long)
    got, left = {}, set(rest[1].tolist())
    for src, p, q in zip(*(c.to_pylist() for c in plain[1:]), strict=True):
        got.setdefault(src, []).append((p, q))
    assert len(got) > 100 and len(left) > 80 and not left & set(got) and left | set(got) == set(range(300))
    for src, found in got.items():
        mine = columns[1] == src
        p, q = substring_dedup.points(columns[2][mine] >> 32, columns[3][mine] >> 32, columns[4][mine].astype(np.uint64), long)
        assert found == [(x.tolist(), y.tolist()) for x, y in substring_dedup.pieces(p, q, substring_dedup.K)]


def test_ends_of_slices(spark):
    """First occurrences and largest ids, reduced slice by slice, are those of all seeds, repeated rows and ids out of order included."""
    line = fresh("x", 80)
    docs = frame(spark, [(i, " ".join([*fresh(f"a{i % 4}_", 20), *line, *fresh("b", 30), *line])) for i in (7, 3, 9, 3, 5)])
    first = [F.min(F.struct("doc_id", "pos")).alias("first")]
    wanted = substring_dedup.seeds_of(docs, 40).groupBy("seed").agg(*first, F.max("doc_id").alias("last"))
    got = substring_dedup.ends_of(docs, 40).groupBy("seed").agg(*first, F.max("last").alias("last"))
    assert sorted(got.collect()) == sorted(wanted.collect())


def test_passage_far_beyond_its_last_seed(spark):
    """After 20 equal words one word in five differs for 380 more: no seed, and the first look goes 128 words beyond; three long texts."""
    texts = []
    for x in range(3):
        base = fresh(f"z{x}_", 400)
        copy = base[:20] + [f"y{x}_{j}" if j % 5 == 0 else w for j, w in enumerate(base[20:])]
        texts += [(10 * x, fresh(f"n{x}_", 300) + base + fresh(f"u{x}_", 300)), (10 * x + 1, fresh(f"o{x}_", 250) + copy + fresh(f"v{x}_", 250))]
    got = covered(spark, texts)
    assert all(set(range(250, 645)) <= got[10 * x + 1] <= set(range(240, 655)) for x in range(3))


def test_short_piece_inside_a_longer_passage_of_another_source(spark):
    """Document 3 holds 300 words of document 1; document 2 has 60 of these with one in eight changed: its link to 3 is no part of 1's."""
    base = fresh("b", 300)
    near = [f"e{j}" if j % 8 == 5 else w for j, w in enumerate(base[100:160])]
    mixed = [w if j % 20 != 7 else f"s{j}" for j, w in enumerate(base)]
    texts = [(1, mixed), (2, fresh("q", 30) + near + fresh("r", 30)), (3, fresh("t", 20) + base + fresh("w", 20))]
    pairs = {(r["doc_id"], r["src_doc_id"]) for r in substring_dedup.repeats(frame(spark, [(i, " ".join(w)) for i, w in texts])).collect()}
    assert {(2, 1), (3, 1), (3, 2)} <= pairs
