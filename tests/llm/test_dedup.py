"""Exact, near and substring dedup against brute force, planted cases and edge cases."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, near_dedup, substring_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, spans int"


def frame(spark, texts):
    """Rows (doc_id, text) with further columns, of which some have names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1) for i, t in texts], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()


EDGES = [(1, None), (2, ""), (3, "a b c"), (4, "a b c"), (4, "a b c"), (None, "a b c"), (5, "x" * 9000), (6, "x" * 9000), (7, "one. " * 3000), (8, " \n "), (9, "word"), (10, "A B C")]


def exact_by_hand(texts):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    out = []
    for i, t in texts:
        keep = max((x for x in groups[t or ""] if x is not None), default=None)
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("texts", [EDGES, []], ids=["edges", "empty"])
def test_exact_dedup(spark, texts):
    assert rows(exact_dedup.exact_dedup(frame(spark, texts)), *COLUMNS) == exact_by_hand(texts)


def test_exact_dedup_with_an_ambiguous_digest(spark):
    """A digest of 8 bits makes chunks collide; the result is still exact."""
    texts = [(i, f"text {i // 2}") for i in range(600)]
    weak = lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2))
    assert not exact_dedup.ambiguous_identifiers(frame(spark, texts), weak).isEmpty()
    assert rows(exact_dedup.exact_dedup(frame(spark, texts), weak), *COLUMNS) == exact_by_hand(texts)


def test_chunks_are_whole_and_bounded(spark):
    texts = [t for _, t in documents()] + ["é" * 10000, "a.\n" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", exact_dedup.chunks_of(F.col("text")).alias("c"))
    bad = df.where((F.array_join("c", "") != F.col("text")) | F.exists("c", lambda c: F.length(c) > 4096)).count()
    assert bad == 0


def test_drop_copies_keeps_columns(spark):
    out = exact_dedup.drop_copies(frame(spark, EDGES[2:5]))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert {r["doc_id"] for r in out.collect()} == {4}


TWICE = [(5, "unique text here"), (5, "shared words of a text"), (9, "shared words of a text"), (3, "other words"), (3, "other words"), (None, "other words"), (None, "alone"), (None, "alone"), (7, None), (7, "")]


def test_drop_copies_goes_by_id_and_text(spark):
    """One id with two texts, repeated rows, and copies without an id."""
    out = rows(exact_dedup.drop_copies(frame(spark, TWICE)), "doc_id", "text")
    empty = [r for r in out if r[0] == 7]
    assert [r for r in out if r[0] != 7] == sorted([(5, "unique text here"), (9, "shared words of a text"), (3, "other words"), (None, "alone")], key=repr)
    assert len(empty) == 1 and not empty[0][1]


def test_drop_near_copies_goes_by_id_and_text(spark):
    """Id 7 has a text of its own and one that id 3 has too; repeated rows of 8 are one document."""
    own, shared, near = passage("o", 60), passage("s", 60), passage("s", 59) + " more"
    texts = [(7, own), (7, near), (3, shared), (3, passage("t", 30)), (8, passage("u", 30)), (8, passage("u", 30)), (8, passage("v", 30)), (None, shared), (1, None), (2, " "), (4, "one"), (6, "one")]
    docs = frame(spark, texts)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_classes(docs).collect()}
    assert {(7, 56, 7, True), (7, 56, 3, False), (3, 56, 3, True), (3, 26, 3, True), (8, 26, 8, True), (6, 1, 4, False)} <= found
    out = rows(near_dedup.drop_near_copies(docs), "doc_id", "text", "key")
    assert out == sorted([(i, t, "k") for i, t in {*texts} - {(7, near), (6, "one")}], key=repr)


def test_words_of_a_pattern_do_not_collide(spark):
    """A text of one word, and its complement: polynomial hashes modulo a power of two take them for equal."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    got = near_dedup.near_classes(frame(spark, [(1, one), (2, other), (3, one.upper()), (4, one[:-1])]), k=2)
    assert rows(got, "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_word_hashes_depend_on_the_bytes_only():
    import numpy as np
    import pyarrow as pa

    from tidemark.llm.words import bytes_of, word_hashes

    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abAB éß\n\t") * rnd.choice([1, 1, 1, 9, 40]) for _ in range(rnd.randrange(60))) for _ in range(300)]
    hashes, firsts, starts, ends = word_hashes(*bytes_of(pa.array(["lead", *texts, None])))
    by_word = {}
    for i, t in enumerate(["lead", *texts, None]):
        own = words(t)
        assert len(own) == firsts[i + 1] - firsts[i]
        for w, h in zip(own, hashes[firsts[i] : firsts[i + 1]].tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word) and np.all(starts < ends)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def near_by_hand(texts, k, percent=80):
    sets = []
    for _, t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for x, y in itertools.combinations(range(len(texts)), 2):
        a, b = sets[x], sets[y]
        if a and b and texts[x][0] is not None and texts[y][0] is not None and 100 * len(a & b) >= percent * len(a | b):
            top[root(x)] = root(y)
    groups = collections.defaultdict(list)
    for x in range(len(texts)):
        groups[root(x)].append(texts[x][0])
    out = []
    for x, (i, _) in enumerate(texts):
        c = i if i is None or not sets[x] else min(groups[root(x)])
        out.append((i, len(sets[x]), c, i == c))
    return sorted(out, key=repr)


def variants():
    """A base and many copies of it that differ from each other more than from the base, a chain, and singles."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    out = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for j in rnd.sample(range(200), 9):
            w[j] = f"e{i}x{j}"
        out.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(150)]
    for i in range(12):
        out.append((100 + i, " ".join(chain[i * 5 :] + [f"n{x}" for x in range(i * 5)])))
    return out + [(200 + i, " ".join(f"s{i}y{j}" for j in range(30))) for i in range(20)]


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("texts", [EDGES, [], variants()], ids=["edges", "empty", "variants"])
def test_near_classes(spark, texts, k):
    assert rows(near_dedup.near_classes(frame(spark, texts), k=k), "doc_id", "n_shingles", "component_id", "kept") == near_by_hand(texts, k)


def test_near_classes_of_documents(spark):
    got = near_dedup.op10_minhash_near_dedup(spark, SF)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == near_by_hand(documents(), 2)


def test_block_step_finds_hidden_links(spark):
    """Two blocks of a bucket, a link between them, and nothing but links comes out."""
    sets = spark.createDataFrame([(i, list(range(i // 2 * 100, i // 2 * 100 + 20))) for i in range(8)], "id long, shingles array<long>")
    rest = spark.createDataFrame([(1, i, i) for i in range(8)], "bucket long, id long, component long")
    assert rows(near_dedup.block_links(rest, sets, 80), "u", "v") == [(0, 1), (2, 3), (4, 5), (6, 7)]


def passage(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_repeats_and_cut(spark):
    fuzzy = passage("p", 70).split()
    fuzzy[20], fuzzy[41] = "changed", "changed2"
    del fuzzy[55]
    texts = [
        (1, passage("a", 40) + "\n" + passage("p", 70) + "\n" + passage("b", 10)),
        (2, passage("c", 30) + " " + passage("P", 70) + " " + passage("d", 30)),
        (3, passage("e", 20) + " " + " ".join(fuzzy) + " " + passage("f", 20)),
        (4, passage("g", 120) + " " + passage("p", 25)),  # too short a passage
        (5, passage("c", 30) + " " + passage("p", 70) + " " + passage("d", 30)),  # all of document 2
        (6, None),
        (None, passage("p", 70)),
        (7, ""),
        (8, "x y"),
    ]
    docs = frame(spark, texts)
    found = {(r["doc_id"], r["src_doc_id"]): r for r in substring_dedup.repeats(docs).collect()}
    assert {(2, 1), (3, 1), (5, 1)} <= set(found) <= {(2, 1), (3, 1), (5, 1), (5, 2)}
    assert (found[2, 1]["start_word"], found[2, 1]["end_word"], found[2, 1]["src_start_word"]) == (30, 100, 40)
    assert (found[3, 1]["start_word"], found[3, 1]["end_word"]) == (20, 89) and found[3, 1]["identity"] >= 0.9
    left = {r["doc_id"]: r for r in substring_dedup.cut_repeats(docs).collect()}
    assert left[1]["text"] == texts[0][1] and left[4]["text"] == texts[3][1] and left[None]["text"] == passage("p", 70)
    assert left[2]["text"] == passage("c", 30) + " " + passage("d", 30) and left[2]["n_chars"] == len(left[2]["text"])
    assert left[6]["text"] is None and left[7]["text"] == "" and left[3]["lang"] == "en"


def test_repeats_of_nothing(spark):
    assert substring_dedup.repeats(frame(spark, [])).count() == 0
    assert substring_dedup.cut_repeats(frame(spark, [])).count() == 0


def test_every_repeat_of_fifty_words_is_covered(spark):
    """Brute force over the documents: each exact run of 50 words that an earlier document holds lies in a passage, but for texts of one repeated word."""
    cover = collections.defaultdict(set)
    for r in substring_dedup.op2_substring_dedup(spark, SF).collect():
        cover[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    first, missed = {}, 0
    for i, t in documents():
        w = words(t)
        runs = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        for j, run in enumerate(runs):
            if run in first and len(set(run)) > 25:
                missed += not set(range(j + 2, j + 48)) <= cover[i]
        for run in runs:
            first.setdefault(run, i)
    assert missed == 0


def test_chains_take_the_best_of_crossing_matches():
    import numpy as np

    p = np.array([0, 10, 20, 30, 40, 40])
    q = np.array([100, 110, 5, 120, 130, 7])
    best = substring_dedup.chains(p, q)[0]
    assert q[best].tolist() == [100, 110, 120, 130]
