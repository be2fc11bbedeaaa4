"""Language, quality, HTML and media: held-out accuracy, golden pages, exact round trips, edge cases."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import common, files, html_text, language_id, media, quality_rules

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "123 456 !!"), (4, "the same"), (4, "the same"), (None, "the of and"), (5, "x" * 300000)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, 3) for i, t in texts], "doc_id long, text string, lang string, score int")


def test_language_held_out(spark):
    got = {r["doc_id"]: r for r in language_id.op3_language_id(spark, SF).collect()}
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    assert set(got) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, sample=400)
    assert (model.weights == 0).mean() > 0.5  # the elastic net keeps it sparse
    got = {r["doc_id"]: r for r in language_id.predict(frame(spark, EDGES), model).collect()}
    assert {got[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and got[4]["lang_pred"] == "en" and got[None]["held_out"] is False
    assert {r["lang_pred"] for r in language_id.predict(frame(spark, EDGES), language_id.train(frame(spark, EDGES))).collect()} == {"und"}
    assert language_id.predict(frame(spark, []), model).count() == 0
    assert language_id.keep_languages(docs).count() > 0.99 * docs.count()


def test_long_texts_are_counted_whole():
    text = "".join(chr(97 + i % 26) for i in range(600_000))
    assert language_id.counts_of(text)[1].sum() == 600_000 + 599_999 + 599_998


def test_quality_held_out_and_sparse(spark):
    got = {r["doc_id"]: r for r in quality_rules.op7_quality_rules(spark, SF).collect()}
    assert len(got) == duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    rows = [(q, got[i]) for i, q in duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall()]
    held = [(q, r["score"]) for q, r in rows if r["held_out"]]
    assert np.mean([(s >= 0.5) == q for q, s in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = quality_rules.score_quality(frame(spark, EDGES), labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    none = quality_rules.score_quality(frame(spark, EDGES), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_rules.score_quality(frame(spark, []), labels).count() == 0


def test_rules_compile_to_what_they_match(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, len(quality_rules.NAMES)))
    y = ((x[:, 6] > 0.3) & (x[:, 3] < 0.7)).astype(float)
    model = quality_rules.fit(x, y)
    df = spark.createDataFrame(x.tolist(), quality_rules.NAMES)
    score = np.array([r[0] for r in df.select(model.score()).collect()])
    margin = model.bias + sum(w * r.matches(x) for r, w in model.rules)
    assert np.allclose(score, 1 / (1 + np.exp(-margin))) and ((score >= 0.5) == y).mean() > 0.97
    assert 0 < len(model.rules) < 150


PAGES = [
    (None, ""),
    ("", ""),
    ("plain words", "plain words"),
    (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy now please</div>"
        "<article><h1>Head &amp; line</h1><p>First  paragraph\n with <b>bold</b> text, long enough to matter.<br>After the break.</p><p>Short.</p>"
        "<aside>Related</aside><form>Name <input></form><script>var a='<p>';</script></article>"
        "<section id='comments'><p>A reader says a lot of things here, at length.</p></section><footer>&copy; x</footer></body></html>",
        "Head & line\nFirst paragraph with bold text, long enough to matter. After the break.\nShort.",
    ),
    (
        "<body><header>Site</header><div class=cookie-notice>We use cookies</div><div id=content><p>" + "Body text that goes on for a while. " * 5 + "</p><p>End.</p></div>"
        "<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div></body>",
        ("Body text that goes on for a while. " * 5).strip() + "\nEnd.",
    ),
    ("<article><p>Cut off in the midd", "Cut off in the midd"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>&#x41;&nbsp;B</article>", "a\nb\nc\nd\nA B"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(i, None if i else "u", h, 1) for i, (h, _) in enumerate(PAGES)] + [(None, "u", None, 1)], "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert len(got) == len(PAGES) + 1 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0
    assert len(html_text.main_text("<article><p>" + "w " * 400_000)) == 799_999


def test_media_round_trip(spark):
    texts = [*EDGES, (9, "é" * 100), (10, "é" * 100), *duckdb.sql(f"select doc_id + 100, text from '{SF}/documents.parquet' limit 50").fetchall()]
    folder = common.new_path(spark, "media")
    got = media.features(media.store(frame(spark, texts), folder)).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    for i, t in texts:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[9]["media_sha256"] == by[10]["media_sha256"] and by[9]["feature"] == by[10]["feature"]
    assert media.features(media.store(frame(spark, []), common.new_path(spark, "media"))).count() == 0


def archive(spark, n=300):
    uri = common.new_path(spark, "one") + "/a.media"
    with files.writing(uri) as out:
        writer = media.ArchiveWriter(out)
        for i in range(n):
            writer.add(i, 64, bytes([i % 251]) * 20000)
        writer.close()
    with files.writing(uri.rsplit("/", 1)[0] + "/_committed.json") as out:
        out.write(b'["a.media"]')
    return uri


def test_ranges_cover_every_member_once(spark, monkeypatch):
    uri = archive(spark)
    monkeypatch.setattr(media, "SPLIT", media.SEGMENT)
    reader = media.Reader(uri.rsplit("/", 1)[0])
    parts = reader.partitions()
    assert len(parts) > 1
    ids = [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()]
    assert ids == list(range(300))


def test_a_damaged_directory_is_noticed(spark):
    uri = archive(spark, 5)
    with files.reading(uri) as source:
        data = bytearray(source.read())
    data[5 * 20000 + 8] ^= 1  # the first member's size in bytes, right behind the members
    with files.writing(uri) as out:
        out.write(bytes(data))
    reader = media.Reader(uri.rsplit("/", 1)[0])
    with pytest.raises(OSError, match="damaged"):
        [b for p in reader.partitions() for b in reader.read(p)]


def test_a_member_is_tried_again_by_itself(spark, monkeypatch):
    uri = archive(spark, 5)
    reader, real, failures = media.Reader(uri.rsplit("/", 1)[0]), media.place, []

    class Failing:
        def __init__(self, inner):
            self.inner, self.at = inner, 0

        def seek(self, at):
            self.at = at
            self.inner.seek(at)

        def read(self, n):
            if n == 20000 and self.at > 30000 and len(failures) < 2:
                failures.append(self.at)
                raise OSError("lost")
            return self.inner.read(n)

    class System:
        def open_input_file(self, path):
            return Failing(real(uri)[0].open_input_file(path))

    parts = reader.partitions()
    monkeypatch.setattr(media, "place", lambda u: (System(), real(u)[1]))
    ids = [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()]
    assert ids == list(range(5)) and len(failures) == 2 and len(set(failures)) == 1


def test_damage_is_noticed(spark):
    uri = archive(spark, 3)
    with files.reading(uri) as f:
        data = bytearray(f.read())
    data[100] ^= 1
    with files.writing(uri) as out:
        out.write(bytes(data))
    reader = media.Reader(uri.rsplit("/", 1)[0])
    with pytest.raises(OSError, match="damaged"):
        [list(reader.read(p)) for p in reader.partitions()]
