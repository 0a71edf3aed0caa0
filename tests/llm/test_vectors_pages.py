"""Nearest neighbours, page text, language identification and archives."""

from __future__ import annotations

import gzip
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import kit  # noqa: E402

from busguard.llm import html_text, language_id, nearest, warc  # noqa: E402
from busguard.llm.queries import Q  # noqa: E402

SMALL = "/root/testdata/sf0.001"


# ---- op1

def exact_top(rows, is_query, top=20):
    out = {}
    for i, v in rows:
        if is_query(i):
            scores = sorted(((-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in rows if j != i))
            out[i] = [j for _, j in scores[:top]]
    return out


def test_nearest_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = Q["op1_cross_polytope"][0](spark, SMALL).collect()
    want = exact_top(rows, lambda i: i % 20 == 0)
    vectors = dict(rows)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(np.dot(np.float64(vectors[r.query_id]), np.float64(vectors[r.vec_id]))))
    assert got.keys() == want.keys() and all(len(v) == len(want[i]) for i, v in got.items())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * sum(map(len, want.values()))


def test_nearest_edge_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 4)  # many blocks
    rng = np.random.default_rng(3)
    units = nearest.unit_rows(rng.normal(size=(39, 5)))
    rows = [(i, [float(x) for x in units[i - 1]], 1) for i in range(1, 40)]
    twin = rows[4][1]
    rows += [(40, twin, 1), (60, twin, None), (80, twin, 1), (None, twin, 1), (100, None, 1), (120, [0.0] * 5, 1),
             (140, [1.0, None, 0.0, 0.0, 1.0], 1), (160, [float("nan")] * 5, 1), (180, [float("inf")] + [0.0] * 4, 1),
             (200, [1.0, 2.0], 1), (220, [], 1), (20, rows[19][1], 1)]
    sf = kit.table_dir(tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    valid = {i: [np.float32(x) for x in v] for i, v, _ in rows if i is not None and v and len(v) == 5
             and None not in v and np.isfinite(v).all() and any(v)}
    want = exact_top(list(valid.items()), lambda i: i % 20 == 0)
    got = {}
    for r in sorted(Q["op1_cross_polytope"][0](spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys() == {20, 40, 60, 80}
    assert [got[40][:2], got[60][:2], got[80][:2]] == [[5, 60], [5, 40], [5, 40]]  # ties to the smaller id
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("copies, spread", [(5, 0.0), (25, 0.0), (5, 0.01), (25, 0.01)])
def test_repeated_ids_take_one_place_each(spark, tmp_path, copies, spread):
    rng = np.random.default_rng(8)
    units = nearest.unit_rows(rng.normal(size=(60, 8)))
    rows = [(i, (units[i] + spread * rng.normal(size=8)).tolist()) for i in range(60) for _ in range(copies)]
    sf = kit.table_dir(tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    best = {}
    for i, v in rows:
        for j, w in rows if i % 20 == 0 else ():
            if i != j:
                best[i, j] = max(best.get((i, j), -9.0), float(np.dot(v, w)))
    got = {}
    for r in Q["op1_cross_polytope"][0](spark, sf).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(best[r.query_id, r.vec_id])
    assert got.keys() == {0, 20, 40} and all(len(v) == len(set(v)) == 20 for v in got.values())
    want = {i: sorted((j for q, j in best if q == i), key=lambda j: -best[i, j])[:20] for i in got}
    assert sum(len(set(got[i]) & set(want[i])) for i in got) >= 0.9 * 60


def test_rows_of_one_id_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 10)
    monkeypatch.setattr(nearest, "best_in_block", lambda top: lambda key, v, q: nearest.pd.DataFrame(
        {"query_id": [len(v)], "vec_ids": [[0]], "scores": [[0.0]]}))
    pack = lambda i: np.array([float(i)]).tobytes()
    shape = "table int, bucket long, id long, vec binary"
    vectors = spark.createDataFrame([(0, 0, 7, pack(i)) for i in range(100)], shape)
    queries = spark.createDataFrame([(0, 0, 20, pack(1))], shape)
    seen = [r.query_id for r in nearest.search_blocks(vectors, queries, 20).collect()]
    assert sum(seen) == 100 and max(seen) < 40


def test_few_vectors_give_all_others(spark, tmp_path):
    rows = [(20 * i, [1.0, float(i)], 1) for i in range(6)]
    sf = kit.table_dir(tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert Q["op1_cross_polytope"][0](spark, sf).groupBy("query_id").count().filter("count = 5").count() == 6


def test_rotations_keep_lengths():
    x = nearest.unit_rows(np.random.default_rng(0).normal(size=(50, 48)))
    y = nearest.rotated(x, 3)
    assert y.shape == (50, 64) and np.allclose(np.linalg.norm(y, axis=1), 1)
    assert np.allclose(y @ y.T, x @ x.T)


# ---- op2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>More</aside>
<article class="post"><h1>A  title &amp; more</h1><p>First <b>bold</b>text&nbsp;here.<script>var a="</p>";</script>
<p>Short.<div class="ad">Buy</div><ul><li>one<li>two</ul><!-- <p>no</p> --><form><input>Name</form>
<p title="a > b">a &lt; b<br>c</p><section id="comments"><article><p>First!</p></article></section></article>
<footer>&copy; x</footer></body></html>"""


def test_page_parts():
    assert html_text.main_text(PAGE) == "A title & more\nFirst boldtext here.\nShort.\none\ntwo\na < b c"


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain words only", "plain words only"), ("<p>a<p>b", "a\nb"), ("a < b", "a < b"), ("<div>", ""),
    ("<p>x<!-- open", "x"), ("<p>x<script>never closed", "x"), ("<p>x <a href=\"y>z", "x z"),
    ("<article></article><p>outside</p>", ""), ("<nav>menu<article><p>kept</p></article>", "kept"),
])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_line_blocks_without_article():
    body = "".join(f"<p>{'A sentence of the story goes on and on. ' * 4}</p><p>So.</p>" for _ in range(5))
    links = "".join(f"<div><a href=/{i}>Link number {i}</a></div>" for i in range(12))
    text = html_text.main_text(f"<body>{links}<h2>Heading</h2>{body}{links}<div>© 2024 Company</div></body>")
    assert text.split("\n") == ["Heading", *(["A sentence of the story goes on and on. " * 3
                                              + "A sentence of the story goes on and on.", "So."] * 5)]


SENTENCE = "A sentence of the story goes on and on."
STORY = [f"{n}. {SENTENCE * 4}" for n in range(5)]
STORY_HTML = "".join(f"<p>{t}</p>" for t in STORY)
LINKS = "".join(f"<div><a href=/{i}>Link number {i}</a></div>" for i in range(12))


@pytest.mark.parametrize("element", ["<article></article>", "<article><p>Read this too.</p></article>", "<main><p>Hi</main>"])
def test_main_text_outside_an_empty_or_teaser_element(element):
    text = html_text.main_text(f"<body>{LINKS}{element}{LINKS}<div>{STORY_HTML}</div>{LINKS}</body>").split("\n")
    assert text == STORY


def test_window_sums_decide_inside_and_outside_an_element():
    notice = "".join(f"<div class=xyz><a href=/{i}>Link {i}</a></div>" for i in range(8)) + "<div class=xyz>Ok</div>"
    text = html_text.main_text(f"<article><h1><a href=/>Title</a></h1>{STORY_HTML}<p>So.</p>{notice}{LINKS}</article>"
                               f"<div>{LINKS}<p>Teaser</p>{LINKS}{STORY_HTML}</div>").split("\n")
    assert text == ["Title", *STORY, "So.", *STORY]
    assert html_text.main_text("<article><h1>T</h1><p>a</p><p>b</p><p>c</p></article>") == "T\na\nb\nc"


def test_only_short_copyright_lines_are_notes():
    long = "Copyright law is the subject of this story. " + SENTENCE * 4
    assert html_text.main_text(f"<p>{long}</p><p>{STORY[0]}</p><p>Copyright 2024 Company</p>") == f"{long}\n{STORY[0]}"


def test_broken_markup_takes_linear_time():
    for piece in ("<a href=\"", "<", "<title>", "<!-", "<p class='x", "</"):
        html_text.main_text(piece * 60_000)


def test_op2_rows(spark, tmp_path):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (4, "u", "<p>" + "long " * 300_000), (1, "u", PAGE)]
    sf = kit.table_dir(tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in Q["op2_html_text"][0](spark, sf).collect()}
    assert got[2].text == got[None].text == "" and got[1].n_chars == len(html_text.main_text(PAGE))
    assert got[4].n_chars == 1_499_999


# ---- op5

def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = Q["op5_language_id"][0](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(lang) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.97 * len(tested)


def test_language_edge_rows(spark):
    rows = [(i, "the house and the garden " * 9, "en", None, 1) for i in range(40)]
    rows += [(i, "das haus und der garten " * 9, "de", None, 1) for i in range(40, 60)]
    rows += [(100, None, "en", None, 1), (101, "12 ?!", "de", None, 1), (102, "", None, None, 1),
             (103, "the garden", None, None, 1), (None, "der garten und das haus", None, None, 1), (104, kit.LONG, None, None, 1)]
    docs = kit.with_clashes(kit.docs_frame(spark, rows))
    model = language_id.learn(docs.filter(~language_id.is_held_out(docs["doc_id"])))
    assert [name for name, _ in model] == ["en", "de"]
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert got[100].rejected and got[101].score == 0 and got[103]["kept"] == "z"
    assert {r.lang_pred for r in language_id.identify(docs, []).collect()} == {"und"}


# ---- op10

def test_archives_of_copies(spark, tmp_path):
    big, small = "<p>" + "same page " * 30, "<p>tiny"
    rows = [(7, "http://a b", big), (3, "u", big), (None, "u", big), (9, None, big), (1, "u", small), (2, "u", small),
            (4, "u", None), (5, "", ""), (6, "u", "é" * 50 + "\r\n\r\nWARC/1.1\r\n"), (1 << 60, "u", "x" * 2_000_000)]
    sf = kit.table_dir(tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = Q["op10_warc"][0](spark, sf)
    assert got.filter("not sound").isEmpty()
    kit.same(kit.as_rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"),
             brute.warc([(i, h) for i, _, h in rows]))


def test_repeated_page_is_revisited_once(spark, tmp_path):
    rows = [(3, "u", "z" * 200), (3, "u", "z" * 200)]
    sf = kit.table_dir(tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = Q["op10_warc"][0](spark, sf).collect()
    assert sorted((r.record_type, r.refers_to) for r in got) == [("response", None), ("revisit", 3)]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("zipped", [False, True])
def test_both_arc_versions(version, zipped):
    doc = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x\n\ny"
    line = {1: "http://h/a 1.2.3.4 20010203040506 text/html", 2: "http://h/a 1.2.3.4 20010203040506 text/html 200 - - 0 f"}
    arc = (warc.version_block(version, "20010203040506") + "\n" + f"{line[version]} {len(doc)}\n").encode() + doc
    arc += b"\n" + line[version].replace("http://h/a", "dns:h").encode() + b" 7\n1.2.3.4\n"
    block, page, dns = warc.read_arc("a.arc", gzip.compress(arc) if zipped else arc)
    assert block["kind"] == "warcinfo" and dns["kind"] == "resource" and dns["payload"] == b"1.2.3.4"
    assert (page["kind"], page["url"], page["date"], page["payload"]) == ("response", "http://h/a", "2001-02-03T04:05:06Z",
                                                                          b"<p>x\n\ny")


def test_short_arc_is_an_error():
    arc = warc.version_block(1, "20010203040506") + "http://h 1.2.3.4 20010203040506 text/html 99\nshort"
    with pytest.raises(ValueError, match="declared"):
        list(warc.read_arc("a.arc", arc.encode()))


def test_revisits_hold_no_payload(spark, tmp_path):
    body = "".join(random.Random(1).choices("abcdef", k=5000))
    rows = [(i, f"http://h/{i}", body) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write_arc(pages, f"{tmp_path}/arc", version=2)
    warc.convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(f"{tmp_path}/warc").glob("part-*"))
    assert raw.count(body.encode()) == 1 and raw.count(b"WARC-Type: revisit") == 19


def test_numerals_are_no_letters():
    model = [("en", b"the shop opens at nine on monday " * 20), ("fr", b"la plage avec les amis de la maison " * 20)]
    classifier = language_id.Classifier(model)
    for text in ("½", "² Ⅷ ①", "12 34", ""):
        assert classifier.predict(text) == ("und", 0.0, True)
    assert classifier.predict("the shop")[0] == "en"


def test_more_languages_than_the_parameter_allows(spark):
    rows = [(i, f"text number {i}", f"l{i}") for i in range(4)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.learn(train, max_languages=4)) == 4
    with pytest.raises(ValueError, match="max_languages"):
        language_id.learn(train, max_languages=3)


def test_page_addresses_that_look_like_a_version_block(spark, tmp_path):
    rows = [(1, "filedesc://pages.arc", "<p>one</p>" * 20), (2, "filedesc://x 0.0.0.0 1 2 3", "<p>two</p>"),
            (3, "http://a.example/", "<p>one</p>" * 20)]
    sf = kit.table_dir(tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in Q["op10_warc"][0](spark, sf).collect()}
    assert sorted(got) == [1, 2, 3] and got[3]["refers_to"] == 1 and got[2]["record_type"] == "response"
    assert got[1]["url"] == "filedesc://pages.arc" and all(r["sound"] for r in got.values())


def test_a_file_without_a_version_block_is_an_error():
    with pytest.raises(ValueError, match="no version block"):
        list(warc.read_arc("x", b"http://a 0.0.0.0 20240101000000 text/html 2\nab\n"))


def test_long_text_full_of_secrets_takes_linear_time():
    import time
    from busguard.llm import secret_scan
    encoding = secret_scan.vocabulary(secret_scan.VOCABULARY)
    rng = random.Random(1)
    one = "".join(f" {rng.getrandbits(100):025x}/Zk3vQ9xT1bLr8WmPz0Yd{i} password=hunter{i}\n" for i in range(20_000))
    began = time.time()
    some = secret_scan.scan(one[:len(one) // 8], encoding)
    eighth, began = time.time() - began, time.time()
    every = secret_scan.scan(one, encoding)
    assert len(every) > 7 * len(some) and time.time() - began < 20 * eighth + 2


def test_random_spans_leave_base_spans_alone():
    from busguard.llm import secret_scan
    encoding = secret_scan.vocabulary(secret_scan.VOCABULARY)
    rng = random.Random(4)
    for _ in range(300):
        taken = [("hex", a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 6)))]
        text = "".join(rng.choice("Zk3vQ9xT1bLr8/.") for _ in range(70))
        for _, a, b in secret_scan.random_spans(text, taken, encoding, 1, 1e9):
            assert not any(x < b and a < y and text[x:y].strip("/.") for _, x, y in taken)


def test_archives_are_compressed_at_the_light_level(spark, tmp_path):
    import glob
    import gzip
    import zlib

    pages = spark.range(300, numPartitions=1).selectExpr(
        "id AS page_id", "concat('http://h/', id) AS url", "array_join(transform(sequence(1, 60), i -> md5(cast(id * i % 97 AS string))), ' ') AS html")
    warc.write_arc(pages, str(tmp_path / "arc"))
    [file] = glob.glob(str(tmp_path / "arc" / "part-*"))
    content = open(file, "rb").read()
    plain = gzip.decompress(content)
    light, usual = (len(zlib.compress(plain, level)) for level in (3, 6))
    assert light != usual and abs(len(content) - light) < abs(len(content) - usual)
    assert plain.count(b"HTTP/1.1 200 OK") == 300
