"""Every operator against a brute-force version, on rows with nulls, empty and very long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from relgraph.llm import bpe, classifier, components, eliasfano, html, licenses, mixing, pretokens, rules, simhash, tokens, topk, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, n_words string"
WORD = r"[^\x20\x09-\x0D]+"


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(["th", "er", "on", "an", "ré", "ß", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    out = [None, "", "   \n\t", "x" * 30_000, "one two three", "One TWO three", "one  two\nthree", "a b c a b c a b c d", "<|endoftext|> it's 'll !! <|endoftext|>", "日本語 テキスト 123  　 é😀", "### $$$ %%% &&& | < >"]
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 160))) + rng.choice(["", "\nLicensed under CC BY-NC 4.0.", "\nReleased under the MIT License.", "\nUnder the Apache License, Version 2.0, apache license"]) for _ in range(60)]
    long = " ".join(rng.choice(vocabulary) for _ in range(12_000))
    return [*out, long, long, out[20], out[20] + " more", *([out[30]] * 5)]


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), i, "clash") for i, t in enumerate(texts())]
    return [*out, out[25], (None, "no id at all", None, None, None, None, None), (-4, "a negative id", "en", "", 1, 1, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def same(found, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_licenses(docs, rows, empty):
    def base(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        spots, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for i in range(len(words)):
                if words[i : i + len(p)] == p:
                    spots.append(i)
                    labels.add(label)
        return len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(labels))

    found = licenses.scan(docs).collect()
    same([tuple(r)[:6] for r in found], [(r[0], *base(r[1])) for r in rows])
    by_id = {r["doc_id"]: r for r in found}
    for r in rows:
        if r[1] and "CC BY-NC" in r[1]:
            assert by_id[r[0]]["labels"] == "cc-by,cc-by-nc-4.0"
        if r[1] and "MIT License" in r[1]:
            assert by_id[r[0]]["labels"] == "mit,mit-notice"
    assert all(0 <= r["score"] <= 1 for r in found)
    assert licenses.scan(empty).count() == 0


def test_license_texts(spark):
    rng = random.Random(3)
    filler = [f"w{rng.randint(0, 500)}" for _ in range(900)]
    rows, expected = [], {}
    for i, (label, (text, keys)) in enumerate(licenses.TEMPLATES.items()):
        whole, cut = text.split(), rng.randint(0, 400)
        rows.append((i, " ".join([*filler[:cut], *whole, *filler[cut:]]).title()))
        expected[i] = label
        if len(whole) > 40:  # a word in ten is lost, but not the key phrases
            kept = [w for k, w in enumerate(whole) if k % 10 or any(w in x.split() for x in keys)]
            rows.append((100 + i, " ".join([*filler[:cut], *kept, *filler[cut:]])))
            expected[100 + i] = label
    shuffled = licenses.TEMPLATES["mit-text"][0].split()
    rng.shuffle(shuffled)
    rows += [(1000, " ".join(shuffled)), (1001, " ".join(filler))]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in expected.items():
        assert label in found[i]["labels"].split(",") and found[i]["score"] > 0.55
    assert found[1000]["labels"] == found[1001]["labels"] == ""


def test_license_scan_against_plain_windows():
    """A template is found exactly where its key phrases stand within a window that holds enough of its weight."""
    index = licenses.Index(licenses.BASE, licenses.TEMPLATES, {}, 10)
    number = lambda text: np.array([index.words.get(w.encode(), -1) for w in text.split()])
    labels, score = licenses.scan_file(number("x y " + " ".join(licenses._ISC.split()[:70]) + " z"), index)
    assert labels == ["isc"] and 0.55 < score < 1
    assert licenses.scan_file(number("free of charge permission granted hereby is"), index) == ([], 0.0)
    assert licenses.scan_file(number(" ".join(licenses._ISC.split()[:12])), index) == ([], 0.0)  # a key phrase is missing


def test_urls(spark):
    rng = random.Random(2)
    hosts = ["a.example.org", "example.org", "b.org", "WWW.shop.COM", "x.net", "example.orgs", "com"]
    data = [(i, rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + rng.choice(["/es/", "/en/1", "/en/2", "/fr/", "/de/", "/", ""]) + rng.choice(["", "7", f"{rng.randint(0, 999)}.html", "p?x=/de/"]), "x", "clash") for i in range(300)]
    data += [(900, None, None, None), (901, "no scheme", "", ""), (902, "http://", "", ""), (903, "http://h#/es/", "", ""), data[0]]
    found = urls.judge(spark.createDataFrame(data, "page_id long, url string, host string, share string")).collect()

    def expected(url):
        _, sep, rest = (url or "").partition("://")
        if not sep:
            rest = ""
        host = lowered(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        best = max(((s + p, v) for s, p, v in urls.RULES if (host == s or host.endswith("." + s)) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, None))
        return host, path, *best

    by_id = {i: expected(u) for i, u, _, _ in data}
    assert len(found) == len(data)
    for r in found:
        host, path, rule, verdict = by_id[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    blocked = [(i, f"http://x.com/{'de' if i % 2 else 'xx'}/{i}/a", "", "") for i in range(40)] + [(99, "http://y.net/q", "", "")]
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(blocked, "page_id long, url string, a string, b string")).collect()}
    assert verdicts[0] == "block" and verdicts[1] == "block"  # all that is labelled on the host is blocked
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_verdicts_are_of_shares(spark):
    rng = random.Random(8)
    data = [(i, f"http://{rng.choice(['a.com', 'b.com', 'c.net'])}/{rng.choice(['de', 'fr', 'xx', 'yy'])}/{rng.choice(['shop', 'news', ''])}/{rng.choice(['p', 'q'])}{rng.randint(0, 60)}/{rng.randint(0, 9)}") for i in range(400)]
    frame = spark.createDataFrame(data, "page_id long, url string")
    once = {r["page_id"]: tuple(r) for r in urls.judge(frame).collect()}
    five = urls.judge(spark.createDataFrame(data * 5, frame.schema)).collect()
    assert len(once) == 400 and len(five) == 2000 and all(tuple(r) == once[r["page_id"]] for r in five)
    assert {r[4] for r in once.values()} == {"allow", "block"}


def test_url_tree_reaches_the_last_segment(spark):
    data = [(i, f"http://h.net/a/b/c/d/{'p' if i % 2 else 'q'}/{i}/x{i}") for i in range(80)] + [(100, "http://h.net/a/b/c/p1"), (101, "http://h.net/a/b/c/q2")]
    found = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(data, "page_id long, url string")).collect()}
    assert {r["template"] for i, r in found.items() if i < 80} == {"/a/b/c/d/{p and like it}/{n}/*"}
    assert found[100]["template"] != found[0]["template"]
    mixed = [(i, f"http://k.com/de/{i}.html") for i in range(40)] + [(50 + i, f"http://k.com/fr/{i}.html") for i in range(40)] + [(200, "http://k.com/xx/1.html")]
    found = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(mixed, "page_id long, url string")).collect()}
    assert found[0]["template"] == "/de/{n}.html" and found[50]["template"] == "/fr/{n}.html" and found[0]["share"] > 0.85 > 0.15 > found[50]["share"]
    assert found[200]["verdict"] == "allow"


def test_rules(docs, rows, empty):
    def base(text):
        words = re.findall(WORD, text or "")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n, hit, seen, dup = Counter(grams), set(), set(), 0
        for i, g in enumerate(grams):
            if n[g] > 1:
                hit |= {i, i + 1, i + 2}
        for line in (text or "").split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)

    found = rules.quality_rules(docs, *rules._paths()).collect()
    same([(*tuple(r)[:6], r["base_failed"]) for r in found], [(r[0], *base(r[1])) for r in rows])
    assert not any(r["kept"] and r["base_failed"] for r in found) and any(r["kept"] for r in found)
    kept = rules.keep_good(docs, *rules._paths())
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)
    assert rules.quality_rules(empty, *rules._paths()).count() == 0


def test_fertility_bands_reject_what_the_base_rule_passes(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice(["th", "er", "on", "an", "ing", "é", "ou"]) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    clean = [rng.choice(words) for _ in range(120)]
    data = [(1, " ".join(clean)), (2, " ".join(w + rng.choice(["%%%", "$$$", "###", "&&&", "***"]) for w in clean)), (3, " ".join(rng.choice("abcdefgh") for _ in range(120)))]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    found = {r["doc_id"]: r for r in rules.quality_rules(frame, *rules._paths()).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert {i: r["kept"] for i, r in found.items()} == {1: True, 2: False, 3: False}
    assert [r["doc_id"] for r in rules.keep_good(frame, *rules._paths()).collect()] == [1]


def test_classifier(spark, docs, empty):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "and", "of", "thing", "other"]) for _ in range(80)) + "." for _ in range(150)]
    bad = [" | ".join(rng.choice(["THE", "AND", "OF"]) + "!!" for _ in range(60)) for _ in range(150)]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(good + bad)] + [(1000, "", ""), (1001, None, ""), (None, "the and", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5, 1, 0), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in classifier.classify(table, labels).collect()}
    assert len(found) == 303
    held = [r for i, r in found.items() if i is not None and i < 300 and r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
    assert np.mean([r["predicted"] == int(r["doc_id"] < 150) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found.values())
    again = {r["doc_id"]: r["score"] for r in classifier.classify(table, labels).collect()}
    assert again == {i: r["score"] for i, r in found.items()}
    assert classifier.classify(empty, labels).count() == 0
    assert classifier.classify(docs, labels.limit(0)).count() == docs.count()


def test_scores_against_plain_loops():
    rng = np.random.default_rng(6)
    shape = (classifier.WIDTH, 256, classifier.FILTERS)
    model = {"filters": rng.normal(0, 0.2, shape).astype(np.float32), "bias": rng.normal(0, 0.2, classifier.FILTERS).astype(np.float32), "out": rng.normal(0, 0.5, classifier.FILTERS).astype(np.float32), "prior": np.float32(0.3)}
    given_texts = ["", "a", "b" * 256, "some longer text, é " * 30, None, "x y" * 400]

    def score(text):
        data, step, total, n = (text or "").encode(), classifier.CHUNK - classifier.OVERLAP, np.zeros(classifier.FILTERS), 0
        while n == 0 or n * step + classifier.OVERLAP < len(data):
            chunk = data[n * step : n * step + classifier.CHUNK].ljust(classifier.CHUNK, b"\0")
            sums = [sum(model["filters"][w][chunk[at + w]].astype(np.float64) for w in range(classifier.WIDTH)) for at in range(0, classifier.CHUNK - classifier.WIDTH + 1, classifier.STEP)]
            total += np.maximum(np.max(sums, axis=0) + model["bias"], 0)
            n += 1
        return 1 / (1 + np.exp(-(total / n @ model["out"] + model["prior"])))

    from relgraph.llm.common import text_buffers

    assert np.allclose(classifier.scores(model, *text_buffers(pa.array(given_texts))), [score(t) for t in given_texts], atol=1e-5)


def test_chunks_cover_every_byte():
    for n in (0, 1, 31, 255, 256, 257, 480, 481, 5000):
        data = np.arange(n) % 251 + 1
        block, k = classifier.chunks(data.astype(np.uint8), np.array([0, n]))
        assert k[0] == len(block)
        seen = np.zeros(n + classifier.CHUNK, bool)
        for i, row in enumerate(block):
            at = i * (classifier.CHUNK - classifier.OVERLAP)
            own = row[: max(0, n - at)]
            assert (own == data[at : at + len(own)]).all()
            seen[at : at + classifier.CHUNK] = True
        assert seen[:n].all()


def best_ten(data):
    """The contract by brute force: every row by itself, components that one of two vectors lacks being zero."""
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v, *_ in data if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    dot = lambda a, b: int(a[: len(b)] @ b[: len(a)])
    return [(q, rank + 1, i, s) for at, (q, x) in enumerate(good) if q % 100 == 0 for rank, (s, i) in enumerate(sorted(((dot(x, v), i) for j, (i, v) in enumerate(good) if j != at), key=lambda x: (-x[0], x[1]))[:10])]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in np.round(rng.normal(0, 0.2, 8), 1 if i % 2 else 3)], 1) for i in range(900)]
    data += [(1000, None, 1), (1100, [1.0, None] + [0.0] * 6, 1), (1200, [float("nan")] + [0.0] * 7, 1), (1300, [float("inf")] + [0.0] * 7, 1), (None, [0.5] * 8, 1), (-100, [0.1] * 8, 1)]
    data += [data[100], data[100], (200, [0.3] * 8, 1), (1400, [0.5, -0.5], 1), (1401, [2.0] * 11, 1), (1500, [], 1), (1501, [], 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)
    same([tuple(r) for r in topk.top_k(table).collect()], best_ten(data))
    con = duckdb.connect()
    con.register("embeddings", table.toArrow())
    same(con.execute(topk.OP5_SQL).fetchall(), best_ten(data))
    assert topk.top_k(table.limit(0)).count() == 0
    few = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0])]
    same([tuple(r) for r in topk.top_k(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect()], [(0, 1, 2, 2097152), (0, 2, 1, 1048576), (0, 3, 1, 524288)])


def test_top_k_in_small_groups_and_blocks(tmp_path, monkeypatch):
    for name, value in (("QUERY_BLOCK", 3), ("SHARD", 16), ("GROUP", 2), ("LEAF", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    vectors = [rng.integers(-9, 9, 4 + i % 3 // 2).tolist() for i in range(400)]
    lists = lambda x: pa.array(x, pa.list_(pa.int64()))
    pq.write_table(pa.table({"q": pa.array(range(20), pa.int64()), "v": lists(vectors[:20])}), tmp_path / "queries.parquet")
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100), pa.int64()), lists(vectors[i : i + 100])], names=["vec_id", "v"]) for i in range(0, 400, 100)]
    found = defaultdict(list)
    for batch in topk._searcher(str(tmp_path), 5)(iter(batches)):
        for q, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found[q].append((-s, i))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    assert {q: sorted(x)[:5] for q, x in found.items()} == {q: sorted((-dot(vectors[q], v), i) for i, v in enumerate(vectors))[:5] for q in range(20)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.int64))
    data = eliasfano.encode(values)
    back = eliasfano.Ascending(data + b"rest")
    assert back.size == len(data) and (back.all() == values).all()
    assert [back.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    for first in range(0, len(values), 97):
        for last in (first, first + 1, first + 60, len(values)):
            assert (back.between(first, min(last, len(values))) == values[first:last]).all()


def test_tokens(docs, rows, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    manifest = tokens.write_tokens(docs, path, 2, str(tmp_path / "t")).cache()
    found = tokens.read_tokens(manifest, str(tmp_path / "t")).collect()
    expected, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        expected.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same([tuple(r) for r in found], expected)
    first = manifest.orderBy("shard").first()
    shard = tokens.Shard(str(tmp_path / "t"), first["file"])
    assert [len(shard.ids(i)) for i in range(shard.n)] == np.diff(shard.starts(0, shard.n)).tolist()
    assert tokens.read_tokens(tokens.write_tokens(empty, path, 2, str(tmp_path / "e")), str(tmp_path / "e")).count() == 0


def test_mixing(docs, empty, spark):
    found = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    same([tuple(r) for r in found.collect()], con.execute(mixing.OP7_SQL).fetchall())
    total = defaultdict(int)
    for r in mixing.mix(docs, carry=True).selectExpr("_row.source as source", "size", "target", "source_size", "taken", "passes").collect():
        assert r["taken"] == r["passes"] * r["size"] <= 3 * r["size"]
        total[r["source"], r["target"]] += r["taken"]
    assert all(abs(t - target) <= 12_000 for (_, target), t in total.items())
    assert mixing.mix(empty).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(wordless).collect()] == [0, 0]


def test_targets_are_reshared(spark):
    table = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate([("a", 10), ("b", 400), ("c", 400), (None, 5)])], "doc_id long, text string, source string")
    targets = {r["doc_id"]: r["target"] for r in mixing.mix(table).collect()}
    # a: weight 5, capped at 30; null: weight 5, capped at 15; b and c share the rest 2 : 1
    assert targets == {0: 30.0, 1: 770 * 2 / 3, 2: 770 / 3, 3: 15.0}


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav>
<!-- ad 3 --><div class="ad">buy</div><header>head</header><article><h1>Title &amp; more</h1><p><b>bold  text<br>next<p>second&nbsp;para
 graph</p><div class="comments"><p>reader says</p></div><div>last</div></article><aside>side</aside><form>sign up</form><footer>&copy; all</footer></body></html>"""


def test_html(spark):
    data = [(1, "http://h/a/1", PAGE, "x"), (2, "http://h/a/2", PAGE.replace("Title", "Other"), "x"), (3, "http://h/b", None, "x"), (4, None, "", "x"), (5, "http://g/1", "<p>plain & simple", "x"), (6, "http://h/a/1", PAGE, "x"), (6, "http://h/a/1", PAGE, "x")]
    data += [(10, "http://k/a", "<div>shared top</div><p>first body</p><p>its own end</p><p>and one</p><div>shared end</div>", ""), (11, "http://k/b", "<div>shared top</div><p>second body</p><p>another end</p><p>and two</p><div>shared end</div>", "")]
    found = {r["page_id"]: r for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string, host string")).collect()}
    body = "Title & more\n\nbold text next\n\nsecond para graph\n\nlast"
    assert found[1]["text"] == found[6]["text"] == body and found[2]["text"] == body.replace("Title", "Other")
    assert found[3]["text"] == found[4]["text"] == "" and found[5]["text"] == "plain & simple"
    assert found[10]["text"] == "first body\n\nits own end\n\nand one" and found[11]["text"] == "second body\n\nanother end\n\nand two"
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def pages_of(spark, pages):
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()}


def test_html_heavy_template_and_copies(spark):
    template = "".join(f"<div>menu block {i}</div>" for i in range(8)) + "<nav>menu</nav><footer>foot</footer>"
    own = {c: [f"{c} first paragraph of this page alone", f"{c} second paragraph, which is its own"] for c in "abc"}
    page = {c: template + "".join(f"<p>{x}</p>" for x in own[c]) for c in own}
    found = pages_of(spark, [(1, "http://h/x/1", page["a"]), (2, "http://h/x/2", page["b"]), (3, "http://k/x/11", page["a"]), (4, "http://k/x/12", page["a"]), (5, "http://k/x/13", page["a"]), (6, "http://k/y", page["c"])])
    text = {c: "\n\n".join(own[c]) for c in own}
    assert found == {1: text["a"], 2: text["b"], 3: text["a"], 4: text["a"], 5: text["a"], 6: text["c"]}


def test_html_boilerplate_inside_articles(spark):
    notice = '<div class="x1">a notice that is on every page of the host</div>'
    copied = "<p>a paragraph that is copied to another page</p>"
    body = {i: [f"{x} is what this page alone tells its readers", f"{x} again, in other words, for the end"] for i, x in enumerate(["apple", "pear", "plum", "fig"])}
    data = [(i, f"http://h/{i}", f"<article>{notice}<p>{a}</p>{copied if i < 2 else ''}<p>{b}</p></article>") for i, (a, b) in body.items()]
    found = pages_of(spark, data)
    assert found == {i: "\n\n".join([a, *(["a paragraph that is copied to another page"] if i < 2 else []), b]) for i, (a, b) in body.items()}


def test_html_does_not_depend_on_partitions(spark, monkeypatch):
    rng = random.Random(12)
    menu = "".join(f"<div>menu {i}</div>" for i in range(3))
    data = []
    for i in range(90):
        own = "".join(f"<p>{rng.random()} is the page's own</p>" for _ in range(3))
        data.append((i if i % 11 else None, f"http://{'hot.org' if i % 3 else f'h{i % 4}.net'}/{rng.choice('abc')}/{i % 17}", data[-1][2] if i % 5 == 0 and data else menu + own))
    frame = spark.createDataFrame(data, "page_id long, url string, html string")
    whole = [tuple(r) for r in html.extract(frame.coalesce(1)).collect()]
    assert sum("menu" in r[2] for r in whole) == 0
    monkeypatch.setattr(html, "BLOCK", 12)
    monkeypatch.setattr(html, "EDGE", 8)
    for n in (1, 40):
        same([tuple(r) for r in html.extract(frame.repartition(n)).collect()], whole)


def main_texts(pages):
    """Every page's main text by the definition: partners are sought over the whole host, each page against each."""

    @lru_cache(maxsize=None)
    def copy(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + len(x) if x == y else 0)
        return best[-1][-1] >= 0.8 * max(len("".join(a)), len("".join(b)))

    out, hosts = {}, defaultdict(list)
    for page_id, url, source in pages:
        host, path = url[7:].split("/", 1)
        hosts[host].append(("/" + path, page_id, [(text, article) for text, named, article in html.lines_of(source) if not named]))
    for host in hosts.values():
        host.sort()
        texts = [tuple(text for text, _ in own) for *_, own in host]

        def seek(side, at, avoid, texts=texts):
            return next((j for j in range(at + side, len(texts) if side > 0 else -1, side) if not any(copy(x, texts[j]) for x in avoid)), None)

        for i, (path, page_id, own) in enumerate(host):
            ends = {side: j for side in (-1, 1) if (j := seek(side, i, [texts[i]])) is not None}
            chosen = []
            for side in sorted(ends, key=lambda side: -html.near(host[ends[side]][0], path)):
                if chosen and copy(chosen[0], texts[ends[side]]):
                    ends[side] = seek(side, ends[side], [texts[i], *chosen])
                chosen += [texts[ends[side]]] if ends[side] is not None else []
            for side in (-1, 1):
                further = seek(side, ends[side], [texts[i], *chosen]) if ends.get(side) is not None else None
                chosen += [texts[further]] if further is not None else []
            shared = [html.common_lines(texts[i], x) for x in chosen]
            inside = set.intersection(*shared) if len(shared) > 1 else set()
            out[page_id] = "\n\n".join(text for k, (text, article) in enumerate(own) if k not in (inside if article else set().union(*shared[:1])))
    return out


def test_html_partners_beyond_blocks_and_copies(spark, monkeypatch):
    rng = random.Random(21)
    menu, notice = "".join(f"<div>menu block {i}</div>" for i in range(3)), "<p>a notice on every page</p>"
    fresh = lambda n: [f"{rng.random()} is a line of the page's own" for _ in range(n)]
    page = lambda own: f"{menu}<article>{notice}{''.join(f'<p>{x}</p>' for x in own)}</article>"
    texts = defaultdict(list)
    one, two, base, drift, few = fresh(3), fresh(4), fresh(30), fresh(140), fresh(12)
    for host in ("copies", "near", "pair", "drift"):
        texts[host] += [fresh(3), fresh(4)]
    texts["copies"] += [one] * 70
    texts["near"] += [[*base[:k], *fresh(2), *base[k:]] for k in (rng.randint(0, 30) for _ in range(70))]
    texts["pair"] += [one, two] * 35
    texts["drift"] += [drift[i : i + 20] for i in range(70)]
    for host in ("copies", "near", "pair", "drift"):
        texts[host] += [fresh(3), fresh(4)]
    texts["only"] = [one] * 40
    texts["chance"] = [[x for x in few if rng.random() < 0.85] for _ in range(80)]
    data = [(len(texts) * i + k, f"http://{host}/{i:03}", page(own)) for k, host in enumerate(texts) for i, own in enumerate(texts[host])]
    expected = main_texts(data)
    frame = spark.createDataFrame(data, "page_id long, url string, html string")
    for block, edge in ((12, 4), (50, 8), (2048, 32)):
        monkeypatch.setattr(html, "BLOCK", block)
        monkeypatch.setattr(html, "EDGE", edge)
        assert {r["page_id"]: r["text"] for r in html.extract(frame.repartition(5)).collect()} == expected
    # what it is for: no copy keeps the menu, and, where there are other pages, none keeps the notice
    by_host = {host: [expected[len(texts) * i + k] for i in range(len(texts[host]))] for k, host in enumerate(texts)}
    assert not any("menu" in x or "notice" in x for host in ("copies", "near", "pair", "drift") for x in by_host[host])
    assert all("menu" in x for x in by_host["only"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_html_copies_share_the_heaviest_subsequence(a, b):
    lengths = {"a": 9, "b": 2, "c": 4}
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + lengths[x] if x == y else 0)
    one, two = (html.text_of([(x * lengths[x], False, False) for x in text]) for text in (a, b))
    assert html.heaviest(one, two) == best[-1][-1]
    assert html.copies(one, two) == html.copies(two, one) == (best[-1][-1] >= 0.8 * max(one.total, two.total))


def test_html_markup_that_is_not_well_formed():
    text = lambda page: [x for x, named, _ in html.lines_of(page) if not named]
    assert text('<article><p title="5" tall">one</p><p a=\'x>y\' b="<p>">two<p c=>three</ ><p>a < b</article>') == ["one", "two", "three", "a < b"]
    assert text("<p>one<!-- <p> --><p>two<a href=\"x") == ["one", "two"]
    assert text("<article><section id='related-work'><p>kept</p></section><h2 id='comments'>kept too</h2><div class='comment-list'>gone</div><div class='share-buttons'>gone</div><div class='share-price'>12</div></article>") == ["kept", "kept too", "12"]
    assert text("<div class='x related-links'>gone</div><math><mi>x</mi></math>") == ["x"]
    begin = time.time()
    for hostile in ('<a "' * 50_000, "<a b='" * 30_001, "<div>" * 50_000 + "</p><li>" * 50_000, "<blockquote>" * 30_000 + "<p>x" * 30_000, "<!-" * 50_000, "<a =" * 50_000):
        html.lines_of(hostile)
    rng = random.Random(1)
    html.common_lines([rng.choice("ab") for _ in range(6000)], [rng.choice("ab") for _ in range(6003)])
    assert time.time() - begin < 10


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    own = [a[i] for i in sorted(html.common_lines(a, b))]
    rest = iter(b)
    assert len(own) == best[-1][-1] and all(x in rest for x in own)


_PARTS = ["a", "s", "t", "re", "ll", "'", "'s", "'ve", " ", "  ", "\n", "\t", "é", "日", "1", "٣", "!", "😀", " ", "　", "\x85"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(_PARTS), max_size=12).map("".join)), max_size=6))
def test_pretokens(texts):
    pattern = regex.compile(public_tokenizers.PATTERN)
    words, counts = pretokens.split_pretokens(pa.array(texts, pa.string()))
    expected = [pattern.findall(t or "") for t in texts]
    assert [w.decode() for w in words.to_pylist()] == [w for x in expected for w in x] and counts.tolist() == [len(x) for x in expected]


def test_bpe(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    digest = lambda data: hashlib.sha256(data).hexdigest()
    expected = [(r[0], len(ids := encoding.encode_ordinary(r[1] or "")), digest(" ".join(map(str, ids)).encode()), digest((r[1] or "").encode())) for r in rows]
    same([tuple(r) for r in bpe.bpe_round_trip(docs, path).collect()], expected)
    assert bpe.bpe_round_trip(empty, path).count() == 0


def test_digests_of_words_put_together_in_parts(monkeypatch):
    rng = random.Random(1)
    parts = [b"%d " % i for i in range(30)]
    counts = [0, 5, 0, 17, 1, 40, 0]
    codes = [rng.randrange(30) for _ in range(sum(counts))]
    expected, at = [], 0
    for n in counts:
        expected.append(hashlib.sha256(b"".join(parts[c] for c in codes[at : at + n])[:-1]).hexdigest())
        at += n
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(bpe, "JOIN_WORDS", size)
        assert bpe._digests(pa.array(parts, pa.large_binary()), np.array(codes, np.int32), np.array(counts), 1) == expected


def fingerprint(text):
    words = re.findall(WORD, lowered(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    """Smallest key reachable over links of 3 or fewer bits, by brute force."""
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in keys:
        groups[find(k)].append(k)
    return {k: min((x for x in g if x is not None), default=None) for g in groups.values() for k in g}


def test_simhash(docs, rows, empty):
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    groups = grouped(prints)
    found = simhash.simhash_groups(docs).collect()
    assert len(found) == len(rows)
    assert all(r["fp"] & (1 << 64) - 1 == prints[r["doc_id"]] and r["component_id"] == groups[r["doc_id"]] for r in found)
    kept = sorted((r["doc_id"] for r in simhash.keep_one(docs).collect()), key=lambda x: (x is not None, x))
    assert kept == sorted(set(groups.values()), key=lambda x: (x is not None, x))
    assert simhash.simhash_groups(empty).count() == 0


def test_keep_one_keeps_one_of_each_group(spark):
    text = ["alpha beta gamma delta", "one two three four five", "red green blue white black", "north south east west", "salt pepper oil bread"]
    rows = [(None, text[0]), (None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (9, text[3]), (5, text[4]), (7, text[4]), (None, text[4])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({fingerprint(x) for x in text}) == len({r["root"] for r in simhash.simhash_groups(frame).collect()}) == 5
    same([tuple(r) for r in simhash.keep_one(frame).collect()], [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (5, text[4])])


def test_simhash_hot_keys_and_plans(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(4)
    prints = {}
    for centre in [rng.getrandbits(64) for _ in range(6)] + [0]:
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints[len(prints)] = x
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in set(prints.values())], "fp long")
    links = simhash.near_links(table)
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    expected = defaultdict(set)
    for i, g in grouped(prints).items():
        expected[g].add(prints[i] - (1 << 64) if prints[i] >> 63 else prints[i])
    for group in expected.values():
        assert {roots.get(x, x) for x in group} == {min(group)}
    assert simhash.allocate([[0, 5, 100], [0, 1, 2], [0, 9, 9]], 3)[1] == [0, 1, -1]
    assert sorted(b for g in simhash.correlated_groups(np.eye(64), 10, 3) for b in g) == list(range(64))
