"""Small tables with nulls, empty texts, repeats, ties and extra columns, against brute force."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlink.llm import exact_dedup, shingle_join
from weftlink.llm.exact_dedup import CuckooIndex, DigestIndex
from weftlink.llm.html_text import TokenWeights, best_run, main_blocks, main_text
from weftlink.llm.license_scan import license_scan
from weftlink.llm.lyndon import suffix_array
from weftlink.llm.packing import Encoder, pack
from weftlink.llm.quality import STATISTICS, RuleEnsemble, fit_quality, held_out, keep_good, quality_scores, statistics
from weftlink.llm.queries import tokenizer_path
from weftlink.llm.shared import buffers
from weftlink.llm.secret_scan import FORMATS, CharCNN, base_spans, labelled_findings, redact_rows, rows_of_findings, secret_scan, train, windows
from weftlink.llm.sentencepiece_codec import PieceCodec, piece_codec
from weftlink.llm.suffix_dedup import suffix_dedup
from weftlink.llm.vector_dedup import MultiIndex, vector_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, wl_id string"


def rows_of(texts, first=1):
    return [(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in enumerate(texts, first)]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(40)]
    texts = base + [t.upper() for t in base[:6]] + [t + " tail" for t in base[:12]] + [None, "", "", "  ", "one two", "one two", "the same " * 60]
    texts += [base[0] * 4, "x" * 300, base[5] + "\n" + base[6]]
    odd = [(None, base[3], None, None, None, None, None, None), (7, base[6], "en", "s", 1, "", "", "")]
    return spark.createDataFrame(rows_of(texts) + odd, SCHEMA).repartition(3)


def test_exact_dedup(spark, docs):
    low = lambda t: (t or "").encode().lower()
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_cuckoo_index_resizes_and_deletes():
    index, keys = CuckooIndex(), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for n, k in enumerate(keys):
        index.add(k, n)
    assert index.resizes and all(index.find(k) == n for n, k in enumerate(keys))
    assert all(index.remove(k) for k in keys[::2]) and not index.remove(keys[0])
    assert [index.find(k) for k in keys[:4]] == [None, 1, None, 3] and len(index) == 1500
    fps, places = index.dump()
    again = CuckooIndex.load(fps, [index.keys[r] for r in places], [index.values[r] for r in places])
    assert all(again.find(k) == (n if n % 2 else None) for n, k in enumerate(keys)) and len(again) == 1500


def test_cuckoo_filter_hits_are_verified():
    """Keys of one fingerprint and bucket differ in their content alone."""
    keys = [bytes(4) + bytes(8) + b"\x07\x07" + bytes([n]) * 18 for n in range(20)]
    index = CuckooIndex()
    for n, k in enumerate(keys[:6]):
        index.add(k, n)
    assert [index.find(k) for k in keys[:8]] == [0, 1, 2, 3, 4, 5, None, None] and index.hits(keys[9]) and index.probes > 6
    assert index.remove(keys[2]) and not index.remove(keys[9]) and [index.find(k) for k in keys[:4]] == [0, 1, None, 3]
    index.add(hashlib.sha256(b"x").digest(), 9)
    assert index.find(hashlib.sha256(b"y").digest()) is None


def test_digest_index_over_runs(spark, tmp_path, monkeypatch):
    """Batches of inserts and deletes against a plain dictionary; shards are split as the index grows."""
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 50)
    r, held, index, seen_bits = random.Random(6), {}, DigestIndex.empty(spark), set()
    frame = lambda rows: spark.createDataFrame([(i, exact_dedup.digest_of(t)) for i, t in rows], "wl_id long, wl_sha binary").repartition(3)
    for turn in range(4):
        new = [(r.choice([None, r.randint(0, 900)]), f"text {r.randint(0, 150 * (turn + 1))}") for _ in range(120 * turn + 20)]
        gone = [(0, f"TEXT {r.randint(0, 200)}") for _ in range(40)]
        index = index.update(frame(new), frame(gone))
        index.save(str(tmp_path / str(turn)))
        index = DigestIndex.load(spark, str(tmp_path / str(turn)))
        seen_bits.add(index.bits)
        for _, t in gone:
            held.pop(t.lower(), None)
        for i, t in new:
            keep, n = held.get(t, (None, 0))
            held[t] = (i if keep is None or i is not None and i > keep else keep, n + 1)
        assert {bytes(q.wl_sha): (q.wl_keep, q.wl_n) for q in index.live().collect()} == {exact_dedup.digest_of(t): v for t, v in held.items()}
    assert len(seen_bits) > 1
    asked = [(k, f"text {k}") for k in range(700)]
    assert {q.wl_id: (q.wl_keep, q.wl_n) for q in index.lookup(frame(asked)).collect()} == {k: held[t] for k, t in asked if t in held}
    emptied = index.update(deletes=frame([(0, t) for t in held]))
    assert emptied.live().count() == 0 and emptied.lookup(frame(asked)).count() == 0
    again = emptied.update(frame([(5, "text 1")]))
    assert [tuple(q)[1:] for q in again.live().collect()] == [(5, 1)]


def test_shingle_join(spark, docs):
    rows = docs.filter("doc_id <> 7").select("doc_id", "text").collect()
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    near = {a: {b for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} for a in sets}
    cls = {a: a for a in sets}
    for _ in sets:
        for a in sets:
            cls[a] = min([cls[a], *(cls[b] for b in near[a])])
    for small, group in ((96, 1024), (2, 2)):
        got = shingle_join.shingle_join(docs.filter("doc_id <> 7"), recall=0.9999, small=small, group=group).collect()
        assert {r.doc_id: (r.n_links, r.class_id) for r in got} == {a: (len(near[a]), cls[a]) for a in sets}
    every = shingle_join.shingle_join(docs).collect()
    assert len(every) == docs.count() and all(r.class_id is None for r in every if r.doc_id is None)
    assert shingle_join.keep_one(docs).columns == docs.columns
    assert shingle_join.shingle_join(docs.limit(0)).count() == 0


def test_vector_dedup(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 8))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i] + r.normal(size=8) * 0.1).tolist(), i % 3) for i in range(40)] + [(200 + i, base[0].tolist(), 0) for i in range(5)]
    odd = [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, base[0].tolist(), None), (304, [], 0), (None, base[0].tolist(), 0), (305, [1.0, None] * 4, 0)]
    odd += [(306, [-0.0], 0), (307, [float("inf")], 0), (308, base[0].tolist() + [0.0], 0), (309, [-4.0], 0)]
    alone = [(310, [2.0], 0), (311, [3.0], 0), (312, [2.0], 1), (313, [1e300, 1e300], 1), (314, [1.0, 1.0], 1), (315, [0.0, 1.0], 2), (316, [-0.0, 1.0], 2)]
    df = spark.createDataFrame(rows + odd + alone, "vec_id long, embedding array<double>, label int").repartition(3)
    df = df.withColumn("wl_id", F.lit("x")).withColumn("cell", F.lit("y"))
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, lab = np.array([i for i, _, _ in rows]), np.array([k for _, _, k in rows])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None]) & ~np.eye(len(x), dtype=bool)
    cls = ids.copy()
    for _ in ids:
        cls = np.array([min([cls[i], *cls[link[i]]]) for i in range(len(ids))])
    want = {int(i): (int(link[k].sum()), int(cls[k])) for k, i in enumerate(ids)} | {i: (0, i) for i, _, _ in odd}
    want |= {310: (1, 310), 311: (1, 310), 312: (0, 312), 313: (1, 313), 314: (1, 313), 315: (1, 315), 316: (1, 315)}
    for strip, cell in ((4096, 256), (3, 1)):
        got = {q.vec_id: (q.n_links, q.component_id) for q in vector_dedup(df, recall=1.0, cell=cell, strip=strip).collect()}
        assert got == want
    assert vector_dedup(df.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, [2.0, 4.0], "a")], "vec_id long, embedding array<float>, label string")
    assert sorted((q.vec_id, q.n_links, q.component_id, q.kept) for q in vector_dedup(repeated).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_vectors_of_many_lengths(spark):
    r = np.random.default_rng(4)
    rows = [(2 * n + k, (v * (1 + k)).tolist()) for n in range(1, 1002) for v in (r.normal(size=n),) for k in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit("x"))
    turned = spark.createDataFrame([(-1, r.normal(size=1500).tolist())] * 2, "vec_id long, embedding array<double>").withColumn("label", F.lit("x"))
    got = vector_dedup(df.unionByName(turned)).collect()
    assert all(q.n_links == 1 and q.component_id == (q.vec_id // 2 * 2 if q.vec_id > 0 else -1) for q in got)


def test_multi_index_finds_the_sample_s_links():
    r = np.random.default_rng(7)
    x = r.normal(size=(3000, 16))
    x[1500:] = x[:1500] + 0.25 * r.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    h = x[:, :8], x[:, 8:]
    index = MultiIndex.fit(*h, list(x), np.zeros(len(x)), 12, 0.9, 0.999)
    home, seen = index.home(*h), [set(v) for v in index.search(*h)]
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert np.mean([home[b] in seen[a] or home[a] in seen[b] for a, b in zip(i, j, strict=True)]) > 0.99 and index.visits < 144
    da, db = index._far(*h)
    grid = (da[0][:, None] + db[0][None]).ravel()
    assert index.search(h[0][:1], h[1][:1])[0] == np.argsort(grid, kind="stable")[: index.visits].tolist()


def test_pack(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = pack(docs.filter("doc_id <> 7"), path, window=64).orderBy("sequence_id", "offset").collect()
    at = 0
    for r in got:
        assert r.sequence_id * 64 + r.offset == at and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.length
    ids = {}
    for r in sorted(got, key=lambda r: r.start):
        ids[r.doc_id] = ids.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    assert ids == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs.filter("doc_id <> 7").select("doc_id", "text").collect()} | {k: v for k, v in ids.items() if k is None}
    assert pack(docs.limit(0), path).count() == 0


def test_pack_special_token_in_text():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["plain words"] * 20 + ["a <|endoftext|> b", "<|endoftext|>", "a <|endoftext b", ""]
    tok = Tokenizer.from_file(path)
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(path, np.dtype("<u4"))(pa.array(texts))]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts] and 50256 in got[20]


def test_pack_encodes_as_the_library(spark):
    """Whole tables against the tokenizers file's own ids: special strings, odd white space, very long and empty texts."""
    from tokenizers import Tokenizer

    path, r = tokenizer_path("byte_bpe_50k.json"), random.Random(8)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "a", "bee", "'s", "'ll", "Z9", "7", "!?", "é", "中", "😀", "\u0301", "<|endoftext|>", "<|endof", "\r\n", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", "word " * 900_000, "x" * 70_000, "中" * 30_000, " " * 5000 + "<|endoftext|>" * 3]
    tok = Tokenizer.from_file(path)
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    ids = {}
    for q in sorted(pack(docs, path).collect(), key=lambda q: q.start):
        ids.setdefault(q.doc_id, []).extend(np.frombuffer(q.ids, "<u4").tolist())
    assert ids == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts, 1)}


def test_pack_other_kinds_of_file(tmp_path):
    """A file with a normaliser is encoded whole; so are texts with an ordinary added token."""
    from tokenizers import Tokenizer, normalizers

    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["Some  Words", "an addedword here", "an added word", ""]
    for change in ("normalizer", "added"):
        tok = Tokenizer.from_file(path)
        if change == "normalizer":
            tok.normalizer = normalizers.Lowercase()
        else:
            tok.add_tokens(["addedword"])
        tok.save(str(tmp_path / change))
        got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(str(tmp_path / change), np.dtype("<u4"))(pa.array(texts))]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_piece_codec(spark, docs):
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    got = piece_codec(docs, data).collect()
    assert len(got) == docs.count() and all(r.parity and r.round_trip for r in got)
    codec = PieceCodec(data)
    odd = ["", " ", "a  b ", "▁▁ a", "中 😀\n", "<s> <0x41>"]
    assert codec.decode(codec.encode(odd)) == [t.replace("▁", " ") for t in odd]


def test_quality(spark, docs):
    r = np.random.default_rng(2)
    x = r.random((600, len(STATISTICS)))
    y = ((x[:, 7] < 0.5) & (x[:, 5] < 0.7)).astype(float)
    m = RuleEnsemble.fit(x, y)
    assert ((m.score(x) > 0.5) == (y > 0)).mean() > 0.97
    assert RuleEnsemble.fit(x[:0], y[:0]).score(x[:1])[0] == pytest.approx(0.5)
    got = quality_scores(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= q.score <= 1 and q.predicted == int(q.score >= 0.3) for q in got)
    assert all(q.held_out == (zlib.crc32(str(q.doc_id).encode()) % 5 == 0) for q in got if q.doc_id is not None)
    assert keep_good(docs, m, 0.0).columns == docs.columns and keep_good(docs, m, 0.0).count() == docs.count()


def test_statistics_against_brute_force():
    r = random.Random(12)
    parts = ["a", "B", "7", " ", "\t", "\n", "\r", ".", ",", "!!", "##", "é", "中", "\u2003", "word ", "word ", "$$$", "line\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["", "\n", " ", "中", "a" * 70_000]
    col = pa.array(texts)
    got = statistics(texts, *buffers(col))
    for t, row in zip(texts, got, strict=True):
        raw = t.encode()
        words, lines = re.findall("[^\t\n\r ]+", t), t.split("\n")
        share = lambda chars, n: sum(c in chars for c in raw) / max(n, 1)
        letters = b"abcdefghijklmnopqrstuvwxyz" + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        plain = [c < 128 and c not in letters + b"0123456789\t\n\r " for c in raw]
        want = [
            len(raw), len(words), len(lines), sum(len(w.encode()) for w in words) / max(len(words), 1), len(words) / len(lines), share(letters[26:], sum(c in letters for c in raw)), share(b"0123456789", len(raw)),
            sum(plain) / max(len(raw), 1), sum(p and k and raw[k] == raw[k - 1] for k, p in enumerate(plain)) / max(len(raw), 1), share(b".,", len(words)), share(b"!?", len(words)),
            sum(c > 127 for c in raw) / max(len(raw), 1), share(b"#$%&*+/<=>@\\^_`{|}~[]", len(words)), len(set(words)) / max(len(words), 1), len(set(lines)) / len(lines),
        ]
        assert row == pytest.approx(want, abs=1e-12), repr(t)


def test_quality_expression_and_labels(spark, docs):
    """The compiled expression against the model, held-out labels without influence, and held-out accuracy."""
    r = np.random.default_rng(3)
    x = r.random((500, len(STATISTICS)))
    m = RuleEnsemble.fit(x, ((x[:, 2] > 0.4) | (x[:, 9] < 0.2)).astype(float))
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "k long, " + ", ".join(f"{c} double" for c in STATISTICS))
    assert [q.s for q in df.withColumn("s", m.column()).orderBy("k").collect()] == pytest.approx(m.score(x).tolist())
    texts, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = fit_quality(texts, labels), fit_quality(texts, flipped)
    assert (one.rules, one.weights, one.intercept) == (two.rules, two.weights, two.intercept)
    got = quality_scores(texts, one).filter("held_out").join(labels, "doc_id").select("score", "quality").toPandas()
    good, bad = (got[got.quality == k].score.to_numpy() for k in (1, 0))
    assert len(good) and len(bad) and (good[:, None] > bad[None]).mean() > 0.97
    assert fit_quality(texts.limit(0), labels).score(x[:1])[0] == fit_quality(texts, labels.limit(0)).score(x[:1])[0] == pytest.approx(0.5)
    twice = fit_quality(texts.unionByName(texts), labels.unionByName(labels))
    assert (twice.rules, twice.weights) == (one.rules, one.weights)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>one\n two<p>x<b>y</b> z<div class='ad'>buy buy</div><p>last one</article><footer>foot</footer>"
    w = TokenWeights.learn([page] * 5)
    assert main_blocks(page, w) == ["A & B", "one two", "xy z", "last one"]
    assert main_blocks("", w) == [] and main_blocks("<p", w) in ([], ["<p"])
    df = spark.createDataFrame([(1, page), (2, None), (None, page), (1, page)], "page_id long, html string")
    assert sorted(r.n_chars for r in main_text(df).collect())[0] == 0
    assert main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, has, lacks",
    [
        ('<div class="content with-sidebar"><p>{}</p></div>', 1, 0),
        ('<div class="page no-comments"><article><p>{}</p></article></div>', 1, 0),
        ('<div class="sidebar"><article><p>{}</p></article></div>', 1, 0),
        ('<form><main><p>{}</p></main></form>', 1, 0),
        ('<p>{}</p><section id="related-work"><h2 id="notice-period">{}</h2></section>', 2, 0),
        ('<div class="article-header"><h1>{}</h1></div><p>{}</p>', 2, 0),
        ('<p>{}</p><div id="social-impact">{}</div>', 2, 0),
        ('<p>{}</p><div class="ad">Buy</div><p>{}</p>', 2, 1),
        ('<p>{}</p><div class="site-footer"><p>Buy</p></div>', 1, 1),
        ('<aside><article>Buy</article></aside><p>{}</p>', 1, 1),
    ],
)
def test_names_of_elements(page, has, lacks):
    text = "Some words that are the text of a page and go on for a while."
    got = main_blocks("<body>" + page.replace("{}", text) + "</body>", TokenWeights())
    assert got.count(text) == has and (not lacks or "Buy" not in got)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p class='lead'>one two <img src=a> three <input> four<wbr>five</p></article>", ["one two three fourfive"]),
        ("<article><div class='post-header'>Title para</div><p class='ad-free-story'>body words here</p></article>", ["Title para", "body words here"]),
        ("<article><p>a &lt;b&gt; &amp;amp; \n\t c<br>d<hr>e</p></article>", ["a <b> &amp; c d", "e"]),
        ("<article><p>one <p>two<table><tr><td>x<td>y</table></article>", ["one", "two", "x", "y"]),
        ("<article><p>a < b and c <3 d</p><p title='x > y'>e</p></article>", ["a < b and c <3 d", "e"]),
        ("<article><h1>Head</h1><script>var a='<p>no</p>'</script><style>p{}</style><p>text</p><textarea>no</textarea></article>", ["Head", "text"]),
    ],
)
def test_blocks_of_a_page(page, want):
    body = "<nav><ul><li><a href=/>Home</a></li></ul></nav>" + page + "<footer>foot</footer>"
    assert main_blocks(body, TokenWeights.learn([body] * 3)) == want


@pytest.mark.parametrize("piece", ["<p a ", "<div>", "</x>", "<p a='", "<p a='\"", "<!--", "<", "<p class=", "<i ", "<title>", "<a href=x>w"])
def test_pages_take_linear_time(piece):
    start = time.time()
    main_blocks("<article>" + piece * (1_000_000 // len(piece)), TokenWeights())
    main_blocks("<article>" + "<div>" * 60_000 + piece * 60_000 + "</div>" * 60_000, TokenWeights())
    assert time.time() - start < 8


def test_best_run_against_brute_force():
    r = random.Random(4)
    for _ in range(400):
        steps = [(-r.choice([0.25, 0.5, 1.0, 3.0]), r.choice([-2.0, -0.5, 0.0, 0.5, 1.0, 4.0])) for _ in range(r.randint(0, 9))]
        runs = {(a, b): sum(w for _, w in steps[a:b]) + sum(t for t, _ in steps[a + 1 : b]) for a in range(len(steps)) for b in range(a + 1, len(steps) + 1)}
        best = max([0.0, *runs.values()])
        at = best_run(steps)
        assert (runs[at] == best) if best > 0 else at == (0, 0)
        if best > 0:
            assert at[1] == min(b for (a, b), v in runs.items() if v == best)


def test_html_over_all_pages(spark):
    """Every page of the small tables against its article element, read by a plain rule that fits these pages alone."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {q.page_id: (q.text, q.n_chars) for q in main_text(pages).collect()}
    assert len(got) == pages.count()
    for i, page in pages.select("page_id", "html").collect():
        body = (re.search("<article>(.*?)</article>", page or "", re.S) or [None, ""])[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", body)]
        want = "\n\n".join(x for x in parts if x)
        assert got[i] == (want, len(want))


def test_secrets(spark, docs):
    text = "é password: 'abc12' TOKEN = \"0123456789abcdef01234567\" AKIA" + "A" * 16 + " api_key=short secret: token: abcdefgh"
    assert [(k, text[a:b]) for a, b, k in base_spans(text)] == [(0, 'TOKEN = "0123456789abcdef01234567'), (2, "0123456789abcdef01234567"), (1, "AKIA" + "A" * 16)]
    net = train(n=400, epochs=2)
    df = docs.unionByName(spark.createDataFrame(rows_of([text], 900), SCHEMA))
    got = {r.doc_id: r for r in secret_scan(df, net).collect()}
    assert (got[900].n_assign, got[900].n_access, got[900].n_hex) == (1, 1, 1)
    clean = redact_rows(df, net)
    assert clean.columns == df.columns and clean.count() == df.count()
    new = clean.filter("doc_id = 900").first()
    assert "0123456789abcdef" not in new.text and new.n_chars == len(new.text)
    assert clean.filter("text is null").count() == df.filter("text is null").count()


@pytest.fixture(scope="module")
def net():
    return train()


def test_secrets_late_in_long_runs(spark, net):
    key = "ghp_Qm4Zt81LrVxK0sPdY7bHnW2cFgJu93EaTo5i"
    paths = ["/a/long/benign/path/that/goes/on/and/on/for/more/than/48/bytes/", "x=" + "some-long-benign-value-with-many-words-in-it-and-more=", "the_long_identifier_of_a_thing_that_goes_on_and_on_for_very_long_"]
    texts = [p + end for p in paths for end in (key, "harmless_word_of_the_text")]
    got = [r for r in secret_scan(spark.createDataFrame(rows_of(texts), SCHEMA), net).orderBy("doc_id").collect()]
    assert [r.n_model for r in got] == [1, 0, 1, 0, 1, 0]
    assert got[0].found == [key] and got[0].redacted == paths[0] + "[MODEL]"
    assert all(key not in r.redacted for r in got)


def test_secrets_beside_base_findings(spark, net):
    key, hexes = "ghp_Qm4Zt81LrVxK0sPdY7bHnW2cFgJu93EaTo5i", "0123456789abcdef01234567"
    texts = [f"x {hexes}-{key} y", f"ü {hexes}-{key} y", f"x {hexes}-pronounceable-words y"]
    got = secret_scan(spark.createDataFrame(rows_of(texts), SCHEMA), net).orderBy("doc_id").collect()
    assert [(r.n_hex, r.n_model) for r in got] == [(1, 1), (1, 1), (1, 0)]
    assert [r.redacted for r in got[:2]] == ["x [HEX][MODEL] y", "ü [HEX][MODEL] y"]


def test_secret_threshold_keeps_the_recall(net):
    rows, y = labelled_findings(3000, 12)  # those that the network is calibrated on
    good = net.scores(*rows_of_findings(rows))[y > 0]
    assert (good >= net.threshold).mean() >= 0.99 and (good > net.threshold).mean() < 0.99 + 1e-9


def test_secrets_of_formats_never_seen():
    """Recall on key formats, and rate of false findings, of a network that never saw those formats."""
    unseen = ("AIza", "npm", "xoxb")
    net = train(n=4000, epochs=6, formats=tuple(f for f in FORMATS if f not in unseen))
    rows, y = labelled_findings(2000, 77, unseen)
    got = net.scores(*rows_of_findings(rows)) >= net.threshold
    assert got[y > 0].mean() > 0.9 and got[y == 0].mean() < 0.01


def test_network_sees_all_of_a_candidate(net, tmp_path):
    """Equal in the first 48 bytes, and far beyond, but not after; in pieces as at once; stored and read again."""
    head = "some/path/of/words/that/is/longer/than/48/bytes/and/goes/on/"
    texts = [head + "ghp_Qm4Zt81LrVxK0sPdY7bHnW2cFgJu93EaTo5i", head + "another/path/of/words/that/goes/on/still"]
    texts += [head * 2000 + "Zq9" * 3000, head * 2000 + "abc" * 3000]
    score = []
    for t in texts:
        x, size = windows(np.frombuffer(t.encode(), np.uint8), *[np.array([v]) for v in (0, len(t), 0, len(t))])
        score.append(net.logits(x, size)[0])
        assert net._long(x[0]) == pytest.approx(score[-1], rel=1e-3) == pytest.approx(net._forward(x, size)[-1][0], rel=1e-3)
    assert score[0] != score[1] and score[2] != score[3]
    net.save(str(tmp_path / "net.npz"))
    again = CharCNN.load(str(tmp_path / "net.npz"))
    assert again.threshold == net.threshold and (again.emb == net.emb).all()


def test_network_gradient():
    """The loss falls along the gradient that fit follows."""
    rows, y = labelled_findings(64, 5)
    x, size = rows_of_findings(rows)
    net = CharCNN.fresh(1)
    loss = lambda: float(np.mean(np.log1p(np.exp(-np.where(y > 0, 1, -1) * net.logits(x, size)))))
    before = loss()
    net.fit(x, size, y, 40, 1)
    assert loss() < 0.5 * before


def test_base_spans_against_brute_force(spark):
    """The base patterns, read character by character, over all documents of the smallest table and odd texts."""

    def runs(t, ok):
        at, out = 0, []
        while at < len(t):
            end = at
            while end < len(t) and t[end] in ok:
                end += 1
            if end > at:
                out.append((at, end))
            at = end + 1 if end == at else end
        return out

    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    value = lower + lower.upper() + digits + "+/_.=-"

    def brute(t):
        out = [(a, b, "hex") for a, b in runs(t, digits + "abcdef") if b - a >= 24]
        at = 0
        while (at := t.find("AKIA", at)) >= 0:
            end = at + 4
            while end < len(t) and t[end] in lower.upper() + digits:
                end += 1
            if end > at + 4:
                out += [(at, end, "access")] if end - at >= 20 else []
                at = end
            else:
                at += 1
        low, at = "".join(c.lower() if c in lower.upper() else c for c in t), 0
        while at < len(t):
            word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at)), None)
            k = at + len(word or "")
            if word and t[k : k + 1] in ('"', "'") and t[k : k + 1]:
                k += 1
            while word and t[k : k + 1] == " ":
                k += 1
            if not word or t[k : k + 1] not in (":", "=") or not t[k : k + 1]:
                at += 1
                continue
            k += 1
            while t[k : k + 1] == " ":
                k += 1
            if t[k : k + 1] in ('"', "'") and t[k : k + 1]:
                k += 1
            end = k
            while end < len(t) and t[end] in value:
                end += 1
            if end == k:
                at += 1
                continue
            out += [(at, end, "assign")] if end - k >= 6 else []
            at = end
        order = ("assign", "access", "hex")
        return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(out, key=lambda x: (x[0], order.index(x[2]))))

    r = random.Random(9)
    parts = ["password", "Token", "api_key", "apiKEY", "é", "中", " ", "  ", ":", "=", "'", '"', "AKIA", "AKIAAKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef", "short", "x" * 7, "-", ".", "\n", "secretsecret", "tokentoken="]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    docs = spark.createDataFrame(rows_of(texts, 100_000), SCHEMA).select("doc_id", "text")
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    got = {q.doc_id: q.base for q in secret_scan(docs, CharCNN.fresh(1)).collect()}
    assert got == {i: brute(t or "") for i, t in docs.collect()}


def test_secrets_of_empty_tables_and_long_texts(spark, net):
    assert secret_scan(spark.createDataFrame([], SCHEMA), net).count() == 0 and redact_rows(spark.createDataFrame([], SCHEMA), net).count() == 0
    key = "ghp_Qm4Zt81LrVxK0sPdY7bHnW2cFgJu93EaTo5i"
    long = "wörd and more. " * 400_000 + f" key = {key} " + "token=abcdefgh " * 20_000
    start = time.time()
    got = secret_scan(spark.createDataFrame(rows_of([long]), SCHEMA), net).first()
    assert got.n_assign == 20_000 and key in got.found and time.time() - start < 90


def test_suffix_array_by_lyndon_groups():
    r = random.Random(5)
    for n in range(120):
        s = bytes(r.choice(b"ab" if n % 2 else b"abcd") for _ in range(r.randint(0, 70))) * (1 + n % 3)
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("length", [100, 24, 12])
def test_suffix_dedup(spark, docs, length):
    rows = sorted((i if i is not None else 1 << 62, (t or "").encode()) for i, t in docs.filter("doc_id <> 7 or doc_id is null").select("doc_id", "text").collect())
    seen, want = set(), {}
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(b[k : k + length])
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = suffix_dedup(docs.filter("doc_id <> 7 or doc_id is null"), length, hot_least=4).collect()
    assert {r.doc_id if r.doc_id is not None else 1 << 62: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert suffix_dedup(docs.limit(0)).count() == 0


def test_license_scan(spark):
    files = [(1, "a/LICENSE", "some words\nReleased under the MIT License.\nmore"), (2, "a/b/c.txt", "nothing here"), (3, "a/b/LICENSE", None), (4, "d/e.txt", "Licensed under CC BY-NC 4.0."), (5, "d/f.txt", ""), (6, None, "x"), (None, "a/x", "y")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.depth) for r in license_scan(df).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", 1), 3: ("MIT", "inherited", 1), 4: ("CC-BY-NC-4.0", "own", None), 5: (None, "none", None), 6: (None, "none", None), None: ("MIT", "inherited", 0)}
    assert license_scan(df.limit(0)).count() == 0


MIT_FILE = """The MIT License (MIT)

Copyright (c) 2019 A. Person and others

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""


@pytest.mark.parametrize(
    "path, text, license",
    [
        ("a.txt", "MIT License", "MIT"),
        ("a.txt", "This project is licensed under the MIT License.", "MIT"),
        ("a.txt", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-3.0"),
        ("a.txt", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "GPL-2.0"),
        ("a.py", "# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"),
        ("a.py", "# Licensed under the Apache\n# License, Version 2.0\nimport os", "Apache-2.0"),
        ("LICENSE-MIT", MIT_FILE, "MIT"),
        ("a.txt", MIT_FILE.split("\n", 4)[4], "MIT"),
        ("a.txt", "Licensed under the Other License, Version 2.0.", None),
        ("a.txt", "mit\nthe isc\ngnu", None),
        ("a.txt", "Licensed under CC BY-NC-ND 4.0.", None),
    ],
)
def test_license_templates(path, text, license):
    from weftlink.llm.license_scan import _FILE, Templates

    assert Templates(0.8).scan(text, bool(_FILE.match(path.lower())))[0] == license


def test_license_file_names(spark):
    files = [(1, "a/LICENSE-MIT", MIT_FILE), (2, "a/x.c", "int x;"), (3, "b/license.py", MIT_FILE), (4, "b/x.c", "int x;")]
    got = {r.doc_id: (r.license, r.origin) for r in license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("MIT", "own"), 4: (None, "none")}


def test_license_scan_does_not_depend_on_the_table(spark):
    texts = ["This file is licensed under the Apache License, Version 2.0.", "Our project is licensed under the Apache License, Version 2.0."]
    files = [(i, f"d/{i}.txt", t) for i, t in enumerate(texts)] + [(2 + i, f"d/{2 + i}.txt", "this file and our project") for i in range(98)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    much = df.crossJoin(spark.range(200).select("id")).drop("id")
    own = lambda x: {(r.doc_id, r.own_license, r.own_score) for r in license_scan(x).collect()}
    got = own(df)
    assert got == own(much) and {r[1] for r in got if r[0] < 2} == {"Apache-2.0"} and {r[1] for r in got if r[0] > 1} == {None}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
    n = docs.agg(F.count("*")).first()[0]
    assert 0 < corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").distinct().count() < n
