"""Unigram models built by hand, licence texts and inheritance by brute force, long texts, and the pipeline's stages."""

import hashlib
import os
import random
import struct
import zlib
from collections import Counter
from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.llm import exact_dedup, shingle_join
from weftlink.llm.license_scan import LICENSE_FILE, TEMPLATES, Templates, license_scan, words
from weftlink.llm.packing import pack
from weftlink.llm.quality import RuleEnsemble, fit_quality, keep_good
from weftlink.llm.queries import tokenizer_path
from weftlink.llm.secret_scan import redact_rows, secret_scan, train
from weftlink.llm.sentencepiece_codec import SPACE, PieceCodec, decode_ids, piece_codec
from weftlink.llm.shared import work_dir
from weftlink.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, wl_id string"


def rows_of(texts, first=1):
    return [(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in enumerate(texts, first)]


def _message(*fields):
    """A protobuf message of (number, value) fields: ints as varints, floats as 32 bits, the rest by length."""

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    out = b""
    for number, v in fields:
        if isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(number << 3) + varint(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += varint(number << 3 | 2) + varint(len(v)) + v
    return out


def model_file(byte_fallback=True, user=(), one_space=True, kind=1):
    r = random.Random(2)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((u, 0.0, 4) for u in user)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    seen = {SPACE} | set("abcdefgh")
    for _ in range(400):
        seen.add(r.choice(["", SPACE]) + "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))))
    pieces += [(p, -r.uniform(2, 12), 1) for p in sorted(seen)]  # no two ways to cut a text are equally good
    trainer = _message((3, kind), (35, int(byte_fallback)))
    normal = _message((1, "identity"), (3, 1), (4, int(one_space)), (5, 1))
    return _message(*((1, _message((1, p), (2, s), (3, k))) for p, s, k in pieces), (2, trainer), (3, normal))


@pytest.mark.parametrize("byte_fallback, user, one_space", [(True, (), True), (False, (), True), (True, ("[X]",), True), (True, (), False)])
def test_unigram_model(spark, byte_fallback, user, one_space):
    """Scores, normaliser, byte fallback and user pieces of a unigram file, against the sentencepiece library."""
    import sentencepiece

    data, r = model_file(byte_fallback, user, one_space), random.Random(3)
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    parts = [*"abcdefgh", " ", " ", "  ", "z", "é", "中", *user]
    texts = ["", "a", " ", "abc  def ", *("".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(300))]
    codec = PieceCodec(data)
    assert [x.tolist() for x in codec.encode(texts)] == other.encode(texts)
    got = piece_codec(spark.createDataFrame(rows_of([*texts, None]), SCHEMA), data).collect()
    assert all(q.parity for q in got) and all(q.ids_crc32 == zlib.crc32(bytes(q.ids)) for q in got)
    if byte_fallback and not one_space:
        assert all(q.round_trip for q in got)


def test_decode_ids(spark):
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    texts = ["", "one  two", "中 😀\n", " lead", None, "word " * 50_000]
    got = piece_codec(spark.createDataFrame(rows_of(texts), SCHEMA), data)
    back = {q.doc_id: q.text for q in decode_ids(got, data).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts, 1)}
    assert decode_ids(got.limit(0), data).count() == 0 and piece_codec(got.limit(0).select("doc_id", F.lit("x").alias("text")), data).count() == 0
    assert decode_ids(got.select("doc_id", F.lit(None).cast("binary").alias("ids")), data).filter("text <> ''").count() == 0


COMMON = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "Artistic": None, "GFDL-1.3": None}


@pytest.mark.parametrize("name", sorted(COMMON))
def test_whole_licence_texts(name):
    """The licence texts that Linux distributions install, where this machine has them."""
    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("not installed")
    with open(path) as f:
        assert Templates(0.8).scan(f.read(), True)[0] == COMMON[name]


def test_wrapped_headers():
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    for width in (5, 9, 14):
        w = header.split()
        text = "".join(f" * {' '.join(w[k : k + width])}\n" for k in range(0, len(w), width))
        assert Templates(0.8).scan("/*\n" + text + " */\nint main() {}\n" * 20, False)[0] == "GPL-3.0"


def test_cosine_against_brute_force():
    """Every run of lines that a template's length allows, compared with every template by the plain formula."""
    t, r = Templates(0.8), random.Random(5)
    held = Counter(w for texts in TEMPLATES.values() for w in {w for x in texts for w in words(x)})
    idf = lambda w: log((1 + len(TEMPLATES)) / (1 + held[w])) + 1 if w in held else log(2) + 1

    def brute(text):
        lines = [x for x in map(words, text.split("\n")) if x]
        best = 0.0
        for name, texts in TEMPLATES.items():
            for x in texts:
                v = Counter(words(x))
                most, size = 2 * v.total() + 16, sqrt(sum((k * idf(w)) ** 2 for w, k in v.items()))
                for a in range(len(lines)):
                    for b in range(a + 1, len(lines) + 1):
                        if b > a + 1 and sum(map(len, lines[a:b])) > most:
                            break
                        c = Counter(w for line in lines[a:b] for w in line)
                        if all(not g.isdisjoint(c) for g in t.marks[name]) and t.others[name].isdisjoint(c):
                            dot = sum(n * v[w] * idf(w) ** 2 for w, n in c.items())
                            best = max(best, dot / size / sqrt(sum((n * idf(w)) ** 2 for w, n in c.items())))
        return best

    short = [x for texts in TEMPLATES.values() for x in texts if len(words(x)) < 20]
    for _ in range(60):
        lines = []
        for _ in range(r.randint(1, 4)):
            w = r.choice(short).split() if r.random() < 0.6 else [r.choice(["some", "code", "for", "license", "the"]) for _ in range(4)]
            w = [x for x in w if r.random() < 0.9]
            cut = r.randint(0, len(w))
            lines += [" ".join(w[:cut]), " ".join(w[cut:])]
        text = "\n".join(lines)
        want, (name, got) = brute(text), t.scan(text, False)
        assert (name is not None) == (want >= 0.8 - 1e-9) and (name is None or got == pytest.approx(want, abs=1e-8))


def test_inheritance_against_brute_force(spark):
    r = random.Random(8)
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "nothing", "", None]
    files = []
    for i in range(250):
        folder = "/".join(r.choice("abc") for _ in range(r.randint(0, 4)))
        name = r.choice(["LICENSE", "x.c", "y.txt", "COPYING"])
        files.append((i if r.random() < 0.97 else None, (folder + "/" if folder else r.choice(["", "/"])) + name, r.choice(notices), "clash", "clash"))
    files += [(900, None, notices[0], "", ""), (901, "", notices[1], "", "")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string, license string, wl_dir string")
    import re

    t, grants = Templates(0.8), {}
    own = [t.scan(x or "", bool(p) and bool(re.match(LICENSE_FILE, p.strip("/").rsplit("/", 1)[-1].lower()))) for _, p, x, _, _ in files]
    for (_, p, _, _, _), (name, score) in zip(files, own, strict=True):
        parts = (p or "").strip("/").split("/")
        if p is not None and name and re.match(LICENSE_FILE, parts[-1].lower()):
            at = "/".join(parts[:-1])
            grants[at] = min(grants.get(at, (0, "~")), (-score, name))
    want = []
    for (i, p, _, _, _), (name, _) in zip(files, own, strict=True):
        if name:
            want.append((i, name, "own", None))
            continue
        parts = (p or "").strip("/").split("/")[:-1]
        found = next(((k, grants["/".join(parts[: len(parts) - k])][1]) for k in range(len(parts) + 1) if "/".join(parts[: len(parts) - k]) in grants), None) if p not in (None, "", "/") else None
        want.append((i, found[1], "inherited", found[0]) if found else (i, None, "none", None))
    got = [(q.doc_id, q.license, q.origin, q.depth) for q in license_scan(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_ties_between_templates():
    """Of equal cosines the longer template stands, then the first by name."""
    t = Templates(0.8, {"B": ("one two three",), "A": ("one two three",), "C": ("one two three four",)})
    assert t.scan("one two three", False)[0] == "A" and t.scan("one two three four", False)[0] == "C"


def test_long_texts(spark):
    """Texts over the slices' sizes (2 to 6 MB), beside short, empty and null ones."""
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    long = " ".join(r.choice(vocabulary) for _ in range(1_300_000))
    assert len(long) > 6 << 20
    texts = [long, "short text", None, "", long + " tail", long.upper(), long[1000:4000]]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = {q.doc_id: q for q in exact_dedup.exact_dedup(docs).collect()}
    assert [got[i].keep_id for i in range(1, 8)] == [6, 2, 4, 4, 5, 6, 7] and got[1].text_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert {q.doc_id: (q.n_links, q.class_id) for q in shingle_join.shingle_join(docs).collect()} == {1: (2, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (2, 1), 6: (2, 1), 7: (0, 7)}
    s = {q.doc_id: q for q in suffix_dedup(docs.select("doc_id", "text")).collect()}
    assert s[1].n_removed < 1000 and s[5].n_removed == len(long) and s[5].n_bytes == len(long) + 5 and s[7].n_removed == 3000 and s[6].n_removed < 1000
    assert bytes(s[5].kept) == b" tail" and s[7].n_spans == 1
    model = RuleEnsemble([((0, True, 1e6),)], [5.0], -2.0)
    assert sorted(q.doc_id for q in keep_good(docs, model, 0.5).select("doc_id").collect()) == [1, 5, 6]
    assert secret_scan(docs, train(n=200, epochs=1)).count() == len(texts)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and out.columns == empty.columns


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage's rows on a small table with nulls, repeats, odd columns and clashing names, by plain Python."""
    import corpus_pipeline

    src = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{src}/documents.parquet").filter("doc_id < 260")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (None, "a null id and a few words"), (9003, "token = abcdefgh12 and so on"), (5, "a repeated id")], "doc_id long, text string")
    odd = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars"))
    docs = docs.unionByName(odd).unionByName(docs.limit(3)).withColumn("wl_gone", F.lit("x")).withColumn("kept", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{src}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    every = texts(docs)

    good = stages["quality"](spark, docs, str(tmp_path))
    model = fit_quality(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    from weftlink.llm.quality import quality_scores

    low = Counter(r.doc_id for r in quality_scores(docs, model).filter("predicted = 0").collect())
    assert len(texts(good)) == len(every) - low.total() and good.columns == docs.columns

    exact, groups = stages["exact"](spark, docs, ""), {}
    for i, t in every:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    kept = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert sorted(map(str, ((i, (t or "").encode().lower()) for i, t in texts(exact)))) == sorted(map(str, ((i, t) for t, i in kept.items())))

    rows = [(i, t) for i, t in texts(exact)]
    near = stages["near"](spark, exact, "")
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    cls = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and rows[a][0] is not None and rows[b][0] is not None and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = cls[a], cls[b]
                cls = [new if c == old else c for c in cls]
    gone = {i for k, (i, _) in enumerate(rows) if i is not None and i != min(rows[m][0] for m in range(len(rows)) if cls[m] == cls[k])}
    assert [r for r in rows if r[0] not in gone] == texts(near)

    clean = stages["secrets"](spark, near, "")
    assert [i for i, _ in texts(clean)] == [i for i, _ in texts(near)] and not [t for _, t in texts(clean) if t and "abcdefgh12" in t]
    found = {(q.doc_id, q.redacted) for q in secret_scan(near).collect()}
    assert {(i, t or "") for i, t in texts(clean)} == found

    from tokenizers import Tokenizer

    tok, ids = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), {}
    for q in sorted(stages["packing"](spark, clean, "").collect(), key=lambda q: q.start):
        ids.setdefault(q.doc_id, []).extend(np.frombuffer(q.ids, "<u4").tolist())
    assert [i for i, _ in texts(clean)].count(5) == 2  # two texts of one id: their pieces interleave
    assert {**ids, 5: 0} == {**{i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts(clean)}, 5: 0}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < whole.select("doc_id").distinct().count() <= len(every) and whole.agg(F.count_distinct(F.struct("sequence_id", "offset")) == F.count("*")).first()[0]


def test_clashing_columns(spark):
    """Extra columns named as results or as helpers."""
    docs = spark.createDataFrame([(1, "one two three", "a", "b", "c"), (2, None, "a", "b", "c")], "doc_id long, text string, ids string, wl_gone string, n_words string")
    assert shingle_join.keep_one(docs).count() == 2 and exact_dedup.keep_one(docs).columns == docs.columns
    assert pack(docs, tokenizer_path("byte_bpe_50k.json")).count() == 2 and redact_rows(docs).columns == docs.columns
    assert keep_good(docs, RuleEnsemble(), 0.1).columns == docs.columns


def test_work_dir_is_the_cluster_s(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default

    class Elsewhere:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        work_dir(Elsewhere())
    assert work_dir(spark)
