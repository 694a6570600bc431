"""Each operator against a plain version, over nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat_format, decontaminate, line_dedup, media_flac, mixing, near_dup, queries, suffix_array, suffix_dedup, token_output, toxicity, warc

CLASH = "doc_id long, text string, source string, _id long, _key string, start long, media string"
g = random.Random(4)
VOCAB = ["".join(g.choices("abcdefghij", k=g.randint(2, 7))) for _ in range(300)]
say = lambda n: " ".join(g.choices(VOCAB, k=n))
LONG, PASSAGE = say(4000), say(70)
BASE = say(150).split()
TEXTS = [
    None, "", "   \n ", "one", LONG, LONG, f"{PASSAGE} {say(30)}", f"{say(20)} {PASSAGE}", f"{say(5)} {PASSAGE} x", " ".join(BASE), " ".join(BASE[:140] + ["neu"] + BASE[141:]), " ".join(BASE[:60]) + " " + say(90), "a b", "A  B",
    "line one\nline two\nline three\nline four\nline five\nline six", "new\nline one\nline two\nline three\nline four\nline five\nline six", "é" * 300, "<|endoftext|> x", "z" * 900,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 3}" if k % 5 else None, 7, "k", 1, "m") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, PASSAGE, "s1", 7, "k", 1, "m"), rows[6]], CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def test_empty_tables(spark, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    assert token_output.encode_documents(empty, queries.tokenizer_path()).count() == 0
    assert mixing.mix(empty).count() == 0
    assert media_flac.media_round_trip(empty).count() == 0
    assert suffix_dedup.repeat_digests(empty).count() == 0
    assert decontaminate.contamination_digests(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert near_dup.near_duplicates(empty).count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert toxicity.score_documents(empty, toxicity.Network()).count() == 0
    assert chat_format.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_line_dedup(docs):
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[14]["n_removed"] == 0 and out[14]["text"] == TEXTS[14]
    kept, whole = out[15]["text"].split("\n"), TEXTS[15].split("\n")
    assert len(whole) - len(kept) == out[15]["n_removed"] and all(x in whole for x in kept)
    assert out[0]["n_lines"] == 1 and out[0]["text"] == ""


def test_tokens(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = token_output.encode_documents(docs, queries.tokenizer_path()).orderBy("start").collect()
    at = 0
    assert len(rows) == docs.count()
    for r in rows:
        text = PASSAGE if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_file_layout(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    for encoding in ("dictionary", "delta"):
        token_output.write_tokens(docs, f"{tmp_path}/{encoding}", queries.tokenizer_path(), encoding=encoding)
        for f in (tmp_path / encoding).glob("part-*.parquet"):
            meta = pq.ParquetFile(f).metadata
            column = meta.row_group(0).column(4)
            assert column.has_offset_index and any(("DICT" if encoding == "dictionary" else "DELTA") in e for e in column.encodings)


def test_chat(spark):
    rows = [(1, 0, "user", "a & <|turn|> </s>"), (1, 1, "assistant", "&lt; [INST] b"), (1, 1, "assistant", "&lt; [INST] b"), (2, 0, None, None), (None, None, "user", "x")]
    out = {r["conv_id"]: r for r in chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    told = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3])
    assert out[1]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and out[1]["n_turns"] == 3 and out[1]["loss_chars"] == 2 * len(rows[1][3])
    assert out[2]["n_turns"] == 1 and out[None]["n_turns"] == 1
    log = [(1, "m0", 0, 0, "message", "user", "hi"), (1, "m1", 1, 1, "start", "assistant", None), (1, "m1", 1, 2, "delta", "", "Hel"), (1, "m1", 1, 3, "delta", "", "lo"), (1, "m2", 2, 4, "message", "user", "gone"), (1, "m1", 1, 5, "regenerate", "", None), (1, "m1", 1, 6, "delta", "", "Hey"), (1, "m0", 0, 7, "edit", "", "hi!"), (1, "m3", 2, 8, "message", "user", "bye"), (1, "m4", 3, 9, "message", "user", "x"), (1, "m4", 3, 10, "delete", "", None)]
    folded = chat_format.fold_log(spark.createDataFrame(log, chat_format.LOG))[0].orderBy("turn").collect()
    assert [(r["turn"], r["role"], r["text"]) for r in folded] == [(0, "user", "hi!"), (1, "assistant", "Hey"), (2, "user", "bye")]


def test_flac(docs):
    odd = [bytes(64), b"\xff" * 128, bytes(g.choices(range(256), k=64 * 70)), bytes(range(256)) * 20, bytes(128) + b"\xff" * 64 * 40]
    assert media_flac.decode(media_flac.encode(odd)) == odd
    broken = bytearray(media_flac.encode(odd)[2])
    broken[-9] ^= 4
    with pytest.raises(ValueError):
        media_flac.decode([bytes(broken)])
    for r in media_flac.media_round_trip(docs).collect():
        p = media_flac.padded((PASSAGE if r["doc_id"] is None else TEXTS[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) and len(p) % 64 == 0


def test_mixing(spark, docs):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"))
    out = mixing.mix(many, {"big": 1.0, "small": 3.0}, target_rows=8000, seed=2)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 250 and abs(n["small"] - 6000) < 400
    assert [r[0] for r in out.select("_mix_key").collect()] == sorted(r[0] for r in out.select("_mix_key").collect())
    huge = mixing.mix(many.where("doc_id < 3"), target_rows=900, seed=2)
    assert abs(huge.count() - 900) < 200
    assert set(mixing.mix(docs).columns) == {*docs.columns, "_copy", "_mix_key"}


def test_suffix_array():
    r = np.random.default_rng(0)
    for x in (b"mississippi", b"abc" * 50, b"a" * 90, bytes(r.integers(0, 3, 200, dtype=np.uint8)), bytes(r.integers(0, 256, 300, dtype=np.uint8))):
        t = np.frombuffer(x, np.uint8)
        assert suffix_array.suffix_array(t, 1000, "/tmp", 64).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_dedup(docs):
    got = sorted((str(r["doc_id"]), tuple(r)[1:]) for r in suffix_dedup.repeat_digests(docs, 64).collect())
    plain = brute.repeats({**dict(enumerate(TEXTS)), "again": TEXTS[6], "None": PASSAGE}, 64)
    assert got == sorted(("6" if d == "again" else str(d), v) for d, v in plain.items())
    assert sum(v[1] for v in plain.values()) > 1000


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_hot_anchor(spark, monkeypatch, rounds):
    """A short string in unlike contexts, and strings repeated beside it: keys stay bounded and results are those of brute force."""
    rng = random.Random(rounds)
    letters = lambda n: "".join(rng.choices("abcdef ", k=n))
    common, tails = letters(50), [letters(60) for _ in range(5)]
    texts = {d: letters(90) + common + (rng.choice(tails) if d % 2 else letters(60)) + letters(40) for d in range(120)}
    texts |= {200: texts[3], 201: texts[5] + texts[6], 202: common * 3, 203: None, 204: "é" * 90}
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "FINER_ROUNDS", rounds)
    shards, sort = [], suffix_dedup.sort_shards

    def spy(contexts, length, folder):
        shards.extend(contexts.groupBy("_h").agg(F.sum(F.length("_c")).alias("b"), F.count("_c").alias("n")).collect())
        return sort(contexts, length, folder)

    monkeypatch.setattr(suffix_dedup, "sort_shards", spy)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeat_digests(rows, 64).collect()}
    assert got == brute.repeats(texts, 64)
    assert sum(v[1] for v in got.values()) > 5000 and all(r["b"] <= 1500 or r["n"] == 1 for r in shards)


@pytest.mark.parametrize("size", [(1 << 24) - 1_900_001, (1 << 24) - 100_000, suffix_dedup.CHUNK, suffix_dedup.CHUNK + 1, 1 << 24])
def test_anchors_of_long_texts(size):
    """A passage at the end of a long text behind others in a batch has the anchors that it has alone."""
    passage, r = hashlib.shake_128(b"p").digest(400), np.random.default_rng(size)
    texts = [r.integers(0, 256, 1_900_000, dtype=np.uint8).tobytes(), r.integers(0, 256, size - 400, dtype=np.uint8).tobytes() + passage, b"", passage]
    found = {1: set(), 3: set()}
    for row, run, at in suffix_dedup.text_runs(texts):
        assert sum(map(len, run)) <= suffix_dedup.CHUNK
        bounds = np.cumsum([0, *map(len, run)])
        doc, first, last, _, h = suffix_dedup.anchors(np.frombuffer(b"".join(run), np.uint8), bounds, 200)
        for d in found:
            here = (row + doc == d) & (last - bounds[doc] + at >= len(texts[d]) - 400)
            found[d] |= set(h[here].tolist())
    assert found[3] and found[1] == found[3]


def test_decontaminate(spark, docs):
    items = [(1, " ".join(PASSAGE.split()[10:40])), (2, "A b"), (3, None), (4, ""), (5, say(13))]
    out = {r["doc_id"]: r for r in decontaminate.contamination_digests(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    for d, t in enumerate(TEXTS):
        w, marked, who = words(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if k + n <= len(w) and (owners := windows.get(tuple(w[k : k + n]))):
                    marked.update(range(k, k + n))
                    who |= owners
        want = (len(w), len(marked), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(marked) and 20 * len(marked) >= len(w))
        assert tuple(out[d])[1:] == want


def test_warc(spark):
    inner = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(1, "u", inner * 3), (2, "u", ""), (3, None, None), (4, "a\r\nb", "x" * 9000), (5, "u", inner * 3), (6, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\n"), (None, "u", "lone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = warc.new_path(spark, "warc")
    warc.write_warc(df, path)
    for split in (500, 1 << 20):
        out = {r["page_id"]: r for r in warc.read_warc(spark, path, split).collect()}
        assert len(out) == len(pages)
        assert [(k, out[k]["record_type"], out[k]["refers_to"]) for k in (1, 2, 3, 5)] == [(1, "response", None), (2, "response", None), (3, "revisit", 2), (5, "revisit", 1)]
        assert all(out[k]["payload_bytes"] == len((h or "").encode()) for k, _, h in pages)


def test_warc_long_url(spark):
    """Headers of any length are read, also over several splits, and beside magic that no header follows."""
    pages = [(1, "u" * 70_000, "a"), (2, "v" * 300_000, ""), (3, "w", "WARC/1.1\r\n" * 9000), (4, "é" * 65_000, "b" * 5000), (5, "x", "WARC/1.1\r\nContent-Length: 7\r\nA: " + "y" * 90_000)]
    path = warc.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    for split in (5000, 1 << 20):
        out = {r["page_id"]: (r["payload_bytes"], r["record_type"]) for r in warc.read_warc(spark, path, split).collect()}
        assert out == {k: (len(h), "response") for k, _, h in pages}


def test_near_duplicates(docs):
    out = {r["doc_id"]: r for r in near_dup.near_duplicates(docs, shingle=2).collect()}
    sets = []
    for t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set()))
    for d, s in enumerate(sets):
        assert out[d]["n_shingles"] == len(s)
        direct = [e for e, o in enumerate(sets) if s and o and 100 * len(s & o) >= 80 * len(s | o)]
        assert out[d]["component_id"] == min(direct, default=d)
    assert out[None]["kept"] and out[None]["component_id"] is None


def test_components(spark):
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95)]
    got = {r[0]: r[1] for r in near_dup.components(spark.createDataFrame(pairs, "_x long, _y long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((90, 95, 100), 90)}

def test_components_of_random_links(spark):
    """Repeated links, links in either direction and with oneself, and no links at all."""
    rng = random.Random(5)
    for n, m in ((60, 45), (40, 80), (9, 0)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] * 2
        least = list(range(n))
        for _ in range(n):
            for x, y in pairs:
                least[x] = least[y] = min(least[x], least[y])
        linked = {v for x, y in pairs if x != y for v in (x, y)}
        links = spark.createDataFrame(pairs, "_x long, _y long")
        assert {r[0]: r[1] for r in near_dup.components(links).collect()} == {v: least[v] for v in linked}
        first = near_dup.components(links.where("_x % 2 = 0"))
        assert {r[0]: r[1] for r in near_dup.merged(first, links.where("_x % 2 = 1")).collect()} == {v: least[v] for v in linked}


def test_toxicity(spark):
    bad = ["grimwort", "foulest", "slimeball"]
    clean = [say(40) for _ in range(160)]
    toxic = [f"{say(20)} {g.choice(bad)} {say(15)}" for _ in range(80)]
    net = toxicity.train(clean[:120] + toxic[:60], [0] * 120 + [1] * 60)
    s = net.scores(clean[120:] + toxic[60:])
    assert ((s >= 0.3) == np.array([0] * 40 + [1] * 20)).mean() > 0.9
    df = spark.createDataFrame([(1, None), (None, ""), (1, LONG)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_documents(df, net).collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, out = docs, None
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, sf).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "token_output":
            assert out.columns == docs.columns and out.select("doc_id").subtract(kept.select("doc_id")).count() == 0
            assert name == "source_mixing" or out.count() <= kept.count()
            kept = out
    assert out.count() == kept.count()


def test_pipeline_stages_keep_what_plain_versions_keep(spark, tmp_path):
    import corpus_pipeline as c

    rng, bad = random.Random(9), ["grimwort", "foulest", "slimeball"]
    words = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    passage = [words(30) for _ in range(3)]
    texts = [words(rng.randint(30, 90)) for _ in range(150)]
    for t in texts[:50]:
        t[rng.randrange(len(t))] = rng.choice(bad)
    base = words(100)
    for k in range(12):  # near copies: some above, some below four fifths
        near = list(base)
        for _ in range(k // 2):
            near[rng.randrange(100)] = f"n{k}"
        texts.append(near)
    texts += [list(base), words(3), [], passage[0] + words(10), words(20) + passage[1][:13] + words(20), words(300) + passage[2][:13], words(20) + passage[2][:12] + words(9)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(len(texts), None), (None, "lone text")]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, int(k < 50)) for k in range(150)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = lambda stage: sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, sf).collect()), key=str)
    split = [(d, t, (t or "").split()) for d, t in rows]

    net = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    worst = lambda w: max(net.scores([" ".join(w[a : a + 24]) for a in range(0, max(1, len(w) - 12), 12)]))
    clean = sorted(((d, t) for d, t, w in split if worst(w) < 0.3), key=str)
    assert kept(c.toxicity_stage) == clean and 90 < len(clean) < 160

    sets = [({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())) for _, _, w in split]
    root = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j in range(i):
                if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in range(len(root))):
            break
    single = sorted(((d, t) for k, (d, t, _) in enumerate(split) if root[k] == k), key=str)
    assert kept(c.near_dup_stage) == single and len(single) < len(rows) - 3

    windows = {tuple(p[k : k + 13]) for p in passage for k in range(len(p) - 12)}
    clear = []
    for d, t, w in split:
        marked = {i for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for i in range(k, k + 13)}
        if not (marked and 20 * len(marked) >= len(w)):
            clear.append((d, t))
    assert kept(c.decontamination_stage) == sorted(clear, key=str) and len(clear) == len(rows) - 2


@pytest.mark.parametrize("edits", [(0, 5), (3, 7), (5, 6)])
def test_links_across_components_are_all_real_links(spark, edits):
    """Families of near copies around a base that is there or not: components and links are those of brute force."""
    rng = random.Random(sum(edits))
    texts = []
    for family in range(3):
        base = [f"f{family}w{rng.randrange(40)}" for _ in range(70)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(*edits)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(30 if rng.random() < 0.5 else 10**9)}"
            texts.append(" ".join(words))
    sets = [{*zip(t.split(), t.split()[1:])} for t in texts]
    real = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    rows = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    apart = spark.range(len(texts)).selectExpr("explode(array(id div 25, 3 + id % 3)) AS _key", "id AS _id", "id AS _c")
    found = {(max(r), min(r)) for r in near_dup.cross_links(apart, rows, 2, 80).collect()}
    assert found <= real
    root = list(range(len(sets)))
    whole = list(range(len(sets)))
    for parents, pairs in ((root, found), (whole, real)):
        for _ in sets:
            for i, j in pairs:
                parents[i] = parents[j] = min(parents[i], parents[j])
    assert root == whole
