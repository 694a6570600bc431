"""The inner workings of operators against plain versions: event folds, replication, the network, blocks of a query set."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat_format, decontaminate, media_flac, mixing, queries, toxicity

WORDS = [f"w{k}" for k in range(200)]


def random_log(rng: random.Random) -> list[tuple]:
    log, seq = [], 0
    for conv in (1, 2, None):
        made = []
        for turn in range(40):
            for copy in range(rng.choice([1, 1, 2])):
                name = f"{conv}-{turn}-{copy}"
                made.append((name, turn))
                log.append((conv, name, turn, seq, "start", rng.choice(["user", "assistant"]), None))
                seq += 1
                for _ in range(rng.randint(0, 3)):
                    log.append((conv, name, turn, seq, "delta", "", rng.choice(["a", "b\n", "<|", None])))
                    seq += 1
            if rng.random() < 0.3:
                name, turn = rng.choice(made[-6:])
                log.append((conv, name, turn, seq, rng.choice(["regenerate", "regenerate", "edit", "delete", "odd"]), "", rng.choice([None, "new"])))
                seq += 1
    return log


def plain_fold(log: list[tuple]) -> list[tuple]:
    state: dict = {}
    for conv, name, turn, seq, kind, role, text in sorted(log, key=lambda r: r[3]):
        m = state.setdefault((conv, name), {"turn": turn, "born": seq, "role": "", "text": "", "live": True, "cut": []})
        if kind == "odd":
            continue
        m["role"], m["live"] = role or m["role"], kind != "delete"
        if kind in ("start", "regenerate"):
            m["text"] = ""
        elif kind == "edit":
            m["text"] = text or ""
        elif kind == "delta":
            m["text"] += text or ""
        if kind == "regenerate":
            m["cut"].append(seq)
    gone = {k for k, m in state.items() for (conv, _), o in state.items() if conv == k[0] and o["turn"] < m["turn"] and any(c > m["born"] for c in o["cut"])}
    return sorted((str(k[0]), m["turn"], m["role"], m["text"]) for k, m in state.items() if m["live"] and k not in gone)


@pytest.mark.parametrize("seed", [1, 2])
def test_logs_fold_like_a_plain_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(chat_format, "CUT_TURNS", 7)
    log = random_log(random.Random(seed))
    table = spark.createDataFrame(log, chat_format.LOG).orderBy(F.rand(seed)).repartition(5)
    got = sorted((str(r["conv_id"]), r["turn"], r["role"], r["text"]) for r in chat_format.fold_log(table)[0].collect())
    assert got == plain_fold(log) and len(got) < len({r[1] for r in log})


def test_every_kind_of_event_counts(spark, tmp_path):
    """The query's log holds deltas, edits and regenerations; leaving one kind out of the fold changes the digests."""
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} é &") for t in range(6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat_format.log_of_turns(turns)
    assert {r[0] for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
    digest = lambda part, name: chat_format.chat_digests(chat_format.format_log(part, f"{tmp_path}/log-{name}")).first()["turns_sha256"]
    assert digest(log, "all") == chat_format.format_turns(turns).first()["turns_sha256"]
    assert len({digest(log.where(f"kind <> '{k}'"), k) for k in ("", "start", "delta", "edit", "regenerate")}) == 5


def test_roles_with_line_ends_come_back():
    for role, text in (("assistant\nx", "hi"), ("a&#10;b", "&amp;\n"), ("", "\n\n")):
        safe = role.replace("&", "&amp;").replace("\n", chat_format.NEW_LINE)
        assert chat_format.parse(f"{chat_format.OPEN}{safe}\n{text.replace('&', '&amp;')}{chat_format.CLOSE}") == (role, text)


def test_rendered_roles_come_back(spark):
    rows = [(1, 0, "assistant\nx", "hi\n"), (1, 1, "<|turn|>", "a&#10;b")]
    out = chat_format.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(chat_format.parse(r["rendered"]) for r in out) == sorted((r[2], r[3]) for r in rows)


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["_n", "_parts", "_cdf", "_source", "_salt", "_s", "_used", "_row", "_ident", "_own", "a.b"]
    rows = [(k, "t", "s", *range(700, 700 + len(names))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = mixing.mix(docs, target_rows=900)
    assert out.columns == [*docs.columns, "_copy", "_mix_key"] and 700 < out.count() < 1100
    assert [tuple(r) for r in out.select(*(f"`{n}`" for n in names)).distinct().collect()] == [tuple(range(700, 700 + len(names)))]


def test_mixing_draws_rows_without_id_one_by_one(spark):
    docs = spark.createDataFrame([(None, "same", "s")] * 1000 + [(k, "x", None) for k in range(1000)], "doc_id long, text string, source string")
    out = mixing.mix(docs, {"s": 3.0}, target_rows=4000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["s"] - 3000) < 250 and abs(n[None] - 1000) < 150
    keys = [r[0] for r in out.select("_mix_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_mixing_over_many_sources(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'t' AS text", "IF(id % 7 = 0, NULL, concat('s', id % 7)) AS source")
    few = sorted(map(tuple, mixing.mix(docs, {"s1": 5.0}).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs, {"s1": 5.0}).collect()), key=str) == few


def test_poisson_counts_have_their_mean_and_variance(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'s' AS source")
    n = {r["doc_id"]: r["count"] for r in mixing.mix(docs, target_rows=50_000).groupBy("doc_id").count().collect()}
    x = np.array([n.get(k, 0) for k in range(20_000)])
    assert abs(x.mean() - 2.5) < 0.05 and abs(x.var() - 2.5) < 0.15


def plain_logit(net: toxicity.Network, words: list[str]) -> float:
    """One window, a number at a time."""
    p, h = net.p, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    buckets, grams, n = toxicity.word_features([w.encode() for w in words])
    at, emb = 0, []
    for k in range(len(words)):
        own = grams[at : at + n[k]]
        at += n[k]
        chars = p["char"][own].astype(float).sum(0) / np.sqrt(n[k])
        emb.append(np.concatenate([p["word"][buckets[k]].astype(float), chars]))
    states = np.zeros((len(words), 2 * h))
    for way in "fb":
        s = np.zeros(h)
        for t in range(len(words)) if way == "f" else reversed(range(len(words))):
            a, m = emb[t] @ p[f"W{way}"] + p[f"c{way}"], s @ p[f"U{way}"]
            z, r = sig(a[:h] + m[:h]), sig(a[h : 2 * h] + m[h : 2 * h])
            s = (1 - z) * s + z * np.tanh(a[2 * h :] + r * m[2 * h :])
            states[t, (0 if way == "f" else h) : (h if way == "f" else 2 * h)] = s
    e = np.exp(states @ p["v"])
    return float((e / e.sum()) @ states @ p["w"] + p["b"][0])


def test_network_scores_like_a_plain_loop():
    rng, net = random.Random(3), toxicity.Network(5)
    texts = [" ".join(rng.choices(WORDS, k=n)) for n in (1, 5, 24, 25, 36, 37, 100)]
    for text, got in zip(texts, net.highest(texts)[0], strict=True):
        w = text.split()
        every = [plain_logit(net, w[a : a + toxicity.WINDOW]) for a in range(0, max(1, len(w) - toxicity.STRIDE), toxicity.STRIDE)]
        assert abs(max(every) - got) < 1e-4
    assert all(window in text for text, window in zip(texts, net.highest(texts)[1], strict=True))


def test_gradients_are_those_of_finite_differences():
    net = toxicity.Network(2)
    words = [f"gr{k}x" for k in range(6)]
    features = toxicity.word_features([w.encode() for w in words])
    ids, target = np.array([[0, 1, 2, 3], [4, 5, -1, -1], [2, 2, 1, -1]]), np.array([1, 0, 1], np.float32)

    def loss() -> float:
        x = net.run(net.inputs(net.embed(features)), ids)[0].astype(float)
        return float(np.mean(np.logaddexp(0, x) - target * x))

    logit, kept = net.run(net.inputs(net.embed(features)), ids, keep=True)
    slope = ((toxicity.sigmoid(logit) - target) / len(target)).astype(np.float32)
    grads = net.back(net.embed(features), features, ids, kept, slope)
    assert set(grads) == set(net.p)
    for name, grad in grads.items():
        for flat in np.argsort(-np.abs(grad).ravel())[:4]:
            at = np.unravel_index(flat, grad.shape)
            old = net.p[name][at]
            net.p[name][at] = old + np.float32(0.02)
            high = loss()
            net.p[name][at] = old - np.float32(0.02)
            numeric = (high - loss()) / 0.04
            net.p[name][at] = old
            assert abs(numeric - grad[at]) < 2e-3 + 0.03 * abs(grad[at]), name


def test_toxicity_learns_only_from_rows_it_may(spark):
    rng = random.Random(8)
    rows = [(k, " ".join([*rng.choices(WORDS, k=rng.randint(5, 60)), *(["vile"] * (k % 3 == 0)), *rng.choices(WORDS, k=20)])) for k in range(240)]
    held = {k for k in range(240) if zlib.crc32(str(k).encode()) % 4 == 2}
    docs = spark.createDataFrame([*rows, *rows[:5], (None, "x"), (999, None)], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    true = [(k, int(k % 3 == 0)) for k in range(240)]
    wrong = [(k, y if k not in held else 1 - y) for k, y in true]
    nets = [toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (4, None)], "doc_id long, toxic int")) for labels in (true, wrong)]
    assert all((nets[0].p[k] == nets[1].p[k]).all() for k in nets[0].p)
    out = toxicity.score_documents(docs, nets[0]).collect()
    assert len(out) == len(rows) + 7
    assert all(r["held_out"] == (r["doc_id"] in held) for r in out if r["doc_id"] not in (None, 999))
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out)
    right = [r["predicted"] == int(r["doc_id"] % 3 == 0) for r in out if r["doc_id"] in held]
    assert len(right) > 40 and sum(right) / len(right) > 0.95
    assert toxicity.drop_toxic(docs, nets[0]).count() == sum(1 - r["predicted"] for r in out)
    empty = toxicity.fit(docs.where("false"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(docs.where("false"), empty).count() == 0


def test_toxic_passage_of_a_long_text_is_learnt():
    """The window that matters is one of hundreds; the epochs over the highest window of all find it."""
    rng = random.Random(4)
    say = lambda n: rng.choices(WORDS, k=n)
    texts = [" ".join(say(400) + ["vile", "filth"] * 2 + say(1200)) for _ in range(40)] + [" ".join(say(1600)) for _ in range(80)] + [" ".join([*say(10), "vile", "filth", *say(8)]) for _ in range(30)]
    net = toxicity.train(texts, [1] * 40 + [0] * 80 + [1] * 30)
    unseen = [" ".join(say(700) + ["vile", "filth"] * 2 + say(700)) for _ in range(20)] + [" ".join(say(1400)) for _ in range(20)]
    assert ((net.scores(unseen) >= 0.3) == np.array([1] * 20 + [0] * 20)).mean() > 0.9


@pytest.mark.parametrize("size", [200, 1500])
def test_blocks_of_the_query_set_give_what_one_block_gives(spark, monkeypatch, size):
    rng = random.Random(size)
    say = lambda n: rng.choices(WORDS, k=n)
    items = [(k, " ".join(say(n))) for k, n in enumerate((400, 13, 14, 5, 40, 90))] + [(2, "again w1 w2"), (None, " ".join(say(15))), (7, None)]
    whole = [t.split() for _, t in items if t]
    docs = [(k, " ".join(say(20) + w[a : a + 16] + say(20))) for k, (w, a) in enumerate((w, a) for w in whole for a in range(0, len(w), 11))]
    tables = [spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")]
    rows = lambda: sorted(map(tuple, decontaminate.contamination_digests(*tables).collect()))
    one = rows()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 3000)
    assert len(decontaminate.load_items(tables[1])) >= 2 and rows() == one
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    assert sum(r[2] for r in one) >= sum(13 for _, t in docs if any(" ".join(words(t)[20:33]) in i for _, i in items if i))
    assert any(r[3] and r[2] for r in one)


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value: int, width: int) -> None:
        self.bits += format(value & ((1 << width) - 1), f"0{width}b") if width else ""

    def rice(self, v: int, k: int) -> None:
        u = 2 * v if v >= 0 else -2 * v - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self) -> bytes:
        bits = self.bits + "0" * (-len(self.bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def foreign_stream(left: list[int], right: list[int], way: int) -> bytes:
    """16-bit stereo in one frame without seek table: fixed order 1, the second of two partitions escape-coded, and a verbatim side channel with wasted bits where it can."""
    w, n = Writer(), len(left)
    for value, width in ((0x3FFE, 14), (0, 2), (7, 4), (0, 4), (way, 4), (4, 3), (0, 1), (0, 8), (n - 1, 16)):
        w.put(value, width)
    w.put(media_flac.crc8(w.bytes()), 8)
    side = [a - b for a, b in zip(left, right, strict=True)]
    first, second = {1: (left, right), 8: (left, side), 9: (side, right), 10: ([(a + b) >> 1 for a, b in zip(left, right, strict=True)], side)}[way]
    for channel, values in enumerate((first, second)):
        depth = 16 + (way in (8, 10) and channel == 1 or way == 9 and channel == 0)
        if channel == 1:
            shift = 2 if all(v % 4 == 0 for v in values) else 0
            w.put(1 << 1 | bool(shift), 8)
            if shift:
                w.put(1, shift)
            for v in values:
                w.put(v >> shift, depth - shift)
            continue
        w.put((8 | 1) << 1, 8)
        w.put(values[0], depth)
        w.put(1, 2)
        w.put(1, 4)
        r = np.diff(values).tolist()
        w.put(3, 5)
        for v in r[: n // 2 - 1]:
            w.rice(v, 3)
        w.put(31, 5)
        w.put(18, 5)
        for v in r[n // 2 - 1 :]:
            w.put(v, 18)
    frame = w.bytes()
    crc = int(media_flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    pcm = np.stack([left, right], 1).astype("<i2").tobytes()
    info = n.to_bytes(2, "big") * 2 + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame + crc.to_bytes(2, "big")


@pytest.mark.parametrize("way", [1, 8, 9, 10])
def test_streams_of_other_encoders(way):
    rng = random.Random(way)
    left, right = ([rng.randint(-9000, 9000) // 8 * 8 for _ in range(64)] for _ in range(2))
    raw = foreign_stream(left, right, way)
    samples, rate, bits = media_flac.decode_stream(raw)
    assert samples.tolist() == [list(x) for x in zip(left, right, strict=True)] and (rate, bits) == (44100, 16)
    for at in (len(raw) - 1, len(raw) - 40, 50):
        with pytest.raises(ValueError):
            media_flac.decode_stream(raw[:at] + bytes([raw[at] ^ 16]) + raw[at + 1 :])


def test_own_streams_hold_their_payload_for_any_decoder():
    rng = random.Random(6)
    payloads = [media_flac.padded(" ".join(rng.choices(WORDS, k=n)).encode()) for n in (0, 1, 300, 900)] + [bytes(rng.choices(range(256), k=2112))]
    for payload, raw in zip(payloads, media_flac.encode(payloads), strict=True):
        samples, rate, bits = media_flac.decode_stream(raw)
        assert media_flac.BYTE[samples[:, 0] & 255].tobytes() == payload and (rate, bits) == (media_flac.RATE_HZ, 8)
    assert sorted(media_flac.SAMPLE.tolist()) == list(range(-128, 128)) and (media_flac.BYTE[media_flac.SAMPLE & 255] == np.arange(256)).all()


def test_media_column_is_what_was_stored(spark):
    rng = random.Random(7)
    rows = [(1, " ".join(rng.choices(WORDS, k=12_000))), (2, None), (3, ""), (4, "é" * 700), (4, "é" * 700), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    streams = {r["doc_id"]: bytes(r["media"]) for r in media_flac.encode_column(docs).collect()}
    table = media_flac.media_round_trip(docs)
    out = table.collect()
    assert len(out) == len(rows)
    for r in out:
        text = (dict(rows)[r["doc_id"]] or "").encode()
        raw, samples = streams[r["doc_id"]], np.frombuffer(media_flac.padded(text), np.uint8).astype(int) - 128
        assert (r["n_bytes"], r["media_bytes"], r["media_sha256"]) == (len(text), len(raw), hashlib.sha256(raw).hexdigest())
        assert b"".join(r["pcm"]) == media_flac.padded(text) and list(r["sample_offsets"]) == list(range(0, len(samples), media_flac.PCM_BLOCK))
        crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
        assert r["feature"] == f"n={len(samples)};sum={samples.sum()};energy={(samples**2).sum()};crossings={crossings};step={max(abs(a - b) for a, b in zip(samples, samples[1:], strict=False))}"
    parts = {r["doc_id"]: bytes(r["payload"]) for r in media_flac.read_samples(table, 20_000, 40_000).collect()}
    assert parts[1] == rows[0][1].encode()[20_000:40_000] and parts[2] == b""


def test_near_duplicates_keep_columns_of_any_name(spark):
    from textloom.llm import near_dup

    text = " ".join(WORDS[:60])
    docs = spark.createDataFrame([(1, text, 5, 6), (2, text, 5, 6), (None, text, 5, 6), (3, None, 5, 6)], "doc_id long, text string, _gone int, gone int")
    out = near_dup.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "None"]


def test_tables_are_released(spark):
    from pathlib import Path

    from textloom.llm import common

    table = common.stage_table(spark.range(5), "numbers")
    folder = Path(common.shared_dir(spark).removeprefix("file://"), common.RUN)
    assert table.count() == 5 and folder.exists()
    common.release_tables(spark)
    assert not folder.exists()


def test_query_names():
    assert len(queries.QUERIES) == 10 and set(queries.SQL) <= set(queries.QUERIES)
