"""Importance resampling, the filter audit and media columns against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaykit.llm import filter_audit, matroska, resampling

from .data import documents, empty, prose
from .test_corpus_operators import labels

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# resampling


def word_runs(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resampling(rows, target, share=5, least=20, buckets=10_000):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in word_runs(t)[1])
    s, t = count([x for _, x in rows]), count(target)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets))))
    out = []
    for i, x in rows:
        w, found = word_runs(x)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    ranked = [(i, n, w, z, k + 1 if k < len(able) * share // 100 else None) for k, (i, _, n, w, z) in enumerate(able)]
    return sorted(ranked + [(i, n, w, z, None) for i, m, n, w, z in out if m < least], key=repr)


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_features_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    r = random.Random(4)
    texts = ["".join(r.choice("aZ9 é.\x80漢\n-") for _ in range(r.randint(0, 60))) for _ in range(40)]
    texts += [None, "", "  ", "x" * 300 + " " + "é" * 200 + " end", "a", "b", "a b", "AB", "Cd"]
    for held in (pa.array(texts), pa.array(["skipped", *texts, "skipped too"]).slice(1, len(texts))):
        got = [Counter() for _ in texts]
        for of, crc in resampling.features(held):
            for i, c in zip(of.tolist(), crc.tolist(), strict=True):
                got[i][c] += 1
        assert got == [Counter(zlib.crc32(f.encode()) for f in word_runs(t)[1]) for t in texts]


def test_resampling_equals_brute_force(spark):
    docs = documents(spark, [(i + 100, prose(random.Random(i), 25)) for i in range(120)])
    rows, target = [(x.doc_id, x.text) for x in docs.collect()], [prose(random.Random(7), 300), None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    gain = resampling.gains(resampling.counts(docs), resampling.counts(bench))
    weighed = resampling.weigh(docs, gain, keep=("doc_id", "score", "n_words", "weight"))
    assert weighed.columns == ["doc_id", "score", "n_words", "n_features", "weight"]
    got = resampling.draw(resampling.scored(weighed)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_resampling(rows, target)
    drawn = resampling.resample(docs.repartition(3), bench, share=10)
    want = brute_resampling(rows, target, 10)
    assert drawn.schema == docs.schema and sorted(repr(x.doc_id) for x in drawn.collect()) == sorted(repr(x[0]) for x in want if x[4])
    assert drawn.where("items <> 'clash' and items <> 'x'").count() == 0


def test_resampling_draws_what_reads_like_the_target(spark):
    r = random.Random(8)
    other = [w[::-1] for w in prose(r, 400).split()]
    rows = [(i, prose(r, 60) if i % 10 == 0 else " ".join(r.choice(other) for _ in range(60))) for i in range(200)]
    bench = spark.createDataFrame([(0, prose(r, 2000))], "item_id long, text string")
    drawn = [x.doc_id for x in resampling.resample(documents(spark).limit(0).select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")), bench, share=8).collect()]
    assert len(drawn) == 16 and all(i % 10 == 0 for i in drawn)


def test_resampling_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    gain = resampling.gains(resampling.counts(empty(spark)), resampling.counts(none))
    assert gain.where("gain <> 0").count() == 0 and gain.count() == 10_000
    assert resampling.draw(resampling.scored(resampling.weigh(empty(spark), gain))).count() == 0
    few = resampling.draw(resampling.scored(resampling.weigh(documents(spark), gain)))
    assert few.count() == documents(spark).count() and few.where("weight <> 0").count() == 0
    named = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    assert resampling.draw(resampling.scored(resampling.weigh(named, gain))).first().doc_id == "a"


# filter audit


def brute_audit(rows, labelled):
    known = {}
    for i, q, t in labelled:
        a, b = known.get(i, (0, 0))
        known[i] = (max(a, q), max(b, t))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out, parts = {}, {p or "" for *_, p in rows}
    for part in parts:
        failing = []
        for i, t, p in rows:
            if (p or "") != part:
                continue
            x = t or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", x)
            f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 10 * len(x), "D": bool(re.search(r"[#$%&*|]", x)), "E": i is not None and first[x] < i}
            failing.append(({k for k, v in f.items() if v}, *known.get(i, (0, 0))))
        for order in itertools.permutations("ABCDE"):
            left, gone = failing, []
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[0]]
                redundant = [x for x in gone if f in x[0]]
                left, gone = [x for x in left if f not in x[0]], gone + removed
                out[part, "".join(order), k + 1] = [len(left), len(removed), len(redundant), sum(x[0] == {f} for x in failing), sum(x[1] for x in removed), sum(x[2] for x in removed)]
    shapley = Counter()
    for (part, order, k), v in out.items():
        shapley[part, order[k - 1]] += v[1]
    return {(p, o, k, *v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_audit_equals_brute_force(spark):
    r = random.Random(12)
    found = []
    for i in range(90):
        w = prose(r, r.choice([20, 99, 100, 130])).split()
        w = w[: len(w) // 3] * 3 if r.random() < 0.3 else w
        t = " ".join(x.upper() if r.random() < r.choice([0, 0.2]) else x for x in w) + r.choice(["", "", " 5%"])
        found.append((i, t, r.choice(["en", "de", None, ""])))
    found += [(i + 200, found[i % 7][1], "de") for i in range(30)] + [(None, found[0][1], "en"), (None, None, "en"), (300, None, "fr"), (301, "", "fr"), (301, "", "fr"), (302, "x" * 50_000 + " y", "fr")]
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in found], "doc_id long, text string, lang string, mask string, id string").repartition(3)
    labelled = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 302, 2)] + [(4, 1, 1), (4, 0, 0)]
    got = filter_audit.audit(filter_audit.cells(filter_audit.marked(docs), labels(spark, labelled)))
    assert {tuple(x) for x in got.collect()} == brute_audit(found, labelled) and got.count() == 600 * 4
    bare = filter_audit.audit(filter_audit.cells(filter_audit.marked(docs)))
    assert {tuple(x) for x in bare.collect()} == brute_audit(found, [])
    assert filter_audit.audit(filter_audit.cells(filter_audit.marked(empty(spark)), labels(spark))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5])
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for k in filter_audit.transpositions(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n) and len(list(filter_audit.transpositions(n))) == math.factorial(n) - 1


# media columns


def brute_file(payload):
    """The stored form, written out element by element."""
    size = lambda n: bytes([0x80 | n]) if n < 127 else (0x4000 | n).to_bytes(2, "big") if n < 16383 else (0x200000 | n).to_bytes(3, "big")
    el = lambda h, body: bytes.fromhex(h) + size(len(body)) + body
    crc = lambda h, body: el(h, bytes.fromhex("BF84") + zlib.crc32(body).to_bytes(4, "little") + body)
    f64 = lambda x: np.array([x], ">f8").tobytes()
    num = lambda n: n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")
    info = crc("1549A966", el("2AD7B1", num(1_000_000)) + el("4489", f64(len(payload) / 8)) + el("4D80", b"rows") + el("5741", b"rows"))
    audio = el("E1", el("B5", f64(8000.0)) + el("9F", b"\1") + el("6264", b"\x08"))
    tracks = crc("1654AE6B", el("AE", el("D7", b"\1") + el("73C5", b"\1") + el("83", b"\2") + el("9C", b"\1") + el("23E383", num(50_000_000)) + el("86", b"A_PCM/INT/LIT") + audio))
    body, at, cues = b"", len(info) + len(tracks), b""
    for c in range(0, len(payload), 102_400):
        blocks = b""
        for k in range(c, min(len(payload), c + 102_400), 3200):
            own = payload[k : k + 3200]
            frames = [own[i : i + 400] for i in range(0, len(own), 400)]
            time = ((k - c) // 8).to_bytes(2, "big")
            if len(frames) == 1:
                blocks += el("A3", b"\x81" + time + b"\x80" + own)
            elif len(frames[-1]) == 400:
                blocks += el("A3", b"\x81" + time + b"\x84" + bytes([len(frames) - 1]) + own)
            else:  # first size, then differences of 0
                blocks += el("A3", b"\x81" + time + b"\x86" + bytes([len(frames) - 1]) + (0x4000 | 400).to_bytes(2, "big") + b"\xbf" * (len(frames) - 2) + own)
        cluster = crc("1F43B675", el("E7", num(c // 8)) + blocks)
        cues += el("BB", el("B3", num(c // 8)) + el("B7", el("F7", b"\1") + el("F1", num(at))))
        body, at = body + cluster, at + len(cluster)
    head = el("1A45DFA3", el("4282", b"matroska") + el("4287", b"\4") + el("4285", b"\2"))
    return head + el("18538067", info + tracks + body + crc("1C53BB6B", cues))


def test_media_equal_brute_force(spark):
    docs = documents(spark, [(900, "x" * 64), (901, "é" * 150_000), (902, "y" * 3200), (903, "z" * 399)])
    got = {(x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32, x.media_bytes, x.media_sha256) for x in matroska.digests(matroska.store(docs)).collect()}
    want = set()
    for x in docs.collect():
        own = (x.text or "").encode()
        payload = own + bytes(-len(own) % 64) if own else bytes(64)
        media = brute_file(payload)
        want.add((x.doc_id, len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert got == want
    found = matroska.samples(matroska.store(docs)).where("error is not null")
    assert found.count() == 0 and matroska.digests(matroska.store(empty(spark))).count() == 0


def mixed_file(r, unknown=False):
    """Two tracks, all lacings, groups with durations, sizes that may be unknown, and what each packet holds."""
    video = matroska.element(matroska.TRACK_ENTRY, matroska.number(0xD7, 2), matroska.number(0x83, 1), matroska.element(0x86, b"V_TEST"), matroska.element(0xE0, matroska.number(0xB0, 640), matroska.number(0xBA, 480)),
                             matroska.element(0x6D80, matroska.element(0x6240, matroska.element(0x5034, matroska.number(0x4254, 3), matroska.element(0x4255, b"\0\1")))))
    info = matroska.element(matroska.INFO, matroska.number(matroska.TIMESTAMP_SCALE, 500_000))
    tracks = matroska.guarded(matroska.TRACKS, matroska.audio_track(10_000_000), video)
    want, clusters, size, starts = [], [], len(info) + len(tracks), []
    for c in range(5):
        body = matroska.element(0xEC, bytes(r.randint(0, 200))) + matroska.number(matroska.TIMESTAMP, c * 1000)
        for k in range(r.randint(1, 6)):
            kind = r.choice(matroska.LACINGS)
            n = 1 if kind == "none" else r.randint(1, 9)
            long = r.choice([3, 300, 20_000])
            frames = [r.randbytes(50 if kind == "fixed" else r.randint(0 if kind != "none" else 1, long)) for _ in range(n)]
            time = k * 100 - 50
            if r.random() < 0.5:
                body += matroska.block(1, time, frames, kind)
                step, track, key = 10_000_000, 1, True
            else:
                lasts = r.choice([None, 40])
                inner = [matroska.block(2, time, frames, kind, 0, False)] + ([matroska.number(matroska.BLOCK_DURATION, lasts)] if lasts else []) + ([matroska.element(matroska.REFERENCE, b"\xff")] if k % 2 else [])
                body += matroska.element(matroska.BLOCK_GROUP, *inner)
                step, track, key = lasts * 500_000 // n if lasts else None, 2, k % 2 == 0
            begin = (c * 1000 + time) * 500_000
            want += [(track, begin + i * step if step is not None else begin if not i else None, key, kind, i, f) for i, f in enumerate(frames)]
        cluster = b"\x1f\x43\xb6\x75" + (b"\x01" + b"\xff" * 7 if unknown else matroska.vint(len(body), r.choice([0, 5, 8]))) + body
        starts.append(size)
        size += len(cluster)
        clusters.append(cluster)
    cues = matroska.guarded(matroska.CUES, *(matroska.element(0xBB, matroska.number(0xB3, c * 1000), matroska.element(0xB7, matroska.number(0xF7, 1), matroska.number(0xF1, s))) for c, s in enumerate(starts)))
    body = b"".join([info, tracks, *clusters, cues])
    return matroska.HEAD + b"\x18\x53\x80\x67" + (b"\xff" if unknown else matroska.vint(len(body))) + body, want


@pytest.mark.parametrize("unknown", [False, True])
def test_packets_of_mixed_files(spark, unknown):
    r = random.Random(21)
    made = [mixed_file(r, unknown) for _ in range(12)]
    files = spark.createDataFrame([(i, bytearray(data), "clash") for i, (data, _) in enumerate(made)], "doc_id long, media binary, track string").repartition(3)
    got = matroska.packets(files, keep=("doc_id", "track")).collect()
    for i, (data, want) in enumerate(made):
        own = sorted((x for x in got if x.doc_id == i), key=lambda x: (x.block_offset, x.frame))
        assert [(x.track, x.timestamp_ns, x.keyframe, x.lacing, x.frame, data[x.offset : x.offset + x.size]) for x in own] == want
        assert matroska.joined(data, matroska.parse(data), 2) == b"".join(b"\0\1" + f for t, *_, f in want if t == 2)
        assert not matroska.parse(data).errors
    assert {(x.track, x.type, x.codec, x.width) for x in matroska.tracks(files).collect()} == {(1, "audio", "A_PCM/INT/LIT", None), (2, "video", "V_TEST", 640)}
    assert matroska.cues(files).where("track = 1").count() == 60
    assert {x.element for x in matroska.elements(files).collect()} >= {"1A45DFA3", "18538067", "1F43B675", "1C53BB6B", "B7"}
    start, stop = 1_000_000_000, 1_600_000_000
    for x in matroska.window(files, start, stop).collect():
        data, want = made[x.doc_id]
        assert x.payload == b"".join(f for t, at, *_, f in want if t == 1 and at is not None and start <= at < stop)
        assert x.from_offset == matroska.parse(data).cues[2][2]


def test_broken_files(spark):
    r = random.Random(23)
    whole, want = mixed_file(r)
    full = matroska.parse(whole).packets
    for at in sorted(r.sample(range(len(whole)), 60)):
        got = matroska.parse(whole[:at])
        assert got.packets == full[: len(got.packets)] and got.errors
    for _ in range(200):
        data = bytearray(whole)
        for _ in range(3):
            data[r.randrange(len(data))] = r.randrange(256)
        matroska.joined(bytes(data), matroska.parse(bytes(data)), 1)  # whatever it holds, no crash
    files = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"RIFF")), (None, bytearray(whole[:3000]))], "doc_id long, media binary")
    assert matroska.packets(files).where("doc_id is not null").count() == 0 and matroska.elements(files).where("doc_id is null").count() > 0
    assert {x.doc_id: x.error for x in matroska.samples(files).collect()}.keys() == {1, 2, 3, None}
    assert matroska.samples(files).where("error is null").count() == 0 and matroska.window(files, 0, 1).count() == 4
    bad = bytearray(matroska.written(bytes(200)))
    bad[-1] ^= 1
    assert any("checksum" in x for x in matroska.parse(bytes(bad)).errors)


def test_numbers_of_any_length():
    for n in [0, 1, 126, 127, 128, 16382, 16383, 1 << 20, (1 << 56) - 2]:
        for length in (0, 8):
            data = matroska.vint(n, length)
            assert matroska.read_vint(data, 0, len(data), False) == (n, len(data))
    assert matroska.read_vint(b"\xff", 0, 1, False) == (-1, 1)
    with pytest.raises(matroska.Broken):
        matroska.read_vint(b"\x40", 0, 1, False)


def test_equal_texts_give_equal_files(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["same text", "same text", None, ""])], "doc_id long, text string")
    got = matroska.digests(matroska.store(rows)).drop("doc_id").distinct()
    assert got.count() == 2 and got.agg(F.max("payload_bytes")).first()[0] == 64
