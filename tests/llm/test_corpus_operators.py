import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import blobs, chosen_path, line_dedup, lm_scoring, quality_fm, substring_dedup
from assaykit.llm.components import components
from assaykit.llm.text import word_hashes, words

from .data import documents, empty, prose


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# op 1


def test_blobs_of_a_batch_are_bounded(spark, monkeypatch):
    """However many buckets there are, a batch deals to LANES lanes, and merging makes a blob for each bucket and set of partitions."""
    monkeypatch.setattr(blobs, "LANES", 8)
    monkeypatch.setattr(blobs, "TOGETHER", 4)
    monkeypatch.setattr(lm_scoring, "GATHER", 3000)
    r = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(r.paretovariate(0.4)) % 9000}" for _ in range(120)), True, k % 3 == 0) for k in range(160)], "k0 long, _text string, _train boolean, _target boolean").repartition(8, "k0")
    models = lm_scoring.totals(docs, text="_text", target="_target")
    dealt = []
    monkeypatch.setattr(lm_scoring, "by_lane", lambda df, merge, buckets: dealt.append(blobs.by_lane(df, merge, buckets)) or df)
    first = lm_scoring._dealt(docs, models, [], 300).where("kind = 1").groupBy("batch").count().collect()
    assert len(first) > 20 and max(x["count"] for x in first) <= 8
    second = dealt[0].where("kind = 1")
    assert second.groupBy("batch").count().agg(F.max("count")).first()[0] <= 300 and second.groupBy("bucket", "batch").count().where("count > 1").count() == 0 and second.select("batch").distinct().count() == 2


def test_a_word_just_under_the_limit_fills_half_a_bucket(spark, monkeypatch):
    """The limit follows the number of buckets: a bucket holds about BUCKET tokens, whatever the words' shares."""
    monkeypatch.setattr(lm_scoring, "HOT", 4)
    monkeypatch.setattr(lm_scoring, "BUCKET", 1500)
    r = random.Random(3)
    warm = [f"warm{i}" for i in range(12)]  # each about 1 of 50 tokens: far over a bucket without the limit
    docs = spark.createDataFrame([(k, " ".join(r.choice(warm) if r.random() < 0.24 else f"w{r.randrange(20000)}" for _ in range(500)), True, k % 2 == 0) for k in range(200)], "k0 long, _text string, _train boolean, _target boolean").repartition(4, "k0")
    models = lm_scoring.totals(docs, text="_text", target="_target")
    assert len(models.hot.words) >= 12
    rows = lm_scoring._dealt(docs, models, [], -(-models.total[0] // 1500)).where("kind = 1").collect()
    tokens = defaultdict(int)
    for x in rows:
        tokens[x.bucket] += int(blobs.unpack(bytes(x.blob))[5].sum())
    assert max(tokens.values()) <= 2 * 1500 and len(tokens) > 50


@pytest.mark.parametrize("words", [100, 1 << 23])
def test_distinct_triples(words):
    r = random.Random(5)
    three = [(r.randrange(2, 30), r.randrange(30), r.randrange(5)) for _ in range(400)]
    found = lm_scoring.distinct(*(np.array(x) for x in zip(*three, strict=True)), words)
    assert list(zip(*(x.tolist() for x in found), strict=True)) == [(*k, n) for k, n in sorted(Counter(three).items())]


def test_lm_prefers_the_target(spark):
    r = random.Random(1)
    one, two = "ba ce di fo gu ha".split(), "pe qi ro su ta ve".split()
    text = lambda v: " ".join(r.choice(v) for _ in range(120))
    more = [(100 + i, text(one if i % 2 else two)) for i in range(60)]
    docs = documents(spark, more)
    marked = lm_scoring.flagged(docs, labels(spark, [(100 + i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (101, 1, 0)]))
    found = lm_scoring.score(marked, lm_scoring.totals(marked)).collect()
    got = {x.doc_id: x for x in found}
    assert len(found) == docs.count()
    assert all((got[100 + i].score > 0) == bool(i % 2) for i in range(60))
    assert got[0].score == 0 and got[0].loss_target is None and got[1].n_tokens == 0
    none = lm_scoring.flagged(docs, labels(spark))
    assert lm_scoring.score(none, lm_scoring.totals(none), keep=("doc_id", "score", "lang")).where("score <> 0").count() == 0
    nothing = lm_scoring.flagged(empty(spark), labels(spark, [(1, 1, 0)]))
    assert lm_scoring.score(nothing, lm_scoring.totals(nothing)).count() == 0


def lm_brute(rows):
    """Losses of (train, target, words) rows under both models, by dictionaries."""
    out = []
    size = len({y for train, _, w in rows if train for y in w}) + 1
    for flagged in (False, True):
        single, pair, start = defaultdict(int), defaultdict(int), 0
        for train, target, w in rows:
            if train and (target or not flagged) and w:
                start += 1
                for x, y in zip([None, *w], w, strict=False):
                    single[y] += 1
                    pair[x, y] += 1
        total, mass = sum(single.values()), lm_scoring.MASS
        p = lambda y: (single[y] + mass / size) / (total + mass)  # noqa: B023, E731
        out.append([np.mean([-np.log((pair[x, y] + mass * p(y)) / ((single[x] if x else start) + mass)) for x, y in zip([None, *w], w, strict=False)]) if w else None for _, _, w in rows])
    return list(zip(*out, strict=True))


@pytest.mark.parametrize(("hot", "bucket", "gather", "lanes", "merged"), [(lm_scoring.HOT, lm_scoring.BUCKET, lm_scoring.GATHER, 256, 1 << 25), (1, 500, 2000, 256, 1 << 25), (40, 700, 1 << 24, 256, 1 << 25), (1, 500, 2000, 3, 1 << 25), (40, 100, 2000, 7, 5000)])
def test_lm_equals_brute_force(spark, monkeypatch, hot, bucket, gather, lanes, merged):
    monkeypatch.setattr(blobs, "LANES", lanes)  # beyond so many buckets they are dealt to in two steps
    monkeypatch.setattr(blobs, "TOGETHER", 2)
    monkeypatch.setattr(blobs, "MERGED", merged)
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "BUCKET", bucket)
    monkeypatch.setattr(lm_scoring, "GATHER", gather)
    r = random.Random(hot)
    rows = [(r.random() < 0.9, r.random() < 0.3, [r.choice(["the", "of", f"w{int(r.paretovariate(0.3)) % 3000}"]) for _ in range(r.choice([0, 1, 3, 40, 200]))]) for _ in range(120)]
    rows += [rows[-1], (True, False, ["the"] * 300), (False, False, ["new", "words", "only", "new"])]
    docs = spark.createDataFrame([(i, " ".join(w), a, b) for i, (a, b, w) in enumerate(rows)], "doc_id long, text string, _train boolean, _target boolean").repartition(3, "doc_id")
    models = lm_scoring.totals(docs, train="_train")
    assert models.words.count() == models.size - 1 + 1 == len({y for a, _, w in rows if a for y in w}) + 1  # and the row of starts
    got = lm_scoring.score(docs, models, train="_train", keep=("doc_id", "n_tokens")).collect()
    assert len(got) == len(rows)
    want = lm_brute(rows)
    for x in got:
        assert x.n_tokens == len(rows[x.doc_id][2])
        assert (x.loss_background, x.loss_target) == (pytest.approx(want[x.doc_id][0], abs=1e-6), pytest.approx(want[x.doc_id][1], abs=1e-6))
        assert x.score == pytest.approx((x.loss_background or 0) - (x.loss_target or 0))


# op 2


def test_quality_held_out(spark):
    r = random.Random(2)
    rows = [(i, prose(r, 60) if i % 3 else " ".join(w + "$$$" for w in prose(r, 60).split())) for i in range(100, 400)]
    docs = documents(spark, rows)
    marked = labels(spark, [(i, int(i % 3 > 0), 0) for i, _ in rows] + [(None, 1, 0), (3, 5, 0)])
    machine = quality_fm.fit(docs, marked)
    got = quality_fm.score(docs, machine).withColumn("out", quality_fm.held_out())
    wrong = got.where("out and doc_id >= 100 and (score >= 0.5) <> (doc_id % 3 > 0)").count()
    assert wrong <= 0.03 * got.where("out and doc_id >= 100").count() and got.count() == docs.count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    kept = quality_fm.keep_good(docs, marked)
    assert kept.columns == docs.columns and kept.where("doc_id >= 100 and doc_id % 3 = 0").count() <= 3
    even = quality_fm.score(docs, quality_fm.fit(docs, labels(spark)))
    assert even.select("score").distinct().count() == 1 and quality_fm.score(empty(spark), machine).count() == 0


def test_machine_equals_sum_over_pairs():
    m = quality_fm.Machine()
    m.w[:] = np.random.default_rng(0).normal(size=len(m.w))
    text = [5, 9, 1000, quality_fm.SLOTS + 3]
    idx, x, row, n = quality_fm.spread([text])
    pairs = sum(m.v[a] @ m.v[b] * x[i] * x[j] for i, a in enumerate(text) for j, b in enumerate(text) if i < j)
    assert m.raw(idx, x, row, n)[0][0] == pytest.approx(m.w[text] @ x + pairs, rel=1e-4)


# op 3


def test_chunk_borders_move_with_the_text():
    r = random.Random(3)
    a, b = prose(r, 300).encode(), prose(r, 300).encode()
    one, two = {a[x:y] for x, y in zip([0, *substring_dedup.ends(a)], substring_dedup.ends(a), strict=False)}, substring_dedup.ends(b + a)
    shifted = {(b + a)[x:y] for x, y in zip([0, *two], two, strict=False)}
    assert len(one - shifted) <= 2 and substring_dedup.ends(b"")[-1] == 0


def test_passages_are_found_and_removed(spark):
    r = random.Random(4)
    passage = " ".join(prose(r, 60).split())
    more = [(100 + i, prose(r, 30) + f"\n{i} é{passage} \n" + prose(r, 30)) for i in range(4)]
    docs = documents(spark, more)
    found = substring_dedup.summary(docs).collect()
    got = {x.doc_id: x for x in found}
    assert len(found) == docs.count()
    assert [got[100 + i].has_copy for i in range(4)] == [False, True, True, True] and got[100].has_repeat
    assert all(got[100 + i].first_ids == [100] for i in (1, 2, 3)) and not got[8].has_repeat and got[0].n_bytes == 0
    clean = {x.doc_id: x.text for x in substring_dedup.remove_copies(docs).collect()}
    assert clean[100] == more[0][1] and len(clean[101]) < len(more[1][1]) - 100 and clean[101].startswith(more[1][1][:100]) and clean[0] is None
    assert substring_dedup.summary(empty(spark)).count() == 0 and substring_dedup.remove_copies(empty(spark)).count() == 0


def test_passages_are_found_at_any_place(spark):
    r = random.Random(9)
    noise = lambda: "".join(r.choice("bcdfghjklmnp ") for _ in range(300))
    passage = lambda: " ".join("".join(r.choice("aeiou") for _ in range(r.randint(3, 6))) for _ in range(51))
    passages = [passage() for _ in range(40)] + ["ha " * 80, "z" * 240]
    rows = [(i, f"{noise()}<{p}>{noise()}") for i, p in enumerate(passages)] + [(100 + i, f"{noise()}[{p}]{noise()}") for i, p in enumerate(passages)]
    rows += [(200, noise()), (201, "one short line\n" + noise()), (202, "one short line\n" + noise())]
    got = {x.doc_id: x for x in substring_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, p in enumerate(passages):
        copy = got[100 + i]
        assert copy.n_copies == 1 and copy.first_ids == [i] and got[i].has_repeat and (got[i].has_copy is False or i >= 40)
        start, end = map(int, copy.copies.split(":"))
        assert 301 <= start and end <= 301 + len(p) and end - start >= substring_dedup.LEAST
    assert not any(got[i].has_repeat for i in (200, 201, 202))


@pytest.mark.parametrize(("buckets", "lanes", "merged"), [(1, 256, 1 << 25), (7, 256, 1 << 25), (7, 2, 1 << 25), (40, 5, 3000)])
def test_repeats_equal_brute_force(spark, monkeypatch, buckets, lanes, merged):
    monkeypatch.setattr(blobs, "LANES", lanes)
    monkeypatch.setattr(blobs, "TOGETHER", 2)
    monkeypatch.setattr(blobs, "MERGED", merged)
    monkeypatch.setattr(substring_dedup, "_buckets", lambda *_: buckets)
    monkeypatch.setattr(substring_dedup, "GATHER", 3000)
    r = random.Random(11)
    shared = [" ".join(prose(r, 40).split()) for _ in range(8)]
    rows = [(r.randrange(60), " ".join(r.choice([prose(r, 15), prose(r, 15), r.choice(shared)]) for _ in range(r.randrange(5)))) for _ in range(80)]
    rows += [(None, rows[0][1]), (5, None), rows[3], rows[3]]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_bytes int").coalesce(1)
    split = lambda t: list(zip([0, *substring_dedup.ends(t)], substring_dedup.ends(t).tolist(), strict=False)) if t else []
    places = defaultdict(list)
    for k in sorted((k for k, (i, _) in enumerate(rows) if i is not None), key=lambda k: (rows[k][0], k)):
        t = (rows[k][1] or "").encode()
        for x, y in split(t):
            places[t[x:y]].append((k, x))
    want = []
    for k, (i, t) in enumerate(rows):
        t, spans = (t or "").encode(), {"repeat": [], "copy": []}
        firsts = set()
        for kind, found in spans.items():
            run = []
            for x, y in [*split(t), (len(t), len(t))]:
                held = places.get(t[x:y], [])
                on = i is not None and y > x and (len(held) > 1 if kind == "repeat" else len(held) > 1 and held[0] != (k, x))
                if on:
                    run.append((x, y, rows[held[0][0]][0]))
                elif run:
                    if run[-1][1] - run[0][0] >= substring_dedup.LEAST:
                        found.append(f"{run[0][0]}:{run[-1][1]}")
                        firsts |= {f for *_, f in run} if kind == "copy" else set()
                    run = []
        want.append((i, len(t), len(spans["repeat"]), ",".join(spans["copy"]), sorted(firsts)))
    got = [(x.doc_id, x.n_bytes, x.n_repeats, x.copies, x.first_ids) for x in substring_dedup.summary(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# op 5


def brute_classes(rows, threshold=0.8):
    cache = word_hashes()
    sets = [set(chosen_path.shingles(words((t or "").encode()), cache).tolist()) for _, t in rows]
    links, label = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[label[k]].append(i)
    return sorted(((i, min((x for x in ids[label[k]] if x is not None), default=None), links[k]) for k, (i, _) in enumerate(rows)), key=repr)


def near_rows(r, groups=12, size=9):
    out, i = [], 1000
    for _ in range(groups):
        base = prose(r, r.choice([40, 80, 150])).split()
        for _ in range(r.randint(2, size)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                own[r.randrange(len(own))] = "changed" + str(r.randrange(1000))
            out.append((i, " ".join(own)))
            i += 1
    return out


@pytest.mark.parametrize("block", [chosen_path.BLOCK, 4])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    if block == 4:
        monkeypatch.setattr(chosen_path, "BUCKET", 4)
        monkeypatch.setattr(chosen_path, "BYTES", 3000)
    docs = documents(spark, near_rows(random.Random(5)))
    got = sorted((tuple(x) for x in chosen_path.classes(docs).select("id", "class_id", "n_links").collect()), key=repr)
    assert got == brute_classes([(x.doc_id, x.text) for x in docs.collect()])


def test_one_of_each_class_stays(spark):
    docs = documents(spark, near_rows(random.Random(6)))
    kept = chosen_path.keep_one(docs)
    assert kept.columns == docs.columns
    expected = {(c if c is not None else i) for i, c, _ in brute_classes([(x.doc_id, x.text) for x in docs.collect()])}
    assert sorted(map(repr, (x.doc_id for x in kept.collect()))) == sorted(map(repr, expected))
    assert chosen_path.keep_one(empty(spark)).count() == 0


def test_an_id_with_two_texts_loses_copies_only(spark):
    r = random.Random(16)
    a, b, c = (prose(r, 60) for _ in range(3))
    docs = documents(spark, [(103, a), (107, a), (107, b), (109, c), (109, c), (110, c + " more")])
    kept = [(x.doc_id, x.text) for x in chosen_path.keep_one(docs).collect() if (x.doc_id or 0) > 100]
    assert sorted(kept) == sorted([(103, a), (107, b), (109, c)])


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_measured_recall(spark, similarity):
    """Pairs of exactly that similarity, one pair to a class, so no chain of others can help: at least 0.99 are found."""
    r = random.Random(int(100 * similarity))
    n, rows = 90, []
    for i in range(300):
        base = [f"w{r.randrange(10**9)}" for _ in range(n + 4)]  # n shingles
        other = list(base)
        cut = next(k for k in range(n) if (n - k) >= similarity * (n + k) and (n - k - 1) < similarity * (n + k + 1))
        other[n + 4 - cut :] = [f"x{r.randrange(10**9)}" for _ in range(cut)]  # changes `cut` shingles of either
        rows += [(1000 + 2 * i, " ".join(base)), (1001 + 2 * i, " ".join(other))]
    got = chosen_path.classes(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count()
    assert got >= 0.99 * len(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {x.v: x.label for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_runs_reach_the_recall():
    p = chosen_path.meeting(0.8)
    assert 1 - (1 - p) ** chosen_path.runs_for(0.8, 0.998) >= 0.998


# op 10


def brute_lines(rows, run=3):
    seen, out = set(), {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        if i in out:
            continue
        own = [(k, x.strip(line_dedup.BLANKS)) for k, x in enumerate((t or "").split("\n"))]
        own = [x for x in own if x[1]]
        gone = set()
        for s in range(len(own) - run + 1):
            g = tuple(x for _, x in own[s : s + run])
            if g in seen:
                gone |= set(range(own[s][0], own[s + run - 1][0] + 1))
            seen.add(g)
        out[i] = sorted(gone)
    return out


def test_lines_equal_brute_force(spark):
    r = random.Random(7)
    more = [(100 + i, "\n".join(r.choice(["a", "b", " c ", "", "d", "e\r"]) for _ in range(r.randint(0, 14)))) for i in range(60)]
    docs = documents(spark, more)
    got = line_dedup.clean(docs, gone="_gone").collect()
    expected = brute_lines([(x.doc_id, x.text) for x in docs.collect()])
    assert len(got) == docs.count() and any(expected.values())
    before = defaultdict(str, {x.doc_id: x.text for x in docs.collect()})
    for x in got:
        gone = expected.get(x.doc_id, [])
        assert list(x._gone or []) == gone
        if before[x.doc_id] is not None:
            assert x.text == "\n".join(y for k, y in enumerate(before[x.doc_id].split("\n")) if k not in gone)
    left = line_dedup.remove_repeats(docs)
    assert left.columns == docs.columns and left.where((F.col("n_chars") != F.char_length("text")) & (F.col("doc_id") >= 100)).count() == 0
    assert line_dedup.remove_repeats(empty(spark)).count() == 0
    assert "Python" not in str(line_dedup.repeated(docs)._jdf.queryExecution().executedPlan())


def test_long_runs_of_one_or_two_lines_go(spark):
    r = random.Random(8)
    flat = lambda n: " ".join(prose(r, n).split())
    one, half, other, short = flat(60), flat(30), flat(30), flat(50)
    rows = [(1, one), (2, f"own\n {one}\nmore"), (3, f"{half}\n\n{other}"), (4, f"a\n{half}\n{other}\nb"), (5, f"{half}\nc"), (6, f"{short}\nd"), (7, f"e\n{short}"), (8, one), (9, f"{one}\nf\n{one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in line_dedup.remove_repeats(docs).collect()}
    expected = dict(rows) | {2: "own\nmore", 4: "a\nb", 9: "f"}
    del expected[8]
    assert got == expected
