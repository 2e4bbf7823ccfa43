"""The methods themselves against plain loops, and the edge cases that the other tests leave out."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import PATH, _by_id, _docs


def _fit_anywhere(lengths, caps, rule, weights=(1.0, 0.02, 0.02)):
    """Best fit over all bins in the order they were opened."""
    bins, out = [], []
    for n in lengths:
        need, best = (n, 1, n * n), None
        for k, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, need)):
                parts = [(x, y, w / c**2) for x, y, w, c in zip(left, need, weights, caps)]
                score = sum(w * (x - y) ** 2 for x, y, w in parts) if rule == "norm" else -sum(w * x * y for x, y, w in parts)
                if best is None or score < best[0] - 1e-12:
                    best = score, k
        if best is None:
            bins.append(list(caps))
            best = 0, len(bins) - 1
        out.append(best[1])
        bins[best[1]] = [x - y for x, y in zip(bins[best[1]], need)]
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_bins_under_capacities_that_bind(rule):
    from nearfield.llm.packing import assign

    rng = random.Random(1)
    for caps in ((64, 4, 900), (64, 64, 4096), (64, 3, 4096), (64, 64, 700)):
        lengths = sorted((rng.randint(1, 26) for _ in range(150)), reverse=True)
        bins, at = assign(np.array(lengths), *caps, rule)
        assert bins.tolist() == _fit_anywhere(lengths, caps, rule)
        for b in set(bins.tolist()):
            own = [(x, y) for x, y, z in zip(lengths, at.tolist(), bins) if z == b]
            assert sum(x for x, _ in own) <= caps[0] and len(own) <= caps[1] and sum(x * x for x, _ in own) <= caps[2]
            assert [y for _, y in own] == np.cumsum([0, *(x for x, _ in own)])[:-1].tolist()
    lengths = sorted((rng.randint(1, 400) for _ in range(4000)), reverse=True)
    assert assign(np.array(lengths), 2048, 2048, 2048.0**2, rule)[0].max() + 1 <= -(-sum(lengths) // 2048) + 1


def test_packing_of_repeated_and_null_ids(spark):
    """Equal rows are pieces of their own and don't all meet in one group."""
    from nearfield.llm.packing import pack

    rows = [(None, "a b c")] * 300 + [(7, "x y z")] * 300 + [(8, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, max_tokens=16, group_tokens=200).collect()
    assert Counter(r.doc_id for r in got) == {None: 300, 7: 300, 8: 1}
    groups = Counter(r.sequence_id >> 32 for r in got)
    assert len(groups) > 5 and max(groups.values()) < 200
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 16 and sorted(s)[0][0] == 0 for s in seqs.values())


def test_kernel_against_its_definition():
    """Windows' common subsequences of four letters within six, by dictionaries; the collapsed machine is linear in them."""
    from nearfield.llm import toxicity as t

    raws = [b"you i-d-i-o-t walk on", b"The stone, the river", b"idiot", b"a", b"", "čaj żaba idiot".encode(), b"x" * 300]
    s = t._Sample(raws)
    at = np.array([int(s.starts[k]) + i for k in range(len(raws)) for i in range(0, int(s.sizes[k]), 3)])
    keys, w = t._features(s.codes, at)

    def phi(place):
        out = defaultdict(float)
        for i in range(place, place + t.WINDOW):
            for o in t.OFFSETS:
                own = [int(s.codes[i]), *(int(s.codes[i + x]) & 31 for x in o)]
                if t.PAD not in [x & 31 for x in own]:
                    out[tuple(own)] += t.DECAY ** (o[2] - 3)
        return out

    plain = [phi(int(p)) for p in at]
    for a in range(0, len(at), 5):
        for b in range(len(at)):
            fast = sum(x * y for k, x in zip(keys[a].tolist(), w[a]) for j, y in zip(keys[b].tolist(), w[b]) if k == j and x and y)
            assert fast == pytest.approx(sum(v * plain[b].get(k, 0) for k, v in plain[a].items()))
    weights = t._clear(np.random.default_rng(2).normal(size=t.SIZE).astype(np.float32))
    values = t.window_values(s.codes.astype(np.uint8), weights)
    for p, own in zip(at.tolist(), plain):
        want = sum(v * weights[(k[0] << 15) | (k[1] << 10) | (k[2] << 5) | k[3]] for k, v in own.items())
        assert values[p] == pytest.approx(want, abs=1e-3)


def _insults(n=200):
    rng, rows = random.Random(8), []
    for i in range(n):
        w = [rng.choice(["the", "stone", "river", "walks", "under", "green", "light", "slowly"]) for _ in range(30)]
        if i % 3 == 0:
            w[3] = w[17] = rng.choice(["idiot", "moron", "scumbag"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    return rows


def test_toxicity_of_ties_long_texts_and_repeated_rows(spark):
    from nearfield.llm.toxicity import score_toxicity

    rows = _insults()
    long = "the river walks slowly under green light " * 6000
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, long), (901, long + " idiot moron idiot scumbag moron"), (902, None), (902, None), (None, rows[0][1]), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = score_toxicity(docs.withColumnRenamed("doc_id", "key").selectExpr("key as doc_id", "text", "1.5 as score", "'x' as predicted"), labels).collect()
    assert len(got) == len(rows) + 6
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.score)
    assert by[None] == by[0] and len(by[902]) == 1 and max(by[901]) >= max(by[900])


def _co_trained(rows, labels, rounds, share):
    """Co-training by plain loops over rows (id, text, meta): score of each."""
    from nearfield.llm import quality_classifier as q
    from nearfield.llm.quality_classifier import _meta
    import zlib

    feats = []
    for i, t, *meta in rows:
        at, n = q.text_features((t or "").encode())
        feats.append((zlib.crc32(("" if i is None else str(i)).encode()) % 5, labels.get(i), dict(zip(at.tolist(), n.tolist())), _meta(tuple(meta))))
    held = [None if f == 0 else y for f, y, _, _ in feats]
    given = [y if f < 4 else None for (f, _, _, _), y in zip(feats, held)]

    def fit(by_text, by_meta):
        text, meta = np.zeros((2, q.BUCKETS)), np.zeros((2, q.META))
        for (_, _, words, own), x, y in zip(feats, by_text, by_meta):
            if x is not None:
                for k, n in words.items():
                    text[x, k] += math.sqrt(n)
            if y is not None:
                for k in own:
                    meta[y, k] += 1
        odds = [np.log((t[1] + 1) / (t[1].sum() + t.shape[1])) - np.log((t[0] + 1) / (t[0].sum() + t.shape[1])) for t in (text, meta)]
        return [sum(odds[0][k] * math.sqrt(n) for k, n in w.items()) / math.sqrt(sum(math.sqrt(n) for n in w.values()) + 1) for _, _, w, _ in feats], [sum(odds[1][k] for k in m) for _, _, _, m in feats]

    views = fit(given, given)
    for _ in range(rounds):
        free, marks = [y is None for y in held], []
        for view in views:
            place = [math.floor(max(-64, min(64, x)) * 256) for x in view]
            own = sorted(p for p, f in zip(place, free) if f)
            need = math.ceil(share * len(own) - 1e-9)
            low, high = own[max(0, need - 1)], own[-max(1, need)]
            marks.append([None if not f or low >= high else 1 if p >= high else 0 if p <= low else None for p, f in zip(place, free)])
        views = fit(*([g if g is not None else m for g, m in zip(given, marks[k])] for k in (1, 0)))
    some = [k for k, (f, *_) in enumerate(feats) if f == 4 and held[k] is not None]
    y = np.array([held[k] for k in some], float)
    own = [q._calibrate(np.array([v[k] for k in some])[:, None], y) for v in views]
    flat = [np.array(v) * w[0] + w[1] for v, w in zip(views, own)]
    both = q._calibrate(np.column_stack([x[some] for x in flat]), y)
    return 1 / (1 + np.exp(-(both[0] * flat[0] + both[1] * flat[1] + both[2])))


def test_co_training_against_plain_loops(spark):
    """With nulls, ties, repeated rows and ids, a text beyond any small counter, and columns named like results."""
    from nearfield.llm.quality_classifier import co_train

    rng, rows, labels = random.Random(4), [], {}
    for i in range(400):
        good = rng.random() < 0.5
        words = [rng.choice(["clear", "plain", "exact", "river", "stone"] if good else ["buy", "NOW!!!", "click", "$$$", "river"]) for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join(words), rng.choice(["en", None]), "a" if rng.random() < (0.8 if good else 0.3) else "b", rng.choice([None, 10, 5000])))
        if rng.random() < 0.4:
            labels[i] = int(good)
    rows += [rows[0], rows[0], (None, "clear plain", None, None, None), (None, None, "en", "a", 1), (3, "buy click", "en", "b", 9), (901, "river " * 70_000, "en", "a", None), (902, "", "en", "a", 0)]
    docs = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean")
    known = spark.createDataFrame([(k, v) for k, v in labels.items()] + [(None, 1), (399, None)], "doc_id long, quality int")
    for rounds in (0, 2):
        got = sorted((r.doc_id is None, r.doc_id, round(r.score, 6)) for r in co_train(docs, known, rounds=rounds).select("doc_id", "score").fillna(-1, "doc_id").collect())
        want = sorted((False, -1 if r[0] is None else r[0], round(float(s), 6)) for r, s in zip(rows, _co_trained(rows, labels, rounds, 0.05)))
        assert [g[1] for g in got] == [w[1] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


def test_large_benchmarks_go_block_by_block(spark):
    """Small blocks and small chunks of documents give what one automaton gives; nulls and repeated ids as ever."""
    from nearfield.llm.decontamination import find_leaks

    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for k in range(40)] + [(None, "w1 w2"), (50, None), (51, "W1, w2")]
    texts = [None, "", "w1 w2", *(" ".join([*(rng.choice(vocab) for _ in range(5)), *(rng.choice(items)[1] or "").split(), "zz"]) for _ in range(60))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = _docs(spark, texts).union(_docs(spark, texts[2:4])).repartition(3)
    rows = lambda **more: sorted(map(str, find_leaks(docs, bench, **more).collect()))
    assert rows() == rows(block_bytes=300, gather=400) and len(rows()) == len(texts) + 2


def test_licences_of_odd_files(spark):
    from nearfield.llm.licenses import scan_licenses

    one = "Released under the MIT License."
    rows = [(1, "a/LICENSE", one), (1, "a/x.c", "code"), (1, "a/x.c", "code"), (None, None, None), (2, "b/y.c", "x\n" * 50_000 + one), (3, "", ""), (None, "a/b/z.c", None)]
    files = spark.createDataFrame([(*r, "clash", 9, 0.1) for r in rows], "doc_id long, path string, text string, license string, row long, similarity double")
    got = Counter((r.doc_id, r.license, r.origin) for r in scan_licenses(spark, files).collect())
    assert got == {(1, "MIT", "own"): 1, (1, "MIT", "inherited"): 2, (None, None, "none"): 1, (2, "MIT", "own"): 1, (3, None, "none"): 1, (None, "MIT", "inherited"): 1}
    assert scan_licenses(spark, files.where("doc_id > 99")).count() == 0


def test_near_duplicates_whose_lists_share_a_rare_member(spark):
    """Groups of several components: two families that share half of their words, and a member between them."""
    from nearfield.llm.minhash import near_duplicates

    rng = random.Random(3)
    common, a, b = ([f"{x}{i}" for i in range(90)] for x in "cab")
    texts = [" ".join(common + own[:k] + [f"{rng.random()}"]) for own in (a, b) for k in range(60, 90, 3)] + [" ".join(common)] * 3 + [None, ""]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").split() for t in texts)]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    for block, shingles in ((512, 2_000_000), (4, 500)):
        got = _by_id(near_duplicates(_docs(spark, texts), block=block, block_shingles=shingles))
        assert [got[d].component_id for d in range(len(texts))] == up


def test_repeats_of_words(spark):
    """Word units: runs, overlaps, repeats within a text, other case and white space; equal texts lose all."""
    from nearfield.llm.suffix_dedup import remove_repeats

    rng = random.Random(9)
    texts = [None, "", " ", "a " * 40, "x y z"]
    for _ in range(80):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        texts.append(rng.choice([" ", "  ", "\n"]).join(rng.choice([w, [x.upper() for x in w]])))
    texts.append(texts[-1] + " é")
    n, words = 6, [(t or "").lower().split() for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    same = Counter(t or "" for t in texts)
    got = _by_id(remove_repeats(_docs(spark, texts), n, unit="word", keep_text=True))
    for d, (t, w) in enumerate(zip(texts, words)):
        on = [any(count[tuple(w[j : j + n])] > 1 for j in range(max(0, i - n + 1), min(i + 1, len(w) - n + 1))) for i in range(len(w))]
        left = [] if same[t or ""] > 1 and len(w) >= n else [x for x, gone in zip(w, on) if not gone]
        assert got[d].kept_text.lower().split() == left, (d, t)


def test_maximal_repeats_with_all_occurrences(spark):
    """Every whole group is a maximal repeat with all of its places; every maximal repeat that contexts hold is there."""
    from nearfield.llm.suffix_dedup import repeat_groups

    rng, n = random.Random(12), 24
    parts = ["".join(rng.choice("abcdefgh") for _ in range(m)) for m in (24, 24, 26, 30, 33, 50)]
    texts = [None, "", "short"]
    for i in range(40):
        own = ["".join(rng.choice("ABCDEFGH") for _ in range(rng.randint(1, 30))) for _ in range(3)]
        texts.append(own[0] + parts[i % 6] + own[1] + (parts[rng.randrange(6)][: rng.randint(1, 50)] if i % 2 else "") + own[2])
    texts.append(texts[-1])
    raws = [(t or "").encode() for t in texts]
    at = defaultdict(set)
    for d, r in enumerate(raws):
        for i in range(len(r)):
            for j in range(i + n, min(len(r), i + 2 * n) + 1):
                at[r[i:j]].add((d, i))
    text = lambda d, i, m: raws[d][i : i + m]
    ends = lambda x: ({raws[d][i - 1 : i] or d for d, i in at[x]}, {raws[d][i + len(x) : i + len(x) + 1] or d for d, i in at[x]})
    maximal = {x for x, own in at.items() if len(own) > 1 and all(len(e) > 1 for e in ends(x))}
    got, whole = defaultdict(set), {}
    for r in repeat_groups(_docs(spark, texts), n, 6).collect():
        x = text(r.doc_id, r.start, r.length)
        got[x].add((r.doc_id, r.start))
        whole[x] = r.whole
    for x in got:
        assert got[x] == at[x] and (not whole[x] or x in maximal)
    assert {x for x in maximal if len(x) == n and len({raws[d] for d, _ in at[x]}) > 1} <= set(got) and sum(len(x) > n for x in got) > 0


def test_a_pair_of_a_large_group_is_sent_in_one_group_only(spark):
    """120 rows in five groups of all: pairs meet in the home, and in the other groups only with rows that have another home."""
    from pyspark.sql import functions as F

    from nearfield.llm import minhash

    rows = [(b, cid, 10, cid, 0 if cid < 115 else 1) for b in range(5) for cid in range(120)]
    groups = spark.createDataFrame(rows, "b long, cid long, size long, comp long, apart long")
    dealt = [(r.b, r.x, r.y, r.cid, r.side, r.apart) for r in minhash._dealt(groups, 10, 1000, True).collect()]
    assert len(dealt) == 5 * (115 + 5 * 13)  # 5 * 120 * 12 when all blocks met all
    own, met = {}, set()
    for b, x, y, cid, side, apart in dealt:
        own.setdefault((b, x, y), []).append((cid, side, apart))
    for task in own.values():
        met |= {frozenset((p[0], q[0])) for p in task for q in task if p[2] != q[2] and (p[1] == 2 or p[1] != q[1])}
    assert met == {frozenset((i, j)) for i in range(115) for j in range(115, 120)}
    homes = minhash._dealt(groups.where("b = 0").withColumn("apart", F.col("cid")), 10, 1000, False)
    own = {}
    for r in homes.collect():
        own.setdefault((r.x, r.y), []).append((r.cid, r.side))
    met = {frozenset((p[0], q[0])) for task in own.values() for p in task for q in task if p[0] != q[0] and (p[1] == 2 or p[1] != q[1])}
    assert len(met) == 120 * 119 // 2


@pytest.mark.parametrize("block", [4, 512])
def test_links_of_chained_copies_in_several_groups(spark, block):
    """Copies of copies, far from the group's smallest member: components are those of all pairs."""
    from nearfield.llm import minhash

    rng, words = random.Random(8), [f"w{i}" for i in range(400)]
    texts = [[rng.choice(words) for _ in range(60)]]
    for i in range(70):
        t = list(texts[rng.randrange(len(texts))])
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(60)] = rng.choice(words)
        texts.append(t)
    sets = [{tuple(t[i : i + 5]) for i in range(56)} for t in texts]
    least = list(range(len(texts)))
    for _ in least:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 75 * len(x | y):
                    least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, block=block).collect()}
    assert got == dict(enumerate(least)) and 1 < len(set(least)) < len(texts)
