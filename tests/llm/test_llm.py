"""Operators of the optional subpackage against brute force, on edge cases: nulls, empty, repeated, long and tied rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ODD = [None, "", " ", "\n\n", "a", "<|endoftext|> x<|endoftext|>", "naïve café — “quotes” 数据 🎉 ͸\U00010ec5", "tab\tand \x1c\x85 odd  spaces \n", "'s 're it's", "x" * 5000, "word " * 3000, "Zero\x00null"]


def _docs(spark, texts):
    """With columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double")


def _by_id(df):
    return {r.doc_id: r for r in df.collect()}


def _corpus(seed=0, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    passage, proto, out = [rng.choice(vocab) for _ in range(60)], [rng.choice(vocab) for _ in range(120)], list(ODD)
    for _ in range(n):
        u = rng.random()
        if u < 0.3:
            w = list(proto)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif u < 0.5:
            w = passage + [rng.choice(vocab) for _ in range(rng.randint(3, 60))]
        elif u < 0.6:
            w = (rng.choice(out) or "").split(" ")
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        out.append(" ".join(w).title() if rng.random() < 0.3 else " ".join(w))
    return out


def test_token_counts_and_packing(spark):
    from nearfield.llm.packing import assign, pack
    from nearfield.llm.token_counts import count_tokens
    from nearfield.llm.vocab import Pretokens

    texts, tok = _corpus(), Tokenizer.from_file(PATH)
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = _by_id(count_tokens(_docs(spark, texts), PATH, limit=100))
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(ids[i]), len((t or "").encode()), len(ids[i]) > 100), t
    rows = pack(_docs(spark, texts), PATH, max_tokens=256).collect()
    seqs = {}
    for r in sorted(rows, key=lambda r: r.offset):
        part = np.array([*ids[r.doc_id], 0], "<u4")[r.start : r.start + r.length]
        assert len(part) == r.length <= 256 and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert seqs.get(r.sequence_id, 0) == r.offset
        seqs[r.sequence_id] = r.offset + r.length
    assert max(seqs.values()) <= 256 and sum(seqs.values()) == sum(len(x) + 1 for x in ids.values())
    for rule in ("norm", "dot"):
        bins, _ = assign(np.array([5, 5, 4, 3, 2, 1]), 10, 3, 60.0, rule)
        for b in set(bins.tolist()):
            own = np.array([5, 5, 4, 3, 2, 1])[bins == b]
            assert own.sum() <= 10 and len(own) <= 3 and (own**2).sum() <= 60
    pre, rng = Pretokens(PATH), random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("ab'st 1\n\té ²ªª\xa0!…ſ") for _ in range(rng.randint(1, 30)))
        assert pre.split(t) is None or [i for p in pre.split(t) for i in pre.ids(p)] == pre.ids(t), repr(t)
        assert pre.split(t) is None or [i for p in pre.split(t) for i in pre.merged(p)] == pre.ids(t), repr(t)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000, 97)]):  # one character is one pre-token
        assert pre.merged(c) == pre.ids(c), repr(c)


def test_quality_rules(spark):
    from nearfield.llm.quality_rules import quality_rules

    texts = _corpus(1) + ["a b c\na b c\n\na b c", "p q r s t u v w x y z " * 20, "x #*$%&|<> y"]
    got = _by_id(quality_rules(_docs(spark, texts)))
    for i, t in enumerate(texts):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]

        def inside(k):
            c = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
            return len({x for j in range(len(w) - k + 1) if c[tuple(w[j : j + k])] > 1 for x in range(j, j + k)})

        longest = next((k for k in range(min(len(w), 3000), 0, -1) if len(w) < 400 and any(v > 1 for v in Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)).values())), None)
        failed = len(w) < 50 or 100 * inside(3) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), inside(3), failed)
        assert r.repeated_words == inside(10) and (len(w) >= 400 or r.longest_repeat == (longest or 0))


def test_decontamination(spark):
    from nearfield.llm.decontamination import find_leaks

    rng, word = random.Random(3), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    items = [(k, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randint(1, 25)))) for k in range(30)] + [(30, None), (31, " ,. "), (None, "w1 w2"), (2, "w7"), (33, "é É ß")]
    texts = _corpus(2) + [f"Intro, {t.upper()}! end" if t else t for _, t in items] + ["é-é ß É ß"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (32 << 20, 200):
        got = _by_id(find_leaks(_docs(spark, texts), bench, block_bytes=block))
        windows = {}
        for k, t in items:
            w = word.findall((t or "").translate(LOWER))
            for i in range(max(1, len(w) - 9)) if w and k is not None else ():
                windows.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
        for d, t in enumerate(texts):
            w, hit, own = word.findall((t or "").translate(LOWER)), set(), set()
            for n in {len(k) for k in windows}:
                for i in range(len(w) - n + 1):
                    if (k := tuple(w[i : i + n])) in windows:
                        hit.update(range(i, i + n))
                        own |= windows[k]
            assert (got[d].n_words, got[d].n_hit, got[d]["items"]) == (len(w), len(hit), sorted(own))
            assert sum(len(word.findall(t[s.start : s.end])) for s in got[d].spans) == len(hit)


def test_near_duplicates(spark):
    from nearfield.llm.minhash import near_duplicates

    texts = _corpus(4, 200)
    sets = {}
    for d, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    for block in (1024, 16):
        got = _by_id(near_duplicates(_docs(spark, texts), block=block))
        assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_near_duplicates_of_a_hot_text(spark):
    """More near copies of one text than a part of the confirming step holds."""
    from nearfield.llm.minhash import near_duplicates

    words = [f"h{i}" for i in range(120)]
    texts = [" ".join([*words[: i % 110], f"x{i}", *words[i % 110 + 1 :]]) for i in range(700)] + ["of another kind altogether , this one"]
    got = _by_id(near_duplicates(_docs(spark, texts), block=256))
    assert {r.component_id for r in got.values()} == {0, 700} and [d for d, r in got.items() if r.kept] in ([0, 700], [700, 0])


def test_suffix_dedup(spark):
    from nearfield.llm.suffix_dedup import remove_repeats

    rng, texts = random.Random(6), [None, "", "aaaa" * 30, "é" * 40]
    for _ in range(60):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) + rng.choice("ab") * rng.randint(0, 50)
        if rng.random() < 0.5:
            o = rng.choice(texts) or ""
            t = t[:7] + o[: rng.randint(0, 60)] + t[7:]
        texts.append(t)
    length, raws = 12, [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for block in (4096, 3):
        got = _by_id(remove_repeats(_docs(spark, texts), length, block=block))
        for d, r in enumerate(raws):
            on = np.zeros(len(r), bool)
            for i in range(len(r) - length + 1):
                if count[r[i : i + length]] > 1:
                    on[i : i + length] = True
            kept = bytes(np.frombuffer(r, np.uint8)[~on])
            assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (len(r), int(on.sum()), hashlib.sha256(kept).hexdigest())
            assert got[d].n_spans == int((np.diff(np.concatenate(([0], on.astype(int)))) == 1).sum())


def test_suffix_dedup_after_periodic_runs(spark):
    """A text with a long run and one with its tail, both followed by the same short text and then by others."""
    from nearfield.llm.suffix_dedup import remove_repeats

    rng, texts, length = random.Random(12), [], 40
    some = lambda n: "".join(map(rng.choice, ["abcdefghijklmnopqrstuvwxyz0123456789"] * n))
    for _ in range(1500):
        unit, tail, more = some(rng.randint(1, 10)), rng.randint(20, 39), rng.randint(0, 4)
        run, x = (unit * 160)[:160], some(length - tail + more)
        texts += [some(20) + run + x + some(60), some(20) + run[-tail:] + x + some(60)]
        if rng.random() < 0.3:
            texts.append(some(20) + (unit * 160)[3:150] + run[-7:] + x + some(50))
    raws = [t.encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    got = _by_id(remove_repeats(_docs(spark, texts), length))
    for d, r in enumerate(raws):
        on = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                on[i : i + length] = True
        assert (got[d].n_removed, got[d].kept_sha256) == (int(on.sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~on])).hexdigest()), d


def test_lm_scoring(spark):
    from nearfield.llm.elias_fano import EliasFano
    from nearfield.llm.lm_scoring import score_texts

    rng = np.random.default_rng(0)
    for n, u in ((0, 10), (1, 5), (3000, 1 << 50), (5000, 6000), (20000, 1 << 30)):
        v = rng.integers(0, u, n, dtype=np.uint64)
        v[: n * 9 // 10] = np.uint64(u // 3) + v[: n * 9 // 10] % np.uint64(max(1, u // 100000))
        v = np.sort(v % np.uint64(u))
        e, x = EliasFano.build(v, u), np.concatenate((v, rng.integers(0, u, 500, dtype=np.uint64)))
        at, known = e.successor(x)
        assert (e[np.arange(n)] == v).all() and (at == np.searchsorted(v, x)).all() and (known == np.isin(x, v)).all()
    texts = _corpus(7)
    own = {d: [*WORD.findall((t or "").translate(LOWER)), None] for d, t in enumerate(texts)}
    train = [d for d in own if zlib.crc32(str(d).encode()) % 10]
    c, b = Counter(), Counter()
    for d in train:
        c.update(own[d])
        b.update(zip([None, *own[d]], own[d]))
    total, words, kids = sum(c.values()), len(c), Counter(x for x, _ in b)
    share = lambda k, most: min(most, max(0.05, sum(v == 1 for v in k.values()) / (sum(v == 1 for v in k.values()) + 2 * sum(v == 2 for v in k.values()))))
    one, two = share(c, 0.95), share(b, 0.98)
    for shares in (4_000_000, 500):
        for d, r in _by_id(score_texts(_docs(spark, texts), share=shares)).items():
            base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (words + 1))) for w in own[d])
            score = 0.0
            for p, w in zip([None, *own[d]], own[d]):
                q = (c[w] - one) / total if c[w] else one * words / total
                if c[p]:
                    q = max(b[p, w] - two, 0) / c[p] + two * kids[p] / c[p] * q
                score += math.log10(q)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own[d]), sum(c[w] > 0 for w in own[d]), total)
            assert r.base_score == pytest.approx(base) and abs(r.score - score) <= 0.03 * len(own[d])


def test_classifiers_on_held_out_rows(spark):
    from nearfield.llm.queries import op3_quality_classifier, op4_toxicity

    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    tox = [(r.predicted, labels[r.doc_id].toxic) for r in op4_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in tox]) > 0.96
    good = [(int(r.kept), labels[r.doc_id].quality) for r in op3_quality_classifier(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in good]) > 0.93


def test_gapped_insults(spark):
    from nearfield.llm.toxicity import score_toxicity

    rng = random.Random(8)
    words = ["the", "stone", "river", "walks", "under", "green", "light", "slowly", "again", "north"]
    rows = []
    for i in range(600):
        w = [rng.choice(words) for _ in range(30)]
        if i % 3 == 0:
            w[rng.randrange(30)] = rng.choice(["idiot", "moron", "scumbag"])
            w[rng.randrange(30)] = rng.choice(["idiot", "moron", "scumbag"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    extra = [(1000, "the i d i o t walks under i-d-i-o-t green light slowly"), (1001, "the stone walks under green light slowly again north"), (1002, None)]
    docs = spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string")
    got = _by_id(score_toxicity(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")))
    assert got[1000].score > got[1001].score and got[1001].predicted == 0 and got[1002].predicted == 0


def test_licenses(spark):
    from nearfield.llm.licenses import scan_licenses

    files = [(0, "a/LICENSE", "Released under the MIT License."), (1, "a/b/x.py", "no notice"), (2, "a/y.py", "code\nLicensed under the Apache License, Version 2.0.\ncode"), (3, "c/z.py", "text"), (4, None, None), (5, "a/b/LICENSE.txt", "nothing of the kind")]
    got = _by_id(scan_licenses(spark, spark.createDataFrame(files, "doc_id long, path string, text string")))
    assert {d: (r.license, r.origin) for d, r in got.items()} == {0: ("MIT", "own"), 1: ("MIT", "inherited"), 2: ("Apache-2.0", "own"), 3: (None, "none"), 4: (None, "none"), 5: ("MIT", "inherited")}


def test_whole_licenses_and_headers(spark):
    from pathlib import Path

    from nearfield.llm.licenses import HEADERS, full_texts, scan_licenses

    def reworked(text):  # another holder, other line ends
        words = text.replace("The Regents of the University of California", "2020 Jane Roe").replace("REGENTS", "AUTHORS").split()
        return "Copyright 2021 Some Company, Inc.\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))

    common = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "MPL-2.0": "MPL-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "CC0-1.0": "CC0-1.0"}
    texts = [(lic, (Path("/usr/share/common-licenses") / name).read_text()) for name, lic in common.items()]
    texts += [x for x in full_texts() if x[0] in ("MIT", "ISC", "BSD-2-Clause", "Unlicense", "AGPL-3.0") and x not in HEADERS]
    files, want = [], {}
    for k, (lic, text) in enumerate(texts):
        files += [(2 * k, f"p{k}/LICENSE", reworked(text)), (2 * k + 1, f"p{k}/a/b.py", "x = 1")]
        want |= {2 * k: (lic, "own"), 2 * k + 1: (lic, "inherited")}
    styles = [("", "# ", ""), ("/*\n", " * ", "\n */"), ("/*\n", "", "\n*/"), ("<!--\n", "  ", "\n-->"), ("", "// ", "")]
    for k, (lic, text) in enumerate(HEADERS):
        first, mark, last = styles[k % len(styles)]
        words, d = text.split(), 100 + k
        lines = [" ".join(words[i : i + 4]) for i in range(0, len(words), 4)]
        files.append((d, f"h{k}/x", "start\n" + first + "\n".join(mark + x for x in lines) + last + "\ncode(1)\n"))
        want[d] = (lic, "own")
    files.append((200, "long/x", "# no notice here\n" * 20000 + "# copyright\n"))
    want[200] = (None, "none")
    got = _by_id(scan_licenses(spark, spark.createDataFrame(files, "doc_id long, path string, text string")))
    assert {d: (r.license, r.origin) for d, r in got.items()} == want


def test_empty_tables(spark):
    from nearfield.llm.decontamination import find_leaks
    from nearfield.llm.lm_scoring import score_texts
    from nearfield.llm.minhash import near_duplicates
    from nearfield.llm.packing import pack
    from nearfield.llm.quality_classifier import co_train
    from nearfield.llm.quality_rules import quality_rules
    from nearfield.llm.suffix_dedup import remove_repeats
    from nearfield.llm.token_counts import count_tokens
    from nearfield.llm.toxicity import score_toxicity

    none = _docs(spark, ["x"]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (count_tokens(none, PATH), quality_rules(none), co_train(none, labels), score_toxicity(none, labels), score_texts(none), pack(none, PATH), find_leaks(none, bench), near_duplicates(none), remove_repeats(none)):
        assert df.count() == 0
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(same).collect()} == {(1, 1), (None, None), (2, 2)}
    assert sorted(r.n_removed for r in remove_repeats(same, 5).collect()) == [0, 11, 11, 11]
    assert score_toxicity(same, labels).where("predicted = 0").count() == 4
