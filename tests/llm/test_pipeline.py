"""Each stage of the pipeline against brute force over what the stage before it kept."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_llm import LOWER, WORD
from tokenizers import Tokenizer

ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _write(spark, folder):
    rng = random.Random(11)
    vocab = ["the", "stone", "river", "walks", "under", "green", "light", "slowly", "again", "north", *(f"w{i}" for i in range(200))]
    item = " ".join(f"q{rng.randrange(90)}" for _ in range(14))
    passage, texts, labels = " ".join(rng.choice(vocab) for _ in range(90)), [None, "", "a", "   \n"], []
    short = [[rng.choice(vocab) for _ in range(n)] for n in (50, 51, 52, 58, 70)]
    for i in range(300):
        w = [rng.choice(vocab) for _ in range(rng.randint(25, 60))]
        if i % 3 == 0:
            for _ in range(2):
                w[rng.randrange(25)] = rng.choice(["idiot", "moron", "scumbag"])
        if i % 10 == 1:
            w += passage.split()
        if i % 25 == 2:
            w += item.split()
        if i % 8 == 4:  # fewer bytes than op9's 400, in another case and with other spaces
            own = short[i // 8 % 5]
            w = w[:25] + ([x.upper() for x in own] if i % 16 == 4 else [" \n".join(own)]) + w[25:]
        if i % 10 == 7:
            w = (texts[-1] or "a").split()
        if i % 20 == 17:
            w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
        labels.append((len(texts) - 1, 1, int(any(x in ("idiot", "moron", "scumbag") for x in w))))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return labels


def _one_of_each_group(texts):
    sets, up = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in texts:
        for b in texts:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: t for d, t in texts.items() if find(d) == d}


def _without_repeats(texts, n=51):
    words, out = {d: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", (t or "").encode())] for d, t in texts.items()}, {}
    lower = {d: [(texts[d] or "").encode()[s:e].lower() for s, e in w] for d, w in words.items()}
    count = Counter(tuple(w[i : i + n]) for w in lower.values() for i in range(len(w) - n + 1))
    for d, w in lower.items():
        on = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                on[i : i + n] = True
        raw, left, at = (texts[d] or "").encode(), b"", 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(int)))))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            left, at = left + raw[at : words[d][s][0]], words[d][e - 1][1]
        out[d] = (left + raw[at:]).decode()
    return out


def _without_leaks(texts, items):
    windows = {tuple(w[i : i + 10]) for t in items if (w := ITEM_WORD.findall((t or "").translate(LOWER))) for i in range(max(1, len(w) - 9))}
    words = {d: ITEM_WORD.findall((t or "").translate(LOWER)) for d, t in texts.items()}
    return {d: texts[d] for d, w in words.items() if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))}


def test_every_stage(spark, tmp_path):
    import corpus_pipeline as c
    from nearfield.llm.common import materialize

    folder = str(tmp_path)
    labels = _write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in c.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name, lasting=True)
        assert docs.columns == COLUMNS
        rows = docs.collect()
        texts.append({r.doc_id: r.text for r in rows})
        assert len(rows) == len(texts[-1])
    tame, single, cut, clean = texts[1:]
    toxic = {d for d, _, t in labels if t}
    gone = set(texts[0]) - set(tame)
    assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) < 0.05 * len(texts[0])
    assert single == _one_of_each_group(tame) and len(single) < len(tame)
    assert {d: t or "" for d, t in cut.items()} == _without_repeats(single) and cut != {d: t or "" for d, t in single.items()}
    assert clean == _without_leaks(cut, [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]) and len(clean) < len(cut)
    tok, own, seqs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, {}
    for r in sorted(c.STAGES[-1][1](spark, docs, folder).collect(), key=lambda r: (r.sequence_id, r.offset)):
        ids = own.setdefault(r.doc_id, [*tok.encode(clean[r.doc_id] or "", add_special_tokens=False).ids, 0])
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert seqs.get(r.sequence_id, 0) == r.offset
        seqs[r.sequence_id] = r.offset + r.length
    assert set(own) == set(clean) and max(seqs.values()) <= 2048 and sum(seqs.values()) == sum(map(len, own.values()))


def test_near_dedup_of_repeated_and_null_ids(spark, tmp_path):
    """Rows are what stays or goes, not ids."""
    import corpus_pipeline as c

    rng = random.Random(13)
    one, two, three, four = (" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(4))
    rows = [(1, one), (1, one), (3, two), (5, two + " more"), (5, three), (None, four), (None, four), (None, one), (7, four + " more"), (None, None), (None, None), (8, ""), (8, "")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    single = c.near_dedup(spark, spark.read.parquet(path), str(tmp_path)).collect()
    want = [(1, one), (3, two), (5, three), (7, four + " more"), (None, None), (None, None), (8, ""), (8, "")]
    assert Counter((r.doc_id, r.text) for r in single) == Counter(want)
    spark.createDataFrame(single, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/single.parquet")
    cut = c.suffix_dedup(spark, spark.read.parquet(f"{tmp_path}/single.parquet"), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in cut) == Counter((i, t or "") for i, t in want)


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns named like results, empty tables."""
    import corpus_pipeline as c
    from nearfield.llm.common import materialize

    rng, folder = random.Random(17), str(tmp_path)
    long, item = " ".join(f"w{rng.randrange(9000)}" for _ in range(60_000)), " ".join(f"q{i}" for i in range(12))
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", "en", None, 0), (3, long, None, "s", None), (3, long, None, "s", None), (4, "x " + item, "en", "s", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, True, 7, 7, 7, 0.9, "t", 7, "u") for r in rows], f"{kind}, kept boolean, n_hit long, component_id long, piece int, score double, tid string, _row long, kept_text string")
    spark.createDataFrame([(1, 0), (None, 1), (2, None), (2, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (None, "a b c"), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    one = rows[:1] + rows[2:5] + rows[6:]
    empty = lambda r: (r[0], r[1] or "", r[2], r[3], len(r[1] or ""))
    wants = [rows, one, [empty(r) for r in one], [empty(r) for r in one if r[0] != 4]]
    for (name, stage), want in zip(c.STAGES, wants):
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS and Counter(map(tuple, out.collect())) == Counter(want), name
        docs = materialize(out.selectExpr("*", *(f"7 as {x}" for x in ("kept", "n_hit", "score", "length", "offset", "tid", "n_bytes"))), name, lasting=True)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = Counter()
    for r in c.packing(spark, docs, folder).collect():
        size[r.doc_id] += r.length
    assert size == {r[0]: len(tok.encode(r[1], add_special_tokens=False).ids) + 1 for r in wants[-1]}
    for name, stage in c.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
