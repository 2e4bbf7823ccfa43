"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised to lower-case words and each word of the
benchmark gets a code of two or three characters; every run of `window`
consecutive words of an item, or the whole of a shorter one, is a pattern of
their codes. Each document is normalised the same way, words that no item has
to one code, and scanned once; hits are places of words, mapped back to offsets
of the original text. One pass over the documents, no shuffle.

Measured: an automaton of 1 MB of benchmark with 30,000 words takes 0.23 GB. Benchmarks go to the
workers in blocks of at most block_bytes of text (one block for any usual
benchmark). Of a larger one a worker holds one block's automaton at a time and
scans `gather` bytes of documents before the next, so memory is bounded by both
and results stay whole.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_text, raw_bytes

#: Bytes of words to themselves or to lower case, all others to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_AUTOMATA: dict = {}
#: Values of one character of a word's code: a node's children are looked through one by one, so they must be few.
DIGIT = 64


class Patterns:
    """The automaton of some items, and the code of each of their words; a pattern's value is (its words, its items).

    A code is `width` characters, of another alphabet at each place, so that
    codes meet only at their starts; words that no item has share one code.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        texts = [(item, text.translate(TABLE).split()) for item, text in items]
        known = sorted({w for _, words in texts for w in words})
        self.width = 1
        while DIGIT**self.width < len(known):
            self.width += 1
        self.other = "\0" * self.width
        self.code = {w: "".join([chr(1 + DIGIT * j + k // DIGIT**j % DIGIT) for j in range(self.width)]) for k, w in enumerate(known)}
        owners = defaultdict(set)
        for item, words in texts:
            for i in range(max(1, len(words) - window + 1)) if words else ():
                owners["".join([self.code[w] for w in words[i : i + window]])].add(item)
        self.auto = ahocorasick.Automaton()
        shared: dict[tuple, tuple] = {}
        for key, own in owners.items():
            value = (len(key) // self.width, tuple(sorted(own)))
            self.auto.add_word(key, shared.setdefault(value, value))
        if owners:
            self.auto.make_automaton()

    def hits(self, words: list[bytes]):
        """(first word, words, items) of each occurrence of a pattern."""
        if len(self.auto):
            of, other = self.code.get, self.other
            for end, (n, own) in self.auto.iter("".join([of(w, other) for w in words])):
                yield end // self.width - n + 1, n, own


def _patterns(block, window: int) -> Patterns:
    """The block's automaton; a worker holds one."""
    key = (block[0], window)
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Patterns(block[1].value, window)
    return _AUTOMATA[key]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, sc = max(1, -(-total // block_bytes)), benchmark.sparkSession.sparkContext
    parts = [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]
    return [(uuid.uuid4().hex, sc.broadcast([(r.item, r.text.encode()) for r in p.toLocalIterator()])) for p in parts]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 512 << 10, gather: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row of docs.

    items: the item ids (as strings, sorted as strings) with a window in the
    text; spans: [start, end) in characters of the original text of each
    maximal run of hit words; n_hit: the words in them. Null and empty texts
    have no words and no hits; items without words or with a null id have no
    windows. carry: columns of docs that go along. Repeated rows and
    items count once per row of docs; an empty benchmark hits nothing, an empty
    table gives no rows.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)

    def batch(b: pa.RecordBatch) -> dict:
        out = {"doc_id": b.column(0), "n_words": [], "n_hit": [], "items": [], "spans": []}
        raws = raw_bytes(b)
        texts = [r.translate(TABLE).split() for r in raws]
        hits: dict[int, list] = defaultdict(list)
        owners: dict[int, set] = defaultdict(set)
        for block in blocks:
            patterns = _patterns(block, window)
            for i, words in enumerate(texts):
                for first, n, own in patterns.hits(words):
                    hits[i].append((first, n))
                    owners[i].update(own)
        for i, words in enumerate(texts):
            out["n_words"].append(len(words))
            spans, n = ([], 0) if i not in hits else _spans(raws[i], words, hits[i])
            out["n_hit"].append(n)
            out["spans"].append(spans)
            out["items"].append(sorted(owners[i]) if i in owners else [])
        return out

    rows = id_text(docs, id_col, text_col, carry)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, batch, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>", rows=0 if len(blocks) > 1 else 500, carry=carry, text_col=text_col, gather=gather if len(blocks) > 1 else 0)


def _spans(raw: bytes, words: list[bytes], hits: list[tuple[int, int]]) -> tuple[list[dict], int]:
    """Runs of hit words as character offsets of the original, and how many words they hold."""
    first, n = np.array(hits).T
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + n, -1)
    hit = np.cumsum(change)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    at = [m.span() for m in WORD.finditer(raw)]
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(chars[at[a][0]]), "end": int(chars[at[z - 1][1]])} for a, z in zip(edge[::2], edge[1::2])], int(hit.sum())
