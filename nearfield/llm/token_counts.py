"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come back as one
token are proven and count directly. Only pre-tokens that aren't proven are
merged, once per worker while its bounded table remembers them. One pass over
the texts, no shuffle; the proven set is as large as the vocabulary at most.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_text, strings
from .vocab import Counts, Pretokens, whole_tokens

_STATE: dict[str, tuple] = {}


def _counter(path: str, proven) -> tuple:
    if path not in _STATE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _STATE[path] = (lambda text: None), (lambda text: len(model.encode(text, num_threads=1))), None
        else:
            pre = Pretokens(path)
            _STATE[path] = pre.split, lambda text: len(pre.ids(text)), Counts(pre, proven.value)
    return _STATE[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_direct) of every row of docs, whole texts.

    vocabulary: a tokenizers .json or a sentencepiece .model, at the same path
    on every machine. No begin, end or added special tokens, truncation or
    padding; strings of special tokens inside a text are handled as the library
    does by default. n_direct: tokens that the shortcut counted without a merge.
    Null and empty texts: 0 bytes, 0 tokens. Rows are kept as they are, with
    null or repeated ids too; an empty table gives no rows.
    """
    proven = docs.sparkSession.sparkContext.broadcast(frozenset() if vocabulary.endswith(".model") else whole_tokens(vocabulary))

    def batch(b: pa.RecordBatch) -> dict:
        split, whole, counts = _counter(vocabulary, proven)
        known, n_bytes, n_tokens, direct = proven.value, [], [], []
        for text in strings(b):
            pieces = split(text)
            n_bytes.append(len(text) if text.isascii() else len(text.encode()))
            if pieces is None:
                n_tokens.append(whole(text))
                direct.append(0)
            else:
                n_tokens.append(sum(map(counts.__getitem__, pieces)))
                direct.append(sum(map(known.__contains__, pieces)))
        return {"doc_id": b.column(0), "n_bytes": n_bytes, "n_tokens": n_tokens, "n_direct": direct}

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = arrow_map(rows, batch, f"doc_id {kind}, n_bytes long, n_tokens long, n_direct long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_direct")
