"""Token counts of whole texts under a public tokenizer."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary file lies; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longest piece of text encoded at once; pieces end at white space where there is any.
PIECE = 100_000


def encoder(path: str = VOCABULARY, pattern: str | None = None):
    """The byte-level BPE whose ranks are in the file ``path``; ``pattern`` cuts texts into words, that of the installed vocabulary by default."""
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encode, text: str) -> int:
    """Tokens of the whole text. Texts longer than PIECE are encoded in pieces that begin at white space."""
    if len(text) <= PIECE:
        return len(encode(text))
    total, a = 0, 0
    while a < len(text):
        b = min(len(text), a + PIECE)
        if b < len(text) and (m := list(re.finditer(r"\s(?=\S)", text[max(a + 1, b - 2000) : b]))):
            b = max(a + 1, b - 2000) + m[-1].start()
        total += len(encode(text[a:b]))
        a = b
    return total


def with_tokens(df: DataFrame, text: str = "text", column: str = "n_tokens", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """``df`` without its text, with the number of tokens of the text (0 for null)."""
    kept = [c for c in df.columns if c != text]

    def run(batches):
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            counts = [count_tokens(encode, t) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64())], names=[*kept, column])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(column, T.LongType())])
    return df.select(*kept, text).mapInArrow(run, schema)
