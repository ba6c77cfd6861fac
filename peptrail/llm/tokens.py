"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A rank file of byte-level BPE (base64 token, rank); every executor must have it at this path.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges of these rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are encoded at once, about. A longer text is cut where the pattern has a border whatever stands around: behind a letter or
#: digit where another kind of character follows, and between a visible character and a blank. So its tokens are those of the whole.
BLOCK = 500_000
_BORDER = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER, block: int = BLOCK) -> int:
    """Tokens of a text; 0 for null and empty text."""
    if not text:
        return 0
    e, n, a = encoder(path), 0, 0
    while a < len(text):
        b = len(text)
        if b - a > block and (cut := _BORDER.search(text, a + block)):
            b = cut.start()
        n += len(e.encode_ordinary(text[a:b]))
        a = b
    return n


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t, path) for t in texts], dtype="int64")

    return count(text)


def same_source(c: Column) -> Column:
    """One spelling of a source's name: lower case, underscores, no blanks around it; null for empty names."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"), F.lit(""))


def sized_documents(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, cluster, n_tokens) of every document with at least one token; cluster is its family, else a hash of its text."""
    cluster = F.xxhash64("text")
    if "family_id" in docs.columns:
        cluster = F.when(F.col("family_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.lit("family"), "family_id"))
    return docs.select("doc_id", same_source(F.col("source")).alias("source"), cluster.alias("cluster"), token_count(F.col("text"), path).alias("n_tokens")).where("n_tokens > 0")
