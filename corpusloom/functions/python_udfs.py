"""The only module with Python UDFs: what Spark has no expression for. All are Arrow-batched, and built when first used: that needs a session."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMBED_DIM = 512


def _nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _decode_text(s: pd.Series) -> pd.Series:
    """Bytes as UTF-8, else as Windows-1252, else as UTF-8 with replacement characters."""

    def one(b: bytes) -> str:
        for codec in ("utf-8", "cp1252"):
            try:
                return bytes(b).decode(codec)
            except UnicodeDecodeError:
                continue
        return bytes(b).decode("utf-8", "replace")

    return s.map(one, na_action="ignore")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the characters of a."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & at.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def _indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * (1 - insertions and deletions / summed length); two empty strings: 100. The score of single tokens in token-set comparison."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        total = len(x) + len(y)
        return 100.0 * 2 * _lcs(x, y) / total if total else 100.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _hash_embedding(tokens: pd.Series) -> pd.Series:
    """Unit vector of hashed tokens: slot blake2b-4(token) mod EMBED_DIM gets 1 + ln(count); no tokens: zeros."""

    def one(words) -> list[float]:
        v = np.zeros(EMBED_DIM)
        for w, n in sorted(Counter(words if words is not None else ()).items()):
            v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") % EMBED_DIM] += 1 + np.log(n)
        norm = np.sqrt((v * v).sum())
        return (v / norm if norm else v).tolist()

    return tokens.map(one)


def nfkc(c: Column | str) -> Column:
    """Unicode compatibility composition."""
    return F.pandas_udf(_nfkc, "string")(c)


def decode_text(c: Column | str) -> Column:
    """Bytes as UTF-8, else as Windows-1252, else as UTF-8 with replacement characters."""
    return F.pandas_udf(_decode_text, "string")(c)


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """100 * (1 - insertions and deletions / summed length); two empty strings: 100. The score of single tokens in token-set comparison."""
    return F.pandas_udf(_indel_ratio, "double")(a, b)


def hash_embedding(tokens: Column | str) -> Column:
    """Unit vector of hashed tokens: slot blake2b-4(token) mod EMBED_DIM gets 1 + ln(count); no tokens: zeros."""
    return F.pandas_udf(_hash_embedding, "array<double>")(tokens)
