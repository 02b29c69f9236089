"""Identity hashes: FNV-1a over UTF-16 code units, SHA digests, and the keys built from them."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME = 2166136261, 16777619
#: Prefixes of the four parts of a wide hash.
PARTS = ("a:", "b:", "c:", "d:")


def _fnv(values: list[str], prefix: str) -> list[str]:
    """FNV-1a of each prefixed value, all values a step at a time."""
    units = [np.frombuffer((prefix + v).encode("utf-16-le", "surrogatepass"), dtype=np.uint16) for v in values]
    order = np.argsort([-len(u) for u in units], kind="stable")
    lengths = np.array([len(units[i]) for i in order])
    state = np.full(len(values), OFFSET, dtype=np.uint64)
    if len(values) and lengths[0]:
        flat = np.concatenate([units[i] for i in order]).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for step in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            state[:live] = ((state[:live] ^ flat[starts[:live] + step]) * PRIME) & 0xFFFFFFFF
    out = [""] * len(values)
    for at, i in enumerate(order):
        out[i] = f"{int(state[at]):08x}"
    return out


def stable_hash(value: str) -> str:
    """32-bit FNV-1a of a string, as eight hexadecimal digits."""
    return _fnv([value], "")[0]


def wide_hash(value: str) -> str:
    """Four FNV-1a hashes of the value behind different prefixes, put together."""
    return "".join(_fnv([value], p)[0] for p in PARTS)


def canonical_json(value: object) -> str:
    """JSON with sorted keys and without white space."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_hash(value: object) -> str:
    """The wide hash of a value's JSON, keys in their given order."""
    return wide_hash(json.dumps(value, separators=(",", ":"), ensure_ascii=False))


def wide_hash_column(value: Column) -> Column:
    """``wide_hash`` of a string column; null stays null."""

    @F.pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        known = values.dropna()
        parts = [_fnv(known.tolist(), p) for p in PARTS]
        return pd.Series(["".join(x) for x in zip(*parts)] if len(known) else [], index=known.index, dtype=object).reindex(values.index)

    return hashed(value)


def fnv_expression(value: Column) -> Column:
    """``stable_hash`` of a short string (ids, keys) inside the JVM."""
    digits = F.hex(F.encode(value, "UTF-16BE"))
    units = F.when(F.length(value) > 0, F.sequence(F.lit(0), (F.length(digits) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(state: Column, i: Column) -> Column:
        unit = F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
        return (state.bitwiseXOR(unit) * F.lit(PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.lpad(F.lower(F.hex(F.aggregate(units, F.lit(OFFSET).cast("long"), step))), 8, "0")


def message_content_hash(session: Column, event: Column, seq: Column, role: Column, text: Column) -> Column:
    """The content hash of a message; null where any part is."""
    return wide_hash_column(reduce(lambda a, b: F.concat(a, F.lit(":"), b), [session, event, seq.cast("string"), role, text]))


def project_scope_token(project_key: Column) -> Column:
    return F.concat(F.lit("p"), F.sha1(project_key))


def fact_hash(fact: Column) -> Column:
    """SHA-256 of a fact's JSON, nulls left out."""
    return F.sha2(F.to_json(fact), 256)


def document_hash(prefix: str, text: Column, content_hash: Column) -> Column:
    """The hash under which an embedding is stored: of the prefixed text, or the content hash without a prefix."""
    return F.sha2(F.concat(F.lit(prefix), text), 256) if prefix else content_hash


def base64url(value: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.translate(F.regexp_replace(F.base64(value), "[=\\s]+", ""), "+/", "-_")
