"""Encoding a corpus with a public byte-level BPE tokenizer.

The tokenizers library does the encoding, over Arrow batches. A text is first cut before each space
that precedes a visible character: the tokenizer's own pre-tokenization always has a boundary there,
so the ids of the parts, put together, are the ids of the text (tests compare them). Parts repeat, so
each task encodes a part once and keeps its ids; the memory of that is bounded and only saves time.
Decoding reverses the byte table: each of the vocabulary's characters stands for one byte, so a
character split over tokens is put together again once all bytes are there.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.arrow import map_lists

#: Parts kept a task; beyond it the memory starts anew.
KEPT_PARTS = 300_000
_CUT = re.compile(r"(?= \S)")


def default_tokenizer() -> str:
    """The path of the public byte_bpe_50k vocabulary installed on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class Encoder:
    """Encodes texts with the tokenizer of ``path``; special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, tuple[int, ...]] = {}

    def parts(self, texts: list[str | None]) -> list[list[str]]:
        """The parts of each text, all of them known afterwards."""
        if len(self.known) > KEPT_PARTS:
            self.known.clear()
        cut = [_CUT.split(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        if new:
            for part, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                self.known[part] = tuple(e.ids)
        return cut

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts have none."""
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, parts))) for parts in self.parts(texts)]

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        cut = self.parts(texts)
        size = {p: len(ids) for p, ids in self.known.items()} if len(self.known) < 4 * sum(map(len, cut)) else None
        if size is None:
            return [sum(len(self.known[p]) for p in parts) for parts in cut]
        return [sum(map(size.__getitem__, parts)) for parts in cut]

    def offsets(self, text: str | None) -> list[tuple[int, int]]:
        """Start and end of each token in code points; tokens that split a character share it."""
        return list(self.tokenizer.encode(text, add_special_tokens=False).offsets) if text else []


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others follow, in order, from code point 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Decoder:
    """Turns ids back into text; ids without a token are left out, broken characters become U+FFFD."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        table = byte_of_character()
        self.bytes_of = {i: bytes(table[c] for c in token) for token, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=False).items() if all(c in table for c in token)}

    def text(self, ids: list[int] | None) -> str:
        return b"".join(self.bytes_of.get(i, b"") for i in ids or []).decode("utf-8", "replace")


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str, with_offsets: bool = False) -> DataFrame:
    """``key, ids`` (array of int) for each row of ``df``, and with ``with_offsets`` the code-point ``starts`` and ``ends``.

    Null and empty texts have the empty list; repeated rows give repeated results; other columns are
    ignored. No row moves between executors: the plan is one scan and one Python stage.
    """
    kind = df.schema[key].dataType.simpleString()
    source = df.select(key, F.col(text).alias("_text"))
    if with_offsets:

        def make_offsets():
            encoder = Encoder(tokenizer)

            def run(rows: dict) -> dict:
                spans = [encoder.offsets(t) for t in rows["_text"]]
                return {key: rows[key], "ids": encoder.ids(rows["_text"]), "starts": [[a for a, _ in s] for s in spans], "ends": [[b for _, b in s] for s in spans]}

            return run

        return map_lists(source, make_offsets, f"`{key}` {kind}, ids array<int>, starts array<int>, ends array<int>")

    def run(batches):
        encoder = Encoder(tokenizer)
        get = encoder.known.__getitem__
        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts = encoder.parts(batch.column(1).to_pylist())
            lists = [list(map(get, p)) for p in parts]
            sizes = np.array([sum(map(len, x)) for x in lists], dtype=np.int32)
            values = np.fromiter(chain.from_iterable(chain.from_iterable(lists)), dtype=np.int32, count=int(sizes.sum()))
            ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, key: str, ids: str, tokenizer: str) -> DataFrame:
    """``key, text`` for each row of ``df``: the text of its ids. A null list gives the empty text."""

    def make():
        decoder = Decoder(tokenizer)
        return lambda rows: {key: rows[key], "text": [decoder.text(x) for x in rows["_ids"]]}

    return map_lists(df.select(key, F.col(ids).alias("_ids")), make, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """``key, n_tokens`` (bigint) for each row of ``df``; null and empty texts have 0."""

    def make():
        encoder = Encoder(tokenizer)
        return lambda rows: {key: rows[key], "n_tokens": encoder.counts(rows["_text"])}

    return map_lists(df.select(key, F.col(text).alias("_text")), make, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint")
