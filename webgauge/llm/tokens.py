"""Token counts of byte-level BPE by rank-synchronous merging of numpy arrays.

A batch's distinct pre-tokens are one ragged array of symbols. Each round finds every sequence's lowest-rank pair and
merges all its places in that sequence at once; a sequence without a ranked pair is done, and what survives is
counted. Counts of pre-tokens are kept in a bounded table of the worker. The texts are only scanned.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are each counted; a special token's
string inside a text is one token, as the library takes it by default. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgauge.llm.textarrays import slices

#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
KEPT = 500_000
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's strings."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The vocabulary's merges as sorted arrays: pair of symbols to rank and merged symbol."""

    def __init__(self, model: dict):
        if model["model"]["type"] != "BPE" or model.get("normalizer") or model["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary without a normalizer is needed")
        if model["pre_tokenizer"]["add_prefix_space"] or not model["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only the plain byte-level pre-tokenizer is supported")
        stands = byte_symbols()
        numbers = {k: b for k, b in stands.items()}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            to = numbers.setdefault(a + b, len(numbers))
            pairs.setdefault((numbers[a], numbers[b]), (rank, to))
        self.size = len(numbers)
        keys = np.array([a * self.size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()], np.int32)[order]
        self.merged = np.array([t for _, t in pairs.values()], np.int32)[order]
        self.special = [t["content"] for t in model["added_tokens"]]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word when no pair of it is ranked."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), np.int64)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        active = np.flatnonzero(lengths)
        lengths = lengths[active]
        while len(active):
            first = np.cumsum(lengths) - lengths
            last = first + lengths - 1
            at = np.searchsorted(self.keys, key := symbols[:-1].astype(np.int64) * self.size + symbols[1:])
            at[at == len(self.keys)] = 0
            rank = np.full(len(symbols), _NONE, np.int32)
            rank[:-1] = np.where(self.keys[at] == key, self.ranks[at], _NONE)
            rank[last] = _NONE  # the pair across two sequences
            least = np.minimum.reduceat(rank, first)
            done = least == _NONE
            out[active[done]] = lengths[done]
            here = np.repeat(np.where(done, -1, least), lengths)
            hit = rank == here
            # of overlapping places of one pair, every other from the left
            begins = hit.copy()
            begins[1:] &= ~hit[:-1]
            runs = np.flatnonzero(begins)
            places = np.flatnonzero(hit)
            if len(runs) != len(places):
                places = places[(places - runs[np.cumsum(begins)[places] - 1]) % 2 == 0]
            symbols[places] = self.merged[at[places]]
            stay = np.repeat(~done, lengths)
            stay[places + 1] = False
            lengths = (lengths - np.bincount(np.searchsorted(first, places, "right") - 1, minlength=len(first)))[~done]
            symbols, active = symbols[stay], active[~done]
        return out


def count_batches(batches: Iterator[pa.RecordBatch], merges) -> Iterator[pa.RecordBatch]:
    table: Merges = merges.value
    pieces = regex.compile(PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None
    known: dict[str, int] = {}
    for batch in batches:
        for part in slices(batch, 1):
            texts, found, extra = part.column(1).to_pylist(), [], []
            for text in texts:
                text = text or ""
                if special is not None and special.search(text):
                    between = special.split(text)
                    found.append([p for x in between for p in pieces(x)])
                    extra.append(len(between) - 1)
                else:
                    found.append(pieces(text))
                    extra.append(0)
            new = list({p for x in found for p in x if p not in known})
            if len(known) + len(new) > KEPT:
                known.clear()
                new = list({p for x in found for p in x})
            for i in range(0, len(new), 50_000):
                some = new[i : i + 50_000]
                known.update(zip(some, table.count([p.encode() for p in some]).tolist()))
            get = known.__getitem__
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                    pa.array([sum(map(get, x)) + n for x, n in zip(found, extra)], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; ``vocabulary``: path of a tokenizer file."""
    with open(vocabulary, encoding="utf-8") as f:
        merges = Merges(json.load(f))
    shared = docs.sparkSession.sparkContext.broadcast(merges)  # as large as the vocabulary file's merges
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(partial(count_batches, merges=shared), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
