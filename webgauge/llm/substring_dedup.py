"""Substring deduplication by fixed-block anchors.

Every document is cut into non-overlapping blocks of half a window, which are indexed; every rolling window of that
length probes the index. A repeat of a whole window holds a block of each of its documents, so a place without a
hit from another document can't be in one. Hits are then extended: the full windows around them are
compared across documents, and those that start in an earlier document too merge into the maximal repeats.

  1. blocks and probes, packed, meet in buckets of their hash; each document gets back its hits, and whether a
     document with a smaller or with a larger id has the block;
  2. hits meet the texts: documents without hits are done; the others emit the windows around hits, those with
     smaller ones elsewhere as questions, those with larger ones as answers;
  3. windows meet in buckets; for each question the smallest id among the answers decides.

Blocks and answers are reduced to the smallest and largest id before they are shuffled, so a hot passage costs each
task one row, and questions stream past them. Windows meet by 64 bits and are told apart by 64 further ones.

Defined results: null and empty texts have no words; documents shorter than a window lose nothing; a null doc_id
neither is earlier than anything nor loses anything; rows that share an id are not earlier than each other; repeated
rows get equal results. Other columns are ignored. Nothing is sampled or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgauge.llm.packing import BUFFER, Found, batch_of, by_bucket, home, home_column, pack_ids, unpack_ids
from webgauge.llm.shared import partitions, written
from webgauge.llm.textarrays import Words, covered, flat, ids, slices

WINDOW = 50
#: Keys that a task holds before it deals them out; with its sorts about 60 bytes each.
HELD = BUFFER // 4
SMALLER, LARGER = 1, 2
_KEYS = "bucket int, kind int, ids binary, counts binary, keys binary, checks binary, least binary, most binary"
_KEYS_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("ids", "counts", "keys", "checks", "least", "most"))])
_HOME = "bucket int, kind int, ids binary, counts binary, keys binary, flags binary, doc_id long, text string, tag long"
_HOME_ARROW = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("ids", "counts", "keys", "flags")), ("doc_id", pa.int64()), ("text", pa.string()), ("tag", pa.int64())]
)
_DONE = "n_words long, n_removed long, kept_sha256 string, kept string"
#: Kinds of rows that step 2 writes.
DONE, OPEN, ANSWER, QUESTION = 0, 1, 2, 3


def reduced(keys: np.ndarray, checks: np.ndarray | None, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray | None, ...]:
    """Distinct keys, or pairs of key and check, in order, with their smallest and largest id."""
    order = np.argsort(keys, kind="stable") if checks is None else np.lexsort((checks, keys))
    keys, least, most = keys[order], least[order], most[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if checks is not None:
        checks = checks[order]
        new[1:] |= checks[1:] != checks[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return keys, checks, least, most
    return keys[at], None if checks is None else checks[at], np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)


def places(index: tuple[np.ndarray | None, ...], keys: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each key (and check) a place in reduced ones that aren't empty, and whether it is there."""
    last = len(index[0]) - 1
    at = np.minimum(np.searchsorted(index[0], keys), last)
    hit = index[0][at] == keys
    if checks is None:
        return at, hit
    while True:  # a second turn only where keys of different windows are equal
        on = np.flatnonzero(hit & (index[1][at] < checks))
        if not len(on):
            return at, hit & (index[1][at] == checks)
        to = np.minimum(at[on] + 1, last)
        hit[on] = (to > at[on]) & (index[0][to] == keys[on])
        at[on] = to


def deal(kind: int, keys: np.ndarray, checks: np.ndarray | None, owners: np.ndarray, buckets: int, asked: bool) -> Iterator[dict]:
    """Packed rows: questions (asked) with all their owners, else answers with the smallest and largest owner.

    Keys without checks only seek candidates: 32 bits and the bucket do.
    """
    if asked:
        rest = (owners,)
    else:
        keys, checks, *rest = reduced(keys, checks, owners, owners)
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    for b, k, c, *rest in by_bucket(bucket, keys, keys if checks is None else checks, *rest):
        row = {"bucket": b, "kind": kind} | ({"keys": k.astype(np.uint32).tobytes()} if checks is None else {"keys": k.tobytes(), "checks": c.tobytes()})
        if asked:
            row["ids"], row["counts"] = pack_ids(rest[0])
        else:
            row["least"], row["most"] = rest[0].tobytes(), rest[1].tobytes()
        yield row


def anchor_batches(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text to packed blocks (kind 0) and rolling probes (kind 1)."""
    block, held, size = window // 2, [], 0

    def flush() -> pa.RecordBatch:
        probes, owners, aligned = (np.concatenate(x) for x in zip(*held))
        rows = [*deal(0, probes[aligned], None, owners[aligned], buckets, False), *deal(1, probes, None, owners, buckets, True)]
        held.clear()
        return batch_of(_KEYS_ARROW, rows)

    for batch in batches:
        for part in slices(batch, 1):
            w = Words(*flat(part.column(1)))
            at, keys = w.windows(block)
            number, known = ids(part.column(0))
            of = w.texts()[at]
            use = (w.counts[of] >= window) & known[of]
            at, of, keys = at[use], of[use], keys[use]
            held.append((keys, number[of], (at - w.first[of]) % block == 0))
            size += len(keys)
            if size >= HELD:
                yield flush()
                size = 0
    if size:
        yield flush()


def match_batches(batches: Iterator[pa.RecordBatch], buckets: int, narrow: bool) -> Iterator[pa.RecordBatch]:
    """Packed rows in order of bucket and kind to the questions that have an answer, packed for the documents' homes."""
    kind = np.uint32 if narrow else np.uint64
    now, answers, index, hits = -1, [], None, []

    def flush() -> pa.RecordBatch:
        owners, keys, flags = (np.concatenate(x) for x in zip(*hits))
        hits.clear()
        rows = []
        for h, i, k, f in by_bucket(home(owners, buckets), owners, keys, flags):
            order = np.argsort(i, kind="stable")
            of, counts = pack_ids(i[order])
            full = (np.uint64(now) << np.uint64(32)) | k[order].astype(np.uint64) if narrow else k[order]
            rows.append({"bucket": h, "kind": 0, "ids": of, "counts": counts, "keys": full.tobytes(), "flags": f[order].tobytes()})
        return batch_of(_HOME_ARROW, rows)

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if hits:
                    yield flush()
                now, answers, index = row["bucket"], [], None
            keys = np.frombuffer(row["keys"], kind)
            checks = None if narrow else np.frombuffer(row["checks"], np.uint64)
            if row["kind"] == 0:
                answers.append((keys, keys if narrow else checks, np.frombuffer(row["least"], np.int64), np.frombuffer(row["most"], np.int64)))
                continue
            if index is None and answers:
                known, more, least, most = (np.concatenate(x) for x in zip(*answers))
                index, answers = reduced(known, None if narrow else more, least, most), []
            if index is None:
                continue
            owners = unpack_ids(row["ids"], row["counts"])
            at, hit = places(index, keys, checks)
            flags = ((index[2][at] < owners) * SMALLER + (index[3][at] > owners) * LARGER).astype(np.uint8)
            hit &= flags > 0
            if not narrow:
                hit &= flags & SMALLER > 0
            if hit.any():
                hits.append((owners[hit], keys[hit], flags[hit]))
                if sum(len(h[0]) for h in hits) >= HELD:
                    yield flush()
    if hits:
        yield flush()


def narrow_code(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Found, pa.RecordBatch]]:
    """Slices of text rows, each with what was found for their bucket; rows come in order of bucket and kind."""
    now, found = -1, Found()
    for batch in batches:
        buckets, kinds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], (buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1]), [True]]))
        for a, b in zip(cuts, cuts[1:]):
            if buckets[a] != now:
                now, found = buckets[a], Found()
            rows = batch.slice(a, b - a)
            if kinds[a] == 0:
                for r in rows.select([2, 3, 4, 5]).to_pylist():
                    found.add(unpack_ids(r["ids"], r["counts"]), np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["flags"], np.uint8))
            else:
                for part in slices(rows, 7):
                    yield found, part


def finished(part: pa.RecordBatch, row: int, n_words: int, removed: np.ndarray | None, keep_text: bool) -> dict:
    words = (part.column(7)[row].as_py() or "").encode().split()
    kept = b" ".join(w for w, r in zip(words, removed) if not r) if removed is not None else b" ".join(words)
    out = {"doc_id": part.column(6)[row].as_py(), "tag": part.column(8)[row].as_py(), "n_words": n_words}
    out |= {"n_removed": int(removed.sum()) if removed is not None else 0, "kept_sha256": hashlib.sha256(kept).hexdigest()}
    return out | {"kept": kept.decode() if keep_text and removed is not None else None}


def extend_batches(batches: Iterator[pa.RecordBatch], window: int, buckets: int, keep_text: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Texts with their hits to finished documents, open ones, and the windows around hits as answers and questions."""
    block, held, size = window // 2, [], 0

    def flush() -> pa.RecordBatch:
        keys, checks, owners, flags = (np.concatenate(x) for x in zip(*held))
        held.clear()
        less, more = flags & SMALLER > 0, flags & LARGER > 0
        rows = [*deal(ANSWER, keys[more], checks[more], owners[more], buckets, False), *deal(QUESTION, keys[less], checks[less], owners[less], buckets, True)]
        return batch_of(schema, rows)

    for found, part in at_home(batches):
        w = Words(*flat(part.column(7)))
        number, _ = ids(part.column(6))
        at, keys = w.windows(block)
        of = w.texts()[at]
        flags = found.look(number[of], narrow_code(keys, buckets))
        full, full_keys = w.windows(window)
        n = len(w.begin)
        around = np.zeros(len(full), np.uint8)
        for flag in (SMALLER, LARGER):
            hits = np.zeros(n + 1, np.int64)
            hits[at[flags & flag > 0] + 1] = 1
            hits = np.cumsum(hits)
            around |= ((hits[full + window - block + 1] - hits[full]) > 0).astype(np.uint8) * np.uint8(flag)
        use = around > 0
        owner = w.texts()[full[use]]
        if use.any():
            held.append((full_keys[use], w.windows(window, checks=True)[1][use], number[owner], around[use]))
        size += int(use.sum())
        is_open = np.zeros(part.num_rows, bool)
        is_open[owner[around[use] & SMALLER > 0]] = True
        rows = []
        for r in range(part.num_rows):
            if is_open[r]:
                rows.append({c: part.column(i)[r].as_py() for c, i in (("bucket", 0), ("doc_id", 6), ("text", 7), ("tag", 8))} | {"kind": OPEN})
            else:
                rows.append(finished(part, r, int(w.counts[r]), None, keep_text) | {"kind": DONE})
        yield batch_of(schema, rows)
        if size >= HELD:
            yield flush()
            size = 0
    if size:
        yield flush()


def cut_batches(batches: Iterator[pa.RecordBatch], window: int, keep_text: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Open texts with the windows that an earlier document has, to finished documents."""
    for found, part in at_home(batches):
        w = Words(*flat(part.column(7)))
        number, _ = ids(part.column(6))
        at, keys = w.windows(window)
        removed = covered(at[found.look(number[w.texts()[at]], keys) > 0], window, len(w.begin))
        rows = [finished(part, r, int(w.counts[r]), removed[w.first[r] : w.first[r + 1]], keep_text) for r in range(part.num_rows)]
        yield batch_of(schema, rows)


def at_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")


def dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, tag, n_words, n_removed, kept_sha256, kept of every document.

    ``kept``, if asked for, is the remaining text of documents that lost words, null for others; tag is a hash of
    the whole text.
    """
    spark, buckets = docs.sparkSession, partitions(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchors = d.mapInArrow(partial(anchor_batches, window=window, buckets=buckets), _KEYS)
    hits = written(at_bucket(anchors, buckets).mapInArrow(partial(match_batches, buckets=buckets, narrow=True), _HOME).drop("doc_id", "text", "tag"), "hits")
    texts = d.select(home_column(F.col("doc_id"), buckets).alias("bucket"), F.lit(1).alias("kind"), "doc_id", "text", F.xxhash64("text").alias("tag"))
    met = hits.unionByName(texts, allowMissingColumns=True)
    out = f"{_KEYS}, doc_id long, tag long, text string, {_DONE}"
    arrow = pa.schema([*_KEYS_ARROW, ("doc_id", pa.int64()), ("tag", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
    step = written(at_bucket(met, buckets).mapInArrow(partial(extend_batches, window=window, buckets=buckets, keep_text=keep_text, schema=arrow), out), "windows")
    columns = ["doc_id", "tag", "n_words", "n_removed", "kept_sha256", "kept"]
    done = step.where(F.col("kind") == DONE).select(*columns)
    windows = step.where(F.col("kind") >= ANSWER).select("bucket", (F.col("kind") - ANSWER).alias("kind"), "ids", "counts", "keys", "checks", "least", "most")
    earlier = at_bucket(windows, buckets).mapInArrow(partial(match_batches, buckets=buckets, narrow=False), _HOME)
    still = step.where(F.col("kind") == OPEN).select("bucket", F.lit(1).alias("kind"), "doc_id", "text", "tag")
    last = earlier.drop("doc_id", "text", "tag").unionByName(still, allowMissingColumns=True)
    end = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
    rest = at_bucket(last, buckets).mapInArrow(partial(cut_batches, window=window, keep_text=keep_text, schema=end), f"doc_id long, tag long, {_DONE}")
    return done.unionByName(rest)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, with repeats cut from the text; one that has no word left goes."""
    result = dedup(docs, window, keep_text=True).where("n_removed > 0")
    changed = written(result.select("doc_id", "tag", "kept").distinct(), "cut").toDF("cut_id", "cut_tag", "cut_text")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("tag"))
    joined = rows.join(changed, (F.col("key") == F.col("cut_id")) & (F.col("tag") == F.col("cut_tag")), "left")
    lost = F.col("cut_tag").isNotNull()
    out = {c: F.col("row")[c] for c in docs.columns}
    out["text"] = F.when(lost, F.col("cut_text")).otherwise(out["text"])
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(lost, F.length("cut_text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return joined.where(~lost | (F.col("cut_text") != "")).select(*(c.alias(name) for name, c in out.items()))
