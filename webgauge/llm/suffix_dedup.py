"""Exact deduplication of byte strings over a partitioned suffix array.

The suffixes of all documents are partitioned so that equal ``LENGTH``-byte strings meet: a string belongs to the bucket
of its minimizer, the smallest hash of the GRAM-byte strings in it. Neighbouring strings with one minimizer travel
together as a stretch of text.

  1. stretches meet as hashes, by minimizer and 96 bits: one that an earlier document has too is a repeat as a whole. What is left
     are different stretches with one minimizer, which may share part of their strings;
  2. of those, one copy each sends its bytes; where a minimizer has more than HOT_STRETCHES of them (the text around a
     passage that many documents share), each string goes to a bucket by its own hash instead, once for each slice of texts;
  3. each bucket sorts the suffixes of its stretches by deep-shallow sorting: multikey quicksort, eight bytes a
     key, to SHALLOW bytes; each remaining group with a long common prefix is ordered by a blind trie. Strings of
     full length that end up equal are repeats, and those of later documents are reported.

Equal stretches are reduced to their smallest id in each task before they are shuffled; copies send no bytes. There is a bucket
for every BUCKET_BYTES of text, so that what a task holds doesn't grow with the input, and a task takes several, one after another.

Defined results: null and empty texts have no bytes; texts under LENGTH bytes lose nothing; a null doc_id neither is
earlier than anything nor loses anything; rows that share an id aren't earlier than each other; repeated rows get
equal results. What is kept needn't be valid UTF-8. Other columns are ignored. Nothing is sampled or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgauge.llm.packing import Found, batch_of, by_bucket, home, home_column, pack_ids, unpack_ids
from webgauge.llm.shared import partitions, written
from webgauge.llm.textarrays import BYTE_VALUES, SLICE_BYTES, U64, flat, ids, mix, prefix, slices, span_hashes, spans

LENGTH, GRAM, SHALLOW = 50, 20, 16
#: Replies to a document about a stretch: all of it is in an earlier document; it is to send its bytes.
#: HOT goes with SEND where the minimizer has more than HOT_STRETCHES different stretches.
REPEAT, SEND, HOT = 1, 2, 4
HOT_STRETCHES = 4096
#: Bytes of text to a bucket, which is held, and to a task, which isn't; stretches, bytes of text and replies that are dealt out together.
BUCKET_BYTES, TASK_BYTES, STRETCHES, SEND_BYTES, REPLIES = 1 << 22, 1 << 25, 1 << 20, 1 << 24, 1 << 20
_MEET = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("ids", "counts", "keys", "flags", "minimizers", "checks"))])
_MEET_SQL = "bucket int, kind int, ids binary, counts binary, keys binary, flags binary, minimizers binary, checks binary"
_STEP = pa.schema(
    [
        ("bucket", pa.int32()),
        ("kind", pa.int32()),
        *((c, pa.binary()) for c in ("ids", "counts", "starts", "lengths", "bytes", "repeats")),
        ("doc_id", pa.int64()),
        ("text", pa.string()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
    ]
)
_STEP_SQL = "bucket int, kind int, ids binary, counts binary, starts binary, lengths binary, bytes binary, repeats binary, doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
DONE, OPEN, STRETCH = 0, 1, 2


def stretches(text: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of a slice of texts: text number, first and last start of a string, minimizer, hash and further hash of each stretch."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none, none.view(U64), none.view(U64), none.view(U64)
    sums = prefix(BYTE_VALUES[text])
    at = np.arange(len(text) - GRAM + 1)
    least = mix(spans(sums, at, at + GRAM))
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    sizes = np.diff(offsets)
    of = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.flatnonzero(np.arange(len(text)) + length <= np.repeat(offsets[1:], sizes))
    if not len(valid):
        return none, none, none, none.view(U64), none.view(U64), none.view(U64)
    value, owner = least[valid], of[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    begin, end = valid[first], valid[last]
    return owner[first], begin, end, value[first], *span_hashes(text, begin, end + length, True)


def bucket_of(minimizers: np.ndarray, buckets: int) -> np.ndarray:
    # the smallest of many hashes isn't spread evenly
    return (mix(minimizers) % U64(buckets)).astype(np.int64)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, few of them unpacked at a time."""
    for at in range(0, batch.num_rows, 64):
        yield from batch.slice(at, 64).to_pylist()


def replies(owners: np.ndarray, keys: np.ndarray, flags: np.ndarray, buckets: int) -> Iterator[dict]:
    for h, i, k, f in by_bucket(home(owners, buckets), owners, keys, flags):
        order = np.argsort(i, kind="stable")
        of, counts = pack_ids(i[order])
        yield {"bucket": h, "kind": 0, "ids": of, "counts": counts, "keys": k[order].tobytes(), "flags": f[order].tobytes()}


def meet_batches(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text to packed stretches (kind 1) and to replies that need no one else (kind 0)."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        owners, minimizers, keys, checks = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((owners, checks, keys))
        owners, minimizers, keys, checks = owners[order], minimizers[order], keys[order], checks[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
        least = owners[new][np.cumsum(new) - 1] if len(keys) else owners
        again = owners > least
        rows = list(replies(owners[again], keys[again], np.full(int(again.sum()), REPEAT, np.uint8), buckets))
        owners, minimizers, keys, checks = owners[new], minimizers[new], keys[new], checks[new]
        for b, i, m, k, c in by_bucket(bucket_of(minimizers, buckets), owners, minimizers, keys, checks):
            order = np.argsort(i, kind="stable")
            of, counts = pack_ids(i[order])
            rows.append({"bucket": b, "kind": 1, "ids": of, "counts": counts, "keys": k[order].tobytes(), "minimizers": m[order].astype(np.uint32).tobytes(), "checks": c[order].astype(np.uint32).tobytes()})
        return batch_of(_MEET, rows)

    for batch in batches:
        for part in slices(batch, 1):
            number, known = ids(part.column(0))
            of, _, _, minimizers, keys, checks = stretches(*flat(part.column(1)), length)
            use = known[of]
            held.append((number[of[use]], minimizers[use], keys[use], checks[use]))
            size += int(use.sum())
            if size >= STRETCHES:
                yield flush()
                size = 0
    if size:
        yield flush()


def reply_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed stretches in order of bucket to replies for the documents' homes."""
    now, held, said, size = -1, [], [], 0

    def flush() -> int:
        owners, minimizers, keys, checks = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((owners, checks, keys, minimizers))
        owners, minimizers, keys, checks = owners[order], minimizers[order], keys[order], checks[order]
        group = np.ones(len(keys), bool)  # of a minimizer
        group[1:] = minimizers[1:] != minimizers[:-1]
        new = group.copy()  # of a stretch in it
        new[1:] |= (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
        flags = np.where(owners > owners[new][np.cumsum(new) - 1], REPEAT, 0).astype(np.uint8)
        at = np.flatnonzero(group)
        number = np.cumsum(group) - 1
        different = np.add.reduceat(new.astype(np.int64), at)
        several = different > 1
        several &= np.minimum.reduceat(owners, at) < np.maximum.reduceat(np.where(new, owners, np.iinfo(np.int64).min), at)
        flags[new & several[number]] |= SEND
        flags[new & (several & (different > HOT_STRETCHES))[number]] |= HOT
        use = flags > 0
        said.append((owners[use], keys[use], flags[use]))
        return int(use.sum())

    def deal() -> pa.RecordBatch:
        rows = list(replies(*(np.concatenate(x) for x in zip(*said)), buckets))
        said.clear()
        return batch_of(_MEET, rows)

    for batch in batches:
        through = []
        for row in rows_of(batch):
            if row["kind"] == 0:
                through.append(row)
                continue
            if row["bucket"] != now and held:
                size += flush()
                if size >= REPLIES:
                    yield deal()
                    size = 0
            now = row["bucket"]
            held.append((unpack_ids(row["ids"], row["counts"]), np.frombuffer(row["minimizers"], np.uint32), np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["checks"], np.uint32)))
        if through:
            yield batch_of(_MEET, through)
    if held:
        flush()
    if said:
        yield deal()


def cut(text: str | None, windows: np.ndarray, length: int) -> dict:
    """What a document's row says once the starts of all its repeated strings are known."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, windows, 1)
    np.add.at(change, windows + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return {"n_bytes": len(data), "n_removed": int(gone.sum()), "n_spans": runs, "kept_sha256": hashlib.sha256(data[~gone].tobytes()).hexdigest()}


def at_home(batches: Iterator[pa.RecordBatch], text_column: int, add) -> Iterator[tuple[object, pa.RecordBatch]]:
    """Slices of text rows with what ``add`` gathered from the rows of kind 0 of the same bucket before them."""
    now, found = None, None
    for batch in batches:
        buckets, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.flatnonzero(np.concatenate([[True], (buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1]), [True]]))
        for a, b in zip(cuts, cuts[1:]):
            if buckets[a] != now:
                now, found = buckets[a], None
            rows = batch.slice(a, b - a)
            if kinds[a] == 0:
                found = add(found, rows)
            else:
                yield from ((found, part) for part in slices(rows, text_column))


def strings_alone(text: np.ndarray, owners: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Each string of some stretches of a slice: its stretch, start and hash, and whether a smaller owner here has the same one."""
    n = end - begin + 1
    if not len(n):  # also of a slice that is shorter than a string
        return n, n, n.view(U64), np.zeros(0, bool)
    of = np.repeat(np.arange(len(n)), n)
    at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    hashes = mix(spans(prefix(BYTE_VALUES[text]), at, at + length))
    order = np.lexsort((owners[of], hashes))
    strings = np.lib.stride_tricks.sliding_window_view(text, length)
    a, b = order[:-1], order[1:]
    new = np.ones(len(of), bool)
    new[1:] = hashes[a] != hashes[b]
    for k in range(0, len(a), SLICE_BYTES // length):  # hashes may agree by chance
        part = slice(k, k + SLICE_BYTES // length)
        new[1:][part] |= (strings[at[a[part]]] != strings[at[b[part]]]).any(1)
    again = np.zeros(len(of), bool)
    sorted_owners = owners[of[order]]
    again[order] = sorted_owners > sorted_owners[new][np.cumsum(new) - 1]
    return of, at, hashes, again


def send_batches(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, ids, counts, keys, flags, doc_id, text) to finished and open documents and stretches' bytes."""
    held, size = [], 0

    def add(found: Found | None, rows: pa.RecordBatch) -> Found:
        found = found or Found()
        for r in rows.select([2, 3, 4, 5]).to_pylist():
            found.add(unpack_ids(r["ids"], r["counts"]), np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["flags"], np.uint8))
        return found

    def deal() -> pa.RecordBatch:
        texts, *columns = zip(*held)
        held.clear()
        text = np.concatenate(texts)
        ends = np.cumsum([len(x) for x in texts])
        owners, to, starts, at, lengths = (np.concatenate(x) for x in columns)
        at = at + np.repeat(ends - [len(x) for x in texts], [len(x) for x in columns[0]])
        rows = []
        for k, i, x, a, n in by_bucket(bucket_of(to, buckets), owners, starts, at, lengths):
            ids_, counts = pack_ids(i)
            data = b"".join(text[p:q].tobytes() for p, q in zip(a, a + n))
            rows.append({"bucket": k, "kind": STRETCH, "ids": ids_, "counts": counts, "starts": x.tobytes(), "lengths": n.tobytes(), "bytes": data})
        return batch_of(_STEP, rows)

    for found, part in at_home(batches, 7, add):
        text, offsets = flat(part.column(7))
        number, known = ids(part.column(6))
        of, begin, end, minimizers, keys, _ = stretches(text, offsets, length)
        flags = found.look(number[of], keys) * known[of] if found and len(of) else np.zeros(len(of), np.uint8)
        repeat, send = flags & REPEAT > 0, (flags & SEND > 0) & (flags & REPEAT == 0)
        is_open = np.zeros(part.num_rows, bool)
        is_open[of[send]] = True
        hot = np.flatnonzero(send & (flags & HOT > 0))
        stretch, alone, hashes, again = strings_alone(text, number[of[hot]], begin[hot], end[hot], length)
        doc_of = np.concatenate([of[repeat], of[hot][stretch[again]]])
        order = np.argsort(doc_of, kind="stable")
        at = np.searchsorted(doc_of[order], np.arange(part.num_rows + 1))
        first, last = (np.concatenate([x[repeat], alone[again]])[order] for x in (begin, end))
        rows = []
        for r in range(part.num_rows):
            windows = [np.arange(x, y + 1) for x, y in zip(first[at[r] : at[r + 1]], last[at[r] : at[r + 1]])]
            windows = np.concatenate([np.zeros(0, np.int64), *windows]) - offsets[r]
            doc, value = part.column(6)[r].as_py(), part.column(7)[r].as_py()
            if is_open[r]:
                pairs = np.stack([first[at[r] : at[r + 1]], last[at[r] : at[r + 1]]], 1) - offsets[r]
                rows.append({"bucket": part.column(0)[r].as_py(), "kind": OPEN, "doc_id": doc, "text": value, "repeats": pairs.astype(np.int64).tobytes()})
            else:
                rows.append({"kind": DONE, "doc_id": doc} | cut(value, windows, length))
        send[hot] = False
        o, b = (np.concatenate([x[send], y[~again]]) for x, y in ((of, of[hot][stretch]), (begin, alone)))
        e, to = (np.concatenate([x[send], y[~again]]) for x, y in ((end, alone), (minimizers, hashes)))
        yield batch_of(_STEP, rows)
        if len(o):
            held.append((text, number[o], to, b - offsets[o], b, e - b + length))
            size += len(text)
            if size >= SEND_BYTES:
                yield deal()
                size = 0
    if held:
        yield deal()


class BlindTrie:
    """Orders strings of one length: inner nodes hold a depth and branch on the byte there; bytes between aren't looked at.

    A new string walks down blindly to some leaf, is compared with that leaf's string once, and branches off where
    the two differ.
    """

    def __init__(self, length: int):
        self.length, self.root = length, None

    def insert(self, string: bytes, name: int) -> None:
        if self.root is None:
            self.root = (string, [name])
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        if node[0] == string:
            node[1].append(name)
            return
        differ = int.from_bytes(node[0]) ^ int.from_bytes(string)
        depth = self.length - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][string[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][string[depth]] = (string, [name])
            return
        below = node
        while isinstance(below, list):
            below = next(iter(below[1].values()))
        branch = [depth, {below[0][depth]: node, string[depth]: (string, [name])}]
        if above is None:
            self.root = branch
        else:
            above[1][string[above[0]]] = branch

    def ordered(self) -> Iterator[list[int]]:
        """Names of equal strings together, in order of the strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield node[1]


def deep_shallow(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the ``length``-byte strings at ``starts``, and for each place in it the number of its group of equal ones.

    Every start has ``length`` bytes of data after it.
    """
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)  # of the place in the order, as far as the strings are compared
    open_ = np.arange(len(starts))
    for depth in range(0, min(shallow, length) - 7, 8):
        if not len(open_):
            break
        at = starts[order[open_]] + depth
        key = np.zeros(len(open_), U64)
        for k in range(8):
            key = (key << U64(8)) | data[at + k]
        inner = np.lexsort((key, group[open_]))  # groups stay where they are
        order[open_] = order[open_[inner]]
        key, g = key[inner], group[open_]
        new = np.ones(len(open_), bool)
        new[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        first = np.flatnonzero(new)
        group[open_] = open_[first][np.cumsum(new) - 1]
        sizes = np.diff(np.append(first, len(open_)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
    done = min(shallow, length) // 8 * 8
    raw = data.tobytes()
    cuts = np.flatnonzero(np.concatenate([[True], group[open_][1:] != group[open_][:-1], [True]])) if len(open_) else []
    for a, b in zip(cuts, cuts[1:]):
        places = open_[a:b]
        trie = BlindTrie(length - done)
        for name in order[places].tolist():
            s = int(starts[name])
            trie.insert(raw[s + done : s + length], name)
        k = 0
        for equal in trie.ordered():
            here = places[k : k + len(equal)]
            order[here], group[here] = equal, here[0]
            k += len(equal)
    return order, group


def sort_batches(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Stretches in order of bucket to (document, start) of the strings that an earlier document has."""
    now, held, said, size = -1, [], [], 0

    def flush() -> int:
        owners = np.concatenate([unpack_ids(r["ids"], r["counts"]) for r in held])
        first = np.concatenate([np.frombuffer(r["starts"], np.int64) for r in held])
        sizes = np.concatenate([np.frombuffer(r["lengths"], np.int64) for r in held])
        data = np.frombuffer(b"".join(r["bytes"] for r in held), np.uint8)
        held.clear()
        windows = sizes - length + 1
        of = np.repeat(np.arange(len(sizes)), windows)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        order, group = deep_shallow(data, (np.cumsum(sizes) - sizes)[of] + inside, length)
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        owner = owners[of[order]]
        least = np.minimum.reduceat(owner, at)[np.cumsum(np.isin(np.arange(len(group)), at, assume_unique=True)) - 1]
        hit = order[owner > least]
        said.append((owners[of[hit]], first[of[hit]] + inside[hit]))
        return len(hit)

    def deal() -> pa.RecordBatch:
        owners, starts = (np.concatenate(x) for x in zip(*said))
        said.clear()
        rows = []
        for h, i, s in by_bucket(home(owners, buckets), owners, starts):
            order = np.argsort(i, kind="stable")
            ids_, counts = pack_ids(i[order])
            rows.append({"bucket": h, "kind": 0, "ids": ids_, "counts": counts, "starts": s[order].tobytes()})
        return batch_of(_STEP, rows)

    for batch in batches:
        for row in rows_of(batch):
            if row["bucket"] != now and held:
                size += flush()
                if size >= REPLIES:
                    yield deal()
                    size = 0
            now = row["bucket"]
            held.append(row)
    if held:
        flush()
    if said:
        yield deal()


def cut_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Open documents with the starts reported for them, to finished ones."""
    names = _STEP.names

    def add(found: dict | None, rows: pa.RecordBatch) -> dict:
        found = found if found is not None else {}
        for r in rows.select([2, 3, 4]).to_pylist():
            owners, starts = unpack_ids(r["ids"], r["counts"]), np.frombuffer(r["starts"], np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1], [True]]))
            for a, b in zip(cuts, cuts[1:]):
                found.setdefault(int(owners[a]), []).append(starts[a:b])
        return found

    for found, part in at_home(batches, names.index("text"), add):
        rows = []
        for r in part.select(["doc_id", "text", "repeats"]).to_pylist():
            pairs = np.frombuffer(r["repeats"], np.int64).reshape(-1, 2)
            windows = [np.arange(a, b + 1) for a, b in pairs] + (found or {}).get(r["doc_id"], [])
            rows.append({"doc_id": r["doc_id"]} | cut(r["text"], np.unique(np.concatenate([np.zeros(0, np.int64), *windows])), length))
        yield batch_of(pa.schema([_STEP.field(c) for c in RESULT]), rows)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(partitions(docs.sparkSession), -(-every // TASK_BYTES))
    buckets = max(tasks, -(-every // BUCKET_BYTES))

    def at_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind")

    met = at_bucket(d.mapInArrow(partial(meet_batches, length=length, buckets=buckets), _MEET_SQL))
    said = written(met.mapInArrow(partial(reply_batches, buckets=buckets), _MEET_SQL).drop("minimizers", "checks"), "replies")
    texts = d.select(home_column(F.col("doc_id"), buckets).alias("bucket"), F.lit(1).alias("kind"), "doc_id", "text")
    at = at_bucket(said.unionByName(texts, allowMissingColumns=True).select("bucket", "kind", "ids", "counts", "keys", "flags", "doc_id", "text"))
    step = written(at.mapInArrow(partial(send_batches, length=length, buckets=buckets), _STEP_SQL), "stretches")
    suffixes = at_bucket(step.where(F.col("kind") == STRETCH)).mapInArrow(partial(sort_batches, length=length, buckets=buckets), _STEP_SQL)
    last = at_bucket(suffixes.unionByName(step.where(F.col("kind") == OPEN)))
    rest = last.mapInArrow(partial(cut_batches, length=length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return step.where(F.col("kind") == DONE).select(*RESULT).unionByName(rest)
