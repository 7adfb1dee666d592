"""Scoring by a hierarchical Pitman-Yor bigram model.

Each context, that is each previous word, has a Chinese restaurant whose dishes are the next words. All restaurants share
one parent, whose customers are their tables; below it lies a uniform base over the vocabulary and one unseen word. The
parent's discount is 0, so its probabilities depend on its customers alone and need no seating of their own.

  1. tokens are counted as (context, word) cells, within tasks and then in buckets of the context, so that a restaurant
     lies in one bucket; a token of a text that is held out makes a cell without customers, which is only asked for;
  2. Gibbs sweeps, each from the seating before, take the customers of a cell out and seat them again given all the rest
     (restaurants.seat), half a restaurant's dishes at a time. Between sweeps every bucket sends its tables by word, and gets
     back the parent's customers of its own words. The first sweeps are burned in; the tables of the others stay in the cells;
  3. predictive probabilities are averaged over those; every document's tokens, training or not, stream past their bucket's
     cells and sums are returned.

A context with over one in SHARE of all tokens is dealt out by cell, and its totals are added up between sweeps; these
contexts, fewer than SHARE whatever the input, and three totals are all that reaches the driver. Buckets hold
about BUCKET_TOKENS tokens, however large the input is. Questions are asked in ROUNDS, so that only a part of them
lies on disk at a time. Draws are hashes, so a task that runs again draws the same.

Defined results: null and empty texts are one end token. A null doc_id trains. Repeated rows count as often as they
occur and are each scored. Without training tokens every token has the unseen word's probability. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgauge.llm.packing import BUFFER, batch_of, by_bucket, home, planes, unplanes
from webgauge.llm.restaurants import DISCOUNT, ROOT, STRENGTH, seat
from webgauge.llm.shared import emptied, partitions, scratch_dir, written
from webgauge.llm.textarrays import U64, Words, flat, mix, mix_int, slices

BURN_IN, SWEEPS = 1, 3
SHARE, BUCKET_TOKENS, LEAST_TOKENS, ROUNDS, MOST_PARTITIONS = 4096, 1 << 20, 1 << 17, 2, 20_000
_END, _BEGIN = U64(mix_int(0xE0D)), U64(mix_int(0xB05))
_PACKED = pa.schema(
    [
        *((c, pa.int32()) for c in ("bucket", "kind", "origin")),
        *((c, pa.binary()) for c in ("contexts", "sizes", "words", "index", "counts")),
        *((c, pa.list_(pa.binary())) for c in ("tables", "customers")),
        *((c, pa.binary()) for c in ("ids", "keys", "docs", "known")),
        ("totals", pa.list_(pa.int64())),
    ]
)
_PACKED_SQL = (
    "bucket int, kind int, origin int, contexts binary, sizes binary, words binary, index binary, counts binary, "
    "tables array<binary>, customers array<binary>, ids binary, keys binary, docs binary, known binary, totals array<long>"
)
#: Kinds of packed rows. A bucket's parents come before its cells, and those before the questions.
PARENTS, CELLS, ASKED, DOCUMENTS, SUMS, WORDS, RESTAURANTS, TOTALS = range(8)


def tokens(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: each token's text number, word and context, ends included, in order."""
    w = Words(*flat(part.column(column)), lower=True)
    n = len(w.counts)
    word = np.insert(w.hashes, w.first[1:], _END)
    of = np.repeat(np.arange(n), w.counts + 1)
    context = np.empty(len(word), U64)
    context[1:] = word[:-1]
    context[np.cumsum(w.counts + 1) - (w.counts + 1)] = _BEGIN
    return of, word, context


def pairs(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context) + word)


def within(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are in known (sorted), and where."""
    if not len(known):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x, at


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers of 0 or more in as few bytes each as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def widened(data: bytes) -> np.ndarray:
    planes_ = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes_.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes_.T
    return out.view(np.int64).ravel()


def deal(context: np.ndarray, pair: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(np.where(within(context, hot)[0], pair, context) + U64(1)) % U64(buckets)).astype(np.int64)


def word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(words) % U64(buckets)).astype(np.int64)


def starts(x: np.ndarray) -> np.ndarray:
    """Places at which a new value begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def merged(context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells with their counts."""
    pair = pairs(context, word)
    order = np.argsort(pair)
    at = starts(pair[order])
    first = order[at]
    return context[first], word[first], (np.add.reduceat(counts[order], at) if len(at) else counts)


def pack_cells(context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> dict:
    """Cells in order of context: contexts once each, words as numbers in a sorted dictionary."""
    order = np.argsort(context)
    context = context[order]
    at = starts(context)
    words, index = np.unique(word[order], return_inverse=True)
    sizes = np.diff(np.append(at, len(context)))
    return {"contexts": planes(context[at]), "sizes": narrow(sizes), "words": planes(words), "index": narrow(index), "counts": narrow(counts[order])}


class Cells:
    """A packed row of cells, opened. of: number of each cell's context; index: number of its word.

    Tables are stored of cells of several customers only; one customer has one.
    """

    def __init__(self, row: dict):
        self.row = row
        self.contexts, self.words = (unplanes(row[c], np.uint64) for c in ("contexts", "words"))
        self.of = np.repeat(np.arange(len(self.contexts)), widened(row["sizes"]))
        self.index, self.counts = widened(row["index"]), widened(row["counts"])

    def pairs(self, at=slice(None)) -> np.ndarray:
        return pairs(self.contexts[self.of[at]], self.words[self.index[at]])

    def tables(self, data: bytes) -> np.ndarray:
        out = self.counts.copy()
        out[self.counts > 1] = widened(data)
        return out

    def pack_tables(self, tables: np.ndarray) -> bytes:
        return narrow(tables[self.counts > 1])

    def totals(self, values: np.ndarray, shared: np.ndarray, of_shared: np.ndarray) -> np.ndarray:
        """Sums over each context; those of shared (sorted) contexts are known from all buckets."""
        out = np.bincount(self.of, values, len(self.contexts))
        hit, at = within(self.contexts, shared)
        out[hit] = of_shared[at[hit]]
        return out


class Model:
    """What buckets must know of the others: training tokens, vocabulary, and for each sweep the parent's customers
    and the shared contexts' tables. Sweep -1 is the start."""

    def __init__(self, hot: np.ndarray):
        self.hot = hot
        self.tokens = self.words = 0
        self.hot_counts = np.zeros(len(hot))
        self.customers: dict[int, int] = {}
        self.hot_tables: dict[int, np.ndarray] = {}

    def parent(self, customers: np.ndarray, sweep: int) -> np.ndarray:
        return (customers + ROOT) / (self.customers[sweep] + ROOT * (self.words + 1))


def frequent_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text to (context, n): the contexts with a share of a buffer's tokens, and all its tokens (null)."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        context = np.concatenate(held)
        held.clear()
        often = np.bincount((context >> U64(48)).astype(np.int64), minlength=1 << 16) * SHARE > len(context)  # of the first 16 bits
        names, n = np.unique(context[often[(context >> U64(48)).astype(np.int64)]], return_counts=True)
        use = n * SHARE > len(context)
        return pa.RecordBatch.from_arrays([pa.array([*names[use].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[use].tolist(), len(context)], pa.int64())], names=["context", "n"])

    for batch in batches:
        for part in slices(batch, 0):
            w = Words(*flat(part.column(0)), lower=True)
            held.append(np.concatenate([w.hashes, np.full(len(w.counts), _BEGIN)]))  # in any order, every word is a context, as is every beginning
            size += len(held[-1])
            if size >= BUFFER:
                yield flush()
                size = 0
    if size:
        yield flush()


def count_batches(batches: Iterator[pa.RecordBatch], hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """text, held_out to packed cells; tokens of texts held out don't count."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        context, word, counts = merged(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        bucket = deal(context, pairs(context, word), hot, buckets)
        return batch_of(_PACKED, [{"bucket": b, "kind": CELLS} | pack_cells(*cells) for b, *cells in by_bucket(bucket, context, word, counts)])

    for batch in batches:
        for part in slices(batch, 0):
            of, word, context = tokens(part, 0)
            held.append((context, word, (~part.column(1).to_numpy(zero_copy_only=False)[of]).astype(np.int64)))
            size += len(word)
            if size >= BUFFER // 2:
                yield flush()
                size = 0
    if size:
        yield flush()


def told(cells: Cells, tables: np.ndarray, model: Model, buckets: int, count: bool) -> Iterator[dict]:
    """What a bucket tells of its tables (and at first of its tokens): by word, and of each shared context."""
    of_word = np.bincount(cells.index, tables, len(cells.words)).astype(np.int64)
    uses = [np.bincount(cells.index, cells.counts, len(cells.words)).astype(np.int64)] if count else []
    for b, w, t, *n in by_bucket(word_bucket(cells.words, buckets), cells.words, of_word, *uses):
        yield {"bucket": b, "kind": WORDS, "origin": cells.row["bucket"], "words": planes(w), "tables": [narrow(t)], "counts": narrow(n[0]) if count else None}
    shared = np.flatnonzero(within(cells.contexts, model.hot)[0])
    if len(shared):
        sums = [np.bincount(cells.of, x, len(cells.contexts))[shared].astype(np.int64) for x in (tables, cells.counts)]
        yield {"bucket": 0, "kind": RESTAURANTS, "contexts": planes(cells.contexts[shared]), "tables": [narrow(sums[0])], "counts": narrow(sums[1])}


def merge_batches(batches: Iterator[pa.RecordBatch], model: Model, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed cells in order of bucket to one row a bucket, seated at one table each, and what it tells."""
    now, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        row = {"bucket": now, "kind": CELLS} | pack_cells(*merged(*(np.concatenate(x) for x in zip(*held))))
        held.clear()
        cells = Cells(row)
        tables = np.minimum(cells.counts, 1)
        yield batch_of(_PACKED, [row | {"tables": [cells.pack_tables(tables)], "customers": []}])
        yield batch_of(_PACKED, list(told(cells, tables, model, buckets, True)))

    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1).to_pylist()[0]
            if row["bucket"] != now and held:
                yield from flush()
            now = row["bucket"]
            c = Cells(row)
            held.append((c.contexts[c.of], c.words[c.index], c.counts))
            if len(held) > 1 and sum(len(h[0]) for h in held) > BUFFER:
                held[:] = [merged(*(np.concatenate(x) for x in zip(*held)))]
    if held:
        yield from flush()


def parent_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What buckets tell, in order of the word's bucket, to the sums that each of them needs, and totals.

    Counts of training tokens are in the first round's rows only.
    """
    now, held = None, []

    def flush() -> pa.RecordBatch:
        words, index = np.unique(np.concatenate([w for _, w, *_ in held]), return_inverse=True)
        tables = np.bincount(index, np.concatenate([t for *_, t, _ in held]), len(words)).astype(np.int64)
        first = held[0][3] is not None
        counts = np.bincount(index, np.concatenate([n for *_, n in held]), len(words)).astype(np.int64) if first else None
        rows, at = [], 0
        for origin, w, *_ in held:
            mine = index[at : at + len(w)]
            at += len(w)
            rows.append({"bucket": origin, "kind": PARENTS, "origin": now, "tables": [narrow(tables[mine])], "counts": narrow(counts[mine]) if first else None})
        totals = [int(tables.sum()), *((int(counts.sum()), int((counts > 0).sum())) if first else (0, 0))]
        held.clear()
        return batch_of(_PACKED, [*rows, {"bucket": -1, "kind": TOTALS, "totals": totals}])

    for batch in batches:
        for row in batch.select(["bucket", "origin", "words", "tables", "counts"]).to_pylist():
            if row["bucket"] != now and held:
                yield flush()
            now = row["bucket"]
            held.append((row["origin"], unplanes(row["words"], np.uint64), widened(row["tables"][0]), widened(row["counts"]) if row["counts"] else None))
    if held:
        yield flush()


def gathered(rows: list[dict], words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The parent's customers, and at first the training tokens, of a bucket's words, from one reply for each bucket of words."""
    rows = sorted(rows, key=lambda r: r["origin"])
    order = np.argsort(word_bucket(words, buckets), kind="stable")
    out = []
    for values in ([r["tables"][0] for r in rows], [r["counts"] for r in rows]):
        if values and values[0] is not None:
            out.append(np.empty(len(words), np.int64))
            out[-1][order] = np.concatenate([widened(v) for v in values])
        else:
            out.append(None)
    return tuple(out)


def sweep_batches(batches: Iterator[pa.RecordBatch], model, sweep: int, burn_in: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Parents and cells in order of bucket and kind to the cells seated anew, and what they tell."""
    m: Model = model.value
    parents: list[dict] = []
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1).to_pylist()[0]
            if row["kind"] == PARENTS:
                parents.append(row)
                continue
            cells = Cells(row)
            customers, uses = gathered(parents, cells.words, buckets)
            parents = []
            if uses is not None:  # kept with the cells from now on
                row["known"] = narrow(uses)
            t = cells.tables(row["tables"][-1])
            kept, of_kept = row["tables"][:-1], row["customers"]
            if sweep > burn_in:
                kept, of_kept = row["tables"], [*of_kept, narrow(customers)]
            in_all, several = m.customers[sweep - 1], np.flatnonzero(cells.counts > 1)
            pair = cells.pairs(several)  # a single customer is never seated anew
            half = (pair >> U64(7)) & U64(1)
            full = cells.totals(t, m.hot, m.hot_tables[sweep - 1])
            for turn in (0, 1):
                now = half == turn
                at = several[now]
                of, mine = cells.of[at], t[at]
                t[at] = seat(cells.counts[at], full[of] - mine, customers[cells.index[at]] - mine, in_all - mine, m.words, pair[now], sweep)
                full += np.bincount(of, t[at] - mine, len(full))
            row = row | {"tables": [*kept, cells.pack_tables(t)], "customers": of_kept}
            yield batch_of(_PACKED, [row])
            yield batch_of(_PACKED, list(told(cells, t, m, buckets, False)))


def ask_batches(batches: Iterator[pa.RecordBatch], hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """row, doc_id, held_out, text to packed questions, and the rows themselves to their homes."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        owners, word, context = (np.concatenate(x) for x in zip(*held))
        held.clear()
        keys = pairs(context, word)
        rows = []
        for b, i, k in by_bucket(deal(context, keys, hot, buckets), owners, keys):
            at = starts(i)
            sizes = np.diff(np.append(at, len(i))).astype(np.int32)
            rows.append({"bucket": b, "kind": ASKED, "ids": planes(np.diff(i[at], prepend=np.int64(0))), "counts": planes(sizes), "keys": k.tobytes()})
        return batch_of(_PACKED, rows)

    for batch in batches:
        for part in slices(batch, 3):
            of, word, context = tokens(part, 3)
            number, out, doc = (part.column(i) for i in (0, 2, 1))
            number = number.to_numpy(zero_copy_only=False)
            held.append((number[of], word, context))
            size += len(word)
            flags = doc.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8) + 2 * out.to_numpy(zero_copy_only=False).astype(np.uint8)
            yield batch_of(
                _PACKED,
                [
                    {"bucket": h, "kind": DOCUMENTS, "ids": planes(np.diff(i, prepend=np.int64(0))), "docs": planes(d), "known": f.tobytes()}
                    for h, i, d, f in by_bucket(home(number, buckets), number, doc.fill_null(0).to_numpy(zero_copy_only=False), flags)
                ],
            )
            if size >= BUFFER // 4:
                yield flush()
                size = 0
    if size:
        yield flush()


class Index:
    """The cells of a bucket, ready to be asked: log10 of each one's averaged probability, and its word's training tokens."""

    def __init__(self, row: dict, parents: list[dict], model: Model, buckets: int):
        cells = Cells(row)
        customers, uses = gathered(parents, cells.words, buckets)
        uses = widened(row["known"]) if uses is None else uses
        every = [*map(widened, row["customers"]), customers]
        room = STRENGTH + cells.totals(cells.counts, model.hot, model.hot_counts)
        total = np.zeros(len(cells.counts))
        last = max(model.customers)
        for sweep, tables, at_parent in zip(range(last - len(every) + 1, last + 1), row["tables"], every):
            t = cells.tables(tables)
            new = STRENGTH + DISCOUNT * cells.totals(t, model.hot, model.hot_tables[sweep])
            total += (cells.counts - DISCOUNT * t + new[cells.of] * model.parent(at_parent, sweep)[cells.index]) / room[cells.of]
        keys = cells.pairs()
        order = np.argsort(keys)
        self.keys = keys[order]
        self.scores = np.log10(total / len(every))[order]
        self.uses = uses[cells.index[order]]
        # keys are hashes, so their first bits say nearly where they lie
        self.shift = U64(64 - min(max(1, len(order).bit_length()), 26))
        self.begin = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=U64) << self.shift)

    def ask(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of keys that are all there."""
        at = self.begin[keys >> self.shift]
        late = np.flatnonzero(self.keys[at] != keys)
        while len(late):
            at[late] += 1
            late = late[self.keys[at[late]] != keys[late]]
        return self.scores[at], self.uses[at]


def answer_batches(batches: Iterator[pa.RecordBatch], model, buckets: int) -> Iterator[pa.RecordBatch]:
    """Parents, cells and questions in order of bucket and kind to sums for the documents.

    Sums are of log10 of model and of count + 1, and known tokens. Questions are answered while they are read.
    """
    now, size, held, parents, index = None, 0, [], [], None

    def flush() -> pa.RecordBatch:
        columns = []
        for r in held:
            score, uses = index.ask(np.frombuffer(r["keys"], np.uint64))
            sizes = unplanes(r["counts"], np.int32)
            at = np.cumsum(sizes) - sizes
            columns.append((np.cumsum(unplanes(r["ids"], np.int64)), *(np.add.reduceat(x, at) for x in (score, np.log10(uses + 1.0), (uses > 0).astype(np.int32))), sizes))
        held.clear()
        rows = []
        owners, *columns = (np.concatenate(x) for x in zip(*columns))
        for h, i, s, b, k, c in by_bucket(home(owners, buckets), owners, *columns):
            order = np.argsort(i, kind="stable")
            rows.append(
                {
                    "bucket": h,
                    "kind": SUMS,
                    "ids": planes(np.diff(i[order], prepend=np.int64(0))),
                    "keys": s[order].tobytes(),
                    "docs": b[order].tobytes(),
                    "known": planes(k[order].astype(np.int32)),
                    "counts": planes(c[order]),
                }
            )
        return batch_of(_PACKED, rows)

    for batch in batches:
        through = []
        for r in range(batch.num_rows):
            row = batch.slice(r, 1).to_pylist()[0]
            if held and (row["bucket"] != now or size >= BUFFER // 8):
                yield flush()
                size = 0
            if row["bucket"] != now:
                now, parents, index = row["bucket"], [], None
            if row["kind"] == DOCUMENTS:
                through.append(row)
            elif row["kind"] == PARENTS:
                parents.append(row)
            elif row["kind"] == CELLS:
                index, parents = Index(row, parents, model.value, buckets), []
            else:
                held.append(row)
                size += len(row["keys"]) // 8
        if through:
            yield batch_of(_PACKED, through)
    if held:
        yield flush()


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_log", pa.float64()), ("score", pa.float64())])


def finish_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and their sums in order of home to one row a document."""
    now, docs, sums = None, [], []

    def flush() -> pa.RecordBatch:
        number, doc, flags = (np.concatenate(x) for x in zip(*docs))
        order = np.argsort(number)
        number, doc, flags = number[order], doc[order], flags[order]
        owners, *values = (np.concatenate(x) for x in zip(*sums))
        at = np.searchsorted(number, owners)
        known, base, score, n = (np.bincount(at, v, len(number)) for v in values)
        docs.clear()
        sums.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc, pa.int64(), mask=flags & 1 == 0),
                pa.array(flags & 2 > 0),
                pa.array(np.rint(n).astype(np.int64)),
                pa.array(np.rint(known).astype(np.int64)),
                pa.array(base),
                pa.array(score),
            ],
            schema=_RESULT,
        )

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now and docs:
                yield flush()
            now = row["bucket"]
            numbers = np.cumsum(unplanes(row["ids"], np.int64))
            if row["kind"] == DOCUMENTS:
                docs.append((numbers, unplanes(row["docs"], np.int64), np.frombuffer(row["known"], np.uint8)))
            else:
                sums.append((numbers, unplanes(row["known"], np.int32), np.frombuffer(row["docs"], np.float64), np.frombuffer(row["keys"], np.float64), unplanes(row["counts"], np.int32)))
    if docs:
        yield flush()


def restaurant_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.select(["contexts", "tables", "counts"]).to_pylist():
            columns = unplanes(r["contexts"], np.int64), widened(r["tables"][0]), widened(r["counts"])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["context", "tables", "n"])


def score(docs: DataFrame, held_out, burn_in: int = BURN_IN, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``held_out``: a boolean column.

    ``burn_in`` sweeps are thrown away, the next ``sweeps`` (1 at least) averaged.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    often = d.select("text").mapInArrow(frequent_batches, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    often = written(often, "frequent")
    every = often.where("context is null").agg(F.sum("n")).first()[0] or 0
    shared = often.where((F.col("context").isNotNull()) & (F.col("n") * SHARE > every)).select("context").collect()  # fewer than SHARE
    model = Model(np.sort(np.array([r["context"] for r in shared], np.int64).view(np.uint64)))
    # as many as there are partitions only while that leaves a bucket enough to do: what buckets tell each other grows with their square
    buckets = max(1, -(-every // BUCKET_TOKENS), min(partitions(spark), every // LEAST_TOKENS))

    def at_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(max(partitions(spark), min(buckets, MOST_PARTITIONS)), "bucket").sortWithinPartitions("bucket", "kind")

    places = {name: [scratch_dir(spark, name) for _ in range(2)] for name in ("cells", "parents")}

    def learn(step: DataFrame, sweep: int) -> DataFrame:
        """The parent's rows for the next sweep, written; the model takes in the totals of this one."""
        told = at_bucket(step.where(F.col("kind") == WORDS).select("bucket", "kind", "origin", "words", "tables", "counts"))
        parents = written(told.mapInArrow(parent_batches, _PACKED_SQL), "parents", places["parents"][sweep % 2])
        customers, n, v = (x or 0 for x in parents.where(F.col("kind") == TOTALS).agg(*(F.sum(F.col("totals")[i]) for i in range(3))).first())
        model.customers[sweep] = customers
        model.hot_tables[sweep] = np.zeros(len(model.hot))
        if sweep < 0:
            model.tokens, model.words = n, v
        if len(model.hot):
            sums = step.where(F.col("kind") == RESTAURANTS).mapInArrow(restaurant_batches, "context long, tables long, n long").groupBy("context").sum("tables", "n").collect()
            at = np.searchsorted(model.hot, np.array([r[0] for r in sums], np.int64).view(np.uint64))
            model.hot_tables[sweep][at] = [r[1] for r in sums]
            model.hot_counts[at] = [r[2] for r in sums]
        return parents.where(F.col("kind") == PARENTS)

    counted = d.select("text", "held_out").mapInArrow(partial(count_batches, hot=model.hot, buckets=buckets), _PACKED_SQL)
    step = written(at_bucket(counted).mapInArrow(partial(merge_batches, model=model, buckets=buckets), _PACKED_SQL), "cells", places["cells"][1])
    parents = learn(step, -1)
    for sweep in range(burn_in + sweeps):
        now = spark.sparkContext.broadcast(model)  # some numbers for each shared context
        met = at_bucket(step.where(F.col("kind") == CELLS).unionByName(parents))
        step = written(met.mapInArrow(partial(sweep_batches, model=now, sweep=sweep, burn_in=burn_in, buckets=buckets), _PACKED_SQL), "cells", places["cells"][sweep % 2])
        parents = learn(step, sweep)
    now = spark.sparkContext.broadcast(model)
    emptied(spark, *(p[(burn_in + sweeps) % 2] for p in places.values()))
    out = []
    for k in range(ROUNDS):
        # by content, so that a document is in one round only even if its input is worked out anew in another order
        in_round = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == k
        rows = d.where(in_round).select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
        asked = rows.mapInArrow(partial(ask_batches, hot=model.hot, buckets=buckets), _PACKED_SQL)
        met = at_bucket(asked.unionByName(step.where(F.col("kind") == CELLS)).unionByName(parents))
        answers = at_bucket(met.mapInArrow(partial(answer_batches, model=now, buckets=buckets), _PACKED_SQL))
        out.append(written(answers.mapInArrow(finish_batches, "doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, score double"), "scores"))
    emptied(spark, *(path for p in places.values() for path in p))
    floor = float(np.log10(model.tokens + model.words + 1))
    return reduce(DataFrame.unionByName, out).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_log") - F.col("n_tokens") * floor).alias("base_score"), "score"
    )
