"""What a task of operator 1 holds doesn't grow with the input: buckets follow the bytes of text, and much to tell goes in parts."""

import functools
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.test_operators import corpus, expected, got
from webgauge.llm import suffix_dedup as sd
from webgauge.llm.packing import unpack_ids


@pytest.mark.parametrize("bucket_bytes,task_bytes", [(1 << 10, 1 << 12), (1 << 22, 1 << 25)])
def test_buckets_follow_the_text(spark, monkeypatch, bucket_bytes, task_bytes):
    rows = corpus(5)
    size = sum(len((t or "").encode()) for _, t in rows)
    asked = []
    monkeypatch.setattr(sd, "BUCKET_BYTES", bucket_bytes, raising=False)
    monkeypatch.setattr(sd, "TASK_BYTES", task_bytes, raising=False)
    monkeypatch.setattr(sd, "partial", lambda f, **kw: asked.append(kw.get("buckets")) or functools.partial(f, **kw))
    assert got(sd.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == expected(brute.op1(rows))
    assert {x for x in asked if x} == {max(4, -(-size // bucket_bytes))}


def test_parts(monkeypatch):
    """Stretches, bytes and replies dealt out in many parts say the same as in one."""
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passages = [noise(120) for _ in range(5)]
    texts = [noise(60) + r.choice(passages) + noise(60) + r.choice(passages) for _ in range(200)]

    def in_order(batches, schema, *more):
        rows = sorted([x for b in batches for x in b.to_pylist()] + list(more), key=lambda x: (x["bucket"], x["kind"]))
        return pa.RecordBatch.from_pylist(rows, schema)

    def run():
        docs = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(k, k + 50), pa.int64()), "text": texts[k : k + 50]}) for k in range(0, 200, 50)]
        met = [list(sd.meet_batches(iter(d.slice(i, 10) for i in range(0, 50, 10)), 50, 16)) for d in docs]
        said = list(sd.reply_batches(iter([in_order((x for b in met for x in b), sd._MEET)]), 16))
        homes = sd.home(np.arange(200), 16).tolist()
        schema = pa.schema([*(sd._MEET.field(c) for c in ("bucket", "kind", "ids", "counts", "keys", "flags")), ("doc_id", pa.int64()), ("text", pa.string())])
        at = in_order(said, schema, *({"bucket": h, "kind": 1, "doc_id": i, "text": t} for i, (h, t) in enumerate(zip(homes, texts))))
        step = list(sd.send_batches(iter([at]), 50, 16))
        rows = [x for b in step for x in b.to_pylist()]
        found = list(sd.sort_batches(iter([in_order([], sd._STEP, *(x for x in rows if x["kind"] == sd.STRETCH))]), 50, 16))
        gone = {(x["doc_id"], int(w)) for x in rows if x["kind"] == sd.OPEN for a, b in np.frombuffer(x["repeats"], np.int64).reshape(-1, 2) for w in range(a, b + 1)}
        for x in (x for b in found for x in b.to_pylist()):
            gone |= set(zip(unpack_ids(x["ids"], x["counts"]).tolist(), np.frombuffer(x["starts"], np.int64).tolist()))
        return gone, [len(x) for x in (*met, said, found)], sum(x["kind"] == sd.STRETCH for x in rows)

    whole, parts, sent = run()
    assert max(parts) <= 2 and sent <= 16  # what passes through, and what all buckets of a task tell together
    for name, most in (("STRETCHES", 100), ("SEND_BYTES", 100), ("REPLIES", 10)):
        monkeypatch.setattr(sd, name, most)
    again, many, more = run()
    assert again == whole and min(many) > 2 and more > sent
    assert whole >= {(199, w) for w in range(60, 131)}
