import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import expected, got
from webgauge.llm import conversations
from webgauge.llm.conversations import BLANKS

SCHEMA = "conv_id long, turn long, role string, text string, audit string, head boolean"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if lot == 1 else "".join(c for c in text if c not in ".!?") if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def brute(original, rows):
    """Cheapest edits by a table of all (row, pattern state) from the end."""
    out = []
    for conv in {r[0] for r in original}:
        own = [r[1:] for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, kinds, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}
        for _turn, role, text in own:
            core = text.strip(BLANKS)
            kind = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "none"
            seen.add((role, text))
            faults[kind] += 1
            kinds.append(kind)
        turns = {t for t, *_ in own if t is not None}
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        arcs = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
        free = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}

        @lru_cache(maxsize=None)
        def best(i, q, inserts):
            ways = []
            if i == len(own):
                if q in (0, 3):
                    ways.append((0, "", ()))
            else:
                more = kinds[i] == "truncated"
                c, a, r = best(i + 1, q, 0)
                ways.append((c + 3, "D" + a, r))
                if kinds[i] not in ("blank", "duplicate"):
                    if own[i][1][:1] in arcs[q]:
                        c, a, r = best(i + 1, arcs[q][own[i][1][:1]], 0)
                        ways.append((c + more, "K" + a, (f"{own[i][1]}:{own[i][2]}", *r)))
                    c, a, r = best(i + 1, free[q][1], 0)
                    ways.append((c + 2 + more, "R" + a, (f"{'user' if free[q][0] == 'u' else 'assistant'}:{own[i][2]}", *r)))
            if inserts < 3:
                c, a, r = best(i, free[q][1], inserts + 1)
                ways.append((c + 2, "I" + a, ("user:" if free[q][0] == "u" else "assistant:", *r)))
            return min(ways) if ways else (10**6, "", ())

        cost, audit, repaired = best(0, 0, 0)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    texts = ["Fine.", "Good? ", "cut", "cut off,", "", " \n\t", None, "Yes!\n", "a\nb.", "Fine.", "漢字。", "end.\x0b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "utter", "SYSTEM"]
    out = [(c, t, r.choice(roles if c % 3 else roles[:5]), r.choice(texts if c % 2 else texts[:4])) for c in range(250) for t in range(r.randint(1, 9))]
    out += [(None, t, roles[t % 2], f"Text {t}.") for t in range(7)] + [(400, None, "user", "Null turn."), (400, None, "assistant", "Null too."), (400, 5, "user", "Later.")]
    out += [(401, 2, "user", "Same."), (401, 2, "user", "Same."), (401, 2, "assistant", "Other."), (402, -4, "system", "Minus."), (402, 9, "user", None)]
    out += [(500, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"{t} words" + "." * (t % 5 > 0)) for t in range(900)]  # a long one
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*x, "audit", True) for x in rows], SCHEMA).repartition(3)


def test_report_of_damaged_rows(table, rows):
    damaged, dropped = conversations.damaged(table)
    assert got(conversations.report(damaged, dropped)) == expected(brute(rows, damage(rows)))


def test_report_and_rows_as_given(table, rows):
    plain = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    told = brute(plain, plain)
    assert got(conversations.report(table)) == expected(told)
    out = conversations.repaired(table).collect()
    for conv, *_, digest in told:
        own = sorted((x for x in out if x.conv_id == conv), key=lambda x: x.place)
        assert [x.place for x in own] == list(range(1, len(own) + 1))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == digest


def test_few_states(table):
    a = conversations.Determinised()
    r = random.Random(2)
    for _ in range(300):
        a.repair(bytearray(r.randrange(9) for _ in range(r.randint(0, 200))))
    assert len(a.vectors) < 100 and len(a.arcs) < 900


def test_all_rows_dropped_and_empty(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(x) for x in conversations.report(rows, F.lit(True)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    none = rows.limit(0)
    assert conversations.report(none).count() == 0 and conversations.repaired(none).count() == 0
