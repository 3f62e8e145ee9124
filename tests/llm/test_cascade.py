"""The cascading release against a plain replay of events."""

import random
import zlib

import pytest
from pyspark.sql import types as T

from tessera.llm import cascade


def replayed(rows):
    """What a loop over the turns of each conversation gives: {(conv, turn): (status, attempts, first, last, number, state)}."""
    crc = lambda x: zlib.crc32(x.encode())
    texts = {}
    for conv, turn, text in rows:
        if conv is not None and turn is not None:
            texts.setdefault(conv, {}).setdefault(turn, []).append(crc(text or ""))
    out = {}
    for conv, turns in texts.items():
        order, done, result = sorted(turns), [], []
        for p, turn in enumerate(order):
            h = lambda k: crc(f"{k}:{conv}:{turn}")  # noqa: B023, E731
            back = h(0) % 7
            parent = done[p - back] if 0 < back <= p else 0
            if parent is None:
                done.append(None)
                result.append(("blocked", 0, None, None))
                continue
            time, repair, faulty = max(7 * p, parent), 7 * p + h(2) % 101, h(1) % 101 < 20
            first = time
            for a in range(1, 5):
                if not (faulty and (time < repair or h(a + 2) % 3 == 0)):
                    done.append(time)
                    result.append(("delivered", a, first, time))
                    break
                if a == 4:
                    done.append(None)
                    result.append(("dead", 4, first, time))
                time += 20 * 2 ** (a - 1)
        state, number = 0, 0
        for _, turn, i in sorted((r[3], turn, i) for i, (turn, r) in enumerate(zip(order, result)) if r[0] == "delivered"):
            number += 1
            state += number * min(turns[turn])
            out[conv, turn] = (*result[i], number, (state + 2**63) % 2**64 - 2**63)
        for turn, r in zip(order, result):
            out.setdefault((conv, turn), (*r, None, None))
    return out


def compared(spark, rows, extra=()):
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in extra]])
    got = cascade.replay(spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)).collect()
    want = replayed(rows)
    assert [c for c in cascade.replay(spark.createDataFrame([], schema)).columns] == ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]
    assert sorted((str(r.conv_id), str(r.turn), *map(str, r[2:])) for r in got) == sorted((str(c), str(t), *map(str, want.get((c, t), [None] * 6))) for c, t, _ in rows)


def test_many_short_and_long_conversations(spark):
    rng = random.Random(4)
    rows = [(c, t, f"text {c} {t}") for c in range(40) for t in range(rng.randrange(1, 30))]
    rows += [(1000, 3 * t - 500, "long" if t % 3 else None) for t in range(700)]
    rng.shuffle(rows)
    compared(spark, rows)


def test_blocks_and_their_summaries():
    c = cascade
    known = [c.delivery(c.GAP * p, w, g) for p, w, g in ((0, -1, 0), (1, 30, 5), (2, 90, 8), (3, 10, 0))]
    for f in known:
        for g in known:
            assert [c.at(c.then(f, g), t) for t in range(300)] == [c.at(g, c.at(f, t)) for t in range(300)]
    rng = random.Random(1)
    for n in (6, 8, 50):
        ps = list(range(16, 16 + n))
        backs, waits, goods = [rng.randrange(7) for _ in ps], [rng.choice((-1, -1, -1, 20, 70)) for _ in ps], [rng.randrange(16) for _ in ps]
        before = [rng.choice((c.DEAD, rng.randrange(60, 200))) for _ in range(6)]
        forest, done = c.Forest(ps, backs, waits, goods), {15 - k: t for k, t in enumerate(before)}
        for p, b, w, g, x in zip(ps, backs, waits, goods, forest.waits_for(before)):
            want = done[p - b] if b else 0
            assert x == want
            done[p] = c.at(c.delivery(c.GAP * p, w, g), want)
        assert c.moved(before, forest.exits()) == [done[ps[-1] - k] for k in range(6)]


def test_one_long_conversation_over_many_blocks(spark):
    compared(spark, [(5, t, f"{t % 11}") for t in range(256 * 70)])


def test_odd_rows(spark):
    rows = [(1, 0, "a"), (1, 0, "a"), (1, 0, "b"), (1, None, "c"), (None, 3, "d"), (None, None, None), (1, 1, ""), (1, 2, None), (2, -(2**40), "x"), (2, 2**40, "y" * 100_000), (1, 1, "")]
    compared(spark, rows, extra=["conv", "block", "before", "status", "p"])
    compared(spark, [])


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query(spark, sf):
    from tessera.llm import queries

    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "text").collect()]
    got = {(r.conv_id, r.turn): tuple(r)[2:] for r in queries.op11_cascade(spark, folder).collect()}
    assert got == replayed(rows) and len(got) == len(rows)
