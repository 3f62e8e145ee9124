"""Secret scans: the rules against plain loops, the network against its gradients and on unseen findings."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import types as T

from tessera.llm import queries, secret_scan as S

HEX = "0123456789abcdef"


def by_rules(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def a_text(r):
    word = lambda n, of: "".join(r.choice(of) for _ in range(n))
    parts = []
    for _ in range(r.randrange(60)):
        parts.append(r.choice([
            lambda: word(r.randrange(1, 9), "abcdefé"), lambda: word(r.randrange(20, 30), HEX), lambda: "AKIA" + word(r.randrange(10, 24), "ABC019"), lambda: r.choice(["PassWord", "token", "API_key", "apikey", "secret", "passwd"]) + r.choice(['="', ": ", " = '", "==", '":', " "]) + word(r.randrange(1, 12), "ab=/.Z"),
            lambda: word(18, "01=/-."), lambda: "token=token:" + word(8, "xyz"), lambda: "\n", lambda: "AKIAAKIA" + word(13, "AKI"),
        ])())
    return r.choice([" ", "", " ; "]).join(parts)


def test_rules():
    r = random.Random(3)
    for _ in range(3000):
        t = a_text(r)
        spans, _ = S.base_spans(t)
        assert spans == by_rules(t), t
        for s, e in S.candidates(t, spans):
            assert e - s >= S.SHORTEST and not any(x < e and s < y for x, y, _ in spans)


def test_gradients():
    net, r = S.Net.fresh(1), np.random.default_rng(2)
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    codes, goal = r.integers(1, 250, (5, S.WIDTH)).astype(np.uint8), np.array([1.0, 0, 1, 0, 1])
    loss = lambda: float(np.sum(np.logaddexp(0, x := net.forward(codes)) - goal * x))
    got = net.backward(S.sigmoid(net.forward(codes)) - goal)
    for name, w in net.w.items():
        for k in np.argsort(-np.abs(got[name]).reshape(-1))[:3]:
            keep, e = w.flat[k], 2e-3
            w.flat[k] = keep + e
            high = loss()
            w.flat[k] = keep - e
            low = loss()
            w.flat[k] = keep
            assert abs((high - low) / (2 * e) - got[name].flat[k]) < 0.05 * max(1.0, abs(got[name].flat[k])), name


def test_threshold_keeps_recall():
    p, labels = np.array([0.9, 0.8, 0.8, 0.6, 0.4, 0.2]), np.array([1, 1, 0, 1, 0, 0])
    assert np.isclose(S.threshold(p, labels, 1.0), 0.5) and np.isclose(S.threshold(p, labels, 0.3), 0.85)


def corpus(r, n):
    """Texts of words, some with a secret in a form that the rules know, some with one in a form that they don't."""
    word = lambda n, of="abcdeghilmnorstu": "".join(r.choice(of) for _ in range(n))
    mixed = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    out = []
    for i in range(n):
        words = [word(r.randrange(2, 10)) for _ in range(40)] + [word(r.randrange(17, 24)) for _ in range(3)] + ["".join(r.choice("0123456789") for _ in range(16)), "www." + word(9) + ".example.com/" + word(8)]
        r.shuffle(words)
        known = f'{r.choice(["token", "api_key", "password"])} = "{word(32, r.choice([HEX, mixed]))}"' if i % 2 else ""
        unknown = word(36, mixed) if i % 5 == 0 else ""
        at = r.randrange(len(words))
        out.append((" ".join([*words[:at], known, "bearer" if unknown else "", unknown, *words[at:]]), unknown))
    return out


def test_unseen_findings(spark):
    made = corpus(random.Random(8), 1500)
    schema = "doc_id long, text string"
    learn = spark.createDataFrame([(i, t) for i, (t, u) in enumerate(made[:1000]) if not u], schema)
    model = S.fit(learn)
    found = missed = wrong = 0
    for t, u in made[1000:]:
        [spans] = S.findings([t], model)
        extra = [t[s:e] for s, e, k in spans if k == S.FOUND]
        assert [s for s in spans if s[2] != S.FOUND] == by_rules(t)
        found += bool(u) and u in extra
        missed += bool(u) and u not in extra
        wrong += len([x for x in extra if x != u])
    assert found >= 0.9 * (found + missed) and wrong <= 10, (found, missed, wrong)


def test_all_windows_are_learned_from(spark, monkeypatch):
    """Every different window is in a part or held back, however many there are, and several parts learn as one does."""
    monkeypatch.setattr(S, "PART", 1500)
    monkeypatch.setattr(S, "LEAST_PART", 500)
    made = corpus(random.Random(5), 1500)
    docs = spark.createDataFrame([(i, t) for i, (t, u) in enumerate(made) if not u], "doc_id long, text string").repartition(3)
    want = {(p, w) for t, u in made if not u for spans, values in [S.base_spans(t)] for p, places in ((True, values), (False, S.candidates(t, spans))) for x in places for w in S.windows(t, *x)}
    got = S.labelled(docs, "text").dropDuplicates(["positive", "h"])
    assert {(r.positive, bytes(r.window)) for r in got.collect()} == want and len(want) > 4000  # more of a class than a sample of 2,000 had
    sizes = {c: sum(p == c for p, _ in want) for c in (True, False)}
    net = S.learned(got, sizes)
    found = S.seen(got, net, len(want))
    assert found[~found.positive].n.sum() == sizes[False] and found[found.positive].n.sum() >= 1.4 * sizes[True]
    right = found[(found.logit > 0) == found.positive].n.sum()
    assert right >= 0.9 * found.n.sum()


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("t", T.LongType()), T.StructField("N_HEX", T.LongType())])
    texts = [None, "", "x" * 300_000, 'api_key: "' + "a1B2" * 5_000 + '"', "🎉 é token=abcdef " + "0f" * 12, "same AKIA" + "Z" * 16, "same AKIA" + "Z" * 16]
    rows = spark.createDataFrame([(None if i == 2 else 1, t, "mine", 7, 8) for i, t in enumerate(texts)], schema)
    assert S.fit(rows) is None
    model = {"weights": S.Net.fresh(1).w, "slope": 1.0, "shift": 0.0, "threshold": 2.0}
    for m in (None, model):
        got = S.with_findings(rows, m).collect()
        assert sorted((r.text or "", r.spans, r.base_sha256, r.t) for r in got) == sorted((t or "", *[x := S.joined(by_rules(t or ""))], hashlib.sha256(x.encode()).hexdigest(), 7) for t in texts)
    empty = spark.createDataFrame([], schema)
    assert S.fit(empty) is None and S.with_findings(empty, model).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_secrets(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        want = by_rules(rows[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for *_, k in want) for x in S.KINDS)
        assert r.base_sha256 == hashlib.sha256(S.joined(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith(S.FOUND)] == [f"{k}:{s}:{e}" for s, e, k in want]
