"""Alignment of two tokenizers against the libraries and loops over bytes."""

import hashlib
from collections import Counter

import public_tokenizers as P
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessera.llm import alignment, queries

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(texts):
    """By row: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    t, m, table = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH), alignment.byte_level()
    t.encode_special_tokens = True
    docs = []
    for text in texts:
        full = (" " + (text or "")).encode()
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids
        b = m.encode(text or "")
        bytes_a = [bytes(table[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != full or b"".join(bytes_b) != full:
            docs.append(([], [], [], ""))
            continue
        spans = []
        for ids, own in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for i, x in zip(ids, own):
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in side if start < e <= cut) for side in spans))
            start = cut
        links = [(i, j) for i, s, e in spans[0] for j, x, y in spans[1] if s < y and x < e]
        docs.append((a, b, links, ";".join(groups)))
    counts = Counter(p for d in docs for p in d[2])
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), g) for a, b, links, g in docs], counts, best


ODD = [None, "", " ", "  ", "a ", " a", "a  b", "ein Haus, das  dort\nsteht\n\nund", "▁", "a▁ b", "x\ty\r\n z", "<s> <0x0A> <|endoftext|> </s>", "日本語 text 🎉 é́", "　wide", "a\x00b", "no-space" * 30, "ﬁ ½ Å", "one two, three. four " * 50, "one two, three. four " * 50]


def test_odd_texts(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("side", T.StringType())])
    rows = [(None if i == 3 else i // 2, t, "x", "y") for i, t in enumerate(ODD)]
    docs, pairs = alignment.align(spark.createDataFrame(rows, schema), A_PATH, B_PATH, groups=True)
    want, counts, best = brute(ODD)
    got = sorted(((str(r.doc_id), *r[1:7], r.groups) for r in docs.collect()))
    assert got == sorted((str(i), *w) for (i, *_), w in zip(rows, want))
    assert {((r.a, r.b), r.n, r.best) for r in pairs.collect()} == {(p, n, n == best[p[1]]) for p, n in counts.items()}
    none, no_pairs = alignment.align(spark.createDataFrame([], schema), A_PATH, B_PATH)
    assert none.count() == 0 and no_pairs.count() == 0


def test_parts_and_cache(monkeypatch):
    """Batches of a few documents and words that are dropped from the cache give the same links."""
    own = alignment.Aligner(A_PATH, B_PATH)
    texts = [t or "" for t in ODD]
    whole = own.align(texts)[1]
    own.b.forget()
    assert [own.align([t])[1][0] for t in texts] == whole == [w[6] for w in brute(ODD)[0]]
    assert all(len(w) <= alignment.LONGEST_CACHED for w in own.b.number)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want, *_ = brute([r.text for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_alignment(spark, folder).collect()}
    assert got == {r.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(rows, want)}
