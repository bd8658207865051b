"""Packing by retrieval: every id once, no padding, neighbours as plain BM25 gives them."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, retrieval_packing as P

DATA = "/root/testdata/sf0.01"


def plain_ids(texts):
    t = Tokenizer.from_file(packing.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, P.END] for x in texts]


def checked(got, docs, window=P.WINDOW):
    """Pieces cover each row's ids once, sequences have no gap, and are full or a power of two long."""
    wanted, pieces, sequences = Counter(), defaultdict(list), defaultdict(list)
    for (doc_id, _), ids in zip(docs, plain_ids([text for _, text in docs])):
        wanted[doc_id, len(ids)] += len(ids)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    assert {k: sum(r.length for r in v) for k, v in pieces.items()} == dict(wanted)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0
    return sequences


def ids_match(got, docs):
    ids = dict(zip([d for d, _ in docs], plain_ids([t for _, t in docs])))
    seen = defaultdict(list)
    for r in got:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert len(own) == 4 * r.length and zlib.crc32(own) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
    for doc_id, own in seen.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(ids[doc_id])
    assert len(seen) == len(ids)


def test_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = P.pack(docs).collect()
    sequences = checked(got, rows)
    ids_match(got, rows)
    assert len(sequences) < sum(r.length for r in got) / P.WINDOW + 8 * 13


def test_document_frequencies(spark):
    rows = [(k, t) for k, t in enumerate(["a b a", "", None, "b c", "Ça b"])]
    tokens = P.tokenize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = Counter(i for ids in plain_ids([t for _, t in rows]) for i in set(ids))
    got = P.document_frequencies(tokens, 49408)
    assert {int(k): int(got[k]) for k in np.nonzero(got)[0]} == dict(want)


def test_neighbours_are_those_of_plain_bm25():
    """Within a shard: the window's seed, then unused documents by falling score of its query."""
    rng = random.Random(4)
    docs = [[rng.randrange(60) for _ in range(rng.randint(1, 40))] for _ in range(50)]
    n, total, df = len(docs), sum(map(len, docs)), Counter(t for d in docs for t in set(d))
    corpus = P.Statistics.of(np.array([df[t] for t in range(60)]), n, total)

    def weight(d, t):
        tf = d.count(t)
        return math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(d) / (total / n)))

    units = [P.Unit(k, 0, np.array(d, "<u4").tobytes(), len(d), *corpus.weighed(np.array(d))) for k, d in enumerate(docs)]
    packer = P.Packer(64, 0)
    packer.shard(units)
    got = [r[0] for r in packer.rows] + [u.doc_id for u, *_ in packer.open]
    unused, order, filled, seed = set(range(n)), [], 0, None
    while unused:
        if seed is None:
            k = min(unused)
        else:
            query = sorted(set(docs[seed]), key=lambda t: (-round(weight(docs[seed], t), 9), t))[: P.QUERY]
            k = queue.pop(0) if queue else None
        if seed is not None and k is None:
            break
        unused.discard(k)
        filled += len(docs[k])
        order.append(k)
        before, filled = filled - len(docs[k]), filled
        if seed is None or filled >= 64:
            seed = k if filled % 64 or filled < 64 else None
            filled %= 64
            if seed is not None:
                query = sorted(set(docs[seed]), key=lambda t: (-round(weight(docs[seed], t), 9), t))[: P.QUERY]
                score = {u: round(sum(weight(docs[u], t) for t in query if t in docs[u]), 9) for u in unused}
                queue = sorted(unused, key=lambda u: (-score[u], u))
            else:
                queue = []
    deduplicated = [k for i, k in enumerate(got) if i == 0 or got[i - 1] != k]
    assert deduplicated == order and len(order) == n


def test_related_documents_share_windows(spark):
    """Copies with a few words changed, dealt over the table, come together again."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(3, 9))) for _ in range(4000)]
    bases = [rng.choices(vocabulary, k=150) for _ in range(40)]
    rows = []
    for k in range(400):
        own = list(bases[k % 40])
        for _ in range(6):
            own[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((k, " ".join(own)))
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    of = defaultdict(set)
    for r in got:
        of[r.sequence_id].add(r.doc_id)
    pairs = [(a, b) for own in of.values() for a in own for b in own if a < b]
    assert sum(a % 40 == b % 40 for a, b in pairs) / len(pairs) > 0.4  # 1 of 40 by chance


def test_cuts_at_powers_of_two():
    packer = P.Packer(64, 5)
    units = [P.Unit(k, 0, np.arange(n, dtype="<u4").tobytes(), n, np.arange(n), np.ones(n)) for k, n in enumerate([13, 1, 30])]
    for u in units:
        packer.place(u)
    packer.finish()
    sizes = Counter()
    for _, _, n, _, _, sequence, offset in packer.rows:
        assert offset == sizes[sequence]
        sizes[sequence] += n
    assert list(sizes.values()) == [32, 8, 4] and [(r[0], r[1]) for r in packer.rows] == [(0, 0), (1, 0), (2, 0), (2, 18), (2, 26)]


@pytest.mark.parametrize("shard", [1, 7])
def test_edges(spark, shard):
    """Nulls, repeats of a third of all rows, very long texts, small shards and windows, other columns."""
    long = " ".join(f"w{k % 977} x{k % 31}" for k in range(9000))
    docs = [(1, "a b c")] * 60 + [(None, "n o"), (None, None), (2, None), (3, ""), (4, long), (4, "other"), (5, long + " end")]
    df = spark.createDataFrame([(d, t, 1, b"x", 2) for d, t in docs], "doc_id long, text string, row int, ids binary, tokens int").repartition(4)
    got = P.pack(df, window=64, shard=shard).collect()
    checked(got, docs, window=64)
    assert P.pack(df.limit(0)).count() == 0
