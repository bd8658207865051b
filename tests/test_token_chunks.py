"""Windows of tokens against the tokenizer itself."""

import random

import pytest

from tessera.operators import token_chunks as K

WORDS = ["the", "été", "x1", "Straße", "日本", "😀", "don't", "\n", "  ", "supercalifragilistic"]


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 5, 60, 300]))) for _ in range(n)]


def plain(text, size, overlap):
    """Byte bounds and ids of each window."""
    e = K._encoding(K.default_ranks())
    ids, out, at = e.encode_ordinary(text), [], 0
    while ids:
        own = ids[at : at + size]
        before = len(e.decode_bytes(ids[:at]))
        out.append((own, before, before + len(e.decode_bytes(own))))
        at += size - overlap
        if at + overlap >= len(ids):
            break
    return out


@pytest.mark.parametrize(("size", "overlap"), [(20, 0), (20, 7), (500, 3)])
def test_windows(spark, size, overlap):
    own = dict(enumerate(texts(1, 40))) | {90: None, 91: ""}
    got = {}
    for r in K.document_chunks(spark.createDataFrame([(f"f{k}", t) for k, t in own.items()], "file string, text string"), size, overlap).collect():
        got.setdefault(int(r.file[1:]), []).append(r)
    assert set(got) == {k for k, t in own.items() if t}
    e = K._encoding(K.default_ranks())
    for k, rows in got.items():
        rows.sort(key=lambda r: r.position)
        want = plain(own[k], size, overlap)
        assert [(r.position, r.start, r.end, r.tokens) for r in rows] == [(i, a, b, len(ids)) for i, (ids, a, b) in enumerate(want, 1)]
        raw = own[k].encode()
        assert all(r.text == raw[r.start : r.end].decode(errors="replace") for r in rows)
        # The windows' ids, without what each shares with the one before, are those of the text.
        assert [i for n, (ids, *_) in enumerate(want) for i in ids[overlap if n else 0 :]] == e.encode_ordinary(own[k])


def test_pages_and_cap(spark):
    pages = [("a", p, t) for p, t in enumerate(texts(2, 12))] + [("b", 1, "one page"), ("b", 2, None), ("b", 3, "third page")]
    df = spark.createDataFrame(pages, "file string, page_number int, text string")
    got = sorted((r.file, r.position, r.page_number, r.text) for r in K.page_chunks(df, 30, 5).collect())
    want, n = [], {}
    for f, p, t in pages:
        for ids, a, b in plain(t or "", 30, 5):
            n[f] = n.get(f, 0) + 1
            want.append((f, n[f], p, t.encode()[a:b].decode(errors="replace")))
    assert got == sorted(want)
    assert sorted((r.file, r.position, r.page_number, r.text) for r in K.page_chunks(df, 30, 5, cap=4).collect()) == sorted(x for x in want if x[1] <= 4)


def test_transcripts(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    rng = random.Random(3)
    pieces = [(v, 10.0 * k, 10.0 * k + 9, " ".join(rng.choices(WORDS[:4], k=rng.randint(1, 9)))) for v in "ab" for k in range(40)]
    got = {(r.video, r.position): (r.start_time, r.end_time) for r in K.transcript_chunks(spark.createDataFrame(pieces, "video string, start double, end double, text string"), 25, 5).collect()}
    want = {}
    for v in "ab":
        own = [p for p in pieces if p[0] == v]
        at, bounds = 0, []
        for p in own:
            bounds.append((at, at + len(p[3].encode()) + 1, p[1], p[2]))
            at = bounds[-1][1]
        for k, (_, a, b) in enumerate(plain(" ".join(p[3] for p in own), 25, 5), 1):
            want[v, k] = (next(s for x, y, s, _ in bounds if x <= a < y), next(e for x, y, _, e in bounds if x <= b - 1 < y))
    assert got == want


def test_overlap_must_be_shorter(spark):
    with pytest.raises(ValueError):
        K.windows(spark.createDataFrame([("a",)], "text string"), 5, 5)
