import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vexel.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_equal_library_for_every_character():
    e = pk.encoder(PATH)
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1 {c} {c}{c}B'{c}" for c in chars]
    for at in range(0, len(texts), 100_000):
        part = texts[at : at + 100_000]
        odd = [t for t, w in zip(part, LIBRARY.encode_batch(part, add_special_tokens=False), strict=True) if e.encode(t).tolist() != [*w.ids, 1]]
        assert not odd, (len(odd), [hex(ord(t[1])) for t in odd[:30]])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abein 'st<|>endoftext\n\t\x1c9木、!?… 　")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_of_random_texts(text):
    assert pk.encoder(PATH).encode(text).tolist() == ids_of(text)


def test_ids_of_odd_texts():
    for t in ["<|endoftext|>", "a<|endoftext|> b", "x" * 30_000, " " * 30_000 + "a", "\n" * 5000, "ab " * 5000, None, ""]:
        assert pk.encoder(PATH).encode(t).tolist() == ids_of(t)


def brute(places, penalties, size):
    cost = {0: 0}
    for p, c in zip(places, penalties, strict=True):
        cost[p] = c + min(cost[q] + size - (p - q) for q in cost if p - q <= size)
    return cost[places[-1]]


def test_cuts_cost_least():
    rnd = random.Random(3)
    for _ in range(300):
        places, p = [], 0
        for _ in range(rnd.randint(1, 40)):
            p += rnd.randint(1, 9)
            places.append(p)
        penalties = [rnd.choice([0, 4, 24]) for _ in places]
        ends = pk.best_cuts(places, penalties, 16)
        assert ends[-1] == places[-1] and all(0 < b - a <= 16 for a, b in zip([0, *ends], ends))
        got = sum(penalties[places.index(e)] for e in ends) + sum(16 - (b - a) for a, b in zip([0, *ends], ends))
        assert got == brute(places, penalties, 16)


def check(rows, data):
    """Every id in exactly one piece, sequences gapless and within size; returns the share of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    want = defaultdict(int)
    for d, t in data:
        want[d, zlib.crc32(np.array(ids_of(t), np.uint32).tobytes())] += 1
    texts = defaultdict(list)
    for d, t in data:
        texts[d].append(ids_of(t))
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert any(zlib.crc32(np.array(i[r.start : r.start + r.length], np.uint32).tobytes()) == r.ids_crc32 and len(i) == r.doc_tokens for i in texts[r.doc_id])
    for d, own in texts.items():
        assert sum(r.length for r in by_doc[d]) == sum(map(len, own))
        if len(own) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at
                at += r.length
            assert at == len(own[0])
    pad = total = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    return pad / max(1, pad + total)


def test_rows(spark):
    rnd = random.Random(1)
    data = [(i, " ".join("abcdef gh. I" * rnd.randint(0, 9) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    data += [(900, None), (901, ""), (None, "null key."), (902, "word " * 20_000), (903, "x" * 30_000), (5, "again. " * 9), (5, "again. " * 9)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in data], "doc_id long, text string, start int, offset string").repartition(3)
    out = pk.pack(df, PATH)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check(out.collect(), data) < 0.02
    assert pk.pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        pk.pack(df, PATH, size=1000)


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    share = check(pk.pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    print("padding", share)
    assert share < 0.02  # windows end between sentences of some 20 tokens


def test_blocks_carry_over():
    e = pk.encoder(PATH)
    p = pk.Packer(e, 0, 2048, block=5000)
    rows = [r for i in range(200) for r in p.add(i, "some words here. " * (i % 37))] + p.close()
    total = sum(len(e.encode("some words here. " * (i % 37))) for i in range(200))
    assert sum(r[2] for r in rows) == total and sorted({r[5] for r in rows}) == list(range(max(r[5] for r in rows) + 1))


def test_open_end_leaves_out_the_last_padding():
    rnd = random.Random(4)
    for _ in range(200):
        places = sorted(rnd.sample(range(1, 80), rnd.randint(20, 60)))
        places = [p for p in places]
        if any(b - a > 16 for a, b in zip([0, *places], places)):
            continue
        penalties = [rnd.choice([0, 4]) for _ in places]
        ends = pk.best_cuts(places, penalties, 16, open_end=True)
        price = lambda e: sum(penalties[places.index(x)] for x in e) + sum(16 - (b - a) for a, b in zip([0, *e[:-1]], e[:-1]))
        assert ends[-1] == places[-1] and ends[-1] - ([0, *ends])[-2] <= 16
        cost = {0: 0}
        for p, c in zip(places, penalties, strict=True):
            cost[p] = c + min(cost[q] + 16 - (p - q) for q in cost if p - q <= 16)
        last = places[-1]
        assert price(ends) == penalties[-1] + min(cost[q] for q in cost if q < last and last - q <= 16)


def test_windows_end_at_boundaries(spark):
    """Full windows end with a document or a sentence, unless there is no such place within a window's reach."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    e = pk.encoder(PATH)
    p = pk.Packer(e, 0)
    rows = [r for d, t in docs.items() for r in p.add(d, t)] + p.close()
    last = {}
    for r in rows:
        last[r[5]] = r
    full = [r for s, r in last.items() if sum(x[2] for x in rows if x[5] == s) & (sum(x[2] for x in rows if x[5] == s) - 1) or s + 12 < len(last)]
    inside = 0
    for d, start, length, _, total, *_ in full:
        ids = e.encode(docs[d])
        gap = np.diff(np.concatenate([[0], np.flatnonzero(e.ends_sentence[ids[:-1]]) + 1, [total]])).max()
        inside += start + length < total and not e.ends_sentence[ids[start + length - 1]] and gap <= pk.SIZE
    print(len(full), inside)
    assert len(full) > 100 and inside == 0
    words = "none " * 9000  # no sentence ends: cut inside, and only there
    p = pk.Packer(e, 0)
    rows = p.add(1, words) + p.close()
    assert sum(r[2] for r in rows) == len(e.encode(words)) and max(r[2] for r in rows) <= pk.SIZE
