import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlog.llm.packing import END_ID, SEQUENCE, TextTokenizer, hilbert, op1_packing, pack
from lumenlog.llm.token_counts import op3_token_counts, pretokens, processor, token_counts

from .fixtures import awkward, clashing, empty

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MARK = "<|endoftext|>"
TEXTS = st.lists(st.one_of(st.sampled_from([MARK, MARK[:-1], " ", "\n"]), st.text(st.one_of(st.sampled_from(" ▁\n\t'aeé1,."), st.characters(exclude_categories=["Cs"])), max_size=30)), max_size=5).map("".join)


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)  # with its defaults, as the contract says
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, derandomize=True)
@given(TEXTS)
def test_pretokens_keep_the_count(text):
    sp = processor(PIECE)
    assert sum(len(sp.encode(w)) for w in pretokens(text)) == len(sp.encode(text))


@settings(max_examples=300, deadline=None, derandomize=True)
@given(TEXTS)
def test_ids_are_the_librarys(text):
    got = b"".join(TextTokenizer.load(BPE).ids(text))
    assert np.frombuffer(got, "<u4").tolist() == library()(text)


def test_token_counts_against_the_library(spark, small):
    sp = processor(PIECE)
    got = Counter(map(tuple, op3_token_counts(spark, small).collect()))
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert got == want


def test_token_counts_of_awkward_rows(spark):
    sp = processor(PIECE)
    df, rows = awkward(spark)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 100) for r in rows)
    for hot in (8, 1 << 17):
        assert Counter(map(tuple, token_counts(clashing(df), PIECE, limit=100, hot_pretokens=hot).collect())) == want
    assert token_counts(empty(spark), PIECE).collect() == []


def check_pieces(pieces, rows, length=SEQUENCE):
    encode = library()
    want = Counter((r[0], tuple([*encode(r[1] or ""), END_ID])) for r in rows)
    ends = {(d, ids): [zlib.crc32(np.array(ids[:i], "<u4").tobytes()) for i in range(len(ids) + 1)] for d, ids in want}
    sequences = defaultdict(list)
    total = Counter()
    for p in pieces:
        sequences[p.sequence_id].append(p)
        total[p.doc_id] += p.length
        found = [ids for d, ids in want if d == p.doc_id and len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
        assert found and ends
    tokens = Counter()
    for (d, ids), n in want.items():
        tokens[d] += n * len(ids)
    assert total == tokens
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_packing_round_trip(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    pieces = op1_packing(spark, small).collect()
    assert check_pieces(pieces, rows) == 0
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.length, p.doc_tokens))
    for own in by_doc.values():
        at = 0
        for start, n, _ in sorted(own):
            assert start == at
            at += n
        assert at == own[0][2]


def test_packing_of_awkward_rows(spark):
    df, rows = awkward(spark)
    pieces = pack(clashing(df), BPE).collect()
    assert check_pieces(pieces, rows) == 0
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    assert pack(empty(spark), BPE).collect() == []


def test_hilbert_is_a_curve():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = hilbert(grid, 3)
    assert sorted(keys) == list(range(side**3))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_copies_are_neighbours(spark):
    rows = [(i, ("alpha beta gamma delta " if i % 2 else "zwölf grüne bücher lesen ") * 20) for i in range(40)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string"), BPE, with_ids=False).collect()
    order = [p.doc_id % 2 for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) <= 2


def test_added_tokens_are_the_librarys(spark, tmp_path):
    from tokenizers import Tokenizer

    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, mark * 3, f"{mark} x", f"x{mark}", f"one two{mark} \n three  {mark}four", f"<|endoftext{mark}|>", "none here", f"é{mark}🙂 " * 50, ""]
    t = Tokenizer.from_file(BPE)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(b"".join(TextTokenizer.load(BPE).ids(x)), "<u4").tolist() for x in texts] == want
    assert want[0] == [64, 220, 50256, 275]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    total = {p.doc_id: p.doc_tokens for p in op1_packing(spark, str(tmp_path)).collect()}
    assert total == {i: len(x) + 1 for i, x in enumerate(want)}


def test_texts_beyond_a_block(spark):
    """Texts of over 2 MB are encoded block by block."""
    words = ["alpha", "beta's", "(gamma)", "12345", "é🙂", "delta,"]
    texts = [" ".join(words[(i * i + i // 7) % 6] for i in range(n)) for n in (400_000, 450_001)]
    texts.append(texts[0][:1_500_000] + MARK + texts[1])
    encode = library()
    assert max(map(len, texts)) > 1 << 21
    for text in texts:
        assert np.frombuffer(b"".join(TextTokenizer.load(BPE).ids(text)), "<u4").tolist() == encode(text)
    want = np.array([*encode(texts[0]), END_ID], "<u4")
    pieces = pack(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), BPE, with_ids=False).collect()
    assert sum(p.length for p in pieces) == len(want) and all(p.doc_tokens == len(want) for p in pieces)
    assert all(zlib.crc32(want[p.start : p.start + p.length]) == p.ids_crc32 for p in pieces)


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    spec = json.load(open(BPE, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        path = f"{tmp_path}/t.json"
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec | change, f)
        with pytest.raises(ValueError):
            TextTokenizer(path)
