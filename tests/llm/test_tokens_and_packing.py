"""Token files and packing: exact round trips against the tokenizer itself."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nitrapanel.llm import packing, tokens
from nitrapanel.llm.coder import TextCoder, tokenizer_path
from nitrapanel.session import scratch_path

PATH = tokenizer_path("word_bpe_49k.json")
FRESH = Tokenizer.from_file(PATH)
ODD = [
    None, "", " ", "\n\n", "7 8 a7b 77", "don't. it's!! I'LL", "ﬁ ² ½ x x² é é", "a\x1cb\x85c d", "<|endoftext|> a", "a<|endoftext|>B. <|startoftext|>", "<|endoftext |>", "x|<|endoftext|>|",
    "a.,b .a", "x*** y=*", "ΣΑΣ. Σ", "İI.", "Éé ßẞ ǅx", "_a_. 'S", "A̸. ≠ .", " ́a", "*́ a*́", "中文 字", "😀😀 ok!!",
]


@pytest.fixture(scope="module")
def coder():
    return TextCoder(PATH)


def plain(coder, text):
    """What a tokenizer of its own makes of the text, with the library's settings."""
    return FRESH.encode(text or "", add_special_tokens=False).ids


def test_coder_equals_the_tokenizer_on_odd_texts(coder):
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode_bytes(ODD)] == [plain(coder, t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_coder_equals_the_tokenizer(coder, text):
    assert np.frombuffer(coder.encode_bytes([text])[0], "<u4").tolist() == plain(coder, text)


def test_what_is_forgotten_is_encoded_anew(monkeypatch):
    from nitrapanel.llm import coder as module

    monkeypatch.setattr(module, "GENERATION", 5)
    monkeypatch.setattr(module, "PART_BYTES", 40)
    own = TextCoder(PATH)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"Word{'abcdefgh'[k]}{'.' * (k % 3)}" for k in rng.integers(0, 8, 30)) for _ in range(40)] + ODD
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_bytes(texts)] == [plain(own, t) for t in texts]
    assert len(own.young) < 40 and len(own.old) < 40


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 32), st.integers(0, 70), st.integers(0, 2**32))
def test_bit_packing_round_trip(width, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
    raw = tokens.pack_ids(ids, width)
    assert len(raw) == -(-n * width // 8)
    assert tokens.unpack_ids(raw, width, n).tolist() == ids.tolist()
    image = tokens.Image(tokens.write_image(ids, width, block=16))
    assert image.ids().tolist() == ids.tolist()
    assert image.ids(n // 3, n // 2).tolist() == ids[n // 3 : n // 2].tolist()


def test_width_is_the_least_that_holds_the_vocabulary():
    assert [tokens.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        tokens.pack_ids(np.array([8]), 3)


ROWS = [(5, "The of and"), (2, None), (None, "no id"), (9, ""), (2, "again two"), (7, "x " * 9000), (5, "The of and")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "s") for r in ROWS], "doc_id long, text string, start int, image string")


def test_token_files(spark, docs, coder):
    path = scratch_path(spark, "t")
    tokens.write_tokens(docs, path, PATH, end_id=2)
    got = sorted((tuple(r) for r in tokens.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 2, 2, 5, 5, 7, 9]
    want = {}
    for doc_id, text in ROWS:
        ids = np.array([*plain(coder, text), 2], "<u4")
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for doc_id, at, n, check in got:
        assert at == start and (n, check) in want[doc_id]
        start += n
    every = np.concatenate([r["ids"] for r in tokens.read_tokens(spark, path).orderBy("start").collect()])
    assert len(every) == start and tokens.read_range(spark, path, 3, 9000).tolist() == every[3:9000].tolist()


def test_empty_tables(spark, docs):
    path = scratch_path(spark, "t")
    none = docs.limit(0)
    tokens.write_tokens(none, path, PATH, end_id=2)
    assert tokens.read_digests(spark, path).count() == 0
    assert packing.pack(none, PATH, 1).count() == 0


def check_packing(rows, whole):
    """Every id in exactly one piece, sequences gapless, at most the longest tier, and a power of two."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, total in whole.items():
        at = 0
        for start, length in sorted(by_doc[doc_id]):
            assert start == at and length > 0
            at += length
        assert at == total
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(spark, docs, coder):
    some = docs.where("doc_id IN (7, 9)").unionByName(spark.createDataFrame([(100 + i, "a " * (i * 37 % 3000), 0, "") for i in range(200)], docs.schema))
    rows = packing.pack(some, PATH, 1).collect()
    sizes = {r["doc_id"]: len(plain(coder, r["text"])) + 1 for r in some.collect()}
    check_packing(rows, sizes)
    ids = {r["doc_id"]: np.array([*plain(coder, r["text"]), 1], "<u4") for r in some.collect()}
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in rows)
    assert all(r["doc_tokens"] == sizes[r["doc_id"]] for r in rows)
    steps = {}
    for r in rows:
        steps[r["step_group"]] = steps.get(r["step_group"], 0) + r["length"]
    assert max(steps.values()) == packing.STEP_TOKENS


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60), st.integers(64, 400))
def test_packer_places_everything_once(lengths, window):
    packer = packing.Packer((32, 16, 8), step_tokens=64, window_tokens=window)
    groups = []
    for i, n in enumerate(lengths):
        groups += packer.add(i, bytes(4 * n))
    groups += packer.finish()
    got = {}
    for group in groups:
        assert sum(p.length for w in group for p in w) <= 64
        for w in group:
            total = sum(p.length for p in w)
            assert total <= 32 and total & (total - 1) == 0
            for p in w:
                got.setdefault(p.doc, []).append((p.start, p.length))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(got[i]):
            assert start == at
            at += length
        assert at == n


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """The smallest documents with strings of special tokens and odd texts among them."""
    path = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = [(10_000 + i, t, None, None, None) for i, t in enumerate([*ODD, "x <|endoftext|> y " * 900])]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


def test_query_token_files(spark, odd_tables):
    from nitrapanel.llm.queries import op1_token_files

    docs = spark.read.parquet(f"{odd_tables}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, []
    for row in docs:
        ids = np.array([*plain(None, row["text"]), 2], "<u4")
        want.append((row["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = op1_token_files(spark, odd_tables).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_query_packing(spark, odd_tables):
    from nitrapanel.llm.queries import op4_packing

    docs = spark.read.parquet(f"{odd_tables}/documents.parquet").select("doc_id", "text").collect()
    ids = {r["doc_id"]: np.array([*plain(None, r["text"]), 1], "<u4") for r in docs}
    rows = op4_packing(spark, odd_tables).collect()
    check_packing(rows, {i: len(x) for i, x in ids.items()})
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
