import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import SCHEMA, odd_rows
from tokenizers import Tokenizer

from ferrylake.llm import chunk_reuse, packing, queries, range_coder
from ferrylake.llm.common import tokenizer_path
from ferrylake.llm.tokenize import BYTE_BPE, encoder


def ids_of(name, texts):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)], t


@pytest.fixture(params=["documents", "odd"])
def docs(request, spark, small):
    return spark.read.parquet(f"{small}/documents.parquet") if request.param == "documents" else spark.createDataFrame(odd_rows(), SCHEMA)


def test_chunk_reuse_is_exact(docs):
    rows = docs.select("doc_id", "text").collect()
    ids, t = ids_of("byte_bpe_50k.json", [r.text for r in rows])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = [(r.doc_id, len(x), sha(np.array(x, "<u4").tobytes()), sha(t.decode(x, skip_special_tokens=False).encode())) for r, x in zip(rows, ids, strict=True)]
    got = [tuple(r) for r in chunk_reuse.digests(chunk_reuse.encode(docs)).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_token_files_round_trip(docs):
    rows = docs.select("doc_id", "text").collect()
    ids, _ = ids_of("byte_bpe_50k.json", [r.text for r in rows])
    got = range_coder.written_and_read(docs).collect()
    pack = lambda x: np.array([*x, 2], "<u4").tobytes()
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids)) for r in got), key=repr) == sorted(((r.doc_id, len(x) + 1, pack(x)) for r, x in zip(rows, ids, strict=True)), key=repr)
    ordered, at = sorted(got, key=lambda r: r.start), 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    keys = [(-(1 << 63) if r.doc_id is None else r.doc_id) for r in ordered]
    assert keys == sorted(keys)


def test_blocks_reset_and_find_damage():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 50257, 5000), np.tile(rng.integers(0, 300, 40), 200), [0, 65535, 65536, 1048575]]).astype(np.uint32)
    blocks = range_coder.encode_blocks(ids)
    assert (range_coder.decode_blocks(blocks) == ids).all()
    assert (range_coder.decode_blocks(blocks[1:2]) == ids[range_coder.BLOCK : 2 * range_coder.BLOCK]).all()
    broken = bytearray(blocks[0])
    broken[40] ^= 1
    with pytest.raises(range_coder.DamagedBlock):
        range_coder.decode_blocks([bytes(broken)])
    assert len(range_coder.decode_blocks(range_coder.encode_blocks(ids[:0]))) == 0
    assert sum(map(len, range_coder.encode_blocks(np.tile(ids[5000:5040], 500)))) < 20000 * 2 / 4


def packed_rightly(got, rows, capacity=packing.CAPACITY):
    ids, _ = ids_of("word_bpe_49k.json", [t for _, t in rows])
    wanted = []
    for (d, _), x in zip(rows, ids, strict=True):
        x = [*x, 0]
        wanted += [(d, i // capacity, i, len(x[i : i + capacity]), zlib.crc32(np.array(x[i : i + capacity], "<u4").tobytes())) for i in range(0, len(x), capacity)]
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(wanted, key=repr)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in p) <= 2
    total = sum(w[3] for w in wanted)
    return len(places), total


def test_packing(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    n, total = packed_rightly(packing.packed(docs).collect(), rows)
    lengths = sorted((r.length for r in packing.packed(docs).collect()), reverse=True)
    bins = []
    for x in lengths:  # best fit decreasing, one by one
        fit = [i for i, b in enumerate(bins) if b >= x]
        if fit:
            bins[min(fit, key=bins.__getitem__)] -= x
        else:
            bins.append(2048 - x)
    assert n <= max(len(bins) + 1, 1.02 * len(bins)) and n >= -(-total // 2048)


def test_small_capacity_cuts_pieces(spark):
    rows = [(i, "word " * (i % 40)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed_rightly(packing.packed(docs, 16).collect(), rows, 16)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chunk_reuse.digests(chunk_reuse.encode(none)).count() == 0
    assert packing.packed(none).count() == 0
    assert range_coder.written_and_read(none).count() == 0


def test_query_columns(spark, small):
    assert queries.op10_token_files(spark, small).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert queries.op7_best_fit_packing(spark, small).columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_blocks_mix_three_orders_and_stay_small():
    rng = np.random.default_rng(6)
    skewed = np.minimum(rng.zipf(1.3, 40_000), 50_000).astype(np.uint32)  # order 0 alone helps
    size = lambda x: sum(map(len, range_coder.encode_blocks(x)))
    counts = np.bincount(skewed)
    p = counts[counts > 0] / len(skewed)
    assert size(skewed) < 1.15 * -(p * np.log2(p)).sum() / 8 * len(skewed)
    follows = np.arange(40_000, dtype=np.uint32) % 997  # order 1 tells the next id
    assert size(follows) < 0.2 * len(follows)
    pairs = np.resize(np.concatenate([[a, b, (a * b) % 89] for a in range(20) for b in range(20)]).astype(np.uint32), 40_000)
    assert size(pairs) < 0.6 * len(pairs)
    for x in (skewed, follows, pairs, np.arange(20_000, dtype=np.uint32), np.zeros(9000, np.uint32)):
        assert (range_coder.decode_blocks(range_coder.encode_blocks(x)) == x).all()
    mixed = range_coder.encode_blocks(skewed[:300]) + range_coder.encode_blocks(follows[:9000]) + range_coder.encode_blocks(pairs[:7])
    assert (range_coder.decode_blocks(mixed) == np.concatenate([skewed[:300], follows[:9000], pairs[:7]])).all()


def test_any_damaged_bit_is_found_at_once_or_by_checksum():
    blocks = range_coder.encode_blocks(np.random.default_rng(7).integers(0, 5000, 600).astype(np.uint32))
    for bit in [*range(8 * range_coder.HEADER.size), 8 * range_coder.HEADER.size + 5, 8 * len(blocks[0]) - 200]:
        broken = bytearray(blocks[0])
        broken[bit // 8] ^= 1 << bit % 8
        with pytest.raises(range_coder.DamagedBlock):
            range_coder.decode_blocks([bytes(broken)])
    with pytest.raises(range_coder.DamagedBlock):
        range_coder.decode_blocks([blocks[0][:-2]])


def test_every_damaged_byte_of_a_block_is_found():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 50257, 150), np.tile(rng.integers(0, 300, 10), 15)]).astype(np.uint32)
    block = range_coder.encode_blocks(ids)[0]
    with np.errstate(all="raise"):
        assert (range_coder.decode_blocks([block]) == ids).all()
    for at in range(len(block)):
        for flip in (0x80, 0xFF):
            broken = bytearray(block)
            broken[at] ^= flip
            try:
                assert (range_coder.decode_blocks([bytes(broken)]) == ids).all()  # only where no id depends on the byte
                assert at >= len(block) - 8
            except range_coder.DamagedBlock:
                pass


def test_damaged_segment_fields_are_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id long, text string")
    range_coder.write(docs, f"file://{tmp_path}/good")
    good = spark.read.schema(range_coder.FILES).parquet(f"file://{tmp_path}/good")
    for column, new in (("n_ids", "n_ids + 1"), ("doc_ids", "concat(substring(doc_ids, 1, 8), substring(doc_ids, 1, 8), substring(doc_ids, 17))"), ("sizes", "concat(X'0900000000000000', substring(sizes, 9))"), ("segment", "segment + 1")):
        path = f"file://{tmp_path}/{column}"
        good.selectExpr(*(f"cast({new} as {t}) as {c}" if c == column else c for c, t in good.dtypes)).write.parquet(path)
        with pytest.raises(Exception, match="DamagedBlock"):
            range_coder.read(spark, path).collect()


def test_the_id_of_a_weight_is_found_without_a_search():
    for bits in (8, 13, 16, 20):
        prior, (by, guesses) = range_coder._prior(bits), range_coder._guesses(bits)
        assert len(guesses) == 1 << range_coder.MIX_BITS - by and np.diff(prior).min() >= 1 << by
        at = np.concatenate([prior[:-1], prior[1:] - 1, np.random.default_rng(bits).integers(0, 1 << range_coder.MIX_BITS, 10_000)])
        guess = guesses[at >> by]
        assert (guess + (at >= prior[guess + 1]) == np.searchsorted(prior, at, "right") - 1).all()


def test_damage_anywhere_in_the_coded_bytes_is_found_before_decoding(monkeypatch):
    block = range_coder.encode_blocks(np.random.default_rng(5).integers(0, 5000, 300).astype(np.uint32))[0]
    monkeypatch.setattr(range_coder, "_decoded", lambda *_: pytest.fail("decoded"))
    for at in range(len(block)):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(range_coder.DamagedBlock):
            range_coder.decode_blocks([bytes(broken)])


def test_plain_words_are_encoded_as_the_library_does_and_often_used_ones_stay():
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    words = [a + b for a in letters for b in ("", "a", "Zé")]
    texts = [f"x {' '.join(words[i : i + 40])}\n{w}. {w}" for i, w in enumerate(words)]
    wanted, _ = ids_of("byte_bpe_50k.json", texts)
    some = encoder(BYTE_BPE, 100)
    for part in (texts, texts[:3], texts[:3]):
        ids, offsets = some.encode(pa.array(part), 1 << 12)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == wanted[: len(part)]
    table = range_coder.encoder(BYTE_BPE, 101).after_space
    for i in range(8):
        table.find(pa.array(["often", *(f"once{k}" for k in range(20 * i, 20 * i + 20))]))
    assert "often" in table.keys.to_pylist() and len(table.keys) < 161
