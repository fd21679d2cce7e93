"""Token ids: encoder, planes, packing, against whole-text encoding and plain checks."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing, token_planes
from gleaner.llm.encoding import PieceEncoder
from gleaner.llm.queries import vocabulary
from gleaner.session import scratch_folder

DOCS = "doc_id long, text string, start string, length string"
ODD = ["", " ", "\n", "a", " a", "a ", "a\n", "\na", "a  b", "a \n b", "a\n\nb", ",a", "a,,b", "it's a.b, c's.", "é. x", "Σας. ΑΣ", "\x00a\x1c b", "x  y", "<|endoftext|> z"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_whole_texts(name, spaces):
    e, plain, rng = PieceEncoder(vocabulary(name), spaces), Tokenizer.from_file(vocabulary(name)), random.Random(3)
    letters = [*"ab é'\n.,1_ sS!\tΣ́", "<|endoftext|>", "<|startoftext|>"]
    texts = ODD + ["".join(rng.choices(letters, [4] * (len(letters) - 2) + [1, 1], k=rng.randint(1, 25))) for _ in range(4000)]
    for got in (e.encode(texts), e.encode(texts)):
        assert all(g.tolist() == plain.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    ids = np.random.default_rng(1).integers(0, 2**32, 1003, dtype=np.uint64).astype(np.uint32)
    for part in (ids, ids[:1], ids[:8] % 7):
        assert token_planes.from_planes(token_planes.to_planes(part, kind), len(part), kind).tolist() == part.tolist()


def test_crc_of_parts():
    data = bytes(range(256)) * 5
    for cut in (0, 1, 700, len(data)):
        assert token_planes.crc_before(zlib.crc32(data[:cut]), len(data) - cut) ^ zlib.crc32(data[cut:]) == zlib.crc32(data)


@pytest.mark.parametrize("block_ids, kind", [(7, "byte"), (64, "bit"), (65536, "byte")])
def test_ids_written_and_read_back(spark, block_ids, kind):
    texts = [None, *ODD, "word " * 300, "word " * 300, "other text"]
    path, e = scratch_folder(spark, "t"), PieceEncoder(vocabulary("byte_bpe_50k.json"), True)
    token_planes.write_ids(docs(spark, texts), path, vocabulary("byte_bpe_50k.json"), block_ids=block_ids, kind=kind)
    got = sorted(map(tuple, token_planes.document_sums(spark, path, block_ids).collect()))
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = np.append(e.whole(t or ""), 0).astype("<u4") if t else np.zeros(1, "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    chunks = token_planes.read_chunks(spark, path).orderBy("first").collect()
    assert [c["first"] for c in chunks] == np.cumsum([0] + [c.n_ids for c in chunks[:-1]]).tolist()
    some = token_planes.read_chunks(spark, path).where("first = 0")
    assert token_planes.read_ids(spark, path, some, block_ids).where("at = 0 and doc_id = 0").count() == 1


def test_ids_with_null_and_repeated_keys_and_empty_table(spark):
    path = scratch_folder(spark, "t")
    rows = spark.createDataFrame([(None, "a b"), (1, "b"), (1, "b"), (1, None), (None, None)], "doc_id long, text string")
    token_planes.write_ids(rows, path, vocabulary("byte_bpe_50k.json"))
    got = token_planes.document_sums(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 1), (None, 1, 3), (1, 4, 1), (1, 5, 2), (1, 7, 2)]
    path = scratch_folder(spark, "t")
    token_planes.write_ids(rows.limit(0), path, vocabulary("byte_bpe_50k.json"))
    assert token_planes.document_sums(spark, path).count() == 0


def check_packing(spark, texts, capacity, groups=8):
    e = PieceEncoder(vocabulary("word_bpe_49k.json"), False)
    cut = packing.stored(packing.pieces(docs(spark, texts), vocabulary("word_bpe_49k.json"), capacity=capacity, keep_ids=True), "p")
    placed = packing.pack(cut, capacity, groups)
    rows = placed.collect()
    for i, t in enumerate(texts):
        ids = np.append(e.whole(t) if t else [], 0).astype("<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // capacity)))
        assert all(r.start == r.piece * capacity and bytes(r.ids) == ids[r.start:r.start + capacity].tobytes() and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in mine)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(placed).collect()} == {k: 4 * sum(n for _, n in v) for k, v in by.items()}
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing_small_cases(spark):
    assert check_packing(spark, [None, "", "a", "a", "a b c d e f g h i j k"], 4)[0] == 5
    rng = random.Random(5)
    used, least = check_packing(spark, ["w " * min(60, int(rng.paretovariate(1) * 2)) for _ in range(500)] + ["q " * 9] * 50, 32)
    assert used <= least * 1.06 + 1
    assert packing.packed(docs(spark, ["a"]).limit(0), vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 2048])
    counts = {n: rng.choice([0, 1, 3, 50, 4000]) for n in rng.sample(range(1, capacity + 1), min(capacity, 60))}
    moves, filled, seen = packing.plan(counts, capacity, 12), {}, dict.fromkeys(counts, 0)
    for length, first, n, sequence, offset in sorted(moves.tolist(), key=lambda m: (m[4], m[0])):
        for s in range(sequence, sequence + n):
            assert filled.get(s, 0) == offset
            filled[s] = offset + length
    for length, first, n, *_ in moves.tolist():
        assert first == seen[length]
        seen[length] += n
    assert seen == counts and all(f <= capacity for f in filled.values())
    # about as good as first fit decreasing on the same pieces
    rooms = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)[:3000]:
        k = next((i for i, r in enumerate(rooms) if r >= length), None)
        if k is None:
            rooms.append(capacity - length)
        else:
            rooms[k] -= length
    if sum(counts.values()) <= 3000:
        assert len(filled) <= len(rooms) * 1.01 + 1
