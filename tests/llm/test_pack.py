import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from contactscope.llm.pack import pack, pieces, plan_large, plan_small
from contactscope.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def cut(model, text, capacity):
    ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
    first = len(ids) % capacity or capacity
    ends = list(range(first, len(ids) + 1, capacity))
    out, at = [], 0
    for k, end in enumerate(ends):
        out.append((k, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())))
        at = end
    return out


def check(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in rows) // capacity)


def test_query_packs_every_token_tightly(spark, folder, model):
    rows = QUERIES["op7_best_fit_packing"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d["doc_id"], *p) for d in docs for p in cut(model, d["text"], 1024))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    used, least = check(rows, 1024)
    assert used <= least * 1.01 + 2


def test_odd_rows(spark, model):
    texts = [None, "", " ", "a", "x  y\n", "<|endoftext|> z", "é " * 30, "word " * 3000, "same", "same", "  lead"]
    docs = spark.createDataFrame([(k // 2 if k < 8 else None, t, "c", 1) for k, t in enumerate(texts)], "doc_id long, text string, length string, _rank int")
    rows = pack(pieces(docs, 16), 16, groups=4, small=3).collect()
    want = sorted((p for t in texts for p in cut(model, t, 16)))
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    check(rows, 16)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(pieces(docs)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_each_rank_once(seed):
    rng = random.Random(seed)
    counts = {k: rng.choice([0, 1, 5, 1000]) for k in rng.sample(range(65, 1024), 200)}
    counts = {k: n for k, n in counts.items() if n}
    rows, n = plan_large(counts, 1024, 32)
    load, got = {}, {}
    for length, lo, hi, base, times, shift in rows:
        for r in range(lo, hi):
            load[base + (r - shift) % times] = load.get(base + (r - shift) % times, 0) + length
            got.setdefault(length, set()).add(r)
    assert {k: len(v) for k, v in got.items()} == counts
    assert sum(hi - lo for _, lo, hi, *_ in rows) == sum(counts.values())
    assert max(load.values()) <= 1024 and set(load) == set(range(n))
    rooms = {}
    for x in load.values():
        rooms[1024 - x] = rooms.get(1024 - x, 0) + 1
    small = {k: rng.randrange(1, 3000) for k in range(1, 65)}
    rows, new = plan_small(small, rooms, 1024)
    room = {}
    for length, lo, hi, origin, first in rows:
        for r in range(hi - lo):
            room[origin, first + r] = room.get((origin, first + r), 0) + length
    assert all(v <= (k[0] if k[0] >= 0 else 1024) for k, v in room.items())
    assert all(k[1] < (rooms[k[0]] if k[0] >= 0 else new) for k in room)
    assert sum(hi - lo for _, lo, hi, *_ in rows) == sum(small.values())


def test_texts_are_encoded_in_bounded_runs(monkeypatch):
    import pyarrow as pa

    from contactscope.llm import pack as module

    rng = random.Random(3)
    texts = [None, "", *(" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(9000))) for _ in range(400))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    assert sum(len(t or "") for t in texts) > 1.5 * module.ENCODE_BYTES
    make, sizes = module.batch_encoder, []

    def recorded(vocabulary):
        encode = make(vocabulary)
        return lambda texts: sizes.append(sum(len(t or "") for t in texts.to_pylist())) or encode(texts)

    monkeypatch.setattr(module, "batch_encoder", recorded)
    got = [r for b in module._pieces(1024, 2, module.VOCABULARY)([batch]) for r in b.to_pylist()]
    assert len(sizes) > 1 and max(sizes) <= module.ENCODE_BYTES
    ids, offsets = make(module.VOCABULARY)(batch.column("text"))
    want = []
    for k in range(len(texts)):
        row = [*ids[offsets[k] : offsets[k + 1]].tolist(), 2]
        at = 0
        for n, end in enumerate(range(len(row) % 1024 or 1024, len(row) + 1, 1024)):
            crc = zlib.crc32(np.array(row[at:end], "<u4").tobytes())
            want.append({"doc_id": k, "piece": n, "start": at, "length": end - at, "ids_crc32": crc})
            at = end
    assert got == want
