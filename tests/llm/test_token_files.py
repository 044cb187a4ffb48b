import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from contactscope.llm.queries import QUERIES
from contactscope.llm.token_files import END_OF_TEXT, count_documents, read_blocks, write_flat


def test_query_counts_every_document(spark, folder):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()
    got = QUERIES["op9_token_counts"](spark, folder).collect()
    assert all(r["complete"] for r in got)
    want = Counter(len(model.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs)
    assert Counter(r["n_tokens"] for r in got) == want


@pytest.mark.parametrize("block_tokens", [1, 2, 3, 7, 1000])
def test_stitching_equals_a_plain_split(spark, tmp_path, block_tokens):
    rng = np.random.default_rng(block_tokens)
    want = {}
    for k in range(4):
        ids = rng.choice([1, 2, 0xC4C4, 0x5050, END_OF_TEXT, 0x50C4], size=rng.integers(1, 60))
        (tmp_path / f"part-{k}.bin").write_bytes(ids.astype(">u2").tobytes() + (b"\xc4" if k == 1 else b""))
        at, rows = 0, []
        for place, token in enumerate(ids.tolist()):
            if token == END_OF_TEXT:
                rows.append((len(rows), at, place - at, True))
                at = place + 1
        if at < len(ids):
            rows.append((len(rows), at, len(ids) - at, False))
        want[f"part-{k}.bin"] = rows
    (tmp_path / "part-9.bin").write_bytes(b"")
    got = {}
    for r in count_documents(read_blocks(spark, f"file://{tmp_path}", block_tokens)).collect():
        got.setdefault(r["file"], []).append((r["doc_no"], r["start"], r["n_tokens"], r["complete"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_round_trip_of_odd_texts(spark, tmp_path):
    texts = [None, "", "<|endoftext|> is text", "é\n\n日本", "a " * 200_000, "same", "same"]
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, body string").coalesce(1)
    path = write_flat(docs, f"file://{tmp_path}/flat", file_docs=3)
    names = sorted(f for f in os.listdir(tmp_path / "flat") if f.startswith("part-"))
    assert len(names) == 3
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    ids = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    flat = np.concatenate([np.fromfile(tmp_path / "flat" / f, ">u2") for f in names]).tolist()
    assert flat == [x for part in ids for x in [*part, END_OF_TEXT]]
    got = count_documents(read_blocks(spark, path, 1 << 12)).orderBy("file", "doc_no").collect()
    assert [r["n_tokens"] for r in got] == [len(p) for p in ids]


def test_empty_table_and_bad_end(spark, tmp_path):
    docs = spark.createDataFrame([], "text string")
    path = write_flat(docs, f"file://{tmp_path}/none")
    assert count_documents(read_blocks(spark, path)).count() == 0
    with pytest.raises(ValueError):
        write_flat(docs, f"file://{tmp_path}/bad", end_id=0xC4)
