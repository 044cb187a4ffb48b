import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from contactscope.llm.tokens import batch_encoder

PARTS = ["a", " ", " ", "\n", "é", " ", "\xa0", "日", "1", "'s", "!", "<|endoftext|>", "\x1f", "😀", "\x85", "word", "Ñandú"]


@pytest.mark.parametrize("seed", range(3))
def test_ids_equal_those_of_the_whole_text(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", " ", "  ", "x" * 5000, "ab " * 50_000]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, offsets = batch_encoder()(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_slices_and_empty_batches():
    run = batch_encoder()
    whole, _ = run(pa.array(["one two", "three"]).slice(1))
    alone, _ = run(pa.array(["three"]))
    assert whole.tolist() == alone.tolist()
    assert run(pa.array([], pa.string()))[1].tolist() == [0]
    assert run(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]


def test_word_hashes_of_slices_and_runs():
    from contactscope.llm.common import text_runs, word_hasher

    texts = ["One two", None, "", "x" * 3000 + " y", "é \t\n Z", "a b c"]
    whole = word_hasher()(pa.array(texts))
    assert whole[1].tolist() == [0, 2, 2, 2, 4, 6, 9]
    part = word_hasher()(pa.array(texts).slice(3))
    assert part[0].tolist() == whole[0][2:].tolist() and part[1].tolist() == [0, 2, 4, 7]
    assert part[2].tolist() == whole[2][2:].tolist() and part[3].tolist() == whole[3][2:].tolist()
    batch = pa.RecordBatch.from_pydict({"text": texts, "k": list(range(6))})
    runs = list(text_runs([batch], limit=10))
    assert [r.column("k").to_pylist() for r in runs] == [[0, 1, 2], [3], [4], [5]]
    found = [h for r in runs for h in word_hasher()(r.column("text"))[0].tolist()]
    assert found == whole[0].tolist()
    assert list(text_runs([batch.slice(0, 0)])) == []
