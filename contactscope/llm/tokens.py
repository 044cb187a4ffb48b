"""Token ids of whole texts by a public byte-level BPE vocabulary, a batch of texts at a time.

Such a vocabulary never merges across a single space that has no other white space beside it. A
batch is cut at these places, each distinct piece is encoded once, and the ids are gathered back.
The ids equal those that ``tokenizers`` gives for the whole text; the rank file of the same
vocabulary is used since encoding by it is several times faster.
"""

from __future__ import annotations

VOCABULARY = "byte_bpe_50k.tiktoken"  # a file name known to ``public_tokenizers.path``
END_OF_TEXT = 50256
PIECE_BYTES = 1 << 20  # distinct pieces are encoded in runs of about so many bytes


def batch_encoder(vocabulary: str = VOCABULARY, special: bool = True):
    """A function from an Arrow string array to (flat ids, offsets of each text); null is empty.

    Without ``special`` the end-of-text string in a text is ordinary text.
    """
    import base64

    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    strings = {"<|endoftext|>": END_OF_TEXT} if special else {}
    model = tiktoken.Encoding(
        "public",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks,
        special_tokens=strings,
    )
    widths = np.zeros(max(max(ranks.values()), END_OF_TEXT) + 1, dtype=np.int64)
    widths[list(ranks.values())] = [len(piece) for piece in ranks]
    widths[END_OF_TEXT] = len("<|endoftext|>")
    ranks.clear()

    # Characters that surely are no white space: printable ASCII, and two-byte ones from U+00C0 on.
    plain = np.zeros(256, dtype=bool)
    plain[0x21:0x7F] = True
    two_byte_lead = np.zeros(256, dtype=bool)
    two_byte_lead[0xC3:0xE0] = True

    def encode(text: str):
        return model.encode_to_numpy(text, allowed_special="all")

    def cuts(data, starts):
        """Offsets at which pieces begin: the texts' own starts and the spaces of single gaps."""
        spaces = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.empty(0, np.int64)
        before = plain[data[spaces - 1]] | two_byte_lead[data[np.maximum(spaces - 2, 0)]] & (
            data[spaces - 1] >= 0x80
        )
        after = plain[data[spaces + 1]] | two_byte_lead[data[spaces + 1]]
        inner = spaces[before & after]
        # A gap must not touch the end of its text: both neighbours lie in the same text.
        text_of = np.searchsorted(starts, inner, side="right")
        same = (starts[text_of - 1] < inner) & (
            inner + 1 < np.append(starts, len(data))[text_of]
        )
        inner = inner[same]
        heads = starts[np.append(starts[1:], len(data)) > starts]
        return np.sort(np.concatenate([heads, inner])), heads

    def run(texts):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("").cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        if n == 0 or raw is None or offsets[-1] == offsets[0]:
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begins, heads = cuts(data, offsets[:-1])
        ends = np.append(begins, len(data))
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(data)]
        ).dictionary_encode()
        codes = pieces.indices.to_numpy(zero_copy_only=False)
        words = pieces.dictionary
        word_ends = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
        word_data = memoryview(words.buffers()[2])
        # Pieces that open a text are encoded alone; the rest begin with a single space.
        opening = np.zeros(len(words), dtype=bool)
        opening[codes[np.searchsorted(begins, heads)]] = True
        found, counts = [], np.zeros(len(words), dtype=np.int64)
        turns = np.flatnonzero(
            np.diff(opening.astype(np.int8), prepend=2)
            | (np.diff(word_ends[:-1] // PIECE_BYTES, prepend=-1) != 0)
            | opening
        )
        for a, b in zip(turns, np.append(turns[1:], len(words)), strict=True):
            ids = encode(str(word_data[word_ends[a] : word_ends[b]], "utf-8"))
            found.append(ids)
            if b - a == 1:
                counts[a] = len(ids)
            else:
                reached = np.cumsum(widths[ids]) + word_ends[a]
                stops = np.searchsorted(reached, word_ends[a + 1 : b + 1]) + 1
                counts[a:b] = np.diff(stops, prepend=0)
        table = np.concatenate(found)
        first = np.cumsum(counts) - counts
        per_piece = counts[codes]
        out_ends = np.cumsum(per_piece)
        take = np.arange(out_ends[-1]) + np.repeat(first[codes] - out_ends + per_piece, per_piece)
        text_cut = np.searchsorted(begins, offsets)  # the first piece at or after each text's start
        return table[take], np.append(0, out_ends)[text_cut]

    return run
