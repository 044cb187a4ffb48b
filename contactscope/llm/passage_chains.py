"""Fuzzy repeated passages by collinear chaining of shared word k-mers.

1. Seeds: of every window of ``window`` consecutive k-mers of a text the one with the smallest hash is
   kept, so two texts that share ``k + window - 1`` words in a row share a seed.
2. A seed that occurs in several documents joins each of them to one document, the smallest id that
   has it, so a passage in m documents gives m - 1 pairs and not m squared. The same is done for each
   seed with the next one, and for each seed with the ``min_words`` words from it on: where frequent
   lines occur alone in earlier documents, the longer run still joins the documents that share it.
3. The anchors (place, place in the other document) of a pair are chained: the best chain that goes
   forward in both, worth ``k`` for each anchor less a cost for the words skipped on either side. The
   best predecessor is a prefix maximum, held in a Fenwick tree over the places in the other document.
4. The words under chains that lie close together are fetched once from both documents. A chain is cut where its identity would
   fall below ``min_identity``, down to single anchors; the parts are extended while they agree, and
   parts of at least ``min_words`` words and ``min_identity`` identity are passages. Parts are aligned
   without a band; those of over ``BIT_WORDS`` words between their anchors, unless few edits do.

Words are runs of characters other than space and 0x09 to 0x0D, with A-Z lower-cased. Defined results:
null text counts as empty; texts shorter than ``k`` words have no seeds; repeats within one document
are no passages; rows without an id are left out; rows that repeat an id count as one document, and a
chain is checked against each of their texts, the best alignment counts. Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactscope.llm.common import RUN_BYTES, mixed, stored, text_runs, window_hashes, word_hasher

K = 4  # MIN_WORDS words with every fifth one replaced have four equal ones in a row
WINDOW = 6
MIN_WORDS = 30
MIN_IDENTITY = 0.8
GAP_COST = 0.05  # for each word skipped on either side, in words
BIN_ANCHORS = 20_000
RANGE = 1024  # words; chains of a pair that begin in the same ones are fetched together
REQUESTS = 256  # slices that are cut from one copy of a text
FLUSH_ROWS = 4096  # chains that a task gathers before it passes them on
MARGIN = 16  # words fetched on either side of a chain at first; more where an extension needs them
BAND, FEW_EDITS = 16, 64  # diagonals beside the corners', edits: where a long part is tried first
TOGETHER, FEW = 4096, 8  # single anchors extended at once; fewer are extended one by one
BIT_WORDS = 4096  # words up to which a row of the alignment is one number
BIT_TABLE = 1 << 28  # bits of the table of a longer row's distinct words, beyond which it is not made
RESUME = 6  # words that must agree after a skip
#: Words skipped in one text and the other where a chain is extended, short skips first.
SKIPS = sorted(((s, t) for s in range(5) for t in range(5) if s + t), key=sum)


def winnowed(hashes, window: int):
    """Places of the smallest hash of every window, the first of equal ones; all in order."""
    import numpy as np

    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= window:
        return np.array([int(np.argmin(hashes))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.argmin(views, axis=1) + np.arange(n - window + 1))


def _run_hashes(words, n: int):
    """A hash of the ``n`` words from each place on, from sums of powers; ``words`` has ``n`` or more."""
    import numpy as np

    base, inverse = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full((2, len(words)), np.array([[base], [inverse]], np.uint64)).cumprod(axis=1, dtype=np.uint64)
        total = np.append(np.uint64(0), np.cumsum(words * up, dtype=np.uint64))
        return mixed((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def _seeds(k: int, window: int, min_words: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes_of = word_hasher()
        for batch in text_runs(batches):
            words, offsets, _, _ = hashes_of(batch.column("text"))
            if len(words) < k:
                continue
            grams = window_hashes(words, k)  # those that go on into the next text are not used
            runs = _run_hashes(words, min_words) if len(words) >= min_words else words[:0]
            kept = np.flatnonzero(np.diff(offsets) >= k)
            if not len(kept):
                continue
            found = [winnowed(grams[offsets[d] : offsets[d + 1] - k + 1], window) for d in kept]
            owner = np.repeat(kept, [len(f) for f in found])
            places = np.concatenate(found)
            at = places + offsets[owner]
            # With the seed itself, half a hash is enough. Zero: there is no next seed or no whole run.
            pair, long = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            pair[:-1] = mixed(grams[at[1:]] + np.diff(at).astype(np.uint64)) >> np.uint64(32)
            pair[:-1][owner[1:] != owner[:-1]] = 0
            whole = at + min_words <= offsets[owner + 1]
            long[whole] = runs[at[whole]] >> np.uint64(32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams[at].view(np.int64)),
                    batch.column("doc_id").take(pa.array(owner)),
                    pa.array(places.astype(np.int32)),
                    pa.array(pair.astype(np.uint32).view(np.int32)),
                    pa.array(long.astype(np.uint32).view(np.int32)),
                ],
                ["seed", "doc_id", "at", "pair", "run"],
            )

    return run


def _shared(batches):
    """Rows sorted by (seed, doc_id): those whose seed occurs in several documents.

    Of a seed only the rows of its first document are held, until another one has it too.
    """
    import numpy as np
    import pyarrow as pa

    held, known = [], None  # rows whose seed may yet be shared; the last seed that is
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        seed, doc = rows.column("seed").to_numpy(), rows.column("doc_id").to_numpy()
        new = np.append(True, seed[1:] != seed[:-1])
        starts = np.flatnonzero(new)
        shared = doc[starts] != doc[np.append(starts[1:], len(doc)) - 1]
        shared[0] |= known is not None and seed[0] == known
        known = seed[-1] if shared[-1] else None
        held = [] if shared[-1] else [rows.slice(int(starts[-1]))]
        yield rows.filter(pa.array(shared[np.cumsum(new) - 1]))


def chains(x, y, k: int, gap_cost: float) -> list[list[int]]:
    """Disjoint chains of the anchors (x, y), best first, as lists of indices in order.

    ``x`` ascends. Both places must ascend along a chain. The worth of a chain is ``k`` for each
    anchor, less ``gap_cost`` for each word between anchors on either side.
    """
    import numpy as np

    n = len(x)
    ranks = (np.unique(y, return_inverse=True)[1] + 1).tolist()
    top = max(ranks)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (top + 1)
    worth, back = [0.0] * n, [-1] * n
    xs, ys = x.tolist(), y.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # equal places are no predecessors of each other
            best, at = (-1e18, -1), ranks[j] - 1
            while at > 0:
                if tree[at][0] > best[0]:
                    best = tree[at]
                at &= at - 1
            gain = best[0] - gap_cost * (xs[j] + ys[j]) if best[1] >= 0 else 0.0
            worth[j] = k + max(0.0, gain)
            back[j] = best[1] if gain > 0 else -1
            j += 1
        for q in range(i, j):
            entry, at = (worth[q] + gap_cost * (xs[q] + ys[q]), q), ranks[q]
            while at <= top:
                if entry[0] > tree[at][0]:
                    tree[at] = entry
                at += at & -at
        i = j
    used, out = [False] * n, []
    for q in sorted(range(n), key=lambda q: -worth[q]):
        chain = []
        while q >= 0 and not used[q]:
            used[q] = True
            chain.append(q)
            q = back[q]
        if chain:
            out.append(chain[::-1])
    return out


def _chained(k: int, gap_cost: float):
    def run(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values(["doc_id", "src_id", "at", "src_at"], kind="stable")
        ids = frame[["doc_id", "src_id"]].to_numpy()
        x, y = frame["at"].to_numpy(np.int64), frame["src_at"].to_numpy(np.int64)
        turn = np.flatnonzero(np.any(np.diff(ids, axis=0, prepend=ids[:1] - 1) != 0, axis=1))
        out = []
        for a, b in zip(turn, np.append(turn[1:], len(ids)), strict=True):
            for chain in chains(x[a:b], y[a:b], k, gap_cost):
                xs, ys = x[a:b][chain], y[a:b][chain]
                out.append((ids[a, 0], ids[a, 1], xs[0], xs[-1] + k, ys[0], ys[-1] + k, xs.tolist(), ys.tolist()))
        return pd.DataFrame(out, columns=["doc_id", "src_id", "lo", "hi", "src_lo", "src_hi", "xs", "ys"])

    return run


def _sliced(margin: int):
    """The words under each of a text's requests with up to ``margin`` more on either side, as hash bytes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes_of = word_hasher()
        for batch in text_runs(batches):
            words, offsets, _, _ = hashes_of(batch.column("text"))
            # Four bytes a word are enough here: the words are compared side by side.
            small = (words >> np.uint64(32)).astype(np.uint32)
            asked = batch.column("asked")
            rows = asked.flatten()
            owner = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
            begin, end = offsets[owner], offsets[owner + 1]
            a = np.maximum(begin, begin + rows.field("lo").to_numpy() - margin)
            b = np.maximum(a, np.minimum(end, begin + rows.field("hi").to_numpy() + margin))
            ends = np.cumsum(b - a)
            at = 0
            while at < len(a):  # many requests of a long text are more than the text
                start = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, start + RUN_BYTES // 4, side="right")))
                cut = [small[p:q].tobytes() for p, q in zip(a[at:to], b[at:to], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.field("unit").slice(at, to - at),
                        rows.field("side").slice(at, to - at),
                        pa.array((a - begin)[at:to].astype(np.int64)),
                        pa.array(cut, pa.binary()),
                        pa.array((b < end)[at:to]),
                    ],
                    ["unit", "side", "from", "words", "more"],
                )
                at = to

    return run


def matched_words(a, b, band: int, least: int) -> int:
    """Words that a best alignment matches, if ``least`` or more are, else 0.

    Greedy by edits: the furthest place on each diagonal within ``band`` of the corners' diagonals,
    over runs of agreeing words that are looked up.
    """
    import numpy as np

    n, m = len(a), len(b)
    most = n + m - 2 * least  # edits beyond which fewer words match
    if most < abs(n - m):
        return 0
    lowest, highest = min(0, m - n) - band, max(0, m - n) + band
    runs: dict[int, list] = {}

    def run(d: int, i: int) -> int:
        """Agreeing words from place i of ``a`` on, on diagonal d."""
        if d not in runs:
            lo, hi = max(0, -d), min(n, m - d)
            stops = np.flatnonzero(a[lo:hi] != b[lo + d : hi + d]) + lo if hi > lo else np.empty(0, np.int64)
            runs[d] = [*stops.tolist(), max(lo, hi)]
        stops = runs[d]
        return max(i, stops[bisect.bisect_left(stops, i)] if i <= stops[-1] else i)

    if n == m and (a == b).all():
        return n
    far = {0: run(0, 0)}
    for edits in range(1, most + 1):
        new = {}
        for d in range(max(lowest, -edits), min(highest, edits) + 1):
            i = max(far.get(d - 1, -1), far.get(d + 1, -2) + 1)
            if i < 0 or i > n or i + d < 0 or i + d > m:
                continue
            i = run(d, i)
            if d == m - n and i >= n:
                return (n + m - edits) // 2
            new[d] = i
        far = new
    return 0


def common_words(a, b) -> int:
    """Length of the longest common subsequence of two runs of words."""
    import numpy as np

    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    head = int(apart[0]) if len(apart) else n
    a, b, n = a[head:], b[head:], n - head
    if n == 0:
        return head
    apart = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(apart[0]) if len(apart) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    b = b[np.isin(b, a)]
    if len(b) == 0:
        return head + tail
    if len(a) > BIT_WORDS and len(a) * len(np.unique(a)) > BIT_TABLE:  # row by row; the table would be too large
        row = np.zeros(len(a) + 1, np.int64)
        for word in b:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (a == word)))
        return head + tail + int(row[-1])
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    whole = (1 << len(a)) - 1
    state = whole
    for word in b.tolist():
        met = state & places[word]
        state = (state + met | state - met) & whole
    return head + tail + len(a) - state.bit_count()


def blocks(a, b, x, y, k: int) -> list[tuple[int, int, int]]:
    """The anchors that hold in ``a`` and ``b`` as (place, place, words), without overlaps."""
    import numpy as np

    if len(x) == 1:
        p, q = int(x[0]), int(y[0])
        fit = p >= 0 and q >= 0 and p + k <= len(a) and q + k <= len(b) and a[p : p + k].tobytes() == b[q : q + k].tobytes()
        return [(p, q, k)] if fit else []
    fits = np.flatnonzero((x >= 0) & (y >= 0) & (x + k <= len(a)) & (y + k <= len(b)))
    for j in range(k):
        fits = fits[a[x[fits] + j] == b[y[fits] + j]]
    out: list[tuple[int, int, int]] = []
    for p, q in zip(x[fits].tolist(), y[fits].tolist(), strict=True):
        n = k
        if out:
            i, j, m = out[-1]
            late = max(0, i + m - p, j + m - q)
            if late >= k:
                continue
            p, q, n = p + late, q + late, k - late
            if (p, q) == (i + m, j + m):
                out[-1] = (i, j, m + n)
                continue
        out.append((p, q, n))
    return out


def parts(a, b, x, y, k: int, min_words: int, min_identity: float, ends=(False,) * 4) -> list[tuple[int, ...]] | None:
    """The passages (lo, hi, src_lo, src_hi, matched) along one chain of anchors (x, y) of ``k`` words.

    ``ends`` says where more words follow: before and after ``a``, before and after ``b``. None, if an
    extension needs them.

    From the first block on, the longest run of blocks that keeps the identity is a part, and the next
    part begins after it. A part that is extended over the blocks behind it takes them along.
    """
    import numpy as np

    found = blocks(a, b, x, y, k)
    out: list[tuple[int, int, int, int, int]] = []
    if len(found) < 2:
        for i, j, m in found:
            return _extended(a, b, (i, i + m, j, j + m), m, min_words, min_identity, ends)
        return out
    p, q, n = (np.array(v) for v in zip(*found, strict=True))
    gaps = [
        common_words(a[i + m : u], b[j + m : v]) for (i, j, m), (u, v, _) in zip(found[:-1], found[1:], strict=True)
    ]
    end = np.cumsum(n + np.array([0, *gaps]))
    begin = end - n
    stops = [end - min_identity * (p + n), end - min_identity * (q + n)]
    begins = [begin - min_identity * p, begin - min_identity * q]
    i = 0
    while i < len(found):
        good = np.flatnonzero((stops[0][i:] >= begins[0][i] - 1e-9) & (stops[1][i:] >= begins[1][i] - 1e-9))
        j = i + int(good[-1])
        core = (int(p[i]), int(p[j] + n[j]), int(q[i]), int(q[j] + n[j]))
        first, i = i, j + 1
        if out and core[1] <= out[-1][1] and core[3] <= out[-1][3]:
            continue
        got = _extended(a, b, core, int(end[j] - begin[first]), min_words, min_identity, ends)
        if got is None:
            return None
        out += got
    return out


def _extended(a, b, core, inner: int, min_words: int, min_identity: float, ends) -> list[tuple[int, ...]] | None:
    """The part around a run of blocks (lo, hi, src_lo, src_hi) of ``inner`` matched words, if it is a passage."""
    lo, hi, src_lo, src_hi = core
    left, right = _reach(a[:lo][::-1], b[:src_lo][::-1]), _reach(a[hi:], b[src_hi:])
    if any(more and out_of for more, out_of in zip(ends, (left[2], right[2], left[3], right[3]), strict=True)):
        return None
    wide = (lo - left[0], hi + right[0], src_lo - left[1], src_hi + right[1])
    return _whole(a, b, core, wide, inner, min_words, min_identity)


def _whole(a, b, core, wide, inner: int, min_words: int, min_identity: float) -> list[tuple[int, ...]]:
    """The run of blocks with its extension ``wide``, or else without, if that is a passage."""
    lo, hi, src_lo, src_hi = core
    for s, t, u, v in dict.fromkeys((wide, core)):
        long = max(t - s, v - u)
        if long < min_words:
            continue
        # Few edits are found along the diagonals; else long parts are aligned block by block.
        matched = matched_words(a[s:t], b[u:v], BAND, long - FEW_EDITS // 2) if long > BIT_WORDS else 0
        if not matched and long > BIT_WORDS:
            matched = common_words(a[s:lo], b[u:src_lo]) + inner + common_words(a[hi:t], b[src_hi:v])
        matched = matched or common_words(a[s:t], b[u:v])
        if matched >= min_identity * long - 1e-9:
            return [(s, t, u, v, matched)]
    return []


def _aligned(k: int, min_words: int, min_identity: float):
    """The passages of each chain of a unit, whose words are there once.

    Most chains are single anchors; those of a batch are extended together, ``TOGETHER`` at a time.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("matched", "lo", "hi", "src_lo", "src_hi")]))

        def rows(out):
            names = ["chain", "total", "cut", "parts"]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), kind)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds, strict=True)], names)

        def flat(column):
            column = column.cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = column.buffers()[2]
            words = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].view(np.uint32)
            return words, (ends - ends[0]) // 4

        def row(chain, got, at, src_at):
            named = [
                {"matched": m, "lo": s + at, "hi": t + at, "src_lo": u + src_at, "src_hi": v + src_at}
                for s, t, u, v, m in got
            ]
            return chain, sum(g[-1] for g in got), False, named

        out = []
        for batch in batches:
            if not batch.num_rows:
                continue
            (a, a_at), (b, b_at) = flat(batch.column("words")), flat(batch.column("src_words"))
            here, src_here, more, src_more = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("from", "src_from", "more", "src_more")
            )
            each = batch.column("chains").flatten()
            owner = np.repeat(np.arange(batch.num_rows), batch.column("chains").value_lengths().to_numpy())
            names, xs, ys = (each.field(c) for c in ("chain", "xs", "ys"))
            names, count = names.to_numpy(), xs.value_lengths().to_numpy()
            ends = np.cumsum(count)
            xs, ys = (v.flatten().to_numpy().astype(np.int64) for v in (xs, ys))
            single = np.flatnonzero(count == 1)
            for part in np.split(single, range(TOGETHER, len(single), TOGETHER)):
                u = owner[part]
                x, y = xs[ends[part] - 1] - here[u], ys[ends[part] - 1] - src_here[u]
                n, m = np.diff(a_at)[u], np.diff(b_at)[u]
                fits = np.flatnonzero((x >= 0) & (y >= 0) & (x + k <= n) & (y + k <= m))
                for j in range(k):
                    fits = fits[a[a_at[u[fits]] + x[fits] + j] == b[b_at[u[fits]] + y[fits] + j]]
                part, u, x, y, n, m = (v[fits] for v in (part, u, x, y, n, m))
                i, j = a_at[u] + x, b_at[u] + y
                left = _reach_all(a, b, i - 1, j - 1, x, y, -1)
                right = _reach_all(a, b, i + k, j + k, n - x - k, m - y - k, 1)
                cut = (here[u] > 0) & left[2] | more[u] & right[2] | (src_here[u] > 0) & left[3] | src_more[u] & right[3]
                out += [(c, 0, True, []) for c in names[part[cut]].tolist()]
                long = k + np.maximum(left[0] + right[0], left[1] + right[1])
                kept = np.flatnonzero(~cut & (long >= min_words))
                places = (v[kept].tolist() for v in (names[part], u, x, y, left[0], right[0], left[1], right[1]))
                for name, d, p, q, s, t, v, w in zip(*places, strict=True):
                    wide = (p - s, p + k + t, q - v, q + k + w)
                    texts = a[a_at[d] : a_at[d + 1]], b[b_at[d] : b_at[d + 1]]
                    got = _whole(*texts, (p, p + k, q, q + k), wide, k, min_words, min_identity)
                    if got:
                        out.append(row(name, got, int(here[d]), int(src_here[d])))
                if len(out) >= FLUSH_ROWS:
                    yield rows(out)
                    out = []
            for c in np.flatnonzero(count != 1).tolist():
                d, span = owner[c], slice(ends[c] - count[c], ends[c])
                at, src_at = int(here[d]), int(src_here[d])
                edges = (at > 0, bool(more[d]), src_at > 0, bool(src_more[d]))
                texts = a[a_at[d] : a_at[d + 1]], b[b_at[d] : b_at[d + 1]]
                got = parts(*texts, xs[span] - at, ys[span] - src_at, k, min_words, min_identity, edges)
                if got is None:
                    out.append((int(names[c]), 0, True, []))
                elif got:
                    out.append(row(int(names[c]), got, at, src_at))
                if len(out) >= FLUSH_ROWS:
                    yield rows(out)
                    out = []
        if out:
            yield rows(out)

    return run


def _together_all(a, b, i, j, n, step: int):
    """``_together`` for many pairs of places: from i in ``a`` and j in ``b`` on, n words each way."""
    import numpy as np

    agreed, wrong, ran_out = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), n == 0
    live = np.flatnonzero(~ran_out)
    live = live[a[i[live]] == b[j[live]]]
    at, width = 0, 16
    while len(live):
        r = np.arange(at, at + width)
        inside = r < n[live][:, None]
        move = np.where(inside, r * step, 0)
        same = (a[i[live][:, None] + move] == b[j[live][:, None] + move]) & inside
        bad = np.cumsum(~same, axis=1) + wrong[live][:, None]
        over = (bad * 5 > r + 1) & inside
        stops = over.any(axis=1)
        good = same & (r < np.where(stops, at + over.argmax(axis=1), at + width)[:, None])
        some = good.any(axis=1)
        agreed[live[some]] = at + width - good[some][:, ::-1].argmax(axis=1)
        wrong[live] = bad[:, -1]
        at += width
        ended = ~stops & (n[live] <= at)
        ran_out[live[ended]] = True
        live = live[~stops & ~ended]
        width = max(16, min(4 * width, 16 * TOGETHER // max(1, len(live))))
    return agreed, ran_out


def _reach_all(a, b, i, j, n, m, step: int):
    """``_reach`` for many pairs of places: n words of ``a`` from i on, m words of ``b`` from j on."""
    import numpy as np

    far = RESUME + max(SKIPS)[0]
    p, q = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    out = np.zeros((2, len(i)), bool)
    live = np.arange(len(i))
    while len(live) >= FEW:
        la, lb = n[live] - p[live], m[live] - q[live]
        short = np.minimum(la, lb)
        more, ran_out = _together_all(a, b, i[live] + step * p[live], j[live] + step * q[live], short, step)
        out[:, live] |= ran_out & (np.stack([la, lb]) == short)
        p[live] += more
        q[live] += more
        la, lb = la - more, lb - more
        r = np.arange(far)
        x = a[np.where(r < la[:, None], (i[live] + step * p[live])[:, None] + step * r, 0)]
        y = b[np.where(r < lb[:, None], (j[live] + step * q[live])[:, None] + step * r, 0)]
        open_ = np.ones(len(live), bool)
        for s, t in SKIPS:
            c = np.flatnonzero(open_ & (x[:, s] == y[:, t]) & (s + RESUME <= la) & (t + RESUME <= lb))
            c = c[(x[c, s : s + RESUME] == y[c, t : t + RESUME]).all(axis=1)]
            p[live[c]] += s
            q[live[c]] += t
            open_[c] = False
        done = live[open_]
        out[:, done] |= np.stack([n[done] - p[done], m[done] - q[done]]) < far
        live = live[~open_]
    for c in live.tolist():
        at, to = i[c] + step * p[c], j[c] + step * q[c]
        la, lb = n[c] - p[c], m[c] - q[c]
        if step > 0:
            got = _reach(a[at : at + la], b[to : to + lb])
        else:
            got = _reach(a[at + 1 - la : at + 1][::-1], b[to + 1 - lb : to + 1][::-1])
        p[c], q[c] = p[c] + got[0], q[c] + got[1]
        out[:, c] |= got[2:]
    return p, q, *out


def _together(a, b) -> tuple[int, bool]:
    """How far two runs of words go on side by side, and whether words ran out before more than every
    fifth word so far differed."""
    import numpy as np

    n = min(len(a), len(b))
    if n == 0:
        return 0, True
    if a[0] != b[0]:
        return 0, False
    size = 64
    while True:  # words behind the stop are not looked at
        same = a[: min(n, size)] == b[: min(n, size)]
        far = np.flatnonzero(np.cumsum(~same) * 5 > np.arange(1, len(same) + 1))
        if len(far) or size >= n:
            break
        size *= 8
    stop = int(far[0]) if len(far) else n
    agreed = np.flatnonzero(same[:stop])
    return (int(agreed[-1]) + 1 if len(agreed) else 0), not len(far)


def _reach(a, b) -> tuple[int, int, bool, bool]:
    """How far two runs of words go on, over short insertions and deletions too; and whether more words
    of ``a``, or of ``b``, could take it further."""
    i = j = 0
    size = 4 * RESUME
    far = RESUME + max(SKIPS)[0]
    out = [False, False]
    while True:
        n, ran_out = _together(a[i:], b[j:])
        left = len(a) - i, len(b) - j
        out = [o or (ran_out and side == min(left)) for o, side in zip(out, left, strict=True)]
        i, j = i + n, j + n
        x, y = a[i : i + far].tobytes(), b[j : j + far].tobytes()
        for s, t in SKIPS:
            p, q = 4 * s, 4 * t
            if p + size <= len(x) and q + size <= len(y) and x[p : p + size] == y[q : q + size]:
                i, j = i + s, j + t
                break
        else:
            return i, j, out[0] or len(a) - i < far, out[1] or len(b) - j < far


WORDS = "unit string, side int, from bigint, words binary, more boolean"


def _units(chains_: DataFrame) -> DataFrame:
    """Chains of a pair of documents that begin in the same ``RANGE`` words of both: their words are fetched once.

    A place is in few anchors, so a unit has no more than a few times ``RANGE`` chains.
    """
    near = [F.floor(F.col(c) / RANGE).alias(f"_{c}") for c in ("lo", "src_lo")]
    return chains_.groupBy("doc_id", "src_id", *near).agg(
        F.min("chain").cast("string").alias("unit"),
        F.collect_list(F.struct("chain", "xs", "ys")).alias("chains"),
        *[f(c).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"), (F.min, "src_lo"), (F.max, "src_hi"))],
    ).drop("_lo", "_src_lo")


def _asked(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(text, asked): each text with its requests (unit, side, lo, hi), about ``REQUESTS`` of them in a row."""
    ours = units.select(F.col("doc_id").alias("_id"), "unit", F.lit(0).alias("side"), "lo", "hi")
    asks = ours.union(units.select("src_id", "unit", F.lit(1), "src_lo", "src_hi"))
    many = asks.groupBy("_id").agg(F.ceil(F.count(F.lit(1)) / REQUESTS).alias("rows"))
    asked = asks.join(many, "_id").groupBy("_id", F.pmod(F.xxhash64("unit", "side"), F.col("rows")).alias("row"))
    asked = asked.agg(F.collect_list(F.struct("unit", "side", "lo", "hi")).alias("asked"))
    return docs.join(asked, F.col("doc_id") == F.col("_id")).select("text", "asked")


def passages(
    docs: DataFrame,
    k: int = K,
    window: int = WINDOW,
    min_words: int = MIN_WORDS,
    min_identity: float = MIN_IDENTITY,
    gap_cost: float = GAP_COST,
) -> DataFrame:
    """One row per repeated passage: doc_id and src_id, the words from lo up to hi and src_lo up to
    src_hi, n_words (the longer side), matched words, and identity (matched by n_words)."""
    docs = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).where("doc_id is not null")
    kind = "seed bigint, doc_id bigint, at int, pair int, run int"
    # Most seeds are in one document only; one sorted shuffle tells them, and they are not stored.
    seeds = docs.mapInArrow(_seeds(k, window, min_words), kind).repartition("seed").sortWithinPartitions("seed", "doc_id")
    met = stored(seeds.mapInArrow(_shared, kind), "passage-shared")
    # Dealt by the seed once: the first place of a seed, of it with the next one, and of it with the run.
    tied = met
    for level, more in (("one", []), ("two", ["pair"]), ("long", ["run"])):
        rows = Window.partitionBy("seed", *more).orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, 0)
        place = F.struct(F.first("doc_id").over(rows).alias("src_id"), F.first("at").over(rows).alias("src_at"))
        tied = tied.withColumn(level, F.when(F.col(more[0]) != 0, place) if more else place)
    ties = F.explode(F.array_distinct(F.array("one", "two", "long")))
    anchors = tied.select("doc_id", ties.alias("s"), "at").where("s is not null and s.src_id <> doc_id")
    anchors = stored(anchors.select("doc_id", "s.src_id", "at", "s.src_at").distinct(), "passage-anchors")
    bins = max(1, anchors.count() // BIN_ANCHORS)
    found = (
        anchors.withColumn("bin", F.pmod(F.xxhash64("doc_id", "src_id"), F.lit(bins)))
        .groupBy("bin")
        .applyInPandas(
            _chained(k, gap_cost),
            "doc_id bigint, src_id bigint, lo bigint, hi bigint, src_lo bigint, src_hi bigint, xs array<int>, ys array<int>",
        )
    )
    # The table is stored, so that its row numbers stay.
    found = stored(found.withColumn("chain", F.monotonically_increasing_id()), "passage-chains")
    part = "struct<matched: bigint, lo: bigint, hi: bigint, src_lo: bigint, src_hi: bigint>"
    best, todo, margin = None, found, MARGIN
    while True:
        units = stored(_units(todo), "passage-units")
        slices = stored(_asked(docs, units).mapInArrow(_sliced(margin), WORDS), "passage-words")
        one = slices.where("side = 0").drop("side")
        two = slices.where("side = 1").select("unit", *[F.col(c).alias(f"src_{c}") for c in ("from", "words", "more")])
        both = units.select("unit", "chains").join(one, "unit").join(two, "unit")
        aligned = both.mapInArrow(
            _aligned(k, min_words, min_identity), f"chain bigint, total bigint, cut boolean, parts array<{part}>"
        )
        aligned = aligned.groupBy("chain")
        aligned = aligned.agg(F.max(F.struct("total", "parts")).alias("b"), F.max("cut").alias("cut"))
        aligned = stored(aligned, "passage-parts")
        whole = aligned.where("not cut")
        best = whole if best is None else best.union(whole)
        # Chains whose extension ran out of the words fetched are aligned again, over more words.
        todo = todo.join(aligned.where("cut").select("chain"), "chain", "left_semi")
        if aligned.where("cut").isEmpty():
            break
        todo, margin = stored(todo, "passage-chains"), margin * 16
    best = best.select("chain", F.explode("b.parts").alias("b"))
    words = F.greatest(F.col("b.hi") - F.col("b.lo"), F.col("b.src_hi") - F.col("b.src_lo"))
    return found.select("chain", "doc_id", "src_id").join(best, "chain").select(
        "doc_id",
        "src_id",
        "b.lo",
        "b.hi",
        "b.src_lo",
        "b.src_hi",
        words.alias("n_words"),
        "b.matched",
        (F.col("b.matched") / words).alias("identity"),
    ).distinct()
