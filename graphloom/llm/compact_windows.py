"""Near-duplicate passages by compact windows.

Tokens are five-word shingles.  For one hash function the Cartesian tree over a text's token
hashes holds, at each node c, the widest span (l, r) in which c has the least hash: all passages inside
it that hold c share that minhash, so one compact window (l, c, r) stands for all of them.  Only nodes
whose span has room for a passage of LEAST tokens count; these are the sliding-window minima.

The passages that a window stands for lie within LEAST - 1 tokens of c; these tokens are its content.  Windows of
one hash and one content are one class: in different texts, all of it is repeated.  Every two classes of
one hash are compared, each passage of the one with each of the other at any offset: they are near if their token sets have a
Jaccard similarity of SIMILARITY or more.  A hash with many classes is compared in pairs of parts (PART), so memory
is bounded; within one, tokens that stand in one class alone can't be shared, so classes that differ in such tokens only are
compared once, and those without a passage of which enough is shared are left out before.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import connected_components
from .scratch import forget, table

SHINGLE, LEAST_WORDS, SIMILARITY = 5, 50, 0.8
LEAST = LEAST_WORDS - SHINGLE + 1
#: The similarity as a fraction.
ENOUGH = Fraction(SIMILARITY).limit_denominator(100).as_integer_ratio()
FUNCTIONS = 4
#: Columns of a window's content, c in the middle.
WIDE = 2 * LEAST - 1
#: A hash with more classes is compared in parts of about so many.
PART = 4096
#: Pairs of classes that are compared at once.
AT_ONCE = 256
#: Regions that one row asks of a text, on average at most.
ASKED_A_ROW = 512
SEEDS = np.array([(0xC2B2AE3D27D4EB4F * (2 * i + 1) ** 5) % (1 << 64) | 1 for i in range(FUNCTIONS)], np.uint64)


def _less_before(value: np.ndarray) -> np.ndarray:
    """Place of the nearest value before each that is less, -1 if there is none: places that are no answer point on to their own, runs of equal values twice as far each round."""
    to, open_ = np.arange(len(value)) - 1, np.arange(1, len(value))
    while len(open_):
        at = to[open_]
        more = value[at] >= value[open_]
        open_ = open_[more]
        to[open_] = to[at[more]]
        open_ = open_[to[open_] >= 0]
    return to


def _most_before(value: np.ndarray) -> np.ndarray:
    """The same of values that are less or equal; what is greater points on to what is less than it."""
    less, to, open_ = _less_before(value), np.arange(len(value)) - 1, np.arange(1, len(value))
    while len(open_):
        open_ = open_[value[to[open_]] > value[open_]]
        to[open_] = less[to[open_]]
        open_ = open_[to[open_] >= 0]
    return to


def cartesian_spans(h: np.ndarray, least: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of the Cartesian trees' nodes with r - l + 1 >= least; of equal hashes the leftmost is the upper node.

    apart: places in no text, at which trees end; those of a text are ``least`` or more.
    A node has such a span if it is the leftmost minimum of some window of ``least``; its nearest smaller neighbours then
    have one too, so these nodes alone give all ends.
    """
    n = len(h)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    high = (h >> np.uint64(32)) + np.uint64(1)
    if apart is not None:
        high[apart] = 0  # less than all hashes
    low = (high << np.uint64(31)) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= least:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if least > size:
        low = np.minimum(low[: len(low) - (least - size)], low[least - size :])
    # minima of windows that move on never go back while one is held: equal ones follow each other
    c = (low & np.uint64(0x7FFFFFFF)).astype(np.int64)
    c = c[np.append(True, c[1:] != c[:-1])]
    value = high[c].astype(np.int64)
    left, right = _most_before(value), len(c) - 1 - _less_before(value[::-1])[::-1]
    l, r = np.where(left < 0, 0, c[left] + 1), np.where(right >= len(c), n - 1, c[np.minimum(right, len(c) - 1)] - 1)
    inside = np.flatnonzero(value > 0)
    return c[inside], l[inside], r[inside]


SALT_AT, OFTEN = 57, 16


def dealt(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block to send by key: row numbers, keys to deal them by, and told.

    Rows whose key stands OFTEN times in the block are known to be repeated: they go to one of many tasks, with a salt in
    the key's upper bits (told: the salt and 1), and one row in their place tells the key's own task (told 1).
    So a key of a third of all rows has a few rows a block there; what comes out is the same for any OFTEN.
    """
    uniq, first, at, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    often = n >= OFTEN
    rows = np.concatenate((np.arange(len(key)), first[often]))
    salt = np.where(often[at], np.arange(len(key)) % 64 + 1, 0)
    deal = np.concatenate((key ^ (salt.astype(np.uint64) << np.uint64(SALT_AT)), uniq[often]))
    return rows, deal.view(np.int64), np.concatenate((np.where(salt > 0, salt + 1, 0), np.ones(int(often.sum()), np.int64))).astype(np.int8)


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of ``deal`` those whose key stands twice or more in the corpus; a run may cross batches."""
    held = None
    for batch in batches:
        told = batch.column("told").to_numpy()
        if (told > 1).any():
            yield batch.filter(pa.array(told > 1))
            batch, told = batch.filter(pa.array(told < 2)), told[told < 2]
        if not batch.num_rows:
            continue
        key = batch.column("deal").to_numpy()
        same = np.append(False, key[1:] == key[:-1])
        twin = same | np.append(same[1:], False)
        if held is not None and held[0] == key[0]:
            twin[0] = True
            if not held[1]:
                yield held[2]
        last = batch.num_rows - 1
        held = (key[-1], bool(twin[-1]) or told[-1] == 1, batch.slice(last))
        yield batch.filter(pa.array(twin & (told == 0)))


WINDOW = "deal long, told byte, content long, id long, c int, before int, behind int"


def contents(tokens: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the tokens a..b with the place of c among them."""
    n = len(tokens)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tx.mix(tokens) * tx.powers(tx.BASE, n), out=sums[1:])
    return tx.mix((sums[b + 1] - sums[a]) * tx.powers(tx.BASE_INVERSE, n + 1)[a] + ((c - a) * WIDE + b - a).astype(np.uint64))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tx.blocks(batches, "text"):
        words = tx.Words(block.column("text"))
        tokens = tx.grams(words.hashes(), SHINGLE)
        ids = block.column("id").to_numpy()
        counts = np.asarray(words.counts)
        texts = np.repeat(np.arange(len(counts)), counts)[: len(tokens)]
        # the tokens of a short text, and those that go on into the next one, are none
        apart = (counts[texts] < LEAST_WORDS) | (np.arange(len(tokens)) > np.asarray(words.at)[1:][texts] - SHINGLE)
        out: list[tuple] = []
        if not apart.all():
            for k, seed in enumerate(SEEDS):
                h = tx.mix((tokens ^ seed) * seed)
                c, l, r = cartesian_spans(h, LEAST, apart)
                a, b = np.maximum(l, c - LEAST + 1), np.minimum(r, c + LEAST - 1)
                out.append((tx.mix(h[c] + np.uint64(k)), ids[texts[c]], c - np.asarray(words.at)[texts[c]], c - a, b - c, c))
        if out:
            sig, id_, c, before, behind, place = (np.concatenate(x) for x in zip(*out, strict=True))
            content = contents(tokens, place, place - before, place + behind).view(np.int64)
            rows, deal, told = dealt(sig)
            yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(told), pa.array(content[rows]), pa.array(id_[rows]), *[pa.array(x[rows].astype(np.int32)) for x in (c, before, behind)]], names=[x.split()[0] for x in WINDOW.split(", ")])


CLASS = "key long, content long, parts int, id long, last long, n long, c int, before int, behind int"
SHOWN = CLASS + ", tokens binary"


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each asked class of windows its tokens (32 bits each) in a text. A popular text is asked for many: they leave in small batches."""
    names = [x.split()[0] for x in CLASS.split(", ")]
    for block in tx.blocks(batches, "text"):
        words = tx.Words(block.column("text"))
        tokens = (tx.grams(words.hashes(), SHINGLE) >> np.uint64(32)).astype(np.uint32)
        asked = block.column("asked")
        flat = asked.flatten()
        at = np.repeat(words.at[:-1], pc.list_value_length(asked).to_numpy(zero_copy_only=False)) + flat.field("c").to_numpy()
        low, high = at - flat.field("before").to_numpy(), at + flat.field("behind").to_numpy()
        for i in range(0, len(flat), 4096):
            own = slice(i, i + 4096)
            blobs = [tokens[a : b + 1].tobytes() for a, b in zip(low[own].tolist(), high[own].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(flat.field(n).slice(i, len(blobs)) for n in names), pa.array(blobs, pa.binary())], names=[*names, "tokens"])


def _firsts(of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """By position, the first and last start of the windows of ``least`` in which it is its token's first occurrence."""
    at = np.arange(len(of))
    order = np.argsort(of, kind="stable")
    before = np.full(len(of), -1)
    again = np.flatnonzero(of[order][1:] == of[order][:-1])
    before[order[again + 1]] = order[again]
    return np.maximum(np.maximum(at - least, before) + 1, 0), np.minimum(at, len(of) - least)


def set_overlaps(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each offset of two sequences of one length: distinct tokens of the window of ``least`` of a, of b, and of both.

    A token is in the windows whose starts lie in disjoint spans, one for each of its occurrences; the overlap counts
    the starts at which a span of a meets one of b with the same token.
    """
    n = len(a)
    _, of = np.unique(np.concatenate((a, b)), return_inverse=True)

    def counted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        ok = low <= high
        return np.cumsum(np.bincount(low[ok], minlength=n + 1) - np.bincount(high[ok] + 1, minlength=n + 1))[: n - least + 1]

    sides = []
    for part in (of[:n], of[n:]):
        low, high = _firsts(part, least)
        ok = np.flatnonzero(low <= high)
        ok = ok[np.lexsort((ok, part[ok]))]
        sides.append((low[ok], high[ok], part[ok] * (n + 1)))
    (la, ha, ka), (lb, hb, kb) = sides
    first, last = np.searchsorted(kb + hb, ka + la), np.searchsorted(kb + lb, ka + ha, "right")
    times = np.maximum(last - first, 0)
    x = np.repeat(np.arange(len(la)), times)
    y = np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times) + first[x]
    return counted(la, ha), counted(lb, hb), counted(np.maximum(la[x], lb[y]), np.minimum(ha[x], hb[y]))


def _held(true: np.ndarray, least: int) -> np.ndarray:
    """How many of each run of ``least`` are true."""
    sums = np.zeros(len(true) + 1, np.int64)
    np.cumsum(true, out=sums[1:])
    return sums[least:] - sums[:-least]


def alike_spans(a: np.ndarray, b: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Merged spans [i, j) of the aligned sequences in which windows of ``least`` tokens are similar as sets, at any offset."""
    n = min(len(a), len(b))
    if n < least:
        return []
    same = _held(a[:n] == b[:n], least)
    good = same >= similarity * (2 * least - same)  # tokens equal in place are enough without a look at the sets
    if not good.all():
        x, y = np.sort(a[:n]), np.sort(b[:n])
        open_ = True
        if (x[1:] > x[:-1]).all() and (y[1:] > y[:-1]).all():  # without repeats a window shares at most those of its tokens that the other side has
            there = np.flatnonzero(~good)
            for side, other in ((a, y), (b, x)):
                at = np.minimum(np.searchsorted(other, side[:n]), n - 1)
                held = _held(other[at] == side[:n], least)[there]
                there = there[held >= similarity * (2 * least - held)]
            open_ = len(there) > 0
        if open_:
            own, other, both = set_overlaps(a[:n], b[:n], least)
            good |= both >= similarity * (own + other - both)
    step = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0]))))
    spans: list[tuple[int, int]] = []
    for i, j in zip(step[::2].tolist(), step[1::2].tolist(), strict=True):
        if spans and i <= spans[-1][1]:
            i = spans.pop()[0]
        spans.append((i, j - 1 + least))
    return spans


def _before(labels: np.ndarray) -> np.ndarray:
    """For each place of each row the column in which its label stood before, else -1."""
    order = np.argsort(labels, axis=1, kind="stable")
    sorted_ = np.take_along_axis(labels, order, 1)
    again = np.zeros_like(order) - 1
    again[:, 1:] = np.where(sorted_[:, 1:] == sorted_[:, :-1], order[:, :-1], -1)
    out = np.empty_like(order)
    np.put_along_axis(out, order, again, 1)
    return out


def _distinct(stood: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Distinct labels at counted places in each passage of each row, from where each stood before: a place is its label's first in the passages that begin behind the one before and hold it."""
    row, col = np.nonzero(counted)
    low = np.maximum(stood[row, col] + 1, np.maximum(col - LEAST + 1, 0))
    high = np.minimum(col, LEAST - 1) + 1
    use = low < high
    at, size = row[use] * (LEAST + 1), len(stood) * (LEAST + 1)
    steps = np.bincount(at + low[use], minlength=size) - np.bincount(at + high[use], minlength=size)
    return np.cumsum(steps.reshape(len(stood), LEAST + 1)[:, :LEAST], axis=1, dtype=np.int32)


def _sums(x: np.ndarray, axis: int) -> np.ndarray:
    """Sums of each LEAST neighbours of WIDE along an axis; all WIDE add up to less than 256."""
    total = np.cumsum(x, axis=axis, dtype=np.uint8)
    ends, starts = [slice(None)] * x.ndim, [slice(None)] * x.ndim
    ends[axis], starts[axis] = slice(LEAST - 1, None), slice(None, LEAST - 1)
    out = total[tuple(ends)].copy()
    ends[axis] = slice(1, None)
    out[tuple(ends)] -= total[tuple(starts)]
    return out


def _both(a: np.ndarray, b: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """[i, j, row]: distinct labels above 0 that passage i of a and passage j of b share, for rows of pairs; repeats: rows where a label stands twice in a side.

    Without repeats a label at u of a and v of b is shared by a rectangle of passages, those that hold u and v: its corners are counted, and summed up along both axes.
    """
    out = np.zeros((LEAST + 1, LEAST + 1, len(a)), np.int8)
    plain = np.flatnonzero(~repeats)
    if len(plain):
        same = (a[plain, :, None] == b[plain, None, :]) & (a[plain] > 0)[:, :, None]
        row, place = np.divmod(np.flatnonzero(same), WIDE * WIDE)
        u, v = np.divmod(place, WIDE)
        row = plain[row]
        (i, i_end), (j, j_end) = ((np.maximum(x - LEAST + 1, 0) * step, (np.minimum(x, LEAST - 1) + 1) * step) for x, step in ((u, (LEAST + 1) * len(a)), (v, len(a))))
        flat = out.reshape(-1)
        np.add.at(flat, np.concatenate((i + j, i_end + j_end)) + np.tile(row, 2), np.int8(1))
        np.subtract.at(flat, np.concatenate((i + j_end, i_end + j)) + np.tile(row, 2), np.int8(1))
        for x in range(1, LEAST):
            out[x] += out[x - 1]
        for x in range(1, LEAST):
            out[:, x] += out[:, x - 1]
    out = out[:LEAST, :LEAST]
    for row in np.flatnonzero(repeats).tolist():
        shared = np.intersect1d(a[row], b[row])
        shared = shared[shared > 0]
        x, y = (_sums((side[row][:, None] == shared[None, :]).astype(np.uint8), 0) > 0 for side in (a, b))
        out[:, :, row] = x.astype(np.float32) @ y.astype(np.float32).T
    return out


def _pairs(counts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(p, q), p <= q, of each two rows of one group, itself included, about ``most`` at once; rows of a group follow each other."""
    ends = np.repeat(np.cumsum(counts), counts)
    times = ends - np.arange(len(ends))
    upto, at = np.cumsum(times), 0
    while at < len(times):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        p = np.repeat(np.arange(at, to), times[at:to])
        yield p, p + np.arange(len(p)) - np.repeat(np.cumsum(times[at:to]) - times[at:to], times[at:to])
        at = to


def near_classes(tokens: list[bytes], before: np.ndarray, first: np.ndarray, last: np.ndarray, group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which classes of one text have passages near one of another text in a class of their group: row, first and last place (c is 0), another text; and links of texts, which join all that are near.

    first, last: the least and greatest id of a class; group: ascending; side: 0, or 1 and 2 for a group of which only different sides are compared.
    Two classes are not compared if they are joined by others and all of both is known to be repeated: no more can come of it.
    """
    m = len(tokens)
    sizes = np.array([len(t) // 4 for t in tokens])
    row = np.repeat(np.arange(m), sizes)
    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(LEAST - 1 - before, sizes)
    _, of = np.unique(np.frombuffer(b"".join(tokens), np.uint32) | (group[row].astype(np.uint64) << np.uint64(32)), return_inverse=True)
    # a token of one class alone is named by the place where it stands there first, as a negative label; 0 is no token
    order = np.argsort(of, kind="stable")  # rows and columns ascend in it
    heads = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
    alone = np.minimum.reduceat(row[order], heads) == np.maximum.reduceat(row[order], heads)
    labels, there = np.zeros((m, WIDE), np.int32), np.zeros((m, WIDE), bool)
    labels[row, col] = np.where(alone[of], -1 - col[order][heads][of], of + 1)
    there[row, col] = True
    valid = _sums(there, 1) == LEAST
    stood = _before(labels)
    size = _distinct(stood, there)
    # s shared tokens of sets of x and y are enough if s >= SIMILARITY (x + y - s); y is no less than the smallest set of the group
    smallest = np.minimum.reduceat(np.where(valid, size, WIDE).min(1), np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    smallest = smallest[np.cumsum(np.append(0, group[1:] != group[:-1]))]
    valid &= (1 + SIMILARITY) * _distinct(stood, labels > 0) >= SIMILARITY * (size + smallest[:, None]) - 1e-6
    open_ = np.flatnonzero(valid.any(1))
    none = (*(np.zeros(0, np.int64),) * 4, np.zeros((0, 2), np.int64))
    if len(open_) < 2:
        return none
    code = (tx.mix(labels[open_].astype(np.int64).view(np.uint64)) * tx.powers(tx.BASE, WIDE)).sum(1) + side[open_].astype(np.uint64)
    order = np.lexsort((code, group[open_]))
    open_, code = open_[order], code[order]
    heads = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (group[open_][1:] != group[open_][:-1])))
    members = np.diff(np.append(heads, len(open_)))
    pick = open_[heads]
    low_id, high_id = np.minimum.reduceat(first[open_], heads), np.maximum.reduceat(last[open_], heads)
    lab, ok, size, at_side = labels[pick], valid[pick], size[pick], side[pick]
    least = np.where(ok, size, WIDE).min(1)
    need = np.where(ok, ENOUGH[0] * size, 16000).astype(np.int16).T
    stood = stood[pick]
    known, repeats = (lab > 0) & (stood < 0), ((lab > 0) & (stood >= 0)).any(1)
    bits, at = np.zeros((len(pick), 1024), bool), np.nonzero(known)
    bits[at[0], lab[at] % 1024] = True
    spare = known.sum(1) - bits.sum(1)
    packed = np.packbits(bits, 1).view(np.uint64)
    found: list[tuple] = []
    links: list[tuple[int, int]] = []
    _, counts = np.unique(group[pick], return_counts=True)
    nth = np.arange(len(pick)) - np.repeat(np.cumsum(counts) - counts, counts)
    joined, linked = np.arange(len(pick)), members == 1
    alone = np.add.reduceat(first[open_] == last[open_], heads) > 0  # some member is of one text
    begin, end = ok.argmax(1), LEAST - 1 - ok[:, ::-1].argmax(1)
    low_of, high_of = np.full(len(pick), LEAST), np.full(len(pick), -1)
    done = ~alone

    def ids(k: int) -> list[int]:
        return first[open_[heads[k] : heads[k] + members[k]]].tolist()

    for p, q in _pairs(counts, 1 << 16):
        use = ((p < q) | (members[p] > 1)) & ((at_side[p] != at_side[q]) | (at_side[p] == 0)) & (np.minimum(low_id[p], low_id[q]) < np.maximum(high_id[p], high_id[q]))
        p, q = p[use], q[use]
        most = np.bitwise_count(packed[p] & packed[q]).sum(1) + np.minimum(spare[p], spare[q])  # as many shared tokens, or more
        use = np.flatnonzero((1 + SIMILARITY) * most >= SIMILARITY * (least[p] + least[q]) - 1e-6)
        use = use[np.argsort(nth[p[use]], kind="stable")]  # each group's first class with all, then its second
        p, q, at = p[use], q[use], 0
        while at < len(p):
            x, y = p[at : at + 8 * AT_ONCE], q[at : at + 8 * AT_ONCE]
            open_pairs = np.flatnonzero(~(done[x] & done[y] & linked[x] & linked[y] & (joined[x] == joined[y])))[:AT_ONCE]
            at += int(open_pairs[-1]) + 1 if len(open_pairs) == AT_ONCE else len(x)
            if not len(open_pairs):
                continue
            x, y = x[open_pairs], y[open_pairs]
            both = _both(lab[x], lab[y], repeats[x] | repeats[y])
            # both >= SIMILARITY * (x + y - both) in whole numbers; a passage that is none asks for more than there can be
            good = (ENOUGH[0] + ENOUGH[1]) * both.astype(np.int16) >= need[:, x][:, None, :] + need[:, y][None, :, :]
            near = np.flatnonzero(good.any((0, 1)))
            good, x, y = good[:, :, near].transpose(2, 0, 1), x[near], y[near]
            for mine, theirs, axis in ((x, y, 2), (y, x, 1)):
                spans = good.any(axis)
                low, high = spans.argmax(1), LEAST - 1 - spans[:, ::-1].argmax(1)
                told = np.flatnonzero(alone[mine])
                found.append((mine[told], theirs[told], low[told], high[told]))
                sure = (low_id[theirs] < high_id[theirs]) & ((mine != theirs) | ~alone[mine]) | (high_id[theirs] < low_id[mine]) | (low_id[theirs] > high_id[mine])  # another text for every member
                np.minimum.at(low_of, mine[sure], low[sure])
                np.maximum.at(high_of, mine[sure], high[sure])
            done |= (low_of <= begin) & (high_of >= end)
            for k in np.flatnonzero((joined[x] != joined[y]) | ~linked[x] | ~linked[y]).tolist():
                a, b = int(x[k]), int(y[k])
                if joined[a] != joined[b]:
                    joined[joined == joined[b]] = joined[a]
                    links.append((int(low_id[a]), int(low_id[b])))
                for own, to in ((a, b), (b, a)):
                    if not linked[own]:
                        links += [(i, int(low_id[to])) for i in ids(own)]
                        linked[own] = True
    if not found:
        return none
    links_ = np.array([(u, v) for u, v in links if u != v], np.int64).reshape(-1, 2)
    mine, theirs, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    at = np.repeat(np.arange(len(mine)), members[mine])
    rows = open_[np.arange(len(at)) - np.repeat(np.cumsum(members[mine]) - members[mine], members[mine]) + heads[mine][at]]
    other = np.where(low_id[theirs][at] != first[rows], low_id[theirs][at], high_id[theirs][at])
    told = (other != first[rows]) & (first[rows] == last[rows])
    rows, other, low, high = rows[told], other[told], low[at][told] - LEAST + 1, high[at][told]
    if not len(rows):
        return *none[:4], links_
    order = np.lexsort((other, rows))
    rows, other, low, high = rows[order], other[order], low[order], high[order]
    cut = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))  # all passages of a class hold c: their union is one span
    return rows[cut], np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), other[cut], links_


NEAR = "key long, content long, id long, n long, c int, other long, low int, high int"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of classes in order of (key, i, j) those with passages near another text: one row for each such class of one text, and links.

    Groups are compared many at once, about PART classes; one group has 2 PART or so.
    """

    def groups(t: pa.Table) -> np.ndarray:
        names = np.stack([t.column(n).to_numpy() for n in ("key", "i", "j")], 1)
        return np.cumsum(np.append(0, (names[1:] != names[:-1]).any(1)))

    def compared(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        col = lambda n: t.column(n).to_numpy()
        side = np.where(col("i") == col("j"), 0, np.where(col("part") == col("i"), 1, 2))
        row, low, high, other, links = near_classes(t.column("tokens").to_pylist(), col("before"), col("id"), col("last"), group, side)
        # a link has an empty span
        u, v = links[:, 0], links[:, 1]
        empty, one = np.zeros(len(u), np.int64), np.ones(len(u), np.int64)
        columns = zip((*(col(x)[row] for x in ("key", "content", "id", "n", "c")), other, low, high), (empty, empty, u, one, empty, v, empty, empty - SHINGLE), strict=True)
        names = [x.split() for x in NEAR.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int32 if kind == "int" else np.int64)) for c, (_, kind) in zip(columns, names, strict=True)], names=[x for x, _ in names])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PART:
            t = pa.Table.from_batches(held)
            group = groups(t)
            start = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if start:
                yield compared(t.slice(0, start), group[:start])
            held, n = t.slice(start).combine_chunks().to_batches(), n - start
    if n:
        t = pa.Table.from_batches(held)
        yield compared(t, groups(t))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            done: list[list[int]] = []
            for s in sorted((s["start"], s["stop"]) for s in spans):
                if done and s[0] <= done[-1][1]:
                    done[-1][1] = max(done[-1][1], s[1])
                else:
                    done.append([*s])
            out.append(done)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([[{"start": a, "stop": b} for a, b in x] for x in out], kind)], names=["id", "spans"])


SPAN = "id long, other long, start long, stop long"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of (id, other), merged, one a row."""
    for batch in batches:
        for done in _merged([batch.select(["id", "spans"])]):
            lists = done.column("spans")
            times = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            at, flat = np.repeat(np.arange(done.num_rows), times), lists.flatten()
            yield pa.RecordBatch.from_arrays([done.column("id").take(pa.array(at)), batch.column("other").take(pa.array(at)), flat.field("start"), flat.field("stop")], names=["id", "other", "start", "stop"])


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, other, start, stop): words start..stop of text id are in a passage near one of another text, as text other.

    Each such word is in a row; links join all texts with near passages, directly or through others (a row that says no more has start = stop).

    Null ids and texts of fewer than LEAST_WORDS words have none; of equal texts the one of least id stands for all.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("id").alias("id")).select("id").distinct()
    found = rows.mapInArrow(_windows, WINDOW).repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(repeated, WINDOW)
    salt = F.when(F.col("told") > 1, F.col("told") - 1).otherwise(0).cast("long")
    found = found.select(F.col("deal").bitwiseXOR(F.shiftleft(salt, SALT_AT)).alias("key"), "content", "id", "c", "before", "behind")
    found = table(found.join(own, "id", "left_semi"), "windows")
    dealt_ = found.repartition(n, "key", "content")
    classes = dealt_.groupBy("key", "content").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min(F.struct("id", "c", "before", "behind")).alias("p"), F.count("*").alias("n"))
    word = lambda c: F.col(c).cast("long")
    # windows of one content in several texts: all of it is repeated
    whole = dealt_.join(classes.where("first < last").select("key", "content", "first", "last"), ["key", "content"])
    whole = whole.select("id", F.when(F.col("id") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("other"), (word("c") - word("before")).alias("start"), (word("c") + word("behind") + SHINGLE).alias("stop"))
    whole = table(whole.groupBy("id", "other").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).mapInArrow(_joined, SPAN), "whole")
    # classes of one hash that differ are compared
    classes = table(classes.select("key", "content", "last", "n", "p.*"), "classes")
    keys = classes.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("m"), F.min("id").alias("x"), F.max("last").alias("y")).where("m > 1 and x < y").select("key", "parts")
    asked = classes.join(keys, "key").select("id", F.struct(*[x.split()[0] for x in CLASS.split(", ")]).alias("a"))
    many = asked.groupBy("id").agg(F.ceil(F.count("*") / ASKED_A_ROW).alias("rows"))
    asked = asked.join(many, "id").withColumn("row", F.pmod(F.xxhash64("a.key", "a.content"), "rows")).groupBy("id", "row").agg(F.collect_list("a").alias("asked"))  # a popular text's classes go to several rows
    shown = rows.dropDuplicates(["id"]).join(asked, "id").select("text", "asked").mapInArrow(_shown, SHOWN)
    shown = shown.withColumn("part", F.pmod(F.xxhash64("content"), "parts").cast("int"))
    shown = shown.withColumn("q", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("i", F.least("part", "q")).withColumn("j", F.greatest("part", "q")).drop("q", "parts")
    near = table(shown.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compared, NEAR), "near")
    once, more = near.where("n = 1"), near.where("n > 1").drop("c", "n")
    more = found.select("key", "content", "id", "c").join(more, ["key", "content", "id"])
    spans = once.select("id", "other", "c", "low", "high").unionByName(more.select("id", "other", "c", "low", "high"))
    return whole.unionByName(spans.select("id", "other", (word("c") + word("low")).alias("start"), (word("c") + word("high") + SHINGLE).alias("stop")))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_dup_words, n_spans, class_id, spans) for each row of ``docs``.

    spans: words in passages that are near one of another text; class_id: the least id that links reach.  A null id or text, or under LEAST_WORDS words: no spans, its own class.
    Rows that share an id are one text (any of them is read).  An empty table gives an empty result.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    signs = table(docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(text_col, 256).alias("sha"), words.alias("n_words")), "texts")
    near = near_passages(docs, id_col, text_col)
    long_ = signs.where((F.col("n_words") >= LEAST_WORDS) & F.col("id").isNotNull())
    firsts = long_.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("n_words").alias("w")).where("n > 1")
    copies = long_.join(firsts.select("sha", "first"), "sha").where("id <> first").select("id", "first", "n_words").distinct()
    zero = F.lit(0).cast("long")
    whole = copies.select("id", F.col("first").alias("other"), zero.alias("start"), F.col("n_words").alias("stop"))
    back = copies.groupBy(F.col("first").alias("id")).agg(F.max("n_words").alias("stop"), F.min("id").alias("other")).select("id", "other", zero.alias("start"), "stop")
    spans = near.unionByName(whole).unionByName(back)
    some = spans.where("start < stop").groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    some = some.mapInArrow(_merged, "id long, spans array<struct<start:long,stop:long>>")
    links = spans.where("id <> other").select(F.col("id").alias("u"), F.col("other").alias("v")).distinct()
    classes = connected_components(links)
    out = signs.join(some.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").join(classes, F.col("id") == F.col("node"), "left")
    total = F.aggregate("spans", zero, lambda s, x: s + x["stop"] - x["start"])
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce(total, zero).alias("n_dup_words"), F.coalesce(F.size("spans").cast("long"), zero).alias("n_spans"), F.coalesce("component", "id").alias("class_id"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"))
