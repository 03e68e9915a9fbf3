"""Remove byte strings that an earlier document holds, by a distributed merge of front-coded sorted suffix runs.

Every string of `length` bytes holds an anchor: the k bytes (k = length / 2 + 1) of least hash among its k-byte
strings, a choice that depends on the string alone. So equal strings have equal anchors at equal places, and
only the suffixes at anchors need sorting, with the bytes before them as far as a string can reach.

1. Parts of the corpus exchange the hashes of their anchors; an anchor goes on if two documents hold it.
2. Each part sorts the suffixes at its shared anchors once per distinct context (bytes after, then bytes before, nearest
   first), front-codes the run (length of the prefix shared with the suffix before, then the rest), and sends it
   to buckets by the hash of the first k bytes. A passage that is in every document is one suffix a part.
3. A bucket merges its runs by a loser tree that keeps, for each run's head, the length of the prefix it is known to share with the last
   winner, and never compares those bytes again. For a string that starts o bytes before its anchor, neighbours that share
   length - o bytes are a run of the merged order; in a run, strings are told apart by the o bytes before the anchor: by
   a hash of them, checked byte by byte. The smallest doc_id of each string is found.
4. Each part gets back, per suffix, the offsets at which a smaller doc_id has the string, and marks the bytes.

Order and ties: only a document with a smaller doc_id takes bytes; rows of one doc_id never take from each other.
A null doc_id neither takes nor gives. A null text is empty: 0 bytes, the hash of nothing. Texts shorter than
`length` are kept whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import cut, parts_for, text_bytes
from .parts import KEY_BITS, bucket_slices, gaps, packed, parted, squeeze, ungaps, unpacked, unsqueeze

NONE = np.int64(2**63 - 1)
SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 2**64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes, never 0; by doubling."""
    by_size = {1: _TABLE[data]}
    n = 1
    while 2 * n <= k:
        h = by_size[n]
        by_size[2 * n] = h[:-n] * _power(n) + h[n:] if len(h) > n else h[:0]
        n *= 2
    count = len(data) - k + 1
    h, at = by_size[n][:count].copy(), n
    while at < k:
        m = 1 << (k - at).bit_length() - 1
        h *= _power(m)
        h += by_size[m][at:at + count]
        at += m
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w neighbours."""
    n = 1
    while 2 * n <= w:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[:len(x) - (w - n)], x[w - n:]) if w > n else x


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in data, a run of texts that end at ends, and their keys."""
    w = length - k + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data, k)
    least = _sliding(h, w, np.minimum)  # by start of the string
    start = np.arange(len(least))
    least[start + length > np.repeat(ends, np.diff(ends, prepend=0))[:len(least)]] = 0
    padded = np.zeros(len(h) + w - 1, np.uint64)
    padded[w - 1:w - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(padded, w, np.maximum) == h)
    return at, h[at] >> np.uint64(64 - KEY_BITS)


def _runs(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(first text, texts, place of data's start in the first, data): about SLICE bytes each; a long text in overlapping pieces."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > 2 * SLICE:
            t = texts[i]
            for s in range(0, len(t), SLICE):
                yield i, 1, s, t[s:s + SLICE + length - 1]
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and len(texts[j]) <= 2 * SLICE and size < SLICE:
            size += len(texts[j])
            j += 1
        yield i, j - i, 0, b"".join(texts[i:j])
        i = j


def part_anchors(texts: list[bytes], skip: list[bool], length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the joined texts and keys of all anchors, each once."""
    offset = np.r_[0, np.cumsum([len(t) for t in texts])]
    places, keys = [], []
    for i, n, s, data in _runs(texts, length):
        ends = np.cumsum([len(t) for t in texts[i:i + n]]) if n > 1 or s == 0 and len(data) == len(texts[i]) else np.array([len(data)])
        at, key = anchors_of(np.frombuffer(data, np.uint8), ends, length, k)
        places.append(at + offset[i] + s)
        keys.append(key)
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    key = np.concatenate(keys)[first]
    if any(skip):
        bad = np.array(skip)[np.searchsorted(offset, place, "right") - 1]
        place, key = place[~bad], key[~bad]
    return place, key


def _owner(place: np.ndarray, texts: list[bytes]) -> np.ndarray:
    return np.searchsorted(np.cumsum([len(t) for t in texts]), place, "right")


def contexts(texts: list[bytes], place: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each place: bytes after it, how many, bytes before it (nearest first), how many; and the text of each."""
    before = length - k
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = _owner(place, texts)
    first = (np.cumsum(sizes) - sizes)[owner]
    n_after = np.minimum(length, first + sizes[owner] - place)
    n_before = np.minimum(before, place - first)
    m = np.zeros((len(place), length + 1 + before + 1), np.uint8)
    step = 1 << 16
    for i in range(0, len(place), step):
        p, s = place[i:i + step], slice(i, i + step)
        j = np.arange(length)
        m[s, :length] = np.where(j < n_after[s, None], data[np.minimum(p[:, None] + j, len(data) - 1)], 0)
        j = np.arange(1, before + 1)
        m[s, length + 1:-1] = np.where(j <= n_before[s, None], data[np.maximum(p[:, None] - j, 0)], 0)
    m[:, length], m[:, -1] = n_after, n_before
    return m, owner


def shared_prefix(m: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before."""
    if len(m) < 2:
        return np.zeros(len(m), np.uint8)
    same = m[1:] == m[:-1]
    return np.r_[0, np.where(same.all(1), m.shape[1], same.argmin(1))].astype(np.uint8)


def front_coded(m: np.ndarray) -> tuple[bytes, bytes]:
    lcp = shared_prefix(m)
    rest = m[np.arange(m.shape[1]) >= lcp[:, None]]
    return squeeze(lcp), squeeze(rest)


def decoded(lcp: bytes, rest: bytes, n: int, width: int) -> tuple[np.ndarray, list[bytes]]:
    """The run's shared prefixes and whole suffixes."""
    lcps = unsqueeze(lcp, "u1", n)
    sizes = (width - lcps.astype(np.int64))
    body = unsqueeze(rest, "u1", int(sizes.sum())).tobytes()
    out, last, at = [], b"", 0
    for h, s in zip(lcps.tolist(), sizes.tolist(), strict=True):
        last = last[:h] + body[at:at + s]
        at += s
        out.append(last)
    return lcps, out


def _first_difference(a: bytes, b: bytes, at: int) -> int:
    n = len(a)
    while at + 8 <= n and a[at:at + 8] == b[at:at + 8]:
        at += 8
    while at < n and a[at] == b[at]:
        at += 1
    return at


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index in it, bytes shared with the one before) in order of all suffixes; a loser tree on known shared prefixes."""
    k = 1 << max(1, len(runs) - 1).bit_length()
    nothing = -1  # shares less than any: a run that has ended loses to all
    heads: list[bytes | None] = [r[1][0] if i < len(runs) and r[1] else None for i, r in enumerate([*runs, *[([], [])] * (k - len(runs))])]
    known = [0 if h is not None else nothing for h in heads]
    index = [0] * k
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        ha, hb = known[a], known[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        if ha == nothing:
            return a, b
        x, y = heads[a], heads[b]
        at = _first_difference(x, y, ha)
        if at == len(x) or x[at] < y[at]:
            known[b] = at
            return a, b
        known[a] = at
        return b, a

    winners = [*([0] * k), *range(k)]
    for n in range(k - 1, 0, -1):
        winners[n], tree[n] = play(winners[2 * n], winners[2 * n + 1])
    best = winners[1]
    while heads[best] is not None:
        yield best, index[best], known[best]
        i = index[best] = index[best] + 1
        lcps, suffixes = runs[best]
        if i < len(suffixes):
            heads[best], known[best] = suffixes[i], lcps[i]
        else:
            heads[best], known[best] = None, nothing
        n = (best + k) >> 1
        while n:
            other = tree[n]
            if known[best] != known[other]:
                if known[other] > known[best]:
                    tree[n], best = best, other
            else:
                best, tree[n] = play(best, other)
            n >>= 1


def _told_apart(run: np.ndarray, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows in which equal (run, bytes before) are neighbours, and where each such group starts.

    The hash decides the order; a group whose bytes differ after all is ordered by the bytes themselves.
    """
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) ^ run.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(mixed, kind="stable")
    new = np.r_[True, mixed[order[1:]] != mixed[order[:-1]]]
    same = (run[order[1:]] == run[order[:-1]]) & (before[order[1:]] == before[order[:-1]]).all(1)
    if not (same | new[1:]).all():
        order = np.lexsort((*before.T, run))
        same = (run[order[1:]] == run[order[:-1]]) & (before[order[1:]] == before[order[:-1]]).all(1)
        new = np.r_[True, ~same]
    return order, np.flatnonzero(new)


def smallest_holders(m: np.ndarray, lcp: np.ndarray, least: np.ndarray, most: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each merged suffix and each offset of a string's start before it, the smallest doc_id that holds the string there.

    lcp, the bytes that each suffix shares with the one before, cuts the merged order into the runs of every offset.
    A suffix stands for documents from least to most, as a part sends copies once: alone in its run, it may still be held by several.
    """
    reach = length - k
    before = m[:, length + 1:-1]  # nearest first
    n_after, n_before = m[:, length].astype(int), m[:, -1].astype(int)
    h = np.zeros(len(m), np.uint64)
    out = np.full((reach + 1, len(m)), NONE)
    for o in range(reach + 1):
        if o:
            h = h * np.uint64(BASE) + _TABLE[before[:, o - 1]]
        run = np.cumsum(lcp < length - o)
        alone = np.bincount(run)[run] < 2
        whole = (n_before >= o) & (n_after >= length - o)
        copies = np.flatnonzero(whole & alone & (least < most))
        out[o, copies] = least[copies]
        ok = np.flatnonzero(whole & ~alone)
        if not len(ok):
            continue
        if o:
            order, start = _told_apart(run[ok], h[ok], before[ok, :o])
        else:  # the run is the string
            order, start = np.arange(len(ok)), np.flatnonzero(np.r_[True, np.diff(run[ok]) != 0])
        low = np.minimum.reduceat(least[ok][order], start)
        out[o, ok[order]] = np.repeat(low, np.diff(np.r_[start, len(ok)]))
    return out


RUN = "bucket long, part long, n long, lcp binary, rest binary, least binary, most binary"
BACK = "part long, kind int, bucket long, n long, a binary, b binary, check long"


def dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for each row of docs."""
    k = length // 2 + 1
    width = 2 * length - k + 2
    size = text_bytes(docs)
    buckets = parts_for(docs, size, 4)  # a bucket's suffixes are held as whole strings while they are merged
    texts = packed(parted(docs, size))

    def load(rows: pd.DataFrame):
        ids, own = unpacked(rows)
        place, key = part_anchors(own, [i is None for i in ids], length, k)
        return ids, own, place, key

    def send_keys(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, own, place, key = load(rows)
        doc = np.array([i or 0 for i in ids], np.int64)[_owner(place, own)] if len(place) else np.empty(0, np.int64)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
        last = np.r_[start[1:], len(key)] - 1
        several = (doc[start] != doc[last]) if len(key) else np.empty(0, bool)
        keys = key[start]
        out = [(b, part[0], j - i, gaps(keys[i:j]), squeeze(np.packbits(several[i:j]))) for b, i, j in bucket_slices(keys, buckets)]
        return pd.DataFrame(out, columns=["bucket", "part", "n", "keys", "several"])

    def find_shared(rows: pd.DataFrame) -> pd.DataFrame:
        ns = rows["n"].tolist()
        keys = np.concatenate([ungaps(x, n) for x, n in zip(rows["keys"], ns, strict=True)])
        several = np.concatenate([np.unpackbits(unsqueeze(x, "u1", -(-n // 8)), count=n) for x, n in zip(rows["several"], ns, strict=True)])
        _, where = np.unique(keys, return_inverse=True)
        shared = (np.bincount(where, 1.0 + several) >= 2)[where]
        ends = np.cumsum(ns).tolist()
        return pd.DataFrame({"part": rows["part"], "kind": 0, "bucket": rows["bucket"], "n": rows["n"], "a": [squeeze(np.packbits(shared[e - n:e])) for e, n in zip(ends, ns, strict=True)], "b": b"",
                             "check": [int(np.bitwise_xor.reduce(keys[e - n:e])) for e, n in zip(ends, ns, strict=True)]})

    def shared_rows(rows: pd.DataFrame, answers: pd.DataFrame):
        """ids, texts, and for each distinct context of a shared anchor: its row, bucket order and occurrences."""
        ids, own, place, key = load(rows)
        keys, where = np.unique(key, return_inverse=True)
        a = answers[answers["kind"] == 0].sort_values("bucket")
        ns = a["n"].tolist()
        if sum(ns) != len(keys) or (len(keys) and int(np.bitwise_xor.reduce(a["check"].to_numpy())) != int(np.bitwise_xor.reduce(keys))):
            raise RuntimeError("a part's documents changed between two reads")
        if not len(keys):
            return ids, own, None
        shared = np.concatenate([np.unpackbits(unsqueeze(x, "u1", -(-n // 8)), count=n) for x, n in zip(a["a"], ns, strict=True)]).astype(bool)
        on = shared[where]
        place, key = place[on], key[on]
        if not len(place):
            return ids, own, None
        m, owner = contexts(own, place, length, k)
        whole = np.ascontiguousarray(m).view(f"V{width}").ravel()
        _, first, which = np.unique(whole, return_index=True, return_inverse=True)
        doc = np.array([i or 0 for i in ids], np.int64)[owner]
        least, most = np.full(len(first), NONE), np.full(len(first), -NONE)
        np.minimum.at(least, which, doc)
        np.maximum.at(most, which, doc)
        bucket = (key[first].astype(float) * (buckets / 2.0**KEY_BITS)).astype(np.int64).clip(0, buckets - 1)
        return ids, own, (m[first], bucket, least, most, which, place, doc, owner)

    def send_runs(part: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        *_, found = shared_rows(rows, answers)
        out = []
        if found:
            m, bucket, least, most = found[:4]
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at = order[i:j]
                out.append((int(bucket[at[0]]), part[0], len(at), *front_coded(m[at]), squeeze(least[at]), squeeze(most[at])))
        return pd.DataFrame(out, columns=["bucket", "part", "n", "lcp", "rest", "least", "most"])

    def merge_runs(rows: pd.DataFrame) -> pd.DataFrame:
        ns = rows["n"].tolist()
        runs = []
        for n, lcp, rest in zip(ns, rows["lcp"], rows["rest"], strict=True):
            lcps, suffixes = decoded(lcp, rest, n, width)
            runs.append((lcps.tolist(), suffixes))
        least = np.concatenate([unsqueeze(x, "<i8", n) for x, n in zip(rows["least"], ns, strict=True)])
        most = np.concatenate([unsqueeze(x, "<i8", n) for x, n in zip(rows["most"], ns, strict=True)])
        starts = (np.cumsum(ns) - ns).tolist()

        def merged() -> Iterator[tuple[list[bytes], list[int], list[int]]]:
            """Suffixes in order, what each shares with the one before, and its place among all rows: groups whole, about 2^15 suffixes at a time."""
            own, lcp, at = [], [], []
            for r, i, h in merge(runs):
                if h < k and len(own) >= 32_768:
                    yield own, lcp, at
                    own, lcp, at = [], [], []
                own.append(runs[r][1][i])
                lcp.append(h)
                at.append(starts[r] + i)
            yield own, lcp, at

        found = []
        for own, lcp, at in merged():
            m = np.frombuffer(b"".join(own), np.uint8).reshape(len(own), width)
            at = np.array(at)
            holder = smallest_holders(m, np.array(lcp), least[at], most[at], length, k)
            who, off = np.nonzero((holder < most[at]).T)
            if not len(who):
                continue
            low = holder[off, who]
            first = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(off) != 1) | (np.diff(low) != 0)])
            last = np.r_[first[1:], len(who)] - 1
            found.append(np.stack([at[who[first]], off[first], off[last], low[first]]))
        seg = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
        seg = seg[:, np.argsort(seg[0], kind="stable")]
        cuts = np.searchsorted(seg[0], [*starts, sum(ns)]).tolist()
        out = []
        for r, (n, s, i, j) in enumerate(zip(ns, starts, cuts[:-1], cuts[1:], strict=True)):
            own = np.stack([seg[0, i:j] - s, *seg[1:, i:j]]).astype("<i8")
            out.append((rows["part"].iat[r], 1, rows["bucket"].iat[r], j - i, squeeze(own.ravel()), b"", n))
        return pd.DataFrame(out, columns=["part", "kind", "bucket", "n", "a", "b", "check"])

    def remove(part: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, own, found = shared_rows(rows, answers)
        sizes = np.array([len(t) for t in own], np.int64)
        starts = np.cumsum(sizes) - sizes
        change = np.zeros(int(sizes.sum()) + 1, np.int32)
        if found:
            m, bucket, _, _, which, place, doc, _ = found
            order = np.argsort(bucket, kind="stable")
            by_bucket = {int(bucket[order[i]]): order[i:j] for i, j in (lambda c: zip(c[:-1].tolist(), c[1:].tolist(), strict=True))(np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]))}
            by_context = np.argsort(which, kind="stable")
            n_of = np.bincount(which, minlength=len(m))
            first_of = np.cumsum(n_of) - n_of
            for b, n, a, sent in answers[answers["kind"] == 1][["bucket", "n", "a", "check"]].itertuples(index=False):
                own_rows = by_bucket[b]
                if len(own_rows) != sent:
                    raise RuntimeError("a part's documents changed between two reads")
                who, lo, hi, low = unsqueeze(a, "<i8", 4 * n).reshape(4, n)
                c = own_rows[who]
                times = n_of[c]
                seg = np.repeat(np.arange(n), times)
                nth = np.arange(len(seg)) - np.repeat(np.cumsum(times) - times, times)
                occ = by_context[first_of[c][seg] + nth]
                take = doc[occ] > low[seg]
                occ, seg = occ[take], seg[take]
                np.add.at(change, place[occ] - hi[seg], 1)
                np.add.at(change, place[occ] - lo[seg] + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for i, t, s, n in zip(ids, own, starts.tolist(), sizes.tolist(), strict=True):
            g = gone[s:s + n]
            kept = t if not g.any() else np.frombuffer(t, np.uint8)[~g].tobytes()
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            out.append((i, n, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        p = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        return p.assign(doc_id=pd.array(ids, "Int64"))

    by_part = texts.groupBy("part")
    keys = by_part.applyInPandas(send_keys, "bucket long, part long, n long, keys binary, several binary")
    shared = cut(keys.groupBy("bucket").applyInPandas(find_shared, BACK))
    runs = by_part.cogroup(shared.groupBy("part")).applyInPandas(send_runs, RUN)
    holders = cut(runs.groupBy("bucket").applyInPandas(merge_runs, BACK))
    return by_part.cogroup(shared.union(holders).groupBy("part")).applyInPandas(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
