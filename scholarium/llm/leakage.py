"""Evaluation passages that appear in the texts of a corpus: latent semantic retrieval, then alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.llm.lookalike import consistent_form
from scholarium.plans.lineage import cut

BLOCK = 25  #: words of a block; a passage is two neighbouring blocks, so any run of 25 words lies inside one passage
ITEMS_AT_ONCE = 192  #: items searched in one pass; more are searched in further passes
EXTRA = 32  #: dimensions of the latent space beyond the number of items
SEGMENT = 64  #: members of a group that are added up in one go
ROWS_AT_ONCE = 2048  #: groups that are added up side by side
BLOCKS_AT_ONCE = 8192  #: blocks projected at once, which bounds a worker's memory
DOCUMENTS_AT_ONCE = 500  #: documents searched at once
DIAGONALS_AT_ONCE = 2000  #: diagonals aligned at once

_WORD = re.compile(r"[^\W_]+")
_PLAIN = bytes(
    c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isalpha() else 32 for c in range(256)
)


def words_of(text: str) -> list[str]:
    """Words of the consistent form: runs of letters and digits."""
    return _WORD.findall(consistent_form(text))


class _Ids(dict):
    """UTF-8 words to vocabulary numbers: 0 for a word no item uses, below 0 an entry of ``many``."""

    LIMIT = 200_000

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.update((w.encode(), k) for w, k in self.vocabulary.items())
        self.many: list[list[int]] = []

    def __missing__(self, word: bytes) -> int:
        if word.isascii():
            return 0
        ids = [self.vocabulary.get(w, 0) for w in words_of(word.decode())]
        if len(ids) == 1:
            value = ids[0]
        else:
            self.many.append(ids)
            value = -len(self.many)
        self[word] = value
        return value

    def encode(self, text: str) -> np.ndarray:
        if len(self) > self.LIMIT + len(self.vocabulary):
            self.fresh()
        ids = np.array(list(map(self.__getitem__, text.encode("utf-8", "replace").translate(_PLAIN).split())), dtype=np.int32)
        if len(ids) and ids.min() < 0:
            ids = np.array([k for i in ids.tolist() for k in (self.many[-i - 1] if i < 0 else (i,))], dtype=np.int32)
        return ids


def _encoded(documents: DataFrame, key: str, text: str, vocabulary: dict[str, int]) -> DataFrame:
    kind = "<u2" if len(vocabulary) < 65_000 else "<i4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids(vocabulary)
        for batch in batches:
            done = [ids.encode(t).astype(kind).tobytes() for t in batch["_text"]]
            yield pd.DataFrame({"_key": batch["_key"], "_ids": done})

    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text IS NOT NULL AND _key IS NOT NULL")
    return rows.mapInPandas(run, f"_key {dict(documents.dtypes)[key]}, _ids binary")


def _blocks(raw: list[bytes], kind: str, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All word ids of a batch, the block each is in, and each document's first block (with the end at last).

    ``number`` gives the id of a stored word number in the present pass, 0 if no item of the pass uses the word.
    """
    arrays = [np.frombuffer(x, dtype=kind) for x in raw]
    sizes = np.array([len(a) for a in arrays], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-sizes // BLOCK)))])
    ids = number[np.concatenate(arrays)] if arrays else np.zeros(0, np.int32)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return ids, np.repeat(first[:-1], sizes) + place // BLOCK, first


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = reduce(np.add, (np.frombuffer(x, dtype="<f8") for x in pdf["_sum"]))
    return pd.DataFrame({"_group": [int(pdf["_group"].iloc[0])], "_sum": [total.tobytes()]})


def _summed(df: DataFrame, run, fan_in: int = 6) -> np.ndarray | None:
    """Sum of the equal-length float arrays that ``run`` yields, one a task, added up in a tree on the executors."""
    schema = "_group long, _sum binary"
    parts = df.mapInPandas(run, schema)
    width = max(1, df.rdd.getNumPartitions())
    while width > 1:
        width = -(-width // fan_in)
        parts = parts.withColumn("_group", F.col("_group") % width).groupBy("_group").applyInPandas(_add, schema)
    got = parts.collect()  # one array of bounded size
    return np.frombuffer(got[0]["_sum"], dtype="<f8") if got else None


def _task() -> int:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def _rows(ids: np.ndarray, group: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Per group the sum of its members' rows of ``basis``; ``group`` ascends.

    The j-th members of many groups are added at once, so that the working set stays in the cache; a
    group of more than SEGMENT members is summed in segments, and these in turn.
    """
    out = np.zeros((n, basis.shape[1]), dtype=np.float32)
    counts = np.bincount(group, minlength=n)
    starts = np.cumsum(counts) - counts
    if len(ids) and counts.max() > SEGMENT:
        pieces = -(-counts // SEGMENT)
        owner = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sizes = np.minimum(counts[owner] - nth * SEGMENT, SEGMENT)
        parts = _rows(ids, np.repeat(np.arange(len(owner)), sizes), len(owner), basis)
        return _rows(np.arange(len(owner)), owner, n, parts)
    order = np.argsort(-counts, kind="stable")
    for lo in range(0, n, ROWS_AT_ONCE):
        some = order[lo : lo + ROWS_AT_ONCE]
        size, at = counts[some], starts[some]
        if not size[0]:
            break
        total, one = np.zeros((len(some), basis.shape[1]), dtype=np.float32), np.empty((len(some), basis.shape[1]), dtype=np.float32)
        for j, k in enumerate(np.searchsorted(-size, -np.arange(size[0])).tolist()):  # the first k groups have a j-th member
            np.take(basis, ids[at[:k] + j], axis=0, out=one[:k], mode="clip")
            total[:k] += one[:k]
        out[some] = total
    return out


def _latent(encoded: DataFrame, kind: str, number: np.ndarray, items: list[np.ndarray], m: int, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(term weights, term rows of the latent space) from all blocks of the corpus and the items."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(m + 1)
        for batch in batches:
            ids, block, first = _blocks(list(batch["_ids"]), kind, number)
            total[0] += first[-1]
            block, ids, step = block[ids > 0], ids[ids > 0], max(1, 16_000_000 // (m + 1))
            for lo in range(0, int(first[-1]), step):
                a, b = np.searchsorted(block, [lo, lo + step])
                there = np.zeros((min(step, int(first[-1]) - lo), m + 1), dtype=bool)
                there[block[a:b] - lo, ids[a:b]] = True
                total += there.sum(axis=0)
        yield pd.DataFrame({"_group": [_task()], "_sum": [total.tobytes()]})

    df = _summed(encoded, count)
    if df is None or df[0] == 0:
        return None
    n = df[0]
    weight = np.maximum(np.log((n + 1) / (df + 1)), 0.05)
    silent = df > n / 3  # words of every third block and more tell little; an item with hardly any others keeps its own
    for own in map(np.unique, items):
        if (df[own] <= n / 3).sum() < min(8, len(own)):
            silent[own] = False
    weight[silent] = 0
    weight[0] = 0
    size = min(len(items) + EXTRA, m + 1)
    rng = np.random.default_rng(seed)
    omega = rng.standard_normal((m + 1, size))
    start = (omega * weight[:, None]).astype(np.float32)
    heavy = weight > 0

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, mass = np.zeros((m + 1, size)), 0.0
        for batch in batches:
            ids, block, first = _blocks(list(batch["_ids"]), kind, number)
            keep = heavy[ids]
            ids, block = ids[keep], block[keep]
            mass += float((weight[ids] ** 2).sum())
            for lo in range(0, int(first[-1]), BLOCKS_AT_ONCE):
                a, b = np.searchsorted(block, [lo, lo + BLOCKS_AT_ONCE])
                some, own = ids[a:b], block[a:b] - lo
                y = _rows(some, own, min(BLOCKS_AT_ONCE, int(first[-1]) - lo), start)
                order = np.argsort(some, kind="stable")
                total += _rows(own[order], some[order], m + 1, y)
        yield pd.DataFrame({"_group": [_task()], "_sum": [np.append(total.ravel(), mass).tobytes()]})

    got = _summed(encoded, sketch)
    gram, mass = got[:-1].reshape(m + 1, size) * weight[:, None], max(got[-1], 1e-9)
    exact = np.zeros((len(items), m + 1))
    for k, ids in enumerate(items):
        np.add.at(exact[k], ids, 1)
    exact *= weight
    image = gram / mass + exact.T @ (exact @ omega) / max((exact**2).sum(), 1e-9)
    # Randomised eigenvectors of the summed Gram matrix from one sketch (Nystroem form).
    core = omega.T @ image
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > 1e-10 * max(value[-1], 1e-30)
    basis = np.linalg.svd(image @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)[0]
    return weight, (basis * weight[:, None]).astype(np.float32)


def longest_run(item: np.ndarray, doc: np.ndarray, one_in: int, least: int = 2) -> tuple[int, int, int, int]:
    """(words, differences, start in item, start in doc) of the longest stretch of the item that stands in doc with at most one word in ``one_in`` replaced.

    Both are arrays of word numbers; 0 equals nothing. Stretches of fewer than ``least`` equal words are not looked for.
    """
    i, j = np.nonzero((item[:, None] == doc[None, :]) & (item[:, None] > 0))
    best = (0, 0, 0, 0)
    if not len(i):
        return best
    shift = j - i + len(item)
    counts = np.bincount(shift)
    for s in np.flatnonzero(counts >= least):
        if counts[s] <= best[0] * (one_in - 1) / one_in:
            continue
        at = i[shift == s]  # ascending item positions that match on this diagonal
        span = at[None, :] - at[:, None] + 1
        matches = np.arange(len(at))[None, :] - np.arange(len(at))[:, None] + 1
        wrong = span - matches
        ok = (span > 0) & (wrong * one_in <= span)
        if ok.any():
            k = int(np.where(ok, span, 0).argmax())
            if span.flat[k] > best[0]:
                first = int(at[k // len(at)])
                best = (int(span.flat[k]), int(wrong.flat[k]), first, first + int(s) - len(item))
    return best


def common_subsequence(item: np.ndarray, doc: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel); 0 equals nothing."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        if w:
            masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in doc.tolist():
        u = v & masks.get(w, 0)
        v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def _aligned(item: np.ndarray, doc: np.ndarray, one_in: int) -> tuple[int, int]:
    """As longest_run, where words may also be left out or put in (each counts as a difference)."""
    n = len(doc)
    score, back = [0] * (n + 1), []
    best, at = 0, (0, 0)
    d = doc.tolist()
    for i, w in enumerate(item.tolist(), 1):
        row, steps = [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            same = w and w == d[j - 1]
            value, step = score[j - 1] + (1 if same else -2), 1
            if score[j] - 2 > value:
                value, step = score[j] - 2, 2
            if row[j - 1] - 2 > value:
                value, step = row[j - 1] - 2, 3
            if value > 0:
                row[j], steps[j] = value, step
                if value > best:
                    best, at = value, (i, j)
        back.append(steps)
        score = row
    i, j = at
    path = []
    while i > 0 and j > 0 and (step := back[i - 1][j]):
        path.append((step != 3, step == 1 and item[i - 1] == doc[j - 1] and item[i - 1] > 0))
        i, j = (i - 1, j - 1) if step == 1 else (i - 1, j) if step == 2 else (i, j - 1)
    of_item = np.concatenate([[0], np.cumsum([a for a, _ in path])])
    wrong = np.concatenate([[0], np.cumsum([not b for _, b in path])])
    span, bad = of_item[None, :] - of_item[:, None], wrong[None, :] - wrong[:, None]
    ok = (span > 0) & (bad * one_in <= span) & (np.arange(len(of_item))[None, :] > np.arange(len(of_item))[:, None])
    if not ok.any():
        return 0, 0
    k = int(np.where(ok, span, 0).argmax())
    return int(span.flat[k]), int(bad.flat[k])


def sure_run(words: int, least: int, one_in: int) -> int:
    """Equal words in a row that each stretch of an item of ``words`` words has, if it spans ``least`` or more with at most one in ``one_in`` differing.

    Of a span with d differences at least span - d words are equal, in at most d + 1 unbroken runs.
    """
    return min(-(-(n - n // one_in) // (n // one_in + 1)) for n in range(min(least, words), words + 1))


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` neighbouring word numbers."""
    out = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    ids = ids.astype(np.uint64)
    for k in range(n):
        out = (out + ids[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _seeds(items: list[np.ndarray], run_words: int, one_in: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length of a sure run: (length, its hashes in order, the edges of each hash in what follows, item numbers, places in the items)."""
    by: dict[int, list[int]] = {}
    for k, item in enumerate(items):
        by.setdefault(sure_run(len(item), run_words, one_in), []).append(k)
    out = []
    for n, ks in by.items():
        grams = [_grams(items[k], n) for k in ks]
        h, who, at = np.concatenate(grams), np.repeat(ks, [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(h, kind="stable")
        values, edges = np.unique(h[order], return_index=True)
        out.append((n, values, np.append(edges, len(h)), who[order], at[order]))
    return out


def _seeded(ids: np.ndarray, block: np.ndarray, first: np.ndarray, seeds: list, tables: list[np.ndarray]) -> np.ndarray:
    """Rows (document, item, shift) of the diagonals on which a document shares a sure run with an item; shift is the place in ``ids`` less that in the item.

    A chance equal hash adds a diagonal, none is lost.
    """
    found = [np.zeros((0, 3), np.int64)]
    for (n, values, edges, who, where), table in zip(seeds, tables):
        h = _grams(ids, n)
        at = np.flatnonzero(table[h >> np.uint64(44)])
        place = np.minimum(np.searchsorted(values, h[at]), len(values) - 1)
        doc, last = (np.searchsorted(first, block[x], side="right") for x in (at, at + n - 1))
        keep = (values[place] == h[at]) & (doc == last)
        at, place, doc = at[keep], place[keep], doc[keep] - 1
        size = edges[place + 1] - edges[place]
        entry = np.repeat(edges[place], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        found.append(np.stack([np.repeat(doc, size), who[entry], np.repeat(at, size) - where[entry]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def least_score(words: int, least: int, one_in: int) -> int:
    """Alignment score (equal words less two for each difference) that every copied stretch of an item of ``words`` words reaches."""
    return min(n - 3 * (n // one_in) for n in range(min(least, words), words + 1))


def _band_scores(ids: np.ndarray, start: np.ndarray, diagonals: np.ndarray, items: list[np.ndarray], one_in: int) -> np.ndarray:
    """Best local alignment score around each diagonal, all diagonals at once.

    Words put in or left out move a stretch off its diagonal by one each, at most by one in ``one_in``
    words of the item, so a band of that width on both sides holds every copied stretch of the diagonal.
    """
    doc, k, shift = diagonals.T
    length = np.array([len(x) for x in items])[k]
    side = int(length.max()) // one_in
    rows, band = int(length.max()), 2 * side + 1
    of_item = np.full((len(items), rows), -1, dtype=np.int32)
    for i, x in enumerate(items):
        of_item[i, : len(x)] = x[:rows]
    of_item = of_item[k]
    at = shift[:, None] + np.arange(-side, rows + side)[None, :]
    inside = (at >= start[doc][:, None]) & (at < start[doc + 1][:, None])
    of_doc = np.where(inside, ids[np.clip(at, 0, max(len(ids) - 1, 0))], 0)
    of_doc[of_doc == 0] = -2  # no item's word, nor a place outside the document
    slope = 2 * np.arange(band, dtype=np.int32)
    score, best = np.zeros((len(doc), band + 1), dtype=np.int32), np.zeros(len(doc), dtype=np.int32)
    for i in range(rows):
        equal = of_doc[:, i : i + band] == of_item[:, i, None]
        step = np.maximum(score[:, :band] + np.where(equal, 1, -2), score[:, 1:] - 2)
        np.maximum(step, 0, out=step)
        step = np.maximum.accumulate(step + slope, axis=1) - slope
        score[:, :band] = step
        np.maximum(best, step.max(axis=1), out=best)
    return best


@dataclass
class _Queries:
    """What every task needs to know of the items of one pass; its size is bounded by ITEMS_AT_ONCE items."""

    names: list
    items: list[np.ndarray]
    weight: np.ndarray
    terms: np.ndarray

    def __post_init__(self) -> None:
        latent = np.stack([self.terms[ids].sum(axis=0) for ids in self.items])
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        #: the rarest words of an item stand for its answer
        self.answers = [np.unique(ids)[np.argsort(-self.weight[np.unique(ids)], kind="stable")][:8] for ids in self.items]
        self.telling = np.unique(np.concatenate(self.answers))


def _passages(ids: np.ndarray, block: np.ndarray, first: np.ndarray, q: _Queries) -> np.ndarray:
    """Latent cosine of every passage (a block and the next one of its document) with every item."""
    keep = q.weight[ids] > 0
    rows = _rows(ids[keep], block[keep], int(first[-1]), q.terms)
    pair = rows.copy()
    pair[:-1] += rows[1:]
    last = first[1:] - 1
    pair[last] = rows[last]  # a last block stands alone, so that no passage crosses documents
    pair /= np.maximum(np.linalg.norm(pair, axis=1, keepdims=True), 1e-12)
    return pair @ q.latent.T


def _stretches(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int]]:
    """Overlapping stretches joined; ``lo`` ascends."""
    a, b = int(lo[0]), int(hi[0])
    for x, y in zip(lo[1:].tolist(), hi[1:].tolist()):
        if x > b:
            yield a, b
            a = x
        b = max(b, y)
    yield a, b


def _copied(item: np.ndarray, own: np.ndarray, shifts: np.ndarray, run_words: int, one_in: int) -> tuple[int, int]:
    """(words, differences) of the longest copied stretch around the diagonals, where it is long enough; else (0, 0)."""
    need, best, margin = min(run_words, len(item)), (0, 0), len(item) // one_in
    for a, b in _stretches(np.maximum(shifts - margin, 0), np.minimum(shifts + len(item) + margin, len(own))):
        part = own[a:b]
        got = longest_run(item, part, one_in, need - need // one_in)[:2]
        if got[0] < need and common_subsequence(item, part) >= need - need // one_in:
            got = max(got, _aligned(item, part, one_in))
        best = max(best, got)
    return best if best[0] >= need else (0, 0)


def _search(encoded: DataFrame, kind: str, key: str, key_type: str, number: np.ndarray, queries: _Queries, least: float, run_words: int, one_in: int) -> DataFrame:
    seeds = _seeds(queries.items, run_words, one_in)
    scores = np.array([least_score(len(x), run_words, one_in) for x in queries.items])
    sent = encoded.sparkSession.sparkContext.broadcast((queries, seeds, number))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [np.zeros(1 << 20, dtype=bool) for _ in sent.value[1]]
        for (_, values, *_), table in zip(sent.value[1], tables):
            table[values >> np.uint64(44)] = True
        for batch in batches:
            for lo in range(0, len(batch), DOCUMENTS_AT_ONCE):
                yield search(batch.iloc[lo : lo + DOCUMENTS_AT_ONCE], tables)

    def search(batch: pd.DataFrame, tables: list[np.ndarray]) -> pd.DataFrame:
        q, seeds, number = sent.value
        ids, block, first = _blocks(list(batch["_ids"]), kind, number)
        start = np.searchsorted(block, first)  # first word of each document
        cosine = _passages(ids, block, first, q)
        copied: dict[tuple[int, int], tuple[int, int]] = {}
        diagonals = _seeded(ids, block, first, seeds, tables)
        for at in range(0, len(diagonals), DIAGONALS_AT_ONCE):
            some = diagonals[at : at + DIAGONALS_AT_ONCE]
            some = some[_band_scores(ids, start, some, q.items, one_in) >= scores[some[:, 1]]]
            for s in _groups(some[:, 0], some[:, 1]):
                d, item = some[s.start, :2].tolist()
                best = _copied(q.items[item], ids[start[d] : start[d + 1]], some[s, 2] - start[d], run_words, one_in)
                copied[d, item] = max(best, copied.get((d, item), (0, 0)))
        copied = {pair: best for pair, best in copied.items() if best[0]}
        reworded = {}
        for d, item, lo_b, hi_b in _answered(ids, block, first, cosine, least, q):
            own, words = ids[start[d] : start[d + 1]], q.items[item]
            part = own[lo_b * BLOCK : hi_b * BLOCK]
            of_item, of_part = (np.bincount(x, minlength=len(q.weight)) for x in (words, part))
            if np.minimum(of_item, of_part)[1:].sum() < 0.6 * len(words):  # a common subsequence is no longer than this
                continue
            share = float(np.isin(q.answers[item], part).mean())
            if (common := common_subsequence(words, part)) >= 0.6 * len(words):
                reworded[d, item] = max(reworded.get((d, item), (0, 0.0)), (common, share))
        out = []
        for d, item in sorted(copied.keys() | reworded.keys()):
            near = float(cosine[first[d] : first[d + 1], item].max())
            best = copied.get((d, item), (0, 0))
            common, share = reworded.get((d, item), (best[0] - best[1], None))
            out.append((batch["_key"].iloc[d], q.names[item], near, near >= least, best[0], best[1], common / len(q.items[item]), share, "copied" if best[0] else "reworded"))
        return pd.DataFrame(out, columns=["_key", "item_id", "cosine", "near", "run", "differing", "common", "answers", "kind"])

    return encoded.mapInPandas(run, f"_key {key_type}, {FOUND}").withColumnRenamed("_key", key)


#: what is told of a document and an item, besides the document's key
FOUND = "item_id bigint, cosine double, near boolean, run int, differing int, common double, answers double, kind string"


def _answered(ids: np.ndarray, block: np.ndarray, first: np.ndarray, cosine: np.ndarray, least: float, q: _Queries) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first block, end block), counted in the document, of candidate surroundings that hold three quarters of the item's answer."""
    b, k = np.nonzero(cosine >= least)
    if not len(b):
        return
    wide = np.array([-(-len(x) // BLOCK) for x in q.items])  # blocks on both sides, so that a whole item fits
    doc = np.searchsorted(first, b, side="right") - 1
    lo, hi = np.maximum(b - wide[k], first[doc]), np.minimum(b + 2 + wide[k], first[doc + 1])
    at = np.minimum(np.searchsorted(q.telling, ids), len(q.telling) - 1)
    hit = q.telling[at] == ids
    there = np.zeros((len(q.telling), int(first[-1]) + 1), dtype=np.int32)
    there[at[hit], block[hit] + 1] = 1
    so_far = np.cumsum(there, axis=1, out=there)
    count = np.zeros(len(b), dtype=np.int64)
    places = [np.searchsorted(q.telling, a) for a in q.answers]
    padded = np.zeros((len(places), max(map(len, places))), dtype=np.int64)
    valid = np.zeros(padded.shape, dtype=bool)
    for i, p in enumerate(places):
        padded[i, : len(p)], valid[i, : len(p)] = p, True
    for j in range(padded.shape[1]):
        word = padded[k, j]
        count += (so_far[word, hi] > so_far[word, lo]) & valid[k, j]
    keep = count >= 0.75 * valid.sum(axis=1)[k]
    lo, hi, k, doc = lo[keep], hi[keep], k[keep], doc[keep]
    order = np.lexsort((lo, k, doc))
    lo, hi, k, doc = lo[order], hi[order], k[order], doc[order]
    for s in _groups(doc, k):
        d = int(doc[s.start])
        for x, y in _stretches(lo[s] - first[d], hi[s] - first[d]):
            yield d, int(k[s.start]), x, y


def _groups(doc: np.ndarray, item: np.ndarray) -> Iterator[slice]:
    if len(doc):
        edges = [0, *np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1, len(doc)]
        yield from (slice(a, b) for a, b in zip(edges, edges[1:]))


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", least_cosine: float = 0.45, run_words: int = 25, one_in: int = 12, seed: int = 7) -> DataFrame:
    """(key, item_id, cosine, near, run, differing, common, answers, kind): documents that hold evaluation items.

    Texts are brought to their consistent form and cut into words; only words that some item uses can
    matter and get a number. All documents are encoded once (the encoding goes to the checkpoint
    folder) and counted in blocks of 25 words. The latent space comes from a distributed randomised
    decomposition of the TF-IDF blocks of the whole corpus together with the items, each side with the
    same total mass, so that the few items keep their own directions. Passages of two neighbouring
    blocks are candidates of an item from a cosine of ``least_cosine`` on (``near``).

    ``kind`` is "copied" if ``run_words`` consecutive words (or all of a shorter item) stand there with at
    most one in ``one_in`` differing. Each such stretch shares so many words in a row with the item
    (sure_run); places that share them are aligned with the item, whatever their cosine, so
    ``least_cosine`` loses no copy. ``kind`` is "reworded" if, around a candidate passage, the longest
    common subsequence covers 0.6 of the item and three quarters of its rarest words, which stand for its answer, are there.

    Items are a bounded query set (their words and names go to the driver and to every task); they are
    searched in passes of ITEMS_AT_ONCE over one encoding. Null or empty texts
    and items find nothing; repeated rows are found as often as they stand there; no row is left out
    for its length. Extra columns are ignored.
    """
    spark = documents.sparkSession
    key_type = dict(documents.dtypes)[key]
    wanted = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text")
    stated = [(r["item_id"], words) for r in wanted.toLocalIterator() if (words := words_of(r["text"]))]
    found = spark.createDataFrame([], f"{key} {key_type}, {FOUND}")
    if not stated:
        return found
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in stated for w in ws}), 1)}
    kind = "<u2" if len(vocabulary) < 65_000 else "<i4"
    encoded = cut(_encoded(documents, key, text, vocabulary))
    for at in range(0, len(stated), ITEMS_AT_ONCE):
        part = stated[at : at + ITEMS_AT_ONCE]
        used = np.unique([vocabulary[w] for _, ws in part for w in ws])
        number = np.zeros(len(vocabulary) + 1, dtype=np.int32)
        number[used] = np.arange(1, len(used) + 1)
        arrays = [number[[vocabulary[w] for w in ws]] for _, ws in part]
        space = _latent(encoded, kind, number, arrays, len(used), seed)
        if space is None:
            continue
        got = _search(encoded, kind, key, key_type, number, _Queries([n for n, _ in part], arrays, *space), least_cosine, run_words, one_in)
        found = got if at == 0 else found.union(got)
    return found


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents whose text holds the item or 25 consecutive words of it."""
    return leaks(documents, items).where("kind = 'copied'").select("doc_id", "item_id").distinct()
