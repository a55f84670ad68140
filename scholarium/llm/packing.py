"""Filling fixed-capacity containers with texts measured in tokens."""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pre-tokenising pattern that belongs to the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): tokens of each whole text; null and empty texts have 0.

    ``vocabulary`` is a file of byte-level BPE ranks that every executor can read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["_text"]]
            yield pd.DataFrame({"_key": batch["_key"], "n_tokens": n})

    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInPandas(run, f"_key {dict(documents.dtypes)[key]}, n_tokens long").withColumnRenamed("_key", key)


def pack_shard(sizes: list[int], capacity: int, linear: float = 1.0, quadratic: float | None = None) -> list[int]:
    """Container of each item, for items in descending order of size, none above the capacity.

    The cost of a sequence is linear * tokens + quadratic * sum of squared lengths. Each item goes to
    the lowest-cost sequence that has room; as many sequences as the tokens need at least are open from
    the start, and one more is opened when none has room.
    """
    quadratic = 1.0 / capacity if quadratic is None else quadratic
    need = -(-sum(sizes) // capacity)
    heap = [(0.0, k, capacity) for k in range(need)]
    out = []
    for size in sizes:
        passed = []
        while heap and heap[0][2] < size:
            passed.append(heapq.heappop(heap))
        if heap:
            cost, k, room = heapq.heappop(heap)
        else:
            cost, k, room = 0.0, need, capacity
            need += 1
        heapq.heappush(heap, (cost + linear * size + quadratic * size * size, k, room - size))
        for x in passed:
            heapq.heappush(heap, x)
        out.append(k)
    return out


def _settle(sizes: list[int], where: list[int], capacity: int, full: float = 0.99) -> list[int]:
    """Pack the texts of all sequences filled below ``full`` anew by best fit, if that takes fewer sequences."""
    load: dict[int, int] = {}
    for size, k in zip(sizes, where):
        load[k] = load.get(k, 0) + size
    loose = {k for k, n in load.items() if n < full * capacity}
    names, rooms, out, opened = sorted(loose), [], list(where), 0
    for i, k in enumerate(where):  # descending sizes
        if k not in loose:
            continue
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, o = rooms.pop(at)
        else:
            if opened == len(names):
                return where
            room, o = capacity, names[opened]
            opened += 1
        out[i] = o
        bisect.insort(rooms, (room - sizes[i], o))
    return out if opened < len(names) else where


def pack(documents: DataFrame, budgets: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, per_shard: int = 4000, linear: float = 1.0, quadratic: float | None = None) -> DataFrame:
    """(budget_id, container, key, piece, first_token, n_tokens): every text in containers of every capacity.

    Texts are measured once with a public tokenizer. A text longer than the capacity is divided: pieces
    of exactly the capacity fill containers of their own and the rest is packed like any text; nothing
    else is divided. Texts are dealt by a hash of the key into shards of about ``per_shard`` and each
    shard is packed on its own, so no task grows with the collection and a shard leaves at most a few
    containers partly empty. Within a shard: descending lengths to the lowest-cost sequence with room,
    then the texts of sequences filled below 99 % are packed anew by best fit where that saves some.

    A text without tokens has one row with a null container. Budgets with a null or non-positive
    capacity are ignored. Repeated keys are packed as often as they stand in the table. ``container`` is
    unique within a budget. Ties in length go by key. An empty table gives no rows.
    """
    kind = dict(documents.dtypes)[key]
    counts = token_counts(documents, key, text, vocabulary)
    n = documents.count()
    shards = max(1, -(-n // per_shard))
    capacities = budgets.where("capacity_tokens > 0 AND budget_id IS NOT NULL").select("budget_id", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    sharded = counts.select(F.col(key).alias("_key"), "n_tokens", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"))
    limits = sorted((r["budget_id"], r["capacity"]) for r in capacities.collect())  # a stated list of budgets, a few rows

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys, sizes = pdf["_key"].tolist(), pdf["n_tokens"].tolist()
        order = sorted(range(len(keys)), key=lambda i: (str(type(keys[i])), keys[i]) if keys[i] is not None else ("", 0))
        out = []
        for budget, capacity in limits:
            rest, full = [], 0
            for i in order:
                whole, left = divmod(sizes[i], capacity)
                for p in range(whole):
                    out.append((budget, (shard << 32) + (1 << 31) + full, keys[i], p + 1, p * capacity, capacity))
                    full += 1
                if left:
                    rest.append((left, i, whole))
                elif not whole:
                    out.append((budget, None, keys[i], 1, 0, 0))
            rest.sort(key=lambda x: -x[0])
            lengths = [x[0] for x in rest]
            where = _settle(lengths, pack_shard(lengths, capacity, linear, quadratic), capacity)
            for (left, i, whole), k in zip(rest, where):
                out.append((budget, (shard << 32) + k, keys[i], whole + 1, whole * capacity, left))
        frame = pd.DataFrame(out, columns=["budget_id", "container", "_key", "piece", "first_token", "n_tokens"])
        frame["container"] = frame["container"].astype("Int64")
        return frame

    schema = f"budget_id long, container long, _key {kind}, piece int, first_token long, n_tokens long"
    spread = sharded.repartition(min(shards, 10_000), "shard")  # stated, so that small rows are not gathered in few tasks
    return spread.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("_key", key)


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, containers, tokens, fill, least, cost_mean, cost_spread), one row a budget that took a container.

    ``fill`` is the used share of all room; ``least`` the containers that the tokens need at least; the cost of
    a container is its tokens plus the sum of squared lengths over the capacity, as in ``pack_shard``, and
    ``cost_spread`` is the standard deviation of the costs over their mean.
    """
    sizes = budgets.where("capacity_tokens > 0").groupBy("budget_id").agg(F.max("capacity_tokens").alias("c"))  # a stated list, a few rows
    used = packed.where("container IS NOT NULL").join(F.broadcast(sizes), "budget_id")
    n = F.col("n_tokens").cast("double")
    each = used.groupBy("budget_id", "c", "container").agg(F.sum("n_tokens").alias("n"), F.sum(n + n * n / F.col("c")).alias("cost"))
    return each.groupBy("budget_id", "c").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.avg("cost").alias("cost_mean"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread")).select(
        "budget_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("c"))).alias("fill"), F.ceil(F.col("tokens") / F.col("c")).alias("least"), "cost_mean", "cost_spread"
    )
