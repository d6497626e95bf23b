"""Problem 7: texts into containers of fixed token capacity with little room left over.

Linear grouping scheme: large lengths are rounded up within groups of equal cardinality, an
optimal mix of configurations of the few rounded lengths is found (column generation over the
configuration programme), actual documents take the places of the rounded ones, and the small
documents fill what is left by best fit.

All planning works on the histogram of lengths, whose size is bounded by the capacity, never by
the number of documents: a plan is a list of segments that send runs of ranks in the order of
length to runs of containers. The cluster only computes the histogram and the ranks and looks
segments up."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotarium.llm.tokens import token_counts
from fotarium.operators.ranges import with_rank
from fotarium.session import materialize, only

GROUPS = 48
#: Most rows of the histograms of lengths that planning takes: the capacities in sum.
MOST_LENGTHS = 10_000_000
#: Lengths above this share of the capacity are large.
LARGE = 0.1
#: Rounds without progress, in numbers of lengths, after which the programme counts as solved.
STALLED = 20


def best_configuration(worth: np.ndarray, weight: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length to put into one container for the greatest worth."""
    layers = int(capacity // weight.min())
    best, takes = np.zeros(capacity + 1), []
    for _ in range(layers):
        new, take = best.copy(), np.full(capacity + 1, -1)
        for i in np.flatnonzero(worth > 1e-12):
            w = weight[i]
            value = best[: capacity + 1 - w] + worth[i]
            better = value > new[w:] + 1e-12
            new[w:][better], take[w:][better] = value[better], i
        takes.append(take)
        if not (take >= 0).any():
            break
        best = new
    counts, room = np.zeros(len(worth), np.int64), capacity
    for take in reversed(takes):
        if take[room] >= 0:
            counts[take[room]] += 1
            room -= weight[take[room]]
    return counts


def configurations(weight: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with how often each is used, which together hold at least the demand.

    The linear programme is solved by the simplex method with columns from best_configuration();
    its solution is rounded down and the few lengths left are packed first-fit decreasing."""
    k = len(weight)
    columns = np.diag(capacity // weight).astype(float)
    price = np.ones(k)
    amount = demand / np.diag(columns)
    least, since = np.inf, 0
    while since <= STALLED * k:  # until no column helps; a cycle of equally good bases ends too
        least, since = (price @ amount, 0) if price @ amount < least - 1e-9 else (least, since + 1)
        dual = np.linalg.solve(columns.T, price)
        if dual.min() < -1e-9:
            new, cost = np.zeros(k), 0.0
            new[dual.argmin()] = -1.0
        else:
            new, cost = best_configuration(dual, weight, capacity).astype(float), 1.0
            if new @ dual <= 1 + 1e-7:
                break
        step = np.linalg.solve(columns, new)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-10, np.maximum(amount, 0) / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out], price[out] = new, cost
        amount = np.linalg.solve(columns, demand.astype(float))
    used: dict[tuple[int, ...], int] = {}
    left = demand.astype(np.int64).copy()
    for j in np.argsort(-amount):
        whole = int(np.floor(amount[j] + 1e-9))
        if price[j] and whole > 0:
            column = columns[:, j].round().astype(np.int64)
            used[tuple(column)] = used.get(tuple(column), 0) + whole
            left -= column * whole
    bins: list[tuple[int, np.ndarray]] = []
    for i in np.argsort(-weight, kind="stable"):
        for _ in range(max(0, int(left[i]))):
            at = next((b for b, (room, _) in enumerate(bins) if room >= weight[i]), None)
            if at is None:
                bins.append((capacity, np.zeros(k, np.int64)))
                at = len(bins) - 1
            bins[at][1][i] += 1
            bins[at] = (bins[at][0] - int(weight[i]), bins[at][1])
    for _, column in bins:
        used[tuple(column)] = used.get(tuple(column), 0) + 1
    return [(np.array(c), n) for c, n in used.items()]


@dataclass
class Plan:
    """Segments: the item of rank r in `start[i] <= r < start[i + 1]` goes to container
    `first[i] + (r - start[i]) // each[i]`. Ranks follow falling length."""

    start: np.ndarray
    first: np.ndarray
    each: np.ndarray
    containers: int

    def container(self, rank: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.start, rank, "right") - 1
        return self.first[i] + (rank - self.start[i]) // self.each[i]


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE) -> Plan:
    """Where to put items of the given lengths (0 to capacity), from the histogram alone."""
    sizes = np.array(sorted((s for s, n in histogram.items() if n), reverse=True), np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], np.int64)
    ends = np.cumsum(counts) if len(sizes) else np.zeros(0, np.int64)
    segments: list[tuple[int, int, int]] = []
    containers = 0
    free: dict[int, list[tuple[int, int]]] = {}  # room -> runs of containers (first, number)
    rooms: list[int] = []

    def give(room: int, first: int, number: int) -> None:
        if number > 0:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, number))

    full = int(counts[0]) if len(sizes) and sizes[0] == capacity else 0
    if full:
        segments.append((0, 0, 1))
        containers = full
    n_large = int(ends[np.searchsorted(-sizes, -large * capacity, "left") - 1]) if (sizes > large * capacity).any() else 0
    if n_large > full:
        each = -(-(n_large - full) // groups)
        bounds = np.arange(full, n_large, each)
        weight = sizes[np.searchsorted(ends, bounds, "right")]
        demand = np.diff(np.append(bounds, n_large))
        weight, inverse = np.unique(weight, return_inverse=True)  # groups of one length are one
        weight, inverse = weight[::-1], len(weight) - 1 - inverse
        merged = np.bincount(inverse, weights=demand).astype(np.int64)
        cursor = full + np.concatenate([[0], np.cumsum(merged)[:-1]])
        limit = full + np.cumsum(merged)
        for column, number in configurations(weight, merged, capacity):
            cuts, parts = {0, number}, []
            for g in np.flatnonzero(column):
                for _ in range(int(column[g])):
                    take = min(number, int(limit[g] - cursor[g]))
                    if take > 0:
                        a = int(cursor[g])
                        segments.append((a, containers, 1))
                        parts.append((a, take))
                        inside = ends[(ends > a) & (ends < a + take)] - a
                        cuts.update(int(x) for x in inside)
                        cuts.add(take)
                        cursor[g] += take
            if not parts:
                continue
            edges = sorted(cuts)
            for lo, hi in zip(edges, edges[1:], strict=False):
                held = sum(int(sizes[np.searchsorted(ends, a + lo, "right")]) for a, take in parts if lo < take)
                give(capacity - held, containers + lo, hi - lo)
            containers += number
    done = n_large
    for s, n_all in zip(sizes, counts, strict=True):
        s, n = int(s), int(n_all)
        if s > large * capacity:
            continue
        if s == 0:
            containers = max(containers, 1)
            segments.append((done, 0, -(-n // containers)))
            done += n
            continue
        while n > 0:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                fits = capacity // s
                give(capacity, containers, -(-n // fits))
                containers += -(-n // fits)
                continue
            room = rooms[at]
            first, number = free[room].pop()
            if not free[room]:
                del free[room], rooms[at]
            fits = room // s
            whole = min(number, n // fits)
            if whole:
                segments.append((done, first, fits))
                give(room - fits * s, first, whole)
                done, n = done + whole * fits, n - whole * fits
            if n and whole < number:  # fewer than one container's worth is left
                segments.append((done, first + whole, n))
                give(room - n * s, first + whole, 1)
                done, n, whole = done + n, 0, whole + 1
            give(room, first + whole, number - whole)
    segments.sort()
    start, first, each = (np.array([x[i] for x in segments], np.int64) for i in range(3))
    return Plan(start, first, each, containers)


def pieces(sized: DataFrame, capacity: dict, pack_type: str, doc_id: str = "doc_id") -> DataFrame:
    """(pack_id, doc_id, part, token_start, n_tokens): every document for every pack, whole unless
    it alone exceeds the capacity; then in parts of the full capacity and a rest."""
    each = F.array(*[F.struct(F.lit(p).cast(pack_type).alias("pack_id"), F.lit(c).cast("bigint").alias("_cap")) for p, c in capacity.items()])
    rows = sized.select(F.col(doc_id).alias("doc_id"), F.col("n_tokens").alias("_n"), F.inline(each))
    last = F.greatest(F.lit(0), F.ceil(F.col("_n") / F.col("_cap")).cast("int") - 1)
    rows = rows.select("pack_id", "doc_id", "_n", "_cap", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    start = F.col("part").cast("bigint") * F.col("_cap")
    return rows.select("pack_id", "doc_id", "part", start.alias("token_start"), F.least(F.col("_n") - start, F.col("_cap")).alias("n_tokens"))


def pack(sized: DataFrame, packs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(pack_id, container, doc_id, part, token_start, n_tokens): a container for every piece.

    `sized` has one row per item with `n_tokens`; repeated rows are so many items, items of length
    0 (empty and null texts) are spread over the containers, a null id is an id. `packs` is a small
    table of pack_id and capacity_tokens (its size is a matter of configuration, not of data;
    more than 1000 rows are refused); packs without a positive capacity are left out. Empty
    tables give no rows. Containers are numbered from 0 in each pack."""
    sized, packs = only(sized, doc_id, "n_tokens"), only(packs, "pack_id", "capacity_tokens")
    known = packs.select("pack_id", "capacity_tokens").distinct().limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("more than 1000 pack sizes")
    capacity = {r["pack_id"]: int(r["capacity_tokens"]) for r in known if r["pack_id"] is not None and (r["capacity_tokens"] or 0) > 0}
    if len(capacity) < sum(1 for r in known if r["pack_id"] is not None and (r["capacity_tokens"] or 0) > 0):
        raise ValueError("a pack_id with several capacities")
    if sum(capacity.values()) > MOST_LENGTHS:
        raise ValueError(f"capacities of over {MOST_LENGTHS} tokens in all")
    kind = packs.schema["pack_id"].dataType.simpleString()
    cut = pieces(sized, capacity or {None: 1}, kind, doc_id)
    if not capacity:
        cut = cut.limit(0)
    # repeated ids, null ones too, are told apart by their place, so that they spread over partitions
    placed = cut.withColumns({"_less": -F.col("n_tokens"), "_place": F.monotonically_increasing_id()})
    ranked = with_rank(placed, ["_less", "doc_id", "part", "_place"], "pieces", "_rank", ["pack_id"]).drop("_less", "_place")
    histograms: dict = {p: {} for p in capacity}
    for r in cut.groupBy("pack_id", "n_tokens").count().collect():  # at most capacity + 1 rows a pack
        histograms[r["pack_id"]][r["n_tokens"]] = r["count"]
    plans = {p: plan(histograms[p], capacity[p]) for p in capacity}
    kind = {f.name: f.dataType.simpleString() for f in ranked.schema}
    columns = ["pack_id", "container", "doc_id", "part", "token_start", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, of = batch.column("_rank").to_numpy(zero_copy_only=False), batch.column("pack_id").to_numpy(zero_copy_only=False)
            container = np.zeros(batch.num_rows, np.int64)
            for p in np.unique(of):
                container[of == p] = plans[p].container(rank[of == p])
            yield pa.RecordBatch.from_arrays([pa.array(container) if c == "container" else batch.column(c) for c in columns], names=columns)

    return ranked.mapInArrow(run, ", ".join(f"{c} {'bigint' if c == 'container' else kind[c]}" for c in columns))


def pack_texts(documents: DataFrame, packs: DataFrame) -> DataFrame:
    """pack() for documents sized in tokens of the public vocabulary."""
    return pack(materialize(token_counts(documents), "token-counts"), packs)


def fill(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, pack_name, capacity_tokens, containers, least, tokens): containers used and the
    least number that could hold the tokens."""
    used = packed.groupBy("pack_id").agg((F.max("container") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    named = packs.select("pack_id", "pack_name", "capacity_tokens").distinct()
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("bigint")
    return used.join(F.broadcast(named), "pack_id").select("pack_id", "pack_name", "capacity_tokens", "containers", least.alias("least"), "tokens")
