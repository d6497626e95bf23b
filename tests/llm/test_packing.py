import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fotarium.llm.packing import configurations, fill, pack, plan


@given(st.integers(1, 60), st.dictionaries(st.integers(0, 60), st.integers(0, 200), max_size=40))
@settings(max_examples=150, deadline=None)
def test_plans_fit(capacity, histogram):
    histogram = {min(s, capacity): n for s, n in histogram.items()}
    items = np.array([s for s in sorted(histogram, reverse=True) for _ in range(histogram[s])], np.int64)
    p = plan(histogram, capacity)
    if len(items):
        used = np.bincount(p.container(np.arange(len(items))), weights=items, minlength=1)
        assert used.max() <= capacity and len(used) <= p.containers
        # any-fit bound: no better than half full only in one container
        assert p.containers <= 2 * -(-items.sum() // capacity) + 1 + 48


def test_little_room_is_left():
    rng = np.random.default_rng(1)
    sizes = np.minimum(512, rng.lognormal(4.5, 1.0, 20_000).astype(int) + 1)
    p = plan(dict(zip(*map(list, np.unique(sizes, return_counts=True)), strict=True)), 512)
    assert p.containers <= 1.01 * sizes.sum() / 512 + 2


def test_configurations_cover_demand():
    weight, demand = np.array([60, 45, 30, 14]), np.array([100, 200, 300, 57])
    held = sum(c * n for c, n in configurations(weight, demand, 100))
    assert (held >= demand).all()
    assert all(c @ weight <= 100 for c, _ in configurations(weight, demand, 100))


def test_rows(spark):
    sized = [(i, n) for i, n in enumerate([0, 0, 5, 10, 11, 25, 3, 7, 7, 10])] + [(3, 10), (None, 4)]
    docs = spark.createDataFrame([(i, n, "x", 1) for i, n in sized], "doc_id bigint, n_tokens bigint, container string, part int")
    packs = spark.createDataFrame([(1, "a", 10), (2, "b", 30), (3, "c", None), (None, "d", 5), (1, "a", 10)], "pack_id int, pack_name string, capacity_tokens int")
    rows = pack(docs, packs).collect()
    for p, cap in ((1, 10), (2, 30)):
        own = [r for r in rows if r["pack_id"] == p]
        used = {}
        for r in own:
            used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        assert max(used.values()) <= cap and sum(used.values()) == sum(n for _, n in sized)
        for r in own:
            assert r["part"] == r["token_start"] // cap and (r["part"] == 0 or r["doc_id"] in (4, 5))
        assert len([r for r in own if r["doc_id"] == 3]) == 2  # repeated rows are two items
    assert {r["pack_id"] for r in rows} == {1, 2}
    assert {r["pack_id"]: (r["containers"] >= r["least"]) for r in fill(pack(docs, packs), packs).collect()} == {1: True, 2: True}
    assert pack(docs.limit(0), packs).collect() == [] and pack(docs, packs.limit(0)).collect() == []
