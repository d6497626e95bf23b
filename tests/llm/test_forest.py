import random

import fotarium.llm.forest as F_
from fotarium.llm.forest import HashForest, admit_batches, camera_name, digest, records
from pyspark.sql import functions as F

NEW = "file_id bigint, size bigint, orig string, sha256 string, id string, SIZE string"
OLD = "entry_id bigint, size bigint, orig string, sha256 string, file_sha256 string, label string"


def h(x):
    return f"{x:064x}"


def test_names_and_digests(spark):
    names = ["L1234567.DNG", "Copy of L1234567.dng", "kopie von l1234567 (2) .dng", "L1234567 - Copie.DNG", "L1234567-copy2.DNG", "L1234567_copy.DNG", "L1234567~2.DNG", "L1234567 copy (1).dng"]
    odd = ["wedding-0012.dng", "", None, "L1234567", "L123456.DNG", "x" * 50_000, "L1234567 edit.DNG"]
    df = spark.createDataFrame([(n,) for n in names + odd], "n string")
    assert [r[0] for r in df.select(camera_name(F.col("n"))).collect()] == ["l1234567.dng"] * len(names) + [None] * len(odd)
    written = [h(11), h(11).upper(), "sha256:" + h(11), f"  {h(11)} ", "SHA256:" + h(11), "", " ", None, "xyz", h(11) + "0"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in written], "d string").select(digest(F.col("d"))).collect()]
    assert got == [h(11)] * 5 + [None] * 5


def brute(old, new):
    sizes = {}
    for r in [*old, *[(i, s, o, d, None) for i, s, o, d in new]]:
        for d in r[3:5]:
            if d:
                sizes.setdefault(d, set()).add(r[1])
    good = lambda d: d if d and len(sizes[d] - {None}) < 2 else None
    accepted = [(i, s, o, good(a), good(b)) for i, s, o, a, b in old]
    found = set()
    for i, s, o, d in sorted(new):
        d = good(d)
        same = [j for j, t, p, a, b in accepted if (d and d in (a, b)) or ((d is None or a is None) and s is not None and s == t and o is not None and o.lower() == p.lower())]
        if same:
            found.add((min(same), i))
        else:
            accepted.append((i, s, o, d, None))
    return found


def case(rnd, n):
    name = lambda: f"L{rnd.randrange(12):07d}.DNG"
    old = [(i, rnd.randrange(3), name(), rnd.choice([None, h(rnd.randrange(1, 40))]), rnd.choice([None, None, h(rnd.randrange(1, 40))])) for i in range(n)]
    new = [(1000 + i, rnd.choice([None, 0, 1, 2, 2]), name(), rnd.choice([None, h(rnd.randrange(1, 90))])) for i in range(2 * n)]
    # most digests belong to one size
    fix = lambda d, s: d if d is None or int(d, 16) % 7 == 0 else h(int(d, 16) * 3 + (s or 0) + 1000)
    return [(i, s, o, fix(a, s), fix(b, s)) for i, s, o, a, b in old], [(i, s, o, fix(d, s)) for i, s, o, d in new]


def of(spark, old, new):
    a = records(spark.createDataFrame([(*r, "x") for r in old], OLD), "entry_id", True)
    b = records(spark.createDataFrame([(*r, "x", "y") for r in new], NEW), "file_id", False)
    return a, b


def test_equals_brute_force_in_one_batch(spark):
    rnd = random.Random(5)
    for n in (6, 25):
        old, new = case(rnd, n)
        a, b = of(spark, old, [*new, *new[:5]])
        found, _ = HashForest.of(a).admit(b)
        assert {tuple(r) for r in found.collect()} == brute(old, new)


def test_batches_add_up_and_runs_merge(spark):
    rnd = random.Random(8)
    old, new = case(rnd, 10)
    # digests of the batches have one size here: a placeholder is only known once two sizes were seen
    old = [(i, s, o, None, None) for i, s, o, _, _ in old]
    new = [(i, s, o, None if d is None else h(int(d, 16) * 10 + (s or 9))) for i, s, o, d in new if s is not None]
    forest, got = HashForest.of(of(spark, old, new)[0]), set()
    for k in range(0, len(new), 4):
        found, forest = forest.admit(of(spark, old, sorted(new)[k : k + 4])[1])
        got |= {tuple(r) for r in found.collect()}
    assert got == brute(old, new)
    assert len({f.run for f in forest.files if f.run}) <= 8
    again = HashForest.load(spark, forest.path)
    assert again.version == forest.version and set(again.files) == set(forest.files)
    repeated = again.admit(of(spark, old, [(9000 + i, s, o, d) for i, s, o, d in new])[1])[0]
    known = lambda s, o, d: d is not None or o is not None
    assert {r["new_id"] for r in repeated.collect()} == {9000 + i for i, s, o, d in new if known(s, o, d)}


def test_hot_copies_and_empty(spark):
    new = [(1000 + i, 7, "L0000001.DNG", h(5)) for i in range(400)] + [(3000 + i, 7, "L0000001.DNG", None) for i in range(400)]
    a, b = of(spark, [], new)
    found = {tuple(r) for r in HashForest.of(a).admit(b)[0].collect()}
    assert found == {(1000, i) for i, *_ in new[1:]}
    a, b = of(spark, [(1, 7, None, None, None)], [])
    assert HashForest.of(a).admit(b)[0].collect() == []


def test_only_touched_files_are_read_and_recall_is_measured(spark, monkeypatch):
    monkeypatch.setattr(F_, "ROWS_A_FILE", 500)
    read = []
    for n in (2000, 20_000):
        old = [(i, i % 9, f"L{i:07d}.DNG", h(i * 2**200 + i), None) for i in range(n)]
        new = [(10**6 + k, (k * 97) % 9, f"L{k * 97:07d}.DNG", None if k == 3 else h(k * 97 * 2**200 + k * 97)) for k in range(5)] + [(10**6 + 9, 1, "L9999999.DNG", h(5))]
        a, b = of(spark, old, new)
        found, forest = HashForest.of(a).admit(b)
        assert {tuple(r) for r in found.collect()} == brute(old, new) and found.count() == 5
        read.append(max(rows for _, _, rows in forest.read))
        assert all(files <= 6 for _, files, _ in forest.read)
        # the same digest under another name and size is only met when the range is widened
        assert forest.measured["content"][16] == 1.0 and forest.measured["name"][16] == 1.0
    assert read[1] < 3 * read[0] < 20_000


def test_widening_to_a_target(spark):
    old = [(i, 5, f"L{i:07d}.DNG", h(i + 1), None) for i in range(400)]
    same = [(1000 + i, 5, f"L{i:07d}.DNG", h(i + 1)) for i in range(0, 380)]
    renamed = [(2000 + i, 5, f"R{i:07d}.DNG", h(i + 1)) for i in range(380, 400)]
    a, b = of(spark, old, same + renamed)
    forest = HashForest.of(a)
    found, after = forest.admit(b, target=0.9)
    assert 0.9 <= after.measured["content"][32] < 0.99 and after.measured["content"][16] == 1.0 and found.count() == 380
    found, after = forest.admit(b, target=0.99)
    assert found.count() == 400
    # probes in blocks give what one by one they give
    one = forest.admit(b)[0]
    blocks, _ = admit_batches(forest, b, [1000, 1100, 1350, 2000, 2390])
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in blocks.collect()}
