import json
import random
import time
from datetime import datetime, timedelta
from difflib import SequenceMatcher
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from fotarium.functions import jsonfields
from fotarium.functions.jsonfields import assign, canonical, likeness, most_pairs, renames
from fotarium.operators.drift import field_changes, report_frames, report_runs, unified_reports

SCHEMA = "report_id bigint, dir string, generated_at timestamp, raw string, loaded_at timestamp, change string, DIR string"


def reports(spark, docs, folder="d"):
    at = datetime(2025, 1, 1)
    return spark.createDataFrame([(i + 1, folder, at + timedelta(hours=i), d if d is None or isinstance(d, str) else json.dumps(d), at, "x", "y") for i, d in enumerate(docs)], SCHEMA)


def changes(spark, docs):
    return sorted(tuple(r) for r in field_changes(reports(spark, docs)).collect())


def frame(name, **fields):
    return {"file": name, **fields}


def test_added_removed_retyped_renamed(spark):
    a = {"v": 1, "tags": {"x": "1"}, "old": "same", "results": [frame("f", n=1, g={"by": "m"}), frame("h", n=2)]}
    b = {"v": "1", "shoot_tags": {"x": "1"}, "fresh": "same", "results": [frame("h", m=2.0), frame("f", m=1, g={"by": "m", "k": [1]})]}
    assert changes(spark, [a, b]) == [
        (2, "added", "", "results[].g.k"), (2, "renamed", "old", "fresh"), (2, "renamed", "results[].n", "results[].m"), (2, "renamed", "tags", "shoot_tags"), (2, "retyped", "v", "v"),
    ]


def test_no_rename_without_common_values_or_of_other_types(spark):
    a, b = {"results": [frame("f", n=1)], "p": 1, "t": "1"}, {"results": [frame("g", m=1)], "q": 2, "u": 1}
    got = changes(spark, [a, b])
    assert {c for _, c, *_ in got} == {"added", "removed", "renamed"}
    assert [x for x in got if x[1] == "renamed"] == [(2, "renamed", "p", "u")]


def test_nothing_below_a_change_and_null_is_absent(spark):
    a = {"a": {"b": {"c": 1}}, "n": None, "keep": 1}
    assert changes(spark, [a, {"a": [1], "n": None, "keep": 1}]) == [(2, "retyped", "a", "a")]
    assert changes(spark, [a, {"a": None, "keep": 1, "n": 5}]) == [(2, "added", "", "n"), (2, "removed", "a", "")]


def test_torn_and_repeated_and_empty(spark):
    docs = [{"a": 1}, '{"a": 1, "b"', None, "", "[1]", {"a": 1, "b": 2}]
    df = reports(spark, docs)
    assert [tuple(r) for r in field_changes(df.union(df)).collect()] == [(6, "added", "", "b")]
    assert field_changes(df.limit(0)).collect() == []
    other = reports(spark, [{"z": 1}, {"z": 2}], None)
    assert field_changes(other).collect() == []


def test_matching_prefers_more_pairs_then_names():
    assert sorted(assign({(0, 0): 1.9, (0, 1): 1.1, (1, 0): 1.2}, 2, 2)) == [(0, 1), (1, 0)]
    assert assign({(0, 0): 1.2, (0, 1): 1.9}, 1, 2) == [(0, 1)]
    assert canonical({"b": 1, "a": None, "c": [True, 1]}) == canonical({"c": [True, 1.0], "b": 1.0})


def test_many_fields_and_a_hot_folder(spark):
    docs = [{**{f"k{i}": i for i in range(60)}, "results": [frame(f"f{j}", s=j) for j in range(300)], **({"extra": n} if n % 2 else {})} for n in range(40)]
    got = changes(spark, docs)
    assert len(got) == 39 and {c for _, c, *_ in got} == {"added", "removed"}


def test_one_table(spark):
    docs = [{"keep": 1, "results": [frame("f", n="1")]}, {"kept": 1, "results": [frame("f", n=1)]}, {"keep": 1, "results": [frame("f", n=1)]}, {"keep": 1, "results": [frame("f", n=1)]}]
    df = reports(spark, docs)
    rows = unified_reports(df, least=1).collect()
    assert {r["field"] for r in rows} == {"keep", "results[].file", "results[].n"}
    assert {r["type"] for r in rows if r["field"] == "results[].n"} == {"number"}


def test_one_table_by_default_takes_every_rename(spark):
    keep, kept, save = {"keep": 1}, {"kept": 1}, {"save": 1}
    fields = lambda docs: {r["field"] for r in unified_reports(reports(spark, docs)).collect()}
    assert fields([keep, kept]) == {"keep"}
    assert fields([{"a": 1, "t": {"x": 1}}, {"b": 1, "s": {"x": 1}}, {"b": 2, "s": {"x": 1, "n": 2}}, {"a": 2, "s": {"x": 1, "m": 2}}]) == {"a", "s.x", "s.m"}  # there and back, below a renamed object
    assert fields([save, save, keep, kept]) == {"save"}  # a chain whose ends were never compared
    two = reports(spark, [keep, keep, {"other": 5}], "d").union(reports(spark, [keep, kept], "e").withColumn("report_id", F.col("report_id") + 10))
    assert {r["field"] for r in unified_reports(two).collect()} == {"keep", "other"}  # in one folder only


def test_one_table_keeps_names_of_one_frame_apart(spark):
    docs = [{"w": 1}, {"h": 1}, {"w": 1, "h": 2}, {"width": 1, "h": 2}]
    rows = unified_reports(reports(spark, docs)).collect()
    assert sorted((r["report_id"], r["field"], r["value"]) for r in rows) == [(1, "w", "1.0"), (2, "h", "1.0"), (3, "h", "2.0"), (3, "w", "1.0"), (4, "h", "2.0"), (4, "w", "1.0")]


def test_many_renames_in_one_report_are_quick():
    side = lambda tag: [(f"results[].{tag}{i}", "number", {f: i * 7 + f for f in range(5)}) for i in range(5000)]
    began = time.perf_counter()
    assert dict(renames(side("old"), side("new"))) == {f"results[].old{i}": f"results[].new{i}" for i in range(5000)}
    assert time.perf_counter() - began < 2
    same = lambda tag: [(f"{tag}{i}", "boolean", {0: 1}) for i in range(300)]
    assert len(renames(same("a"), same("b")[:200])) == 200


def test_most_pairs_equals_the_matching():
    rnd = random.Random(3)
    for _ in range(60):
        n, m = rnd.randrange(1, 8), rnd.randrange(1, 8)
        near = {i: [j for j in range(m) if rnd.random() < 0.35] for i in range(n)}
        best = assign({(i, j): 1.0 for i in near for j in near[i]}, n, m)
        got = most_pairs(list(near), near, {i: f"k{i}" for i in range(n)}, {j: f"k{j}" for j in range(m)})
        assert len(got) == len(best) == len({j for _, j in got}) and all(j in near[i] for i, j in got)


def test_repeated_files_are_compared_one_by_one(spark):
    a, b = {"results": [frame("f", n=1), frame("f", n=2)]}, {"results": [frame("f", m=1), frame("f", m=3)]}
    assert {c for _, c, *_ in changes(spark, [a, b])} == {"added", "removed"}
    assert {c for _, c, *_ in changes(spark, [a, {"results": [frame("f", m=1), frame("f", m=2)]}])} == {"renamed"}


def test_runs_and_frames_as_typed_tables(spark):
    docs = [{"a": 1, "s": "x\"y", "results": [frame("f", n="1", g={"by": "m"}), frame("h", n=2)]}, {"b": 1, "s": 3, "flag": True, "results": [frame("f", n=1, k=["z"])]}, {"c": 1, "s": "t", "results": []}]
    docs = [{**docs[0], "flag": True}, docs[1], {**docs[2], "flag": "true"}]
    unified = unified_reports(reports(spark, docs))
    runs = {r["report_id"]: r.asDict() for r in report_runs(unified).collect()}
    assert [runs[i]["a"] for i in (1, 2, 3)] == [1.0, 1.0, 1.0] and "b" not in runs[1] and "c" not in runs[1]
    assert [runs[i]["s"] for i in (1, 2, 3)] == ['x"y', None, "t"] and runs[2]["rest"] == {"s number": "3.0"}
    assert [runs[i]["flag"] for i in (1, 2, 3)] == [True, True, True]
    frames = {(r["report_id"], r["frame"]): r.asDict() for r in report_frames(unified).collect()}
    assert {k: (r["n"], r["g_by"], r["k"]) for k, r in frames.items()} == {(1, "f"): (1.0, "m", None), (1, "h"): (2.0, None, None), (2, "f"): (1.0, None, '["z"]')}
    few = report_frames(unified, most=1).collect()
    assert sum(len(r["rest"]) for r in few) + sum(r[4] is not None for r in few) == unified.filter("frame <> ''").count()
    assert report_runs(unified.limit(0)).collect() == []


def words(rnd, n, size=8):
    return sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)) for _ in range(n)})


def test_renames_are_matched_in_one_way_at_any_number_of_fields():
    rnd = random.Random(7)
    for n in (3, 149, 150, 151, 152, 400):
        olds = words(rnd, n)
        side = lambda names: [(name, "boolean", {0: 1}) for name in sorted(names)]
        want = {name: f"new_{name}" for name in olds}
        assert dict(renames(side(olds), side(want.values()))) == want
        # more old than new fields, and fields of other values beside them
        few = dict(list(want.items())[: n * 2 // 3])
        other = [(f"other{i}", "number", {0: i + 2}) for i in range(40)]
        got = renames(sorted(side(olds) + other), sorted(side(few.values()) + [(f"{q}x", *rest) for q, *rest in other]))
        assert dict(got) == few | {q: f"{q}x" for q, *_ in other}


def test_many_equal_fields_of_a_report_keep_their_names_apart(spark):
    olds = words(random.Random(8), 160)
    got = changes(spark, [dict.fromkeys(olds, True), {f"new_{x}": True for x in olds}])
    assert got == [(2, "renamed", x, f"new_{x}") for x in olds]


def test_renames_equal_trying_all():
    rnd = random.Random(5)
    like = lambda p, q: round(SequenceMatcher(None, p, q, autojunk=False).ratio() * 10**9)
    for _ in range(300):
        letters = rnd.choice(["ab", "abcdef"])
        n, m = rnd.randrange(1, 5), rnd.randrange(1, 5)
        old, new = (sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 6))) for _ in range(k)}) for k in (n, m))
        near = {i: [j for j in range(len(new)) if rnd.random() < 0.6] for i in range(len(old))}
        best = None
        for to in permutations([*range(len(new)), *[len(new)] * len(old)], len(old)):
            pairs = [(i, j) for i, j in enumerate(to) if j < len(new)]
            if all(j in near[i] for i, j in pairs):
                key = (-len(pairs), -sum(like(old[i], new[j]) for i, j in pairs), to)
                best = key if best is None else min(best, key)
        got = dict(most_pairs(list(near), near, dict(enumerate(old)), dict(enumerate(new))))
        assert tuple(got.get(i, len(new)) for i in near) == best[2]


def test_likeness_equals_difflib(monkeypatch):
    rnd = random.Random(9)
    for cells in (1 << 20, 50):
        monkeypatch.setattr(jsonfields, "CELLS", cells)
        monkeypatch.setattr(jsonfields, "PAIRS", 30)
        text = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 25)))
        for letters in ("ab", "A\u00e9\u6f22\ud800\u0130", "abcdefghijklmnop"):
            old, new = [text(letters) for _ in range(15)], [text(letters) for _ in range(20)]
            near = [np.array(sorted(rnd.sample(range(20), rnd.randrange(21))), dtype=np.int32) for _ in old]
            want = [[round(SequenceMatcher(None, p.lower(), new[j].lower(), autojunk=False).ratio() * 10**9) for j in js] for p, js in zip(old, near, strict=True)]
            assert [x.tolist() for x in likeness(old, new, near)] == want
