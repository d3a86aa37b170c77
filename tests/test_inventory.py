"""Name plans against moving the files one by one."""

import hashlib
import os
import random
from collections import defaultdict

import pytest

from spendframe.operators import inventory


def moved_one_by_one(files, existing=()):
    """Names given by moving first holders first, then the rest in the plan's order."""
    taken = set(existing)
    waiting, plan = [], {}
    groups = defaultdict(list)
    for folder, name, path in files:
        groups[folder, name].append((hashlib.md5(path.encode()).hexdigest()[:3], path))
    for (folder, name), members in groups.items():
        members.sort()
        if (folder, name) not in taken:
            plan[members.pop(0)[1]] = name
        waiting += [(folder, name, path) for _, path in members]
    taken |= {(folder, name) for folder, name in groups}
    for folder, name, path in waiting:
        base, ext = os.path.splitext(name)
        number = 1
        while (folder, f"{base}_{number}{ext}") in taken:
            number += 1
        plan[path] = f"{base}_{number}{ext}"
        taken.add((folder, plan[path]))
    return plan


def planned(spark, files, existing=None):
    df = spark.createDataFrame(files, "folder string, name string, path string")
    held = None if existing is None else spark.createDataFrame(existing, "folder string, name string")
    return {r["path"]: r["new_name"] for r in inventory.plan_names(df, existing=held).collect()}


def test_three_names(spark):
    files = [("f", "a.txt", "p1"), ("f", "a.txt", "p2"), ("f", "a_1.txt", "p3")]
    found = planned(spark, files)
    assert sorted(found.values()) == ["a.txt", "a_1.txt", "a_2.txt"] and found["p3"] == "a_1.txt"


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", [2, 1024])
def test_random_names(spark, monkeypatch, seed, block):
    monkeypatch.setattr(inventory, "NAME_BLOCK", block)
    generator = random.Random(seed)
    bases = ["a", "a_1", "a_1_1", "b", ".a", "a.b", "x_007", "x", "_1", ""]
    names = [b + s + e for b in bases for s in ("", "_1", "_2", "_3", "_5", "_12") for e in ("", ".txt", ".TXT")]
    names = [n for n in names if n]
    files = [("f" if i % 3 else None, "a.txt" if i % 4 == 0 else generator.choice(names), f"/p/{seed}/{i}")
             for i in range(600)]
    existing = [("f", generator.choice(names)) for _ in range(25)] + [(None, "a_4.txt"), ("g", "a.txt")]
    found = planned(spark, files, existing)
    assert found == moved_one_by_one(files, existing)
    targets = {(folder, found[path]) for folder, _, path in files}
    assert len(targets) == len(files) and not targets & set(existing)


def test_hot_name(spark):
    files = [("f", "r.md", f"/d{i}/r.md") for i in range(5000)] + [("f", f"r_{i}.md", f"/n/{i}") for i in range(1, 3000)]
    found = planned(spark, files)
    assert found == moved_one_by_one(files)


def test_organize_and_counts(spark):
    df = spark.createDataFrame([("/a/x.PNG",), ("/b/x.PNG",), ("/b/readme",)], "path string")
    plan = {r["path"]: (r["category"], r["new_name"]) for r in inventory.organize(df).collect()}
    assert sorted(plan[p] for p in ("/a/x.PNG", "/b/x.PNG")) == [("Images", "x.PNG"), ("Images", "x_1.PNG")]
    assert plan["/b/readme"] == ("Others", "readme")
    counts = inventory.category_counts(inventory.classify(df)).collect()
    assert {(r["category"], r["files"]) for r in counts} == {("Images", 2), ("Others", 1)}


def test_export_plan(spark):
    rows = [("/o/1", "converted_a.txt", 5), ("/o/2", "a.txt", 5), ("/o/3", "converted_b.txt", 0),
            ("/o/4", "converted_converted_c.txt", 1)]
    df = spark.createDataFrame(rows, "path string, name string, length bigint")
    held = spark.createDataFrame([("", "a.txt")], "folder string, name string")
    found = {r["path"]: r["new_name"] for r in inventory.export_plan(df, held).collect()}
    assert set(found) == {"/o/1", "/o/2", "/o/4"} and found["/o/4"] == "converted_c.txt"
    assert sorted([found["/o/1"], found["/o/2"]]) == ["a_1.txt", "a_2.txt"]


def test_latest_and_stale(spark):
    rows = [("f", "a", 1), ("f", "b", 3), ("f", "c", 3), (None, "d", 1), ("g", "e", 0)]
    df = spark.createDataFrame(rows, "folder string, path string, modified bigint")
    assert {(r["folder"], r["path"]) for r in inventory.latest(df).collect()} == {
        ("f", "c"), (None, "d"), ("g", "e")}
    stale = {r["path"]: r["stale"] for r in inventory.mark_stale(df).collect()}
    assert stale == {"a": True, "b": True, "c": False, "d": False, "e": False}


def test_suffix_filter(spark):
    df = spark.createDataFrame([("merged_a.PDF",), ("merged_a.txt",), ("x.pdf",)], "name string")
    assert [r["name"] for r in inventory.with_suffix(df, ".pdf", prefix="merged_").collect()] == ["merged_a.PDF"]
