import random

import pytest

from plumbline.operators import hierarchy as H
from plumbline.session import stage

SCHEMA = "id long, parent_id int, name string, created_at timestamp, root string, depth int, path string"


def rows(parents):
    return [(i, p, f"n{i}", None, "x", 1, "y") for i, p in parents.items()]


def brute(parents):
    """id -> (smallest id of the loop reached or None, chain from the node upwards)."""
    out = {}
    for v in parents:
        chain = [v]
        while (p := parents[chain[-1]]) in parents and p not in chain:
            chain.append(p)
        p = parents[chain[-1]]
        out[v] = min(chain[chain.index(p):]) if p in parents else None, chain
    return out


@pytest.fixture(params=["small blocks"])
def blocks(request, monkeypatch):
    if request.param == "small blocks":  # so that links leave blocks and tasks
        for name, bits in (("ID_BLOCK", 3), ("TASK_NODES", 4), ("SIBLING_BLOCK", 1), ("TOUR_BLOCK", 3)):
            monkeypatch.setattr(H, name, bits)


@pytest.mark.parametrize("seed,shape", [(1, "random"), (2, "chains"), (3, "forest")])
def test_against_brute_force(spark, blocks, seed, shape):
    rng = random.Random(seed)
    n = 80
    pick = {"random": lambda i: rng.randrange(n) * 3, "chains": lambda i: (i - 1) * 3 if i else None, "forest": lambda i: rng.randrange(i) * 3 if i and rng.random() < 0.9 else rng.choice([None, -1, 999])}[shape]
    parents = {i * 3: pick(i) for i in range(n)}
    t = stage(H.tour(spark.createDataFrame(rows(parents) * 2, SCHEMA)))
    got = {r["id"]: r for r in t.collect()}
    want = brute(parents)
    assert set(got) == set(parents)
    paths = {r["id"]: r for r in H.paths(t).collect()}
    for v, (cycle, chain) in want.items():
        assert got[v]["looped"] == (cycle is not None)
        assert got[v]["root"] == (chain[-1] if cycle is None else cycle)
        assert got[v]["broken"] == (parents[v] == 999)
        assert len(paths[v]["ancestors"]) == got[v]["depth"]
        if cycle is None:
            assert paths[v]["ancestors"] == chain[:0:-1]
            assert paths[v]["path"] == "/".join(f"n{c}" for c in chain[::-1])
    below = [a for p in paths.values() for a in p["ancestors"]]
    assert all(got[v]["descendants"] == below.count(v) for v in parents)
    wanted = spark.createDataFrame([(0,), (3,)], "id long")
    d = {(r["id"], r["descendant"], r["hops"]) for r in H.descendants(t, wanted).collect()}
    assert d == {(a, v, len(p["ancestors"]) - k) for v, p in paths.items() for k, a in enumerate(p["ancestors"]) if a in (0, 3)}


def test_loops_and_what_hangs_on_them(spark, blocks):
    parents = {1: 1, 2: 3, 3: 4, 4: 2, 5: 4, 6: 5, 7: -1, 8: 7}
    got = {tuple(r) for r in H.looped(spark.createDataFrame(rows(parents), SCHEMA)).collect()}
    assert got == {(1, 1), (2, 2), (2, 3), (2, 4), (2, 5), (2, 6)}


def test_hot_parent(spark, blocks):
    parents = {0: None} | {i: 0 for i in range(1, 400)}
    t = {r["id"]: r for r in H.tour(spark.createDataFrame(rows(parents), SCHEMA)).collect()}
    assert t[0]["descendants"] == 399 and (t[0]["entry"], t[0]["exit"]) == (0, 799)
    assert [t[i]["entry"] for i in range(1, 400)] == list(range(1, 799, 2))


def test_empty_null_and_odd_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.tour(empty).count() == 0 and H.looped(empty).count() == 0 and H.paths(H.tour(empty)).count() == 0
    df = spark.createDataFrame([(None, 1, "x", None, "", 0, ""), (1, None, "a/b\\c", None, "", 0, ""), (2, 1, None, None, "", 0, ""), (3, 77, "", None, "", 0, "")], SCHEMA)
    t = stage(H.tour(df))
    assert {r["id"]: (r["path"]) for r in H.paths(t).collect()} == {1: r"a\/b\\c", 2: r"a\/b\\c/", 3: ""}
    assert {r["id"]: r["broken"] for r in t.collect()} == {1: False, 2: False, 3: True}


def test_query_of_all_descendants(spark, tmp_path):
    from plumbline.plans.records import R

    parents = {0: None, 1: 0, 2: 1, 3: 1, 4: 6, 5: 4, 6: 5, 7: 99}
    spark.createDataFrame(rows(parents), SCHEMA).write.parquet(f"{tmp_path}/building_components.parquet")
    got = sorted(tuple(r) for r in R.queries["p1_descendants"](spark, str(tmp_path)).select("id", "descendant", "hops").collect())
    assert got[:6] == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (1, 2, 1), (1, 3, 1), (4, 5, 1)] and got[6:] == [(4, 6, 2), (5, 6, 1)]
