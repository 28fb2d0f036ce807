import random
import re

import numpy as np
import pytest
import xxhash

from tablefit.llm import simhash
from tablefit.llm.components import _large_star, _small_star, _star_step, components
from tablefit.llm.simhash import simhash_groups


def plain_fingerprint(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints, bits=4):
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted(((doc, f"{fp:016x}", least.get(find(i))) for i, (doc, fp) in enumerate(prints)), key=repr)


def found(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = plain_groups([(i, plain_fingerprint(t)) for i, t in rows])
    assert found(simhash_groups(documents)) == expected
    assert any(doc != component for doc, _, component in expected)


def test_edge_cases(make_docs):
    rng = random.Random(1)
    long = " ".join("w%d" % rng.randrange(300) for _ in range(30000))
    rows = [(5, None), (2, ""), (9, " \t\n"), (3, "one Two"), (4, "ONE two"), (4, "one two"), (7, long),
            (8, long + " end"), (None, long), (6, "é x A"), (1, "a b c d"), (1, "a b c d e")]
    expected = plain_groups([(i, plain_fingerprint(t)) for i, t in rows])
    assert found(simhash_groups(make_docs(rows))) == expected
    assert found(simhash_groups(make_docs([]))) == []


@pytest.mark.parametrize("block", [4, 2048])
def test_links_of_crowded_keys(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 3)
    prints = {0}
    for c in centres:
        for _ in range(120):
            flips = rng.integers(0, 63, rng.integers(0, 6))
            prints.add(int(c) ^ int(sum(1 << int(b) for b in set(flips.tolist()))))
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 100)}
    prints = sorted(prints)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    rows = plain_groups([(p, p) for p in prints])
    assert {(p, got.get(p, p)) for p in prints} == {(p, root) for p, _, root in rows}
    assert links.count() < 40 * len(prints)


def test_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    links = spark.createDataFrame(chain + star, "a long, b long").repartition(5)
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(links.limit(0)).count() == 0


def test_no_table_is_broadcast(spark, make_docs):
    """Tables that grow with the input do not pass through the driver, even where Spark takes them for small."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    docs = make_docs([(i, f"text number {i // 2} of a few") for i in range(20)])
    try:
        spark.conf.set(limit, str(1 << 40))
        links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
        prints = spark.createDataFrame([(1,), (3,)], "fp long")
        groups = simhash_groups(docs)
        joined = [simhash.near_links(prints), _large_star(links), _small_star(links), groups, simhash.leave_one(docs, groups)]
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in joined]
        assert all("SortMergeJoin" in plan and "Broadcast" not in plan for plan in plans)
    finally:
        spark.conf.set(limit, before)
    assert simhash.leave_one(docs, groups).count() == groups.where("doc_id = component_id").count() == 10


@pytest.mark.parametrize("batch", [3, 10000])
def test_star_steps(spark, batch):
    """Each step gives the links of its definition, none without need twice in a node, by one shuffle and one sort."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    rng = random.Random(5)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(7, i) for i in range(100, 160)]
    links = spark.createDataFrame(pairs + pairs[:30], "a long, b long").repartition(3)
    try:
        spark.conf.set(size, str(batch))
        for large, defined in ((True, _large_star), (False, _small_star)):
            step = _star_step(links, large)
            plan = step._jdf.queryExecution().executedPlan().toString()
            assert not any(name in plan for name in ("Join", "Aggregate", "Broadcast"))
            assert plan.count("Exchange hashpartitioning") == 1
            got = [tuple(r) for r in step.collect()]
            assert set(got) == {tuple(r) for r in defined(links.where("a != b")).collect()}
            assert len(got) <= len(pairs) + 30
    finally:
        spark.conf.set(size, before)


def test_rounds_of_components_are_small(spark, monkeypatch):
    """A round writes one table whose plan holds two sorts and no hash map."""
    from tablefit.llm import components as module
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    kept = module.kept
    monkeypatch.setattr(module, "kept", noted)
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r.root for r in components(links).collect()} == {0}
    assert len(plans) > 2
    assert all(p.count("Sort [") == 2 and "Aggregate" not in p and "Join" not in p for p in plans[1:])
