"""The mix next to a plain program."""

import math

import duckdb

import brute
from sessionlake.llm import mixing


def filled(sizes):
    """Targets by raising the level step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in stopped]
        if not open_:
            return {s: 3.0 * sizes[s] for s in order}
        level = (total - sum(3 * sizes[s] for s in stopped)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in stopped else weight[s] * level for s in order}
        stopped |= over


def test_targets_and_words_taken(spark):
    for shape in ([40, 40, 40, 40], [300, 5, 5, 60, 5], [3, 400, 3]):
        rows = [(1000 * s + d, "w " * (d % 7 + 1), f"s{s}") for s, n in enumerate(shape) for d in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        sized = mixing.sizes(docs)
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t))
        want = filled(sizes)
        got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
        assert all(math.isclose(got[s], want[s], rel_tol=1e-12) for s in want)
        taken = {}
        for r in mixing.schedule(sized, slice_rows=16).collect():
            taken.setdefault(r.source, []).append(r["size"])
        assert all(abs(sum(taken[s]) - want[s]) <= 14 for s in want), (want, {s: sum(v) for s, v in taken.items()})
        assert [tuple(r) for r in mixing.mix(docs).collect()] == [tuple(r) for r in mixing.mix(docs).collect()]


def test_the_query_on_repeated_rows(spark, monkeypatch):
    rows = [(1, "a b c d e f g h i j", "s")] * 2 + [(1, "a b", "s"), (None, "x y z", None), (None, "x y z", None), (2, None, "s"), (3, "q " * 40, "t"), (3, "q " * 40, "t")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, row long, part long")
    monkeypatch.setattr(mixing, "load", lambda *_: docs)
    got = mixing.op9_mix_sources(spark, "").collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in got) == sorted((i or 0, len((t or "").split())) for i, t, _ in rows)
    assert all(r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0) for r in got)
    total = sum(r["size"] for r in got)
    assert total - 2 * 40 <= sum(r.taken for r in got) <= total
    con = duckdb.connect()
    frame = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    want = con.execute(mixing.SQL).df()
    assert sorted(zip(*[want[c].fillna(-1).astype(int).tolist() for c in ("doc_id", "size", "source_size", "taken")])) == sorted(
        (-1 if r.doc_id is None else r.doc_id, r["size"], r.source_size, r.taken) for r in got)
